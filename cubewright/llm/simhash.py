"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at most
``MAX_BITS`` bits differ in at most as many bytes, so they share at least ``MIN_SHARED``
positional bytes: that is the guaranteed minimum of the count filter.  A posting list of
a single positional byte would hold 1/256 of all fingerprints, so the index is keyed by
``KEY_BYTES`` positional bytes together: a pair that shares s bytes meets in C(s, 5) of
the 56 kinds of lists.  Meetings are tallied for each pair; pairs that reach C(6, 5), and
so share six bytes or more, are retained and then verified bit by bit.

Lists over ``LONG_LIST`` are never paired or gathered: each member is posted again under
the values one bit away in the list's free bytes.  Members that meet there differ in two
bits or fewer, and a star to the least of them carries every link of the group.  A pair
within two bits whose meetings are partly in long lists is linked there, since all bytes
in which it differs are free in any list that holds both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch, without_rows
from .worker import release

BYTES = 8
MAX_BITS = 2
MIN_SHARED = BYTES - MAX_BITS
#: Positional bytes of an index key, and the meetings of a pair that shares ``MIN_SHARED`` bytes.
KEY_BYTES = 5
LEAST_MEETINGS = comb(MIN_SHARED, KEY_BYTES)
#: Lists longer than this are linked by stars over one-bit neighbours instead of by pairs.
LONG_LIST = 48
_CHUNK = 1 << 15


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of the A-Z-lower-cased text.

    Repeats count.  Fewer words than ``shingle`` make one shingle of them all; no
    word at all (null, empty, white space) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        block = words[at : min(at + _CHUNK, total) + shingle - 1]
        if len(words) < shingle:
            hashes = [digest(b" ".join(words), seed)]
        else:
            hashes = [digest(b" ".join(s), seed) for s in zip(*(block[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<i8")[0])


@F.arrow_udf(T.LongType())
def simhash_column(texts: pa.Array) -> pa.Array:
    release()
    return pa.array([simhash64(t.as_py()) for t in texts], pa.int64())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fp) of rows (id, text).  Beside :func:`simhash_column` Spark would hold the texts of rows that wait for theirs."""
    for batch in batches:
        release()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash64(t.as_py()) for t in batch.column(1)], pa.int64())], ["id", "fp"])


def _masks() -> list[tuple[int, list[int]]]:
    """(mask of the kept bytes, free bit positions) of each key."""
    out = []
    for kept in combinations(range(BYTES), KEY_BYTES):
        mask = sum(0xFF << (8 * b) for b in kept)
        out.append((_signed(mask), [8 * b + i for b in range(BYTES) if b not in kept for i in range(8)]))
    return out


def postings(fingerprints: DataFrame) -> DataFrame:
    """The index: (combo, key, fp), each distinct fingerprint under all its keys."""
    masks = F.array(*[F.lit(m) for m, _ in _masks()])
    return fingerprints.select("fp", F.posexplode(masks).alias("combo", "mask")).select("combo", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def shared_lists(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings (combo, key, fp, n) of the lists that hold n > 1 fingerprints.

    Spark takes the index for as small as the fingerprints it is made of, so without the
    hint it would broadcast the sizes of all lists through the driver.
    """
    index = postings(fingerprints)
    sizes = index.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    return scratch.table(index.join(sizes.hint("merge"), ["combo", "key"]), "lists")


def candidates(lists: DataFrame) -> DataFrame:
    """Pairs (a, b, meetings) of the short lists that meet as often as the count filter demands."""
    members = F.col("members")
    pairs = F.flatten(
        F.transform(members, lambda x, i: F.transform(F.slice(members, i + 2, F.size(members)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return (
        lists.where(F.col("n") <= LONG_LIST)
        .groupBy("combo", "key").agg(F.array_sort(F.collect_list("fp")).alias("members"))
        .select(F.explode(pairs).alias("p"))
        .groupBy("p.a", "p.b").agg(F.count("*").alias("meetings"))
        .where(F.col("meetings") >= LEAST_MEETINGS)
    )


def near_links(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect the fingerprints within two bits of one another.

    ``fingerprints``: distinct ``fp``.  Every two fingerprints within two bits are
    connected through the edges, and every edge is such a pair.
    """
    lists = shared_lists(fingerprints, scratch)
    short = candidates(lists).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    flips = F.array(
        *[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << bit)) for bit in free]) for _, free in _masks()]
    )
    near = (
        lists.where(F.col("n") > LONG_LIST)
        .select("combo", "fp", F.explode(F.element_at(flips, F.col("combo") + 1)).alias("flip"))
        .groupBy("combo", F.col("fp").bitwiseXOR(F.col("flip")).alias("between"))
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("group"))  # 25 at most
        .where(F.size("group") > 1)
        .select("a", F.explode("group").alias("b"))
        .where("a <> b")
    )
    links = scratch.table(short.union(near), "links")
    scratch.drop(lists)
    return links


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, fingerprint, component_id.

    fingerprint: 16 lowercase hex digits.  component_id: the least id among the
    rows whose fingerprints are connected by links of two bits or fewer.  Exact
    copies share a fingerprint and are never paired.  Repeated rows stay; a null
    or empty text has fingerprint zero, linked like any other; rows with a null
    id take part, and a component of null ids alone has a null component_id.  A very
    long text is hashed in pieces of words; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = scratch.table(given.mapInArrow(_hashed, T.StructType([given.schema["id"], T.StructField("fp", T.LongType())])), "fingerprints")
    groups = scratch.table(hashed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(near_links(groups.select("fp"), scratch), scratch)
    # These joins are of all fingerprints: none goes through the driver, and sides that are
    # written before let Spark split the key of a large component.
    rooted = scratch.table(
        groups.join(roots.hint("merge"), groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    label = scratch.table(rooted.join(named.hint("merge"), "root").select("fp", "component_id"), "labels")
    scratch.keep_only(hashed, label)
    return hashed.join(label.hint("merge"), "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each near-duplicate group: that with the least id.

    Columns and their order are those of ``docs``.  Of repeated rows with that
    same id one remains.  Groups without any id (null) keep one row as well, and so
    does the group of null and empty texts.  An empty table gives an empty one.  A very
    long text is one row, whose words and shingles are held at once.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]  # free of clashes with the columns below
    id_name, text_name = names[columns.index(id_col)], names[columns.index(text_col)]
    # Written once with row numbers and fingerprints: numbers made anew in a later job could differ.
    rows = scratch.table(
        docs.toDF(*names).select(F.monotonically_increasing_id().alias("row"), simhash_column(F.col(text_name)).alias("fp"), *names), "rows"
    )
    order = F.struct(F.col(id_name).isNull().alias("none"), F.col(id_name).alias("id"), F.col("row").alias("row"))
    groups = scratch.table(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = connected_components(near_links(groups.select("fp"), scratch), scratch)
    kept = (
        groups.join(roots, groups.fp == roots.node, "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    dropped = scratch.table(rows.select("row").join(kept, "row", "left_anti"), "dropped")
    scratch.keep_only(rows, dropped)
    return without_rows(rows, dropped, "row").select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
