"""Ranked lexical search: an index by shards of documents, searched by block-max WAND.

A task takes documents as it reads them and, whenever they have ``SHARD_POSTINGS``
postings, writes a shard: for every term one row with its blocks (see :mod:`.wand`), and
one row for the documents.  No text and no posting is shuffled, and a term of all
documents has as many rows as there are shards.  A search joins the index with the
terms of its queries and searches each shard for a block of queries at a time; the best
of the shards are put together at the end.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import slices
from .scratch import Scratch
from .terms import Terms
from .wand import Postings, pack_blocks, search
from .worker import give_back

TOP = 50
#: Postings and documents of a shard, about: what one task holds.
SHARD_POSTINGS, SHARD_DOCS = 1_500_000, 200_000
#: Queries that a shard is searched for at a time.
QUERY_BLOCK = 256
#: Terms of queries that are broadcast at most; more of them meet the index in a shuffle.
BROADCAST_TERMS = 200_000
_TOTALS = "docs bigint, terms bigint"


class _Numbering(dict):
    """Numbers in the order of first asking."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, docs, total = Terms(digits=True), 0, 0
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                n = sum(map(len, terms(text)))
                docs += n > 0
                total += n
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=["docs", "terms"])
    give_back()


class _Shard:
    """Postings of documents that are yet to be written."""

    def __init__(self):
        self.numbers = _Numbering()
        self.term, self.doc, self.tf, self.sizes = array("i"), array("i"), array("i"), array("q")
        self.ids: list[pa.Array] = []

    def add(self, ids: pa.Array, texts: list[str | None], terms: Terms) -> None:
        kept = []
        for i, text in enumerate(texts):
            counted: Counter[bytes] = Counter()
            for words in terms(text):
                counted.update(words)
            if counted:
                kept.append(i)
                self.term.extend(map(self.numbers.__getitem__, counted))
                self.tf.extend(counted.values())
                self.doc.extend([len(self.sizes)] * len(counted))
                self.sizes.append(sum(counted.values()))
        self.ids.append(ids.take(pa.array(kept, pa.int64())))

    def rows(self, name: str, docs: int, terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(self.sizes)
        if n == 0:
            return
        ids = pa.concat_arrays(self.ids)
        order = pa.compute.array_sort_indices(ids, null_placement="at_start")  # documents are numbered in the order of ties
        place = np.empty(n, np.int64)
        place[order.to_numpy()] = np.arange(n)
        m = 50 + 50 * np.array(self.sizes, np.int64)[order.to_numpy()] * docs // terms
        term, doc, tf = np.array(self.term, np.int64), place[np.array(self.doc, np.int64)], np.array(self.tf, np.int64)
        at = np.argsort(term * n + doc)
        packed = pack_blocks(term[at], doc[at], tf[at], m)
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string()).take(pa.array(packed["terms"]))
        rows = len(words)
        lists = pa.array(np.r_[0, np.cumsum(packed["blocks"])], pa.int32())
        edges = np.r_[0, np.cumsum(packed["sizes"])]
        body = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(packed["body"].tobytes())])
        columns = [
            pa.array([name] * rows), words, pa.array(packed["df"], pa.int64()), *[pa.ListArray.from_arrays(lists, pa.array(packed[c], kind)) for c, kind in (("last", pa.int32()), ("most", pa.int64()), ("ends", pa.int32()))],
            body, pa.nulls(rows, schema.field("ids").type), pa.nulls(rows, schema.field("lengths").type),
        ]
        table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        yield from table.to_batches(max_chunksize=20_000)
        one = pa.array([0, n], pa.int32())
        nothing = [pa.nulls(1, f.type) for f in list(schema)[1:-2]]
        ids_list = pa.ListArray.from_arrays(one, ids.take(order)).cast(schema.field("ids").type)
        yield pa.RecordBatch.from_arrays([pa.array([name]), *nothing, ids_list, pa.ListArray.from_arrays(one, pa.array(m)).cast(schema.field("lengths").type)], schema=schema)


def _build(docs: int, terms: int, schema: pa.Schema, postings: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, number, shard = Terms(digits=True), TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                shard.add(part.column(0), part.column("text").to_pylist(), cut)
                if len(shard.term) >= postings or len(shard.sizes) >= SHARD_DOCS:
                    yield from shard.rows(f"{task}-{number}", docs, terms, schema)
                    number, shard = number + 1, _Shard()
        yield from shard.rows(f"{task}-{number}", docs, terms, schema)
        give_back()

    return run


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> tuple[DataFrame, int]:
    """The written index of all documents, and how many have a term.

    Rows (shard, term, df, last, most, ends, body) of terms, and one of each shard's
    documents with ids (in order, null first) and lengths, whose term is null.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sums = text.select("text").mapInArrow(_count, _TOTALS).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    kind = text.schema["id"].dataType
    fields = [("shard", T.StringType()), ("term", T.StringType()), ("df", T.LongType()), ("last", T.ArrayType(T.IntegerType())), ("most", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.IntegerType())), ("body", T.BinaryType()), ("ids", T.ArrayType(kind)), ("lengths", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    built = text.mapInArrow(_build(sums["docs"] or 0, sums["terms"] or 1, to_arrow_schema(schema), shard_postings), schema)
    return scratch.table(built, "index"), sums["docs"] or 0


def _queried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, term) for the different terms of each query."""
    terms = Terms(digits=True)
    for batch in batches:
        for part in slices(batch, "text"):
            numbers, found = [], []
            for number, text in zip(part.column("query").to_pylist(), part.column("text").to_pylist()):
                once = set().union(*terms(text))
                numbers += [number] * len(once)
                found += once
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["query", "term"])


def _search(most: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asked: dict[int, list[tuple[int, int]]] = {}
        documents = group.filter(pa.compute.is_null(group.column("term")))
        lists = group.filter(pa.compute.is_valid(group.column("term")))
        m = documents.column("lengths")[0].as_py()
        ids = documents.column("ids").combine_chunks().flatten()
        last, tops, ends = (lists.column(c).to_pylist() for c in ("last", "most", "ends"))
        body = lists.column("body")
        for row, asks in enumerate(lists.column("asks").to_pylist()):
            for ask in asks:
                asked.setdefault(ask["query"], []).append((row, ask["weight"]))
        queries, scores, places = [], [], []
        bodies: dict[int, bytes] = {}
        for query, terms in asked.items():
            for row, _ in terms:
                if row not in bodies:
                    bodies[row] = body[row].as_py()
            found = search([Postings(w, last[row], tops[row], ends[row], bodies[row]) for row, w in terms], m, most)
            queries += [query] * len(found)
            scores += [s for s, _ in found]
            places += [d for _, d in found]
        columns = [pa.array(queries, pa.int64()), ids.take(pa.array(places, pa.int64())), pa.array(scores, pa.int64())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    most: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    shard_postings: int = SHARD_POSTINGS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(``query_id_col``, rank, ``id_col``, score): the ``most`` best documents of each row of ``queries``.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased.
    A term adds its weight, floor(1000 ln((2N+2) / (2df+1))), times (10^9 tf) div (1000 tf
    + 20 m) of a document, m = 50 + (50 n N) div L; N documents with a term have L terms
    together, n of them in this one.  Only documents with a score above 0 are ranked,
    equal scores by id, a null id first.

    Null and empty texts have no terms: such documents are never found and such queries
    find nothing.  A very long text is read stretch by stretch.  Each of several rows
    with one id is ranked by itself, and each query row is answered, also with an id
    that comes twice.  Empty tables give an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "search")
    index, total = build_index(docs, scratch, id_col, text_col, shard_postings)
    asked = scratch.table(
        queries.select(F.col(f"`{query_id_col}`").alias("item"), F.col(f"`{query_text_col}`").alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries"
    )
    wanted = scratch.table(asked.select("query", "text").mapInArrow(_queried, "query bigint, term string"), "wanted")
    block = F.xxhash64("query")
    blocks = max(1, -(-asked.count() // query_block))
    distinct = wanted.select("term").distinct()
    few = distinct.count() <= BROADCAST_TERMS
    df = index.select("term", "df").join(F.broadcast(distinct) if few else distinct, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total + 2.0) / (2.0 * F.col("df") + 1.0)))
    asks = scratch.table(
        wanted.join(df.select("term", weight.cast("bigint").alias("weight")), "term")
        .groupBy("term", F.pmod(block, F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "weight")).alias("asks")),  # of one block: bounded
        "asks",
    )
    few = asks.count() <= BROADCAST_TERMS
    lists = index.where("term is not null").join(F.broadcast(asks) if few else asks, "term")
    documents = index.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint")).withColumn("asks", F.lit(None).cast(asks.schema["asks"].dataType))
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    found = T.StructType([T.StructField("query", T.LongType()), id_field, T.StructField("score", T.LongType())])
    best = lists.unionByName(documents).groupBy("shard", "block").applyInArrow(_search(most, to_arrow_schema(found)), found)
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    scratch.keep_only(index, asked, asks)
    return ranked.join(asked.select("query", "item"), "query").select(F.col("item").alias(query_id_col), "rank", F.col("id").alias(id_col), "score")
