"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text becomes an array of word hashes, then of hashes of ``GRAM`` consecutive words,
and of every ``WINDOW`` consecutive gram hashes the least is kept.  A shared span of
``GRAM + WINDOW - 1`` words, the contract's 13, has a whole window of grams and so at
least one kept hash in common: none is missed.

Kept hashes of a document become rows, each with the words around it, and are joined with
the benchmark's kept hashes; only those that meet are extended to the 13-word spans around
them, which are joined with the benchmark's own spans by their words.  Before any row is
made a bit set of the benchmark's hashes, of a fixed largest size, spares most of them;
results don't depend on it.  Items of fewer than 13 words are spans of their own length,
whose hash is looked up at every position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, without_rows
from .text import ascii_lower

SPAN, GRAM = 13, 6
#: Grams in a window; a power of two, for the sliding minimum doubles its reach.
WINDOW = SPAN - GRAM + 1
#: What parts words: ASCII characters other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits wanted for each hash of the benchmark, and the bounds of the bit set (powers of two).
BITS_PER_HASH, MIN_BITS, MAX_BITS = 128, 1 << 14, 1 << 23
#: The benchmark's spans are broadcast up to this many bytes of text, else joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Hashes of the benchmark are broadcast up to this many rows, else joined by shuffle.
BROADCAST_HASHES = 500_000
_MARK_TYPE = "array<struct<h:bigint,start:int,len:int,around:array<string>>>"


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def with_word_hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _gram_hash(length: int) -> Column:
    """32-bit hash of ``length`` words from each position; null where the text ends before."""
    hashes = F.col("hashes")
    return F.transform(
        hashes,
        lambda h, i: F.when(
            i <= F.size(hashes) - F.lit(length),
            F.shiftrightunsigned(F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, length)], F.lit(length)), 32),
        ),
    )


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds ``minima``: for each window of grams its least hash and that gram's position, packed in one number."""
    df = df.withColumn("minima", F.transform(_gram_hash(GRAM), lambda h, i: F.shiftleft(h, 31) + i))
    reach = 1
    while reach < WINDOW:
        df = df.withColumn("minima", _least_with_next("minima", reach))
        reach *= 2
    return df


def _least_with_next(name: str, distance: int) -> Column:
    array = F.col(name)
    return F.transform(array, lambda v, i: F.least(v, F.get(array, i + F.lit(distance))))


class Benchmark:
    """Spans, items and bit set of the benchmark texts."""

    def __init__(self, items: DataFrame, scratch: Scratch, id_col: str, text_col: str):
        listed = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
        length = F.least(F.size("words"), F.lit(SPAN))
        starts = F.sequence(F.lit(0), F.size("words") - length)
        cut = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, length), " "))
        self.spans = scratch.table(
            listed.where(F.size("words") > 0).select("item_id", length.alias("len"), F.explode(cut).alias("span")).distinct(),
            "benchmark-spans",
        )
        hashed = with_fingerprints(with_word_hashes(listed.where(F.size("words") > 0).select("words").distinct()))
        self.short = sorted(r["len"] for r in self.spans.where(F.col("len") < SPAN).select("len").distinct().collect())
        long_keys = hashed.where(F.size("words") >= SPAN).select(
            F.explode(F.array_compact("minima")).alias("v")
        ).select(F.shiftrightunsigned("v", 31).alias("h"))
        short_keys = [
            hashed.where(F.size("words") == m).select(F.element_at(_gram_hash(m), 1).alias("h")) for m in self.short
        ]
        self.hashes = keys = scratch.table(reduce(DataFrame.union, short_keys, long_keys).distinct(), "benchmark-hashes")
        size = self.spans.agg(F.count("*").alias("n"), F.sum(F.octet_length("span")).alias("bytes")).first()
        self.small = (size["bytes"] or 0) <= BROADCAST_BYTES
        held = keys.count()
        self.few = held <= BROADCAST_HASHES
        wanted = max(MIN_BITS, min(MAX_BITS, held * BITS_PER_HASH))
        self.bits = 1 << (wanted - 1).bit_length()
        words = (
            keys.select(F.col("h").bitwiseAND(F.lit(self.bits - 1)).alias("b"))
            .groupBy(F.shiftright("b", 6).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
            .collect()  # at most MAX_BITS / 64 rows
        )
        table = [0] * (self.bits // 64)
        for r in words:
            table[r["w"]] = r["bits"]
        self.table = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def has(self, h: Column) -> Column:
        """Whether the bit set has a hash."""
        b = h.bitwiseAND(F.lit(self.bits - 1))
        word = F.get(self.table, F.shiftright(b, 6).cast("int"))
        return F.getbit(word, b.bitwiseAND(F.lit(63)).cast("int")) == 1


def fingerprint_marks(df: DataFrame, bench: Benchmark) -> DataFrame:
    """Adds ``marks``: kept hashes that the bit set lets pass, with the words of the spans around them.  Needs ``words``."""
    df = with_fingerprints(with_word_hashes(df))
    words, n = F.col("words"), F.size("words")
    kept = F.array_distinct(F.filter("minima", lambda v: bench.has(F.shiftrightunsigned(v, 31))))

    def mark(v: Column) -> Column:
        place = v.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        start = F.greatest(place - (WINDOW - 1), F.lit(0))
        return F.struct(
            F.shiftrightunsigned(v, 31).alias("h"), start.alias("start"), F.lit(SPAN).alias("len"),
            F.slice(words, start + 1, F.least(place + SPAN, n) - start).alias("around"),
        )

    found = [F.filter(F.transform(kept, mark), lambda m: F.size(m["around"]) >= SPAN)]
    for m in bench.short:
        hashed = F.transform(_gram_hash(m), lambda h, i: F.when(bench.has(h), F.struct(h.alias("h"), i.alias("start"), F.lit(m).alias("len"), F.slice(words, i + 1, F.lit(m)).alias("around"))))
        found.append(F.array_compact(hashed))
    return df.withColumn("marks", F.concat(*[f.cast(_MARK_TYPE) for f in found]))


def spans_around(marks: DataFrame) -> DataFrame:
    """A row (start, len, span) for each span that the marks (start, len, around) may stand in; other columns stay."""
    offset = F.explode(F.sequence(F.lit(0), F.size("around") - F.col("len"))).alias("offset")
    return marks.select("*", offset).select(
        *[c for c in marks.columns if c not in ("h", "start", "len", "around")],
        (F.col("start") + F.col("offset")).alias("start"), "len", F.array_join(F.slice("around", F.col("offset") + 1, F.col("len")), " ").alias("span"),
    )


def _covered(ends: Column) -> Column:
    """Positions covered by (start, end) structs sorted by start, end exclusive."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        ends,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            (acc["n"] + F.greatest(s["end"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per input row: its columns ``keep`` (``id_col`` alone by default), then n_words, n_hit, n_items, item_ids, contaminated.

    n_hit: words inside any occurrence of a span of the benchmark.  item_ids: the
    items with occurring spans, sorted as strings.  contaminated: n_hit > 0 and
    20 * n_hit >= n_words.  A null or empty text has no words and isn't
    contaminated; an item without words is never found; items that repeat or have
    a null id count once each id, null ids not at all in item_ids.  An empty
    benchmark finds nothing.  Kept columns with the new names are replaced.  A very
    long text is one row: its words and hashes take some 60 bytes a word at once.
    """
    new = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    kept = [c for c in (keep or [id_col]) if c not in new]
    scratch = Scratch(docs.sparkSession, "decontam")
    bench = Benchmark(benchmark, scratch, item_col, item_text_col)
    rows, hits, counted = _matches(docs, bench, scratch, text_col, kept)
    scratch.keep_only(rows, hits, bench.spans)
    items = bench.spans.select("span", "len", "item_id").where(F.col("item_id").isNotNull())
    named = (
        hits.select("row", "span", "len").distinct().join(F.broadcast(items) if bench.small else items, ["span", "len"])
        .groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    found = counted.drop("n_words").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select("row", "kept", "n_words").join(found, "row", "left").select(
        *[F.col("kept")[c].alias(c) for c in kept],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def fingerprint_hits(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """Marks (row, n_words, h, start, len, around) whose hash is one of the benchmark's."""
    marks = rows.select("row", "n_words", F.explode("marks").alias("m")).select("row", "n_words", "m.*")
    return marks.join(F.broadcast(bench.hashes) if bench.few else bench.hashes, "h", "left_semi")


def _matches(docs: DataFrame, bench: Benchmark, scratch: Scratch, text_col: str, kept: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written rows (row, kept, n_words, marks), their verified spans, and the words hit in each row that has any."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), words_of(F.col(f"`{text_col}`")).alias("words"))
    rows = scratch.table(
        fingerprint_marks(base, bench).select(
            F.monotonically_increasing_id().alias("row"), "kept", F.size("words").cast("bigint").alias("n_words"), "marks"
        ),
        "candidates",
    )
    known = bench.spans.select("span", "len").distinct()
    spread = spans_around(fingerprint_hits(rows, bench))
    hits = scratch.table(spread.join(F.broadcast(known) if bench.small else known, ["span", "len"], "left_semi"), "hits")
    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    return rows, hits, hits.groupBy("row").agg(_covered(ends).alias("n_hit"), F.first("n_words").alias("n_words"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated rows; columns and their order stay.

    A null or empty text has no words and stays; repeated rows stay or go alike.  An
    empty benchmark drops nothing, and an empty table gives an empty one.  A very long
    text is one row, as :func:`contamination` has it.
    """
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]  # free of clashes with the operator's names
    scratch = Scratch(docs.sparkSession, "decontam")
    bench = Benchmark(benchmark, scratch, item_col, item_text_col)
    rows, _, counted = _matches(docs.toDF(*names), bench, scratch, names[columns.index(text_col)], names)
    bad = scratch.table(counted.where(_contaminated(F.col("n_hit"), F.col("n_words"))).select("row"), "contaminated")
    scratch.keep_only(rows, bad)
    return without_rows(rows.select("row", "kept"), bad, "row").select(*[F.col("kept")[n].alias(c) for n, c in zip(names, columns)])
