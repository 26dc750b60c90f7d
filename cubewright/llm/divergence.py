"""Source divergence audit: how far the term shares of each source lie from those of the other sources of its language.

For each two sources of a language, the pairs of counts that a term has in the one and
in the other are tallied as a joint histogram: cells where both counts are above zero
come from the terms that both hold, the cells with a zero are implied, as the terms of
a source at a count less those that the other holds as well.  The divergence is then
evaluated once for each cell, times the cell's terms.

Terms are counted by source inside each task before anything is shuffled, so a hot
source or a very frequent term sends one row for each task at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .scratch import Scratch
from .terms import Terms
from .worker import give_back

LEAST_DOCS, TOP, SMOOTHING = 30, 50, 5
#: Terms of sources that a task holds before it sends them on.
HELD_TERMS = 300_000
#: Pairs of counts that a task tallies at once, and cells that it holds before it sends them on.
TALLY_PAIRS = 1_000_000
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_CELLS = "lang string, s string, t string, a bigint, b bigint, m bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, held = Terms(digits=False), {}

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                rows = len(n)
                columns = [pa.array([lang] * rows), pa.array([source] * rows), pa.array(list(n), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, n)), pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                once: set[bytes] = set()
                for words in terms(text):
                    n.update(words)
                    once.update(words)
                docs.update(once)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from send()
    yield from send()
    give_back()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of terms that two sources hold, from (lang, held); a batch's lists are ordered by source."""
    names = ["lang", "s", "t", "a", "b", "m"]
    waiting: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(waiting).group_by(names[:-1]).aggregate([("m", "sum")]).rename_columns(names)

    for batch in batches:
        lists = batch.column("held")
        flat = lists.flatten()
        term = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
        source, n, lang = flat.field("source"), flat.field("n"), batch.column("lang")
        firsts: list[np.ndarray] = []
        gaps: list[np.ndarray] = []
        size, gap = 0, 1
        while True:
            same = np.flatnonzero(term[gap:] == term[:-gap]) if gap < len(term) else np.zeros(0, np.int64)
            firsts.append(same)
            gaps.append(same + gap)
            size += len(same)
            if size and (size > TALLY_PAIRS or not len(same)):
                left, right = pa.array(np.concatenate(firsts)), pa.array(np.concatenate(gaps))
                columns = [lang.take(pa.array(term[left.to_numpy()])), source.take(left), source.take(right), n.take(left), n.take(right), pa.array(np.ones(size, np.int64))]
                waiting.append(pa.Table.from_arrays(columns, names=names).group_by(names[:-1]).aggregate([("m", "sum")]).rename_columns(names))
                firsts, gaps, size = [], [], 0
            if not len(same):
                break
            gap += 1
        if sum(t.num_rows for t in waiting) > 2 * TALLY_PAIRS:
            waiting = [merged()]
            if waiting[0].num_rows > TALLY_PAIRS:
                yield from waiting.pop().to_batches(max_chunksize=65_536)
    if waiting:
        yield from merged().to_batches(max_chunksize=65_536)
    give_back()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in decimals, as 10^9 times a count may be beyond 64 bits."""
    wide = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, F.greatest(total + SMOOTHING * kept, F.lit(1)).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def divergence_audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    apart: Callable[[Column, Column], Column] = _apart,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part ``pair``: for each other source of the language, ``apart`` of the two shares of
    a term, summed over all kept terms, all ranks.  Part ``term``: the terms whose share
    in the source is above that in the language, by ``apart``, the first ``top`` ranks.
    ``apart`` must be symmetric.  Kept are the terms that ``least_docs`` documents of the
    language have; terms are runs of letters, of which only A-Z are lower-cased.

    Nulls are empty text, also as language and source.  A source without a term has its
    pairs and no terms; a language without a kept term has pairs of value 0.  Equal
    values rank by item in order of UTF-8.  A very long text is counted stretch by
    stretch.  Repeated rows count each; an empty table gives an empty result; columns
    other than the three are not read.  A task holds the sources of the terms of one
    batch, so there may be thousands of sources of a language; its result has a row for
    every two of them.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    # Dealt by language and term, both sums find their rows together.
    counted = docs.select(*plain).mapInArrow(_count, _COUNTS).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"))
    kept = scratch.table(listed.where(F.col("docs") >= least_docs).select("lang", "term", "total", "held"), "kept")

    entries = kept.select("lang", "term", "total", F.inline("held"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sources = docs.select(*plain[:2]).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    sources = scratch.table(sources, "sources")

    # Terms.
    sized = entries.withColumnRenamed("n", "count").join(sources, ["lang", "source"])
    p, q = _share(F.col("count"), F.col("n"), F.col("v")), _share(F.col("total"), F.col("lang_n"), F.col("v"))
    above = sized.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    valued = above.select("lang", "source", "part", "item", apart(F.col("p"), F.col("q")).cast("bigint").alias("value"))
    terms = valued.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    # Pairs.
    both = scratch.table(
        kept.select("lang", "held").where(F.size("held") > 1).mapInArrow(_tally, _CELLS).groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")), "cells"
    )
    sides = [sources.select("lang", F.col("source").alias(x), F.col("n").alias(f"{x}_n"), F.col("terms").alias(f"{x}_terms"), *(["v"] if x == "s" else [])) for x in ("s", "t")]
    pairs = scratch.table(sides[0].join(sides[1], "lang").where("s < t"), "pairs")
    marginal = entries.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("bigint")
    keys = ["lang", "s", "t", "a", "b"]
    implied = (
        pairs.select("lang", "s", "t", zero.alias("a"), zero.alias("b"), (F.col("v") - F.col("s_terms") - F.col("t_terms")).alias("m"))
        .unionByName(pairs.join(marginal.withColumnRenamed("source", "s"), ["lang", "s"]).select("lang", "s", "t", F.col("c").alias("a"), zero.alias("b"), "m"))
        .unionByName(pairs.join(marginal.withColumnRenamed("source", "t"), ["lang", "t"]).select("lang", "s", "t", zero.alias("a"), F.col("c").alias("b"), "m"))
        .unionByName(both.select("lang", "s", "t", F.explode(F.array(
            F.struct(F.col("a"), zero.alias("b"), (-F.col("m")).alias("m")), F.struct(zero.alias("a"), F.col("b"), (-F.col("m")).alias("m")), F.struct(zero.alias("a"), zero.alias("b"), F.col("m")),
        )).alias("c")).select("lang", "s", "t", "c.*"))
        .groupBy(*keys).agg(F.sum("m").alias("m"))
    )
    cells = both.unionByName(implied).join(pairs, ["lang", "s", "t"])
    f = apart(_share(F.col("a"), F.col("s_n"), F.col("v")), _share(F.col("b"), F.col("t_n"), F.col("v"))).cast("bigint")
    summed = cells.groupBy("lang", "s", "t").agg(F.sum(f * F.col("m")).alias("value"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("s", "t"), ("t", "s"))])).alias("w")
    paired = summed.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(first))
    scratch.keep_only(kept, sources, both, pairs)
    return paired.unionByName(terms)
