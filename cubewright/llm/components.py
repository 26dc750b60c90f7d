"""Connected components by alternating large-star and small-star steps.

Only two-column edge tables move between steps, every step is a group-by-minimum
and an equi-join, and a node with any number of neighbours is never gathered
into one row: its minimum is aggregated map-side and joined back, where Spark
may split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the least node reachable.

    Self-edges are ignored and nodes without another edge are absent.  An empty
    edge table gives an empty result.
    """
    current = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _signature(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lower.select("a", F.col("m").alias("b")))
            .distinct()
        )
        following = scratch.table(small, "stars")
        now = _signature(following)
        scratch.drop(current)
        current = following
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
