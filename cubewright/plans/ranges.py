"""Aggregates over ranges of days, one range for each group, from sums that many ranges share.

Day numbers are nodes of a binary tree: a node of level k covers 2^k days.  Rows are
summed up by day and then by node, each range falls apart into at most two nodes of each
level, and an equi-join brings both together.  So neither a window over all rows nor a
join of every range with every day is needed, and minima and maxima go the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree, and a day number beyond all dates.
LEVELS = 22
FAR = (1 << LEVELS) - 1


def day_number(moment: Column) -> Column:
    """Days since the first day of the year 1; of a day before it, 0."""
    return F.greatest(F.lit(0), F.datediff(moment.cast("date"), F.lit("0001-01-01").cast("date")))


def by_node(days: DataFrame) -> DataFrame:
    """``days`` (day and other columns) once for each level, as level and node instead of day."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("day"), k).alias("node")))
    return days.withColumn("__n", F.explode(nodes)).select("__n.level", "__n.node", *[c for c in days.columns if c != "day"])


def nodes_between(ranges: DataFrame) -> DataFrame:
    """(other columns, level, node) of ``ranges`` (first, last and other columns), both ends included; an empty range has none."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), k)
        left = F.call_function("shiftright", F.col("first") + size - 1, k)  # the first node that begins in the range
        right = F.call_function("shiftright", F.col("last") + 1, k)  # the first one that ends after it
        odd_left, odd_right = left % 2 == 1, right % 2 == 1
        taken = F.array(F.when(odd_left & (left < right), left), F.when(odd_right & (left + (left % 2) < right), right - 1))
        return F.transform(F.filter(taken, lambda n: n.isNotNull()), lambda n: F.struct(k.alias("level"), n.alias("node")))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))
    kept = [c for c in ranges.columns if c not in ("first", "last")]
    return ranges.where("first <= last").withColumn("__n", F.explode(found)).select(*kept, "__n.level", "__n.node")
