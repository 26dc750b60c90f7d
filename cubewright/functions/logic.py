"""Branches, ordered sets, running totals and shares as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Refused


def switch_true(*arguments: Any) -> Column:
    """The value after the first condition that holds: condition, value, condition, value and so on, then what else.

    Without a last single argument the rest is null.  Conditions are Boolean columns; a
    form that compares values with one expression isn't one, and is refused.
    """
    if len(arguments) < 2:
        raise Refused("a switch needs a condition and a value")
    pairs, rest = list(zip(arguments[::2], arguments[1::2])), arguments[len(arguments) - len(arguments) % 2 :]
    if not all(isinstance(c, Column) for c, _ in pairs):
        raise Refused("a switch takes conditions, not values to compare with")
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(rest[0]) if rest else out


def in_order_once(values: Column) -> Column:
    """An array without repeats and nulls, in the order of first occurrence."""
    return F.array_distinct(F.array_compact(values))


#: Stretches that a running total over all rows is cut into, and keys that are looked at to cut it evenly.
STRETCHES, LOOKED_AT = 64, 10_000


def running_total(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), name: str = "running") -> DataFrame:
    """Adds the sum of ``value`` over the rows up to each one in ``order``, apart for each value of ``by``.

    Without ``by`` the rows are cut into stretches by their order, at keys of some of the
    rows: each stretch is summed up in itself and gets the sum of those before it.  Rows
    of equal order keys stay in one stretch, in no certain order.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by:
        return df.withColumn(name, F.sum(value).over(w))
    key = F.struct(*order)
    # Any rows do, as they only balance the stretches.
    looked = df.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h").limit(LOOKED_AT)
    keys = looked.agg(F.sort_array(F.collect_list("k")).alias("all"))  # one row, of so many keys at most
    places = F.transform(F.sequence(F.lit(1), F.lit(STRETCHES - 1)), lambda i: F.get("all", F.floor(i * F.size("all") / STRETCHES).cast("int")))
    cuts = keys.select(F.array_distinct(F.filter(places, lambda k: k.isNotNull())).alias("__cuts"))
    rows = df.join(F.broadcast(cuts)).withColumn("__stretch", F.size(F.filter("__cuts", lambda c: c <= key))).drop("__cuts")
    sums = rows.groupBy("__stretch").agg(F.sum(value).alias("s")).agg(F.collect_list(F.struct("__stretch", "s")).alias("__sums"))  # of 64 stretches at most
    within = Window.partitionBy("__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.filter("__sums", lambda e: (e["__stretch"] < F.col("__stretch")) & e["s"].isNotNull())
    kind = rows.agg(F.sum(value).alias("s")).schema["s"].dataType
    earlier = F.aggregate(before, F.lit(None).cast(kind), lambda a, e: F.coalesce((a + e["s"]).cast(kind), e["s"].cast(kind)))
    own = F.sum(value).over(within)
    total = F.when(own.isNull(), F.col("__before")).when(F.col("__before").isNull(), own).otherwise(own + F.col("__before"))
    return rows.join(F.broadcast(sums)).withColumn("__before", earlier).withColumn(name, total).drop("__stretch", "__sums", "__before")


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Adds each row's part of the sum of ``value`` over all rows, or over those with the same ``by``; null where that is zero."""
    if by:
        return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))
    whole = df.agg(F.sum(value).alias("__whole"))  # one row
    return df.join(F.broadcast(whole)).withColumn(name, F.try_divide(F.col(value), F.col("__whole"))).drop("__whole")
