"""PASS and FAIL as joins of what a report shows with what the source holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import compare_display, parse_value

#: Beginnings of scenario labels that stand for no filter.
BASELINE_LABELS = ("all$", "all data", "model measures")


def _status(passed: Column) -> Column:
    return F.when(passed, "PASS").otherwise("FAIL")


def scalar_verdicts(expected: DataFrame, actual: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One verdict for each expected item: item_id, status, match_type, difference, difference_pct.

    expected: item_id, dashboard_value.  actual: item_id, value, error (null if it ran).
    An error fails.  Without a dashboard value the item passes if the source gave a
    number.  An item without a source row fails as ``no-rows``.
    """
    a = actual.select(F.col("item_id").alias("__id"), "value", "error")
    joined = expected.join(a.withColumnRenamed("__id", "there"), F.col("item_id") == F.col("there"), "left")
    return judged_scalars(joined, tolerance)


def judged_scalars(joined: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The verdicts of :func:`scalar_verdicts` beside the columns of rows (dashboard_value, value, error, there) that have met; there: null without a source row."""
    compared = compare_display(F.col("dashboard_value"), F.col("value"), tolerance)
    shown = F.coalesce(F.trim("dashboard_value"), F.lit("")) != ""
    usable = parse_value(F.col("value"))["value"].isNotNull()
    none = F.col("there").isNull()
    return joined.select(
        *[c for c in joined.columns if c not in ("dashboard_value", "value", "error", "there")],
        _status(F.when(F.col("error").isNotNull() | none, F.lit(False)).when(~shown, usable).otherwise(compared["passed"])).alias("status"),
        F.when(F.col("error").isNotNull(), "error").when(none, "no-rows").when(~shown, "executable").otherwise(compared["match_type"]).alias("match_type"),
        F.when(shown, compared["difference"]).alias("difference"),
        F.when(shown, compared["difference_pct"]).alias("difference_pct"),
    )


def _key(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def grouped_verdicts(expected: DataFrame, actual: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Verdicts of charts: item_id, dimension, status, match_type.

    expected: item_id, dimension, raw_value.  actual: item_id, dimension, value.
    Categories meet by trimmed lower-case text.  A missing one fails; one whose shown
    value is no number passes as ``chart-category``; an item of which the source has
    more categories than shown gets a further failing row, dimension ``_COV``.
    """
    return judged_charts(None, expected, actual, tolerance)


def judged_charts(titles: DataFrame | None, expected: DataFrame, actual: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """:func:`grouped_verdicts` of the charts ``titles`` (item_id); one of them that shows nothing passes as ``executable`` if the source has a row.

    Both sides meet in one grouping by category; what a whole chart shows and lacks is
    counted from its categories.
    """
    key, text = _key("dimension").alias("key"), F.lit(None).cast("string")
    e = expected.where(F.col("dimension").isNotNull()).select("item_id", key, F.struct("dimension", "raw_value").alias("point"), text.alias("value"), F.lit(False).alias("there"))
    point = F.lit(None).cast(e.schema["point"].dataType).alias("point")
    sides = [e, actual.select("item_id", key, point, "value", F.lit(True).alias("there"))]
    if titles is not None:
        sides = [side.join(F.broadcast(titles), "item_id", "left_semi") for side in sides]  # as many rows as the plan has charts
        sides.append(titles.select("item_id", text.alias("key"), point, text.alias("value"), F.lit(False).alias("there")))
    met = reduce(DataFrame.unionByName, sides).groupBy("item_id", "key").agg(F.collect_list("point").alias("points"), F.min("value").alias("value"), F.bool_or("there").alias("there"))
    compared = compare_display(F.col("raw_value"), F.col("value"), tolerance)
    unread = parse_value(F.col("raw_value"))["value"].isNull()
    shown = met.select("item_id", "value", "there", F.inline("points")).select(
        "item_id", "dimension",
        _status(F.when(~F.col("there"), F.lit(False)).when(unread, F.lit(True)).otherwise(compared["passed"])).alias("status"),
        F.when(~F.col("there"), "chart-missing").when(unread, "chart-category").otherwise(compared["match_type"]).alias("match_type"),
    )
    counted = met.groupBy("item_id").agg(F.sum(F.size("points")).alias("shown"), F.count_if(F.col("there") & (F.size("points") == 0)).alias("more"))
    bare = F.col("shown") == 0
    whole = counted.where("shown > 0 AND more > 0" if titles is None else "shown = 0 OR more > 0").select(
        "item_id", F.when(~bare, "_COV").alias("dimension"), _status(bare & (F.col("more") > 0)).alias("status"),
        F.when(~bare, "chart-coverage").when(F.col("more") > 0, "executable").otherwise("no-rows").alias("match_type"),
    )
    return shown.union(whole)


def structural_verdicts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Categories alone: item_id, status, invalid (shown, not in the source), missing (in the source, not shown).

    Only invalid categories fail.  expected, actual: item_id, dimension.
    """
    e = expected.select("item_id", _key("dimension").alias("key")).distinct().withColumn("shown", F.lit(True))
    a = actual.select("item_id", _key("dimension").alias("key")).distinct().withColumn("held", F.lit(True))
    both = e.join(a, ["item_id", "key"], "full").groupBy("item_id")
    counted = both.agg(F.count(F.when(F.col("held").isNull(), 1)).alias("invalid"), F.count(F.when(F.col("shown").isNull(), 1)).alias("missing"))
    return counted.select("item_id", _status(F.col("invalid") == 0).alias("status"), "invalid", "missing")


def consistency_verdicts(values: DataFrame, rules: list[tuple[str, str, str, str, float]], tolerance: float = 1.0) -> DataFrame:
    """Measures against their own parts: scenario, measure, expected, actual, status.

    values: scenario, measure, value.  A rule is (measure, left, op, right, scale) with
    op one of + - * /; scenarios that lack one of the three values give no row.
    """
    names = sorted({n for m, a, _, b, _ in rules for n in (m, a, b)})
    wide = values.groupBy("scenario").pivot("measure", names).agg(F.first("value"))
    frames = []
    for measure, a, op, b, scale in rules:
        left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
        expected = {"+": left + right, "-": left - right, "*": left * right, "/": F.try_divide(left, right)}[op] * scale
        frames.append(wide.select("scenario", F.lit(measure).alias("measure"), expected.alias("expected"), F.col(f"`{measure}`").alias("actual")))
    rows = reduce(DataFrame.unionByName, frames).where("expected is not null and actual is not null")
    gap = F.abs(F.col("actual") - F.col("expected"))
    whole = F.when(F.col("expected") != 0, F.abs("expected")).when(F.col("actual") != 0, F.abs("actual")).otherwise(1.0)
    return rows.withColumn("status", _status(gap / whole * 100 <= tolerance))


def status_totals(results: DataFrame, status_col: str = "status") -> DataFrame:
    """One row: total, passed, failed, errors."""
    s = F.upper(F.col(status_col))
    return results.agg(F.count("*").alias("total"), *[F.count(F.when(s == k, 1)).alias(n) for k, n in (("PASS", "passed"), ("FAIL", "failed"), ("ERROR", "errors"))])
