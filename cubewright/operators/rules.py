"""Rules over a model's metadata, each a filter or anti-join that gives findings.

Findings: rule_id, severity, passed, entity, actual.  A rule without an offender gives
one passing row where it has a positive statement to make.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> frame: tables(table), columns(table, column), measures(table, measure, formula),
#: relationships(from_table, from_column, to_table, to_column, active), visuals(page, visual, fields), pages(page), bookmarks(bookmark, page)
Metadata = dict[str, DataFrame]


def _findings(df: DataFrame, rule: str, severity: str, entity, actual, passed: bool = False) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(passed).alias("passed"), entity.cast("string").alias("entity"), actual.cast("string").alias("actual")
    )


def _or_pass(found: DataFrame, rule: str) -> DataFrame:
    none = found.agg(F.count("*").alias("n")).where("n = 0")
    return found.union(_findings(none, rule, "INFO", F.lit("model"), F.lit("none"), True))


def measures_have_formulas(m: Metadata) -> DataFrame:
    bad = m["measures"].where(F.trim(F.coalesce("formula", F.lit(""))) == "")
    return _or_pass(_findings(bad, "MD-001", "ERROR", F.format_string("%s[%s]", "table", "measure"), F.lit("(empty)")), "MD-001")


def tables_have_columns(m: Metadata) -> DataFrame:
    bad = m["tables"].join(m["columns"].select("table").distinct(), "table", "left_anti")
    return _or_pass(_findings(bad, "MD-002", "WARNING", F.col("table"), F.lit("0 columns")), "MD-002")


def relationships_are_whole(m: Metadata) -> DataFrame:
    known = m["columns"].select(F.concat_ws("|", "table", "column").alias("known")).distinct()
    ends = m["relationships"].select(
        F.format_string("%s->%s", "from_table", "to_table").alias("entity"),
        F.explode(F.array(F.concat_ws("|", "from_table", "from_column"), F.concat_ws("|", "to_table", "to_column"))).alias("end"),
    )
    bad = ends.join(known, F.col("end") == F.col("known"), "left_anti").groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("end")), ", ").alias("ends"))
    return _or_pass(_findings(bad, "MD-003", "CRITICAL", F.col("entity"), F.col("ends")), "MD-003")


def inactive_relationships(m: Metadata) -> DataFrame:
    return _findings(m["relationships"].where("not active"), "MD-004", "INFO", F.format_string("%s->%s", "from_table", "to_table"), F.lit("inactive"), True)


def measure_names_are_unique(m: Metadata) -> DataFrame:
    counted = m["measures"].groupBy(F.lower("measure").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    return _or_pass(_findings(counted, "MD-005", "WARNING", F.col("name"), F.format_string("%d definitions", "n")), "MD-005")


def visuals_have_fields(m: Metadata) -> DataFrame:
    return _or_pass(_findings(m["visuals"].where(F.size("fields") == 0), "MD-006", "WARNING", F.col("visual"), F.lit("0 fields")), "MD-006")


def pages_have_visuals(m: Metadata) -> DataFrame:
    bad = m["pages"].join(m["visuals"].select("page").distinct(), "page", "left_anti")
    return _or_pass(_findings(bad, "MD-007", "WARNING", F.col("page"), F.lit("0 visuals")), "MD-007")


def bookmarks_have_pages(m: Metadata) -> DataFrame:
    bad = m["bookmarks"].where(F.coalesce("page", F.lit("")) != "").join(m["pages"].select("page").distinct(), "page", "left_anti")
    return _findings(bad, "MD-008", "ERROR", F.col("bookmark"), F.col("page"))


RULES: tuple[Callable[[Metadata], DataFrame], ...] = (
    measures_have_formulas, tables_have_columns, relationships_are_whole, inactive_relationships,
    measure_names_are_unique, visuals_have_fields, pages_have_visuals, bookmarks_have_pages,
)


def check_model(m: Metadata, rules: tuple[Callable[[Metadata], DataFrame], ...] = RULES) -> DataFrame:
    """All findings of all rules, in order.

    A rule whose frame lacks a table or column gives the finding ``RULE-ERROR`` instead, and the others go on.
    """
    spark = next(iter(m.values())).sparkSession
    frames = []
    for rule in rules:
        try:
            frames.append(rule(m))
        except (PySparkException, KeyError) as e:
            row = (rule.__name__, f"{type(e).__name__}: {str(e).splitlines()[0]}")
            frames.append(_findings(spark.createDataFrame([row], "entity string, actual string"), "RULE-ERROR", "ERROR", F.col("entity"), F.col("actual")))
    return reduce(DataFrame.unionByName, frames)


def check_images(images: DataFrame, least_width: int = 640) -> DataFrame:
    """Screenshots that can't be read (null width) or are too narrow.  images: image, width."""
    unread = _findings(images.where("width is null"), "VS-001", "ERROR", F.col("image"), F.lit("unreadable"))
    return unread.union(_findings(images.where(F.col("width") < least_width), "VS-002", "WARNING", F.col("image"), F.col("width")))


def failed_comparisons(comparisons: DataFrame) -> DataFrame:
    """Comparisons (entity, passed, actual) that failed, as findings."""
    return _findings(comparisons.where("not passed"), "CMP-001", "ERROR", F.col("entity"), F.col("actual"))
