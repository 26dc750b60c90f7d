"""Test suites: removing duplicates, choosing plan items, roll-ups of suites and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import title_concepts

# Beginnings or parts of module names and their suites, first match first.
SUITES = (
    ("sql validation:", "SQL Tests"), ("kpi:", "KPI Tests"), ("chart:", "Visual Tests"), ("filters", "Filter Tests"),
    ("slicer", "Filter Tests"), ("navigation", "Navigation Tests"), ("measure", "Measure / DAX Tests"), ("dax", "Measure / DAX Tests"),
    ("relationship", "Data Model Tests"), ("dataset", "Data Model Tests"), ("model", "Data Model Tests"), ("page", "Navigation Tests"),
    ("security", "Data Model Tests"),
)
#: Unexecuted tests kept for each subject and priority.
CAPS = {"high": 3, "medium": 2, "low": 1}


def _lower(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def best_plan_items(plan: DataFrame) -> DataFrame:
    """Of items with one scenario, KPI and type the surest; of equally sure ones the first by ``item_id``."""
    w = Window.partitionBy("scenario_id", "kpi_name", "item_type").orderBy(F.desc("confidence"), "item_id")
    return plan.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def deduplicate_tests(cases: DataFrame) -> DataFrame:
    """Tests without duplicates and surplus templates; columns stay.

    cases: test_case_id, kind, module, test_scenario, test_data, status, priority,
    generated_sql.  An executed test (with a query or a verdict) goes only if another
    executed one has its fingerprint, data and query.  A template goes if an executed
    test or an earlier template proves the same, or if its subject has enough of its
    priority.  Order: executed, then high priority, then test_case_id.
    """
    status, priority = _lower("status"), _lower("priority")
    executed = (F.coalesce(F.col("generated_sql"), F.lit("")) != "") | status.isin("pass", "fail", "warning")
    level = F.when(priority.startswith("high"), "high").when(priority.startswith("low"), "low").otherwise("medium")
    query = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("generated_sql"), F.lit("")), r"\s+", " ")))
    base = F.struct(F.coalesce(F.col("kind"), F.lit("")).alias("k"), _lower("module").alias("m"), title_concepts(F.col("test_scenario")).alias("t"))
    marked = cases.withColumns({"__executed": executed, "__level": level, "__base": base, "__data": _lower("test_data"), "__query": query})
    order = [(F.col("__level") != "high").cast("int"), F.col("test_case_id")]
    done = marked.where("__executed")
    first = Window.partitionBy("__base", "__data", "__query").orderBy(*order)
    done = done.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    proved = done.select(F.col("__base").alias("__proved")).distinct()
    open_ = marked.where("not __executed").join(proved, F.col("__base") == F.col("__proved"), "left_anti")
    once = Window.partitionBy("__base").orderBy(*order)
    open_ = open_.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    rank = Window.partitionBy("__level", _lower("module")).orderBy(*order)
    cap = reduce(lambda c, k: c.when(F.col("__level") == k, CAPS[k]), ("medium", "low"), F.when(F.col("__level") == "high", CAPS["high"]))
    open_ = open_.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= cap).drop("__n")
    return done.unionByName(open_).select(*cases.columns)


def suite_of(module: Column, scenario: Column) -> Column:
    m, s = F.lower(F.coalesce(module, F.lit(""))), F.lower(F.coalesce(scenario, F.lit("")))
    out = F.when(m.contains("performance") | s.contains("performance"), "Performance Tests")
    return reduce(lambda c, x: c.when(m.contains(x[0]), x[1]), SUITES, out).otherwise("Other Tests")


def suite_rollup(cases: DataFrame) -> DataFrame:
    """suite, total, passed, failed, other, automatable, manual; largest first."""
    status = F.lower(F.coalesce(F.trim("status"), F.lit("")))
    auto = F.coalesce(F.col("automatable"), F.lit(False))
    counts = {
        "total": F.lit(True), "passed": status == "pass", "failed": status == "fail", "other": ~status.isin("pass", "fail"),
        "automatable": auto, "manual": ~auto,
    }
    grouped = cases.groupBy(suite_of(F.col("module"), F.col("test_scenario")).alias("suite"))
    return grouped.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()]).orderBy(F.desc("total"), "suite")


def run_totals(runs: DataFrame) -> DataFrame:
    """One row over all runs; the mean duration is that of timed runs, severities are those of runs that have them."""
    timed = F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))
    severe = (F.col("issues_high") + F.col("issues_medium") + F.col("issues_low")) > 0
    chosen = F.col("candidates") > 0
    return runs.agg(
        F.count("*").alias("runs"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tests_total", "tests_passed", "tests_failed", "tokens", "llm_calls")],
        F.avg(timed).alias("mean_ms"),
        *[F.coalesce(F.sum(F.when(severe, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("issues_high", "issues_medium", "issues_low")],
        *[F.coalesce(F.sum(F.when(chosen, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("candidates", "duplicates_removed", "low_value_skipped")],
    )


def recent_runs(runs: DataFrame, most: int = 8) -> DataFrame:
    return runs.orderBy(F.desc("generated_at"), "project_id").limit(most)


def trend(runs: DataFrame, most: int = 14) -> DataFrame:
    """The last runs, oldest first."""
    return recent_runs(runs, most).orderBy("generated_at", "project_id")


def last_runs(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Each project with its last run, nulls where it never ran, newest first."""
    last = runs.groupBy(F.col("project_id").alias("__project")).agg(F.max_by(F.struct("*"), F.col("generated_at")).alias("run"))
    joined = projects.join(last, F.col("project_id") == F.col("__project"), "left")
    return joined.select(*projects.columns, F.col("run.generated_at").alias("generated_at"), F.col("run.tests_total").alias("tests_total")).orderBy(
        F.desc_nulls_last("generated_at"), "project_id"
    )


def usage_by_stage(calls: DataFrame) -> DataFrame:
    """stage, calls, tokens and the share of all tokens."""
    by_stage = calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return by_stage.join(F.broadcast(calls.agg(F.sum("tokens").alias("all_tokens")))).select(
        "stage", "calls", "tokens", F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens").cast("double")).alias("share")
    )


def activity_feed(kinds: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """Events of several kinds (at, text) as one list, newest first; ``most`` is held to 1 to 300."""
    frames = [df.select(F.lit(k).alias("kind"), "at", "text") for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, frames).orderBy(F.desc("at"), "kind", "text").limit(max(1, min(300, most)))
