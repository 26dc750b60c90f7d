"""A test suite from templates and subjects, with the verdicts that executed checks prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .verdicts import BASELINE_LABELS

# Subject, kind of test, test type, priority and the evidence that decides it.
TEMPLATES = (
    ("kpi", "qa", "Value Validation", "High", "value"),
    ("kpi", "qa", "Format Validation", "Medium", "format"),
    ("kpi", "qa", "Filter Validation", "High", "filter"),
    ("kpi", "qa", "Null/Blank Validation", "Medium", None),
    ("kpi", "qa", "Refresh Validation", "Medium", None),
    ("kpi", "qa", "Performance Validation", "Low", None),
    ("chart", "qa", "Chart Validation", "High", "chart"),
    ("chart", "qa", "Filter Validation", "High", "filter"),
    ("chart", "qa", "Cross-Filter Validation", "Medium", None),
    ("chart", "qa", "Tooltip Validation", "Low", None),
    ("chart", "qa", "Formatting Validation", "Low", None),
    ("chart", "qa", "Export Validation", "Medium", None),
    ("chart", "qa", "Performance Validation", "Low", None),
    ("filter", "qa", "Filter Validation", "High", None),
    ("filter", "qa", "Selection Validation", "Medium", None),
    ("page", "qa", "Navigation Validation", "Medium", None),
    ("page", "qa", "Export Validation", "Low", None),
    ("kpi", "unit", "Visual Binding Test", "Medium", "binding"),
    ("chart", "unit", "Visual Binding Test", "Medium", "binding"),
    ("chart", "unit", "Formatting Test", "Low", None),
    ("measure", "unit", "Measure Test", "High", "measure"),
    ("measure", "unit", "Formula Test", "Medium", "formula"),
    ("relationship", "unit", "Relationship Test", "High", "relationship"),
    ("table", "unit", "Dataset Test", "Medium", "dataset"),
)
_TEMPLATE = "subject_kind string, kind string, test_type string, priority string, proof string"
LISTED = 6


def templates(spark: SparkSession) -> DataFrame:
    """subject_kind, kind, test_type, priority, proof of the standing templates."""
    return spark.createDataFrame(list(TEMPLATES), _TEMPLATE)


def evidence(results: DataFrame) -> DataFrame:
    """key, proof, status, remark: what executed checks prove of each subject.

    results: test_id, subject, scenario, status, match_type.  Checks of charts prove
    ``chart``; others ``value`` without a filter and ``filter`` with one; those whose text
    is exactly that shown also ``format``.  One failure fails the proof.
    """
    kind = F.coalesce("match_type", F.lit(""))
    label = F.lower(F.coalesce("scenario", F.lit("")))
    base = (label == "") | label.rlike(f"^({'|'.join(BASELINE_LABELS)})")
    chart = kind.startswith("chart")
    proofs = F.array_compact(F.array(F.when(chart, "chart"), F.when(~chart & base, "value"), F.when(~chart & ~base, "filter"), F.when(kind == "exact", "format")))
    rows = results.select(F.lower(F.trim("subject")).alias("key"), F.explode(proofs).alias("proof"), "test_id", (F.upper("status") == "FAIL").alias("bad"))
    # The first few ids are wanted, so they are ranked before anything is gathered.
    one = Window.partitionBy("key", "proof")
    ranked = rows.withColumns({"n": F.row_number().over(one.orderBy(F.desc("bad"), "test_id")), "failed": F.count_if("bad").over(one), "total": F.count("*").over(one)})
    few = ranked.where(F.col("n") <= LISTED).groupBy("key", "proof", "failed", "total").agg(F.array_sort(F.collect_list(F.struct("n", "test_id", "bad"))).alias("ids"))

    def listed(ids: Column) -> Column:
        return F.array_join(F.transform(ids, lambda i: i["test_id"]), ", ")

    wrong = F.format_string("%d of %d executed checks failed: %s", "failed", "total", listed(F.filter("ids", lambda i: i["bad"])))
    return few.select("key", "proof", F.when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("status"), F.when(F.col("failed") > 0, wrong).otherwise(F.concat(F.lit("proven by "), listed(F.col("ids")))).alias("remark"))


def checked(results: DataFrame, proof: str) -> DataFrame:
    """key, proof, status, remark of one of the :mod:`model_checks` frames."""
    return results.select(F.lower(F.trim("entity")).alias("key"), F.lit(proof).alias("proof"), "status", F.col("reason").alias("remark"))


def expand(subjects: DataFrame, proofs: DataFrame, standing: DataFrame) -> DataFrame:
    """subject_kind, subject, kind, module, test_type, test_scenario, priority, status, remark, automatable.

    subjects: subject_kind, subject.  standing: as :func:`templates` gives them; each meets
    the subjects of its kind.  proofs: key, proof, status, remark.  A test takes a verdict
    only from the proof that its template names, and is otherwise not executed.
    """
    cases = subjects.distinct().join(F.broadcast(standing), "subject_kind")  # a standing list
    named = F.concat(F.initcap("subject_kind"), F.lit(": "), F.col("subject"))
    module = F.when(F.col("subject_kind") == "kpi", F.concat(F.lit("KPI: "), F.col("subject"))).when(F.col("subject_kind") == "filter", "Filters").otherwise(named)
    met = cases.withColumn("key", F.lower(F.trim("subject"))).join(proofs.select("key", "proof", "status", "remark"), ["key", "proof"], "left")
    return met.select(
        "subject_kind", "subject", "kind", module.alias("module"), "test_type", F.format_string("%s of %s '%s'", "test_type", "subject_kind", "subject").alias("test_scenario"),
        "priority", F.coalesce("status", F.lit("Not Executed")).alias("status"), F.coalesce("remark", F.lit("")).alias("remark"), F.col("proof").isNotNull().alias("automatable"),
    )


#: Letters of the longest grams that index texts; shorter ones have each power of two below.
LONGEST_GRAM = 16


def _grams(text: str, size: int) -> Column:
    """Hashes of the different grams of so many letters; none in a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr(text, i, F.lit(size)))))).otherwise(F.array().cast("array<bigint>"))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) of all different texts of ``parts`` that lie within one of ``wholes``; frames of one text column, empty and null parts lie in nothing.

    An index holds the grams of 1, 2, 4, ... letters of the wholes, as hashes; a part is looked
    for under the rarest of its own grams of the longest kind that fits into it.  Spark takes an
    index for as small as the texts it is made of, so the hints keep it from being broadcast
    through the driver.
    """
    part = parts.toDF("part").where("part <> ''").distinct()
    whole = wholes.toDF("whole").where("whole <> ''").distinct()
    sizes = [1 << i for i in range(LONGEST_GRAM.bit_length())]
    own = F.coalesce(*[F.when(F.length("part") >= n, _grams("part", n)) for n in reversed(sizes)])
    asked = part.select("part", F.explode(own).alias("gram"))
    # Only grams that some part has are of use; a gram that no whole has says that the part lies in none.
    index = whole.select("whole", F.explode(F.concat(*[_grams("whole", n) for n in sizes])).alias("gram")).join(asked.select("gram").distinct().hint("merge"), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = asked.join(counts.hint("merge"), "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("gram"))
    return rarest.join(index.hint("merge"), "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")


def match_findings(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """test_case_id, status, findings: each generated case with the findings it is about.

    cases: test_case_id, rule_id, entity (part of a finding's entity, whatever its case).
    findings: rule_id, entity, passed.  Findings of both the rule and the entity come
    first, then those of the rule, then those of the entity.  A case without any isn't
    executed; one failure fails it.  A case's entity is looked for through :func:`contained`
    among the findings' entities.
    """
    c = cases.select("test_case_id", F.trim(F.coalesce("rule_id", F.lit(""))).alias("r"), F.lower(F.trim(F.coalesce("entity", F.lit("")))).alias("e"))
    f = findings.select("rule_id", F.lower(F.coalesce("entity", F.lit(""))).alias("entity"), "passed")
    inside = contained(c.select("e"), f.select("entity")).toDF("e", "entity").hint("merge")
    of_rule = c.where("r <> ''").join(f, F.col("r") == F.col("rule_id")).join(inside.withColumn("both", F.lit(True)), ["e", "entity"], "left")
    by_rule = of_rule.select("test_case_id", F.when(F.col("both"), 0).otherwise(1).alias("rank"), "rule_id", "entity", "passed")
    by_entity = c.join(inside, "e").join(f.hint("merge"), "entity").select("test_case_id", F.lit(2).alias("rank"), "rule_id", "entity", "passed")
    every = by_rule.union(by_entity)
    best = every.groupBy("test_case_id").agg(F.min("rank").alias("best"))
    kept = every.join(best.hint("merge"), "test_case_id").where("rank = best").groupBy("test_case_id").agg(F.count("*").alias("findings"), F.count_if(~F.col("passed")).alias("failed"))
    out = c.select("test_case_id").join(kept.hint("merge"), "test_case_id", "left")
    return out.select("test_case_id", F.when(F.col("findings").isNull(), "NOT EXECUTED").when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))
