"""Registered queries of plans, checks and expansion, and further ones over the driver's tables for operators on metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import display, names
from .functions.logic import in_order_once, running_total
from .model import derived
from .operators import expansion, matching, model_checks, rules
from .plans import measures as M
from .plans import validation
from .queries import _SHOWN, _SLICERS, MEASURES, _evaluator, _measure, _round, _shown, net
from .registry import query
from .scratch import Scratch, owned
from .sources import catalog, runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Order, limits and members ------------------------------------------------------


@query("SRT-01_in_order", f"SELECT c_name AS dim, {_round('sum(o_totalprice)')} AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 500")
def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _evaluator(spark, sf_dir).values({"value": M.Reference("Order Value")}, by=("customer", "c_name"), order="dim", limit=500)
    return out.withColumn("value", F.round("value", 4))


@query("SRT-02_limit", "SELECT DISTINCT o_clerk AS dim FROM (SELECT o_orderpriority || o_orderstatus || (o_orderkey % 100) AS o_clerk FROM orders) ORDER BY 1 LIMIT 500")
def _limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    clerk = {"o_clerk": _text(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 100)}
    evaluator.model.tables.opened["orders"] = derived(evaluator.model.table("orders"), clerk)
    return evaluator.members("orders", "o_clerk", limit=500)


@query("SRT-03_many_keys", "SELECT p_type AS dim, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY returned DESC, lines, dim NULLS FIRST LIMIT 20")
def _many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"lines": M.Reference("Lines"), "returned": M.Reference("Returned Lines")}
    return _evaluator(spark, sf_dir).values(wanted, by=("part", "p_type"), order=("-returned", "lines"), limit=20)


@query(
    "SRT-04_scenarios",
    """WITH m AS (SELECT 'customer' AS t, 'c_mktsegment' AS c, c_mktsegment AS member FROM customer UNION SELECT 'orders', 'o_orderstatus', o_orderstatus FROM orders UNION SELECT 'lineitem', 'l_returnflag', l_returnflag FROM lineitem),
    r AS (SELECT *, count(*) OVER (PARTITION BY t, c) AS n, row_number() OVER (PARTITION BY t, c ORDER BY member) AS place FROM m),
    o AS (SELECT *, row_number() OVER (ORDER BY n, t, c, place) AS k FROM r WHERE place <= 2)
    SELECT CAST(k + 1 AS INTEGER) AS scenario_no, t AS "table", c AS "column", member FROM o WHERE k < 5""",
)
def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = catalog.slicer_members(_evaluator(spark, sf_dir).model.tables, [*_SLICERS, ("lineitem", "l_returnflag")])
    return validation.representative_scenarios(members, most=5, each=2)


_measure("AGG-16_guarded", validation.guarded_aggregate(MEASURES["Gross Sales"], "LineItem", "l_extendedprice", "sum"), f"SELECT {_round('sum(l_extendedprice)')} AS value FROM lineitem")


@query("PRJ-03_calculated_column", f"SELECT l_returnflag AS dim, {_round('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))')} AS value FROM lineitem GROUP BY 1")
def _calculated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    columns = {"net": net, "charge": lambda: F.col("net") * (1 + F.col("l_tax"))}
    evaluator.model.tables.opened["lineitem"] = derived(evaluator.model.table("lineitem"), columns)
    return evaluator.values({"value": M.total("lineitem", "charge")}, by=("lineitem", "l_returnflag")).withColumn("value", F.round("value", 4))


@query("PRJ-05_members", "SELECT DISTINCT c_mktsegment AS dim FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluator(spark, sf_dir).members("customer", "c_mktsegment", [M.Is("region", "r_name", "ASIA")])


@query("SET-06_in_order_once", "SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '') AS digits FROM (SELECT o_orderkey, string_split(CAST(o_orderkey AS VARCHAR), '') AS l FROM orders)")
def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    digits = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.substr(key, i, F.lit(1)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(in_order_once(digits), "").alias("digits"))


# Plans and runs ------------------------------------------------------------------


def _chosen(evaluator) -> dict[str, tuple[M.Is, ...]]:
    return validation.scenarios_of(validation.representative_scenarios(catalog.slicer_members(evaluator.model.tables, list(_SLICERS))))


_CHOSEN = """(SELECT 'all' AS scenario UNION ALL SELECT 'o_orderstatus=' || min(o_orderstatus) FROM orders UNION ALL SELECT 'c_mktsegment=' || min(c_mktsegment) FROM customer)"""
_RUN = ("Order Value", "Orders", "Gross Sales", "AOV")


@query(
    "VAL-01_run",
    f"""WITH p AS (SELECT o_orderpriority AS d FROM orders GROUP BY 1)
    SELECT scenario || '/' || m AS item_id, 'scalar' AS item_type, scenario, m AS measure, NULL AS dimension, CASE WHEN m = 'Broken' OR (scenario = 'all' AND m = 'Orders') THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN m = 'Broken' THEN 'error' WHEN scenario = 'all' AND m = 'Orders' THEN '' WHEN scenario = 'all' AND m = 'Order Value' THEN 'numeric' ELSE 'executable' END AS match_type
    FROM {_CHOSEN}, (SELECT unnest(['Order Value', 'Orders', 'Gross Sales', 'AOV', 'Broken']) AS m)
    UNION ALL SELECT scenario || '/AOV', 'consistency', scenario, 'AOV', NULL, 'PASS', 'dax-consistency' FROM {_CHOSEN}
    UNION ALL SELECT 'priorities', 'grouped', 'all', 'Order Value', d, CASE WHEN d = '1-URGENT' THEN 'FAIL' ELSE 'PASS' END, CASE WHEN d = '1-URGENT' THEN '' ELSE 'numeric' END FROM p WHERE d < '5'
    UNION ALL SELECT 'priorities', 'grouped', 'all', 'Order Value', '_COV', 'FAIL', 'chart-coverage'
    UNION ALL SELECT 'segments', 'grouped', 'all', 'Orders', NULL, 'PASS', 'executable'
    UNION ALL SELECT 'unknown', 'grouped', 'all', 'Nothing', NULL, 'FAIL', 'error'
    UNION ALL SELECT 'brands', 'structural', 'all', NULL, NULL, 'FAIL', 'chart-invalid'""",
)
def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders")
    money = display.apply_format(F.sum("o_totalprice"), "\\$#,0")
    shown = orders.agg(money.alias("a"), (F.count_distinct("o_orderkey") * 2).cast("string").alias("b"))
    shown = shown.select(F.explode(F.array(*[F.struct(F.lit("all").alias("scenario"), F.lit(m).alias("measure"), F.col(c).alias("dashboard_value")) for m, c in (("Order Value", "a"), ("Orders", "b"))])).alias("s")).select("s.*")
    d = F.col("o_orderpriority")
    points = orders.where(d < "5").groupBy(d.alias("dimension")).agg(display.apply_format(F.sum("o_totalprice") * F.when(F.first(d) == "1-URGENT", 2).otherwise(1), "#,0").alias("raw_value"))
    points = points.select(F.lit("priorities").alias("item_id"), "dimension", "raw_value").union(spark.createDataFrame([("brands", "Imaginary", None)], "item_id string, dimension string, raw_value string"))
    charts = [("priorities", ("orders", "o_orderpriority"), "Order Value"), ("segments", ("customer", "c_mktsegment"), "Orders"), ("brands", ("part", "p_brand"), None), ("unknown", ("part", "p_brand"), "Nothing")]
    wanted = {m: MEASURES[m] for m in _RUN} | {"Broken": M.total("nowhere", "x")}
    return validation.validation_run(evaluator, wanted, _chosen(evaluator), shown, charts, points)


@query(
    "VAL-05_extracted_rules",
    f"""WITH s AS (SELECT 'all' AS scenario, NULL AS seg, NULL AS st UNION ALL SELECT 'o_orderstatus=' || min(o_orderstatus), NULL, min(o_orderstatus) FROM orders UNION ALL SELECT 'c_mktsegment=' || min(c_mktsegment), min(c_mktsegment), NULL FROM customer),
    o AS (SELECT scenario, sum(o_totalprice) AS v, sum(o_totalprice) FILTER (c_mktsegment = 'BUILDING') AS b, count(DISTINCT o_orderkey) AS n FROM s, orders LEFT JOIN customer ON o_custkey = c_custkey
      WHERE (seg IS NULL OR seg = c_mktsegment) AND (st IS NULL OR st = o_orderstatus) GROUP BY 1),
    l AS (SELECT scenario, sum(l_extendedprice) AS g FROM s, lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
      WHERE (seg IS NULL OR seg = c_mktsegment) AND (st IS NULL OR st = o_orderstatus) GROUP BY 1)
    SELECT scenario, 'AOV' AS measure, {_round('g / n')} AS expected, 'PASS' AS status FROM o JOIN l USING (scenario)
    UNION ALL SELECT scenario, 'Building Share', {_round('b / v')}, 'PASS' FROM o WHERE b IS NOT NULL""",
)
def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.verdicts import consistency_verdicts

    evaluator = _evaluator(spark, sf_dir)
    found = [r for r in validation.consistency_rules(MEASURES)]
    parts = sorted({n for m, a, _, b, _ in found for n in (m, a, b)})
    checked = consistency_verdicts(evaluator.matrix(parts, _chosen(evaluator)), found)
    return checked.select("scenario", "measure", F.round("expected", 4).alias("expected"), "status")


_NAMES = ", ".join(f"'{m}'" for m in MEASURES)


@query(
    "VAL-17_plan",
    f"""SELECT scenario, measure, 'scalar' AS item_type, CASE measure WHEN 'Gross Sales' THEN 'sum' WHEN 'Orders' THEN 'distinct_count' WHEN 'Lines' THEN 'rows' WHEN 'Order Value' THEN 'sum' END AS aggregate
    FROM {_CHOSEN}, (SELECT unnest([{_NAMES}]) AS measure) UNION ALL SELECT 'all', 'Lines', 'grouped', 'rows' UNION ALL SELECT 'all', NULL, 'structural', NULL""",
)
def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = validation.plan_items(MEASURES, _chosen(_evaluator(spark, sf_dir)), [("a", ("part", "p_brand"), "Lines"), ("b", ("part", "p_brand"), None)])
    schema = "item_id string, item_type string, scenario string, measure string, dimension string, table string, column string, aggregate string"
    return spark.createDataFrame(items, schema).select("scenario", "measure", "item_type", "aggregate")


_S = "(seg IS NULL OR seg = c_mktsegment) AND (st IS NULL OR st = o_orderstatus)"


@query(
    "VAL-14_full_matrix",
    f"""WITH s AS (SELECT 'all' AS scenario, NULL AS seg, NULL AS st UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, NULL FROM customer UNION ALL SELECT DISTINCT o_orderstatus, NULL, o_orderstatus FROM orders),
    j AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    e AS (SELECT max(date_trunc('day', o_orderdate)) AS hi, min(date_trunc('day', o_orderdate)) AS lo FROM orders),
    o AS (SELECT scenario, sum(o_totalprice) FILTER ({_S}) AS v, count(DISTINCT o_orderkey) FILTER ({_S}) AS n, sum(o_totalprice) FILTER ({_S} AND c_mktsegment = 'BUILDING') AS b,
      sum(o_totalprice) FILTER (st IS NULL OR st = o_orderstatus) AS w, sum(o_totalprice) FILTER ({_S} AND d BETWEEN date_trunc('year', hi) AND hi) AS y, sum(o_totalprice) FILTER ({_S} AND d BETWEEN date_trunc('quarter', hi) AND hi) AS q,
      sum(o_totalprice) FILTER ({_S} AND d BETWEEN date_trunc('month', hi) AND hi) AS mtd, sum(o_totalprice) FILTER ({_S} AND d BETWEEN lo AND hi - INTERVAL 1 YEAR) AS py,
      sum(o_totalprice) FILTER ({_S} AND d BETWEEN lo AND hi - INTERVAL 1 MONTH) AS pm, sum(o_totalprice) FILTER ({_S} AND d <= hi) AS run FROM s, j, e GROUP BY 1),
    l AS (SELECT scenario, sum(l_extendedprice) FILTER ({_S}) AS g, sum(l_extendedprice * (1 - l_discount)) FILTER ({_S}) AS net, count(*) FILTER ({_S}) AS lines, count(*) FILTER ({_S} AND l_returnflag = 'R') AS ret
      FROM s, lineitem LEFT JOIN j ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT scenario, c.m AS measure, round(CAST(c.v AS DOUBLE), 2) AS value FROM (SELECT scenario, unnest([
      {{'m': 'Gross Sales', 'v': CAST(g AS DOUBLE)}}, {{'m': 'Net Sales', 'v': net}}, {{'m': 'Orders', 'v': n}}, {{'m': 'Lines', 'v': lines}}, {{'m': 'Returned Lines', 'v': ret}}, {{'m': 'AOV', 'v': g / n}},
      {{'m': 'Return Rate', 'v': CASE WHEN lines = 0 THEN 0 ELSE ret / lines END * 100}}, {{'m': 'Order Value', 'v': v}}, {{'m': 'Building Value', 'v': b}}, {{'m': 'Building Share', 'v': b / v}}, {{'m': 'Share of All', 'v': v / w}},
      {{'m': 'YTD', 'v': y}}, {{'m': 'QTD', 'v': q}}, {{'m': 'MTD', 'v': mtd}}, {{'m': 'Prior Year', 'v': py}}, {{'m': 'Previous Month', 'v': pm}}, {{'m': 'Running', 'v': run}}]) AS c FROM o JOIN l USING (scenario))""",
)
def _full_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    members = catalog.slicer_members(evaluator.model.tables, list(_SLICERS)).collect()  # at most eight of each
    scenarios = {"all": ()} | {r["member"]: (M.Is(r["table"], r["column"], r["member"]),) for r in members}
    return evaluator.matrix(list(MEASURES), scenarios).withColumn("value", F.round("value", 2))


_TYPE = "CASE p_size % 4 WHEN 0 THEN 'barChart' WHEN 1 THEN 'card' WHEN 2 THEN 'lineChart' ELSE 'slicer' END"


@query(
    "VAL-15_charts",
    f"""WITH v AS (SELECT {_TYPE} AS visual_type, 'part.' || p_type AS c, 'm.' || p_brand AS b, p_partkey % 2 = 1 AS turned, p_brand LIKE '%1' AS known FROM part)
    SELECT DISTINCT visual_type, CASE WHEN turned AND NOT known THEN b ELSE c END AS dimension_field, CASE WHEN turned AND NOT known THEN c ELSE b END AS measure_field FROM v WHERE visual_type LIKE '%Chart'""",
)
def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    container, brand = _text("part.", F.col("p_type")), _text("m.", F.col("p_brand"))
    part = _table(spark, sf_dir, "part")
    visuals = part.select(
        F.lit("Home").alias("page"), F.col("p_partkey").cast("string").alias("visual"), F.when(size == 0, "barChart").when(size == 1, "card").when(size == 2, "lineChart").otherwise("slicer").alias("visual_type"),
        F.when(F.col("p_partkey") % 2 == 1, F.array(brand, container)).otherwise(F.array(container, brand)).alias("fields"),
    )
    measures = part.where("p_brand like '%1'").select(F.upper("p_brand").alias("measure")).distinct()
    return validation.chart_descriptors(visuals, measures).select("visual_type", "dimension_field", "measure_field")


# Checks, expansion and findings -----------------------------------------------------


def _nation_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    columns = nation.where(k < 4).select(F.lit("nation").alias("table"), _text("n", k).alias("column")).union(nation.select(F.lit("region"), _text("r", F.col("r_regionkey"))).distinct())
    return nation, columns


@query(
    "VAL-08_formulas",
    """SELECT n_name AS entity, CASE WHEN n_nationkey % 4 = 1 OR (n_nationkey % 4 = 0 AND n_nationkey < 4) THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE n_nationkey % 4 WHEN 0 THEN CASE WHEN n_nationkey < 4 THEN 'all names exist' ELSE 'not in the model: nation[n' || n_nationkey || ']' END WHEN 1 THEN 'all names exist'
      WHEN 2 THEN 'not in the model: table ''nowhere'', [gone]' ELSE 'has no formula' END AS reason FROM nation""",
)
def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, columns = _nation_frames(spark, sf_dir)
    k = F.col("n_nationkey")
    formula = F.when(k % 4 == 0, _text("SUM ( 'nation'[N", k, "] )")).when(k % 4 == 1, _text("DIVIDE([", F.lower("n_name"), "], 2)")).when(k % 4 == 2, "SUM(nowhere[x]) + [gone]").otherwise(" ")
    found = model_checks.check_formulas(nation.select(F.col("n_name").alias("measure"), formula.alias("formula")), columns)
    return found.select("entity", "status", F.regexp_replace("reason", r"nation\[N", "nation[n").alias("reason"))


@query(
    "VAL-08_relationships",
    """SELECT 'nation[n' || n_nationkey || '] -> region[r' || n_regionkey || ']' AS entity, CASE WHEN n_nationkey < 4 THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN n_nationkey >= 4 THEN 'from column ''nation[n' || n_nationkey || ']'' does not exist' WHEN n_nationkey % 2 = 0 THEN 'both ends exist' ELSE 'both ends exist; inactive' END AS reason FROM nation""",
)
def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, columns = _nation_frames(spark, sf_dir)
    k = F.col("n_nationkey")
    links = nation.select(F.lit("nation").alias("from_table"), _text("n", k).alias("from_column"), F.lit("region").alias("to_table"), _text("r", F.col("r_regionkey")).alias("to_column"), (k % 2 == 0).alias("active"))
    return model_checks.check_relationships(links, columns).select("entity", "status", "reason")


@query("VAL-08_bindings", "SELECT r_name || '/' || n_name AS entity, CASE WHEN n_nationkey < 4 AND n_nationkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey")
def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, columns = _nation_frames(spark, sf_dir)
    k = F.col("n_nationkey")
    fields = F.array(_text("nation.n", k), _text("Sum(Region.r", F.col("r_regionkey"), ")"), F.col("n_name"))
    visuals = nation.select(F.col("r_name").alias("page"), F.col("n_name").alias("visual"), fields.alias("fields"))
    return model_checks.check_bindings(visuals, columns, nation.where(k % 2 == 0).select(F.lower("n_name").alias("measure"))).select("entity", "status")


@query(
    "VAL-08_datasets",
    "SELECT r_name AS entity, CASE WHEN count(*) FILTER (n_nationkey % 2 = 0) > 0 THEN 'PASS' ELSE 'BLOCKED' END AS status, count(*) || ' columns' AS actual FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, _ = _nation_frames(spark, sf_dir)
    columns = nation.select(F.col("r_name").alias("table"), F.col("n_name").alias("column"))
    source = nation.where("n_nationkey % 2 = 0").select(_text("d", F.col("r_regionkey")).alias("dataset"), F.lower("n_name").alias("column"))
    tables = columns.select("table", F.lit(False).alias("calculated")).distinct()
    return model_checks.check_datasets(tables, columns, source).select("entity", "status", "actual")


@query(
    "VAL-08_measures",
    "SELECT n_name AS entity, CASE WHEN n_nationkey % 3 = 0 THEN 'PASS' WHEN n_nationkey % 3 = 1 THEN 'FAIL' ELSE 'BLOCKED' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN CAST(count(c_custkey) AS VARCHAR) ELSE '' END AS actual FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey",
)
def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    nation = _table(spark, sf_dir, "nation")
    counted = nation.where(k % 3 == 0).join(_table(spark, sf_dir, "customer"), F.col("c_nationkey") == k, "left").groupBy(F.lower("n_name").alias("measure")).agg(F.count("c_custkey").alias("value"))
    return model_checks.check_measures(nation.select(F.col("n_name").alias("measure"), F.when(k % 3 == 1, "").otherwise("x").alias("formula")), counted).select("entity", "status", "actual")


_TESTS = "(VALUES ('kpi', 'qa', 'Value Validation', 'High', 'value'), ('kpi', 'qa', 'Format Validation', 'Medium', 'format'), ('kpi', 'qa', 'Filter Validation', 'High', 'filter'), ('kpi', 'qa', 'Refresh Validation', 'Medium', NULL), ('chart', 'qa', 'Chart Validation', 'High', 'chart'), ('chart', 'qa', 'Filter Validation', 'High', 'filter')) t(subject_kind, kind, test_type, priority, proof)"


@query(
    "VAL-19_expansion",
    f"""WITH r AS (SELECT o_orderpriority AS subject, o_orderkey % 3 <> 1 AS base, o_orderkey % 700 = 0 AS bad, o_orderkey % 5 = 0 AS exact, o_orderkey % 11 = 0 AS chart FROM orders),
    e AS (SELECT subject, 'value' AS proof, bool_or(bad) AS bad FROM r WHERE base AND NOT chart GROUP BY 1 UNION ALL SELECT subject, 'filter', bool_or(bad) FROM r WHERE NOT base AND NOT chart GROUP BY 1
      UNION ALL SELECT subject, 'format', bool_or(bad) FROM r WHERE exact AND NOT chart GROUP BY 1 UNION ALL SELECT subject, 'chart', bool_or(bad) FROM r WHERE chart GROUP BY 1),
    s AS (SELECT DISTINCT unnest(['kpi', 'chart']) AS subject_kind, o_orderpriority AS subject FROM orders)
    SELECT subject_kind, subject, kind, test_type, priority, CASE WHEN bad IS NULL THEN 'Not Executed' WHEN bad THEN 'FAIL' ELSE 'PASS' END AS status, proof IS NOT NULL AS automatable
    FROM s JOIN {_TESTS} USING (subject_kind) LEFT JOIN e USING (subject, proof)""",
)
def _expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders")
    results = orders.select(
        k.cast("string").alias("test_id"), F.upper("o_orderpriority").alias("subject"), F.when(k % 3 == 0, "All data").when(k % 3 == 1, "year=1").alias("scenario"),
        F.when(k % 700 == 0, "FAIL").otherwise("PASS").alias("status"), F.when(k % 11 == 0, "chart-category").when(k % 5 == 0, "exact").otherwise("numeric").alias("match_type"),
    )
    subjects = orders.select(F.explode(F.array(F.lit("kpi"), F.lit("chart"))).alias("subject_kind"), F.col("o_orderpriority").alias("subject")).distinct()
    wanted = ["Value Validation", "Format Validation", "Filter Validation", "Refresh Validation", "Chart Validation"]
    standing = expansion.templates(spark).where(F.col("test_type").isin(*wanted) & F.col("subject_kind").isin("kpi", "chart"))
    return expansion.expand(subjects, expansion.evidence(results), standing).select("subject_kind", "subject", "kind", "test_type", "priority", "status", "automatable")


@query(
    "VAL-20_findings",
    """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'R' || (p_size % 5) END AS r, CASE WHEN p_size % 4 = 0 THEN '' ELSE lower(p_brand) END AS e FROM part),
    f AS (SELECT DISTINCT 'R' || (p_size % 7) AS rule_id, lower(p_brand) || ' x' AS entity, p_size % 2 = 0 AS passed FROM part),
    m AS (SELECT id, CASE WHEN r <> '' AND r = rule_id AND e <> '' AND contains(entity, e) THEN 0 WHEN r <> '' AND r = rule_id THEN 1 ELSE 2 END AS rank, passed FROM c JOIN f ON (r <> '' AND r = rule_id) OR (e <> '' AND contains(entity, e))),
    b AS (SELECT id, count(*) AS findings, count(*) FILTER (NOT passed) AS failed FROM (SELECT *, min(rank) OVER (PARTITION BY id) AS best FROM m) WHERE rank = best GROUP BY 1)
    SELECT id AS test_case_id, CASE WHEN findings IS NULL THEN 'NOT EXECUTED' WHEN failed > 0 THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(findings, 0) AS findings FROM c LEFT JOIN b USING (id)""",
)
def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, size = _table(spark, sf_dir, "part"), F.col("p_size")
    cases = part.select(F.col("p_partkey").alias("test_case_id"), F.when(size % 3 != 0, _text("R", size % 5)).alias("rule_id"), F.when(size % 4 != 0, F.col("p_brand")).alias("entity"))
    found = part.select(_text("R", size % 7).alias("rule_id"), _text(F.col("p_brand"), " x").alias("entity"), (size % 2 == 0).alias("passed")).distinct()
    return expansion.match_findings(cases, found)


@query(
    "SRC-03_csv_scan",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders",
)
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "csv").path("orders")
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")).write.option("header", True).csv(path)
    read = catalog.read_csv(spark, path)
    return read.select(F.col("o_orderkey").cast("long"), "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz"))


_FILES = ("nation", "region", "customer")


@query("SRC-04_csv_folder", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}" for t in _FILES))
def _csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "csv").path("folder")
    for name in _FILES:
        _table(spark, sf_dir, name).write.option("header", True).csv(f"{folder}/{name}.csv")
    return catalog.csv_folder(spark, folder).row_counts().withColumn("columns", F.col("columns").cast("long"))


@query("SRC-15_summaries", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}" for t in ("orders", "part")))
def _sheet_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parquet_folder(spark, sf_dir, ["orders", "part"]).row_counts().withColumn("columns", F.col("columns").cast("long"))


@query(
    "VAL-11_images",
    """SELECT CASE WHEN p_size % 5 = 0 THEN 'VS-001' ELSE 'VS-002' END AS rule_id, CASE WHEN p_size % 5 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, p_type || p_partkey AS entity
    FROM part WHERE p_size % 5 = 0 OR p_size * 20 < 640""",
)
def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 20)
    images = _table(spark, sf_dir, "part").select(_text(F.col("p_type"), F.col("p_partkey")).alias("image"), width.alias("width"))
    return rules.check_images(images).select("rule_id", "severity", "entity")


@query(
    "STR-07_severity",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'High' WHEN o_orderkey % 6 IN (0, 4) THEN 'Medium' WHEN o_orderkey % 6 IN (1, 2, 3) THEN 'High' ELSE 'Medium' END AS severity FROM orders""",
)
def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("chart-missing", "numeric-percent", "Exact", "", "Chart-coverage", "novel")))
    kind = F.element_at(kinds, (k % 6 + 1).cast("int"))
    actual = F.when(k % 8 == 0, " ").when(k % 4 == 0, "—").otherwise(F.col("o_totalprice").cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", names.issue_severity(kind, actual).alias("severity"))


@query("SNK-02_run_summaries", "SELECT 'p' || (o_custkey % 20) AS project_id, max(o_orderdate + to_seconds(o_orderkey)) AS generated_at, CAST(arg_max(o_orderkey, o_orderdate + to_seconds(o_orderkey)) AS BIGINT) AS tests_total FROM orders GROUP BY 1")
def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "runs").path("summaries")
    k = F.col("o_orderkey")
    done = _table(spark, sf_dir, "orders").select(_text("p", F.col("o_custkey") % 20).alias("project_id"), (F.col("o_orderdate") + F.make_interval(secs=k)).cast("timestamp_ntz").alias("generated_at"), k.alias("tests_total"))
    runs.save_summaries(done, folder)
    return runs.list_summaries(spark, folder).select("project_id", "generated_at", "tests_total")


@query(
    "VAL-20_findings_of_customers",
    """WITH f AS (SELECT c_custkey AS k, lower(c_name) AS entity, c_custkey % 3 > 0 AS passed FROM customer), c AS (SELECT o_orderkey AS id, '#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS e FROM orders)
    SELECT id AS test_case_id, CASE WHEN k IS NULL THEN 'NOT EXECUTED' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status, CAST((k IS NOT NULL)::INT AS BIGINT) AS findings FROM c LEFT JOIN f ON entity = 'customer' || e""",
)
def _findings_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_case_id"), F.lit("").alias("rule_id"), _text("#", F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("entity"))
    found = _table(spark, sf_dir, "customer").select(F.lit("R").alias("rule_id"), F.col("c_name").alias("entity"), (F.col("c_custkey") % 3 > 0).alias("passed"))
    return expansion.match_findings(cases, found)


# Matching over the driver's tables ---------------------------------------------------


@query(
    "JOIN-06_join_keys",
    """SELECT n_name AS from_table, r_name AS to_table, CASE WHEN n_nationkey % 3 < 2 THEN 'h' WHEN n_nationkey % 2 = 0 THEN 'f' ELSE 'g' END || n_nationkey AS from_column, 'r' || n_regionkey AS to_column
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _join_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, _ = _nation_frames(spark, sf_dir)
    k = F.col("n_nationkey")

    def links(letter: str, rows: DataFrame, turned: bool) -> DataFrame:
        ends = [F.col("n_name").alias("from_table"), _text(letter, k).alias("from_column"), F.col("r_name").alias("to_table"), _text("r", F.col("r_regionkey")).alias("to_column")]
        names_ = ("to_table", "to_column", "from_table", "from_column") if turned else ("from_table", "from_column", "to_table", "to_column")
        return rows.select(*ends).toDF(*names_).select("from_table", "from_column", "to_table", "to_column")

    hints = links("h", nation.where(k % 3 == 0), False).union(links("h", nation.where(k % 3 == 1), True))
    keys = links("f", nation.where(k % 2 == 0), False).union(links("g", nation, True))
    return matching.join_keys(nation.select(F.col("n_name").alias("from_table"), F.col("r_name").alias("to_table")), hints, keys)


@query(
    "JOIN-07_inferred_of_tables",
    """WITH c AS (SELECT table_name AS t, regexp_replace(column_name, '^[^_]*_', '') AS c, ordinal_position AS p FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders'))
    SELECT DISTINCT s.t AS from_table, s.c AS from_column, k.t AS to_table, k.c AS to_column, true AS inferred FROM c s JOIN c k ON s.c = k.c AND s.t <> k.t AND k.p = 1 WHERE s.c LIKE '%key'""",
)
def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog.parquet_folder(spark, sf_dir, ["region", "nation", "customer", "supplier", "part", "orders"]).columns()
    bare = F.regexp_replace("column", "^[^_]*_", "")
    return matching.infer_joins(listed.select("table", "table_position", bare.alias("column"), "position", (F.col("position") == 0).alias("is_primary_key")))


@query(
    "SRC-13_schema",
    """WITH c AS (SELECT 'dbo.' || n_name AS t, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT t AS "table", CASE WHEN n_nationkey % 4 = 0 THEN 'view' ELSE 'table' END AS kind, count(*) AS columns, count(*) FILTER (c_custkey % 2 = 0) AS nullable, coalesce(string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) FILTER (c_custkey % 5 = 0), '') AS primary_keys,
    coalesce(string_agg('k' || c_custkey || '>dbo.region.r', ',' ORDER BY 'k' || c_custkey) FILTER (c_custkey % 7 = 0), '') AS foreign_keys FROM c GROUP BY t, n_nationkey""",
)
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, k = _table(spark, sf_dir, "nation"), F.col("c_custkey")
    held = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    place = (F.lit("dbo").alias("schema"), F.col("n_name").alias("name"))
    tables = nation.select(*place, F.when(F.col("n_nationkey") % 4 == 0, "VIEW").otherwise("BASE TABLE").alias("type"))
    columns = held.select(*place, _text("c", k).alias("column"), F.lit("int").alias("data_type"), F.when(k % 2 == 0, "YES").otherwise("NO").alias("nullable"), k.alias("position"))
    keys = held.where(k % 5 == 0).select(*place, _text("c", k).alias("column"))
    links = held.where(k % 7 == 0).select(_text("k", k).alias("constraint"), *place, _text("c", k).alias("column"), F.lit("dbo").alias("ref_schema"), F.lit("region").alias("ref_name"), F.lit("r").alias("ref_column"))
    out = matching.assemble_schema(tables, columns, keys, links)
    return out.select(
        "table", "kind", F.size("columns").cast("bigint").alias("columns"), F.size(F.filter("columns", lambda c: c["nullable"])).cast("bigint").alias("nullable"), F.array_join("primary_keys", ",").alias("primary_keys"),
        F.array_join(F.transform("foreign_keys", lambda f: F.concat(f["constraint"], F.lit(">"), f["ref_table"], F.lit("."), f["ref_column"])), ",").alias("foreign_keys"),
    )


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, _ = _nation_frames(spark, sf_dir)
    model = nation.select(F.col("r_name").alias("table"), F.col("n_name").alias("column"))
    even = nation.where("n_nationkey % 2 = 0").select(_text("dbo.dim_", F.col("r_name")).alias("table"), F.lower("n_name").alias("column"))
    third = nation.where("n_nationkey % 3 = 0").select(_text("dbo.", F.col("r_name"), "_data"), F.lower("n_name"))
    return model, even.union(third)


@query(
    "WIN-04_match_regions",
    """WITH g AS (SELECT r_name, count(*) FILTER (n_nationkey % 2 = 0) AS a, count(*) FILTER (n_nationkey % 3 = 0) AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT r_name AS "table", CASE WHEN a >= b THEN 'dbo.dim_' || r_name ELSE 'dbo.' || r_name || '_data' END AS source_table, greatest(a, b) AS shared, CAST((a > 0)::INT + (b > 0)::INT AS BIGINT) AS candidates FROM g WHERE a + b > 0""",
)
def _match_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_tables(*_both(spark, sf_dir))


@query(
    "SET-04_missing_of_regions",
    """SELECT r_name AS "table", count(*) FILTER (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AS shared, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 0), '') AS missing
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def _missing_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.compare_columns(*_both(spark, sf_dir)).select("table", "shared", F.array_join("missing", ",").alias("missing"))


@query(
    "JOIN-08_partners",
    "SELECT DISTINCT n_name AS \"table\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION SELECT 'ASIA'",
)
def _partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, _ = _nation_frames(spark, sf_dir)
    hints = nation.select(F.col("n_name").alias("from_table"), F.col("r_name").alias("to_table"))
    return matching.relevant_tables(nation.where("r_name = 'ASIA'").select(F.col("r_name").alias("table")).distinct(), hints)


_NAME = "translate(lower(substr(to_base64(unhex(md5(CAST(p_partkey AS VARCHAR)))), 1, 22)), '0123456789+/', 'abcdefghijkl')"


@query(
    "STR-03_matched_columns",
    f"""SELECT p_partkey AS part, CASE WHEN n = o THEN 'exact' WHEN lower(n) = lower(o) THEN 'case' ELSE 'fuzzy' END AS method,
    CAST(CASE WHEN n = o THEN 1.0 WHEN lower(n) = lower(o) THEN 0.99 ELSE 0.88 END AS DOUBLE) AS confidence
    FROM (SELECT p_partkey, {_NAME} AS n, CASE p_partkey % 4 WHEN 0 THEN {_NAME} WHEN 1 THEN upper({_NAME}) WHEN 2 THEN {_NAME} || 'z' ELSE reverse({_NAME}) || 'qqqqqqqqqq' END AS o FROM part)
    WHERE p_partkey % 4 < 3""",
)
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("p_partkey"), _table(spark, sf_dir, "part")
    name = F.translate(F.lower(F.substring(F.base64(F.unhex(F.md5(k.cast("string").cast("binary")))), 1, 22)), "0123456789+/", "abcdefghijkl")
    other = F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.concat(name, F.lit("z"))).otherwise(F.concat(F.reverse(name), F.lit("qqqqqqqqqq")))
    one = F.lit("parts").alias("table")
    found = matching.matched_columns(part.select(one, name.alias("column")), part.select(one, other.alias("column")))
    keys = part.select(name.alias("column"), k.alias("part"))
    return found.join(keys.hint("merge"), "column").select("part", "method", "confidence")


@query(
    "STR-05_assigned_columns",
    "SELECT p_partkey AS part, p_partkey AS other FROM part WHERE p_partkey % 4 < 3",
)
def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("p_partkey"), _table(spark, sf_dir, "part")
    name = F.translate(F.lower(F.substring(F.base64(F.unhex(F.md5(k.cast("string").cast("binary")))), 1, 22)), "0123456789+/", "abcdefghijkl")
    other = F.when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.concat(name, F.lit("z"))).otherwise(F.concat(F.reverse(name), F.lit("qqqqqqqqqq")))
    table = (k % 7).cast("string").alias("table")
    with owned() as kept:
        found = matching.matched_columns(part.select(table, name.alias("column")), part.select(table, other.alias("column")))
    taken = matching.assign_columns(found)
    for tables in kept:  # what only the pairs read
        tables.delete()
    keys = [part.select(x.alias(c), k.alias(y)) for x, c, y in ((name, "column", "part"), (other, "source_column", "other"))]
    return taken.join(keys[0].hint("merge"), "column").join(keys[1].hint("merge"), "source_column").select("part", "other")


@query(
    "WIN-06_running_over_orders",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
)
def _running_over_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = running_total(_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.round("running", 2).alias("running"))


@query(
    "STR-02_similar_columns",
    """SELECT r_name AS "table", n_name AS "column", CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE substr(n_name, 1, 2) || '_' || substr(n_name, 3) END AS source_column,
    CAST(CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 ELSE 0.97 END AS DOUBLE) AS confidence, CASE n_nationkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'case' ELSE 'normalised' END AS method
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 < 3""",
)
def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, _ = _nation_frames(spark, sf_dir)
    k, n = F.col("n_nationkey") % 4, F.col("n_name")
    other = F.when(k == 0, n).when(k == 1, F.lower(n)).when(k == 2, F.concat(F.substring(n, 1, 2), F.lit("_"), F.expr("substr(n_name, 3)"))).otherwise(_text("zz", F.col("n_nationkey")))
    pairs = matching.similarities(nation.select(F.col("r_name").alias("table"), n.alias("column")), nation.select(F.col("r_name").alias("table"), other.alias("column")))
    return matching.assign_columns(pairs)


# Further rows for operators that are otherwise shown on constants --------------------------


@query("STR-01_names_of_parts", "SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS normal FROM part")
def _names_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, _text("dbo.dim_", F.col("p_brand"))).when(k == 1, _text("x.stg_", F.col("p_brand"), "_data")).otherwise(_text(F.upper("p_brand"), "_tbl"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.normal_table(name).alias("normal"))


@query("STR-06_kinds_of_parts", "SELECT CASE p_size % 5 WHEN 0 THEN 'timeseries' WHEN 1 THEN 'tabular' WHEN 2 THEN 'kpi' WHEN 3 THEN 'filter' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def _kinds_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    visual = F.when(k == 0, "line_Clustered").when(k == 1, "multiRow Card").when(k == 2, "Card").when(k == 3, "advancedSlicer").otherwise("novel")
    return _table(spark, sf_dir, "part").groupBy(names.visual_kind(_text(visual, F.col("p_size"))).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "DSP-05_compare_orders",
    f"""SELECT o_orderkey % 7 AS form, o_orderkey % 7 IN (0, 1, 4, 6) AS passed, CASE WHEN o_orderkey % 7 IN (0, 1, 4, 6) THEN 'numeric' ELSE '' END AS match_type, count(*) AS n FROM {_SHOWN} GROUP BY ALL""",
)
def _compare_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = display.compare_display(F.col("shown"), F.format_string("%.4f", "v"))
    rows = _shown(spark, sf_dir).select((F.col("o_orderkey") % 7).alias("form"), c.alias("c"))
    return rows.groupBy("form", F.col("c.passed").alias("passed"), F.col("c.match_type").alias("match_type")).agg(F.count("*").alias("n"))


@query(
    "DSP-08_formats_of_orders",
    """SELECT o_orderkey, '+' || format('{:,}', s) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END AS signed, CAST(s AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END AS plain,
    CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS duration FROM (SELECT o_orderkey, 1 + o_orderkey % 5000 AS s FROM orders)""",
)
def _formats_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = (1 + k % 5000).cast("double") + F.when(k % 2 == 0, 0.5).otherwise(0.0)
    return _table(spark, sf_dir, "orders").select("o_orderkey", display.signed_difference(x).alias("signed"), display.plain_number(x).alias("plain"), display.duration(x).alias("duration"))


@query(
    "VAL-10_rules_of_regions",
    """SELECT 'MD-001' AS rule_id, false AS passed, r_name || '[' || n_name || ']' AS entity FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0
    UNION ALL SELECT 'MD-002', false, n_name FROM nation UNION ALL SELECT 'MD-003', false, r_name || '->' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'MD-004', true, r_name || '->' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'MD-005', true, 'model'
    UNION ALL SELECT 'MD-006', false, n_name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'MD-007', false, r_name FROM region WHERE r_name NOT IN (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 3)
    UNION ALL SELECT 'MD-008', false, n_name FROM nation WHERE n_nationkey % 4 = 0""",
)
def _rules_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, _ = _nation_frames(spark, sf_dir)
    k, n, r = F.col("n_nationkey"), F.col("n_name"), F.col("r_name")
    some = F.array(F.lit("x"))
    shown = nation.where(k < 3).select(r.alias("page"), F.lit("v").alias("visual"), some.alias("fields"))
    found = rules.check_model(
        {
            "tables": nation.select(n.alias("table")).union(nation.select(r).distinct()), "columns": nation.select(r.alias("table"), n.alias("column")),
            "measures": nation.select(r.alias("table"), n.alias("measure"), F.when(k % 5 == 0, " ").otherwise("x").alias("formula")),
            "relationships": nation.select(r.alias("from_table"), n.alias("from_column"), n.alias("to_table"), n.alias("to_column"), (k % 2 == 0).alias("active")),
            "visuals": shown.union(nation.select(F.lit("elsewhere"), n, F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(some))),
            "pages": nation.select(r.alias("page")).distinct(), "bookmarks": nation.select(n.alias("bookmark"), F.when(k % 4 == 0, "gone").alias("page")),
        }
    )
    return found.select("rule_id", "passed", "entity")
