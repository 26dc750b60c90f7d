"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, display
from .functions.logic import running_total, share_of_total, switch_true
from .model import Model, OpenedWhenNamed, Relationship
from .operators import matching, rules, sets, suite, verdicts
from .plans import measures as M
from .plans.lower import Band, Evaluator
from .registry import QUERIES, SQL, query  # noqa: F401  both are read from here
from .sources import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
def load_model(spark: SparkSession, sf_dir: str) -> Model:
    """The sales model: lineitem to orders to customer to nation to region, part, supplier and a generated calendar."""
    openers: dict[str, Callable[[], DataFrame]] = {t: lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    tables = OpenedWhenNamed(openers)

    def calendar() -> DataFrame:
        day = F.to_date("o_orderdate")
        span = tables["orders"].agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
        return dates.calendar_table(spark, span["a"], span["b"])

    tables.openers["calendar"] = calendar
    links = [
        Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Relationship("lineitem", "l_partkey", "part", "p_partkey"),
        Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Relationship("orders", "o_custkey", "customer", "c_custkey"),
        Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
        Relationship("supplier", "s_nationkey", "nation", "n_nationkey", active=False),
        Relationship("nation", "n_regionkey", "region", "r_regionkey"),
        Relationship("orders", "o_orderdate", "calendar", "date"),
        Relationship("lineitem", "l_shipdate", "calendar", "date", active=False),
    ]
    return Model(tables, links, ("calendar", "date"))


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def ship_lag() -> Column:
    return dates.boundaries(M.related("orders", "o_orderdate"), F.col("l_shipdate"), "day")


MEASURES: dict[str, M.Node] = {
    "Gross Sales": M.total("lineitem", "l_extendedprice"),
    "Net Sales": M.total("lineitem", net),
    "Orders": M.distinct_count("orders", "o_orderkey"),
    "Lines": M.count_rows("lineitem"),
    "Returned Lines": M.count_rows("lineitem", where=lambda: F.col("l_returnflag") == "R"),
    "AOV": M.divide(M.Reference("Gross Sales"), M.Reference("Orders")),
    "Return Rate": M.divide(M.Reference("Returned Lines"), M.Reference("Lines"), 0) * 100,
    "Order Value": M.total("orders", "o_totalprice"),
    "Building Value": M.calculate(M.Reference("Order Value"), M.Is("customer", "c_mktsegment", "BUILDING")),
    "Building Share": M.divide(M.Reference("Building Value"), M.Reference("Order Value")),
    "Share of All": M.divide(M.Reference("Order Value"), M.calculate(M.Reference("Order Value"), M.All("customer"))),
    "YTD": M.to_date(M.Reference("Order Value"), "year"),
    "QTD": M.to_date(M.Reference("Order Value"), "quarter"),
    "MTD": M.to_date(M.Reference("Order Value"), "month"),
    "Prior Year": M.calculate(M.Reference("Order Value"), M.same_period_last_year()),
    "Previous Month": M.calculate(M.Reference("Order Value"), M.Shift(-1, "month")),
    "Running": M.calculate(M.Reference("Order Value"), M.UpTo("calendar", "date", "<=", "max", "calendar", "date")),
}


def _evaluator(spark: SparkSession, sf_dir: str) -> Evaluator:
    return Evaluator(load_model(spark, sf_dir), MEASURES)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _measure(name: str, measure: M.Node | str, sql: str, filters: tuple[M.Is, ...] = (), by: tuple[str, str] | None = None) -> None:
    """Register one measure as column ``value`` (and ``dim``), rounded where it is a fraction."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        node = M.Reference(measure) if isinstance(measure, str) else measure
        out = _evaluator(spark, sf_dir).values({"value": node}, filters, by)
        return _rounded(out, "value") if dict(out.dtypes)["value"] == "double" else out

    query(name, sql)(run)


def _round(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4)"


# Aggregates -----------------------------------------------------------------

_measure("AGG-01_sum", "Gross Sales", f"SELECT {_round('sum(l_extendedprice)')} AS value FROM lineitem")
_measure("AGG-02_average", M.average("lineitem", "l_quantity"), f"SELECT {_round('avg(l_quantity)')} AS value FROM lineitem")
_measure("AGG-03_min", M.least("orders", "o_totalprice"), f"SELECT {_round('min(o_totalprice)')} AS value FROM orders")
_measure("AGG-04_max", M.greatest("orders", "o_totalprice"), f"SELECT {_round('max(o_totalprice)')} AS value FROM orders")
_measure("AGG-05_count", M.count_values("lineitem", "l_partkey"), "SELECT count(l_partkey) AS value FROM lineitem")
_measure("AGG-06_counta", M.count_values("customer", "c_name"), "SELECT count(c_name) AS value FROM customer")
_measure("AGG-07_distinctcount", "Orders", "SELECT count(DISTINCT o_orderkey) AS value FROM orders")
_measure("AGG-08_countrows", "Lines", "SELECT count(*) AS value FROM lineitem")
_measure("AGG-08_countrows_filter", "Returned Lines", "SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'")
_measure("AGG-09_sumx", "Net Sales", f"SELECT {_round('sum(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem")
_measure("AGG-10_averagex", M.average("lineitem", net), f"SELECT {_round('avg(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem")
_measure("AGG-11_minx", M.least("lineitem", net), f"SELECT {_round('min(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem")
_measure("AGG-12_maxx", M.greatest("lineitem", net), f"SELECT {_round('max(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem")
_measure(
    "AGG-13_countx",
    M.count_values("lineitem", lambda: F.when(F.col("l_discount") > 0.05, F.col("l_tax"))),
    "SELECT count(CASE WHEN l_discount > 0.05 THEN l_tax END) AS value FROM lineitem",
)
_measure(
    "AGG-14_calculated_column",
    M.average("lineitem", ship_lag, [("orders", "o_orderdate")]),
    f"SELECT {_round("avg(date_diff('day', o_orderdate, l_shipdate))")} AS value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
)
_measure(
    "AGG-18_grouped",
    "Order Value",
    f"SELECT c_mktsegment AS dim, {_round('sum(o_totalprice)')} AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    by=("customer", "c_mktsegment"),
)
_measure(
    "AGG-18_grouped_composite",
    "AOV",
    """WITH g AS (SELECT o_orderpriority AS dim, sum(l_extendedprice) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    o AS (SELECT o_orderpriority AS dim, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
    SELECT dim, round(s / n, 4) AS value FROM g JOIN o USING (dim)""",
    by=("orders", "o_orderpriority"),
)
_measure(
    "AGG-18_grouped_filtered",
    "Lines",
    """SELECT r_name AS dim, count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1""",
    (M.Is("customer", "c_mktsegment", "MACHINERY"),),
    ("region", "r_name"),
)


@query(
    "AGG-19_calculated_dimension",
    """SELECT CASE WHEN lag <= 30 THEN '0-30' WHEN lag <= 60 THEN '31-60' ELSE '61+' END AS dim, count(*) AS lines
    FROM (SELECT date_diff('day', o_orderdate, l_shipdate) AS lag FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
)
def _calculated_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = Band("lineitem", lambda: switch_true(ship_lag() <= 30, "0-30", ship_lag() <= 60, "31-60", "61+"), (("orders", "o_orderdate"),))
    return _evaluator(spark, sf_dir).values({"lines": M.Reference("Lines")}, by=band)


@query("AGG-20_structural", "SELECT DISTINCT p_type AS dim FROM part WHERE p_type IS NOT NULL ORDER BY 1 LIMIT 500")
def _structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluator(spark, sf_dir).members("part", "p_type", limit=500)


_measure("AGG-15_named_aggregate", M.named_aggregate("Count Distinct", "lineitem", "l_suppkey"), "SELECT count(DISTINCT l_suppkey) AS value FROM lineitem")

# Measure algebra and contexts -------------------------------------------------

_GROSS, _VALUE = "(SELECT sum(l_extendedprice) FROM lineitem)", "(SELECT sum(o_totalprice) FROM orders)"
_measure("EXP-01_arithmetic", M.Reference("Gross Sales") - M.Reference("Net Sales") * 2 + 1, f"SELECT {_round('sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)) * 2 + 1')} AS value FROM lineitem")
_measure("EXP-02_division_by_zero", M.Reference("Lines") / (M.Reference("Lines") - M.Reference("Lines")), "SELECT CAST(NULL AS DOUBLE) AS value")
_measure("EXP-03_divide", "AOV", f"SELECT {_round(f'{_GROSS} / (SELECT count(DISTINCT o_orderkey) FROM orders)')} AS value")
_measure("EXP-04_divide_alternate", M.divide(M.Reference("Lines"), M.Reference("Lines") - M.Reference("Lines"), 7), "SELECT CAST(7 AS DOUBLE) AS value")
_measure("EXP-05_reference", M.Reference("return rate"), f"SELECT {_round("count(*) FILTER (l_returnflag = 'R') / count(*) * 100")} AS value FROM lineitem")
_measure(
    "CTX-01_calculate",
    "Building Share",
    f"SELECT {_round(f"(SELECT sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') / {_VALUE}")} AS value",
)
_measure(
    "CTX-02_scenario_in_every_leaf",
    "Return Rate",
    f"""SELECT {_round("count(*) FILTER (l_returnflag = 'R') / count(*) * 100")} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
    (M.Is("orders", "o_orderstatus", "F"),),
)
_measure(
    "CTX-03_share_of_total",
    "Share of All",
    f"SELECT {_round(f"(SELECT sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE') / {_VALUE}")} AS value",
    (M.Is("customer", "c_mktsegment", "AUTOMOBILE"),),
)
_measure("CTX-04_running_total", "Running", f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'", (M.Is("calendar", "year", 1998),))
_LAST = "(SELECT max(date_trunc('day', o_orderdate)) FROM orders)"
for _id, _name, _unit in (("TI-01_year_to_date", "YTD", "year"), ("TI-02_quarter_to_date", "QTD", "quarter"), ("TI-03_month_to_date", "MTD", "month")):
    _measure(_id, _name, f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders WHERE o_orderdate >= date_trunc('{_unit}', {_LAST}) AND o_orderdate <= {_LAST}")
_measure(
    "TI-04_to_date_extra_filter",
    M.to_date(M.Reference("Order Value"), "year", M.Is("orders", "o_orderstatus", "O")),
    f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders WHERE o_orderdate >= date_trunc('year', {_LAST}) AND o_orderdate <= {_LAST} AND o_orderstatus = 'O'",
)
_measure(
    "TI-05_dateadd",
    "Previous Month",
    f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate <= TIMESTAMP '1997-02-28'",
    (M.Is("calendar", "year", 1997), M.Is("calendar", "month", 3)),
)
_measure(
    "TI-06_same_period_last_year",
    "Prior Year",
    f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'",
    (M.Is("calendar", "year", 1998),),
)
_measure("TI-07_date_bound", M.calculate(M.greatest("orders", lambda: F.year("o_orderdate")), M.Is("calendar", "year", 1996)), "SELECT max(CAST(year(o_orderdate) AS INTEGER)) AS value FROM orders WHERE year(o_orderdate) = 1996")
_measure("TI-08_no_dates_left", "QTD", "SELECT CAST(NULL AS DOUBLE) AS value", (M.Is("calendar", "year", 2050),))


# Groups whose context has lost or moved the group's member.

_measure(
    "CTX-03_share_by_segment",
    "Share of All",
    f"SELECT c_mktsegment AS dim, {_round(f'sum(o_totalprice) / {_VALUE}')} AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    by=("customer", "c_mktsegment"),
)
_measure(
    "CTX-04_running_by_year",
    "Running",
    f"SELECT CAST(year(o_orderdate) AS INTEGER) AS dim, {_round('sum(sum(o_totalprice)) OVER (ORDER BY year(o_orderdate))')} AS value FROM orders GROUP BY year(o_orderdate)",
    by=("calendar", "year"),
)
_measure(
    "TI-01_year_to_date_by_month",
    "YTD",
    f"SELECT CAST(month(o_orderdate) AS INTEGER) AS dim, {_round('sum(sum(o_totalprice)) OVER (ORDER BY month(o_orderdate))')} AS value FROM orders WHERE year(o_orderdate) = 1997 GROUP BY month(o_orderdate)",
    (M.Is("calendar", "year", 1997),),
    ("calendar", "month"),
)
_measure(
    "TI-06_prior_year_by_year",
    "Prior Year",
    f"""WITH b AS (SELECT year(o_orderdate) AS y, min(o_orderdate) - INTERVAL 1 YEAR AS lo, max(o_orderdate) - INTERVAL 1 YEAR AS hi FROM
      (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS o_orderdate FROM orders) GROUP BY 1)
    SELECT CAST(y AS INTEGER) AS dim, {_round('sum(o_totalprice)')} AS value FROM b JOIN orders ON o_orderdate >= lo AND o_orderdate <= hi GROUP BY 1""",
    by=("calendar", "year"),
)


@query(
    "TI-02_periods_by_month",
    """WITH d AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS k, * FROM orders),
    p AS (SELECT k, min(date_trunc('quarter', o_orderdate)) AS q, min(date_trunc('month', o_orderdate)) AS m, min(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH AS e FROM d GROUP BY 1)
    SELECT CAST(k % 100 AS INTEGER) AS dim, round(sum(d2.o_totalprice), 4) AS qtd, round(sum(d2.o_totalprice) FILTER (d2.o_orderdate >= m), 4) AS mtd, count(DISTINCT d2.o_custkey) AS customers,
      round(max(d2.o_totalprice), 4) AS largest FROM p JOIN orders d2 ON d2.o_orderdate >= q AND d2.o_orderdate < e WHERE k // 100 = 1996 GROUP BY 1""",
)
def _periods_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {
        "qtd": M.Reference("QTD"), "mtd": M.Reference("MTD"), "customers": M.to_date(M.distinct_count("orders", "o_custkey"), "quarter"), "largest": M.to_date(M.greatest("orders", "o_totalprice"), "quarter"),
    }
    out = _evaluator(spark, sf_dir).values(wanted, [M.Is("calendar", "year", 1996)], ("calendar", "month"))
    return _rounded(out, "qtd", "mtd", "largest")


@query(
    "WIN-06_running_and_share",
    """WITH g AS (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT CAST(year AS INTEGER) AS year, round(v, 2) AS value, round(sum(v) OVER (ORDER BY year), 2) AS running, round(v / sum(v) OVER (), 6) AS share FROM g""",
)
def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_year = _evaluator(spark, sf_dir).values({"v": M.Reference("Order Value")}, by=("calendar", "year")).withColumnRenamed("dim", "year")
    out = share_of_total(running_total(by_year, "v", ["year"]), "v")
    return out.select("year", F.round("v", 2).alias("value"), F.round("running", 2).alias("running"), F.round("share", 6).alias("share"))


# Filters and joins -------------------------------------------------------------

_measure("FIL-01_slicer", "Lines", "SELECT count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 15", (M.Is("part", "p_size", "15"),))
_measure("FIL-02_slicer_text", "Lines", "SELECT count(*) AS value FROM lineitem WHERE l_linestatus = 'O'", (M.Is("lineitem", "l_linestatus", "O"),))
_measure(
    "FIL-04_conjunction",
    "Order Value",
    f"SELECT {_round('sum(o_totalprice)')} AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'",
    (M.Is("customer", "c_mktsegment", "BUILDING"), M.Is("orders", "o_orderpriority", "1-URGENT")),
)
_measure(
    "FIL-05_comparison",
    M.calculate(M.Reference("Lines"), M.Is("lineitem", "l_quantity", 10, ">="), M.Is("lineitem", "l_quantity", 20, "<")),
    "SELECT count(*) AS value FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20",
)
_measure(
    "FIL-07_filter_rows",
    M.total("lineitem", "l_quantity", where=lambda: (F.col("l_discount") > 0.05) & (F.col("l_tax") < 0.04)),
    f"SELECT {_round('sum(l_quantity)')} AS value FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.04",
)
_measure(
    "FIL-08_filter_up_to",
    M.calculate(M.count_rows("orders"), M.UpTo("orders", "o_totalprice", "<", "max", "customer", "c_acctbal", clear=False)),
    "SELECT count(*) AS value FROM orders WHERE o_totalprice < (SELECT max(c_acctbal) FROM customer)",
)
_measure("FIL-09_all", M.calculate(M.Reference("Lines"), M.All()), "SELECT count(*) AS value FROM lineitem", (M.Is("lineitem", "l_returnflag", "A"),))
_measure("FIL-09_all_column", M.calculate(M.Reference("Lines"), M.All("lineitem", "l_returnflag")), "SELECT count(*) AS value FROM lineitem WHERE l_linestatus = 'F'", (M.Is("lineitem", "l_returnflag", "A"), M.Is("lineitem", "l_linestatus", "F")))
_measure("FIL-12_unreachable", M.count_rows("customer"), "SELECT count(*) AS value FROM customer", (M.Is("lineitem", "l_returnflag", "A"),))
_measure(
    "FIL-14_multi_hop",
    "Net Sales",
    f"""SELECT {_round('sum(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
    (M.Is("region", "r_name", "ASIA"),),
)
_measure(
    "FIL-15_null_test",
    M.count_rows("lineitem", where=lambda: M.related("part", "p_size").isNull() | F.col("l_tax").isNotNull(), using=[("part", "p_size")]),
    "SELECT count(*) AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_size IS NULL OR l_tax IS NOT NULL",
)
_measure(
    "FIL-16_logic",
    M.count_rows("lineitem", where=lambda: ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)) | (F.col("l_discount") == 0)),
    "SELECT count(*) AS value FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 25) OR l_discount = 0",
)
_measure(
    "JOIN-02_related",
    M.total("lineitem", lambda: F.when(M.related("customer", "c_mktsegment") == "FURNITURE", net()), [("customer", "c_mktsegment")]),
    f"""SELECT {_round("sum(CASE WHEN c_mktsegment = 'FURNITURE' THEN l_extendedprice * (1 - l_discount) END)")} AS value
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
_measure(
    "JOIN-03_group_by_dimension",
    "Net Sales",
    f"SELECT p_brand AS dim, {_round('sum(l_extendedprice * (1 - l_discount))')} AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
    by=("part", "p_brand"),
)

_SLICERS = (("customer", "c_mktsegment"), ("orders", "o_orderstatus"))


@query(
    "VAL-14_scenario_matrix",
    """WITH s AS (SELECT DISTINCT c_mktsegment AS m FROM customer), j AS (
      SELECT c_mktsegment AS m, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    o AS (SELECT m AS scenario, sum(o_totalprice) AS v, count(DISTINCT o_orderkey) AS n FROM j GROUP BY 1
      UNION ALL SELECT 'all', sum(o_totalprice), count(DISTINCT o_orderkey) FROM orders),
    l AS (SELECT c_mktsegment AS scenario, sum(l_extendedprice) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1
      UNION ALL SELECT 'all', sum(l_extendedprice) FROM lineitem)
    SELECT scenario, measure, round(value, 2) AS value FROM (
      SELECT scenario, 'Order Value' AS measure, v AS value FROM o UNION ALL SELECT scenario, 'Orders', CAST(n AS DOUBLE) FROM o
      UNION ALL SELECT scenario, 'Gross Sales', g FROM l UNION ALL SELECT scenario, 'AOV', g / n FROM l JOIN o USING (scenario))""",
)
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    members = catalog.slicer_members(evaluator.model.tables, [_SLICERS[0]]).collect()  # at most eight
    scenarios = {"all": ()} | {r["member"]: (M.Is(r["table"], r["column"], r["member"]),) for r in members}
    out = evaluator.matrix(["Order Value", "Orders", "Gross Sales", "AOV"], scenarios)
    return out.withColumn("value", F.round("value", 2))


# Row functions ------------------------------------------------------------------


def _date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text, d = F.col("o_orderdate").cast("string"), F.col("o_orderdate")
    other = F.lit("1999-12-31 23:30:00")
    units = {u: dates.boundaries(d, other, u) for u in ("day", "month", "quarter", "year", "hour")}
    return orders.select(
        "o_orderkey", dates.year(text).alias("y"), dates.month(text).alias("m"), dates.day(text).alias("d"),
        dates.year(F.lit("no date")).alias("none"), *[c.cast("long").alias(f"diff_{u}") for u, c in units.items()],
        dates.shifted(d, -1, "month").alias("month_before"), dates.shifted(d, 1, "year").alias("year_after"), F.date_trunc("quarter", d).cast("timestamp_ntz").alias("quarter_start"),
    )


query(
    "FN-01_date_functions",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(NULL AS INTEGER) AS none,
    date_diff('day', o_orderdate, t) AS diff_day, date_diff('month', o_orderdate, t) AS diff_month, date_diff('quarter', o_orderdate, t) AS diff_quarter,
    date_diff('year', o_orderdate, t) AS diff_year, date_diff('hour', o_orderdate, t) AS diff_hour,
    o_orderdate - INTERVAL 1 MONTH AS month_before, o_orderdate + INTERVAL 1 YEAR AS year_after, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS quarter_start
    FROM (SELECT *, TIMESTAMP '1999-12-31 23:30:00' AS t FROM orders)""",
)(_date_parts)


@query(
    "FN-06_switch",
    "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
)
def _switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(switch_true(q < 10, "low", q < 30, "middle", "high").alias("band")).agg(F.count("*").alias("n"))


# Displayed values ---------------------------------------------------------------

_SHOWN = """(SELECT o_orderkey, o_totalprice AS v,
  CASE o_orderkey % 7 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN format('{:.5f}K', o_totalprice / 1000) WHEN 2 THEN '(' || format('{:.2f}', o_totalprice) || ')'
    WHEN 3 THEN format('{:.5f}%', o_totalprice / 1000) WHEN 4 THEN format('{:.8f}M', o_totalprice / 1000000) WHEN 5 THEN 'n/a' ELSE format('{:.2f}', o_totalprice) END AS shown
  FROM orders)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.col("o_totalprice"), F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(v, 2))).when(k == 1, F.format_string("%.5fK", v / 1000))
        .when(k == 2, F.format_string("(%.2f)", v)).when(k == 3, F.format_string("%.5f%%", v / 1000))
        .when(k == 4, F.format_string("%.8fM", v / 1000000)).when(k == 5, "n/a").otherwise(F.format_string("%.2f", v))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", v.alias("v"), text.alias("shown"))


@query(
    "DSP-01_parse_value",
    f"""SELECT o_orderkey % 7 AS form, unit, count(*) AS n, count(value) AS parsed, round(sum(value), 0) AS total FROM (
      SELECT o_orderkey, CASE WHEN shown LIKE '%\\%' ESCAPE '\\' THEN '%' WHEN shown LIKE '$%' THEN 'currency' ELSE '' END AS unit,
        CASE WHEN shown LIKE '(%' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(shown, '[$,%()KM]', '', 'g') AS DOUBLE)
          * CASE WHEN shown LIKE '%K' THEN 1000 WHEN shown LIKE '%M' THEN 1000000 ELSE 1 END AS value FROM {_SHOWN}) GROUP BY ALL""",
)
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _shown(spark, sf_dir).select((F.col("o_orderkey") % 7).alias("form"), display.parse_value(F.col("shown")).alias("p"))
    return p.groupBy("form", F.col("p.unit").alias("unit")).agg(F.count("*").alias("n"), F.count("p.value").alias("parsed"), F.round(F.sum("p.value"), 0).alias("total"))


@query(
    "DSP-09_apply_format",
    """SELECT o_orderkey, '$' || format('{:,.0f}', v) AS money, format('{:.1f}%', v / 1000000 * 100) AS percent, format('{:.1f}%', v / 1000) AS points,
    format('{:,.2f}', v) AS number, format('{:.0f}', v) AS whole FROM (SELECT o_orderkey, o_totalprice + 0.0001 AS v FROM orders)""",
)
def _format(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_totalprice") + 0.0001
    f = display.apply_format
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", f(v, "\\$#,0").alias("money"), f(v / 1000000, "0.0%").alias("percent"), f(v / 1000, '0.0"%"').alias("points"), f(v, "#,0.00").alias("number"), f(v, "0").alias("whole")
    )


# Verdicts -----------------------------------------------------------------------

_EXPECTED = "(SELECT o_orderpriority AS dimension, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


def _by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluator(spark, sf_dir).values({"v": M.Reference("Order Value")}, by=("orders", "o_orderpriority")).withColumnRenamed("dim", "dimension")


@query(
    "VAL-02_scalar_verdict",
    f"""SELECT dimension AS item_id, CASE WHEN dimension = '2-HIGH' THEN 'FAIL' WHEN dimension = '5-LOW' THEN 'FAIL' ELSE 'PASS' END AS status,
    CASE WHEN dimension = '2-HIGH' THEN '' WHEN dimension = '3-MEDIUM' THEN 'executable' WHEN dimension = '5-LOW' THEN 'no-rows' ELSE 'numeric' END AS match_type FROM {_EXPECTED}""",
)
def _scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_priority(spark, sf_dir)
    shown = F.when(F.col("dimension") == "2-HIGH", display.apply_format(F.col("v") * 1.2, "\\$#,0")).when(F.col("dimension") == "3-MEDIUM", "").otherwise(display.apply_format(F.col("v"), "\\$#,0"))
    expected = rows.select(F.col("dimension").alias("item_id"), shown.alias("dashboard_value"))
    actual = rows.where("dimension <> '5-LOW'").select(F.col("dimension").alias("item_id"), F.format_string("%.4f", "v").alias("value"), F.lit(None).cast("string").alias("error"))
    return verdicts.scalar_verdicts(expected, actual).select("item_id", "status", "match_type")


@query(
    "VAL-03_grouped_verdict",
    f"""SELECT 'chart' AS item_id, upper(dimension) AS dimension, CASE WHEN dimension = '1-URGENT' THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN dimension = '1-URGENT' THEN '' ELSE 'numeric' END AS match_type FROM {_EXPECTED} WHERE dimension NOT LIKE '5%'
    UNION ALL SELECT 'chart', 'GONE', 'FAIL', 'chart-missing' UNION ALL SELECT 'chart', '_COV', 'FAIL', 'chart-coverage'""",
)
def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_priority(spark, sf_dir)
    shown = F.format_string("%.3fM", F.col("v") / 1e6 * F.when(F.col("dimension") == "1-URGENT", 1.5).otherwise(1.0))
    expected = rows.where("dimension not like '5%'").select(F.lit("chart").alias("item_id"), F.upper("dimension").alias("dimension"), shown.alias("raw_value"))
    expected = expected.union(spark.createDataFrame([("chart", "GONE", "1")], expected.schema))
    actual = rows.select(F.lit("chart").alias("item_id"), "dimension", F.format_string("%.4f", "v").alias("value"))
    return verdicts.grouped_verdicts(expected, actual)


@query(
    "VAL-04_structural_verdict",
    "SELECT 'bad' AS item_id, 'FAIL' AS status, CAST(1 AS BIGINT) AS invalid, CAST(5 AS BIGINT) AS missing UNION ALL SELECT 'good', 'PASS', 0, 4",
)
def _structural_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("dimension")).distinct()
    actual = types.select(F.lit("good").alias("item_id"), "dimension").union(types.select(F.lit("bad"), "dimension"))
    shown = types.where("dimension = 'BUILDING'").select(F.lit("good").alias("item_id"), F.lower("dimension").alias("dimension"))
    return verdicts.structural_verdicts(shown.union(spark.createDataFrame([("bad", "BUILD")], shown.schema)), actual)


@query(
    "VAL-06_consistency",
    """SELECT 'all' AS scenario, 'AOV' AS measure, 'PASS' AS status UNION ALL SELECT s, 'AOV', 'PASS' FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)
    UNION ALL SELECT 'all', 'Lines', 'FAIL' UNION ALL SELECT s, 'Lines', 'FAIL' FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)""",
)
def _consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluator = _evaluator(spark, sf_dir)
    members = catalog.slicer_members(evaluator.model.tables, [_SLICERS[1]]).collect()
    scenarios = {"all": ()} | {r["member"]: (M.Is(r["table"], r["column"], r["member"]),) for r in members}
    values = evaluator.matrix(["AOV", "Gross Sales", "Orders", "Lines"], scenarios)
    checked = verdicts.consistency_verdicts(values, [("AOV", "Gross Sales", "/", "Orders", 1.0), ("Lines", "Orders", "*", "Orders", 1.0)])
    return checked.select("scenario", "measure", "status")


@query("AGG-21_status_totals", "SELECT count(*) AS total, count(*) FILTER (s = 'F') AS passed, count(*) FILTER (s = 'O') AS failed, count(*) FILTER (s = 'P') AS errors FROM (SELECT o_orderstatus AS s FROM orders)")
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "pass").when(s == "O", "FAIL").when(s == "P", "Error")
    return verdicts.status_totals(spark.read.parquet(f"{sf_dir}/orders.parquet").select(status.alias("status")))


# Runs and suites ------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id"), (F.col("o_orderdate") + F.make_interval(secs=k)).alias("generated_at"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(F.floor(price)).cast("bigint").alias("processing_time_ms"),
        (k % 50).alias("tests_total"), (k % 30).alias("tests_passed"), (k % 20).alias("tests_failed"), (k % 1000).alias("tokens"), (k % 9).alias("llm_calls"),
        (k % 2).alias("issues_high"), (k % 4).alias("issues_medium"), F.lit(0).cast("bigint").alias("issues_low"),
        F.when(k % 5 == 0, 0).otherwise(k % 100).alias("candidates"), (k % 11).alias("duplicates_removed"), (k % 13).alias("low_value_skipped"),
    )


_RUNS = """(SELECT 'p' || o_custkey AS project_id, o_orderdate + to_seconds(o_orderkey) AS generated_at, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE floor(o_totalprice) END AS ms, o_orderkey AS k FROM orders)"""


@query(
    "AGG-22_run_totals",
    f"""SELECT count(*) AS runs, CAST(sum(k % 50) AS BIGINT) AS tests_total, CAST(sum(k % 30) AS BIGINT) AS tests_passed, CAST(sum(k % 20) AS BIGINT) AS tests_failed,
    CAST(sum(k % 1000) AS BIGINT) AS tokens, CAST(sum(k % 9) AS BIGINT) AS llm_calls, round(avg(ms) FILTER (ms > 0), 4) AS mean_ms,
    CAST(sum(k % 2) FILTER (k % 4 > 0) AS BIGINT) AS issues_high, CAST(sum(k % 4) FILTER (k % 4 > 0) AS BIGINT) AS issues_medium, CAST(0 AS BIGINT) AS issues_low,
    CAST(sum(k % 100) FILTER (k % 5 > 0) AS BIGINT) AS candidates, CAST(sum(k % 11) FILTER (k % 5 > 0 AND k % 100 > 0) AS BIGINT) AS duplicates_removed,
    CAST(sum(k % 13) FILTER (k % 5 > 0 AND k % 100 > 0) AS BIGINT) AS low_value_skipped FROM {_RUNS}""",
)
def _run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(suite.run_totals(_runs(spark, sf_dir)), "mean_ms")


@query("WIN-07_recent_runs", f"SELECT project_id, generated_at FROM {_RUNS} ORDER BY generated_at DESC, project_id LIMIT 8")
def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.recent_runs(_runs(spark, sf_dir)).select("project_id", "generated_at")


@query("WIN-07_trend", f"SELECT project_id, generated_at FROM (SELECT * FROM {_RUNS} ORDER BY generated_at DESC, project_id LIMIT 14)")
def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.trend(_runs(spark, sf_dir)).select("project_id", "generated_at")


@query(
    "AGG-23_last_runs",
    f"SELECT project_id, generated_at FROM (SELECT 'p' || c_custkey AS project_id FROM customer) LEFT JOIN (SELECT project_id, max(generated_at) AS generated_at FROM {_RUNS} GROUP BY 1) USING (project_id)",
)
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project_id"))
    return suite.last_runs(projects, _runs(spark, sf_dir)).select("project_id", "generated_at")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    module = F.element_at(F.array(*map(F.lit, ("KPI: Sales", "Chart: Mix", "Model checks", "Page flow", "Load performance", "SQL Validation: Sales", "Misc"))), (k % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("test_case_id"), F.lit("functional").alias("kind"), module.alias("module"), F.concat(F.lit("Verify the "), F.col("p_type"), F.lit(" value")).alias("test_scenario"),
        F.col("p_brand").alias("test_data"), F.when(k % 4 == 0, "Pass").when(k % 4 == 1, "Fail").otherwise("Not Executed").alias("status"),
        F.when(k % 3 == 0, "High").when(k % 3 == 1, "Medium").otherwise("Low").alias("priority"), (k % 2 == 0).alias("automatable"), F.lit("").alias("generated_sql"),
    )


_SUITE = "CASE k % 7 WHEN 0 THEN 'KPI Tests' WHEN 1 THEN 'Visual Tests' WHEN 2 THEN 'Data Model Tests' WHEN 3 THEN 'Navigation Tests' WHEN 4 THEN 'Performance Tests' WHEN 5 THEN 'SQL Tests' ELSE 'Other Tests' END"


@query(
    "AGG-24_suite_rollup",
    f"""SELECT {_SUITE} AS suite, count(*) AS total, count(*) FILTER (k % 4 = 0) AS passed, count(*) FILTER (k % 4 = 1) AS failed, count(*) FILTER (k % 4 > 1) AS other,
    count(*) FILTER (k % 2 = 0) AS automatable, count(*) FILTER (k % 2 = 1) AS manual FROM (SELECT p_partkey AS k FROM part) GROUP BY 1""",
)
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.suite_rollup(_cases(spark, sf_dir))


@query(
    "WIN-02_deduplicate_tests",
    """WITH c AS (SELECT p_partkey AS k, p_partkey % 7 AS module, lower(p_type) AS t, lower(p_brand) AS d, p_partkey % 4 < 2 AS done, p_partkey % 3 AS level FROM part),
    e AS (SELECT * FROM c WHERE done QUALIFY row_number() OVER (PARTITION BY module, t, d ORDER BY level <> 0, k) = 1),
    o AS (SELECT * FROM c WHERE NOT done AND NOT EXISTS (SELECT 1 FROM e WHERE e.module = c.module AND e.t = c.t) QUALIFY row_number() OVER (PARTITION BY module, t ORDER BY level <> 0, k) = 1),
    r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY level, module ORDER BY level <> 0, k) <= 3 - level)
    SELECT k AS test_case_id FROM e UNION ALL SELECT k FROM r""",
)
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.deduplicate_tests(_cases(spark, sf_dir)).select("test_case_id")


@query(
    "WIN-01_best_plan_items",
    """SELECT l_orderkey AS scenario_id, l_returnflag AS kpi_name, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2""",
)
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("scenario_id"), F.col("l_returnflag").alias("kpi_name"), F.lit("scalar").alias("item_type"), F.col("l_quantity").alias("confidence"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("item_id")
    )
    return suite.best_plan_items(plan).select("scenario_id", "kpi_name", "confidence")


@query(
    "AGG-25_usage_by_stage",
    "SELECT event_type AS stage, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS tokens, round(sum(event_id % 1000) / (SELECT sum(event_id % 1000) FROM events), 6) AS share FROM events GROUP BY 1",
)
def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), (F.col("event_id") % 1000).alias("tokens"))
    return suite.usage_by_stage(calls).withColumn("share", F.round("share", 6))


@query(
    "SRT-05_activity_feed",
    """SELECT kind, "at", text FROM (SELECT 'order' AS kind, o_orderdate AS "at", CAST(o_orderkey AS VARCHAR) AS text FROM orders UNION ALL SELECT 'event', ts, event_type || event_id FROM events)
    ORDER BY "at" DESC, kind, text LIMIT 300""",
)
def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").cast("string").alias("text"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").alias("at"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return suite.activity_feed({"order": orders, "event": events}, 1000)


# Sources and sets -------------------------------------------------------------------


@query("SRC-10_preview", "SELECT count(*) AS rows FROM (SELECT * FROM lineitem LIMIT 50)")
def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parquet_folder(spark, sf_dir, ["lineitem"]).preview("lineitem").agg(F.count("*").alias("rows"))


@query("SRC-11_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS rows FROM {t}" for t in TABLES))
def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parquet_folder(spark, sf_dir, list(TABLES)).row_counts().select("dataset", "rows")


@query(
    "SRC-12_columns",
    "SELECT 'region' AS \"table\", 'r_regionkey' AS \"column\", 0 AS position UNION ALL SELECT 'region', 'r_name', 1 UNION ALL SELECT 'nation', 'n_nationkey', 0 UNION ALL SELECT 'nation', 'n_name', 1 UNION ALL SELECT 'nation', 'n_regionkey', 2",
)
def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.parquet_folder(spark, sf_dir, ["region", "nation"]).columns().select("table", "column", "position")


@query(
    "SRC-14_low_cardinality",
    """SELECT c AS "column", unnest(m) AS member FROM (SELECT 'o_orderstatus' AS c, list(DISTINCT o_orderstatus) AS m FROM orders UNION ALL SELECT 'o_orderpriority', list(DISTINCT o_orderpriority) FROM orders)""",
)
def _low(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.low_cardinality(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return found.select("column", F.explode("members").alias("member"))


@query(
    "PRJ-06_slicers",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS member FROM (SELECT DISTINCT {c} FROM {t})" for t, c in (*_SLICERS, ("lineitem", "l_returnflag"))
    ),
)
def _slicers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.slicer_members(load_model(spark, sf_dir).tables, [*_SLICERS, ("lineitem", "l_returnflag"), ("part", "p_brand")])


@query("PRJ-04_as_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.as_text(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"))


_SHOWN_TYPES = ["ECONOMY", "PROMO", "Imaginary"]


def _set(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("dim")).distinct()
    shown = held.where("dim < 'M'").union(spark.createDataFrame([("Imaginary",)], held.schema))
    found = {"invalid": sets.invalid, "missing": sets.missing, "shared": sets.shared}[how](shown, held)
    return found.agg(F.count("*").alias("n")) if how == "shared" else found


query("SET-01_invalid", "SELECT 'Imaginary' AS dim")(lambda s, d: _set(s, d, "invalid"))
query("SET-02_missing", "SELECT DISTINCT p_type AS dim FROM part WHERE p_type >= 'M'")(lambda s, d: _set(s, d, "missing"))
query("SET-03_shared", "SELECT count(DISTINCT p_type) AS n FROM part WHERE p_type < 'M'")(lambda s, d: _set(s, d, "shared"))


# Names, matching and rules -------------------------------------------------------------


@query(
    "WIN-05_best_datasets",
    """WITH s AS (SELECT o_orderpriority AS "table", o_orderstatus AS dataset, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) AS covered FROM orders GROUP BY 1, 2)
    SELECT "table", dataset, covered FROM s QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY covered DESC, dataset) = 1""",
)
def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("table"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").cast("string").alias("column"),
        F.when(F.col("o_orderkey") % 3 > 0, F.lit(1.0)).alias("confidence"),
    )
    return matching.best_datasets(scores).select("table", "dataset", "covered")


@query(
    "VAL-09_row_comparison",
    """SELECT 'region' AS dataset, (SELECT count(*) FROM region) AS rows, true AS equal UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), true
    UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') = (SELECT count(*) FROM orders)""",
)
def _row_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = catalog.parquet_folder(spark, sf_dir, ["region", "nation", "orders"])
    source = catalog.Catalog({"dbo.dim_region": model["region"], "nation_data": model["nation"], "fact_orders": model["orders"].where("o_orderstatus <> 'F'")})
    return model.compare_rows(source).select("dataset", "rows", "equal")


@query("VAL-12_failed_comparisons", "SELECT 'CMP-001' AS rule_id, o_orderpriority AS entity, CAST(count(*) AS VARCHAR) AS actual FROM orders GROUP BY ALL HAVING count(*) % 2 = 1")
def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("entity")).agg(F.count("*").alias("actual"))
    return rules.failed_comparisons(counted.withColumn("passed", F.col("actual") % 2 == 0)).select("rule_id", "entity", "actual")


from . import plan_queries  # noqa: E402, F401  registers its queries beside these
