"""Cases set down by hand for operators whose registered queries run over the driver's tables."""

import pytest
from pyspark.sql import functions as F

from cubewright.functions import display, names
from cubewright.operators import matching, rules
from cubewright.queries import load_model
from tests.against_sql import SF_DIR, assert_same, connect

CASES = {}


def query(name, sql):
    def add(f):
        CASES[name] = f, sql
        return f

    return add


_CASES = [
    ("$51.88M", "$ 51.88 M"), ("$51.88M", "51879473.12"), ("60.0%", "0.6"), ("60.0%", "6000"), ("4", "3.5557"), ("0", "5"), ("abc", "5"),
    ("€1.5bn", "1500000000"), ("-$5", "-5"), ("5 K", "5000"), ("", "3"), ("(500)", "-500"), ("12ab", "12"), ("1e3", "1000"), (None, None), ("0", "0"),
]


def _two_schemas(spark):
    kind = "table string, column string"
    model = spark.createDataFrame([("Sales", "Sales Amount"), ("Sales", "Qty"), ("Sales", "Margin"), ("Customer", "Name")], kind)
    source = spark.createDataFrame([("dbo.fact_sales", "SalesAmount"), ("dbo.fact_sales", "qty"), ("dbo.sales_data", "qty"), ("dbo.dim_customer", "name")], kind)
    return model, source


@query(
    "DSP-05_compare_display",
    """SELECT * FROM (VALUES ('$51.88M', '$ 51.88 M', true, 'exact'), ('$51.88M', '51879473.12', true, 'numeric'), ('60.0%', '0.6', true, 'numeric-percent'),
    ('60.0%', '6000', false, ''), ('4', '3.5557', true, 'rounded'), ('0', '5', false, ''), ('abc', '5', false, ''), ('€1.5bn', '1500000000', true, 'numeric'),
    ('-$5', '-5', true, 'numeric'), ('5 K', '5000', true, 'numeric'), ('', '3', false, ''), ('(500)', '-500', true, 'numeric'), ('12ab', '12', false, ''),
    ('1e3', '1000', true, 'numeric'), (NULL, NULL, false, ''), ('0', '0', true, 'exact')) t(shown, actual, passed, match_type)""",
)
def _compare(spark, sf_dir):
    rows = spark.createDataFrame(_CASES, "shown string, actual string")
    c = display.compare_display(F.col("shown"), F.col("actual"))
    return rows.select("shown", "actual", c["passed"].alias("passed"), c["match_type"].alias("match_type"))


@query(
    "DSP-08_small_formats",
    """SELECT * FROM (VALUES (CAST(1234.5 AS DOUBLE), '+1,234.5', '1234.5', '20m 34s'), (-3, '-3', '-3', '--'), (0.25, '+0.25', '0.25', '0s'), (NULL, '—', NULL, '--'), (59.99999, '+60', '59.99999', '59s'))
    t(x, signed, plain, duration)""",
)
def _small_formats(spark, sf_dir):
    x = F.col("x")
    rows = spark.createDataFrame([(1234.5,), (-3.0,), (0.25,), (None,), (59.99999,)], "x double")
    return rows.select("x", display.signed_difference(x).alias("signed"), display.plain_number(x).alias("plain"), display.duration(x).alias("duration"))


@query(
    "STR-01_names",
    """SELECT * FROM (VALUES ('dbo.dim_Sales_Territory', 'salesterritory'), ('Sales Territory_data', 'salesterritory'), ('FactSales', 'factsales'), ('stg_Orders_tbl', 'orders'), (NULL, '')) t(name, normal)""",
)
def _names(spark, sf_dir):
    rows = spark.createDataFrame([("dbo.dim_Sales_Territory",), ("Sales Territory_data",), ("FactSales",), ("stg_Orders_tbl",), (None,)], "name string")
    return rows.select("name", names.normal_table(F.col("name")).alias("normal"))


@query(
    "STR-06_visual_kinds",
    """SELECT * FROM (VALUES ('lineClusteredColumnComboChart', 'timeseries'), ('multiRowCard', 'tabular'), ('card', 'kpi'), ('slicer', 'filter'), ('pivotTable', 'tabular'), ('clusteredBarChart', 'categorical'), ('novel', 'other'), (NULL, 'other')) t(visual, kind)""",
)
def _kinds(spark, sf_dir):
    rows = [("lineClusteredColumnComboChart",), ("multiRowCard",), ("card",), ("slicer",), ("pivotTable",), ("clusteredBarChart",), ("novel",), (None,)]
    return spark.createDataFrame(rows, "visual string").select("visual", names.visual_kind(F.col("visual")).alias("kind"))


@query(
    "JOIN-07_infer_joins",
    """SELECT * FROM (VALUES ('lineitem', 'l_orderkey', 'orders', 'o_orderkey', false), ('orders', 'cust_key', 'customer', 'cust_key', true), ('orders', 'order_date_key', 'dates', 'date_key', true))
    t(from_table, from_column, to_table, to_column, inferred)""",
)
def _joins(spark, sf_dir):
    columns = spark.createDataFrame(
        [("customer", 0, "cust_key", 0, True), ("customer", 0, "c_name", 1, False), ("orders", 1, "o_orderid", 0, True), ("orders", 1, "cust_key", 1, False), ("orders", 1, "order_date_key", 2, False), ("dates", 2, "date_key", 0, True)],
        "table string, table_position int, column string, position int, is_primary_key boolean",
    )
    keys = spark.createDataFrame([("lineitem", "l_orderkey", "orders", "o_orderkey")], "from_table string, from_column string, to_table string, to_column string")
    return matching.infer_joins(columns, keys)


@query("WIN-04_match_tables", "SELECT * FROM (VALUES ('Sales', 'dbo.fact_sales', CAST(2 AS BIGINT), CAST(2 AS BIGINT)), ('Customer', 'dbo.dim_customer', 1, 1)) t(\"table\", source_table, shared, candidates)")
def _match(spark, sf_dir):
    return matching.match_tables(*_two_schemas(spark))


@query("SET-04_missing_columns", "SELECT 'Sales' AS \"table\", CAST(2 AS BIGINT) AS shared, 'Margin' AS missing UNION ALL SELECT 'Customer', 1, ''")
def _missing(spark, sf_dir):
    return matching.compare_columns(*_two_schemas(spark)).select("table", "shared", F.array_join("missing", ",").alias("missing"))


@query(
    "VAL-10_rules",
    """SELECT * FROM (VALUES ('MD-001', false, 'T[Empty]'), ('MD-002', false, 'Bare'), ('MD-003', false, 'T->Nowhere'), ('MD-004', true, 'T->Nowhere'), ('MD-005', false, 'total'),
    ('MD-006', false, 'v1'), ('MD-007', false, 'Blank'), ('MD-008', false, 'b1')) t(rule_id, passed, entity)""",
)
def _rules(spark, sf_dir):
    frame = spark.createDataFrame
    found = rules.check_model(
        {
            "tables": frame([("T",), ("Bare",)], "table string"), "columns": frame([("T", "a")], "table string, column string"),
            "measures": frame([("T", "Empty", " "), ("T", "Total", "x"), ("Bare", "total", "y")], "table string, measure string, formula string"),
            "relationships": frame([("T", "a", "Nowhere", "b", False)], "from_table string, from_column string, to_table string, to_column string, active boolean"),
            "visuals": frame([("Home", "v1", []), ("Home", "v2", ["T.a"])], "page string, visual string, fields array<string>"),
            "pages": frame([("Home",), ("Blank",)], "page string"), "bookmarks": frame([("b1", "Lost"), ("b2", "Home")], "bookmark string, page string"),
        }
    )
    return found.select("rule_id", "passed", "entity")


@query("JOIN-08_relevant_tables", "SELECT * FROM (VALUES ('orders'), ('customer'), ('lineitem')) t(\"table\")")
def _relevant(spark, sf_dir):
    hints = [(r.from_table, r.to_table) for r in load_model(spark, sf_dir).relationships if "calendar" not in (r.from_table, r.to_table)]
    return matching.relevant_tables(spark.createDataFrame([("orders",)], "table string"), spark.createDataFrame(hints, "from_table string, to_table string"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    run, sql = CASES[name]
    assert_same(run(spark, SF_DIR), connect(), sql)
