import pytest

from cubewright.operators import expansion, matching, model_checks

PAIRS = [
    ("Sales Amount", "SalesAmount", 0.97, True), ("Amount Sales", "Sales Amount", 0.93, True), ("Net Charge", "Freight Charge", 0.727, False), ("Despatch Date", "despatch_ref", 0.783, False),
    ("Region", "Territory", 0.91, True), ("x", "x", 1.0, True), ("X", "x", 0.99, True), ("", "x", 0.0, False), ("dim_Unit Price", "UnitPrice_tbl", 0.96, True), ("Customer Names", "Customer Name1", 0.88, True),
]


def test_similarities(spark):
    left = spark.createDataFrame([(str(i), p[0]) for i, p in enumerate(PAIRS)], "table string, column string")
    right = spark.createDataFrame([(str(i), p[1]) for i, p in enumerate(PAIRS)], "table string, column string")
    pairs = matching.similarities(left, right)
    assert {int(r.table): r.confidence for r in pairs.collect()} == {i: p[2] for i, p in enumerate(PAIRS)}
    assert {int(r.table) for r in matching.recognised(pairs).collect()} == {i for i, p in enumerate(PAIRS) if p[3]}


def test_assignment_uses_each_source_column_once(spark):
    columns = "table string, column string"
    left = spark.createDataFrame([("t", "Sales Amount"), ("t", "Amount"), ("u", "a")], columns)
    right = spark.createDataFrame([("t", "SalesAmount"), ("t", "amount"), ("u", "b")], columns)
    got = {r.column: r.source_column for r in matching.assign_columns(matching.similarities(left, right)).collect()}
    assert got == {"Sales Amount": "SalesAmount", "Amount": "amount"}


def test_inferred_joins_by_ending(spark):
    columns = spark.createDataFrame(
        [("c", 0, "cust_key", 0, True), ("o", 1, "ship_cust_key", 0, False), ("o", 1, "id", 1, True), ("d", 2, "cust_key", 0, True), ("e", 3, "x_id", 0, False)],
        "table string, table_position int, column string, position int, is_primary_key boolean",
    )
    got = {tuple(r)[:4] for r in matching.infer_joins(columns).collect()}
    assert got == {("o", "ship_cust_key", "c", "cust_key"), ("c", "cust_key", "d", "cust_key")}  # "id" is too short to be an ending


def test_nothing_to_check_against(spark):
    none = spark.createDataFrame([], "table string, column string")
    measures = spark.createDataFrame([("m", "SUM(t[a])"), ("n", "")], "measure string, formula string")
    assert {r.entity: r.status for r in model_checks.check_formulas(measures, none).collect()} == {"m": "BLOCKED", "n": "FAIL"}
    visuals = spark.createDataFrame([("p", "v", ["t.a"]), ("p", "w", [])], "page string, visual string, fields array<string>")
    assert {r.entity: r.status for r in model_checks.check_bindings(visuals, none, measures.where("false").select("measure")).collect()} == {"p/v": "BLOCKED", "p/w": "NOT EXECUTED"}
    tables = spark.createDataFrame([("t", False), ("u", True)], "table string, calculated boolean")
    columns = spark.createDataFrame([("t", "a"), ("u", "b")], "table string, column string")
    assert {r.entity: r.status for r in model_checks.check_datasets(tables, columns, None).collect()} == {"t": "BLOCKED", "u": "BLOCKED"}
    assert {r.entity: r.status for r in model_checks.check_datasets(tables, columns, none.withColumnRenamed("table", "dataset")).collect()} == {"t": "BLOCKED", "u": "PASS"}


@pytest.mark.parametrize("field, status", [("Sum(Sales.Amount)", "PASS"), ("Min(Sum(sales.AMOUNT))", "PASS"), ("Date.Date.Variation.Year", "PASS"), ("'Sales'[Amount]", "PASS"), ("Total", "PASS"), ("Sales.Gone", "FAIL")])
def test_bindings(spark, field, status):
    visuals = spark.createDataFrame([("p", "v", [field])], "page string, visual string, fields array<string>")
    columns = spark.createDataFrame([("Sales", "Amount"), ("Date", "Date")], "table string, column string")
    assert model_checks.check_bindings(visuals, columns, spark.createDataFrame([("total",)], "measure string")).first().status == status


def test_evidence_lists_failures_first(spark):
    rows = [(f"Q{i}", "K", "", "FAIL" if i == 9 else "PASS", "numeric") for i in range(10)]
    got = expansion.evidence(spark.createDataFrame(rows, "test_id string, subject string, scenario string, status string, match_type string")).collect()
    assert [(r.key, r.proof, r.status, r.remark) for r in got] == [("k", "value", "FAIL", "1 of 10 executed checks failed: Q9")]


def test_model_checks_are_evidence(spark):
    checks = spark.createDataFrame([("M", "FAIL", "gone", "")], "entity string, status string, reason string, actual string")
    subjects = spark.createDataFrame([("measure", "M"), ("measure", "N")], "subject_kind string, subject string")
    got = expansion.expand(subjects, expansion.checked(checks, "formula"), expansion.templates(spark)).where("test_type = 'Formula Test'")
    assert {r.subject: r.status for r in got.collect()} == {"M": "FAIL", "N": "Not Executed"}
