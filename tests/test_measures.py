import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubewright.model import Cardinality, Model, OpenedWhenNamed, Refused, Relationship, derived
from cubewright.plans import measures as M
from cubewright.plans import validation
from cubewright.plans.lower import Band, Evaluator

DAY = dt.datetime


@pytest.fixture(scope="module")
def model(spark):
    sales = spark.createDataFrame(
        [(1, 10, 5.0, DAY(2020, 1, 31)), (2, 11, 7.0, DAY(2020, 3, 31)), (3, 99, 1.0, DAY(2021, 2, 1)), (4, None, None, DAY(2021, 2, 2))],
        "id long, shop long, amount double, day timestamp_ntz",
    )
    shops = spark.createDataFrame([(10, "A", 1), (11, "B", 2), (12, "C", None)], "shop long, name string, town long")
    towns = spark.createDataFrame([(1, "X"), (2, "Y")], "town long, title string")
    days = spark.range(0, 800).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_interval(days=F.col("id").cast("int"))).alias("date"))
    days = days.select("date", F.year("date").alias("year"), F.month("date").alias("month"))
    links = [Relationship("sales", "shop", "shops", "shop"), Relationship("shops", "town", "towns", "town"), Relationship("sales", "day", "days", "date")]
    return Model({"sales": sales, "shops": shops, "towns": towns, "days": days}, links, ("days", "date"))


def value(model, measure, *filters, named=None):
    return Evaluator(model, named).values({"v": measure}, filters).first()["v"]


AMOUNT = M.total("sales", "amount")


def test_blank_algebra(model):
    nothing = M.Is("shops", "name", "nobody")
    assert value(model, AMOUNT, nothing) is None
    assert value(model, M.average("sales", "amount"), nothing) is None
    assert value(model, M.count_rows("sales"), nothing) == 0
    assert value(model, AMOUNT + 1, nothing) is None
    assert value(model, AMOUNT / 0) is None
    assert value(model, M.divide(AMOUNT, 0, 7)) == 7
    assert value(model, M.divide(AMOUNT, M.calculate(AMOUNT, nothing), 7)) is None
    assert value(model, M.total("sales", "amount"), M.Is("sales", "id", 4)) is None


def test_filters_travel_down_only_and_over_hops(model):
    assert value(model, AMOUNT, M.Is("towns", "title", "Y")) == 7
    assert value(model, M.count_rows("towns"), M.Is("sales", "id", 1)) == 2
    assert Evaluator(model).model.reach("towns") == {"towns", "shops", "sales"}


def test_related_rows_are_kept_without_a_match(model):
    seen = M.count_rows("sales", where=lambda: M.related("towns", "title").isNull(), using=[("towns", "title")])
    assert value(model, seen) == 2
    assert value(model, M.count_rows("sales")) == 4


def test_contexts(model):
    b = M.Is("shops", "name", "B")
    assert value(model, M.calculate(AMOUNT, M.All()), b) == 13
    assert value(model, M.calculate(AMOUNT, M.All("shops")), b, M.Is("sales", "id", 2)) == 7
    assert value(model, M.calculate(AMOUNT, M.All("shops", "name")), b) == 13
    assert value(model, M.calculate(AMOUNT, M.Is("shops", "name", "A")), b) is None


def test_periods(model):
    march = (M.Is("days", "year", 2020), M.Is("days", "month", 3))
    assert value(model, M.to_date(AMOUNT, "month"), *march) == 7
    assert value(model, M.calculate(AMOUNT, M.Shift(-2, "month")), *march) == 5  # 31 March moves to 31 January
    assert value(model, M.calculate(AMOUNT, M.same_period_last_year()), M.Is("days", "year", 2021)) == 12
    assert value(model, M.calculate(AMOUNT, M.UpTo("days", "date", "<=", "max", "days", "date")), M.Is("days", "year", 2020)) == 12
    assert value(model, M.to_date(AMOUNT, "quarter")) is None  # the calendar ends after the facts
    assert value(model, M.to_date(AMOUNT, "year"), M.Is("days", "year", 1990)) is None


def test_grouping_keeps_unmatched_rows_under_null(model):
    got = {r["dim"]: (r["v"], r["n"]) for r in Evaluator(model).values({"v": AMOUNT, "n": M.distinct_count("sales", "id")}, by=("shops", "name")).collect()}
    assert got == {"A": (5.0, 1), "B": (7.0, 1), None: (1.0, 2)}
    few = Evaluator(model).values({"v": AMOUNT}, [M.Is("towns", "title", "X")], by=("shops", "name")).collect()
    assert [tuple(r) for r in few] == [("A", 5.0)]


def test_matrix_is_one_scan_of_each_table(model):
    evaluator = Evaluator(model, {"a": AMOUNT, "n": M.count_rows("sales"), "avg": M.Reference("A") / M.Reference("N")})
    out = evaluator.matrix(["a", "avg"], {"all": (), "b": (M.Is("shops", "name", "B"),)})
    assert {(r.scenario, r.measure): r.value for r in out.collect()} == {("all", "a"): 13.0, ("all", "avg"): 3.25, ("b", "a"): 7.0, ("b", "avg"): 7.0}
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_refusals(model, spark):
    for bad in (
        lambda: value(model, M.total("nowhere", "x")),
        lambda: value(model, M.Reference("none")),
        lambda: value(model, AMOUNT, M.Is("sales", "missing", 1)),
        lambda: value(model, AMOUNT, M.Is("sales", "id", "text")),
        lambda: value(model, M.calculate(AMOUNT, "guess")),
        lambda: value(model, M.Reference("loop"), named={"loop": M.Reference("Loop") + 1}),
        lambda: Cardinality.parse("some:1"),
        lambda: value(model, M.count_rows("shops", where=lambda: M.related("sales", "id") > 0, using=[("sales", "id")])),
    ):
        with pytest.raises(Refused):
            bad()
    twice = Model(model.tables, [*model.relationships, Relationship("sales", "id", "towns", "town")])
    with pytest.raises(Refused):
        Evaluator(twice).values({"v": AMOUNT}, [M.Is("towns", "title", "X")])
    done, refused = Evaluator(model).try_values({"ok": AMOUNT, "bad": M.Reference("none")})
    assert done.columns == ["ok"] and list(refused) == ["bad"]


@pytest.mark.parametrize("text, kind", [("M:1", "MANY_ONE"), ("many-to-one", "MANY_ONE"), ("manyToOne", "MANY_ONE"), ("*:1", "MANY_ONE"), ("1:*", "ONE_MANY"), ("1:1", "ONE_ONE")])
def test_cardinalities(text, kind):
    assert Cardinality.parse(text) is Cardinality[kind]


def test_literals_that_a_column_cannot_hold_are_refused(model, spark):
    flags = spark.createDataFrame([(True, dt.date(2020, 1, 1), 1)], "ok boolean, day date, n int")
    other = Model({"flags": flags})
    for column, bad, good in (("ok", "maybe", "true"), ("day", "2020-13-45", "2020-01-01"), ("n", "1.5", "1"), ("n", "nan", "1")):
        with pytest.raises(Refused):
            value(other, M.count_rows("flags"), M.Is("flags", column, bad))
        assert value(other, M.count_rows("flags"), M.Is("flags", column, good)) == 1
    with pytest.raises(Refused):
        value(model, AMOUNT, M.Is("days", "date", "rubbish"))
    assert value(model, AMOUNT, M.Is("shops", "name", 5)) is None  # a number against text is text


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.strip(" +-:").startswith("Join ") for line in plan.splitlines())


def test_scenarios_share_their_joins(model):
    evaluator = Evaluator(model, {"a": AMOUNT, "n": M.count_rows("sales")})
    few = evaluator.matrix(["a", "n"], {"A": (M.Is("shops", "name", "A"),), "X": (M.Is("towns", "title", "X"),)})
    many = {f"s{i}": (M.Is("shops", "name", f"n{i}"), M.Is("towns", "title", f"t{i}")) for i in range(12)}
    assert joins(evaluator.matrix(["a", "n"], many)) == joins(few) == 2
    assert {r.value for r in few.where("measure = 'a'").collect()} == {5.0}


def test_any_text_names_a_scenario(model):
    odd = "it's \\n a `b` \"c\" é $x {0} -- /* */"
    got = Evaluator(model, {odd: AMOUNT}).matrix([odd], {odd: (), "": ()}).collect()
    assert {(r.scenario, r.measure, r.value) for r in got} == {(odd, odd, 13.0), ("", odd, 13.0)}
    assert Evaluator(model).matrix({}, {"all": ()}).count() == 0 == Evaluator(model, {"a": AMOUNT}).matrix(["a"], {}).count()


def test_bounds_of_a_matrix_are_one_job(model, spark):
    named = {"ytd": M.to_date(AMOUNT, "year"), "ly": M.calculate(AMOUNT, M.same_period_last_year()), "run": M.calculate(AMOUNT, M.UpTo("days", "date", "<=", "max", "days", "date"))}
    scenarios = {str(y): (M.Is("days", "year", y),) for y in (2019, 2020, 2021)} | {"all": ()}
    spark.sparkContext.setJobGroup("bounds", "bounds")
    out = Evaluator(model, named).matrix(list(named), scenarios)
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bounds"))
    spark.sparkContext.setJobGroup("", "")
    single = {(s, m): value(model, node, *f) for s, f in scenarios.items() for m, node in named.items()}
    assert {(r.scenario, r.measure): r.value for r in out.collect()} == single
    assert 0 < ran <= 2  # one aggregate: a job for its map stage and one for its result


def test_periods_within_periods(model):
    inner = M.calculate(AMOUNT, M.same_period_last_year())
    assert value(model, M.calculate(inner, M.same_period_last_year()), M.Is("days", "year", 2021)) is None
    assert value(model, M.to_date(inner, "year"), M.Is("days", "year", 2021)) == 12


def test_tables_open_when_they_are_named(model):
    lazy = OpenedWhenNamed({n: (lambda n=n: model.tables[n]) for n in model.tables})
    other = Model(lazy, model.relationships, model.calendar)
    assert value(other, AMOUNT) == 13 and set(lazy.opened) == {"sales"}
    assert value(other, AMOUNT, M.Is("shops", "name", "A")) == 5 and set(lazy.opened) == {"sales", "shops"}
    wrong = Model(OpenedWhenNamed(lazy.openers), [Relationship("sales", "gone", "shops", "shop")])
    with pytest.raises(Refused):
        value(wrong, AMOUNT, M.Is("shops", "name", "A"))


def test_the_first_sum_opens_one_table(spark):
    from cubewright.queries import MEASURES, load_model
    from tests.against_sql import SF_DIR

    sales = load_model(spark, SF_DIR)
    Evaluator(sales, MEASURES).values(["Gross Sales"])
    assert set(sales.tables.opened) == {"lineitem"}


def test_groups_by_a_formula_in_order(model):
    band = Band("sales", lambda: F.when(M.related("towns", "title") == "X", "x").otherwise("rest"), (("towns", "title"),))
    got = Evaluator(model).values({"v": AMOUNT, "n": M.count_rows("sales")}, by=band, order="-n")
    assert [tuple(r) for r in got.collect()] == [("rest", 8.0, 3), ("x", 5.0, 1)]
    assert [tuple(r) for r in Evaluator(model).values({"v": AMOUNT}, by=("shops", "name"), order="v", limit=2).collect()] == [(None, 1.0), ("A", 5.0)]
    assert [r.dim for r in Evaluator(model).members("shops", "name", [M.Is("towns", "title", "Y")]).collect()] == ["B"]
    for bad in (lambda: Evaluator(model).values({"v": M.count_rows("shops")}, by=band), lambda: Evaluator(model).values({"v": AMOUNT}, by=band, order="gone"), lambda: Evaluator(model).values({"v": M.as_node(1)}, by=band)):
        with pytest.raises(Refused):
            bad()


def test_calculated_columns(model):
    sales = derived(model.table("sales"), {"double": F.col("amount") * 2, "more": lambda: F.col("double") + 1})
    assert value(Model({"sales": sales}), M.total("sales", "more")) == 29
    for bad in ({"amount": F.lit(1)}, {"x": F.col("nowhere")}):
        with pytest.raises(Refused):
            derived(model.table("sales"), bad)


def test_what_a_tree_tells():
    a, b = M.Reference("A"), M.Reference("b")
    measures = {"A": AMOUNT, "B": M.count_rows("sales"), "Q": M.divide(a, b), "D": a - b, "S": a + 1, "P": M.divide(a, b) * 100, "Z": M.divide(a, M.Reference("gone")), "C": M.calculate(a / b, M.All())}
    assert validation.consistency_rules(measures, {"q": "0.0%"}) == [("Q", "A", "/", "B", 100.0), ("D", "A", "-", "B", 1.0)]
    assert validation.measure_references(M.calculate(a / (b + a), M.All())) == ["A", "b"]
    assert validation.intent(AMOUNT) == ("sales", "amount", "sum") and validation.intent(measures["P"]) is None
    assert validation.intent(M.total("sales", "amount", where=lambda: F.lit(True))) is None
    assert validation.guarded_aggregate(AMOUNT, "SALES", "Amount", "sum") is AMOUNT
    for bad in (("sales", "amount", "avg"), ("sales", "day", "sum")):
        with pytest.raises(Refused):
            validation.guarded_aggregate(AMOUNT, *bad)
    formats = {"Return Rate": "0.0%", "Avg Price": "\\$#,0.00", "Orders": "#,0", "Ratio": "#,0.00", "Total Sales": "\\$#,0"}
    assert {n: validation.infer_format(n) for n in formats} == formats
    assert validation.infer_format("Win Rate", measures["P"]) == '0.0"%"' and validation.infer_format("Ratio", measures["Q"]) == "0.0%"
    assert validation.infer_format("Rows", measures["B"]) == "#,0"


def test_a_run_without_shown_values_or_answers(model, spark):
    shown = spark.createDataFrame([], "scenario string, measure string, dashboard_value string")
    got = validation.validation_run(Evaluator(model), {"bad": M.total("nowhere", "x")}, {"all": ()}, shown)
    assert [tuple(r) for r in got.collect()] == [("all/bad", "scalar", "all", "bad", None, "FAIL", "error")]
    got = validation.validation_run(Evaluator(model), {"v": AMOUNT}, {"none": (M.Is("shops", "name", "?"),)}, shown, [("c", ("shops", "name"), "v")])
    assert {(r.item_id, r.status, r.match_type) for r in got.collect()} == {("none/v", "FAIL", "executable"), ("c", "PASS", "executable")}
