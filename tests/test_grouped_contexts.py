"""Grouped measures whose context has lost or moved the group's member, against one scalar query for each member."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cubewright.model import Cardinality, Model, Refused, Relationship
from cubewright.plans import lower, ranges, validation
from cubewright.plans import measures as M
from cubewright.plans.lower import Band, Evaluator

RNG = random.Random(11)
FIRST = dt.datetime(2019, 11, 5)
SALES = [
    (i, RNG.choice([1, 2, 3, 9, None]), RNG.choice([None, 1.0, 2.5, 7.0, -3.0]), FIRST + dt.timedelta(days=RNG.randrange(-20, 620)), RNG.randrange(6)) for i in range(400)
]


@pytest.fixture(scope="module")
def model(spark):
    sales = spark.createDataFrame(SALES, "id long, shop long, amount double, day timestamp_ntz, bill long")
    shops = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", "y"), (4, "D", "z")], "shop long, name string, kind string")
    days = spark.range(0, 700).select((F.lit("2019-11-05").cast("timestamp_ntz") + F.make_interval(days=F.col("id").cast("int"))).alias("date"))
    days = days.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.date_format("date", "yyyy-MM").alias("stamp"))
    links = [Relationship("sales", "shop", "shops", "shop"), Relationship("sales", "day", "days", "date")]
    return Model({"sales": sales, "shops": shops, "days": days}, links, ("days", "date"))


AMOUNT = M.total("sales", "amount")
KINDS = {
    "sum": AMOUNT, "avg": M.average("sales", "amount"), "min": M.least("sales", "amount"), "max": M.greatest("sales", "amount"), "count": M.count_values("sales", "amount"), "rows": M.count_rows("sales"),
    "bills": M.distinct_count("sales", "bill"), "some": M.total("sales", "amount", where=lambda: F.col("bill") > 2), "some bills": M.distinct_count("sales", "bill", where=lambda: F.col("amount") > 1),
}
UP_TO = M.UpTo("days", "date", "<=", "max", "days", "date")
CHANGES = {
    "all shops": M.All("shops"), "all names": M.All("shops", "name"), "all": M.All(), "all days": M.All("days"), "running": UP_TO, "before": M.UpTo("days", "date", "<", "min", "days", "date"),
    "from": M.UpTo("days", "date", ">=", "min", "days", "date"), "on": M.UpTo("days", "date", "=", "max", "days", "date"), "after": M.UpTo("days", "date", ">", "max", "days", "date"),
    "last year": M.same_period_last_year(), "a month on": M.Shift(1, "month"), "days back": M.Shift(-45, "day"), "kept": M.UpTo("days", "date", ">=", "min", "days", "date", clear=False),
}


def same(got, want):
    return got == want or (got is not None and want is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9))


def by_member(evaluator, measures, by, members, filters=()):
    out = {}
    for m in members:
        row = evaluator.values(measures, (*filters, M.Is(*by, m))).first().asDict()
        out[m] = {k: None if v == 0 and isinstance(v, int) else v for k, v in row.items()}
    return out


@pytest.mark.parametrize(
    "by,members,filters",
    [
        (("days", "year"), [2019, 2020, 2021], ()),
        (("days", "stamp"), ["2019-11", "2020-11", "2021-10"], (M.Is("shops", "kind", "x"),)),
        (("shops", "name"), ["A", "D"], (M.Is("days", "year", 2020),)),
        (("shops", "kind"), ["y"], ()),
    ],
)
def test_groups_equal_scalars(model, by, members, filters):
    measures = {(name, k): M.calculate(v, change) for name, change in CHANGES.items() for k, v in KINDS.items()}
    measures |= {(name, "share"): M.divide(AMOUNT, M.calculate(AMOUNT, change)) for name, change in CHANGES.items()}
    measures = {" ".join(k): v for k, v in measures.items()}
    got = {r["dim"]: r.asDict() for r in Evaluator(model).values(measures, filters, by).collect()}
    for member, want in by_member(Evaluator(model), measures, by, members, filters).items():
        mine = got.get(member, dict.fromkeys(measures))
        for k in measures:
            value = None if mine[k] == 0 and isinstance(mine[k], int) else mine[k]
            assert same(value, want[k]), (k, member, mine[k], want[k])


def period_to_date(period, last, kind=None):
    start = {"year": dt.datetime(last.year, 1, 1), "quarter": dt.datetime(last.year, last.month - (last.month - 1) % 3, 1), "month": dt.datetime(last.year, last.month, 1)}[period]
    calendar = [FIRST + dt.timedelta(days=d) for d in range(700)]
    found = [a for _, shop, a, day, _ in SALES if day in calendar and start <= day <= last and a is not None and (kind is None or shop in kind)]
    return sum(found) if found else None


def test_periods_to_date_grow_over_the_groups(model):
    measures = {p: M.to_date(AMOUNT, p) for p in ("year", "quarter", "month")}
    for filters, kind in (((), None), ((M.Is("shops", "kind", "x"),), (1, 2))):
        got = {r["dim"]: r for r in Evaluator(model).values(measures, filters, ("days", "stamp")).collect()}
        for stamp, row in got.items():
            year, month = map(int, stamp.split("-"))
            last = min(dt.datetime(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1), FIRST + dt.timedelta(days=699))
            assert all(same(row[p], period_to_date(p, last, kind)) for p in measures), stamp
        assert len(got) == 24
    # A filter of the scenario stays beside the period, as it does without groups.
    march = Evaluator(model).values({"v": M.to_date(AMOUNT, "year")}, [M.Is("days", "month", 3)], ("days", "year")).collect()
    assert {r["dim"]: r["v"] for r in march} == {y: Evaluator(model).values({"v": AMOUNT}, [M.Is("days", "year", y), M.Is("days", "month", 3)]).first()["v"] for y in (2020, 2021)}


def test_a_period_within_a_period(model):
    before = M.calculate(M.to_date(AMOUNT, "year"), M.same_period_last_year())
    got = {r["dim"]: r["v"] for r in Evaluator(model).values({"v": before}, (), ("days", "stamp")).collect()}
    for stamp, value in got.items():
        year, month = map(int, stamp.split("-"))
        last = dt.datetime(year - 1 + month // 12, month % 12 + 1, 1) - dt.timedelta(days=2 if stamp == "2021-02" else 1)
        if (year, month) != (2021, 10) and last >= FIRST:
            assert same(value, period_to_date("year", last)), stamp


def test_what_a_group_has_lost_or_never_had(model):
    evaluator = Evaluator(model, {"all": M.calculate(AMOUNT, M.All("shops"))})
    everything = sum(a or 0 for *_, a, _, _ in SALES)
    rows = {r["dim"]: r["all"] for r in evaluator.values(["all"], (), ("shops", "name")).collect()}
    assert rows == dict.fromkeys("ABCD", everything)  # D has no sales
    both = {r["dim"]: (r["own"], r["all"]) for r in evaluator.values({"own": AMOUNT, "all": M.Reference("all")}, (), ("shops", "name")).collect()}
    assert both[None][1] == everything and both["D"] == (None, everything) and len(both) == 5  # rows without a shop are a group of null
    assert evaluator.values({"own": AMOUNT}, (), ("shops", "name")).count() == 4
    band = Band("sales", lambda: F.col("bill") % 2)
    share = {r["dim"]: r["v"] for r in evaluator.values({"v": M.divide(AMOUNT, M.calculate(AMOUNT, M.All("sales")))}, (), band).collect()}
    assert same(sum(share.values()), 1.0) and share.keys() == {0, 1}
    # A customer count by year: years don't reach shops, so it is refused, but not once the years are cleared.
    with pytest.raises(Refused):
        evaluator.values({"v": M.count_rows("shops")}, (), ("days", "year"))
    assert {r["dim"]: r["v"] for r in evaluator.values({"v": M.calculate(M.count_rows("shops"), M.All("days"))}, (), ("days", "year")).collect()} == dict.fromkeys((2019, 2020, 2021), 4)


def test_what_is_refused(model, spark):
    evaluator = Evaluator(model)
    for change in (M.UpTo("days", "date", "<>", "max", "days", "date"), M.UpTo("days", "year", "<=", "max", "days", "year"), M.ToDate("week"), M.Shift(1, "fortnight")):
        with pytest.raises(Refused):
            evaluator.values({"v": M.calculate(AMOUNT, change)}, (), ("days", "year"))
    assert evaluator.answerable({"v": M.calculate(AMOUNT, M.UpTo("days", "year", "<=", "max", "days", "year"))}, (), ("days", "year"))[1]
    late = Model(
        {"sales": spark.createDataFrame([(1.0, dt.datetime(2020, 1, 1, 5))], "amount double, at timestamp_ntz"), "days": spark.createDataFrame([(dt.datetime(2020, 1, 1, 5), 2020)], "date timestamp_ntz, year int")},
        [Relationship("sales", "at", "days", "date", Cardinality.MANY_ONE)], ("days", "date"),
    )
    with pytest.raises(Exception, match="times of day"):
        Evaluator(late).values({"v": M.to_date(AMOUNT, "year")}, (), ("days", "year")).collect()


def test_ranges_are_cut_into_few_nodes_that_cover_them(spark):
    spans = [(0, 0), (3, 3), (5, 4), (0, ranges.FAR - 1), (1, 2), (737_000, 737_364), (7, 1 << 20)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "dim int, first int, last int")
    found = {}
    for r in ranges.nodes_between(frame).collect():
        found.setdefault(r["dim"], []).append((r["node"] << r["level"], (r["node"] + 1) << r["level"]))
    for i, (a, b) in enumerate(spans):
        covered = sorted(found.get(i, []))
        assert len(covered) <= 2 * ranges.LEVELS
        if a <= b:
            assert covered[0][0] == a and covered[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        else:
            assert not covered


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_aggregates_and_joins_do_not_grow_with_scenarios(model, monkeypatch):
    measures = {k: v for k, v in KINDS.items()} | {"late": M.calculate(AMOUNT, M.Is("days", "year", 2020))}
    every = {f"s{i}": (M.Is("sales", "id", i * 3, ">="), M.Is("shops", "kind", "x")) for i in range(100)}

    def matrix(scenarios):
        return Evaluator(model).matrix(measures, scenarios)

    few, many = (plan(matrix(dict(list(every.items())[:n]))) for n in (6, 100))
    assert few.count("Join") == many.count("Join")

    def lowest(text):  # the aggregates over the fact table: those that name its own columns
        lines = [line for line in text.splitlines() if "Aggregate" in line and "amount" in line]
        return [line.count("sum(") + line.count("count(") + line.count("min(") + line.count("max(") for line in lines]

    assert lowest(few) == lowest(many)
    got = {(r["scenario"], r["measure"]): r["value"] for r in matrix(every).collect()}
    monkeypatch.setattr(lower, "MOST_DIRECT", 1000)
    want = {(r["scenario"], r["measure"]): r["value"] for r in matrix(every).collect()}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)


def test_upward_filters_come_by_one_join(spark):
    tables = {
        "a": spark.createDataFrame([(i, i % 7) for i in range(50)], "ka long, kb long"), "b": spark.createDataFrame([(i, i % 3) for i in range(7)], "kb long, kc long"),
        "c": spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "kc long, v double"),
    }
    links = [Relationship("a", "kb", "b", "kb", both_directions=True), Relationship("b", "kc", "c", "kc", both_directions=True)]
    measures = {f"m{i}": M.calculate(M.total("c", "v"), M.Is("a", "ka", i)) for i in range(70)}
    evaluator = Evaluator(Model(tables, links))
    one, many = (evaluator.values(dict(list(measures.items())[:n])) for n in (1, 70))
    assert plan(one).count("Join") == plan(many).count("Join")
    row = many.first()
    assert all(row[f"m{i}"] == (None if i >= 50 else [1.0, 2.0, 4.0][(i % 7) % 3]) for i in range(70))


def test_charts_of_many_groupings_come_from_one_scan(model):
    evaluator = Evaluator(model)
    plain = {"sum": AMOUNT, "bills": KINDS["bills"], "mean": KINDS["avg"], "x": M.calculate(AMOUNT, M.Is("sales", "bill", 3))}
    wanted = [(("shops", "name"), plain), (("days", "year"), plain), (("shops", "kind"), {"ratio": M.divide(AMOUNT, KINDS["rows"])}), (("days", "stamp"), {"ytd": M.to_date(AMOUNT, "year"), "share": M.divide(AMOUNT, M.calculate(AMOUNT, M.All("days")))})]
    got = {(r["set"], r["dim"], r["name"]): r["value"] for r in evaluator.charts(wanted).collect()}
    want = {}
    for k, (by, measures) in enumerate(wanted):
        for r in evaluator.values(measures, by=by).collect():
            want |= {(k, None if r["dim"] is None else str(r["dim"]), m): float(r[m]) for m in measures if r[m] is not None}
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    one, three = (plan(evaluator.charts(wanted[:n])) for n in (1, 3))
    assert three.count("Aggregate") == one.count("Aggregate")  # the same scans, whatever the number of groupings
    assert evaluator.charts([]).count() == 0
    with pytest.raises(Refused):
        evaluator.charts([(("days", "year"), {"v": M.count_rows("shops")})])


def test_a_run_judges_shares_and_periods_by_group(model, spark):
    named = {"ytd": M.to_date(AMOUNT, "year"), "share": M.divide(AMOUNT, M.calculate(AMOUNT, M.All("shops"))), "rows": KINDS["rows"]}
    evaluator = Evaluator(model, named)
    ytd = {r["dim"]: r["ytd"] for r in evaluator.values(["ytd"], (), ("days", "stamp")).collect()}
    share = {r["dim"]: r["share"] for r in evaluator.values(["share"], (), ("shops", "name")).collect()}
    points = [("by month", k, f"{v:.2f}" if k != "2020-05" else "123456") for k, v in ytd.items()] + [("by shop", k, f"{v:.4f}") for k, v in share.items() if k and v is not None]
    shown = spark.createDataFrame([], "scenario string, measure string, dashboard_value string")
    charts = [("by month", ("days", "stamp"), "ytd"), ("by shop", ("shops", "name"), "share"), ("bare", ("shops", "kind"), "rows"), ("never", ("days", "year"), "nothing")]
    out = validation.validation_run(evaluator, ["rows"], {"all": ()}, shown, charts, spark.createDataFrame(points, "item_id string, dimension string, raw_value string"))
    got = {(r.item_id, r.dimension): (r.status, r.match_type) for r in out.where("item_type = 'grouped'").collect()}
    assert {k for k, v in got.items() if v[0] == "FAIL"} == {("by month", "2020-05"), ("by shop", "_COV"), ("never", None)}  # shops without a name aren't shown
    assert got["bare", None] == ("PASS", "executable") and got["never", None] == ("FAIL", "error") and len([k for k in got if k[0] == "by month"]) == len(ytd)
