import pytest
from pyspark.sql import functions as F

from cubewright.functions import dates, display, names


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a, b, unit, want",
    [("2020-01-31", "2020-02-01", "month", 1), ("2020-12-31", "2021-01-01", "year", 1), ("2020-12-31 23:00", "2021-01-01 01:00", "day", 1), ("2020-01-01 23:59", "2020-01-02 00:01", "hour", 1), ("2020-03-31", "2020-04-01", "quarter", 1), ("2020-01-01 00:00:59.9", "2020-01-01 00:01:00.1", "second", 1), ("no", "2020-01-01", "day", None), ("2020-01-01 00:59:59", "2020-01-01 01:00:00", "minute", 1)],
)
def test_boundaries(spark, a, b, unit, want):
    assert one(spark, dates.boundaries(F.lit(a), F.lit(b), unit)) == want


@pytest.mark.parametrize("start, n, unit, want", [("2020-03-31", -1, "month", "2020-02-29"), ("2020-02-29", -1, "year", "2019-02-28"), ("2020-05-31", -1, "quarter", "2020-02-29"), ("2020-01-01", 2, "day", "2020-01-03")])
def test_shifts_end_in_the_month(spark, start, n, unit, want):
    assert str(one(spark, dates.shifted(F.lit(start), n, unit)))[:10] == want


@pytest.mark.parametrize(
    "text, value, unit",
    [("109.81M", 109810000.0, ""), ("11.4%", 11.4, "%"), ("$1,234.5", 1234.5, "currency"), ("(500)", -500.0, ""), ("€1.5bn", 1.5e9, "currency"), ("-$5", -5.0, "currency"), ("5 K", 5000.0, ""), ("12ab", None, ""), ("%", None, "%"), ("", None, ""), (None, None, ""), ("1e3", 1000.0, ""), ("(1,000%)", -1000.0, "%"), (".5", 0.5, "")],
)
def test_parse_value(spark, text, value, unit):
    got = one(spark, display.parse_value(F.lit(text).cast("string")))
    assert (got["value"], got["unit"]) == (value, unit)


@pytest.mark.parametrize("value, pattern, want", [(51879473.12, "\\$#,0", "$51,879,473"), (0.114302, "0.0%", "11.4%"), (35.0, '0.0"%"', "35.0%"), (1234.5, "", "1,234.5"), (None, "0", "")])
def test_apply_format(spark, value, pattern, want):
    assert one(spark, display.apply_format(F.lit(value).cast("double"), pattern)) == want


def test_small_formats(spark):
    assert one(spark, display.signed_difference(F.lit(1234.5))) == "+1,234.5"
    assert one(spark, display.signed_difference(F.lit(None).cast("double"))) == "—"
    assert one(spark, display.plain_number(F.lit(1200.0))) == "1200"
    assert one(spark, display.plain_number(F.lit(0.25))) == "0.25"
    assert [one(spark, display.duration(F.lit(s))) for s in (0, 45, 125)] == ["--", "45s", "2m 05s"]
    assert "percentage" in display.describe_format("0.0%")


def test_words_and_severity(spark):
    assert one(spark, names.column_words(F.lit("dim_SalesAmount"))) == ["sales", "amount"]
    assert one(spark, names.title_concepts(F.lit("Verify the total Sales value of a KPI"))) == "sales total"
    assert one(spark, names.issue_severity(F.lit("chart-missing"), F.lit("1"))) == "Medium"
    assert one(spark, names.issue_severity(F.lit("chart-missing"), F.lit(""))) == "High"


@pytest.mark.parametrize("moment, n, unit", [("2020-03-31", -1, "month"), ("2020-02-29", -1, "year"), ("2020-05-31", -1, "quarter"), ("2020-01-01", 2, "day"), ("2020-12-31", 2, "month"), ("2021-01-15", -13, "month")])
def test_moments_move_on_the_driver_as_in_columns(spark, moment, n, unit):
    import datetime as dt

    assert dates.moved(dt.datetime.fromisoformat(moment), n, unit) == one(spark, dates.shifted(F.lit(moment), n, unit))
    for period in ("year", "quarter", "month"):
        assert dates.period_start(dt.datetime.fromisoformat(moment), period) == one(spark, F.date_trunc(period, F.lit(moment)).cast("timestamp_ntz"))
    for bad in (lambda: dates.moved(dt.datetime.now(), 1, "week"), lambda: dates.period_start(dt.datetime.now(), "week")):
        with pytest.raises(ValueError):
            bad()


def test_switch_and_sets(spark):
    from cubewright.functions.logic import in_order_once, running_total, share_of_total, switch_true
    from cubewright.model import Refused
    from cubewright.operators import sets

    assert one(spark, switch_true(F.lit(1) > 2, "a", F.lit(2) > 1, "b", "c")) == "b" and one(spark, switch_true(F.lit(1) > 2, "a")) is None
    for bad in (lambda: switch_true(F.lit(True)), lambda: switch_true(F.lit(1) > 0, 2, "x", 3)):
        with pytest.raises(Refused):
            bad()
    assert one(spark, in_order_once(F.array(*map(F.lit, ["b", "a", None, "b", "c", "a"])))) == ["b", "a", "c"]
    shown = spark.createDataFrame([("A ",), ("x",), (None,), ("A ",)], "dim string")
    held = spark.createDataFrame([("a",), ("y",), (None,)], "dim string")
    assert {r.dim for r in sets.invalid(shown, held).collect()} == {"A ", "x"}
    assert {r.dim for r in sets.invalid(shown, held, fold=True).collect()} == {"x"}
    assert {r.dim for r in sets.missing(shown, held, fold=True).collect()} == {"y"}
    assert {r.dim for r in sets.shared(shown, held, fold=True).collect()} == {"a", None}
    rows = spark.createDataFrame([(1, 2.0, "p"), (2, 3.0, "p"), (3, 5.0, "q")], "k int, v double, g string")
    assert [r.running for r in running_total(rows, "v", ["k"]).orderBy("k").collect()] == [2, 5, 10]
    assert [r.running for r in running_total(rows, "v", ["k"], ["g"]).orderBy("k").collect()] == [2, 5, 5]
    assert [r.share for r in share_of_total(rows, "v", ["g"]).orderBy("k").collect()] == [0.4, 0.6, 1.0]
    assert share_of_total(rows.withColumn("v", F.lit(0.0)), "v").where("share is not null").count() == 0
