"""Date functions of row formulas: text or timestamps in, null for what isn't a date."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "month", "quarter", "year")


def as_timestamp(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def year(value: Column) -> Column:
    return F.year(as_timestamp(value))


def month(value: Column) -> Column:
    return F.month(as_timestamp(value))


def day(value: Column) -> Column:
    return F.day(as_timestamp(value))


def calendar_table(spark: SparkSession, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """A row for each day: date, year, quarter, month; none if there is no first or last day."""
    days = (last - first).days + 1 if first is not None and last is not None else 0
    day = (F.lit(first or dt.date(1970, 1, 1)) + F.col("id").cast("int")).alias("date")
    return spark.range(0, days, 1, 1).select(day).select(
        F.col("date").cast("timestamp_ntz").alias("date"), F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month")
    )


def boundaries(start: Column, end: Column, unit: str) -> Column:
    """Boundaries of ``unit`` between two moments: 31 January to 1 February is one month.

    Not the number of whole elapsed units that ``timestampdiff`` gives.  Weeks are refused.
    """
    unit = unit.lower()
    if unit not in UNITS:
        raise ValueError(f"no boundary count for {unit!r}")
    a, b = as_timestamp(start), as_timestamp(end)
    years = (F.year(b) - F.year(a)).cast("long")
    if unit == "year":
        return years
    if unit == "quarter":
        return years * 4 + F.quarter(b) - F.quarter(a)
    if unit == "month":
        return years * 12 + F.month(b) - F.month(a)
    days = F.datediff(b, a).cast("long")
    if unit == "day":
        return days
    hours = days * 24 + F.hour(b) - F.hour(a)
    if unit == "hour":
        return hours
    minutes = hours * 60 + F.minute(b) - F.minute(a)
    if unit == "minute":
        return minutes
    return minutes * 60 + F.floor(F.second(b)) - F.floor(F.second(a))


def shifted(value: Column, count: int, unit: str) -> Column:
    """A moment moved by whole units, to the last day of a shorter month where needed."""
    unit = unit.lower()
    scale = {"day": ("DAY", 1), "month": ("MONTH", 1), "quarter": ("MONTH", 3), "year": ("MONTH", 12)}
    if unit not in scale:
        raise ValueError(f"no shift by {unit!r}")
    name, times = scale[unit]
    parts = {"DAY": {"days": F.lit(count * times)}, "MONTH": {"months": F.lit(count * times)}}[name]
    return as_timestamp(value) + F.make_interval(**parts)


# One moment on the driver: the ends of a period.


def period_start(moment: dt.datetime, period: str) -> dt.datetime:
    """The first moment of the year, quarter or month of a moment."""
    months = {"year": 1, "quarter": moment.month - (moment.month - 1) % 3, "month": moment.month}
    if period not in months:
        raise ValueError(f"no period {period!r}")
    return dt.datetime(moment.year, months[period], 1)


def moved(moment: dt.datetime, count: int, unit: str) -> dt.datetime:
    """What :func:`shifted` gives, for one moment."""
    unit = unit.lower()
    if unit == "day":
        return moment + dt.timedelta(days=count)
    if unit not in ("month", "quarter", "year"):
        raise ValueError(f"no shift by {unit!r}")
    years, month = divmod(moment.year * 12 + moment.month - 1 + count * {"month": 1, "quarter": 3, "year": 12}[unit], 12)
    return moment.replace(year=years, month=month + 1, day=min(moment.day, calendar.monthrange(years, month + 1)[1]))
