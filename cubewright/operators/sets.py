"""What a report shows against what a source holds, as sets.  Both frames have the columns named in ``on``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(on: Sequence[str], fold: bool) -> list[tuple[str, Column]]:
    return [(f"__{c}", F.lower(F.trim(F.col(c).cast("string"))) if fold else F.col(c)) for c in on]


def _apart(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, fold: bool) -> DataFrame:
    """Different rows of ``left`` with a partner (left_semi) or without one (left_anti); nulls are equal."""
    keys = _keys(on, fold)
    there = right.select(*[k.alias(f"{n}_r") for n, k in keys]).distinct()
    meets = [F.col(n).eqNullSafe(F.col(f"{n}_r")) for n, _ in keys]
    return left.select(*on).distinct().withColumns(dict(keys)).join(there, meets, how).drop(*[n for n, _ in keys])


def invalid(shown: DataFrame, held: DataFrame, on: Sequence[str] = ("dim",), fold: bool = False) -> DataFrame:
    """Shown, but not held by the source; ``fold``: text is compared trimmed and in lower case."""
    return _apart(shown, held, on, "left_anti", fold)


def missing(shown: DataFrame, held: DataFrame, on: Sequence[str] = ("dim",), fold: bool = False) -> DataFrame:
    """Held by the source, but not shown."""
    return _apart(held, shown, on, "left_anti", fold)


def shared(shown: DataFrame, held: DataFrame, on: Sequence[str] = ("dim",), fold: bool = False) -> DataFrame:
    """Both shown and held."""
    return _apart(held, shown, on, "left_semi", fold)
