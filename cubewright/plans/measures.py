"""Measures: aggregates, arithmetic over them, and changes of the filter context.

A measure is a small tree of frozen nodes that ordinary Python expressions build:
``total("orders", "o_totalprice") / count_rows("orders")``.  Row formulas inside an
aggregate are Spark columns, or functions without arguments that make them once there is
a session; a column of a related table is ``related("orders", "o_orderdate")``.  Nothing here touches data: :mod:`cubewright.plans.lower` turns trees
into DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Refused

Formula = Column | Callable[[], Column]
AGGREGATES = ("sum", "avg", "min", "max", "count", "distinct_count", "rows")


class Node:
    """Arithmetic between measures; BLANK (null) on either side gives BLANK, and so does division by zero."""

    def __add__(self, other: Any) -> Node:
        return Arithmetic("+", self, as_node(other))

    def __radd__(self, other: Any) -> Node:
        return Arithmetic("+", as_node(other), self)

    def __sub__(self, other: Any) -> Node:
        return Arithmetic("-", self, as_node(other))

    def __rsub__(self, other: Any) -> Node:
        return Arithmetic("-", as_node(other), self)

    def __mul__(self, other: Any) -> Node:
        return Arithmetic("*", self, as_node(other))

    def __rmul__(self, other: Any) -> Node:
        return Arithmetic("*", as_node(other), self)

    def __truediv__(self, other: Any) -> Node:
        return Arithmetic("/", self, as_node(other))

    def __rtruediv__(self, other: Any) -> Node:
        return Arithmetic("/", as_node(other), self)


@dataclass(frozen=True, eq=False)
class Constant(Node):
    value: float


@dataclass(frozen=True, eq=False)
class Arithmetic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True, eq=False)
class Divide(Node):
    """Division with an alternate result, given only where the divisor is zero."""

    left: Node
    right: Node
    alternate: float | None = None


@dataclass(frozen=True, eq=False)
class Reference(Node):
    """Another measure of the same set, by name, whatever its case."""

    name: str


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    kind: str
    table: str
    value: Formula | str | None = None
    related: tuple[tuple[str, str], ...] = ()
    where: Formula | None = None

    def __post_init__(self) -> None:
        if self.kind not in AGGREGATES:
            raise ValueError(f"no aggregate {self.kind!r}")


@dataclass(frozen=True, eq=False)
class Calculate(Node):
    measure: Node
    changes: tuple[Any, ...] = field(default=())


def as_node(value: Any) -> Node:
    return value if isinstance(value, Node) else Constant(float(value))


# Filters and changes of the context.


@dataclass(frozen=True)
class Is:
    """``table[column] op value``; op is one of = <> < <= > >= and value is text, a number or a date."""

    table: str
    column: str
    value: Any
    op: str = "="


@dataclass(frozen=True)
class UpTo:
    """``table[column] op`` the least or greatest value of a column in the context outside the change."""

    table: str
    column: str
    op: str
    bound: str
    bound_table: str
    bound_column: str
    clear: bool = True


@dataclass(frozen=True)
class All:
    """Takes away all filters, those on a table, or those on one column."""

    table: str | None = None
    column: str | None = None


@dataclass(frozen=True)
class ToDate:
    """The year, quarter or month up to the latest calendar date in the context."""

    period: str


@dataclass(frozen=True)
class Shift:
    """The calendar dates in the context, moved by whole units."""

    count: int
    unit: str


def same_period_last_year() -> Shift:
    return Shift(-1, "year")


def related(table: str, column: str) -> Column:
    """In a row formula: the value in the row's related row; name the pair in ``using`` as well."""
    return F.col(f"{table}__{column}")


def _aggregate(kind: str):
    def build(table: str, value: Formula | str | None = None, using: Sequence[tuple[str, str]] = (), where: Formula | None = None) -> Aggregate:
        return Aggregate(kind, table, value, tuple(using), where)

    build.__doc__ = f"The {kind} of a column or row formula over the rows of a table, or those that ``where`` keeps."
    return build


total, average, least, greatest = (_aggregate(k) for k in ("sum", "avg", "min", "max"))
count_values, distinct_count, count_rows = (_aggregate(k) for k in ("count", "distinct_count", "rows"))


# Names of aggregates in free text, first match first.
AGGREGATE_NAMES = (
    ("DISTINCTCOUNT", "distinct_count"), ("COUNT DISTINCT", "distinct_count"), ("COUNT(DISTINCT", "distinct_count"), ("COUNTROWS", "rows"),
    ("AVERAGE", "avg"), ("AVG", "avg"), ("SUM", "sum"), ("MIN", "min"), ("MAX", "max"), ("COUNT", "count"),
)


def named_aggregate(text: str, table: str, value: Formula | str | None = None) -> Aggregate:
    """The aggregate that a free text such as ``Count Distinct`` names; refused if it names none."""
    for part, kind in AGGREGATE_NAMES:
        if part in text.upper():
            return Aggregate(kind, table, value)
    raise Refused(f"no aggregate is named in {text!r}")


def divide(left: Any, right: Any, alternate: float | None = None) -> Divide:
    return Divide(as_node(left), as_node(right), alternate)


def calculate(measure: Node, *changes: Any) -> Calculate:
    return Calculate(measure, changes)


def to_date(measure: Node, period: str, *more: Any) -> Calculate:
    return Calculate(measure, (ToDate(period), *more))
