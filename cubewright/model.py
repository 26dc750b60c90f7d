"""The semantic model: tables, relationships, and how a filter travels between tables.

A filter on one table reaches another along active relationships, from the one side to
the many side, and both ways where a relationship is one to one or filters in both
directions.  Any number of hops is followed.  Two active routes are ambiguous and
refused, as is whatever the model doesn't know: nothing is guessed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A measure or filter that can't be answered, with the reason."""


class Cardinality(Enum):
    MANY_ONE = "many-to-one"
    ONE_MANY = "one-to-many"
    ONE_ONE = "one-to-one"

    @classmethod
    def parse(cls, text: str) -> Cardinality:
        """The spellings in use: ``M:1``, ``many:1``, ``*:1``, ``many-to-one``, ``manyToOne`` and so on."""
        words = text.strip().lower().replace("-", "").replace("_", "").replace(" ", "").replace("to", ":")
        sides = [{"m": "many", "*": "many", "1": "one"}.get(s, s) for s in words.split(":")]
        known = {("many", "one"): cls.MANY_ONE, ("one", "many"): cls.ONE_MANY, ("one", "one"): cls.ONE_ONE}
        if tuple(sides) not in known:
            raise Refused(f"unknown cardinality {text!r}")
        return known[tuple(sides)]


@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    cardinality: Cardinality = Cardinality.MANY_ONE
    both_directions: bool = False
    active: bool = True


@dataclass(frozen=True)
class Step:
    """A filter's hop: rows of ``table`` whose ``column`` is among the values of ``source[source_column]``."""

    source: str
    source_column: str
    table: str
    column: str
    lookup: bool  # the source's column is unique


def derived(df: DataFrame, columns: Mapping[str, Column | Callable[[], Column]]) -> DataFrame:
    """A table with calculated columns, each a row formula over its columns and the calculated ones before it."""
    for name, formula in columns.items():
        if name.casefold() in {c.casefold() for c in df.columns}:
            raise Refused(f"there is a column {name!r} already")
        try:
            df = df.withColumn(name, formula if isinstance(formula, Column) else formula())
        except AnalysisException as e:
            raise Refused(f"{name!r} can't be calculated: {str(e).splitlines()[0]}") from None
    return df


class OpenedWhenNamed(Mapping[str, DataFrame]):
    """Tables that are opened when they are first asked for, so that a measure opens no table beside its own."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self.openers = dict(openers)
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.openers[name]()
        return self.opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.openers)

    def __len__(self) -> int:
        return len(self.openers)


@dataclass
class Model:
    """Tables (as DataFrames), relationships and the calendar's date column.

    Tables and columns of relationships are checked here, the columns of tables that are
    yet to be opened when a filter first takes the relationship.
    """

    tables: Mapping[str, DataFrame]
    relationships: Iterable[Relationship] = ()
    calendar: tuple[str, str] | None = None
    _names: dict[str, str] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.relationships = tuple(self.relationships)
        self._names = {name.casefold(): name for name in self.tables}
        for r in self.relationships:
            for table, column in ((r.from_table, r.from_column), (r.to_table, r.to_column)):
                if self.name(table) in getattr(self.tables, "opened", self.tables):
                    self.column(table, column)

    def table(self, name: str) -> DataFrame:
        return self.tables[self.name(name)]

    def name(self, table: str) -> str:
        if table.casefold() not in self._names:
            raise Refused(f"unknown table {table!r}")
        return self._names[table.casefold()]

    def column(self, table: str, column: str) -> str:
        for c in self.table(table).columns:
            if c.casefold() == column.casefold():
                return c
        raise Refused(f"unknown column {table}[{column}]")

    def steps_from(self, table: str) -> list[Step]:
        """Hops that a filter on ``table`` can take."""
        out = []
        for r in self.relationships:
            if not r.active:
                continue
            down = Step(r.to_table, r.to_column, r.from_table, r.from_column, r.cardinality is not Cardinality.ONE_MANY)
            up = Step(r.from_table, r.from_column, r.to_table, r.to_column, r.cardinality is not Cardinality.MANY_ONE)
            free = r.both_directions or r.cardinality is Cardinality.ONE_ONE
            if r.cardinality is not Cardinality.ONE_MANY or free:
                out.append(down)
            if r.cardinality is not Cardinality.MANY_ONE or free:
                out.append(up)
        return [s for s in out if s.source == table]

    def reach(self, table: str) -> set[str]:
        """Tables that a filter on ``table`` reaches, itself included."""
        seen, waiting = {self.name(table)}, deque([self.name(table)])
        while waiting:
            for s in self.steps_from(waiting.popleft()):
                if s.table not in seen:
                    seen.add(s.table)
                    waiting.append(s.table)
        return seen

    def route(self, source: str, target: str) -> list[Step] | None:
        """The hops of a filter from ``source`` to ``target``; None where it doesn't reach, Refused where two routes do."""
        source, target = self.name(source), self.name(target)
        found: list[list[Step]] = []

        def walk(at: str, taken: list[Step], seen: set[str]) -> None:
            if at == target:
                found.append(taken)
                return
            for s in self.steps_from(at):
                if s.table not in seen:
                    walk(s.table, [*taken, s], seen | {s.table})

        walk(source, [], {source})
        if len(found) > 1:
            raise Refused(f"a filter on {source} reaches {target} by {len(found)} routes")
        for s in found[0] if found else ():
            self.column(s.source, s.source_column)
            self.column(s.table, s.column)
        return found[0] if found else None

    def lookup_route(self, table: str, other: str) -> list[Step]:
        """Hops by which each row of ``table`` has at most one row of ``other``, from ``other`` to ``table``."""
        route = self.route(other, table)
        if route is None or not all(s.lookup for s in route):
            raise Refused(f"rows of {table} have no single row of {other}")
        return route

    def with_related(self, df: DataFrame, table: str, columns: Iterable[tuple[str, str]]) -> DataFrame:
        """Adds ``other__column`` for each (other, column): the value in the row's related row, null without one.

        Every hop is a left join on a unique key, so rows are neither lost nor multiplied.
        Tables that several routes pass are joined once, and distant tables are joined to
        nearer ones first: ``df`` itself meets each neighbour of its table once.
        """
        wanted: dict[str, set[str]] = {}
        hops: dict[str, dict[str, Step]] = {}  # table -> next tables outward, by the step that leads back
        for other, column in columns:
            other = self.name(other)
            wanted.setdefault(other, set()).add(self.column(other, column))
            for s in self.lookup_route(table, other):
                hops.setdefault(s.table, {})[s.source] = s

        def outward(rows: DataFrame, at: str, named: str) -> DataFrame:
            """``rows`` of table ``at``, whose columns that hops need are called ``named`` and their name, with all that lies beyond."""
            for source, step in sorted(hops.get(at, {}).items()):
                key, own = f"__{source}", f"__{source}_"
                needed = sorted({s.column for s in hops.get(source, {}).values()})
                found = self.table(source).select(
                    F.col(step.source_column).alias(key), *[F.col(c).alias(own + c) for c in needed],
                    *[F.col(c).alias(f"{source}__{c}") for c in sorted(wanted.get(source, ()))],
                )
                found = outward(found, source, own).drop(*[own + c for c in needed])
                rows = rows.join(found, F.col(named + step.column) == F.col(key), "left").drop(key)
            return rows

        return outward(df, self.name(table), "")

    def keys_after(self, source: str, target: str, rows: DataFrame, masks: list[Column]) -> tuple[str, DataFrame] | None:
        """(column of ``target``, distinct ``key`` values with the masks that ``rows`` of ``source`` leave); None where no filter reaches.

        masks: numbers whose bits are the filters that a row meets; a key has the bits of
        all its rows together, so many filters come over each hop in one join.  Keys that
        no filter leaves are absent.
        """
        route = self.route(source, target)
        if route is None:
            return None
        names = [f"m{i}" for i in range(len(masks))]

        def by_key(frame: DataFrame, column: str) -> DataFrame:
            return frame.groupBy(F.col(column).alias("key")).agg(*[F.bit_or(n).alias(n) for n in names])

        marked = rows.select(F.col(route[0].source_column).alias("__key"), *[m.alias(n) for m, n in zip(masks, names)])
        keys = by_key(marked.where(" OR ".join(f"{n} <> 0" for n in names)), "__key")
        for here, after in zip(route, route[1:]):
            own = self.table(here.table).select(F.col(here.column).alias("__here"), F.col(after.source_column).alias("__after"))
            keys = by_key(own.join(keys, F.col("__here") == F.col("key")).select("__after", *names), "__after")
        return route[-1].column, keys.where("key IS NOT NULL")
