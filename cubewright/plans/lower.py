"""From measures and filter contexts to DataFrames.

Each measure falls apart into leaves: one aggregate under one context.  All leaves of a
base table are answered by one scan of it, as conditional aggregates, whatever their
contexts: the filtered columns of related tables come in by one chain of left joins on
unique keys, whatever the number of contexts, and each context is a predicate over them;
a filter that comes up to the one side is a flag that a left join on distinct keys brings
in.  No row is lost or multiplied.  Distinct counts first group by the counted
value with a flag for each leaf and then count the flags, so many of them cost one
shuffle and no copies of rows.  Results of several tables meet on the group columns.

Dates that periods start from or end at are worked out before: those of all measures and
all contexts in one aggregate, and a second only for periods within periods.

The member of a grouped query is part of each leaf's context, as a :class:`Member` that
changes of the context take away like any filter.  A leaf that has lost it is worked out
once and given to every group; a leaf under a period that depends on the member reads
sums by day (see :mod:`.ranges`) from the group's first to its last day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_timestamp, moved, period_start, shifted
from ..model import Model, Refused
from . import measures as M
from .ranges import FAR, by_node, day_number, nodes_between

_OPS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Restriction:
    """One condition of a context: ``table[column]`` compared with a value, or between two dates."""

    table: str
    column: str
    op: str
    value: Any
    upper: Any = None

    def predicate(self, schema: T.StructType, name: str | None = None) -> Column:
        """The condition over the column, or over one of another ``name`` that holds its values."""
        kind, c = schema[self.column].dataType, F.col(name or self.column)
        if self.op == "between":
            return (as_timestamp(c) >= F.lit(self.value)) & (as_timestamp(c) <= F.lit(self.upper))
        value = F.lit(self.value)
        if isinstance(self.value, dt.date):  # a datetime too
            c, value = as_timestamp(c), F.lit(self.value).cast("timestamp_ntz")
        elif isinstance(self.value, str) and not isinstance(kind, T.StringType):
            value = value.try_cast(kind)
        elif isinstance(kind, T.StringType) and not isinstance(self.value, str):
            value = F.lit(str(self.value))
        return _OPS[self.op](c, value)


@dataclass(frozen=True, eq=False)
class Band:
    """A group for each value of a row formula over ``table``; ``using``: related columns that it reads."""

    table: str
    formula: M.Formula
    using: tuple[tuple[str, str], ...] = ()


Group = tuple[str, str] | Band


@dataclass(frozen=True)
class Member:
    """The filter of a grouped query: rows of the group's own member.  A band has no column that could be cleared."""

    table: str
    column: str | None


#: The member of whichever grouping: stands for all of several whose leaves keep it.
ANY = Member("", None)


@dataclass(frozen=True)
class Period:
    """A condition on ``table[column]`` whose bounds differ between the members of a grouped query.

    ``ends``: leaves of the least and the greatest value that the bounds are worked out
    from.  ``rule``: ("to date", period), ("shift", count, unit) or ("up to", op, bound).
    """

    table: str
    column: str
    ends: tuple[Leaf, Leaf]
    rule: tuple

    def holds(self, value: Column, low: Column, high: Column) -> Column:
        """Whether a value lies within the bounds that come from the least and greatest value."""
        if self.rule[0] == "up to":
            return _OPS[self.rule[1]](value, {"min": low, "max": high}[self.rule[2]])
        first, last = self._moments(low, high)
        return (as_timestamp(value) >= first) & (as_timestamp(value) <= last)

    def _moments(self, low: Column, high: Column) -> tuple[Column, Column]:
        low, high = as_timestamp(low), as_timestamp(high)
        if self.rule[0] == "to date":
            return F.date_trunc(self.rule[1], high).cast("timestamp_ntz"), high
        return shifted(low, *self.rule[1:]), shifted(high, *self.rule[1:])

    def days(self, low: Column, high: Column) -> tuple[Column | None, Column | None]:
        """Numbers of the first and last day within the bounds; None where a side is open."""

        def begun(moment: Column) -> Column:  # the first day that begins at the moment or later
            return day_number(moment) + F.when(as_timestamp(moment) > F.date_trunc("day", moment).cast("timestamp_ntz"), 1).otherwise(0)

        if self.rule[0] != "up to":
            first, last = self._moments(low, high)
            return begun(first), day_number(last)
        value = {"min": low, "max": high}[self.rule[2]]
        return {
            "=": (begun(value), day_number(value)), "<=": (None, day_number(value)), "<": (None, begun(value) - 1), ">=": (begun(value), None), ">": (day_number(value) + 1, None),
        }[self.rule[1]]


Context = tuple[Restriction | Member | Period, ...]


@dataclass(frozen=True)
class Leaf:
    aggregate: M.Aggregate
    context: Context


class _Unknown(Exception):
    """A bound that is yet to be worked out."""


class Evaluator:
    """Answers measures of one model.  ``named`` holds the measures that others may refer to."""

    def __init__(self, model: Model, named: Mapping[str, M.Node] | None = None):
        self.model = model
        self.named = dict(named or {})
        self._folded = {k.casefold(): v for k, v in self.named.items()}
        self._dates: dict[Context, tuple[Any, Any]] = {}
        self._unknown: dict[Context, tuple[str, str]] = {}
        self._checked: set[tuple[str, T.DataType]] = set()
        self._ends: dict[tuple[str, str, Context], tuple[Leaf, Leaf]] = {}

    # Contexts -------------------------------------------------------------

    def restriction(self, f: M.Is) -> Restriction:
        """A filter checked against the model; text that the column's type can't hold is refused."""
        table = self.model.name(f.table)
        column = self.model.column(table, f.column)
        if f.op not in _OPS:
            raise Refused(f"unknown comparison {f.op!r}")
        kind = self.model.table(table).schema[column].dataType
        if isinstance(f.value, str) and not isinstance(kind, T.StringType) and (f.value, kind) not in self._checked:
            # A row of literals: Spark folds it, so no job runs.
            spark = self.model.table(table).sparkSession
            if spark.sql("SELECT * FROM VALUES (1)").select(F.lit(f.value).try_cast(kind)).first()[0] is None:
                raise Refused(f"{f.value!r} is no value of {table}[{column}]")
            self._checked.add((f.value, kind))
        return Restriction(table, column, f.op, f.value)

    def _calendar(self) -> tuple[str, str]:
        if self.model.calendar is None:
            raise Refused("the model has no calendar")
        table, column = self.model.calendar
        return self.model.name(table), self.model.column(table, column)

    def _member(self, by: Group | None) -> Context:
        """What the context of a grouped query has beside its filters."""
        if by is None:
            return ()
        table = self.model.name(by.table if isinstance(by, Band) else by[0])
        return (Member(table, None if isinstance(by, Band) else self.model.column(table, by[1])),)

    def _by_member(self, table: str, context: Context) -> bool:
        """Whether rows of ``table`` in this context differ between the members of a grouped query."""
        return any(not isinstance(r, Restriction) and r is not ANY and (r.table == table or self.model.route(r.table, table) is not None) for r in context)

    def _period(self, context: Context, table: str, column: str, rule: tuple, bound: tuple[str, str]) -> Period:
        """A condition on ``table[column]`` by the least or greatest value of ``bound`` (table, column) in each member's context."""
        key = (*bound, context)
        if key not in self._ends:
            self._ends[key] = tuple(Leaf(M.Aggregate(kind, *bound), context) for kind in ("min", "max"))
        return Period(table, column, self._ends[key], rule)

    def _bounds(self, table: str, column: str, context: Context) -> tuple[Any, Any]:
        """Least and greatest value of a column in a context; noted and raised as unknown before they are worked out."""
        key = (*[r for r in context if isinstance(r, Restriction)], Restriction(table, column, "bounds", None))
        if key not in self._dates:
            self._unknown[key] = (table, column)
            raise _Unknown
        return self._dates[key]

    def _expanded(self, cells: Sequence[tuple[M.Node, Context]]) -> tuple[list[str], list[Leaf]]:
        """Each measure as arithmetic over its leaves, and the leaves of all; unknown bounds are worked out in one job together."""
        while True:
            leaves: dict[Leaf, int] = {}
            columns = []
            for node, context in cells:
                try:
                    columns.append(self._expand(node, context, leaves, ()))
                except _Unknown:
                    pass
            if not self._unknown:
                return columns, list(leaves)
            wanted, self._unknown = self._unknown, {}
            ends = [Leaf(M.Aggregate(kind, table, column), key[:-1]) for key, (table, column) in wanted.items() for kind in ("min", "max")]
            row = self._flat(ends, typed=True).first()
            for i, key in enumerate(wanted):
                self._dates[key] = (row[2 * i], row[2 * i + 1])

    def change(self, context: Context, change: Any) -> Context | None:
        """The context after one change; None where no date is left to move, so that the measure is BLANK."""
        if isinstance(change, M.Is):
            return (*context, self.restriction(change))
        if isinstance(change, M.All):
            if change.table is None:
                return ()
            table = self.model.name(change.table)
            column = self.model.column(table, change.column) if change.column else None
            return tuple(r for r in context if r.table != table or (column and r.column != column))
        if isinstance(change, M.UpTo):
            table, bound_table = self.model.name(change.table), self.model.name(change.bound_table)
            bound_column = self.model.column(bound_table, change.bound_column)
            kept = tuple(r for r in context if r.table != table) if change.clear else context
            if self._by_member(bound_table, context):
                if change.op not in ("=", "<", "<=", ">", ">="):
                    raise Refused(f"no group has one bound for {change.op!r}")
                return (*kept, self._period(context, table, self.model.column(table, change.column), ("up to", change.op, change.bound), (bound_table, bound_column)))
            low, high = self._bounds(bound_table, bound_column, context)
            value = {"min": low, "max": high}[change.bound]
            if value is None:
                return None
            return (*kept, self.restriction(M.Is(change.table, change.column, value, change.op)))
        if isinstance(change, (M.ToDate, M.Shift)):
            table, column = self._calendar()
            if self._by_member(table, context):
                if isinstance(change, M.ToDate):  # the member's place on the calendar gives way to the period up to it, filters stay
                    rule, kept = ("to date", change.period), tuple(r for r in context if r.table != table or isinstance(r, Restriction))
                else:
                    rule, kept = ("shift", change.count, change.unit), tuple(r for r in context if r.table != table)
                try:  # units and periods that there aren't are refused here as well
                    period_start(dt.datetime(2000, 1, 1), change.period) if rule[0] == "to date" else moved(dt.datetime(2000, 1, 1), change.count, change.unit)
                except ValueError as e:
                    raise Refused(str(e)) from None
                return (*kept, self._period(context, table, column, rule, (table, column)))
            low, high = self._bounds(table, column, context)
            if high is None:
                return None
            try:
                if isinstance(change, M.ToDate):
                    return (*context, Restriction(table, column, "between", period_start(_moment(high), change.period), _moment(high)))
                first, last = (moved(_moment(v), change.count, change.unit) for v in (low, high))
            except ValueError as e:
                raise Refused(str(e)) from None
            return (*(r for r in context if r.table != table), Restriction(table, column, "between", first, last))
        raise Refused(f"unknown change of context {change!r}")

    # Measures -------------------------------------------------------------

    def _expand(self, node: M.Node, context: Context, leaves: dict[Leaf, int], within: tuple[str, ...]) -> str:
        """The measure as an SQL expression over the columns ``l0``, ``l1`` and so on of its leaves."""
        if isinstance(node, M.Constant):
            return f"CAST('{float(node.value)!r}' AS DOUBLE)"
        if isinstance(node, M.Reference):
            name = node.name.casefold()
            if name not in self._folded:
                raise Refused(f"unknown measure [{node.name}]")
            if name in within:
                raise Refused(f"[{node.name}] refers to itself")
            return self._expand(self._folded[name], context, leaves, (*within, name))
        if isinstance(node, M.Aggregate):
            self.model.name(node.table)
            return f"l{leaves.setdefault(Leaf(node, context), len(leaves))}"
        if isinstance(node, M.Calculate):
            outer = context
            for c in node.changes:
                changed = self.change(outer, c)
                if changed is None:
                    return "CAST(NULL AS DOUBLE)"
                outer = changed
            return self._expand(node.measure, outer, leaves, within)
        if isinstance(node, (M.Divide, M.Arithmetic)):
            left, right = (self._expand(n, context, leaves, within) for n in (node.left, node.right))
            if isinstance(node, M.Arithmetic) and node.op != "/":
                return f"({left} {node.op} {right})"
            plain = f"try_divide({left}, {right})"
            alternate = getattr(node, "alternate", None)
            return plain if alternate is None else f"CASE WHEN {right} = 0 THEN CAST('{float(alternate)!r}' AS DOUBLE) ELSE {plain} END"
        raise Refused(f"unknown measure {node!r}")

    def _base(self, table: str, leaves: Sequence[Leaf], related: set[tuple[str, str]]) -> tuple[DataFrame, dict[Context, Column | None]]:
        """The table with all columns its leaves need and ``related`` ones, and the condition of each context's restrictions."""
        model = self.model
        df = model.table(table)
        schema = df.schema
        plain = {leaf.context: tuple(r for r in leaf.context if isinstance(r, Restriction)) for leaf in leaves}
        related = related | {(t, c) for leaf in leaves for t, c in leaf.aggregate.related}
        lookups: dict[str, bool] = {}
        for other in {r.table for context in plain.values() for r in context} - {table}:
            route = model.route(other, table)
            lookups[other] = route is not None and all(s.lookup for s in route)
        related |= {(r.table, r.column) for context in plain.values() for r in context if lookups.get(r.table)}
        df = model.with_related(df, table, related)
        hits: dict[Restriction, Column] = {}

        def hit(r: Restriction) -> Column:
            if r not in hits:
                if r.table == table:
                    hits[r] = r.predicate(schema)
                else:
                    kinds = model.table(r.table).schema
                    hits[r] = r.predicate(kinds, f"{r.table}__{r.column}") if lookups[r.table] else r.predicate(kinds)
            return hits[r]

        # Filters that come up to this table: one key table for each table that they come from, with a bit for each group of them.
        upward: dict[str, list[tuple[Restriction, ...]]] = {}
        groups = {}
        for context in plain.values():
            for r in context:
                if r.table != table:
                    groups.setdefault(context, {}).setdefault(r.table, []).append(r)
        for of in groups.values():
            for other, members in of.items():
                if not lookups[other] and tuple(members) not in upward.setdefault(other, []):
                    upward[other].append(tuple(members))
        flags: dict[tuple[Restriction, ...], Column] = {}
        for other, members in upward.items():
            masks = masks_of([reduce(Column.__and__, map(hit, m)) for m in members])
            found = model.keys_after(other, table, model.table(other), masks)
            if found is not None:  # a filter that doesn't reach the table changes nothing
                column, keys = found
                names = [f"__{other}_k", *[f"__{other}_m{i}" for i in range(len(masks))]]
                df = df.join(keys.toDF(*names), F.col(column) == F.col(names[0]), "left").drop(names[0])
                flags |= {m: bit_of(names[1:], i) for i, m in enumerate(members)}

        # One expression for each set of restrictions, shared by all its leaves.
        made: dict[Context, Column | None] = {}
        for context in dict.fromkeys(plain.values()):
            parts = [hit(r) for r in context if r.table == table]
            for other, members in groups.get(context, {}).items():
                if lookups[other]:
                    parts += [hit(r) for r in members]
                elif tuple(members) in flags:
                    parts.append(flags[tuple(members)])
            made[context] = reduce(Column.__and__, parts) if parts else None
        wheres = {leaf: leaf.aggregate.where for leaf in leaves}
        if all(made[plain[leaf.context]] is not None or wheres[leaf] is not None for leaf in leaves):
            # No leaf needs the other rows: they are filtered before anything is grouped.
            keep = list(made.values()) if all(c is not None for c in made.values()) else [
                reduce(Column.__and__, [c for c in (made[plain[leaf.context]], None if wheres[leaf] is None else _column(wheres[leaf])) if c is not None]) for leaf in leaves
            ]
            df = df.where(reduce(Column.__or__, keep))
        return df, {context: made[restrictions] for context, restrictions in plain.items()}

    def _check(self, leaf: Leaf, by: Group | None) -> None:
        """Refuse a leaf whose columns, filters or groups the model can't bring to its table; no frame is made."""
        model, table = self.model, self.model.name(leaf.aggregate.table)
        if isinstance(leaf.aggregate.value, str):
            model.column(table, leaf.aggregate.value)
        wanted = {*leaf.aggregate.related, *self._reaching(leaf), *self._of_member(leaf, by)}
        for r in leaf.context:
            for end in r.ends if isinstance(r, Period) else ():
                self._check(end, by)
        for other, column in wanted:
            model.column(other, column)
            if model.name(other) != table:
                model.lookup_route(table, other)
        for other in {r.table for r in leaf.context if isinstance(r, Restriction)} - {table}:
            model.route(other, table)

    def _of_member(self, leaf: Leaf, by: Group | None) -> list[tuple[str, str]]:
        """Columns that the group of a leaf's row is read from; none for a leaf that has lost the member."""
        if by is None or not any(isinstance(r, Member) for r in leaf.context):
            return []
        if not isinstance(by, Band):
            return [(self.model.name(by[0]), self.model.column(by[0], by[1]))]
        if self.model.name(by.table) != self.model.name(leaf.aggregate.table):
            raise Refused(f"rows of {leaf.aggregate.table} have no formula over rows of {by.table}")
        return list(by.using)

    def _reaching(self, leaf: Leaf) -> dict[tuple[str, str], list[Period]]:
        """Periods of a leaf that reach its table, by their column; those of a context without the member must be days of one column."""
        table, out = self.model.name(leaf.aggregate.table), {}
        for r in leaf.context:
            if isinstance(r, Period) and (r.table == table or self.model.route(r.table, table) is not None):
                out.setdefault((r.table, r.column), []).append(r)
        if out and not any(isinstance(r, Member) for r in leaf.context):
            if len(out) > 1:
                raise Refused("bounds of one group lie on several columns")
            ((other, column),) = out
            if not isinstance(self.model.table(other).schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise Refused(f"{other}[{column}] is bounded by group and holds no dates")
        return out

    def _frames(self, leaves: Mapping[int, Leaf], by: Group | None, typed: bool, dated: bool = False, sets: Mapping[int, Mapping[int, Group]] | None = None) -> list[DataFrame]:
        """Frames of one row, or with column ``dim`` of a row for each group, that together hold column ``l{i}`` of each leaf.

        ``dated``: the leaves have periods that reach them; each row is held against its own group's bounds.
        ``sets``: the numbered groupings that each leaf is for, instead of ``by``; rows are then keyed by ``set`` as well.
        """
        apart: dict[tuple, dict[int, Leaf]] = {}
        for i, leaf in leaves.items():
            a = leaf.aggregate
            distinct = str(_column(a.value)) + str(a.related) if a.kind == "distinct_count" else ""
            apart.setdefault((self.model.name(a.table), distinct), {})[i] = leaf
        frames = []
        for (table, distinct), members in apart.items():
            related = {pair for leaf in members.values() for pair in (*self._of_member(leaf, by), *(self._reaching(leaf) if dated else ())) if pair[0] != table}
            groupings = {k: g for i in members for k, g in (sets or {}).get(i, {}).items()}
            related |= {(self.model.name(g[0]), self.model.column(g[0], g[1])) for g in groupings.values() if self.model.name(g[0]) != table}
            df, restricted = self._base(table, list(members.values()), related)
            keys = [] if by is None else [self._dimension(table, by).alias("dim")]
            if sets is not None:  # grouping sets: each row once for every grouping
                df = df.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(k).alias("set"), self._dimension(table, g).cast("string").alias("dim")) for k, g in groupings.items()])))
                keys = [F.col("__s.set").alias("set"), F.col("__s.dim").alias("dim")]
            conditions = {context: restricted[context] for context in dict.fromkeys(leaf.context for leaf in members.values())}
            if dated:
                df, conditions = self._within(df, table, members, conditions, by)
            dim = ["set", "dim"] if sets is not None else ["dim"] * len(keys)
            if distinct:
                frames.append(_distinct_counts(df, members, conditions, keys, dim))
                continue
            direct = len(conditions) <= MOST_DIRECT
            atoms, of_leaf = _atoms(members, conditions if direct else None)
            if direct:
                out = df.groupBy(*keys).agg(*atoms)
                frames.append(out.selectExpr(*dim, *[_final(leaf, of_leaf[i], typed) + f" AS l{i}" for i, leaf in members.items()]))
                continue
            # Signatures: rows with the same bits meet the same contexts, and are aggregated once whatever their number.
            masks = masks_of([F.lit(True) if on is None else on for on in conditions.values()])
            names = [f"__m{k}" for k in range(len(masks))]
            place = {c: k for k, c in enumerate(conditions)}
            cube = df.groupBy(*keys, *[m.alias(n) for m, n in zip(masks, names)]).agg(*atoms)
            cells = [_final(leaf, of_leaf[i], typed, _has_bit(place[leaf.context])) + f" AS l{i}" for i, leaf in members.items()]
            frames.append(cube.groupBy(*dim).agg(*map(F.expr, cells)))
        return frames

    def _within(self, df: DataFrame, table: str, leaves: Mapping[int, Leaf], conditions: Mapping[Context, Column | None], by: Group) -> tuple[DataFrame, dict[Context, Column]]:
        """Rows beside their group's bounds, and the conditions of contexts that have both the member and periods."""
        periods = list(dict.fromkeys(p for leaf in leaves.values() for found in self._reaching(leaf).values() for p in found))
        bounds = self._group_bounds(periods, by).withColumnRenamed("dim", "__dim")
        df = df.join(bounds, self._dimension(table, by).eqNullSafe(F.col("__dim")), "left")
        out = {}
        for leaf in leaves.values():
            parts = [] if conditions[leaf.context] is None else [conditions[leaf.context]]
            for (other, column), found in self._reaching(leaf).items():
                value = F.col(column if other == table else f"{other}__{column}")
                parts += [p.holds(value, F.col(f"b{periods.index(p)}_0"), F.col(f"b{periods.index(p)}_1")) for p in found]
            out[leaf.context] = reduce(Column.__and__, parts)
        return df, out

    def _group_bounds(self, periods: Sequence[Period], by: Group) -> DataFrame:
        """(dim, b0_0, b0_1, ...): least and greatest value that the bounds of each period come from, by group."""
        numbers: dict[Leaf, int] = {}
        for p in periods:
            for end in p.ends:
                numbers.setdefault(end, len(numbers))
        out = _met(self._groups(dict(enumerate(numbers)), by, typed=True))
        return out.select("dim", *[F.col(f"l{numbers[end]}").alias(f"b{i}_{k}") for i, p in enumerate(periods) for k, end in enumerate(p.ends)])

    def _ranged(self, leaves: Mapping[int, Leaf], by: Group, typed: bool) -> list[DataFrame]:
        """Frames (dim, l{i}, ...) of leaves that have lost the member and lie between days that depend on it."""
        apart: dict[tuple, dict[int, Leaf]] = {}
        for i, leaf in leaves.items():
            ((column, periods),) = self._reaching(leaf).items()
            apart.setdefault((self.model.name(leaf.aggregate.table), column, tuple(periods)), {})[i] = leaf
        frames = []
        for (table, (other, column), periods), members in apart.items():
            bounds = self._group_bounds(periods, by)
            first, last = [F.lit(0)], [F.lit(FAR)]
            for k, p in enumerate(periods):
                bounds = bounds.where(F.col(f"b{k}_1").isNotNull())  # no date is left: BLANK
                low, high = p.days(F.col(f"b{k}_0"), F.col(f"b{k}_1"))
                first += [low] if low is not None else []
                last += [high] if high is not None else []
            ranges = bounds.select("dim", F.greatest(F.lit(0), *first).alias("first"), F.least(F.lit(FAR - 1), *last).alias("last"))
            df, conditions = self._base(table, list(members.values()), {(other, column)} - {(table, column)})
            date = F.col(column if other == table else f"{other}__{column}")
            whole = F.when(as_timestamp(date) == F.date_trunc("day", date).cast("timestamp_ntz"), day_number(date)).otherwise(
                F.raise_error(F.lit(f"{other}[{column}] has times of day; periods by group need whole days")).cast("int")
            )
            df = df.where(date.isNotNull()).withColumn("day", whole)
            distinct = {i: leaf for i, leaf in members.items() if leaf.aggregate.kind == "distinct_count"}
            added = {i: leaf for i, leaf in members.items() if i not in distinct}
            if added:
                atoms, of_leaf = _atoms(added, conditions)
                days = df.groupBy("day").agg(*atoms)
                merge = [F.expr(f"{_MERGE[name[0]]}({name}) AS {name}") for name in days.columns if name != "day"]
                nodes = by_node(days).groupBy("level", "node").agg(*merge)
                found = nodes_between(ranges).join(nodes, ["level", "node"]).groupBy("dim").agg(*merge)
                frames.append(found.selectExpr("dim", *[_final(leaf, of_leaf[i], typed) + f" AS l{i}" for i, leaf in added.items()]))
            for i, leaf in distinct.items():
                on = _both(conditions[leaf.context], leaf.aggregate.where)
                kept = df if on is None else df.where(on)
                values = kept.select("day", _column(leaf.aggregate.value).alias("v")).where("v IS NOT NULL").distinct()
                span = values.agg(F.min("day").alias("low"), F.max("day").alias("high"))  # one row
                listed = ranges.crossJoin(F.broadcast(span)).withColumn("first", F.greatest("first", "low")).withColumn("last", F.least("last", "high")).where("first <= last")
                on_days = listed.select("dim", F.explode(F.sequence("first", "last")).alias("day"))
                frames.append(values.join(on_days, "day").groupBy("dim").agg(F.count_distinct("v").alias(f"l{i}")))
        return frames

    def _groups(self, leaves: Mapping[int, Leaf], by: Group, typed: bool = False, filters: Context | None = None) -> list[DataFrame]:
        """Frames (dim, l{i}, ...) and frames of one row for all groups; with ``filters``, one of the members that these leave."""
        kinds: dict[tuple[bool, bool], dict[int, Leaf]] = {}
        for i, leaf in leaves.items():
            kinds.setdefault((any(isinstance(r, Member) for r in leaf.context), bool(self._reaching(leaf))), {})[i] = leaf
        frames = self._frames(kinds.get((True, False), {}), by, typed) + self._frames(kinds.get((True, True), {}), by, typed, dated=True)
        wide = kinds.get((False, False), {})
        if filters is not None and (wide or (False, True) in kinds):
            held = reduce(_side_by_side, frames).select("dim", F.lit(True).alias("__held")) if frames else None
            members = self._member_frame(by, filters)
            frames.append(members if held is None else _side_by_side(members, held))
        return frames + self._ranged(kinds.get((False, True), {}), by, typed) + self._frames(wide, None, typed)

    def _member_frame(self, by: Group, filters: Context) -> DataFrame:
        """``dim``: the members of a group under the filters that reach their table."""
        table = self.model.name(by.table if isinstance(by, Band) else by[0])
        rows = Leaf(M.Aggregate("rows", table), (*filters, *self._member(by)))
        df, conditions = self._base(table, [rows], {pair for pair in self._of_member(rows, by) if pair[0] != table})
        on = conditions[rows.context]
        return (df if on is None else df.where(on)).select(self._dimension(table, by).alias("dim")).where("dim IS NOT NULL").distinct()

    def _flat(self, leaves: Sequence[Leaf], typed: bool = False) -> DataFrame:
        """One row with ``l0``, ``l1`` and so on."""
        frames = self._frames(dict(enumerate(leaves)), None, typed)
        if not frames:
            return next(iter(self.model.tables.values())).sparkSession.range(1).select()
        return _met(frames).select(*[f"l{i}" for i in range(len(leaves))])

    def _dimension(self, table: str, by: Group) -> Column:
        if isinstance(by, Band):
            return _column(by.formula)
        other = self.model.name(by[0])
        column = self.model.column(other, by[1])
        return F.col(column) if other == table else F.col(f"{other}__{column}")

    def values(
        self,
        measures: Mapping[str, M.Node] | Sequence[str],
        filters: Sequence[M.Is] = (),
        by: Group | None = None,
        order: str | Sequence[str] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """One row of measures, or one for each member of ``by`` as column ``dim``.

        ``by`` is (table, column) or a :class:`Band`.  Each group's member is part of the
        context, so a share of a total divides by all groups, and periods run up to each
        group's last day or lie one year before it.  Members without rows of their own are
        there if a measure has a value for them.  Rows without a member are a group of null.

        ``order`` names columns of the result, a minus sign before one for the largest
        first; nulls are the least, and ``dim`` decides ties.  ``limit`` keeps the first
        so many rows of that order.
        """
        wanted = measures if isinstance(measures, Mapping) else {m: M.Reference(m) for m in measures}
        context = tuple(self.restriction(f) for f in filters)
        texts, leaves = self._expanded([(node, (*context, *self._member(by))) for node in wanted.values()])
        named = [f"{text} AS {_name(n)}" for n, text in zip(wanted, texts)]
        if by is None:
            return ordered(self._flat(leaves).selectExpr(*named), [order] if isinstance(order, str) else order, [], limit)
        if not leaves:
            raise Refused("a measure without any aggregate can't be grouped")
        for leaf in leaves:
            self._check(leaf, by)
        joined = _met(self._groups(dict(enumerate(leaves)), by, filters=context))
        if "__held" in joined.columns:  # other members have a row if anything has a value for them
            joined = joined.selectExpr("dim", "__held", *named)
            joined = joined.where(F.col("__held") | F.coalesce(*[F.col(_name(n)).cast("string") for n in wanted]).isNotNull()).drop("__held")
        elif len(joined.columns) > 1 and any(not any(isinstance(r, Member) for r in leaf.context) for leaf in leaves):
            joined = joined.selectExpr("dim", *named).where(F.coalesce(*[F.col(_name(n)).cast("string") for n in wanted]).isNotNull())
        else:
            joined = joined.selectExpr("dim", *named)
        return ordered(joined, [order] if isinstance(order, str) else order, ["dim"], limit)

    def charts(self, wanted: Sequence[tuple[tuple[str, str], Mapping[str, M.Node]]]) -> DataFrame:
        """(set, dim, name, value) of several groupings (table, column), numbered from 0, each with its measures by name; no nulls.

        ``dim`` is text.  All groupings whose measures keep their members are grouping sets
        of one scan of each base table; the others are grouped each on its own.
        """
        frames: list[DataFrame] = []
        kept: dict[int, tuple[tuple[str, str], dict[str, M.Node]]] = {}
        shape = "set int, dim string, name string, value double"
        for k, (by, measures) in enumerate(wanted):
            _, leaves = self._expanded([(node, self._member(by)) for node in measures.values()])
            for leaf in leaves:
                self._check(leaf, by)
            if all(any(isinstance(r, Member) for r in leaf.context) and not self._reaching(leaf) for leaf in leaves):
                kept[k] = by, dict(measures)
            else:
                names = [f"m{i}" for i in range(len(measures))]
                found = self.values(dict(zip(names, measures.values())), by=by)
                cells = ", ".join(f"{_quoted(name)}, CAST({n} AS DOUBLE)" for n, name in zip(names, measures))
                frames.append(found.selectExpr(f"{k} AS set", "CAST(dim AS STRING) AS dim", f"stack({len(names)}, {cells}) AS (name, value)"))
        if kept:
            texts, leaves = self._expanded([(node, (ANY,)) for _, measures in kept.values() for node in measures.values()])
            number = {leaf: i for i, leaf in enumerate(leaves)}
            sets: dict[int, dict[int, Group]] = {}
            listed, at = [], 0
            for k, (by, measures) in kept.items():
                _, own = self._expanded([(node, (ANY,)) for node in measures.values()])
                for leaf in own:
                    sets.setdefault(number[leaf], {})[k] = by
                cells = ", ".join(f"named_struct('name', {_quoted(name)}, 'value', CAST({text} AS DOUBLE))" for name, text in zip(measures, texts[at:]))
                listed.append(f"WHEN {k} THEN array({cells})")
                at += len(measures)
            joined = reduce(lambda a, b: _side_by_side(a, b, ["set", "dim"]), self._frames(dict(enumerate(leaves)), None, False, sets=sets))
            frames.append(joined.selectExpr("set", "dim", f"inline(CASE set {' '.join(listed)} END)"))
        if not frames:
            return next(iter(self.model.tables.values())).sparkSession.createDataFrame([], shape)
        return reduce(DataFrame.unionByName, frames).where("value IS NOT NULL")

    def members(self, table: str, column: str, filters: Sequence[M.Is] = (), limit: int | None = None) -> DataFrame:
        """The different values of a column, without null, in order: ``dim``.  Filters that reach the table hold."""
        by = (self.model.name(table), self.model.column(table, column))
        return ordered(self._member_frame(by, tuple(self.restriction(f) for f in filters)), ["dim"], [], limit)

    def matrix(self, measures: Mapping[str, M.Node] | Sequence[str], scenarios: Mapping[str, Sequence[M.Is]]) -> DataFrame:
        """(scenario, measure, value) for all measures under all scenarios, from one scan of each base table."""
        wanted = measures if isinstance(measures, Mapping) else {m: M.Reference(m) for m in measures}
        contexts = {scenario: tuple(self.restriction(f) for f in filters) for scenario, filters in scenarios.items()}
        names = [(scenario, name) for scenario in contexts for name in wanted]
        texts, leaves = self._expanded([(node, context) for context in contexts.values() for node in wanted.values()])
        cells = self._flat(leaves)
        if not names:
            return cells.select(F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("measure"), F.lit(None).cast("double").alias("value")).limit(0)
        listed = ", ".join(f"{_quoted(scenario)}, {_quoted(name)}, CAST({text} AS DOUBLE)" for (scenario, name), text in zip(names, texts))
        return cells.select(F.expr(f"stack({len(names)}, {listed})").alias("scenario", "measure", "value"))

    def try_values(self, measures: Mapping[str, M.Node], filters: Sequence[M.Is] = ()) -> tuple[DataFrame | None, dict[str, str]]:
        """The measures that can be answered, and why the others are refused."""
        good, refused = self.answerable(measures, filters)
        return (self.values(good, filters) if good else None), refused

    def answerable(self, measures: Mapping[str, M.Node], filters: Sequence[M.Is] = (), by: Group | None = None) -> tuple[dict[str, M.Node], dict[str, str]]:
        """Measures that can be answered in a context, and the reasons why others can't."""
        good, refused = {}, {}
        for name, node in measures.items():
            try:
                _, leaves = self._expanded([(node, (*[self.restriction(f) for f in filters], *self._member(by)))])
                for leaf in leaves:
                    self._check(leaf, by)
                if by is not None and not leaves:
                    raise Refused("a measure without any aggregate can't be grouped")
                good[name] = node
            except Refused as e:
                self._unknown.clear()
                refused[name] = str(e)
        return good, refused


def ordered(df: DataFrame, order: Sequence[str], ties: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows by columns, a minus sign before one for the largest first, then by ``ties``; the first ``limit`` of them."""
    keys = []
    for name in [*order, *(ties if order or limit is not None else ())]:
        bare = name.removeprefix("-")
        if bare not in df.columns:
            raise Refused(f"no column {bare!r} to order by")
        keys.append(F.desc_nulls_last(f"`{bare}`") if name.startswith("-") else F.asc_nulls_first(f"`{bare}`"))
    out = df.orderBy(*keys) if keys else df
    return out if limit is None else out.limit(limit)


#: Contexts of a table up to which each leaf is a conditional aggregate of its own; more are told apart by signatures.
MOST_DIRECT = 4
_BITS = 62
#: How partial aggregates are put together, by the first letter of their names.
_MERGE = {"s": "sum", "n": "sum", "a": "min", "z": "max"}


def masks_of(conditions: Sequence[Column]) -> list[Column]:
    """Bits of the conditions that a row meets, in as many numbers as it takes."""
    out = []
    for at in range(0, len(conditions), _BITS):
        bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions[at : at + _BITS])]
        out.append(reduce(Column.bitwiseOR, bits).cast("bigint"))
    return out


def _has_bit(i: int, names: Sequence[str] | None = None) -> str:
    name = f"__m{i // _BITS}" if names is None else names[i // _BITS]
    return f"({name} & {1 << i % _BITS}L) <> 0"


def bit_of(names: Sequence[str], i: int) -> Column:
    """Whether condition ``i`` is met, false where there are no masks."""
    return F.expr(f"coalesce({_has_bit(i, names)}, false)")


def _atoms(leaves: Mapping[int, Leaf], conditions: Mapping[Context, Column | None] | None) -> tuple[list[Column], dict[int, list[str]]]:
    """Aggregates of rows, named by kind (s: sum, n: count, a: least, z: greatest) and number, and those that each leaf is made of.

    Without ``conditions``, leaves that differ in nothing but their contexts share theirs.
    """
    made: dict[tuple, str] = {}
    atoms, of_leaf = [], {}
    for i, leaf in leaves.items():
        a = leaf.aggregate
        names = []
        for letter in {"sum": "s", "avg": "sn", "count": "n", "rows": "n", "min": "a", "max": "z"}[a.kind]:
            key = (letter, id(a.value) if not isinstance(a.value, str) else a.value, a.kind == "rows", id(a.where), leaf.context if conditions is not None else None)
            if key not in made:
                on = [c for c in (None if conditions is None else conditions[leaf.context], None if a.where is None else _column(a.where)) if c is not None]
                value = F.lit(1) if a.kind == "rows" else _column(a.value)
                value = F.when(reduce(Column.__and__, on), value) if on else value
                made[key] = f"{letter}{len(made)}"
                atoms.append({"s": F.sum, "n": F.count, "a": F.min, "z": F.max}[letter](value).alias(made[key]))
            names.append(made[key])
        of_leaf[i] = names
    return atoms, of_leaf


def _both(on: Column | None, where: M.Formula | None) -> Column | None:
    parts = [c for c in (on, None if where is None else _column(where)) if c is not None]
    return reduce(Column.__and__, parts) if parts else None


def _distinct_counts(df: DataFrame, leaves: Mapping[int, Leaf], conditions: Mapping[Context, Column | None], keys: Sequence[Column], dim: Sequence[str]) -> DataFrame:
    """Distinct counts of one column: a row for each value with the bits of the conditions that any of its rows meets, then rows counted by their bits."""
    wanted: dict[tuple, Column | None] = {}
    place = {}
    for i, leaf in leaves.items():
        key = (leaf.context, id(leaf.aggregate.where))
        if key not in wanted:
            wanted[key] = _both(conditions[leaf.context], leaf.aggregate.where)
        place[i] = list(wanted).index(key)
    masks = masks_of([F.lit(True) if on is None else on for on in wanted.values()])
    names = [f"__m{k}" for k in range(len(masks))]
    value = _column(next(iter(leaves.values())).aggregate.value)
    once = df.groupBy(*keys, value.alias("v")).agg(*[F.bit_or(m).alias(n) for m, n in zip(masks, names)])
    cube = once.groupBy(*dim, *names).agg(F.count("v").alias("n"))
    return cube.groupBy(*dim).agg(*[F.expr(f"coalesce(sum(CASE WHEN {_has_bit(place[i])} THEN n END), 0L) AS l{i}") for i in leaves])


def _final(leaf: Leaf, names: Sequence[str], typed: bool, bit: str | None = None) -> str:
    """A leaf from its atoms: of one row, or of all rows whose signature has the bit."""
    parts = [n if bit is None else f"{_MERGE[n[0]]}(CASE WHEN {bit} THEN {n} END)" for n in names]
    if leaf.aggregate.kind == "avg":
        return f"try_divide(CAST({parts[0]} AS DOUBLE), {parts[1]})"
    if leaf.aggregate.kind == "sum" and not typed:
        return f"CAST({parts[0]} AS DOUBLE)"
    return parts[0] if names[0][0] != "n" or bit is None else f"coalesce({parts[0]}, 0L)"


def _side_by_side(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("dim",)) -> DataFrame:
    """Rows of both by their keys, null being a value of them."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    met = left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]), "full")
    return met.withColumns({k: F.coalesce(k, f"__r_{k}") for k in keys}).drop(*[f"__r_{k}" for k in keys])


def _met(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames with ``dim`` side by side, and those of one row beside every row."""
    keyed, single = [f for f in frames if "dim" in f.columns], [f for f in frames if "dim" not in f.columns]
    out = [reduce(_side_by_side, keyed)] if keyed else []
    return reduce(lambda a, b: a.crossJoin(b), out + single)  # of one row each, but the first


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quoted(text: str) -> str:
    """A text as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(value: M.Formula | str | None) -> Column:
    if value is None:
        raise Refused("this aggregate needs a column")
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else value()


def _moment(value: Any) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
