"""Validation of a report against its source, planned from the measures themselves.

Nothing is asked of a generator: scenarios come from the slicers' members, charts from the
layout, references, consistency rules and formats from the measure trees.  A run answers
all measures under all scenarios in one matrix and all charts by one scan of each base
table, and joins the results with what the report shows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import COUNT_WORDS, MONEY_WORDS
from ..functions.names import VISUAL_KINDS, visual_kind
from ..model import Refused
from ..operators import verdicts
from . import measures as M
from .lower import Evaluator

#: Kinds of visuals that plot data of their own.
DATA_KINDS = tuple(sorted({kind for _, kind in VISUAL_KINDS} - {"kpi", "filter", "decoration"} | {"other"}))
MOST_SCENARIOS, VALUES_PER_SLICER = 10, 1
BASELINE = "all"
RESULT = "item_id string, item_type string, scenario string, measure string, dimension string, status string, match_type string"


# What a measure tree tells.


def _below(node: M.Node) -> Iterator[M.Node]:
    yield node
    parts = {M.Arithmetic: ("left", "right"), M.Divide: ("left", "right"), M.Calculate: ("measure",)}.get(type(node), ())
    for part in parts:
        yield from _below(getattr(node, part))


def measure_references(node: M.Node) -> list[str]:
    """Measures that a measure names, each once, in the order of the formula."""
    return list(dict.fromkeys(n.name for n in _below(node) if isinstance(n, M.Reference)))


def consistency_rules(measures: Mapping[str, M.Node], formats: Mapping[str, str] | None = None) -> list[tuple[str, str, str, str, float]]:
    """Rules (measure, left, op, right, scale) of measures that are one operation on two known ones.

    The scale is 100 where the measure's format shows a percentage, as its value is then
    compared as it is shown.
    """
    known = {name.casefold(): name for name in measures}
    percent = {name.casefold() for name, pattern in (formats or {}).items() if "%" in pattern}
    out = []
    for name, node in measures.items():
        if not isinstance(node, (M.Divide, M.Arithmetic)):
            continue
        if not (isinstance(node.left, M.Reference) and isinstance(node.right, M.Reference)):
            continue
        left, right = known.get(node.left.name.casefold()), known.get(node.right.name.casefold())
        if left and right:
            op = node.op if isinstance(node, M.Arithmetic) else "/"
            out.append((name, left, op, right, 100.0 if name.casefold() in percent else 1.0))
    return out


def intent(node: M.Node) -> tuple[str, str, str] | None:
    """(table, column, aggregate) of a measure that is one aggregate of a plain column, or of rows, and nothing else."""
    if not isinstance(node, M.Aggregate) or node.where is not None or node.related or not (isinstance(node.value, str) or node.kind == "rows"):
        return None
    return node.table, node.value or "", node.kind


def guarded_aggregate(node: M.Node, table: str, column: str, kind: str) -> M.Aggregate:
    """The aggregate that a plan names for a measure; refused unless the measure is exactly that."""
    found = intent(node)
    if found is None or tuple(p.casefold() for p in found) != (table.casefold(), column.casefold(), kind.casefold()):
        raise Refused(f"the measure is not the {kind} of {table}[{column}]")
    return node


def _is_hundred(node: M.Node) -> bool:
    return isinstance(node, M.Constant) and node.value == 100


def infer_format(name: str, node: M.Node | None = None) -> str:
    """A format string for a measure without one, from its name and its tree.

    Ratios whose name says so are percentages, or points where the tree multiplies by
    100 itself; counts are whole; money has a currency sign, and cents in averages.
    """
    text = name.casefold()
    tree = list(_below(node)) if node is not None else []
    says = {kind: any(word in text for word in words) for kind, words in {
        "percent": ("%", "percent", "rate"), "part": ("margin", "ratio", "share"), "count": COUNT_WORDS, "money": MONEY_WORDS,
    }.items()}
    divides = any(isinstance(n, M.Divide) or (isinstance(n, M.Arithmetic) and n.op == "/") for n in tree)
    points = any(isinstance(n, M.Arithmetic) and n.op == "*" and (_is_hundred(n.left) or _is_hundred(n.right)) for n in tree)
    counts = any(isinstance(n, M.Aggregate) and n.kind in ("count", "distinct_count", "rows") for n in tree) and not divides
    choices = (
        (says["percent"] or (divides and says["part"]), '0.0"%"' if points else "0.0%"),
        (counts or says["count"], "#,0"),
        (says["money"], "\\$#,0.00" if text.startswith(("avg", "average")) else "\\$#,0"),
    )
    return next((pattern for holds, pattern in choices if holds), "#,0.00")


# Scenarios and charts.


def representative_scenarios(members: DataFrame, most: int = MOST_SCENARIOS, each: int = VALUES_PER_SLICER) -> DataFrame:
    """scenario_no, table, column, member: the slicers with fewest members first, ``each`` members of each, ``most`` scenarios in all.

    members: table, column, member (see ``catalog.slicer_members``).  Number 1 is the
    scenario without a filter, which isn't listed, so at most ``most`` - 1 rows remain.
    """
    sized = members.withColumn("n", F.count("*").over(Window.partitionBy("table", "column")))
    first = sized.withColumn("place", F.row_number().over(Window.partitionBy("table", "column").orderBy("member"))).where(F.col("place") <= each)
    chosen = first.orderBy("n", "table", "column", "place").limit(max(0, most - 1))
    numbered = chosen.withColumn("scenario_no", F.row_number().over(Window.orderBy("n", "table", "column", "place")) + 1)  # at most ``most`` rows
    return numbered.select("scenario_no", "table", "column", "member")


def scenarios_of(chosen: DataFrame) -> dict[str, tuple[M.Is, ...]]:
    """Scenario name -> filters, from :func:`representative_scenarios`, with the one that has none."""
    rows = chosen.orderBy("scenario_no").collect()  # at most ``most``
    return {BASELINE: ()} | {f"{r['column']}={r['member']}": (M.Is(r["table"], r["column"], r["member"]),) for r in rows}


def _last(field: Column) -> Column:
    return F.trim(F.substring_index(field, ".", -1))


def chart_descriptors(visuals: DataFrame, measures: DataFrame) -> DataFrame:
    """title, visual_type, dimension_field, measure_field, page of the charts of a layout, each once.

    visuals: page, visual, visual_type, fields (``Table.Field`` texts), and title if there
    is one; measures: measure.  The first field that is no measure is the dimension, the
    first measure, or else the next field, the value.  Visuals that plot no data, have no
    dimension, or repeat another's type, dimension and measure are left out.
    """
    shown = visuals if "title" in visuals.columns else visuals.withColumn("title", F.lit(None).cast("string"))
    names = measures.select(F.lower(F.trim("measure")).alias("name")).distinct()
    kept = shown.where(visual_kind(F.col("visual_type")).isin(*DATA_KINDS) & (F.size("fields") > 0))
    refs = kept.select("page", "visual", "title", "visual_type", F.posexplode("fields").alias("place", "field"))
    marked = refs.join(names.withColumn("there", F.lit(True)), F.lower(_last(F.col("field"))) == F.col("name"), "left")
    known = F.coalesce("there", F.lit(False))
    one = marked.groupBy("page", "visual", "title", "visual_type").agg(
        F.min_by(F.when(~known, F.col("field")), F.when(~known, F.col("place"))).alias("dimension_field"),
        F.min_by(F.when(known, F.col("field")), F.when(known, F.col("place"))).alias("named"),
        F.array_sort(F.collect_list(F.struct("place", "field"))).alias("all"),
    )
    following = F.get(F.filter("all", lambda f: f["field"] != F.col("dimension_field")), 0)["field"]
    charts = one.where("dimension_field is not null").withColumn("measure_field", F.coalesce("named", following, F.lit("")))
    same = Window.partitionBy(*[F.lower(c) for c in ("visual_type", "dimension_field", "measure_field")]).orderBy("page", "visual")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat("visual_type", F.lit(" by "), _last(F.col("dimension_field"))))
    first = charts.withColumn("n", F.row_number().over(same)).where("n = 1")
    return first.select(title.alias("title"), "visual_type", "dimension_field", "measure_field", "page")


# Plans and runs.


def plan_items(measures: Mapping[str, M.Node], scenarios: Mapping[str, Sequence[M.Is]], charts: Sequence[tuple[str, tuple[str, str], str | None]] = ()) -> list[tuple]:
    """The plan: (item_id, item_type, scenario, measure, dimension, table, column, aggregate) of every check of a run.

    charts: (title, (table, column), measure or None).  They are checked once, without a
    filter; one without a measure is structural.  table, column and aggregate are given
    where the measure is a single aggregate.
    """
    items = []
    for scenario in scenarios:
        for name, node in measures.items():
            items.append((f"{scenario}/{name}", "scalar", scenario, name, None, *(intent(node) or (None, None, None))))
    for title, (table, column), name in charts:
        aim = intent(measures[name]) if name is not None and name in measures else None
        items.append((title, "structural" if name is None else "grouped", BASELINE, name, f"{table}[{column}]", *(aim or (None, None, None))))
    return items


def validation_run(
    evaluator: Evaluator,
    measures: Mapping[str, M.Node] | Sequence[str],
    scenarios: Mapping[str, Sequence[M.Is]],
    shown: DataFrame,
    charts: Sequence[tuple[str, tuple[str, str], str | None]] = (),
    points: DataFrame | None = None,
    formats: Mapping[str, str] | None = None,
    tolerance: float = 1.0,
) -> DataFrame:
    """Verdicts of a whole plan: item_id, item_type, scenario, measure, dimension, status, match_type.

    shown: scenario, measure, dashboard_value, as far as a report shows them; a value
    that isn't shown passes if the source gives a number.  points: item_id (a chart's
    title, which is one chart's), dimension, raw_value.  A chart without points passes if
    the source gives it a row.  Measures that are refused fail as ``error``; consistency rules of the
    measures are checked under every scenario.
    """
    wanted = dict(measures) if isinstance(measures, Mapping) else {m: evaluator.named[m] for m in measures}
    spark = shown.sparkSession
    nodes = {name: M.Reference(name) if evaluator.named.get(name) is node else node for name, node in wanted.items()}
    good, refused = evaluator.answerable(nodes)
    # As many cells as the plan has scalar items: they are worked out once, for the verdicts and the rules alike.
    cells = spark.createDataFrame(evaluator.matrix(good, scenarios).collect() if good else [], "scenario string, measure string, value double")
    frames = [_scalar_rows(spark, cells, wanted, refused, scenarios, shown, tolerance)]
    rules = [r for r in consistency_rules(wanted, formats) if {r[0], r[1], r[3]} <= good.keys()]
    if rules:
        checked = verdicts.consistency_verdicts(cells, [(*r[:4], 1.0) for r in rules], tolerance)
        frames.append(checked.select(
            F.concat_ws("/", "scenario", "measure").alias("item_id"), F.lit("consistency").alias("item_type"), "scenario", "measure",
            F.lit(None).cast("string").alias("dimension"), "status", F.lit("dax-consistency").alias("match_type"),
        ))
    frames += _chart_rows(evaluator, nodes, charts, points, spark, tolerance)
    return reduce(DataFrame.unionByName, frames)


def _scalar_rows(spark, cells, wanted, refused, scenarios, shown, tolerance) -> DataFrame:
    plan = spark.createDataFrame([(f"{s}/{m}", s, m, refused.get(m)) for s in scenarios for m in wanted], "item_id string, scenario string, measure string, error string")
    # One row for each item of the plan: what is shown and what was found beside it.
    met = plan.join(shown.select("scenario", "measure", "dashboard_value"), ["scenario", "measure"], "left").join(cells, ["scenario", "measure"], "left")
    value = F.when(F.col("value").isNotNull(), F.format_string("%.10g", "value"))
    return verdicts.judged_scalars(met.withColumn("value", value).withColumn("there", F.lit(True)), tolerance).select(
        "item_id", F.lit("scalar").alias("item_type"), "scenario", "measure", F.lit(None).cast("string").alias("dimension"), "status", "match_type"
    )


def _chart_rows(evaluator, nodes, charts, points, spark, tolerance) -> list[DataFrame]:
    """Verdicts of all charts: grouped ones from one scan of each base table, whatever their dimensions."""
    by_dimension: dict[tuple[str, str], list[tuple[str, str | None]]] = {}
    for title, dimension, measure in charts:
        by_dimension.setdefault(tuple(dimension), []).append((title, measure))
    shown = points if points is not None else spark.createDataFrame([], "item_id string, dimension string, raw_value string")
    failed, grouped, held, frames = [], [], [], []
    sets: list[tuple[tuple[str, str], dict[str, M.Node]]] = []
    for dimension, members in by_dimension.items():
        named = {m: nodes.get(m, M.Reference(m)) for _, m in members if m is not None}
        good, refused = evaluator.answerable(named, by=dimension)
        failed += [(t, "grouped", BASELINE, m, None, "FAIL", "error") for t, m in members if m in refused]
        mine = [(t, m) for t, m in members if m in good]
        if mine:
            sets.append((dimension, {t: good[m] for t, m in mine}))
            grouped += mine
        structural = [t for t, m in members if m is None]
        if structural:
            held.append((structural, evaluator.members(*dimension).select(F.explode(F.array(*map(F.lit, structural))).alias("item_id"), F.col("dim").cast("string").alias("dimension"))))
    if failed:
        frames.append(spark.createDataFrame(failed, RESULT))
    if grouped:
        actual = evaluator.charts(sets).select(F.col("name").alias("item_id"), F.col("dim").alias("dimension"), F.format_string("%.10g", "value").alias("value"))
        frames.append(_grouped_rows(spark, grouped, actual, shown, tolerance))
    if held:
        wanted = shown.where(F.col("item_id").isin(*[t for titles, _ in held for t in titles])).select("item_id", "dimension")
        judged = verdicts.structural_verdicts(wanted, reduce(DataFrame.unionByName, [h for _, h in held]))
        frames.append(judged.select(
            "item_id", F.lit("structural").alias("item_type"), F.lit(BASELINE).alias("scenario"), F.lit(None).cast("string").alias("measure"),
            F.lit(None).cast("string").alias("dimension"), "status", F.when(F.col("status") == "PASS", "chart-category").otherwise("chart-invalid").alias("match_type"),
        ))
    return frames


def _grouped_rows(spark, grouped, actual, shown, tolerance) -> DataFrame:
    """Verdicts by category for charts that show points, and one verdict for each chart that shows none."""
    titles = spark.createDataFrame(grouped, "item_id string, measure string")
    judged = verdicts.judged_charts(titles.select("item_id"), shown.select("item_id", "dimension", "raw_value"), actual, tolerance)
    return judged.join(F.broadcast(titles), "item_id").select(  # as many rows as the plan has charts
        "item_id", F.lit("grouped").alias("item_type"), F.lit(BASELINE).alias("scenario"), "measure", "dimension", "status", "match_type"
    )
