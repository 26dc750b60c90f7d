"""Whether names resolve: measures, formulas, relationships, bindings and datasets against a model's metadata.

Each check gives entity, status (PASS, FAIL or BLOCKED, where nothing can be decided),
reason and actual; references are anti-joined with what exists, whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import best_datasets, dataset_scores

#: A column or measure in a formula: an optional table, quoted or bare, and a name in brackets.
_REFERENCE = r"(?:'[^']+'|[A-Za-z_][A-Za-z0-9_]*)?\s*\[[^\]]+\]"
_WRAPPED = r"^\s*\w+\s*\(\s*(.+?)\s*\)\s*$"
LISTED = 4


def _fold(column: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))))


def _result(entity: Column, status: Column, reason: Column, actual: Column) -> list[Column]:
    return [entity.alias("entity"), status.alias("status"), reason.alias("reason"), F.coalesce(actual.cast("string"), F.lit("")).alias("actual")]


def _first(items: str) -> Column:
    return F.array_join(F.slice(F.array_distinct(items), 1, LISTED), ", ")


def check_measures(measures: DataFrame, values: DataFrame) -> DataFrame:
    """Whether each measure gave a value.  measures: measure, formula; values: measure, value."""
    known = values.select(_fold("measure").alias("key"), F.col("value").cast("string").alias("value")).groupBy("key").agg(F.first("value", ignorenulls=True).alias("value"))
    joined = measures.join(known, _fold("measure") == F.col("key"), "left")
    has, empty = F.coalesce("value", F.lit("")) != "", F.trim(F.coalesce("formula", F.lit(""))) == ""
    status = F.when(has, "PASS").when(empty, "FAIL").otherwise("BLOCKED")
    reason = F.when(has, "gave a value").when(empty, "has no formula").otherwise("can't be answered here")
    return joined.select(*_result(F.col("measure"), status, reason, F.col("value")))


def formula_references(measures: DataFrame) -> DataFrame:
    """measure, place, table (empty for a bare name), field: what each formula names, in order.  measures: measure, formula."""
    flat = F.regexp_replace(F.coalesce("formula", F.lit("")), r'"[^"]*"', '""')
    found = measures.select("measure", F.posexplode(F.regexp_extract_all(flat, F.lit(_REFERENCE), F.lit(0))).alias("place", "text"))
    table = F.regexp_replace(F.trim(F.substring_index("text", "[", 1)), "^'|'$", "")
    return found.select("measure", "place", table.alias("table"), F.trim(F.regexp_extract("text", r"\[([^\]]+)\]", 1)).alias("field"))


def check_formulas(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """Whether every table, column and measure that a formula names exists.  columns: table, column."""
    names = measures.select(_fold("measure").alias("name")).distinct().withColumn("is_measure", F.lit(True))
    held = columns.select(_fold("table").alias("t"), _fold("column").alias("c")).distinct().withColumn("is_column", F.lit(True))
    tables = columns.select(_fold("table").alias("t1")).distinct().withColumn("is_table", F.lit(True))
    refs = formula_references(measures).withColumns({"rt": _fold("table"), "rf": _fold("field")})
    seen = (
        refs.join(names, F.col("rf") == F.col("name"), "left").join(tables, F.col("rt") == F.col("t1"), "left")
        .join(held, (F.col("rt") == F.col("t")) & (F.col("rf") == F.col("c")), "left")
    )
    bare, whole = F.col("table") == "", F.format_string("%s[%s]", "table", "field")
    lost = (
        F.when(bare & F.col("is_measure").isNull(), F.format_string("[%s]", "field"))
        .when(~bare & F.col("is_table").isNull(), F.format_string("table '%s'", "table"))
        .when(~bare & F.col("is_column").isNull() & F.col("is_measure").isNull(), whole)
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", lost.alias("lost")))), lambda r: r["lost"])
    bad = seen.groupBy(F.col("measure").alias("of")).agg(F.array_compact(listed).alias("lost"))
    any_column = columns.limit(1).agg((F.count("*") > 0).alias("some"))
    joined = measures.join(bad, F.col("measure") == F.col("of"), "left").join(F.broadcast(any_column))
    empty, fails = F.trim(F.coalesce("formula", F.lit(""))) == "", F.coalesce(F.size("lost"), F.lit(0)) > 0
    status = F.when(empty, "FAIL").when(~F.col("some"), "BLOCKED").when(fails, "FAIL").otherwise("PASS")
    reason = F.when(empty, "has no formula").when(~F.col("some"), "the model lists no columns").when(fails, F.concat(F.lit("not in the model: "), _first("lost"))).otherwise("all names exist")
    return joined.select(*_result(F.col("measure"), status, reason, F.substring(F.regexp_replace(F.trim("formula"), r"\s+", " "), 1, 90)))


def check_relationships(relationships: DataFrame, columns: DataFrame) -> DataFrame:
    """Whether both ends of each relationship exist.  relationships: from_table, from_column, to_table, to_column, active."""
    held = columns.select(_fold("table").alias("t"), _fold("column").alias("c")).distinct()
    tables = held.select("t").distinct()
    out = relationships.withColumn("entity", F.format_string("%s[%s] -> %s[%s]", "from_table", "from_column", "to_table", "to_column"))
    for side in ("from", "to"):
        table, column = F.col(f"{side}_table"), F.col(f"{side}_column")
        ends = held.toDF("t", "c").withColumn("there", F.lit(True))
        out = out.join(tables.withColumn("known", F.lit(True)), _fold(table) == F.col("t"), "left").drop("t")
        out = out.join(ends, (_fold(table) == F.col("t")) & (_fold(column) == F.col("c")), "left").drop("t", "c")
        problem = F.when(F.col("known").isNull(), F.format_string(f"{side} table '%s' does not exist", table)).when(
            F.col("there").isNull(), F.format_string(f"{side} column '%s[%s]' does not exist", table, column)
        )
        out = out.withColumn(side, problem).drop("known", "there")
    problems = F.array_compact(F.array("from", "to"))
    fine = F.when(F.coalesce("active", F.lit(True)), "both ends exist").otherwise("both ends exist; inactive")
    return out.select(*_result(F.col("entity"), F.when(F.size(problems) > 0, "FAIL").otherwise("PASS"), F.when(F.size(problems) > 0, F.array_join(problems, "; ")).otherwise(fine), F.col("entity")))


def check_bindings(visuals: DataFrame, columns: DataFrame, measures: DataFrame) -> DataFrame:
    """Whether every field that a visual shows exists.  visuals: page, visual, fields; measures: measure.

    A field is ``Table.Field``, perhaps inside aggregates, perhaps with a date level after
    it, ``Table[Field]``, or a bare name.
    """
    bare = F.trim("field")
    for _ in range(3):  # aggregates inside one another
        bare = F.when(bare.rlike(_WRAPPED), F.regexp_extract(bare, _WRAPPED, 1)).otherwise(bare)
    parts = visuals.select("page", "visual", F.posexplode_outer("fields").alias("place", "field")).withColumn("bare", bare)
    bracket, point = F.col("bare").rlike(r"^[^\[]*\[[^\]]+\]$"), F.col("bare").contains(".")
    table = F.when(bracket, F.regexp_replace(F.trim(F.substring_index("bare", "[", 1)), "^'|'$", "")).when(point, F.substring_index("bare", ".", 1)).otherwise("")
    name = F.when(bracket, F.regexp_extract("bare", r"\[([^\]]+)\]", 1)).when(point, F.element_at(F.split("bare", "[.]"), 2)).otherwise(F.col("bare"))
    asked = parts.withColumns({"t": _fold(table), "n": _fold(name)})
    known = columns.select(_fold("column").alias("known")).union(measures.select(_fold("measure"))).distinct().withColumn("there", F.lit(True))
    seen = asked.join(known, F.col("n") == F.col("known"), "left")
    real = F.trim(F.coalesce("field", F.lit(""))) != ""
    fields = F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("place", "field", F.coalesce("there", F.lit(False)).alias("there"))))), lambda f: f)
    one = seen.groupBy("page", "visual").agg(fields.alias("f"))
    shown = F.array_join(F.slice(F.transform("f", lambda f: f["field"]), 1, 5), ", ")
    lost = F.transform(F.filter("f", lambda f: ~f["there"]), lambda f: f["field"])
    any_name = known.limit(1).agg((F.count("*") > 0).alias("some"))
    joined = one.join(F.broadcast(any_name)).withColumn("lost", lost)
    none = F.size("f") == 0
    status = F.when(none, "NOT EXECUTED").when(~F.col("some"), "BLOCKED").when(F.size("lost") > 0, "FAIL").otherwise("PASS")
    reason = F.when(none, "no field is known").when(~F.col("some"), "the model lists no names").when(F.size("lost") > 0, F.concat(F.lit("not in the model: "), _first("lost"))).otherwise("all fields exist")
    return joined.select(*_result(F.concat_ws("/", "page", "visual"), status, reason, shown))


def check_datasets(tables: DataFrame, columns: DataFrame, source_columns: DataFrame | None) -> DataFrame:
    """Whether each table has columns and a dataset that holds some of them.  tables: table, calculated; source_columns: dataset, column."""
    counted = columns.groupBy(F.col("table").alias("of")).agg(F.count("*").alias("n"))
    out = tables.join(counted, F.col("table") == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if source_columns is None:
        out = out.withColumns({"dataset": F.lit(None).cast("string"), "covered": F.lit(0)})
    else:
        best = best_datasets(dataset_scores(columns.select("table", "column"), source_columns)).select(F.col("table").alias("t"), "dataset", "covered").where("covered > 0")
        out = out.join(best, F.col("table") == F.col("t"), "left")
    calculated, found = F.coalesce("calculated", F.lit(False)), F.col("dataset").isNotNull()
    read = F.lit(source_columns is not None)
    status = F.when(F.col("n") == 0, "FAIL").when(~read, "BLOCKED").when(calculated | found, "PASS").otherwise("BLOCKED")
    reason = (
        F.when(F.col("n") == 0, "has no columns").when(~read, "no source was read").when(calculated, "calculated, so no source holds it")
        .when(found, F.format_string("%s holds %d of %d columns", "dataset", "covered", "n")).otherwise("no dataset shares its columns")
    )
    return out.select(*_result(F.col("table"), status, reason, F.format_string("%d columns", "n")))
