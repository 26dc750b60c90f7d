"""Matching a model's tables and columns to a source's, and inferring joins, over metadata frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column_concepts, column_words, normal_column, normal_table
from ..scratch import Scratch
from .similar import FUZZY, FUZZY_TOP, REVIEW, TIERS, name_matches, ratio

# Endings of key columns.
KEY_ENDINGS = ("key", "id", "no", "code")
LEAST_ENDING, MOST_JOINS = 4, 60


def _key_like(column):
    return F.lower(F.trim(column)).rlike(f"({'|'.join(KEY_ENDINGS)})$")


def infer_joins(columns: DataFrame, foreign_keys: DataFrame | None = None, most: int = MOST_JOINS) -> DataFrame:
    """from_table, from_column, to_table, to_column, inferred: declared keys first, then by name.

    columns: table, column, position, is_primary_key, table_position.  Targets are
    primary keys, or key-like columns of tables without any.  A key-like column joins
    the first target of another table that has its name, or whose name of four
    letters or more it ends with.  Of a pair and its reverse the first stays.
    """
    c = columns.withColumn("has_key", F.max(F.col("is_primary_key").cast("int")).over(Window.partitionBy("table")) == 1)
    targets = c.where((F.col("has_key") & F.col("is_primary_key")) | (~F.col("has_key") & _key_like(F.col("column")))).select(
        F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("table_position").alias("tt"), F.col("position").alias("tp")
    )
    ends = F.transform(F.sequence(F.lit(1), F.length("a") - F.lit(LEAST_ENDING) + 1), lambda i: F.substr("a", i))
    sources = c.where(_key_like(F.col("column"))).select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.col("table_position").alias("ft"), F.col("position").alias("fp"))
    # The whole name, and each of its ends that is long enough: an equi-join finds all targets.
    asked = sources.withColumn("a", F.lower("from_column")).withColumn("end", F.explode(F.array_distinct(F.concat(F.array("a"), F.when(F.length("a") >= LEAST_ENDING, ends).otherwise(F.array())))))
    first = Window.partitionBy("from_table", "from_column").orderBy("tt", "tp")
    met = asked.join(targets, (F.col("end") == F.lower("to_column")) & (F.lower("from_table") != F.lower("to_table")))
    found = met.withColumn("n", F.row_number().over(first)).where("n = 1")
    hints = found.select("from_table", "from_column", "to_table", "to_column", F.lit(True).alias("inferred"), F.struct(F.lit(1).alias("r"), "ft", "fp").alias("at"))
    if foreign_keys is not None:
        declared = foreign_keys.select("from_table", "from_column", "to_table", "to_column", F.lit(False).alias("inferred"), F.struct(F.lit(0).alias("r"), F.lit(0).alias("ft"), F.lit(0).alias("fp")).alias("at"))
        hints = declared.unionByName(hints)
    ends = F.array_sort(F.array(F.concat_ws("|", F.lower("from_table"), F.lower("from_column")), F.concat_ws("|", F.lower("to_table"), F.lower("to_column"))))
    once = Window.partitionBy(ends).orderBy("at", "from_table", "from_column")
    kept = hints.withColumn("n", F.row_number().over(once)).where("n = 1")
    return kept.orderBy("at", "from_table", "from_column").limit(most).drop("n", "at")


def match_tables(model_columns: DataFrame, source_columns: DataFrame) -> DataFrame:
    """table, source_table, shared, candidates: the source table of the same normal name that shares most columns.

    Both frames: table, column.  Ties go to the shorter name, then to the first by name.
    """
    m = model_columns.select("table", normal_table(F.col("table")).alias("key"), normal_column(F.col("column")).alias("c")).distinct()
    s = source_columns.select(F.col("table").alias("source_table"), normal_table(F.col("table")).alias("key"), normal_column(F.col("column")).alias("sc")).distinct()
    pairs = m.join(s, "key").groupBy("table", "source_table").agg(F.count_distinct(F.when(F.col("c") == F.col("sc"), F.col("c"))).alias("shared"))
    best = Window.partitionBy("table").orderBy(F.desc("shared"), F.length("source_table"), "source_table")
    ranked = pairs.withColumns({"n": F.row_number().over(best), "candidates": F.count("*").over(Window.partitionBy("table"))})
    return ranked.where("n = 1").select("table", "source_table", "shared", "candidates")


def best_datasets(scores: DataFrame) -> DataFrame:
    """table, dataset, covered, confidence: for each model table the dataset with most columns matched, then the surest.

    scores: table, dataset, column, confidence (null where unmatched).
    """
    summed = scores.groupBy("table", "dataset").agg(F.count("confidence").alias("covered"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence"))
    best = Window.partitionBy("table").orderBy(F.desc("covered"), F.desc("confidence"), "dataset")
    return summed.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def compare_columns(model_columns: DataFrame, source_columns: DataFrame) -> DataFrame:
    """table, shared, missing (sorted model columns that the source table of that name lacks).  Both frames: table, column."""
    m = model_columns.select("table", "column", normal_table(F.col("table")).alias("t"), normal_column(F.col("column")).alias("c"))
    s = source_columns.select(normal_table(F.col("table")).alias("t"), normal_column(F.col("column")).alias("c")).distinct().withColumn("there", F.lit(True))
    joined = m.join(s, ["t", "c"], "left")
    return joined.groupBy("table").agg(
        F.count("there").alias("shared"), F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("column")))).alias("missing")
    )


def relevant_tables(names: DataFrame, hints: DataFrame) -> DataFrame:
    """Wanted tables and their direct join partners.  names: table; hints: from_table, to_table."""
    wanted = names.select(normal_table(F.col("table")).alias("k")).distinct()
    ends = hints.select("from_table", "to_table").union(hints.select("to_table", "from_table")).toDF("table", "other")
    partners = ends.join(wanted, normal_table(F.col("table")) == F.col("k"), "left_semi").select(F.col("other").alias("table"))
    return names.select("table").union(partners).distinct()


def similarities(model_columns: DataFrame, source_columns: DataFrame) -> DataFrame:
    """table, column, source_column, confidence, method for every two columns of a model table and of its source table.

    Both frames: table, column, with one name for both tables of a pair.  The first tier
    of ``TIERS`` that holds decides; what no tier settles is compared letter by letter,
    ``fuzzy`` where the ratio is high and ``unresolved`` elsewhere.  This lists what is
    far apart too, for a person to look at; :func:`matched_columns` finds the matches alone.
    """

    def forms(df: DataFrame, name: str) -> DataFrame:
        text = F.coalesce(F.col("column"), F.lit(""))
        out = df.select("table", text.alias(name)).distinct()
        out = out.withColumns({f"{name}_bare": normal_column(F.col(name)), f"{name}_words": column_words(F.col(name))})
        return out.withColumns({f"{name}_sorted": F.array_sort(f"{name}_words"), f"{name}_concepts": F.array_distinct(column_concepts(F.col(f"{name}_words")))})

    pairs = forms(model_columns, "m").join(forms(source_columns, "s"), "table")
    m, s = F.col("m"), F.col("s")
    both = (F.size("m_words") > 0) & (F.size("s_words") > 0)
    holds: dict[str, Column] = {
        "exact": m == s, "case": F.lower(m) == F.lower(s), "normalised": (F.col("m_bare") != "") & (F.col("m_bare") == F.col("s_bare")),
        "tokens": both & (F.col("m_words") == F.col("s_words")), "tokens-reordered": both & (F.col("m_sorted") == F.col("s_sorted")),
        "synonym": both & (F.size("m_words") == F.size("s_words")) & (F.size(F.array_except("m_concepts", "s_concepts")) == 0),
    }
    tier = F.coalesce(*[F.when((m != "") & (s != "") & holds[name], F.struct(F.lit(sure).alias("confidence"), F.lit(name).alias("method"))) for name, sure in TIERS])
    judged = pairs.withColumn("tier", tier)
    settled = judged.where("tier is not null").select("table", "m", "s", "tier.confidence", "tier.method")

    r = F.when((m != "") & (s != ""), F.col("r")).otherwise(0.0)
    rest = judged.where("tier is null").withColumn("r", ratio("m_bare", "s_bare"))
    rest = rest.select(
        "table", "m", "s", F.round(F.when(r >= FUZZY, F.least(r, F.lit(FUZZY_TOP))).otherwise(r), 3).alias("confidence"), F.when(r >= FUZZY, "fuzzy").otherwise("unresolved").alias("method")
    )
    return settled.union(rest).withColumnsRenamed({"m": "column", "s": "source_column"})


def matched_columns(model_columns: DataFrame, source_columns: DataFrame) -> DataFrame:
    """The pairs of :func:`similarities` that count as matches, found through indexes: the different names of all tables are compared once."""
    known = name_matches(*[df.select(F.col("column").alias("name")) for df in (model_columns, source_columns)])
    # Names may be longer than Spark takes them to be: hints keep them from the driver.
    left = model_columns.select("table", "column").distinct().join(known.hint("merge"), "column")
    right = source_columns.select("table", F.col("column").alias("source_column")).distinct()
    return left.join(right.hint("merge"), ["table", "source_column"]).select("table", "column", "source_column", "confidence", "method")


def recognised(pairs: DataFrame) -> DataFrame:
    """Pairs of :func:`similarities` that count as matches."""
    return pairs.where((F.col("method") != "unresolved") & (F.col("confidence") >= REVIEW))


def assign_columns(pairs: DataFrame) -> DataFrame:
    """table, column, source_column, confidence, method: within each table the strongest pairs first, no column twice.

    pairs: as :func:`similarities` or :func:`matched_columns` gives them.  Ties go to the first column, then source
    column, by name.  In each round every pair that is the first of both its columns is
    taken, and pairs with a column of these go; as pairs are in one order, that gives what
    taking them one by one gives.  Repeated pairs count once; a null column matches nothing.
    """
    names = ("table", "column", "source_column", "confidence", "method")
    scratch = Scratch(pairs.sparkSession, "assigned")
    left = scratch.table(recognised(pairs).select(*names).where("column IS NOT NULL AND source_column IS NOT NULL").distinct(), "pairs")
    taken = []
    while left.limit(1).count():
        order = [F.desc("confidence"), "column", "source_column", "method"]
        ranks = {x: F.row_number().over(Window.partitionBy("table", x).orderBy(*order)) for x in ("column", "source_column")}
        ranked = left.withColumns({"own": ranks["column"], "other": ranks["source_column"]})
        first = scratch.table(ranked.where("own = 1 AND other = 1").select(*names), "taken")
        taken.append(first)
        rest = left.join(first.select("table", "column"), ["table", "column"], "left_anti").join(first.select("table", "source_column"), ["table", "source_column"], "left_anti")
        following = scratch.table(rest.select(*names), "pairs")
        scratch.drop(left)
        left = following
    scratch.keep_only(*(taken or [left]))
    return reduce(DataFrame.unionByName, taken) if taken else left


def dataset_scores(model_columns: DataFrame, source_columns: DataFrame) -> DataFrame:
    """table, dataset, column, confidence of every model column that a dataset holds: what :func:`best_datasets` takes.

    model_columns: table, column; source_columns: dataset, column.  A table and a dataset
    that share nothing have no row.
    """
    known = name_matches(*[df.select(F.col("column").alias("name")) for df in (model_columns, source_columns)])
    met = model_columns.select("table", "column").distinct().join(known, "column").join(source_columns.select("dataset", F.col("column").alias("source_column")), "source_column")
    return met.groupBy("table", "dataset", "column").agg(F.max("confidence").alias("confidence"))


def join_keys(wanted: DataFrame, hints: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """from_table, to_table, from_column, to_column of each wanted pair (from_table, to_table).

    A hint in either direction comes first, then a key that the left table declares, then
    one of the right table; of several the first by column names.  Pairs without any are absent.
    hints, foreign_keys: from_table, from_column, to_table, to_column.
    """
    names = ("from_table", "to_table", "from_column", "to_column")

    def ways(df: DataFrame, forth: int, back: int) -> DataFrame:
        turned = df.select(F.col("to_table").alias("from_table"), F.col("from_table").alias("to_table"), F.col("to_column").alias("from_column"), F.col("from_column").alias("to_column"))
        return df.select(*names, F.lit(forth).alias("rank")).union(turned.select(*names, F.lit(back).alias("rank")))

    every = ways(hints, 0, 0).union(ways(foreign_keys, 1, 2))
    first = Window.partitionBy("from_table", "to_table").orderBy("rank", "from_column", "to_column")
    met = wanted.select("from_table", "to_table").distinct().join(every, ["from_table", "to_table"])
    return met.withColumn("n", F.row_number().over(first)).where("n = 1").select(*names)


def assemble_schema(tables: DataFrame, columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """table, kind, primary_keys, columns, foreign_keys of a database, from its four catalogue listings.

    tables: schema, name, type; columns: schema, name, column, data_type, nullable,
    position; primary_keys: schema, name, column; foreign_keys: constraint, schema, name,
    column, ref_schema, ref_name, ref_column.  Columns of what isn't listed are left out.
    """

    def key(schema: str, name: str) -> Column:
        return F.concat_ws(".", schema, name)

    keys = primary_keys.select(key("schema", "name").alias("table"), "column").distinct()
    flagged = columns.select(key("schema", "name").alias("table"), "column", "data_type", "nullable", "position").join(keys.withColumn("pk", F.lit(True)), ["table", "column"], "left")
    held = flagged.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "data_type", (F.upper(F.col("nullable").cast("string")).isin("YES", "TRUE")).alias("nullable"), F.coalesce("pk", F.lit(False)).alias("is_primary_key")))).alias("columns")
    )
    links = foreign_keys.groupBy(key("schema", "name").alias("table")).agg(
        F.array_sort(F.collect_list(F.struct("constraint", "column", key("ref_schema", "ref_name").alias("ref_table"), "ref_column"))).alias("foreign_keys")
    )
    named = keys.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("primary_keys"))
    kind = F.when(F.upper("type") == "VIEW", "view").otherwise("table").alias("kind")
    out = tables.select(key("schema", "name").alias("table"), kind).join(held, "table").join(named, "table", "left").join(links, "table", "left")
    empty = F.array().cast("array<string>")
    return out.select("table", "kind", F.coalesce("primary_keys", empty).alias("primary_keys"), "columns", F.coalesce("foreign_keys", F.filter("foreign_keys", lambda _: F.lit(False)), F.from_json(F.lit("[]"), out.schema["foreign_keys"].dataType)).alias("foreign_keys"))
