"""Datasets by name: CSV files and folders, Parquet folders, workbooks, databases over JDBC."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol
from xml.etree import ElementTree

import pyarrow as pa
from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normal_column, normal_table
from ..operators.matching import assemble_schema

_log = logging.getLogger(__name__)


class SourceError(ValueError):
    """A source that can't be read, or that holds nothing."""


class Source(Protocol):
    """What any source answers, files and databases alike."""

    def reachable(self) -> bool: ...

    def names(self) -> list[str]: ...

    def query(self, sql: str) -> DataFrame: ...

    def preview(self, name: str, rows: int = 50) -> DataFrame: ...

    def columns(self) -> DataFrame: ...

    def row_count(self, name: str) -> DataFrame: ...


@dataclass
class Catalog:
    """Named datasets and what can be asked of each without reading more than it takes."""

    datasets: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        for key, df in self.datasets.items():
            if key.casefold() == name.casefold():
                return df
        raise SourceError(f"no dataset {name!r}")

    def names(self) -> list[str]:
        return sorted(self.datasets)

    def preview(self, name: str, rows: int = 50) -> DataFrame:
        return as_text(self[name].limit(max(1, rows)))

    def row_counts(self) -> DataFrame:
        """dataset, rows, columns in one job; the counts come from file metadata where the format has them."""
        if not self.datasets:
            raise SourceError("the catalog is empty")
        frames = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")) for n, df in self.datasets.items()]
        return reduce(DataFrame.unionByName, frames)

    def row_count(self, name: str) -> DataFrame:
        return Catalog({name: self[name]}).row_counts()

    def columns(self) -> DataFrame:
        """table, table_position, column, position, data_type, nullable for all datasets."""
        rows = [
            (n, i, f.name, j, f.dataType.simpleString(), f.nullable)
            for i, n in enumerate(self.names())
            for j, f in enumerate(self.datasets[n].schema)
        ]
        return self._spark().createDataFrame(rows, "table string, table_position int, column string, position int, data_type string, nullable boolean")

    def _spark(self) -> SparkSession:
        if not self.datasets:
            raise SourceError("the catalog is empty")
        return next(iter(self.datasets.values())).sparkSession

    def reachable(self) -> bool:
        """Whether every dataset can be read."""
        return not self.unreadable()

    def unreadable(self) -> dict[str, str]:
        """Datasets that can't be read, with the reason; each is tried alone, by its first row."""
        bad = {}
        for name, df in self.datasets.items():
            try:
                df.limit(1).count()
            except (PySparkException, Py4JJavaError) as e:
                bad[name] = str(e).split("\n", 1)[0]
        return bad

    def compare_rows(self, other: Catalog) -> DataFrame:
        """dataset, rows, other_rows, equal for datasets whose normal names meet."""
        a, b = (c.row_counts().select("dataset", normal_table(F.col("dataset")).alias("key"), "rows") for c in (self, other))
        b = b.groupBy("key").agg(F.max("rows").alias("other_rows"))
        return a.join(b, "key", "left").select("dataset", "rows", "other_rows", F.coalesce(F.col("rows") == F.col("other_rows"), F.lit(False)).alias("equal"))

    def compare(self, other: Catalog) -> DataFrame:
        """dataset, check, passed, expected, actual: whether ``other`` has each dataset, its columns and as many rows.

        Datasets that can't be read, here or there, fail as ``readable`` and take no other
        with them.  Columns and rows are compared where the dataset exists.
        """
        here, there = (dict.fromkeys(c.unreadable()) for c in (self, other))
        mine, theirs = (Catalog({n: df for n, df in c.datasets.items() if n not in bad}) for c, bad in ((self, here), (other, there)))
        spark = self._spark()
        schema = "dataset string, check string, passed boolean, expected string, actual string"
        frames = [spark.createDataFrame([(n, "readable", False, "", "") for n in [*here, *there]], schema)]
        if mine.datasets and theirs.datasets:
            names = [c.columns().select("table", normal_table(F.col("table")).alias("key"), normal_column(F.col("column")).alias("c"), "column") for c in (mine, theirs)]
            held = names[1].select("key", F.lit(True).alias("there")).distinct()
            one = names[0].select("table", "key").distinct().join(held, "key", "left")
            frames.append(one.select(F.col("table").alias("dataset"), F.lit("exists"), F.col("there").isNotNull(), F.col("table"), F.when(F.col("there"), F.col("table")).otherwise("")))
            met = names[0].join(held, "key").join(names[1].select("key", "c", F.lit(True).alias("same")).distinct(), ["key", "c"], "left")
            lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("same").isNull(), F.col("column")))), ", ")
            aligned = met.groupBy("table").agg(F.count("*").alias("n"), F.count("same").alias("shared"), lost.alias("lost"))
            frames.append(aligned.select("table", F.lit("columns"), F.col("n") == F.col("shared"), F.format_string("%d columns", "n"), F.col("lost")))
            rows = mine.compare_rows(theirs).where("other_rows is not null")
            frames.append(rows.select("dataset", F.lit("rows"), "equal", F.col("rows").cast("string"), F.col("other_rows").cast("string")))
        return reduce(DataFrame.union, frames)

    def query(self, sql: str) -> DataFrame:
        """A read-only query over the datasets as views."""
        spark = self._spark()
        require_read_only(spark, sql)
        for name, df in self.datasets.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, null as empty text."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."


def require_read_only(spark: SparkSession, sql: str) -> None:
    """One statement that Spark's parser reads as a query, with no command or write anywhere in it."""
    try:
        waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except Py4JJavaError as e:
        raise SourceError(f"no query: {str(e.java_exception.getMessage()).strip()[:200]}") from None
    except PySparkException as e:
        raise SourceError(f"no query: {str(e).strip()[:200]}") from None
    gateway = spark.sparkContext._gateway
    while waiting:
        plan = waiting.pop()
        if any(is_instance_of(gateway, plan, _LOGICAL + kind) for kind in ("Command", "ParsedStatement")):
            raise SourceError("only a read-only query is allowed")
        children = plan.children()
        waiting += [children.apply(i) for i in range(children.size())]


def require_one_query(sql: str) -> None:
    """One SELECT without a semicolon outside quotes: what can stand in parentheses after FROM, where no database writes."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]", "x", sql), flags=re.S).strip()
    if not re.match(r"select\b", bare, re.I) or ";" in bare:
        raise SourceError("only a single query is allowed")


def scales_percent_twice(sql: str) -> bool:
    """Whether a query formats a value that it multiplies by 100 with a percent format, which multiplies again."""
    return bool(re.search(r"format\s*\([^;]*(?:100(?:\.0+)?\s*\*|\*\s*100(?:\.0+)?)[^;]*,\s*'[^']*%'", sql, re.I))


def read_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df if rows is None else df.limit(rows)


def csv_folder(spark: SparkSession, folder: str) -> Catalog:
    """Each ``*.csv`` file of a folder as a dataset named by its stem; files that can't be read are left out with a warning."""
    files = [s[0] for s in _list(spark, folder) if s[0].lower().endswith(".csv")]
    out = Catalog()
    for path in sorted(files):
        try:
            df = read_csv(spark, path)
        except (PySparkException, Py4JJavaError) as e:
            _log.warning("%s can't be read: %s", path, str(e).split("\n", 1)[0])
            continue
        if df.columns:
            out.datasets[path.rsplit("/", 1)[-1][:-4]] = df
    if not out.datasets:
        raise SourceError(f"no readable CSV file in {folder}")
    return out


def parquet_folder(spark: SparkSession, folder: str, names: list[str] | None = None) -> Catalog:
    """Each ``*.parquet`` file or folder as a dataset named by its stem."""
    found = names or sorted(p.rstrip("/").rsplit("/", 1)[-1][: -len(".parquet")] for p, _ in _list(spark, folder) if p.rstrip("/").endswith(".parquet"))
    if not found:
        raise SourceError(f"no Parquet table in {folder}")
    return Catalog({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in found})


def _list(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of what a folder holds, through the file system that Spark uses for it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(jpath)]


def low_cardinality(df: DataFrame, most: int = 24, columns: int = 60, text_only: bool = True) -> DataFrame:
    """column, members (sorted text) of columns with 1 to ``most`` different values, at most ``columns`` of them looked at.

    One pass estimates the distinct values of all columns, a second collects the
    members of those that may be few: the sets stay small, whatever the rows.
    """
    wanted = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) or not (text_only or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)))][:columns]
    spark = df.sparkSession
    schema = "column string, members array<string>"
    if not wanted:
        return spark.createDataFrame([], schema)
    estimate = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in wanted]).first()
    few = [c for c in wanted if 0 < estimate[c] <= 2 * most + 8]
    if not few:
        return spark.createDataFrame([], schema)
    sets = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(c) for c in few])
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("members")) for c in few]))
    return sets.select(listed.alias("s")).select("s.*").where(F.size("members").between(1, most))


def slicer_members(tables: Mapping[str, DataFrame], slicers: list[tuple[str, str]], most: int = 8) -> DataFrame:
    """table, column, member of slicers with 2 to ``most`` different values."""
    frames = [
        tables[t].where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("member")).distinct().select(F.lit(t).alias("table"), F.lit(c).alias("column"), "member")
        for t, c in slicers
    ]
    # No more than one member above the bound of each slicer comes together, so a long list stays where it is.
    one = Window.partitionBy("table", "column")
    first = reduce(DataFrame.unionByName, frames).withColumn("__n", F.row_number().over(one.orderBy("member"))).where(F.col("__n") <= most + 1)
    return first.withColumn("__n", F.count("*").over(one)).where(F.col("__n").between(2, most)).drop("__n")


@dataclass(frozen=True)
class SqlServer:
    """Where a SQL Server database is and how to sign in."""

    server: str
    database: str
    port: int = 1433
    user: str | None = None
    password: str | None = None
    encrypt: bool = True

    def url(self) -> str:
        parts = [f"jdbc:sqlserver://{self.server}:{self.port}", f"databaseName={self.database}"]
        parts.append(f"encrypt={str(self.encrypt).lower()}")
        if self.encrypt:
            parts.append("trustServerCertificate=true")
        if self.user is None:
            parts.append("integratedSecurity=true")
        return ";".join(parts)

    def read(self, spark: SparkSession, query: str, **options: Any) -> DataFrame:
        """A read-only query; for a large table name partitionColumn, lowerBound, upperBound and numPartitions."""
        require_one_query(query)
        reader = spark.read.format("jdbc").option("url", self.url()).options(**options)
        if self.user is not None:
            reader = reader.option("user", self.user).option("password", self.password or "")
        if "partitionColumn" in options:  # Spark doesn't take these together with a query
            return reader.option("dbtable", f"({query}) q").load()
        return reader.option("query", query).load()


# Catalogue listings of a database that has an information schema: columns as ``assemble_schema`` takes them.
_LISTINGS = {
    "tables": "SELECT TABLE_SCHEMA AS [schema], TABLE_NAME AS name, TABLE_TYPE AS type FROM INFORMATION_SCHEMA.TABLES",
    "columns": "SELECT TABLE_SCHEMA AS [schema], TABLE_NAME AS name, COLUMN_NAME AS [column], DATA_TYPE AS data_type, IS_NULLABLE AS nullable, ORDINAL_POSITION AS position FROM INFORMATION_SCHEMA.COLUMNS",
    "primary_keys": """SELECT k.TABLE_SCHEMA AS [schema], k.TABLE_NAME AS name, k.COLUMN_NAME AS [column] FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE k
        JOIN INFORMATION_SCHEMA.TABLE_CONSTRAINTS c ON c.CONSTRAINT_SCHEMA = k.CONSTRAINT_SCHEMA AND c.CONSTRAINT_NAME = k.CONSTRAINT_NAME WHERE c.CONSTRAINT_TYPE = 'PRIMARY KEY'""",
    "foreign_keys": """SELECT r.CONSTRAINT_NAME AS [constraint], f.TABLE_SCHEMA AS [schema], f.TABLE_NAME AS name, f.COLUMN_NAME AS [column],
        p.TABLE_SCHEMA AS ref_schema, p.TABLE_NAME AS ref_name, p.COLUMN_NAME AS ref_column FROM INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS r
        JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE f ON f.CONSTRAINT_SCHEMA = r.CONSTRAINT_SCHEMA AND f.CONSTRAINT_NAME = r.CONSTRAINT_NAME
        JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE p ON p.CONSTRAINT_SCHEMA = r.UNIQUE_CONSTRAINT_SCHEMA AND p.CONSTRAINT_NAME = r.UNIQUE_CONSTRAINT_NAME
        AND p.ORDINAL_POSITION = f.ORDINAL_POSITION""",
}


@dataclass(frozen=True)
class Database:
    """A database as a source: what :class:`Catalog` answers, asked over JDBC."""

    spark: SparkSession
    server: SqlServer

    def reachable(self) -> bool:
        try:
            return self.query("SELECT 1 AS one").count() == 1
        except (PySparkException, Py4JJavaError):
            return False

    def schema(self) -> DataFrame:
        return assemble_schema(*[self.query(_LISTINGS[k]) for k in ("tables", "columns", "primary_keys", "foreign_keys")])

    def names(self) -> list[str]:
        return [r["table"] for r in self.schema().select("table").orderBy("table").collect()]

    def query(self, sql: str) -> DataFrame:
        return self.server.read(self.spark, sql)

    def _quoted(self, name: str) -> str:
        return ".".join("[" + part.replace("]", "]]") + "]" for part in name.split("."))

    def preview(self, name: str, rows: int = 50) -> DataFrame:
        return as_text(self.query(f"SELECT TOP {max(1, int(rows))} * FROM {self._quoted(name)}"))

    def columns(self) -> DataFrame:
        listed = self.schema().select("table", F.explode("columns").alias("c"))
        return listed.select("table", F.lit(None).cast("int").alias("table_position"), "c.column", "c.position", "c.data_type", "c.nullable")

    def row_count(self, name: str) -> DataFrame:
        return self.query(f"SELECT COUNT_BIG(*) AS rows FROM {self._quoted(name)}").select(F.lit(name).alias("dataset"), "rows")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SHEET_ROWS = 2000


def read_workbook(spark: SparkSession, path: str) -> Catalog:
    """Each sheet of an OOXML workbook as a dataset of text columns, the first row its header.

    The file is read by a task, through the file system that Spark uses for it, and its
    sheets are parsed row by row; only their names and headers come to the driver.  A
    sheet without a header is left out.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for place, (name, part) in enumerate(_sheets(z)):
                    first = next(_rows(z, part, _strings(z)), {})
                    header = [first.get(i) or f"column_{i + 1}" for i in range(max(first) + 1)] if first else []
                    yield pa.RecordBatch.from_pylist([{"place": place, "name": name, "header": header}])

    out = Catalog()
    for r in files.mapInArrow(heads, "place long, name string, header array<string>").orderBy("place").collect():
        if r["header"]:
            out.datasets[r["name"]] = _sheet(files, r["place"], r["header"])
    if not out.datasets:
        raise SourceError(f"no sheet with a header in {path}")
    return out


def _sheet(files: DataFrame, place: int, header: list[str]) -> DataFrame:
    width = len(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                rows = _rows(z, _sheets(z)[place][1], _strings(z))
                next(rows, None)
                held: list[list] = []
                for cells in rows:
                    held.append([cells.get(i) for i in range(width)])
                    if len(held) == _SHEET_ROWS:
                        yield _batch(held, width)
                        held = []
                if held:
                    yield _batch(held, width)

    return files.mapInArrow(run, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])).toDF(*header)


def _batch(rows: list[list], width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[f"c{i}" for i in range(width)])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column(0):
            yield content.as_py()


def _strings(z: zipfile.ZipFile) -> list[str]:
    """Texts that cells name by number."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    items = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")
    return ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in items]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet."""
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    listed = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")
    return [(s.get("name"), t if (t := targets[s.get(_LINK)]).startswith("xl/") else f"xl/{t}") for s in listed]


def _rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[dict[int, str]]:
    """Cells of each row by place, one row at a time."""
    with z.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_SHEET}row":
                yield _cells(node, shared)
                node.clear()


def _cells(row: ElementTree.Element, shared: list[str]) -> dict[int, str]:
    out = {}
    for cell in row.iter(f"{_SHEET}c"):
        letters = re.match("[A-Z]+", cell.get("r", "A")).group()
        place = 0
        for c in letters:
            place = place * 26 + ord(c) - 64
        value = cell.find(f"{_SHEET}v")
        if cell.get("t") == "s" and value is not None:
            out[place - 1] = shared[int(value.text)]
        elif cell.get("t") == "inlineStr":
            out[place - 1] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
        elif value is not None:
            out[place - 1] = value.text
    return out
