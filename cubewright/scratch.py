"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the one that the cluster names in ``spark.checkpoint.dir``, which
the driver and every executor share, so a lost executor costs a re-read and
nothing else.  Only a local session may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_owners: list[list[Scratch]] = []


@contextmanager
def owned() -> Iterator[list[Scratch]]:
    """The runs that begin inside, so that a caller who has written what they gave can delete all that they kept."""
    _owners.append([])
    try:
        yield _owners[-1]
    finally:
        _owners.pop()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, from the session's setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


class Scratch:
    """Tables of one operator run, each written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []
        if _owners:
            _owners[-1].append(self)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def keep_only(self, *wanted: DataFrame) -> None:
        """Delete all tables of this run but these, which the result reads."""
        paths = {df._scratch_path for df in wanted}
        for df in self.tables:
            if df._scratch_path not in paths:
                self.drop(df)
        self.tables = [df for df in self.tables if df._scratch_path in paths]

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by :meth:`table`; nothing may read it later."""
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            self.delete(path)

    def delete(self, path: str | None = None) -> None:
        """Delete a path, or all that this run has written."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.base)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
