"""Run summaries: JSON lines in a folder for each project, and the list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a summary holds; fields that a file lacks are null.
SUMMARY = """project_id string, generated_at timestamp_ntz, processing_time_ms long, tests_total long, tests_passed long, tests_failed long,
tokens long, llm_calls long, issues_high long, issues_medium long, issues_low long, candidates long, duplicates_removed long, low_value_skipped long"""


def save_summaries(runs: DataFrame, folder: str) -> None:
    """Add each row of ``runs`` to the folder of its project, ``<folder>/project_id=<id>/``."""
    fields = [c.split()[0] for c in SUMMARY.replace("\n", " ").split(", ")]
    kept = runs.select(*[F.col(c) for c in fields if c in runs.columns], F.col("project_id").alias("__project"))
    kept.withColumnRenamed("__project", "of").write.mode("append").partitionBy("of").json(folder)


def list_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The last summary of each project, newest first; records that can't be read, or name no project, are left out.

    Of several at one moment the one with the greatest fields stays, in the order of ``SUMMARY``.
    """
    read = spark.read.schema(SUMMARY).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(folder)
    last = read.where("project_id is not null").groupBy("project_id").agg(F.max(F.struct("generated_at", F.struct("*").alias("run"))).alias("last"))
    return last.select("last.run.*").orderBy(F.desc_nulls_last("generated_at"), "project_id")
