"""The training-corpus pipeline: stages that each filter or rewrite ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cubewright.llm.bpe import bpe_encode
from cubewright.llm.decontam import drop_contaminated
from cubewright.llm.langid import drop_unidentified, fit_languages
from cubewright.llm.pii import fit_spans, redact_personal_data
from cubewright.llm.scratch import Scratch, owned
from cubewright.llm.simhash import drop_near_duplicates

#: Texts below this fit (0: like texts of languages not learned, 1: like held-out ones of a learned language) fit no language.
LEAST_LANGUAGE_SCORE = 0.25
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones among them, or that no language fits, go; lang becomes the language that the rest are identified as, repeated rows alike."""
    return drop_unidentified(docs, fit_languages(docs), LEAST_LANGUAGE_SCORE, lang_col="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate group stays; of repeated rows one, texts without a word are one group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows.  Null and empty texts stay as they are."""
    return redact_personal_data(docs, fit_spans(docs), length_col="n_chars")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the text they decode to beside each document's other columns."""
    return bpe_encode(docs, public_tokenizers.path(TOKENIZER), keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", bpe),
]

#: No SQL: language ID, simhash and byte-pair stages are beyond DuckDB's dialect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over the whole Parquet output of the one before.

    What a stage reads and what its operator has kept is deleted once its output is
    written; the last output but one stays, as the result reads it.  Null, empty and
    very long texts, repeated rows and columns of any name are what the stages'
    operators say; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with owned() as kept:
            following = scratch.table(stage(spark, docs, sf_dir), name)
        for tables in kept:
            tables.delete()
        scratch.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
