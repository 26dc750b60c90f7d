import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cubewright.llm.text import id_bucket
from tests.against_sql import SF_DIR
from tests.llm import brute


def test_stages_keep_clean_documents_and_take_effect(spark):
    kept, columns = {}, ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(9000, "123 456", "en", "s", 7), (9001, None, "en", "s", 0), (9002, docs.first().text, "en", "s", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    kept[""] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids[""] - ids["language_id"] == {9000, 9001}
    rows = kept["language_id"].select("doc_id", "text").collect()
    roots = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    assert ids["near_dedup"] == set(roots)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = brute.contamination([(r.doc_id, r.text) for r in kept["near_dedup"].select("doc_id", "text").collect()], items)
    assert ids["decontamination"] == {d for d, *_, bad in judged if not bad}
    assert ids["personal_data"] == ids["bpe"] == ids["decontamination"]
    assert not any(brute.personal(r.text) for r in kept["personal_data"].select("text").collect())
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {r.doc_id: r.text for r in kept["personal_data"].collect()}
    for r in kept["bpe"].limit(20).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == library.decode(want, skip_special_tokens=False) and len(r.token_ids) == 4 * len(want)


def test_language_id_says_the_language_of_what_stays(spark):
    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_bucket(F.col("doc_id"), 3) == 1
    given = every.withColumn("lang", F.when(~held, F.col("lang")).when(F.col("doc_id") % 2 == 0, F.lit("xx")))
    out = corpus_pipeline.language_id(spark, given, SF_DIR)
    assert out.columns == every.columns and out.where("lang IS NULL OR lang = 'xx'").count() == 0
    both = out.where(held).join(every.select("doc_id", F.col("lang").alias("want")), "doc_id")
    right, n = both.agg(F.count_if(F.col("lang") == F.col("want")), F.count("*")).first()
    assert n > 300 and right > 0.98 * n


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "bpe"]
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.where(F.col("token_ids").isNull()).count() == 0 and out.count() > 100


def made(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    folder = tmp_path / f"in{len(rows)}"
    spark.createDataFrame(rows, docs.schema).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_run_on_empty_tables_and_nulls_leaves_no_stage_behind(spark, tmp_path, monkeypatch):
    root = tmp_path / "scratch"
    monkeypatch.setattr("cubewright.scratch.scratch_root", lambda _: f"file://{root}")
    assert corpus_pipeline.run(spark, made(spark, tmp_path, [])).count() == 0
    text = "A plain english text of some words that stays as it is, with the usual letters. " * 3
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, text, "en", "s", 5), (3, text, "en", "s", 5), (None, text, None, None, None)]
    out = corpus_pipeline.run(spark, made(spark, tmp_path, rows))
    assert {r.doc_id for r in out.collect()} <= {None, 3} and set(out.columns) >= {"doc_id", "token_ids", "decoded"}
    held = [p for p in root.glob("*/*") if any(p.iterdir())]
    assert [p.name.split("-", 1)[1] for p in held] == ["personal_data"] * 2  # what the two results read
