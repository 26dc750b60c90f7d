"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .decontam import contamination
from .divergence import divergence_audit
from .langid import fit_languages, identify_languages
from .lexical import ranked_search
from .linequality import fit_lines, quality_counts
from .packing import pack_sequences
from .pii import KINDS, fit_spans, personal_data
from .ppm import language_model_scores
from .simhash import simhash_groups
from .text import id_bucket
from .tokencount import token_counts
from .urlfilter import judge_urls
from .warc import archived_pages

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (id_bucket(F.col("doc_id"), 10) == 0).alias("held"))
    return language_model_scores(docs, "held")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_counts(docs, fit_lines(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = personal_data(docs, fit_spans(docs), keep=["doc_id"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[_kind_count(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    marked = docs.withColumn("held_out", id_bucket(F.col("doc_id"), 3) == 1)
    return identify_languages(marked, fit_languages(docs), keep=["doc_id", "held_out"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archived_pages(_table(spark, sf_dir, "pages"))
    return captures.select(
        F.col("id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("refers_to_id").alias("refers_to"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep=["doc_id"])
    return encoded.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_link_graph": op1_link_graph,
        "op2_simhash": op2_simhash,
        "op3_ppm": op3_ppm,
        "op4_winnowing": op4_winnowing,
        "op5_line_labels": op5_line_labels,
        "op6_personal_data": op6_personal_data,
        "op7_string_kernel": op7_string_kernel,
        "op8_warc": op8_warc,
        "op9_token_counts": op9_token_counts,
        "op10_bpe": op10_bpe,
        "op11_packing": op11_packing,
        "op12_block_max_wand": op12_block_max_wand,
        "op13_divergence": op13_divergence,
    }


_WORDS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP4_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m,
         array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS span
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT rid, m, s, array_to_string(w[s + 1 : s + m], ' ') AS span
  FROM (SELECT rid, w, m, unnest(range(len(w) - m + 1)) AS s
        FROM docs, (SELECT DISTINCT m FROM spans) WHERE len(w) >= m)),
found AS (SELECT rid, s, m, item_id FROM places JOIN spans USING (span, m)),
hit AS (
  SELECT rid, count(DISTINCT pos) AS n_hit
  FROM (SELECT rid, unnest(range(s, s + m)) AS pos FROM (SELECT DISTINCT rid, s, m FROM found)) GROUP BY rid),
named AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM f
"""


_TERMS = _WORDS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
q AS (
  SELECT qid, item_id, unnest(list_distinct(w)) AS term
  FROM (SELECT row_number() OVER () AS qid, item_id, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark)),
p AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term),
scored AS (
  SELECT qid, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS score
  FROM q JOIN p USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""

OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs
  FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY ALL),
held AS (SELECT lang, source, term, n FROM c JOIN k USING (lang, term)),
g AS (
  SELECT s.lang, s.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.lang_n), 0) AS lang_n, coalesce(sum(h.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v ON s.lang = v.lang LEFT JOIN held h ON s.lang = h.lang AND s.source = h.source
  GROUP BY s.lang, s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000 * (coalesce(h.n, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000 * (k.total + 5)) // (g.lang_n + 5 * g.v) AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN held h ON g.lang = h.lang AND g.source = h.source AND k.term = h.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, CAST(value AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term QUALIFY rank <= 50)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_winnowing": OP4_SQL, "op8_warc": OP8_SQL, "op12_block_max_wand": OP12_SQL, "op13_divergence": OP13_SQL}
