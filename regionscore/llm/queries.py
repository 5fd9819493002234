"""The dealt operators on the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.llm.common import documents, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_training_order")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 512-id sequences of all documents in training order; one row per sequence."""
    from regionscore.llm.training_order import materialise

    return materialise(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "training_order"), length=512
    )


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionscore.llm.token_counts import token_counts

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


@query("op7_harmonic_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionscore.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and decision of every document; the target is text labelled good."""
    from regionscore.llm.importance import fit, resample

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(docs, model)[0]


@query("op4_rendezvous_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by key, and where each would be with 17."""
    from regionscore.llm.rendezvous import slots

    placed = slots(documents(spark, sf_dir).select("doc_id", "text"), [1.0] * 16, more=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_invertible_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionscore.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


@query("op10_jaccard_classes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionscore.llm.jaccard_join import similarity_classes

    return similarity_classes(documents(spark, sf_dir), width=4, num=85, den=100)


@query("op5_surrogates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for the personal data in their texts."""
    from regionscore.llm.surrogates import replace_entities

    return replace_entities(documents(spark, sf_dir), key="corpus-2024")


@query("op8_simhash_windows")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    from regionscore.llm.decontaminate import contaminations

    return contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


BACKOFF_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
tokens AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM words),
placed AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM tokens),
own1 AS (SELECT doc_id, w, count(*) AS n FROM placed GROUP BY ALL),
all1 AS (SELECT w, sum(n) AS n FROM own1 GROUP BY w),
own2 AS (SELECT doc_id, v, w, count(*) AS n FROM placed WHERE v IS NOT NULL GROUP BY ALL),
all2 AS (SELECT v, w, sum(n) AS n FROM own2 GROUP BY ALL),
sizes AS (SELECT doc_id, len(ws) AS n_words, (SELECT count(*) FROM tokens) AS corpus FROM words),
scored AS (
  SELECT p.doc_id, p.v IS NOT NULL AS inner_word, coalesce(a2.n - o2.n, 0) AS both_n,
    a1.n - o1.n AS word_n, coalesce(c1.n - d1.n, 0) AS context_n, greatest(s.corpus - s.n_words, 1) AS corpus
  FROM placed p JOIN sizes s USING (doc_id) JOIN own1 o1 ON o1.doc_id = p.doc_id AND o1.w = p.w JOIN all1 a1 ON a1.w = p.w
  LEFT JOIN own2 o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.w = p.w LEFT JOIN all2 a2 ON a2.v = p.v AND a2.w = p.w
  LEFT JOIN own1 d1 ON d1.doc_id = p.doc_id AND d1.w = p.v LEFT JOIN all1 c1 ON c1.w = p.v
),
summed AS (
  SELECT doc_id, CAST(sum(CASE WHEN inner_word AND both_n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_backed_off,
    sum(CASE WHEN both_n > 0 THEN ln(both_n) - ln(context_n)
        ELSE ln(greatest(word_n, 1)) - ln(corpus) + CASE WHEN inner_word THEN ln(0.4) ELSE 0 END END) AS total
  FROM scored GROUP BY doc_id
)
SELECT s.doc_id, CAST(s.n_words AS BIGINT) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off,
  round(coalesce(total, 0), 4) AS log_score, CASE WHEN s.n_words > 0 THEN round(total / s.n_words, 6) END AS mean_log_score
FROM sizes s LEFT JOIN summed USING (doc_id)
"""


@query("op3_stupid_backoff", BACKOFF_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out bigram scores of all documents under the whole corpus."""
    from regionscore.llm.backoff import backoff_scores

    scored = backoff_scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM w GROUP BY ALL),
vocab AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING sum(df) >= 10),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM vocab GROUP BY lang),
k AS (SELECT c.lang, c.source, c.term, CAST(c.n AS HUGEINT) AS n FROM c JOIN vocab USING (lang, term)),
g AS (
  SELECT s.lang, s.source, CAST(coalesce(sum(k.n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN k ON k.lang = s.lang AND k.source = s.source GROUP BY ALL
),
p AS (
  SELECT g.lang, g.source, vocab.term, coalesce(k.n, 0) AS n, 1 + (1000000000 * (coalesce(k.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
    1 + (1000000000 * (vocab.total + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN langs l ON l.lang = g.lang JOIN vocab ON vocab.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = vocab.term
),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(far.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of each language, and the ten terms that mark each source most."""
    from regionscore.llm.divergence import divergence_audit

    return divergence_audit(documents(spark, sf_dir))


CAPTURES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, html, list_aggregate([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (j // 4), 5))::INT >> (15 - 5 * (j % 4))) & 31), 1) FOR j IN range(32)
    ], 'string_agg', '') AS digest
  FROM p
),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


@query("op12_capture_history", CAPTURES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the archives through their merged index."""
    from regionscore.llm.warc import capture_history

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = capture_history(pages, new_path(spark, "captures"))
    return index.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer over all documents."""
    from regionscore.llm.alignment import align_tokens

    return align_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
