"""The registered queries of this folder: each applies one operator to its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm import bpe, decontaminate, divergence, embedding_dedup, html_extract, license_scan, ngram_join, prefix_forest, quality, substring_dedup, url_filter, vector_codes, warc
from lumicat.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived record; the block as its digest, length and code points."""
    got = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return got.select(
        F.col("headers")["WARC-Page-Id"].cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest",
        F.octet_length("block").cast("long").alias("content_length"), F.col("headers")["WARC-Source-Content-Type"].alias("source_content_type"))


@query
def op3_html_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op11_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"))


@query
def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


ORACLE["op12_vector_code_compression"] = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, label, k, v[k * (len(v) // 16) + 1 : (k + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(k)),
  first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
  book0 AS MATERIALIZED (SELECT p.k, f.e, p.x AS c FROM parts p JOIN first f USING (vec_id)),
  near0 AS MATERIALIZED (SELECT p.vec_id, p.k, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) % 64 AS e
    FROM parts p JOIN book0 b USING (k) GROUP BY ALL),
  mean0 AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT k, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM near0, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
  book1 AS MATERIALIZED (SELECT k, e, coalesce(m.c, b.c) AS c FROM book0 b LEFT JOIN mean0 m USING (k, e)),
  near1 AS MATERIALIZED (SELECT p.vec_id, p.k, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) % 64 AS e
    FROM parts p JOIN book1 b USING (k) GROUP BY ALL),
  mean1 AS (SELECT k, e, list(m ORDER BY i) AS c FROM (SELECT k, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM near1, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
  book2 AS MATERIALIZED (SELECT k, e, coalesce(m.c, b.c) AS c FROM book1 b LEFT JOIN mean1 m USING (k, e)),
  near2 AS (SELECT p.vec_id, p.label, p.k, min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) AS d
    FROM parts p JOIN book2 b USING (k) GROUP BY ALL),
  coded AS (SELECT vec_id, label, string_agg(printf('%02x', d % 64), '' ORDER BY k) AS code, sum(d // 64)::BIGINT AS error FROM near2 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM book2) AS codebooks_sha256
FROM coded
"""


@query
def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence_audit"] = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM words GROUP BY ALL),
  kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
  langs AS (SELECT lang, count(*) AS v, sum(n) + 5 * count(*) AS total FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
    FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  totals AS (SELECT lang, source, sum(n) + 5 * count(*) AS total FROM dense GROUP BY ALL),
  priced AS (SELECT d.lang, d.source, d.term, d.n, 1 + (1000000000::HUGEINT * (d.n + 5)) // t.total AS p, 1 + (1000000000::HUGEINT * (d.lang_n + 5)) // l.total AS q
    FROM dense d JOIN totals t ON t.lang = d.lang AND t.source = d.source JOIN langs l ON l.lang = d.lang),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
"""
