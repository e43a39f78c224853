"""Registered queries of this folder: thin calls of the operators over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .common import table
from .conversations import repair_conversations
from .decontamination import contaminated
from .filter_audit import audit_filters
from .fingerprint import edited_fingerprints
from .fixity import audit, damaged
from .license_scan import scan_licenses
from .line_dedup import line_components
from .ngram_join import jaccard_components
from .packing import pack
from .permutation_index import permutation_search
from .pii import ADDED, BASE, find_pii, rendered
from .token_counts import count_tokens
from .toxicity import score_toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica with planted faults."""
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages)).select(F.col("id").alias("page_id"), "status", "file_no", "lo", "hi")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    of_kind = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind("base", k).alias(f"n_{x}") for k, x in enumerate(BASE)]
    added = [of_kind("spans", k).alias(f"n_{x}") for k, x in enumerate(ADDED, len(BASE))]
    return found.select("doc_id", *counts, F.sha2(rendered("base"), 256).alias("base_sha256"), rendered("spans").alias("spans"), *added)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = permutation_search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_permutation_search": op7_permutation_search,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_fingerprints": op11_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
#: The records that differ, straight from their bytes, and the offset ranges by window sums.
AUDIT_SQL = """
WITH kept AS (SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN html || chr(0) WHEN page_id % 389 = 7 THEN '' ELSE html END AS html
  FROM pages WHERE page_id % 211 <> 13
  UNION ALL SELECT page_id + 1000000007, url, html FROM pages WHERE page_id % 503 = 11),
a AS (SELECT page_id, url, html, page_id // 1024 AS file_no, strlen(url) + strlen(html) + strlen(strlen(html)::VARCHAR) AS n FROM pages),
b AS (SELECT page_id, url, html, page_id // 1024 AS file_no, strlen(url) + strlen(html) + strlen(strlen(html)::VARCHAR) AS n FROM kept),
x AS (SELECT *, sum(n + 99) OVER (PARTITION BY file_no ORDER BY page_id) AS hi FROM a),
y AS (SELECT *, sum(n + 99) OVER (PARTITION BY file_no ORDER BY page_id) AS hi FROM b)
SELECT coalesce(x.page_id, y.page_id) AS page_id, CASE WHEN y.page_id IS NULL THEN 'missing' WHEN x.page_id IS NULL THEN 'extra' ELSE 'altered' END AS status,
  coalesce(x.file_no, y.file_no)::BIGINT AS file_no, coalesce(x.hi - x.n - 99, y.hi - y.n - 99)::BIGINT AS lo, coalesce(x.hi, y.hi)::BIGINT AS hi
FROM x FULL JOIN y ON x.page_id = y.page_id
WHERE x.page_id IS NULL OR y.page_id IS NULL OR x.html <> y.html OR x.url <> y.url
"""
#: Each order applied step by step: a document is removed by the first filter of the order that it fails.
FILTERS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS own FROM o, k),
x AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS hit, list_bool_or(list_transform(o[1:step - 1], lambda j: fails[j])) AS gone,
  list_sum(list_transform(fails, lambda f: f::INT)) AS n_fails FROM c, s),
r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT coalesce(gone, false)), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT coalesce(gone, false)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND coalesce(gone, false)), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT coalesce(gone, false)), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT coalesce(gone, false)), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda j: ['A', 'B', 'C', 'D', 'E'][j]), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
ORACLE_SQL: dict[str, str] = {"op3_merkle_audit": AUDIT_SQL, "op12_filter_audit": FILTERS_SQL}
