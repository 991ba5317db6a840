"""Thin queries over the driver's tables, with production parameters; digest columns come from the operators' outputs."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import contamination, digest
from tessella.llm.fingerprints import compare_edits
from tessella.llm.html_extract import extract_text
from tessella.llm.jaccard import jaccard_components
from tessella.llm.language import identify
from tessella.llm.license_scan import scan_licenses
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.packing import pack
from tessella.llm.sharding import ShardStore
from tessella.llm.token_counts import count_tokens
from tessella.runtime import scratch_dir, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "dice", F.size("matches").cast("long").alias("n_matches"), "matches")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}")
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=3, num=90, den=100)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_document_fingerprints, op3_license_scan, op4_line_dedup, op5_language_id, op6_token_counts, op7_html_extraction, op8_sharding, op9_benchmark_decontamination, op10_ngram_jaccard_join)}
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), iw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM i WHERE len(w) > 0
), ig AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM iw
), dg AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, item_id, n, p FROM dg JOIN ig USING (n, g)
), hw AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT r.doc_id, links.b FROM r JOIN links ON r.root = links.a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

#: What the compacted store gives back is the table that was put in.
OP8_SQL = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents"

ORACLE_SQL: dict[str, str] = {"op8_sharding": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op9_benchmark_decontamination": OP9_SQL}
