"""The operators bound to the check tables: one query for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, byte_cnn, decontamination, language_id, license_scan, mixing, near_dup, suffix_lm, toxicity, warc
from .frames import table
from .store import crc_bucket, scratch_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = byte_cnn.learn(docs, table(spark, sf_dir, "labels"), crc_bucket("k", 5) != 0)
    scored = byte_cnn.score(docs, model)
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_bucket("k", 5) != 0)
    scored = toxicity.score(docs, index)
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1, five bits at a time from each five hexadecimal digits.
OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages),
g AS (SELECT hx, max(page_id) AS top FROM p GROUP BY hx)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(p.hx, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)
    FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id < g.top OR (p.page_id IS NULL AND g.top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.top OR (p.page_id IS NULL AND g.top IS NOT NULL) THEN g.top END AS refers_to
FROM p JOIN g USING (hx)
"""


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = additive_ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs, where=crc_bucket("doc_id", 4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[a : a + 7], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS a FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, a, array_to_string(w[a : a + n - 1], ' ') AS phrase
  FROM (SELECT r, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS a FROM d, lens)),
hit AS (SELECT g.r, g.a, g.n, win.item_id FROM grams g JOIN win USING (n, phrase)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT r, a, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = suffix_lm.learn(docs, where=crc_bucket("doc_id", 5) != 1)
    scored = suffix_lm.score(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license": op2_license,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_ann": op6_ann,
    "op7_language": op7_language,
    "op8_decontamination": op8_decontamination,
    "op9_near_dup": op9_near_dup,
    "op10_lm": op10_lm,
}

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op8_decontamination": OP8_SQL}
