"""The numbered queries over whole driver tables and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastgrid.llm import (
    byte_pairs,
    exact_dedup,
    filter_audit,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    personal_data,
    quality_rules,
    site_quality,
    spelling,
    tokens,
    toxicity,
)
from coastgrid.llm.common import read_table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM t JOIN g USING (text)
"""

def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), edits=line_dedup.EDITS)
    return cleaned.select("doc_id", "lines", "equal_lines", "near_lines", exact_dedup.sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, every length that occurs; no limit is left out."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.length_histogram(read_table(spark, sf_dir, "documents"), path, keys=("lang",))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), path, with_ids=False).drop("ids")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_from_labels(docs, read_table(spark, sf_dir, "labels"))
    scores = toxicity.score_toxicity(docs, model)
    return scores.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.round_trips(read_table(spark, sf_dir, "documents"), path)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the host and path of their page, or else by source and language."""
    docs = read_table(spark, sf_dir, "documents")
    sites = site_quality.merged_sites(docs, read_table(spark, sf_dir, "pages"))
    # Labels of every fifth id stay unseen, so that the result can be measured on them.
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id"))
    return site_quality.site_quality(docs, sites, labels)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = personal_data.find_personal_data(docs, personal_data.fit_documents(docs))
    counts = [f"n_{k}" for k in personal_data.KINDS]
    return found.select("doc_id", *counts, exact_dedup.sha256(F.col("base")).alias("base_sha256"), "spans")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return license_scan.scan_licenses(docs, license_scan.build_index(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, f, bit,
    coalesce((SELECT sum(l.bit) FROM letters l WHERE position(l.f IN left(filter_order, step - 1)) > 0), 0) AS earlier
  FROM orders, generate_series(1, 5) AS s(step), letters WHERE f = substr(filter_order, step, 1)
), texts AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), said AS (SELECT doc_id, max(quality) FILTER (quality = 1) AS good, max(toxic) FILTER (toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS MATERIALIZED (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask,
    count(*) AS n, count(good) AS good, count(toxic) AS toxic
  FROM texts LEFT JOIN said USING (doc_id) GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters and more that occur twice, every 31st occurrence misspelt."""
    found = spelling.word_counts(read_table(spark, sf_dir, "documents"), least_chars=7, drop_every=31)
    return spelling.spelling_variants(found.filter("n >= 2"), times=10)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_packing": (op3_packing, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op6_near_dedup": (op6_near_dedup, None),
    "op5_toxicity": (op5_toxicity, None),
    "op7_byte_pairs": (op7_byte_pairs, None),
    "op8_site_quality": (op8_site_quality, None),
    "op9_personal_data": (op9_personal_data, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_license_scan": (op11_license_scan, None),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_spelling": (op13_spelling, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
