"""A corpus pipeline over ``documents``; each stage applies one of the text operators.

Every stage works on all that the stage before it kept, on whole texts, and returns the columns of
``documents``; the last returns packed pieces.  Documents without an id cannot be named in
any decision and leave in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm import line_dedup, near_dedup, packing, personal_data, quality_rules
from driver_queries.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Links from 0.8 on, one of which the bands miss with probability 4.9e-5.
NEAR = near_dedup.NearConfig(hundredths=80, bands=25, rows=5)


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    kept = quality_rules.quality_rules(docs).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has, up to two edits; documents of nothing else go."""
    cleaned = line_dedup.drop_repeated_lines(docs, edits=line_dedup.EDITS)
    return _with_text(cleaned.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more), the one with the smallest id."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs, config=NEAR).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship_package(spark)
    return _with_text(personal_data.redact_documents(docs, personal_data.fit_documents(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece with its ids."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("personal_data", private),
    ("packing", packed),
]
#: Robust estimates, boosted trees and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        docs = result if n == len(STAGES) - 1 else materialise(result)
    return docs
