"""Exact duplicates of whole texts, safe for a group that holds a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import ascii_lower, narrow, shuffle_width


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    salts: int | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document with its group: ``doc_id, keep_id, group_size, kept, text_digest``.

    Texts are equal when identical after lower-casing A-Z.  The row with the largest
    ``doc_id`` stays.

    Copies are combined in three steps, each of which groups by digest *and* whole text:
    inside each task before anything is shuffled, then by digest and salt, then the
    salt winners of a digest.  The first shuffle spreads a hot text over ``salts`` keys
    (the shuffle width unless given) after the tasks have reduced it, the second sees
    one row per salt of it.  The result joins back on the digest alone where all texts of
    the digest were seen to be equal, and on the whole text elsewhere.  Only groups of
    two or more are joined; they are written first, so Spark knows their size.

    Null text counts as empty, and empty texts are equal.  A repeated row counts as often as it
    occurs and returns as often.  Null ids sort below all others; ``keep_id`` is null if a group
    has no other.  Other columns of ``docs`` are not used and may have any name.
    """
    salts = salts or shuffle_width(docs.sparkSession)
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("text_digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    # Partitioned by digest alone: both groupings below, by text and by digest, are then local.
    texts = (
        salted.repartition("text_digest")
        .groupBy("text_digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    groups = materialise(
        texts.groupBy("text_digest")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
        .filter("group_size > 1")
    )
    joined = rows.select("doc_id", "text_digest").join(groups.filter("texts = 1").drop("texts"), "text_digest", "left")
    clashes = groups.filter("texts > 1").select("text_digest")
    if not clashes.isEmpty():
        suspects = rows.join(clashes, "text_digest", "left_semi")
        exact = materialise(suspects.groupBy("text_digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        joined = (
            joined.join(clashes, "text_digest", "left_anti")
            .unionByName(suspects.join(exact, ["text_digest", "text"]).drop("text"))
        )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_digest",
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, with all their columns; needs a unique ``doc_id``."""
    gone = exact_duplicates(docs, text, doc_id, **options).filter("not kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
