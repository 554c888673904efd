"""Months published by a marker, so that no reader sees half of one.

A publication is written below ``<path>/data/version=<id>`` and then named in ``<path>/ledger``,
one small Parquet file that appears by a single rename.  Readers go by the ledger
alone: what it does not name was never published, whether its writer failed, was
lost or is still at work.  The latest line of a variable's month holds; versions it replaces stay
until ``drop_unnamed`` is asked to remove them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coastgrid.errors import MissingRecordError, ValidationError
from coastgrid.sinks.writers import MONTH_PARTITIONS, _by_month, pending_months, remove_folder, write_watched

LEDGER_SCHEMA = "variable string, year int, month int, version string, row_count long, seq long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the ledger, in any order; none where nothing was published yet."""
    ledger = f"{path.rstrip('/')}/ledger"
    if not _exists(spark, ledger):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def published_months(spark: SparkSession, path: str) -> DataFrame:
    """One row per published month of a variable, its latest line: the columns of ``LEDGER_SCHEMA``."""
    rest = F.struct("version", "row_count", "seq")
    latest = ledger_lines(spark, path).groupBy(*MONTH_PARTITIONS).agg(F.max_by(rest, F.struct("seq", "version")).alias("_l"))
    return latest.select(*MONTH_PARTITIONS, "_l.version", "_l.row_count", "_l.seq")


def publish_months(
    df: DataFrame,
    path: str,
    sort: Sequence[str] = ("ts", "k", "j", "i"),
    refuse: Column | None = None,
    replace: bool = True,
) -> DataFrame:
    """Publish exactly the months in ``df`` and return their lines of the ledger.

    The rows are written once, to a version of their own; the same pass counts those that ``refuse``
    holds for, and a single one is an error that leaves nothing to be seen.  Then one marker
    names all months of ``df``: readers have every one of them or none, and before that the months as they
    were.  ``replace=False`` refuses months that are published already.

    Writers of different months may run at the same time; of two writers of one month the later marker holds,
    and of two at once the larger version, for every reader the same.
    Lost tasks and executors are Spark's to repeat; after a lost driver the version stays unnamed.
    """
    # The letter keeps partition discovery from reading the version as a number.
    spark, root, version = df.sparkSession, path.rstrip("/"), f"v{uuid.uuid4().hex}"
    staged = f"{root}/data/version={version}"
    rows = write_watched(_by_month(df, sort), staged, refuse)
    if not rows:
        remove_folder(spark, staged)
        return spark.createDataFrame([], LEDGER_SCHEMA)
    before = ledger_lines(spark, path).agg(F.max("seq")).first()[0] or 0
    # Counted from what lies there; the partition columns are in the paths, the counts in the footers.
    months = spark.read.parquet(staged).groupBy(*MONTH_PARTITIONS).agg(F.count("*").alias("row_count"))
    lines = months.select(
        F.col("variable").cast("string").alias("variable"),
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
        F.lit(version).alias("version"),
        "row_count",
        F.lit(before + 1).cast("long").alias("seq"),
    )
    if not replace:
        clash = lines.join(published_months(spark, path), list(MONTH_PARTITIONS), "left_semi").select(*MONTH_PARTITIONS).limit(5).collect()
        if clash:
            remove_folder(spark, staged)
            raise ValidationError(f"already published: {', '.join('{} {}-{:02}'.format(*r) for r in clash)}")
    # One task, one file, one rename.  A line per variable and month, not per row.
    lines.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return ledger_lines(spark, path).filter(F.col("version") == version)


def read_published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all published months, each from the version its latest line names.

    Versions are partitions of the files, and only named ones are opened; months that a later version
    replaces are left out by a join with the ledger, which has a row per variable and month.  Files
    that got lost are found by ``check_published``.
    """
    named = published_months(spark, path).select(*MONTH_PARTITIONS, "version")
    root = f"{path.rstrip('/')}/data"
    # One string per publication.
    versions = [r["version"] for r in named.select("version").distinct().collect()]
    if not versions:
        raise MissingRecordError(f"nothing is published under {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    data = reader.option("basePath", root).parquet(*(f"{root}/version={v}" for v in sorted(versions)))
    return data.withColumn("variable", F.col("variable").cast("string")).join(named, [*MONTH_PARTITIONS, "version"], "left_semi").drop("version")


def check_published(spark: SparkSession, path: str) -> DataFrame:
    """Published months whose files hold another number of rows than their line says; none is right."""
    counted = read_published(spark, path).groupBy(*MONTH_PARTITIONS).agg(F.count("*").alias("found"))
    told = published_months(spark, path)
    held = F.coalesce("found", F.lit(0))
    return told.join(counted, list(MONTH_PARTITIONS), "left").filter(held != F.col("row_count")).select(*MONTH_PARTITIONS, "row_count", held.alias("found"))


def pending_published(spark: SparkSession, path: str, years: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``year, month`` pairs of the wanted years that lack any of ``variables`` in the ledger."""
    wanted = years.select("year", F.explode(F.array(*map(F.lit, variables))).alias("variable"))
    return pending_months(published_months(spark, path), wanted, ["variable"]).select("year", "month").distinct()


def unnamed_versions(spark: SparkSession, path: str) -> list[str]:
    """Versions in the files that no latest line names: replaced ones, and those whose writer failed or still writes."""
    root = f"{path.rstrip('/')}/data"
    if not _exists(spark, root):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    there = {f.getPath().getName().removeprefix("version=") for f in found if f.getPath().getName().startswith("version=")}
    return sorted(there - {r["version"] for r in published_months(spark, path).select("version").distinct().collect()})


def drop_unnamed(spark: SparkSession, path: str) -> list[str]:
    """Remove unnamed versions.  Only while nobody writes to ``path``, and no reader began before it."""
    gone = unnamed_versions(spark, path)
    for version in gone:
        remove_folder(spark, f"{path.rstrip('/')}/data/version={version}")
    return gone
