"""Parquet sinks.

Fields are partitioned by ``variable, year, month`` and sorted by ``ts, k, j, i``
inside each file, so that reading one level of one time touches few row groups.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from coastgrid.errors import ValidationError
from coastgrid.functions.columns import finite, micros_between

COMPRESSION = "zstd"
MONTH_PARTITIONS = ("variable", "year", "month")
ROWS_PER_STRIP = 512


def write_bathymetry(df: DataFrame, path: str, domains: DataFrame | None = None) -> None:
    """Cell centres, heights as FLOAT and, with ``domains``, the vertical faces; replaces what is there."""
    out = df.withColumn("h", F.col("h").cast("float"))
    if domains is not None:
        domains.write.mode("overwrite").parquet(f"{path.rstrip('/')}_domains")
    (
        out.repartition("grid_id", F.floor((F.col("j") - 1) / ROWS_PER_STRIP))
        .sortWithinPartitions("grid_id", "j", "i")
        .write.mode("overwrite")
        .option("compression", COMPRESSION)
        .parquet(path)
    )


def _by_month(df: DataFrame, sort: Sequence[str]) -> DataFrame:
    """Rows ready for a monthly partitioned write.

    A month of one variable is spread over its days and, where present, its levels, domains and
    strips of rows, so neither a huge month nor a wide domain lands in one task or file.
    """
    spread = [F.dayofmonth("ts"), *(F.col(c) for c in ("k", "grid_id") if c in df.columns)]
    if "j" in df.columns:
        spread.append(F.floor((F.col("j") - 1) / ROWS_PER_STRIP))
    return (
        df.withColumns({"year": F.year("ts"), "month": F.month("ts")})
        .repartition(*MONTH_PARTITIONS, *spread)
        .sortWithinPartitions(*MONTH_PARTITIONS, *[c for c in sort if c in df.columns])
    )


def _write_months(df: DataFrame, path: str, sort: Sequence[str]) -> None:
    (
        _by_month(df, sort)
        .write.mode("overwrite")
        .option("compression", COMPRESSION)
        .partitionBy(*MONTH_PARTITIONS)
        .parquet(path)
    )


def write_forcing(df: DataFrame, path: str) -> None:
    """Values and relaxation rates as FLOAT, by variable and month."""
    out = df.withColumns({"value": F.col("value").cast("float"), "lambda": F.col("lambda").cast("float")})
    _write_months(out, path, ("grid_id", "ts", "k", "j", "i"))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def not_finite(value: str = "value") -> Column:
    """NULL, NaN and infinite values."""
    return ~finite(F.col(value))


def write_watched(rows: DataFrame, path: str, refuse: Column | None = None) -> int:
    """Write rows by month to a new folder and count them in the same pass; the number written.

    A single row that ``refuse`` holds for is an error that names up to five of their times, and then
    the folder is gone again.
    """
    watched, spark = Observation(), rows.sparkSession
    bad = F.count_if(F.lit(False) if refuse is None else F.coalesce(refuse, F.lit(False)))
    seen = rows.observe(watched, F.count(F.lit(1)).alias("rows"), bad.alias("bad"))
    seen.write.option("compression", COMPRESSION).partitionBy(*MONTH_PARTITIONS).parquet(path)
    if watched.get["bad"]:
        held = spark.read.parquet(path).filter(refuse).select("variable", F.col("ts").cast("string")).distinct().orderBy("variable", "ts").limit(5).collect()
        remove_folder(spark, path)
        named = ", ".join("{} at {}".format(*r) for r in held)
        raise ValidationError(f"{watched.get['bad']} of {watched.get['rows']} rows are refused, so nothing is kept of the write: {named}")
    return watched.get["rows"]


def write_atmosphere(df: DataFrame, path: str) -> None:
    """Atmosphere fields, refused when any value is not finite; replaces what is there.

    The input is computed once: values are counted while they are written beside ``path``, and the
    folder takes its place only when all are finite.
    """
    out = _by_month(df.withColumn("value", F.col("value").cast("float")), ("grid_id", "ts", "j", "i"))
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    write_watched(out, staged, not_finite())
    spark = df.sparkSession
    files, place = _folder(spark, path)
    files.delete(place, True)
    if not files.rename(_folder(spark, staged)[1], place):
        raise ValidationError(f"{staged} holds the fields, but could not be moved to {path}")


def _place(path: str) -> str:
    """A path in one spelling: absolute where it names no file system, no ``file:``, no dots or double slashes."""
    scheme, sep, rest = path.partition("://")
    if sep and scheme != "file":
        host, _, inner = rest.partition("/")
        return f"{scheme}://{host}{posixpath.normpath('/' + inner.lstrip('/'))}"
    local = rest if sep else path.removeprefix("file:")
    return "/" + os.path.abspath(local).lstrip("/")


def write_river_copy(df: DataFrame, source_path: str, path: str) -> None:
    """Forcing with rivers, to a place of its own; the source, and what lies above or below it, is never overwritten."""
    old, new = _place(source_path), _place(path)
    if old == new or old.startswith(new.rstrip("/") + "/") or new.startswith(old.rstrip("/") + "/"):
        raise ValidationError(f"refusing to overwrite the input table {source_path}")
    write_forcing(df, path)


def write_month_staged(df: DataFrame, path: str, sort: Sequence[str] = ("ts", "k", "j", "i")) -> None:
    """Replace exactly the months in ``df``; dynamic partition overwrite keeps every other month.

    Spark stages task output and publishes it when the job commits, month by month: a job that
    fails before its commit changes nothing, a driver lost during it may leave some months old.
    """
    (
        _by_month(df, sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", COMPRESSION)
        .partitionBy(*MONTH_PARTITIONS)
        .parquet(path)
    )


def pending_months(done: DataFrame, years: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``year, month`` pairs of the wanted years that are not done yet."""
    wanted = years.select(*keys, F.col("year").cast("int").alias("year")).distinct()
    months = wanted.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    present = done.select(*keys, F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))
    return months.join(present.distinct(), [*keys, "year", "month"], "left_anti")


def model_seconds(df: DataFrame, reference: str) -> DataFrame:
    """Add whole seconds since ``reference``, the time axis a model reads."""
    origin = F.lit(reference).cast("timestamp_ntz")
    return df.withColumn("seconds", F.floor(micros_between(origin, F.col("ts")) / 1000000))
