"""Table and file sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastgrid.errors import MissingRecordError, ValidationError
from coastgrid.functions.columns import raise_if_any
from coastgrid.operators.checks import validate_dims

# Fixed value: columns of an outlet file, in file order (latitude comes first).
OUTLET_SCHEMA = "`River number` STRING, Name STRING, LatOutlet STRING, LonOutlet STRING, Zero STRING"


def read_records(
    spark: SparkSession, path: str, years: Iterable[int], months: Iterable[int] = range(1, 13), strict: bool = True
) -> DataFrame:
    """Time records of the chosen years from a table partitioned by ``year, month``.

    The filter is on partition columns, so other months are never listed or read; a
    month that does not exist adds nothing.  Nothing at all is an error.
    """
    years, months = sorted(set(years)), sorted(set(months))
    out = spark.read.parquet(path).filter(F.col("year").isin(years) & F.col("month").isin(months))
    if strict and out.isEmpty():
        raise MissingRecordError(f"no records for years {years}, months {months} under {path}")
    return out


def dedupe_records(
    df: DataFrame, by: Sequence[str] = ("series", "ts"), tiebreak: Sequence[str] = ("file", "idx")
) -> DataFrame:
    """One record per date: the first in ``tiebreak`` order.

    An aggregate, so duplicates collapse before the shuffle however many there are.
    """
    rest = [c for c in df.columns if c not in by]
    row, order = F.struct(*rest), F.struct(*tiebreak)
    return df.groupBy(*by).agg(F.min_by(row, order).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_outlets(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """River outlets from CSV: ``river_id, name, lon, lat``.

    The header and blank lines are skipped and names trimmed.  A line with fewer than
    four fields or an unreadable number is an error, and so is a file without rivers.
    """
    raw = spark.read.csv(
        path, schema=OUTLET_SCHEMA, header=True, mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True
    )
    blank = F.coalesce(*[F.col(f"`{c}`") for c in raw.columns]).isNull()
    lines = raw.filter(~blank).select(
        F.trim("`River number`").try_cast("int").alias("river_id"),
        F.trim("Name").alias("name"),
        F.trim("LonOutlet").try_cast("double").alias("lon"),
        F.trim("LatOutlet").try_cast("double").alias("lat"),
    )
    broken = F.col("river_id").isNull() | F.col("name").isNull() | F.col("lon").isNull() | F.col("lat").isNull()
    if strict:
        raise_if_any(
            lines.filter(broken),
            F.format_string("malformed river line: %s", F.to_json(F.struct("river_id", "name", "lon", "lat"))),
            ValidationError,
        )
        if lines.isEmpty():
            raise ValidationError(f"no rivers found in {path}")
    return lines


def read_field(
    df: DataFrame, domains: DataFrame, variables: Sequence[str], strict: bool = True
) -> DataFrame:
    """Requested variables plus the velocity components, as far as the table has them.

    Tables whose extents differ from the grid's are rejected (``strict``), or left out.
    NaN becomes NULL.
    """
    wanted = df.filter(F.col("variable").isin(*{*variables, "u", "v"}))
    report = validate_dims(wanted, domains, strict=strict)
    if not strict:
        wanted = wanted.join(report.filter("fits").select("grid_id", "variable"), ["grid_id", "variable"], "left_semi")
    return wanted.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Fetched text files, one row each: ``path, body``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
