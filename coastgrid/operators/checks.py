"""Checks, metadata and diagnostics.

Report functions return one row per checked group; the ``require_*`` functions raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.errors import CoverageError, MissingRecordError, ValidationError
from coastgrid.functions.columns import finite, raise_if_any
from coastgrid.functions.neighbours import with_prev_next
from coastgrid.functions.session import summary_table
from coastgrid.operators.interp import zero_fill
from coastgrid.operators.timeaxis import record_nearest

# Fixed value: relative tolerance of axis spacing (square root of the double epsilon).
AXIS_RTOL = 1.4901161193847656e-08

# Markers of a fetched payload that is a web page, not data.
PAGE_MARK = "<"


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, unless it is empty."""
    if df.isEmpty():
        raise MissingRecordError(message)
    return df


def require_two_columns(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> None:
    """A rotation angle needs at least two source columns."""
    narrow = df.groupBy(*keys).agg((F.max("i") - F.min("i")).alias("_span")).filter("_span < 1")
    raise_if_any(narrow, F.lit("rotation is undefined for a source with a single column"), ValidationError)


def require_variables(df: DataFrame, variables: Sequence[str]) -> None:
    """Every named variable must occur."""
    have = {r[0] for r in df.filter(F.col("variable").isin(*variables)).select("variable").distinct().collect()}
    missing = sorted(set(variables) - have)
    if missing:
        raise MissingRecordError(f"missing variable(s) {missing}")


def describe_field(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Extent, sizes, dates and vertical levels of every dataset.

    Distinct times and levels are found first (partial aggregation), so only axis
    values, never cells, are gathered per dataset.
    """
    keys = list(keys)
    extent = df.groupBy(*keys).agg(
        F.min("lon").alias("west"),
        F.max("lon").alias("east"),
        F.min("lat").alias("south"),
        F.max("lat").alias("north"),
        F.max("i").alias("nx"),
        F.max("j").alias("ny"),
        F.max("k").alias("nz"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    dates = df.select(*keys, "ts").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("ts")).alias("dates"))
    levels = df.select(*keys, "z").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("z")).alias("levels"))
    return extent.join(dates, keys).join(levels, keys)


def validate_axis(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: str,
    rtol: float = AXIS_RTOL,
    bucket_size: int = 4096,
) -> DataFrame:
    """Per axis: number of points, first spacing and whether it is regular.

    Regular means at least two points and every spacing equal to the first one
    within a relative tolerance.
    """
    keys = list(keys)
    bucket = F.floor(F.col(idx) / bucket_size)
    rows = with_prev_next(df.select(*keys, idx, value), keys, [idx], bucket, [value])
    gap = F.col(value) - F.col(f"prev.{value}")
    spaced = rows.select(*keys, idx, gap.alias("_gap"))
    # The spacings all agree with the first when the smallest and the largest do.
    stats = spaced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("_gap", F.when(F.col("_gap").isNotNull(), F.col(idx))).alias("spacing"),
        F.min("_gap").alias("_lo"),
        F.max("_gap").alias("_hi"),
    )

    def close(c: str) -> Column:
        largest = F.greatest(F.abs(F.col(c)), F.abs(F.col("spacing")))
        return F.abs(F.col(c) - F.col("spacing")) <= rtol * largest

    return stats.select(
        *keys, "points", "spacing", ((F.col("points") >= 2) & F.coalesce(close("_lo") & close("_hi"), F.lit(False))).alias("regular")
    )


def validate_target_coverage(
    nodes: DataFrame, source_grid: DataFrame, keys: Sequence[str] = ("dataset",), strict: bool = True
) -> DataFrame:
    """Per dataset: extents of the projected nodes and of the source, and whether the latter holds the former."""
    keys = list(keys)
    target = nodes.groupBy(*keys).agg(
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    )
    source = source_grid.select(
        *keys,
        F.col("x0").alias("source_x_min"),
        (F.col("x0") + (F.col("nx") - 1) * F.col("dx")).alias("source_x_max"),
        F.col("y0").alias("source_y_min"),
        (F.col("y0") + (F.col("ny") - 1) * F.col("dy")).alias("source_y_max"),
    )
    covered = (
        (F.col("x_min") >= F.col("source_x_min"))
        & (F.col("x_max") <= F.col("source_x_max"))
        & (F.col("y_min") >= F.col("source_y_min"))
        & (F.col("y_max") <= F.col("source_y_max"))
    )
    report = target.join(source, keys).withColumn("covered", covered)
    if strict:
        raise_if_any(
            report.filter(~F.col("covered")),
            F.format_string(
                "target x %s..%s, y %s..%s leaves source x %s..%s, y %s..%s",
                *[
                    F.col(c).cast("string")
                    for c in ("x_min", "x_max", "y_min", "y_max", "source_x_min", "source_x_max", "source_y_min", "source_y_max")
                ],
            ),
            CoverageError,
        )
    return report


def validate_same_geometry(
    axes: DataFrame, keys: Sequence[str] = ("dataset",), file: str = "file", strict: bool = True
) -> DataFrame:
    """Files whose axes or CRS differ from those of their dataset's first file.

    ``axes`` has one row per file and axis point, ``axis, idx, value``, and ``crs``.
    A file is summed up by order-free aggregates, so no axis is gathered in one place.
    """
    keys = list(keys)
    point = F.xxhash64("axis", "idx", "value", "crs")
    prints = axes.groupBy(*keys, file).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(point).alias("_xor"),
        F.sum((point % 1000000007).cast("long")).alias("_sum"),
    )
    fingerprint = F.struct("_n", "_xor", "_sum")
    first = prints.groupBy(*keys).agg(F.min_by(fingerprint, file).alias("_ref"))
    report = prints.join(first, keys).select(*keys, file, (fingerprint == F.col("_ref")).alias("same"))
    if strict:
        raise_if_any(
            report.filter(~F.col("same")),
            F.format_string("%s has other axes or another CRS than the first file", F.col(file)),
            ValidationError,
        )
    return report


def non_finite_counts(df: DataFrame, by: Sequence[str] = ("variable", "ts"), value: str = "value") -> DataFrame:
    """Groups that hold null, NaN or infinite values, with how many."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(~finite(F.col(value))).alias("bad"))
        .filter("bad > 0")
    )


def require_finite(df: DataFrame, by: Sequence[str] = ("variable", "ts"), value: str = "value") -> DataFrame:
    """``df`` itself, unless it holds a non-finite value."""
    raise_if_any(
        non_finite_counts(df, by, value),
        F.format_string(
            "%s holds %d non-finite value(s)", F.concat_ws(" at ", *[F.col(c).cast("string") for c in by]), F.col("bad")
        ),
        ValidationError,
    )
    return df


def validate_dims(df: DataFrame, domains: DataFrame, strict: bool = True) -> DataFrame:
    """Per domain and variable: the table's extents and whether they are the domain's.

    ``domains`` gives ``nx, ny, nz``; a face variable reaches one further along its
    own axis (``loc``).
    """
    extents = df.groupBy("grid_id", "variable", "loc").agg(
        F.max("i").alias("ni"), F.max("j").alias("nj"), F.max("k").alias("nk")
    )
    on_x = (F.substring("loc", 1, 1) == "f").cast("int")
    on_y = (F.substring("loc", 2, 1) == "f").cast("int")
    fits = (
        (F.col("ni") == F.col("nx") + on_x) & (F.col("nj") == F.col("ny") + on_y) & (F.col("nk") == F.col("nz"))
    )
    report = extents.join(domains.select("grid_id", "nx", "ny", "nz"), "grid_id").select(
        "grid_id", "variable", "ni", "nj", "nk", fits.alias("fits")
    )
    if strict:
        raise_if_any(
            report.filter(~F.col("fits")),
            F.format_string("%s is %d x %d x %d, not the extents of its grid", "variable", "ni", "nj", "nk"),
            ValidationError,
        )
    return report


def field_diagnostics(df: DataFrame, keys: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Per time: greatest speed of each component and the temperature range."""
    def of(name: str) -> Column:
        return F.when(F.col("variable") == name, F.col("value"))

    return df.groupBy(*keys, "ts").agg(
        F.max(F.abs(of("u"))).alias("max_u"),
        F.max(F.abs(of("v"))).alias("max_v"),
        F.max(F.abs(of("w"))).alias("max_w"),
        F.min(of("T")).alias("min_t"),
        F.max(of("T")).alias("max_t"),
    )


def panel_stats(surface: DataFrame, keys: Sequence[str] = ("grid_id",)) -> DataFrame:
    """Colour range and land count of every variable of a surface slice.

    The range is (0, 1) when there is no finite value or only one.
    """
    ok = finite(F.col("value"))
    stats = surface.groupBy(*keys, "variable").agg(
        F.min(F.when(ok, F.col("value"))).alias("_lo"),
        F.max(F.when(ok, F.col("value"))).alias("_hi"),
        F.count_if(~ok).alias("land"),
    )
    flat = F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi"))
    return stats.select(
        *keys,
        "variable",
        F.when(flat, F.lit(0.0)).otherwise(F.col("_lo").cast("double")).alias("low"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi").cast("double")).alias("high"),
        "land",
    )


def read_state(
    results: DataFrame,
    domains: DataFrame,
    tracers: Sequence[str],
    date: Column | None = None,
    keys: Sequence[str] = ("grid_id",),
    tolerance_seconds: float = 1.0,
    strict: bool = True,
) -> DataFrame:
    """One record of a results table as a model state.

    Takes the tracers and both velocity components, at the record nearest to ``date``
    (within the tolerance) or else the last one; no-data becomes 0.  Extents and times are
    found in one pass over the table, the record is read in another.
    """
    keys = list(keys)
    wanted = results.filter(F.col("variable").isin(*{*tracers, "u", "v"}))
    slabs = dict.fromkeys([*keys, "grid_id", "variable", "loc", "ts"])
    extents = summary_table(wanted.groupBy(*slabs).agg(*[F.max(c).alias(c) for c in ("i", "j", "k")]))
    if strict:
        validate_dims(extents, domains)
    if date is None:
        at = summary_table(extents.groupBy(*keys).agg(F.max("ts").alias("_at")))
        chosen = wanted.join(at, keys).filter(F.col("ts") == F.col("_at"))
    else:
        stamps = extents.select(*keys, "ts").distinct()
        asked = stamps.select(*keys).distinct().withColumn("date", date)
        found = summary_table(record_nearest(stamps, asked, keys, tolerance_seconds))
        if strict:
            raise_if_any(
                found.filter(~F.col("found")),
                F.format_string("no record within %s s of %s", F.lit(str(tolerance_seconds)), F.col("date").cast("string")),
                MissingRecordError,
            )
        chosen = wanted.join(found.filter("found").select(*keys, "ts"), [*keys, "ts"])
    return zero_fill(chosen).select(*keys, "variable", "ts", "k", "j", "i", "value")


def is_data(body: Column) -> Column:
    """Neither empty nor a web page, judged by the first character."""
    text = F.coalesce(body, F.lit(""))
    return (F.length(text) > 0) & ~F.startswith(text, F.lit(PAGE_MARK))


def drop_web_pages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payloads that are data."""
    return payloads.filter(is_data(F.col(body)))


def rejected_pages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Payloads to quarantine: empty ones and web pages."""
    return payloads.filter(~is_data(F.col(body)))
