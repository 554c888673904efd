"""Small Column helpers used across the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.errors import ValidationError

EDGES = ("south", "north", "west", "east")


def check_edge(edge: str) -> str:
    """Return ``edge`` if it names a lateral side of a domain."""
    if edge not in EDGES:
        raise ValidationError(f"edge must be one of {EDGES}, got {edge!r}")
    return edge


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    d = value.cast("double")
    return F.coalesce(
        ~F.isnan(d) & (d != F.lit(float("inf"))) & (d != F.lit(float("-inf"))), F.lit(False)
    )


def null_if_not_finite(value: Column) -> Column:
    """NaN and infinities become the library's one no-data value, NULL."""
    return F.when(finite(value), value)


def null_if_nan(value: Column) -> Column:
    """NaN becomes NULL; infinities stay visible to the finiteness gate."""
    return F.when(~F.isnan(value.cast("double")), value)


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end`` (both TIMESTAMP_NTZ), free of any time zone."""
    gap = end - start
    whole = (F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)) * 60 + F.extract(
        F.lit("MINUTE"), gap
    )
    seconds = (F.extract(F.lit("SECOND"), gap) * 1000000).cast("bigint")
    return whole.cast("bigint") * 60000000 + seconds


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, as BIGINT."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def interval_seconds(seconds: Column) -> Column:
    """A day-time interval of ``seconds`` (fractions allowed)."""
    return F.make_dt_interval(secs=seconds)


def check_columns(df: DataFrame, needed: Sequence[str], what: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValidationError(f"{what} lacks column(s) {missing}; it has {df.columns}")


def raise_if_any(bad: DataFrame, message: Column, error: type[Exception]) -> None:
    """Raise ``error`` with up to five rendered examples when ``bad`` has rows."""
    shown = [r[0] for r in bad.select(message.alias("m")).limit(5).collect()]
    if shown:
        raise error("; ".join(str(s) for s in shown))
