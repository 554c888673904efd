"""Time axes: completing, padding, checking, blending and de-accumulating.

A record is ``series, ts``; a step is ``series, ts, lower_ts, upper_ts, weight``.
Time stamps are TIMESTAMP_NTZ throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coastgrid.errors import CoverageError, MissingRecordError, require
from coastgrid.functions.columns import interval_seconds, micros, micros_between, raise_if_any
from coastgrid.functions.neighbours import with_prev_next
from coastgrid.functions.session import never_broadcast, summary_table

# Longest unflagged run of missing days, and the forecast layout.
MAX_GAP_DAYS = 6
DAY_MICROS = 86400000000
RUN_HOURS = 6
FIRST_LEAD, LAST_LEAD = 4, 9
SECONDS_PER_LEAD = 3600


def month_bucket(ts: str = "ts") -> Column:
    """Monotone bucket that spreads one long series over its months."""
    return F.year(ts) * 12 + F.month(ts)


def complete_daily(records: DataFrame, keys: Sequence[str] = ("series",), max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Fill missing days of day-spaced series with blends of the bracketing records.

    ``whole_day`` is false for a series with any other spacing, which is left alone.
    ``long_gap`` marks steps inside a run of more than ``max_gap`` missing days.
    """
    keys = list(keys)
    gaps = with_prev_next(records.select(*keys, "ts"), keys, ["ts"], month_bucket(), ["ts"]).select(
        *keys, "ts", F.col("next.ts").alias("_next")
    )
    gaps = gaps.withColumn("_gap", micros_between(F.col("ts"), F.col("_next")))
    cadence = summary_table(
        gaps.groupBy(*keys).agg(
            F.coalesce(F.bool_and(F.col("_gap") % DAY_MICROS == 0), F.lit(True)).alias("whole_day")
        )
    )
    span = F.when(F.col("whole_day") & F.col("_gap").isNotNull(), F.floor(F.col("_gap") / DAY_MICROS)).otherwise(1)
    step = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("_span"), F.lit(1)) - 1),
        lambda m: F.struct(
            (F.col("ts") + F.make_dt_interval(days=m)).alias("_ts"),
            F.col("ts").alias("lower_ts"),
            F.when(m == 0, F.col("ts")).otherwise(F.col("_next")).alias("upper_ts"),
            (m / F.col("_span")).alias("weight"),
        ),
    )
    steps = (
        gaps.join(cadence, keys)
        .withColumn("_span", span.cast("int"))
        .select(*keys, "whole_day", "_span", F.inline(step))
        .select(
            *keys,
            F.col("_ts").alias("ts"),
            "lower_ts",
            "upper_ts",
            "weight",
            "whole_day",
            ((F.col("weight") > 0) & (F.col("_span") > max_gap + 1)).alias("long_gap"),
        )
    )
    # A step a day out of a row a gap.
    return never_broadcast(steps)


def pad_axis(
    steps: DataFrame, windows: DataFrame, keys: Sequence[str] = ("series",), strict: bool = True
) -> DataFrame:
    """Replicate the end steps where an axis falls short of its window.

    ``windows`` has ``keys, first_needed, last_needed``; a series without a window, or
    with NULL bounds, is unchanged.  A pad reaches at most one record spacing (that of
    the first pair) past the axis.  ``strict`` raises otherwise; without it the
    offending pad is left out.
    """
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in steps.columns])
    rest = [c for c in steps.columns if c not in (*keys, "ts")]
    ends = summary_table(
        steps.groupBy(*keys).agg(
            F.min_by(row, "ts").alias("_head"), F.max_by(row, "ts").alias("_tail"), F.min("ts").alias("_first")
        )
    )
    # The second stamp needs only the minimum of the stamps after the first.
    second = (
        steps.join(ends.select(*keys, "_first"), keys)
        .filter(F.col("ts") > F.col("_first"))
        .groupBy(*keys)
        .agg(F.min("ts").alias("_second"))
    )
    plan = summary_table(ends.join(windows, keys).join(second, keys, "left"))
    head, tail = F.col("_head.ts"), F.col("_tail.ts")
    plan = plan.withColumns(
        {
            "_short": head > F.col("first_needed"),
            "_early": tail < F.col("last_needed"),
            # A head pad changes the first pair, and with it the spacing that bounds the tail pad.
            "_spacing": micros_between(F.col("_first"), F.col("_second")),
        }
    ).withColumns(
        {
            "_head_gap": micros_between(F.col("first_needed"), head),
            "_tail_gap": micros_between(tail, F.col("last_needed")),
        }
    )
    plan = plan.withColumn(
        "_tail_spacing", F.when(F.col("_short"), F.col("_head_gap")).otherwise(F.col("_spacing"))
    )
    head_ok = F.coalesce(F.col("_head_gap") <= F.col("_spacing"), F.lit(False))
    tail_ok = F.coalesce(F.col("_tail_gap") <= F.col("_tail_spacing"), F.lit(False))
    if strict:
        bad = plan.filter((F.col("_short") & ~head_ok) | (F.col("_early") & ~tail_ok))
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        raise_if_any(
            bad,
            F.format_string(
                "axis of %s runs %s to %s, more than one record spacing short of %s to %s",
                name,
                head.cast("string"),
                tail.cast("string"),
                F.col("first_needed").cast("string"),
                F.col("last_needed").cast("string"),
            ),
            CoverageError,
        )

    def pad(where: Column, at: str, end: str) -> DataFrame:
        return plan.filter(where).select(
            *keys, F.col(at).alias("ts"), *[F.col(f"{end}.{c}").alias(c) for c in rest]
        )

    pads = pad(F.col("_short") & head_ok, "first_needed", "_head").unionByName(
        pad(F.col("_early") & tail_ok, "last_needed", "_tail")
    )
    return steps.unionByName(pads)


def coverage_window(df: DataFrame, start: str = "start_date", stop_seconds: str = "stop_seconds") -> DataFrame:
    """The window a run needs: its start and start plus the rounded stop time."""
    whole = F.rint(F.col(stop_seconds))
    return df.withColumns(
        {"first_needed": F.col(start), "last_needed": F.col(start) + interval_seconds(whole)}
    )


def validate_coverage(
    df: DataFrame, windows: DataFrame, keys: Sequence[str] = ("series",), strict: bool = True
) -> DataFrame:
    """One row per series: its extent, its window and whether it is covered.

    A NULL window is skipped (covered).
    """
    extent = df.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    covered = (F.col("first_ts") <= F.col("first_needed")) & (F.col("last_ts") >= F.col("last_needed"))
    skipped = F.col("first_needed").isNull() | F.col("last_needed").isNull()
    report = extent.join(windows, list(keys)).select(
        *keys,
        "first_ts",
        "last_ts",
        "first_needed",
        "last_needed",
        F.when(skipped, F.lit(True)).otherwise(covered).alias("covered"),
    )
    if strict:
        raise_if_any(
            report.filter(~F.col("covered")),
            F.format_string(
                "data run %s to %s but %s to %s is needed",
                *[F.col(c).cast("string") for c in ("first_ts", "last_ts", "first_needed", "last_needed")],
            ),
            CoverageError,
        )
    return report


def gap_report(
    records: DataFrame, keys: Sequence[str] = ("series",), expected_seconds: int = 3600
) -> DataFrame:
    """Every pair of neighbouring records whose spacing is not the expected one."""
    keys = list(keys)
    pairs = with_prev_next(records.select(*keys, "ts"), keys, ["ts"], month_bucket(), ["ts"])
    gap = micros_between(F.col("prev.ts"), F.col("ts"))
    return (
        pairs.select(*keys, F.col("prev.ts").alias("from_ts"), F.col("ts").alias("to_ts"), gap.alias("_gap"))
        .filter(F.col("_gap") != expected_seconds * 1000000)
        .select(*keys, "from_ts", "to_ts", (F.col("_gap") / 1000000).alias("gap_seconds"))
    )


def select_range(records: DataFrame, start: datetime | Column | None, end: datetime | Column | None) -> DataFrame:
    """Records between two dates, both included; an open side is None."""
    out = records
    if start is not None:
        out = out.filter(F.col("ts") >= (start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        out = out.filter(F.col("ts") <= (end if isinstance(end, Column) else F.lit(end).cast("timestamp_ntz")))
    return out


def number_slots(records: DataFrame, keys: Sequence[str] = ("series",), by: str = "ts") -> DataFrame:
    """1-based ``slot`` of every record of a series in time order.

    Positions inside a month are ranked there; months before it are added as counts,
    so no series is ranked in one task.
    """
    keys = list(keys)
    rows = records.withColumn("_month", month_bucket(by))
    running = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_month").count().select(
        *keys, "_month", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_month").orderBy(by)
    return (
        rows.join(counts, [*keys, "_month"])
        .withColumn("slot", (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
        .drop("_month", "_before")
    )


def resolve_records(
    records: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("series",), strict: bool = True
) -> DataFrame:
    """The record of every requested date, with its slot among the requested ones.

    Every requested date must exist; ``strict=False`` returns the missing ones with
    NULL record columns instead of raising.
    """
    keys = list(keys)
    slots = number_slots(wanted.select(*keys, "ts").distinct(), keys)
    found = slots.join(records.withColumn("_found", F.lit(True)), [*keys, "ts"], "left")
    if strict:
        raise_if_any(
            found.filter(F.col("_found").isNull()),
            F.format_string("no record at %s", F.col("ts").cast("string")),
            MissingRecordError,
        )
    return found.drop("_found")


def blend_steps(
    steps: DataFrame,
    values: DataFrame,
    keys: Sequence[str] = ("series",),
    cell: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """The value of every step: one record, or ``(1 - w) lower + w upper``.

    Only true blends are regrouped, once per pair of records whatever the number of steps between them;
    all other rows go straight through.  No-data in either record stays no-data.
    """
    keys, cell = list(keys), list(cell)
    pair = ["lower_ts", "upper_ts"]
    source = values.select(*keys, F.col("ts").alias("src_ts"), *cell, value)
    plain = steps.filter(~(F.col("weight") > 0)).select(*keys, "ts", F.col("lower_ts").alias("src_ts"))
    single = source.join(plain, [*keys, "src_ts"]).select(*keys, "ts", *cell, value)
    blends = steps.filter(F.col("weight") > 0).select(*keys, "ts", *pair, "weight")
    ends = F.inline(F.array(*[F.struct(F.col(c).alias("src_ts"), F.lit(c).alias("_end")) for c in pair]))
    at_end = {c: F.max(F.when(F.col("_end") == c, F.col(value))) for c in pair}
    met = (
        source.join(blends.select(*keys, *pair).distinct().select("*", ends), [*keys, "src_ts"])
        .groupBy(*keys, *pair, *cell)
        .agg(at_end["lower_ts"].alias("_lower"), at_end["upper_ts"].alias("_upper"), F.count(value).alias("_n"))
    )
    blend = (1 - F.col("weight")) * F.col("_lower") + F.col("weight") * F.col("_upper")
    mixed = met.join(blends, [*keys, *pair]).select(*keys, "ts", *cell, F.when(F.col("_n") == 2, blend).alias(value))
    return single.unionByName(mixed)


def seconds_since(
    df: DataFrame, reference: datetime | None = None, keys: Sequence[str] = ("series",), out: str = "seconds"
) -> DataFrame:
    """Seconds from a common instant, by default the first record of each series."""
    if reference is not None:
        origin = F.lit(reference).cast("timestamp_ntz")
        return df.withColumn(out, micros_between(origin, F.col("ts")) / 1000000)
    first = summary_table(df.groupBy(*keys).agg(F.min("ts").alias("_origin")))
    return (
        df.join(first, list(keys))
        .withColumn(out, micros_between(F.col("_origin"), F.col("ts")) / 1000000)
        .drop("_origin")
    )


def instant_from_seconds(df: DataFrame, reference: str, seconds: str, out: str = "ts") -> DataFrame:
    """Inverse of ``seconds_since``, rounded to milliseconds."""
    return df.withColumn(out, F.col(reference) + interval_seconds(F.round(F.col(seconds), 3)))


def interpolate_at(
    records: DataFrame,
    instants: DataFrame,
    keys: Sequence[str] = ("series",),
    mode: str = "cyclical",
    bucket_days: int = 32,
) -> DataFrame:
    """Values at arbitrary instants, linear between the bracketing records.

    Outside the axis ``clamp`` takes the end record, ``linear`` gives NULL and
    ``cyclical`` wraps with a period of the axis span plus its first spacing, so the
    stretch between the last record and the first of the next period is linear too.
    Records are unique per series and time.  Both sides are windowed in buckets of
    ``bucket_days``; one summary row per bucket carries records across.
    """
    require(mode in ("cyclical", "linear", "clamp"), f"unknown mode {mode!r}")
    keys = list(keys)
    source = records.select(*keys, micros(F.col("ts")).alias("_t"), F.col("value").alias("_v"))
    extent = source.groupBy(*keys).agg(
        F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.min_by("_v", "_t").alias("_v0"), F.max_by("_v", "_t").alias("_v1")
    )
    second = (
        source.join(extent.select(*keys, "_t0"), keys)
        .filter("_t > _t0")
        .groupBy(*keys)
        .agg((F.min("_t") - F.min("_t0")).alias("_spacing"))
    )
    extent = summary_table(
        extent.join(second, keys, "left").withColumn(
            "_period", F.col("_t1") - F.col("_t0") + F.coalesce("_spacing", F.lit(DAY_MICROS))
        )
    )
    want = instants.withColumn("_want", micros(F.col("ts"))).join(extent, keys)
    if mode == "cyclical":
        position = F.col("_t0") + F.pmod(F.col("_want") - F.col("_t0"), F.col("_period"))
    else:
        position = F.col("_want")
    bucket = F.floor(F.col("_t") / (bucket_days * DAY_MICROS))
    asked = want.withColumn("_t", position).withColumn("_bucket", bucket)
    source = source.withColumn("_bucket", bucket)
    point = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))
    # Buckets of either side, each with the nearest record before and after it.
    edges = (
        source.groupBy(*keys, "_bucket")
        .agg(F.min_by(point, "_t").alias("_lo"), F.max_by(point, "_t").alias("_hi"))
        .unionByName(asked.select(*keys, "_bucket").distinct(), allowMissingColumns=True)
        .groupBy(*keys, "_bucket")
        .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    )
    axis = Window.partitionBy(*keys).orderBy("_bucket")
    carried = edges.select(
        *keys,
        "_bucket",
        F.last("_hi", ignorenulls=True).over(axis.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True).over(axis.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    payload = [c for c in instants.columns if c not in keys]
    merged = source.select(*keys, "_bucket", "_t", point.alias("_rec"), F.lit(0).alias("_kind")).unionByName(
        asked.select(
            *keys, "_bucket", "_t", F.lit(1).alias("_kind"), "_t0", "_t1", "_v0", "_v1", "_period", *payload
        ),
        allowMissingColumns=True,
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_kind")
    back = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_t"), "_kind")
    found = (
        merged.withColumn("_prev", F.last("_rec", ignorenulls=True).over(inside))
        .withColumn("_next", F.last("_rec", ignorenulls=True).over(back))
        .filter("_kind = 1")
        .join(carried, [*keys, "_bucket"])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
        .withColumn("_next", F.coalesce("_next", "_after"))
    )
    if mode == "cyclical":
        wrap = F.struct((F.col("_t0") + F.col("_period")).alias("t"), F.col("_v0").alias("v"))
        found = found.withColumn("_next", F.coalesce("_next", wrap))
    elif mode == "clamp":
        found = found.withColumn("_next", F.coalesce("_next", "_prev")).withColumn(
            "_prev", F.coalesce("_prev", "_next")
        )
    width = F.col("_next.t") - F.col("_prev.t")
    w = F.when(width == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_t") - F.col("_prev.t"), width))
    value = F.when(w == 0, F.col("_prev.v")).otherwise((1 - w) * F.col("_prev.v") + w * F.col("_next.v"))
    return found.withColumn("value", value).select(*keys, *payload, "value")


def record_at(df: DataFrame, date: datetime, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The records at exactly ``date``; an empty result raises with the axis range."""
    out = df.filter(F.col("ts") == F.lit(date).cast("timestamp_ntz"))
    if out.isEmpty():
        low, high = df.agg(F.min("ts"), F.max("ts")).first()
        raise MissingRecordError(f"no record at {date}; the axis runs from {low} to {high}")
    return out


def record_nearest(
    df: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("series",), tolerance_seconds: float = 1.0
) -> DataFrame:
    """The record nearest to each series' wanted ``date``, with ``found`` false beyond the tolerance.

    Only records within the tolerance are compared, so the aggregate stays small.
    """
    keys = list(keys)
    distance = F.abs(micros_between(F.col("date"), F.col("ts")))
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    near = (
        df.join(wanted.select(*keys, "date"), keys)
        .filter(distance <= int(tolerance_seconds * 1000000))
        .groupBy(*keys, "date")
        .agg(F.min_by(row, F.struct(distance, F.col("ts"))).alias("_r"))
    )
    return (
        wanted.select(*keys, "date")
        .join(near, [*keys, "date"], "left")
        .select(*keys, "date", "_r.*", F.col("_r").isNotNull().alias("found"))
    )


def last_record(df: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The rows at the last time of every series."""
    last = summary_table(df.groupBy(*keys).agg(F.max("ts").alias("_last")))
    return df.join(last, list(keys)).filter(F.col("ts") == F.col("_last")).drop("_last")


def forecast_runs(months: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs that supply a month: 18Z of the day before, then 00, 06, 12 and 18Z of each day.

    ``months`` has INT columns ``year, month``.
    """
    first = F.make_date("year", "month", F.lit(1)).cast("timestamp_ntz")
    end = F.add_months(F.make_date("year", "month", F.lit(1)), 1).cast("timestamp_ntz")
    step = F.make_dt_interval(hours=F.lit(RUN_HOURS))
    runs = F.sequence(first - step, end - step, step)
    return months.select(*keys, "year", "month", F.explode(runs).alias("run_ts"))


def month_hours(months: DataFrame, keys: Sequence[str] = (), first: int = FIRST_LEAD, last: int = LAST_LEAD) -> DataFrame:
    """Every hour of a month with the one run and lead that supply it."""
    leads = F.sequence(F.lit(first), F.lit(last))
    hours = forecast_runs(months, keys).withColumn("lead_h", F.explode(leads))
    hours = hours.withColumn("ts", F.col("run_ts") + F.make_dt_interval(hours=F.col("lead_h")))
    return hours.filter((F.year("ts") == F.col("year")) & (F.month("ts") == F.col("month")))


def select_leads(df: DataFrame, first: int = FIRST_LEAD, last: int = LAST_LEAD) -> DataFrame:
    """Keep the leads that tile the day; ``ts`` is the valid time."""
    return df.filter(F.col("lead_h").between(first, last)).withColumn(
        "ts", F.col("run_ts") + F.make_dt_interval(hours=F.col("lead_h"))
    )


def deaccumulate(
    df: DataFrame,
    cell: Sequence[str] = ("cell",),
    accumulated: str | Mapping[str, str] = "acc",
    seconds: int = SECONDS_PER_LEAD,
    first: int = FIRST_LEAD,
    last: int = LAST_LEAD,
    out: str = "flux",
) -> DataFrame:
    """Mean rate over the hour that ends at each lead, within one run.

    The lead before ``first`` serves only as the lower end of the first difference.
    A run has a handful of leads per cell, so no window group can grow large.  ``accumulated``
    is the column whose rate becomes ``out``, or several as ``{out: column}``, in one window.
    """
    run = Window.partitionBy("run_ts", *cell).orderBy("lead_h")
    follows = F.lag("lead_h").over(run) == F.col("lead_h") - 1
    columns = {out: accumulated} if isinstance(accumulated, str) else accumulated
    rates = {name: (F.col(c) - F.when(follows, F.lag(c).over(run))) / F.lit(float(seconds)) for name, c in columns.items()}
    leads = df.filter(F.col("lead_h").between(first - 1, last)).withColumns(rates)
    return select_leads(leads, first, last)
