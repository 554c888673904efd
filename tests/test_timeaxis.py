from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coastgrid.errors import CoverageError, MissingRecordError, ValidationError
from coastgrid.operators import timeaxis


@pytest.fixture(scope="module")
def axis(spark):
    def build(*stamps, series=1):
        rows = [(series, s.isoformat(" "), float(n)) for n, s in enumerate(stamps)]
        return spark.createDataFrame(rows, "series int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return build


def day(d, h=12):
    return datetime(2020, 1, 1) + timedelta(days=d - 1, hours=h)


def test_missing_days_are_blended(axis):
    steps = timeaxis.complete_daily(axis(day(1), day(2), day(5))).orderBy("ts").collect()
    assert [s.ts for s in steps] == [day(d) for d in range(1, 6)]
    assert [s.weight for s in steps] == pytest.approx([0, 0, 1 / 3, 2 / 3, 0])
    assert steps[1].lower_ts == steps[1].upper_ts == day(2) and (steps[2].lower_ts, steps[2].upper_ts) == (day(2), day(5))
    assert not any(s.long_gap for s in steps)
    values = timeaxis.blend_steps(timeaxis.complete_daily(axis(day(1), day(2), day(5))), axis(day(1), day(2), day(5)))
    assert [r.value for r in values.orderBy("ts").collect()] == pytest.approx([0, 1, 4 / 3, 5 / 3, 2])


def test_long_gaps_are_flagged_and_hours_left_alone(axis):
    long = timeaxis.complete_daily(axis(day(1), day(20))).collect()
    assert len(long) == 20 and sum(s.long_gap for s in long) == 18
    assert not any(s.long_gap for s in timeaxis.complete_daily(axis(day(1), day(20)), max_gap=30).collect())
    hourly = timeaxis.complete_daily(axis(day(1, 0), day(1, 1), day(3, 1))).collect()
    assert len(hourly) == 3 and not any(s.whole_day for s in hourly) and all(s.weight == 0 for s in hourly)


def test_no_data_stays_no_data(spark, axis):
    values = axis(day(1), day(3)).withColumn("value", F.when(F.col("value") == 0, F.col("value")))
    out = timeaxis.blend_steps(timeaxis.complete_daily(values), values).orderBy("ts").collect()
    assert [r.value for r in out] == [0.0, None, None]


def _pad(axis, stamps, low, high):
    records = axis(*stamps)
    windows = records.select("series").distinct().select(
        "series", F.lit(low).cast("timestamp_ntz").alias("first_needed"), F.lit(high).cast("timestamp_ntz").alias("last_needed")
    )
    steps = records.select("series", "ts", F.col("ts").alias("lower_ts"), F.col("ts").alias("upper_ts"), F.lit(0.0).alias("weight"))
    return timeaxis.pad_axis(steps, windows).orderBy("ts").collect()


def test_padding(axis):
    two = (day(1), day(2))
    assert len(_pad(axis, two, None, None)) == 2 and len(_pad(axis, two, *two)) == 2
    padded = _pad(axis, two, day(1, 0), day(3, 0))
    assert [p.ts for p in padded] == [day(1, 0), day(1), day(2), day(3, 0)]
    assert padded[0].lower_ts == day(1) and padded[-1].lower_ts == day(2)
    assert len(_pad(axis, two, day(0), day(2))) == 3 and len(_pad(axis, two, day(1), day(3))) == 3
    for low, high in ((day(0, 11), day(2)), (day(1), day(3, 13))):
        with pytest.raises(CoverageError):
            _pad(axis, two, low, high)
    with pytest.raises(CoverageError):
        _pad(axis, two[:1], day(1, 0), day(1))


def test_head_pad_becomes_the_first_spacing(axis):
    """After a half-day pad at the head, the tail may reach half a day only."""
    assert len(_pad(axis, (day(1), day(2)), day(1, 0), day(3, 0))) == 4
    with pytest.raises(CoverageError):
        _pad(axis, (day(1), day(2)), day(1, 0), day(3, 6))


def test_coverage(spark, axis):
    run = spark.createDataFrame([(1, "2020-01-01 12:00:00", 86400.4)], "series int, start_date string, stop_seconds double")
    windows = timeaxis.coverage_window(run.withColumn("start_date", F.col("start_date").cast("timestamp_ntz")))
    assert windows.first().last_needed == day(2)
    assert timeaxis.validate_coverage(axis(day(1), day(2)), windows).first().covered
    with pytest.raises(CoverageError):
        timeaxis.validate_coverage(axis(day(1), day(1, 18)), windows)


def test_gaps_and_lookups(axis):
    records = axis(day(1, 0), day(1, 1), day(1, 6))
    gap = timeaxis.gap_report(records).collect()
    assert [(g.from_ts, g.to_ts, g.gap_seconds) for g in gap] == [(day(1, 1), day(1, 6), 18000.0)]
    assert timeaxis.record_at(records, day(1, 1)).first().value == 1.0
    with pytest.raises(MissingRecordError, match="2020-01-01 00:00:00"):
        timeaxis.record_at(records, day(2))
    with pytest.raises(MissingRecordError):
        timeaxis.resolve_records(records, axis(day(1, 1), day(1, 2)))
    slots = timeaxis.resolve_records(records, axis(day(1, 1), day(1, 6))).orderBy("ts").collect()
    assert [s.slot for s in slots] == [1, 2]
    assert timeaxis.last_record(records).first().value == 2.0
    near = axis(day(1, 6) + timedelta(milliseconds=700)).select("series", F.col("ts").alias("date"))
    assert timeaxis.record_nearest(records, near).first().value == 2.0
    far = axis(day(1, 6) + timedelta(seconds=2)).select("series", F.col("ts").alias("date"))
    assert timeaxis.record_nearest(records, far).first().found is False


def test_slots_run_across_months(axis):
    stamps = [datetime(2020, 1, 30) + timedelta(days=d) for d in range(40)]
    out = timeaxis.number_slots(axis(*stamps)).orderBy("ts").collect()
    assert [r.slot for r in out] == list(range(1, 41))


@pytest.mark.parametrize(
    ("mode", "expected"),
    [("cyclical", [0.0, 0.5, 2.0, 1.0, 0.5, 2.0]), ("linear", [0.0, 0.5, 2.0, None, None, None]), ("clamp", [0.0, 0.5, 2.0, 2.0, 2.0, 0.0])],
)
def test_interpolation_modes(axis, mode, expected):
    """Records 0, 1, 2 on three days: the period is three days."""
    records = axis(day(1), day(2), day(3))
    asked = axis(day(1), day(2, 0), day(3), day(4, 0), day(4) + timedelta(hours=12), day(0)).withColumnRenamed("value", "n")
    for bucket in (1, 32):
        out = timeaxis.interpolate_at(records, asked, mode=mode, bucket_days=bucket).orderBy("n").collect()
        assert [r.value for r in out] == pytest.approx(expected)


def test_interpolation_across_empty_buckets(axis):
    records, asked = axis(day(1), day(101)), axis(day(51)).withColumnRenamed("value", "n")
    assert timeaxis.interpolate_at(records, asked, mode="linear", bucket_days=3).first().value == pytest.approx(0.5)
    with pytest.raises(ValidationError):
        timeaxis.interpolate_at(records, asked, mode="nearest")


def test_seconds_round_trip(axis):
    out = timeaxis.seconds_since(axis(day(1), day(2))).orderBy("ts").collect()
    assert [r.seconds for r in out] == [0.0, 86400.0]
    out = timeaxis.seconds_since(axis(day(1)), datetime(2020, 1, 1)).first()
    assert out.seconds == 43200.0


def test_month_hours_tile_the_month(spark):
    months = spark.createDataFrame([(2020, m) for m in range(1, 13)] + [(2021, 2)], "year int, month int")
    runs = timeaxis.forecast_runs(months).filter("year = 2020 and month = 1").orderBy("run_ts").collect()
    assert len(runs) == 1 + 31 * 4 and runs[0].run_ts == datetime(2019, 12, 31, 18) and runs[-1].run_ts == datetime(2020, 1, 31, 18)
    hours = timeaxis.month_hours(months).groupBy("year", "month").agg(F.count("ts").alias("n"), F.count_distinct("ts").alias("d"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    got = {(r.year, r.month): r for r in hours.collect()}
    assert got[2020, 2].n == got[2020, 2].d == 29 * 24 and got[2021, 2].n == 28 * 24
    assert sum(r.n for k, r in got.items() if k[0] == 2020) == 366 * 24
    assert got[2020, 1].a == datetime(2020, 1, 1) and got[2020, 12].b == datetime(2020, 12, 31, 23)


def test_deaccumulation_stays_inside_a_run(spark):
    rows = [(1, f"2020-01-01 {run:02d}:00:00", lead, 3600.0 * lead * (1 + run)) for run in (0, 6) for lead in range(3, 11)]
    runs = spark.createDataFrame(rows, "cell int, run_ts string, lead_h int, acc double").withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))
    out = timeaxis.deaccumulate(runs).orderBy("ts").collect()
    assert [r.flux for r in out] == [1.0] * 6 + [7.0] * 6
    assert [r.ts.hour for r in out] == list(range(4, 16))
