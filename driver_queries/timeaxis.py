"""Time-axis queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from coastgrid import sources
from coastgrid.operators import timeaxis
from driver_queries import fixtures as fx

def t1_complete_daily(spark, sf):
    out = timeaxis.complete_daily(fx.daily(spark, sf))
    return out.withColumn("weight", F.round("weight", 6))


STEPS = """gaps AS (SELECT series, ts, value, lead(ts) OVER w AS nxt FROM daily WINDOW w AS (PARTITION BY series ORDER BY ts)),
spans AS (SELECT *, coalesce(date_diff('day', ts, nxt), 1) AS span FROM gaps),
steps AS (
  SELECT series, ts + m * INTERVAL 1 DAY AS ts, ts AS lower_ts, CASE WHEN m = 0 THEN ts ELSE nxt END AS upper_ts,
         m / CAST(span AS DOUBLE) AS weight, true AS whole_day, m > 0 AND span > 7 AS long_gap
  FROM spans, LATERAL (SELECT unnest(generate_series(0, span - 1)) AS m))"""
T1_SQL = f"WITH {fx.D_DAILY}, {STEPS} SELECT series, ts, lower_ts, upper_ts, round(weight, 6) AS weight, whole_day, long_gap FROM steps"


def t1_complete_hourly(spark, sf):
    """Hourly series are not on a whole-day cadence and stay as they are."""
    rec = fx.records(spark, sf).select("series", "ts").distinct()
    return timeaxis.complete_daily(rec)


T1_HOURLY_SQL = f"""WITH {fx.D_RECORDS}, d AS (SELECT DISTINCT series, ts FROM rec),
g AS (SELECT *, date_diff('hour', ts, lead(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM d),
c AS (SELECT series, coalesce(bool_and(gap % 24 = 0), true) AS whole_day FROM g GROUP BY 1)
SELECT series, ts, ts AS lower_ts, ts AS upper_ts, 0e0 AS weight, whole_day, false AS long_gap FROM d JOIN c USING (series)"""


def _windows(spark, sf):
    """Windows half a day wider than the axes on either side; every third series has none."""
    ends = fx.daily(spark, sf).groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    half = F.make_dt_interval(hours=F.lit(12))
    none = F.col("series") % 3 == 0
    return ends.select(
        "series",
        F.when(~none, F.col("a") - half).alias("first_needed"),
        F.when(~none, F.col("b") + half).alias("last_needed"),
    )


def t2_pad_axis(spark, sf):
    steps = timeaxis.complete_daily(fx.daily(spark, sf)).drop("whole_day", "long_gap")
    return timeaxis.pad_axis(steps, _windows(spark, sf)).withColumn("weight", F.round("weight", 6))


T2_SQL = f"""WITH {fx.D_DAILY}, {STEPS},
e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM daily GROUP BY 1),
padded AS (
  SELECT series, ts, lower_ts, upper_ts, weight FROM steps
  UNION ALL SELECT s.series, a - INTERVAL 12 HOUR, lower_ts, upper_ts, weight FROM steps s JOIN e ON s.series = e.series AND s.ts = e.a AND s.series % 3 <> 0
  UNION ALL SELECT s.series, b + INTERVAL 12 HOUR, lower_ts, upper_ts, weight FROM steps s JOIN e ON s.series = e.series AND s.ts = e.b AND s.series % 3 <> 0)
SELECT series, ts, lower_ts, upper_ts, round(weight, 6) AS weight FROM padded"""


def t3_coverage_window(spark, sf):
    runs = fx.ntz(fx.run(spark, sf, "SELECT o_orderkey, o_orderdate AS start_date, o_totalprice AS stop_seconds FROM {orders}"), "start_date")
    return timeaxis.coverage_window(runs)


T3_SQL = """SELECT o_orderkey, o_orderdate AS start_date, o_totalprice AS stop_seconds, o_orderdate AS first_needed,
o_orderdate + CAST(round_even(o_totalprice, 0) AS BIGINT) * INTERVAL 1 SECOND AS last_needed FROM orders"""


def t4_validate_coverage(spark, sf):
    windows = _windows(spark, sf).withColumn(
        "first_needed", F.col("first_needed") + F.make_dt_interval(hours=(F.col("series") % 2) * 12)
    ).withColumn("last_needed", F.col("last_needed") - F.make_dt_interval(hours=F.lit(12)))
    return timeaxis.validate_coverage(fx.daily(spark, sf), windows, strict=False)


T4_SQL = f"""WITH {fx.D_DAILY}, e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM daily GROUP BY 1)
SELECT series, a AS first_ts, b AS last_ts,
       CASE WHEN series % 3 <> 0 THEN a - (1 - series % 2) * INTERVAL 12 HOUR END AS first_needed,
       CASE WHEN series % 3 <> 0 THEN b END AS last_needed, series % 3 = 0 OR series % 2 = 1 AS covered FROM e"""


def _hourly(spark, sf):
    return sources.dedupe_records(fx.records(spark, sf))


D_HOURLY = f"""{fx.D_RECORDS},
dd AS (SELECT series, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY series, ts ORDER BY file, idx) AS rn FROM rec) WHERE rn = 1)"""


def t5_gap_report(spark, sf):
    return timeaxis.gap_report(_hourly(spark, sf))


T5_SQL = f"""WITH {D_HOURLY}
SELECT * FROM (SELECT series, lag(ts) OVER w AS from_ts, ts AS to_ts,
               CAST(date_diff('second', lag(ts) OVER w, ts) AS DOUBLE) AS gap_seconds FROM dd
               WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE gap_seconds <> 3600"""


def t6_select_range(spark, sf):
    low, high = (F.lit(v).cast("timestamp_ntz") for v in ("2024-01-05 00:00:00", "2024-01-20 06:00:00"))
    chosen = timeaxis.select_range(_hourly(spark, sf), low, high)
    return timeaxis.number_slots(chosen).select("series", "ts", "slot")


RANGE = "ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 06:00:00'"
T6_SQL = f"""WITH {D_HOURLY}
SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) AS slot FROM dd WHERE {RANGE}"""


def t6_resolve_records(spark, sf):
    """Every hour of one user is asked of the next user; hours without a record come back empty."""
    wanted = fx.records(spark, sf).select((F.col("series") + 1).alias("series"), "ts")
    return timeaxis.resolve_records(_hourly(spark, sf).select("series", "ts", "value"), wanted, strict=False)


T6_RESOLVE_SQL = f"""WITH {D_HOURLY}, w AS (SELECT DISTINCT series + 1 AS series, ts FROM rec)
SELECT w.series, w.ts, row_number() OVER (PARTITION BY w.series ORDER BY w.ts) AS slot, dd.value
FROM w LEFT JOIN dd ON dd.series = w.series AND dd.ts = w.ts"""


def t7_blend_steps(spark, sf):
    daily = fx.daily(spark, sf)
    return timeaxis.blend_steps(timeaxis.complete_daily(daily), daily)


T7_SQL = f"""WITH {fx.D_DAILY}, {STEPS}
SELECT s.series, s.ts, (1 - weight) * a.value + weight * b.value AS value
FROM steps s JOIN daily a ON a.series = s.series AND a.ts = s.lower_ts JOIN daily b ON b.series = s.series AND b.ts = s.upper_ts"""


def t8_seconds_since(spark, sf):
    return timeaxis.seconds_since(_hourly(spark, sf)).select("series", "ts", "seconds")


T8_SQL = f"""WITH {D_HOURLY}
SELECT series, ts, CAST(date_diff('second', min(ts) OVER (PARTITION BY series), ts) AS DOUBLE) AS seconds FROM dd"""


def t8_instant_from_seconds(spark, sf):
    first = _hourly(spark, sf).groupBy("series").agg(F.min("ts").alias("origin"))
    timed = timeaxis.seconds_since(_hourly(spark, sf)).select("series", "seconds").join(first, "series")
    return timeaxis.instant_from_seconds(timed, "origin", "seconds").select("series", "ts")


T8_INSTANT_SQL = f"WITH {D_HOURLY} SELECT series, ts FROM dd"


def _interpolated(mode):
    def query(spark, sf):
        """Hourly user series asked at every event's own instant, ten days later."""
        asked = fx.run(spark, sf, "SELECT CAST(user_id AS INT) AS series, event_id, ts FROM {events}")
        asked = fx.ntz(asked, "ts").withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(10)))
        out = timeaxis.interpolate_at(_hourly(spark, sf).select("series", "ts", "value"), asked, mode=mode)
        return out.select("series", "event_id", F.round("value", 5).alias("value"))

    return query


def _interpolated_sql(mode):
    position = "t0 + (((want - t0) % period) + period) % period" if mode == "cyclical" else "want"
    after = {"cyclical": "coalesce(n.t, t0 + period)", "linear": "n.t", "clamp": "coalesce(n.t, p.t)"}[mode]
    after_v = {"cyclical": "coalesce(n.value, v0)", "linear": "n.value", "clamp": "coalesce(n.value, p.value)"}[mode]
    before, before_v = ("coalesce(p.t, n.t)", "coalesce(p.value, n.value)") if mode == "clamp" else ("p.t", "p.value")
    return f"""WITH {D_HOURLY},
h AS (SELECT series, epoch_us(ts) AS t, value FROM dd),
x AS (SELECT series, min(t) AS t0, max(t) AS t1, arg_min(value, t) AS v0,
             max(t) - min(t) + coalesce(list_sort(list(t))[2] - min(t), 86400000000) AS period FROM h GROUP BY 1),
a AS (SELECT CAST(user_id AS INT) AS series, event_id, epoch_us(ts) + 864000000000 AS want FROM events),
q AS (SELECT a.series, event_id, {position} AS t, t0, period, v0 FROM a JOIN x USING (series)),
b AS (SELECT q.*, (SELECT max(t) FROM h WHERE h.series = q.series AND h.t <= q.t) AS tp,
             (SELECT min(t) FROM h WHERE h.series = q.series AND h.t >= q.t) AS tn FROM q),
r AS (SELECT b.series, event_id, b.t, {before} AS p, {before_v} AS pv, {after} AS n, {after_v} AS nv
      FROM b LEFT JOIN h p ON p.series = b.series AND p.t = b.tp LEFT JOIN h n ON n.series = b.series AND n.t = b.tn)
SELECT series, event_id, round(CASE WHEN n = p OR t = p THEN pv
  ELSE (1 - (t - p) / CAST(n - p AS DOUBLE)) * pv + (t - p) / CAST(n - p AS DOUBLE) * nv END, 5) AS value FROM r"""


def t10_record_at(spark, sf):
    return timeaxis.record_at(_hourly(spark, sf), datetime(2024, 1, 1)).select("series", "ts", "value")


T10_SQL = f"WITH {D_HOURLY} SELECT series, ts, value FROM dd WHERE ts = TIMESTAMP '2024-01-01 00:00:00'"


def t11_record_nearest(spark, sf):
    """The event nearest to each user's five-hundred-thousandth second, within half a day."""
    events = fx.ntz(fx.run(spark, sf, "SELECT CAST(user_id AS INT) AS series, ts, event_id, value FROM {events}"), "ts")
    asked = events.select("series").distinct().withColumn("date", F.lit("2024-01-06 18:53:20").cast("timestamp_ntz"))
    return timeaxis.record_nearest(events, asked, tolerance_seconds=43200.0)


T11_SQL = """WITH e AS (SELECT CAST(user_id AS INT) AS series, ts, event_id, value, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-06 18:53:20')) AS d FROM events),
u AS (SELECT DISTINCT series FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d, ts) AS rn FROM e WHERE d <= 43200000000)
SELECT u.series, TIMESTAMP '2024-01-06 18:53:20' AS date, r.ts, r.event_id, r.value, r.series IS NOT NULL AS found
FROM u LEFT JOIN r ON r.series = u.series AND r.rn = 1"""


def t11_last_record(spark, sf):
    return timeaxis.last_record(_hourly(spark, sf)).select("series", "ts", "value")


T11_LAST_SQL = f"WITH {D_HOURLY} SELECT series, ts, value FROM dd WHERE ts = (SELECT max(ts) FROM dd d WHERE d.series = dd.series)"


def _months(spark, sf):
    """Months with orders, per group of customers."""
    return fx.daily(spark, sf).select("series", F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()


D_MONTHS = f"{fx.D_DAILY}, months AS (SELECT DISTINCT series, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month FROM daily)"
D_FORECAST = f"""{D_MONTHS},
fr AS (SELECT series, year, month, unnest(generate_series(make_timestamp(year, month, 1, 0, 0, 0) - INTERVAL 6 HOUR,
         make_timestamp(year, month, 1, 0, 0, 0) + INTERVAL 1 MONTH - INTERVAL 6 HOUR, INTERVAL 6 HOUR)) AS run_ts FROM months)"""


def t12_forecast_runs(spark, sf):
    return timeaxis.forecast_runs(_months(spark, sf), ["series"])


T12_SQL = f"WITH {D_FORECAST} SELECT series, year, month, run_ts FROM fr"


#: Hours held in one BIGINT, the sign left alone.
BITS = 62


def t12_month_hours(spark, sf):
    """Every hour of every month, summed up: as many hours as distinct ones, first to last."""
    hour = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    hours = timeaxis.month_hours(_months(spark, sf), ["series"]).withColumn("hour", hour)
    # The hours of a month are bits of a few numbers: a row a month is held, not a row an hour.
    words = [f"_w{w}" for w in range(-(-31 * 24 // BITS))]
    seen = [F.expr(f"bit_or(CASE WHEN hour DIV {BITS} = {w} THEN shiftleft(1L, hour % {BITS}) END)").alias(c) for w, c in enumerate(words)]
    found = hours.groupBy("series", "year", "month").agg(
        F.count(F.lit(1)).alias("hours"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("lead_h").alias("leads"),
        *seen,
    )
    distinct = sum((F.bit_count(F.coalesce(w, F.lit(0))) for w in words), F.lit(0)).cast("bigint")
    return found.withColumn("distinct_hours", distinct).select(
        "series", "year", "month", "hours", "distinct_hours", "first_ts", "last_ts", "leads"
    )


T12_HOURS_SQL = f"""WITH {D_FORECAST}
SELECT series, year, month, count(*) AS hours, count(DISTINCT ts) AS distinct_hours, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(l) AS BIGINT) AS leads
FROM (SELECT series, year, month, l, run_ts + l * INTERVAL 1 HOUR AS ts FROM fr, generate_series(4, 9) AS g(l))
WHERE date_trunc('month', ts) = make_date(year, month, 1) GROUP BY 1, 2, 3"""


def t13_select_leads(spark, sf):
    return timeaxis.select_leads(fx.forecast_runs(spark, sf)).select("cell", "run_ts", "lead_h", "ts", "acc")


T13_SQL = f"WITH {fx.D_RUNS} SELECT cell, run_ts, lead_h, run_ts + lead_h * INTERVAL 1 HOUR AS ts, acc FROM runs WHERE lead_h BETWEEN 4 AND 9"


def t14_deaccumulate(spark, sf):
    return timeaxis.deaccumulate(fx.forecast_runs(spark, sf)).select("cell", "ts", F.round("flux", 8).alias("flux"))


T14_SQL = f"""WITH {fx.D_RUNS}
SELECT b.cell, b.run_ts + b.lead_h * INTERVAL 1 HOUR AS ts, round((b.acc - a.acc) / 3600e0, 8) AS flux
FROM runs b JOIN runs a ON a.cell = b.cell AND a.run_ts = b.run_ts AND a.lead_h = b.lead_h - 1 WHERE b.lead_h BETWEEN 4 AND 9"""

QUERIES = {
    "T1_complete_daily": (t1_complete_daily, T1_SQL),
    "T1_complete_hourly": (t1_complete_hourly, T1_HOURLY_SQL),
    "T2_pad_axis": (t2_pad_axis, T2_SQL),
    "T3_coverage_window": (t3_coverage_window, T3_SQL),
    "T4_validate_coverage": (t4_validate_coverage, T4_SQL),
    "T5_gap_report": (t5_gap_report, T5_SQL),
    "T6_select_range": (t6_select_range, T6_SQL),
    "T6_resolve_records": (t6_resolve_records, T6_RESOLVE_SQL),
    "T7_blend_steps": (t7_blend_steps, T7_SQL),
    "T8_seconds_since": (t8_seconds_since, T8_SQL),
    "T8_instant_from_seconds": (t8_instant_from_seconds, T8_INSTANT_SQL),
    "T9_interpolate_cyclical": (_interpolated("cyclical"), _interpolated_sql("cyclical")),
    "T9_interpolate_linear": (_interpolated("linear"), _interpolated_sql("linear")),
    "T9_interpolate_clamp": (_interpolated("clamp"), _interpolated_sql("clamp")),
    "T10_record_at": (t10_record_at, T10_SQL),
    "T11_record_nearest": (t11_record_nearest, T11_SQL),
    "T11_last_record": (t11_last_record, T11_LAST_SQL),
    "T12_forecast_runs": (t12_forecast_runs, T12_SQL),
    "T12_month_hours": (t12_month_hours, T12_HOURS_SQL),
    "T13_select_leads": (t13_select_leads, T13_SQL),
    "T14_deaccumulate": (t14_deaccumulate, T14_SQL),
}
