"""Check, metadata and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coastgrid.operators import checks, masks
from driver_queries import fixtures as fx


def _field(spark, sf):
    """The ocean source with coordinates, as a described dataset."""
    grid = fx.source_grid(spark, sf)
    z = F.element_at(F.array(*[F.lit(-d) for d in fx.SOURCE_DEPTHS]), F.col("lev"))
    return fx.source_values(spark, sf).join(grid, "dataset").select(
        "dataset", "ts", "i", "j", F.col("lev").alias("k"), z.alias("z"),
        (F.col("x0") + (F.col("i") - 1) * F.col("dx")).alias("lon"), (F.col("y0") + (F.col("j") - 1) * F.col("dy")).alias("lat"),
    )


def m1_describe_field(spark, sf):
    out = checks.describe_field(_field(spark, sf))
    return out.select(
        "dataset", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")], "nx", "ny", "nz", "first_ts", "last_ts",
        F.size("dates").alias("dates"), F.element_at("dates", 4).alias("fourth_ts"), F.element_at("levels", 1).alias("deepest"),
        F.size("levels").alias("levels"),
    )


M1_SQL = f"""WITH {fx.D_DOMAIN}, {fx.D_SOURCE_GRID}
SELECT dataset, round(x0, 6) AS west, round(x0 + 11 * dx, 6) AS east, round(y0, 6) AS south, round(y0 + 9 * dy, 6) AS north,
       CAST(12 AS INT) AS nx, CAST(10 AS INT) AS ny, CAST(7 AS INT) AS nz, TIMESTAMP '1995-01-01 12:00:00' AS first_ts,
       TIMESTAMP '1995-01-05 12:00:00' AS last_ts, CAST(4 AS INT) AS dates, TIMESTAMP '1995-01-05 12:00:00' AS fourth_ts,
       -75e0 AS deepest, CAST(7 AS INT) AS levels FROM srcgrid"""


def m2_validate_axis(spark, sf):
    """Hours between the records of every user; regular only by chance."""
    rec = fx.records(spark, sf).select("series", "ts").distinct()
    axis = rec.withColumns(
        {
            "idx": (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("int"),
            "value": (F.dayofmonth("ts") * 24.0 + F.hour("ts")) * F.when(F.col("series") % 2 == 0, 1.0).otherwise(0.5),
        }
    )
    return checks.validate_axis(axis, ["series"], "idx", "value", bucket_size=48)


M2_SQL = f"""WITH {fx.D_RECORDS},
a AS (SELECT series, extract(day FROM ts) * 24 + extract(hour FROM ts) AS idx,
             (extract(day FROM ts) * 24 + extract(hour FROM ts)) * CASE WHEN series % 2 = 0 THEN 1e0 ELSE 5e-1 END AS v
      FROM (SELECT DISTINCT series, ts FROM rec)),
g AS (SELECT series, idx, v - lag(v) OVER (PARTITION BY series ORDER BY idx) AS gap FROM a)
SELECT series, count(*) AS points, arg_min(gap, idx) FILTER (gap IS NOT NULL) AS spacing,
       count(*) >= 2 AND coalesce(max(gap) - min(gap) < 1e-6, false) AS regular FROM g GROUP BY 1"""


def m2_validate_axis_regular(spark, sf):
    """Longitude axes of the grids are regular."""
    axis = fx.spine(spark, sf).filter("j = 1").select("grid_id", "i", "lon")
    return checks.validate_axis(axis, ["grid_id"], "i", "lon", bucket_size=8).withColumn("spacing", F.round("spacing", 6))


M2_REGULAR_SQL = f"WITH {fx.D_DOMAIN} SELECT grid_id, CAST(nx AS BIGINT) AS points, round((east - west) / nx, 6) AS spacing, true AS regular FROM domain"


def m3_validate_target_coverage(spark, sf):
    """Each grid against the source of the next dataset too small or not."""
    nodes = fx.spine(spark, sf).select(F.col("grid_id").alias("dataset"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    source = fx.domains(spark, sf).select(
        F.col("grid_id").alias("dataset"), (F.col("west") + 0.03 * (F.col("grid_id") % 2)).alias("x0"),
        ((F.col("east") - F.col("west")) / 9).alias("dx"), F.lit(10).alias("nx"),
        F.col("south").alias("y0"), ((F.col("north") - F.col("south")) / 9).alias("dy"), F.lit(10).alias("ny"),
    )
    out = checks.validate_target_coverage(nodes, source, strict=False)
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "source_x_min", "source_x_max")], "covered")


M3_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id AS dataset, round(west + (east - west) / nx / 2, 6) AS x_min, round(east - (east - west) / nx / 2, 6) AS x_max,
       round(west + 3e-2 * (grid_id % 2), 6) AS source_x_min, round(east + 3e-2 * (grid_id % 2), 6) AS source_x_max, grid_id % 2 = 0 AS covered FROM domain"""


def m4_validate_same_geometry(spark, sf):
    """Ten files per dataset, one per grid, of several lengths; every seventh is shifted by a millionth of a degree."""
    d = fx.domains(spark, sf)
    axes = fx.spine(spark, sf).filter("j = 1").join(d.select("grid_id", "dataset", "west"), "grid_id")
    shift = F.when(F.col("grid_id") % 7 == 3, F.lit(1e-6)).otherwise(F.lit(0.0))
    rows = axes.select(
        "dataset", F.format_string("f%06d", "grid_id").alias("file"), F.lit("x").alias("axis"), F.col("i").alias("idx"),
        (F.col("i") * 0.02 + shift).alias("value"), F.lit("utm33").alias("crs"),
    )
    return checks.validate_same_geometry(rows, strict=False)


M4_SQL = f"""WITH {fx.D_DOMAIN}, f AS (SELECT CAST(floor(grid_id / 1e1) AS INT) AS dataset, grid_id, nx, grid_id % 7 = 3 AS odd FROM domain),
r AS (SELECT dataset, arg_min(odd, grid_id) AS ref, arg_min(nx, grid_id) AS ref_nx FROM f GROUP BY 1)
SELECT dataset, printf('f%06d', grid_id) AS file, odd = ref AND nx = ref_nx AS same FROM f JOIN r USING (dataset)"""


def m5_non_finite_counts(spark, sf):
    values = fx.source_values(spark, sf).withColumn("value", F.when(F.col("i") == 3, F.lit(float("nan"))).otherwise(F.col("value")))
    return checks.non_finite_counts(values, ["dataset", "lev", "ts"])


M5_SQL = f"""WITH {fx.D_SOURCE} SELECT dataset, lev, ts, count(*) AS bad FROM src WHERE value IS NULL OR i = 3 GROUP BY 1, 2, 3"""


def m6_validate_dims(spark, sf):
    """Every fourth grid claims one row more than its table has."""
    d = fx.domains(spark, sf).withColumns(
        {"nz": F.size("z_faces") - 1, "ny": (F.col("ny") + (F.col("grid_id") % 4 == 0).cast("int"))}
    )
    return checks.validate_dims(fx.forcing(spark, sf), d, strict=False)


M6_SQL = f"""WITH {fx.D_FORCING}
SELECT grid_id, variable, max(i) AS ni, max(j) AS nj, max(k) AS nk, grid_id % 4 <> 0 AS fits FROM forcing GROUP BY 1, 2"""


def m7_field_diagnostics(spark, sf):
    out = checks.field_diagnostics(fx.forcing(spark, sf).withColumn("value", F.col("value").cast("double") - 2.0))
    return out


M7_SQL = f"""WITH {fx.D_FORCING}, f AS (SELECT *, value - 2 AS v FROM forcing)
SELECT grid_id, ts, max(abs(v)) FILTER (variable = 'u') AS max_u, CAST(NULL AS DOUBLE) AS max_v, CAST(NULL AS DOUBLE) AS max_w,
       min(v) FILTER (variable = 'T') AS min_t, max(v) FILTER (variable = 'T') AS max_t FROM f GROUP BY 1, 2"""


def m8_panel_stats(spark, sf):
    surface = masks.surface_slice(fx.forcing(spark, sf), ["grid_id", "variable"])
    flat = surface.withColumn("value", F.when(F.col("grid_id") % 3 == 0, F.col("value") * 0).otherwise(F.col("value")))
    return checks.panel_stats(flat)


M8_SQL = f"""WITH {fx.D_FORCING},
s AS (SELECT grid_id, variable, value * CASE WHEN grid_id % 3 = 0 THEN 0 ELSE 1 END AS v FROM forcing WHERE k = 6 AND ts = TIMESTAMP '1995-01-01 12:00:00'),
m AS (SELECT grid_id, variable, min(v) AS lo, max(v) AS hi, count(*) FILTER (v IS NULL) AS land FROM s GROUP BY 1, 2)
SELECT grid_id, variable, CASE WHEN lo IS NULL OR lo = hi THEN 0e0 ELSE lo END AS low, CASE WHEN lo IS NULL OR lo = hi THEN 1e0 ELSE hi END AS high, land FROM m"""


def _state(date):
    def query(spark, sf):
        d = fx.domains(spark, sf).withColumn("nz", F.size("z_faces") - 1)
        at = None if date is None else F.lit(date).cast("timestamp_ntz")
        return checks.read_state(fx.forcing(spark, sf), d, ["T", "S"], at)

    return query


def _state_sql(ts):
    return f"WITH {fx.D_FORCING} SELECT grid_id, variable, ts, k, j, i, coalesce(value, 0e0) AS value FROM forcing WHERE ts = TIMESTAMP '{ts}'"


def m10_drop_web_pages(spark, sf):
    return checks.drop_web_pages(fx.payloads(spark, sf)).select("kind", "id", F.length("body").alias("chars"))


def m10_rejected_pages(spark, sf):
    return checks.rejected_pages(fx.payloads(spark, sf)).select("kind", "id", F.length("body").alias("chars"))


M10_SQL = f"WITH {fx.D_PAYLOADS} SELECT kind, id, CAST(length(body) AS INT) AS chars FROM payloads WHERE body <> '' AND left(body, 1) <> '<'"
M10_REJECT_SQL = f"WITH {fx.D_PAYLOADS} SELECT kind, id, CAST(length(body) AS INT) AS chars FROM payloads WHERE NOT coalesce(body <> '' AND left(body, 1) <> '<', false)"

QUERIES = {
    "M1_describe_field": (m1_describe_field, M1_SQL),
    "M2_validate_axis": (m2_validate_axis, M2_SQL),
    "M2_validate_axis_regular": (m2_validate_axis_regular, M2_REGULAR_SQL),
    "M3_validate_target_coverage": (m3_validate_target_coverage, M3_SQL),
    "M4_validate_same_geometry": (m4_validate_same_geometry, M4_SQL),
    "M5_non_finite_counts": (m5_non_finite_counts, M5_SQL),
    "M6_validate_dims": (m6_validate_dims, M6_SQL),
    "M7_field_diagnostics": (m7_field_diagnostics, M7_SQL),
    "M8_panel_stats": (m8_panel_stats, M8_SQL),
    "M9_read_state_last": (_state(None), _state_sql("1995-01-02 12:00:00")),
    "M9_read_state_at": (_state("1995-01-01 12:00:00.4"), _state_sql("1995-01-01 12:00:00")),
    "M10_drop_web_pages": (m10_drop_web_pages, M10_SQL),
    "M10_rejected_pages": (m10_rejected_pages, M10_REJECT_SQL),
}
