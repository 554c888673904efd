"""Sources and sinks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from coastgrid import sinks, sources
from coastgrid.functions.session import scratch_dir
from coastgrid.operators import bathymetry as bathy
from coastgrid.operators import rivers, soundings
from driver_queries import fixtures as fx


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/coastgrid/{name}-{uuid.uuid4().hex}"


def s1_read_records(spark, sf):
    path = new_path(spark, "records")
    orders = fx.run(spark, sf, "SELECT o_orderkey, o_custkey, o_orderdate AS ts FROM {orders}")
    months = fx.ntz(orders, "ts").withColumns({"year": F.year("ts"), "month": F.month("ts")})
    months.repartition("year", "month").write.partitionBy("year", "month").parquet(path)
    return sources.read_records(spark, path, [1995, 1996, 1999, 2030]).select(
        "o_orderkey", "o_custkey", "ts", "year", "month"
    )


S1_SQL = """SELECT o_orderkey, o_custkey, o_orderdate AS ts, CAST(year(o_orderdate) AS INT) AS year,
CAST(month(o_orderdate) AS INT) AS month FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1999)"""


def s2_dedupe_records(spark, sf):
    return sources.dedupe_records(fx.records(spark, sf))


S2_SQL = f"""WITH {fx.D_RECORDS}
SELECT series, ts, file, idx, value FROM (
  SELECT *, row_number() OVER (PARTITION BY series, ts ORDER BY file, idx) AS rn FROM rec) WHERE rn = 1"""


def s3_read_outlets(spark, sf):
    path = new_path(spark, "outlets")
    fx.outlets(spark, sf).select(
        F.col("river_id").alias("River number"),
        F.concat(F.lit("  "), "name").alias("Name"),
        F.col("lat").alias("LatOutlet"),
        F.col("lon").alias("LonOutlet"),
        F.lit(0).alias("Zero"),
    ).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return sources.read_outlets(spark, path)


S3_SQL = f"WITH {fx.D_OUTLETS} SELECT river_id, trim(name) AS name, lon, lat FROM outlets"


def s4_read_river_series(spark, sf):
    return rivers.read_river_series(fx.river_source(spark, sf), {"temp": "T"}, {"S": 0.0})


S4_SQL = f"""WITH {fx.D_RIVER}
SELECT CAST(river - 4 AS INT) AS river_id, ts, 'T' AS variable, CAST(temp AS DOUBLE) AS value FROM river WHERE level = 2
UNION ALL SELECT CAST(river - 4 AS INT), ts, 'S', 0e0 FROM river WHERE level = 2"""


def s5_depth_points(spark, sf):
    features = fx.points(spark, sf).drop("grid_id")
    return soundings.assign_domains(soundings.depth_points(features), fx.domains(spark, sf))


S5_SQL = f"""WITH {fx.D_POINTS}, {fx.D_DOMAIN}
SELECT d.grid_id, p.lon, p.lat, -abs(p.depth) AS h FROM pts p JOIN domain d
  ON p.lon BETWEEN d.west AND d.east AND p.lat BETWEEN d.south AND d.north WHERE p.depth IS NOT NULL"""


def s6_contour_vertices(spark, sf):
    """Lines as arrays of parts."""
    lines = fx.lines(spark, sf)
    vertex = F.struct("pos", F.struct("x", "y").alias("v"))
    parts = lines.groupBy("line_id", "depth", "part").agg(
        F.transform(F.array_sort(F.collect_list(vertex)), lambda p: p["v"]).alias("p")
    )
    features = parts.groupBy("line_id", "depth").agg(F.collect_list("p").alias("geom"))
    return soundings.contour_vertices(features, 3, keep=("line_id",))


def s6_contour_rows(spark, sf):
    """Lines stored one vertex per row."""
    return soundings.contour_vertices_from_rows(fx.lines(spark, sf), 3).select("line_id", "x", "y", "h")


S6_SQL = f"""WITH {fx.D_LINES}
SELECT line_id, x, y, CAST(-abs(depth) AS DOUBLE) AS h FROM (
  SELECT *, max(pos) OVER (PARTITION BY line_id, part) AS last FROM lines) WHERE pos % 3 = 0 OR pos = last"""


def s7_read_land_features(spark, sf):
    """A layer that does not exist is skipped."""
    return soundings.read_land_features(
        fx.land(spark, sf), fx.domains(spark, sf), ["land", "skerry", "no such layer"]
    ).select("grid_id", "id", "layer")


S7_SQL = f"""WITH {fx.D_LAND}, {fx.D_DOMAIN},
box AS (SELECT id, layer, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM land
        WHERE layer IN ('land', 'skerry') GROUP BY 1, 2)
SELECT grid_id, id, layer FROM box JOIN domain ON x1 <= east AND x2 >= west AND y1 <= north AND y2 >= south"""


def s8_read_bathymetry(spark, sf):
    """A third of the tables hold positive depths, half have their axes swapped, empty cells are missing."""
    positive = F.col("grid_id") % 3 == 0
    h = F.when(F.col("h") == 0, F.lit(None)).otherwise(F.when(positive, F.abs("h")).otherwise(F.col("h")))
    swapped = F.col("grid_id") % 2 == 1
    stored = fx.bathymetry(spark, sf).select(
        "grid_id",
        F.when(swapped, F.col("j")).otherwise(F.col("i")).alias("i"),
        F.when(swapped, F.col("i")).otherwise(F.col("j")).alias("j"),
        h.alias("h"),
    )
    return bathy.read_bathymetry(bathy.normalise_axes(stored, fx.domains(spark, sf)))


S8_SQL = f"""WITH {fx.D_BATHY}
SELECT grid_id, nx, ny, i, j, true AS fits,
       CASE WHEN grid_id % 3 = 0 THEN -abs(h) ELSE h END + 0e0 AS h FROM bathy"""


def s8_stored_axes(spark, sf):
    """Half of the tables have their axes swapped, a third run from north to south, a fifth from east to west; faces from centres."""
    cells = fx.bathymetry(spark, sf)
    i = F.when(F.col("grid_id") % 5 == 0, F.col("nx") + 1 - F.col("i")).otherwise(F.col("i"))
    j = F.when(F.col("grid_id") % 3 == 0, F.col("ny") + 1 - F.col("j")).otherwise(F.col("j"))
    swapped = F.col("grid_id") % 2 == 1
    stored = cells.select("grid_id", F.when(swapped, j).otherwise(i).alias("i"), F.when(swapped, i).otherwise(j).alias("j"), "lon", "lat", "h")
    found, domains = bathy.read_stored_grid(stored)
    faces = domains.select("grid_id", "x_faces", "y_faces")
    sides = {"west": ("x_faces", "i", 0), "east": ("x_faces", "i", 1), "south": ("y_faces", "j", 0), "north": ("y_faces", "j", 1)}
    return found.join(faces, "grid_id").select(
        "grid_id", "nx", "ny", "i", "j", "h", *(F.round(F.element_at(a, F.col(n) + d), 6).alias(name) for name, (a, n, d) in sides.items())
    )


S8_AXES_SQL = f"""WITH {fx.D_BATHY}, lowest AS (SELECT grid_id, min(h) AS low FROM bathy GROUP BY 1)
SELECT b.grid_id, b.nx, b.ny, b.i, b.j, CASE WHEN low >= 0 THEN -h ELSE h END + 0e0 AS h,
       round(west + (b.i - 1) * ((east - west) / b.nx), 6) AS west, round(west + b.i * ((east - west) / b.nx), 6) AS east,
       round(south + (b.j - 1) * ((north - south) / b.ny), 6) AS south, round(south + b.j * ((north - south) / b.ny), 6) AS north
FROM bathy b JOIN domain d ON b.grid_id = d.grid_id JOIN lowest l ON b.grid_id = l.grid_id"""


def s9_read_field(spark, sf):
    forcing = fx.forcing(spark, sf)
    return sources.read_field(
        forcing, fx.domains(spark, sf).withColumn("nz", F.size("z_faces") - 1), ["T", "no such"]
    ).select("grid_id", "variable", "ts", "k", "j", "i", "value")


S9_SQL = f"WITH {fx.D_FORCING} SELECT grid_id, variable, ts, k, j, i, value FROM forcing"


def k1_write_bathymetry(spark, sf):
    path = new_path(spark, "bathymetry")
    sinks.write_bathymetry(fx.bathymetry(spark, sf), path, fx.domains(spark, sf))
    return spark.read.parquet(path).select("grid_id", "i", "j", F.col("h").cast("double").alias("h"))


K1_SQL = f"WITH {fx.D_BATHY} SELECT grid_id, i, j, CAST(CAST(h AS FLOAT) AS DOUBLE) AS h FROM bathy"


def k2_write_forcing(spark, sf):
    path = new_path(spark, "forcing")
    sinks.write_forcing(fx.forcing(spark, sf), path)
    return spark.read.parquet(path).select(
        "grid_id", "variable", "year", "month", "ts", "k", "j", "i",
        F.col("value").cast("double").alias("value"), F.col("lambda").cast("double").alias("lambda"),
    )


K2_SQL = f"""WITH {fx.D_FORCING}
SELECT grid_id, variable, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, ts, k, j, i,
       CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(CAST("lambda" AS FLOAT) AS DOUBLE) AS "lambda" FROM forcing"""


def event_field(spark, sf):
    """Events as an atmosphere table: one variable per event type, hourly sums per user."""
    records = fx.run(spark, sf, EVENT_FIELD_SQL)
    return fx.ntz(records, "ts")


EVENT_FIELD_SQL = """
SELECT event_type AS variable, date_trunc('hour', ts) AS ts, CAST(1 + user_id AS INT) AS i, CAST(1 AS INT) AS j,
       CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100e0 AS DOUBLE) AS value
FROM {events} GROUP BY 1, 2, 3"""


def k3_write_atmosphere(spark, sf):
    path = new_path(spark, "atmosphere")
    sinks.write_atmosphere(event_field(spark, sf), path)
    return spark.read.parquet(path).select(
        "variable", "year", "month", "ts", "i", "j", F.col("value").cast("double").alias("value")
    )


K3_SQL = f"""SELECT variable, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, ts, i, j,
       CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM ({fx.duck(EVENT_FIELD_SQL)})"""


def k4_write_river_copy(spark, sf):
    source, target = new_path(spark, "forcing"), new_path(spark, "rivers")
    sinks.write_forcing(fx.forcing(spark, sf), source)
    sinks.write_river_copy(spark.read.parquet(source), source, target)
    return spark.read.parquet(target).groupBy("grid_id", "variable").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("wet_cells")
    )


K4_SQL = f"""WITH {fx.D_FORCING}
SELECT grid_id, variable, count(*) AS cells, count(value) AS wet_cells FROM forcing GROUP BY 1, 2"""


def k5_write_month_staged(spark, sf):
    """All months are written, then 1996 is replaced; every other month must survive."""
    path = new_path(spark, "staged")
    orders = fx.ntz(fx.run(spark, sf, ORDER_FIELD_SQL), "ts")
    sinks.write_month_staged(orders, path, ("ts", "i"))
    again = orders.filter(F.year("ts") == 1996).withColumn("value", -F.col("value"))
    sinks.write_month_staged(again, path, ("ts", "i"))
    return spark.read.parquet(path).select("variable", "year", "month", "ts", "i", "value")


ORDER_FIELD_SQL = """SELECT o_orderstatus AS variable, o_orderdate AS ts, CAST(o_orderkey AS INT) AS i,
o_totalprice AS value FROM {orders}"""
K5_SQL = f"""SELECT variable, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, ts, i,
       CASE WHEN year(ts) = 1996 THEN -value ELSE value END AS value FROM ({fx.duck(ORDER_FIELD_SQL)})"""


def _half_published(spark, sf, name):
    """Orders until 1997 are published; a writer of 1998 was lost before its marker."""
    path = new_path(spark, name)
    orders = fx.ntz(fx.run(spark, sf, ORDER_FIELD_SQL), "ts")
    sinks.publish_months(orders.filter(F.year("ts") <= 1997), path, ("ts", "i"))
    lost = orders.filter(F.year("ts") == 1998).withColumns({"value": -F.col("value"), "year": F.year("ts"), "month": F.month("ts")})
    lost.write.partitionBy("variable", "year", "month").parquet(f"{path}/data/version=vlost")
    return orders, path


def k5_publish_months(spark, sf):
    """From a half-done table the later years are published, then 1996 is replaced; readers go by the ledger."""
    orders, path = _half_published(spark, sf, "published")
    sinks.publish_months(orders.filter(F.year("ts") >= 1998), path, ("ts", "i"), replace=False)
    sinks.publish_months(orders.filter(F.year("ts") == 1996).withColumn("value", -F.col("value")), path, ("ts", "i"))
    return sinks.read_published(spark, path).select("variable", "year", "month", "ts", "i", "value")


def k6_pending_published(spark, sf):
    """What the half-done table still lacks; a month counts when every status has it."""
    orders, path = _half_published(spark, sf, "pending")
    years = orders.select(F.year("ts").alias("year")).distinct()
    return sinks.pending_published(spark, path, years, ["F", "O", "P"])


K6_PUBLISHED_SQL = f"""WITH o AS (SELECT DISTINCT variable, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month FROM ({fx.duck(ORDER_FIELD_SQL)}))
SELECT year, CAST(m AS INT) AS month FROM (SELECT DISTINCT year FROM o), generate_series(1, 12) AS s(m)
EXCEPT SELECT year, month FROM o WHERE year <= 1997 GROUP BY 1, 2 HAVING count(*) = 3"""


def k6_pending_months(spark, sf):
    """Months without any order, per group of customers."""
    daily = fx.daily(spark, sf).select("series", F.year("ts").alias("year"), F.month("ts").alias("month"))
    years = daily.select("series", "year")
    return sinks.pending_months(daily, years, ["series"])


K6_SQL = f"""WITH {fx.D_DAILY}
SELECT series, year, CAST(month AS INT) AS month
FROM (SELECT DISTINCT series, CAST(year(ts) AS INT) AS year FROM daily), generate_series(1, 12) AS m(month)
EXCEPT SELECT series, CAST(year(ts) AS INT), CAST(month(ts) AS INT) FROM daily"""


def k7_pack_slabs(spark, sf):
    packed = sinks.pack_slabs(fx.forcing(spark, sf), tile=8)
    return packed.select(
        "grid_id", "variable", "ts", "k", "tile_i", "tile_j",
        F.size("values").alias("cells"),
        F.element_at("is", 2).alias("second_i"), F.element_at("js", 2).alias("second_j"),
        F.element_at("values", 2).alias("second"),
    )


K7_SQL = f"""WITH {fx.D_FORCING},
t AS (SELECT *, CAST((i - 1) // 8 AS INT) AS tile_i, CAST((j - 1) // 8 AS INT) AS tile_j FROM forcing),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY grid_id, variable, ts, k, tile_i, tile_j) AS n
      FROM t WINDOW w AS (PARTITION BY grid_id, variable, ts, k, tile_i, tile_j ORDER BY j, i))
SELECT grid_id, variable, ts, k, tile_i, tile_j, CAST(n AS INT) AS cells, i AS second_i, j AS second_j, value AS second
FROM r WHERE rn = 2"""


def k7_unpack_slabs(spark, sf):
    return sinks.unpack_slabs(sinks.pack_slabs(fx.forcing(spark, sf))).select(
        "grid_id", "variable", "ts", "k", "j", "i", "value"
    )


QUERIES = {
    "S1_read_records": (s1_read_records, S1_SQL),
    "S2_dedupe_records": (s2_dedupe_records, S2_SQL),
    "S3_read_outlets": (s3_read_outlets, S3_SQL),
    "S4_read_river_series": (s4_read_river_series, S4_SQL),
    "S5_depth_points": (s5_depth_points, S5_SQL),
    "S6_contour_vertices": (s6_contour_vertices, S6_SQL),
    "S6_contour_rows": (s6_contour_rows, S6_SQL),
    "S7_read_land_features": (s7_read_land_features, S7_SQL),
    "S8_read_bathymetry": (s8_read_bathymetry, S8_SQL),
    "S8_stored_axes": (s8_stored_axes, S8_AXES_SQL),
    "S9_read_field": (s9_read_field, S9_SQL),
    "K1_write_bathymetry": (k1_write_bathymetry, K1_SQL),
    "K2_write_forcing": (k2_write_forcing, K2_SQL),
    "K3_write_atmosphere": (k3_write_atmosphere, K3_SQL),
    "K4_write_river_copy": (k4_write_river_copy, K4_SQL),
    "K5_write_month_staged": (k5_write_month_staged, K5_SQL),
    "K5_publish_months": (k5_publish_months, K5_SQL),
    "K6_pending_published": (k6_pending_published, K6_PUBLISHED_SQL),
    "K6_pending_months": (k6_pending_months, K6_SQL),
    "K7_pack_slabs": (k7_pack_slabs, K7_SQL),
    "K7_unpack_slabs": (k7_unpack_slabs, S9_SQL),
}
