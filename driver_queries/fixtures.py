"""Operator inputs derived from the driver's tables.

Each ``*_SQL`` text is plain SQL that Spark and DuckDB both accept; ``{table}`` stands
for a driver table.  Every input covers its whole table, so it grows with the data:
one grid per supplier, one ocean source per ten suppliers, one record series per user.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise, never_broadcast
from coastgrid.operators.grid import grid_spine
from coastgrid.operators.masks import water_mask
from coastgrid.operators.relax import relaxation_lambda

TABLES = ("nation", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

# Vertical faces of every grid and depths of every source level (fixed values).
Z_FACES = [-26.0, -18.0, -12.0, -8.0, -5.0, -2.0, 0.0]
SOURCE_DEPTHS = [0.0, 3.0, 10.0, 15.0, 25.0, 50.0, 75.0]

DOMAIN_SQL = """
SELECT CAST(s_suppkey AS INT) AS grid_id,
       CAST(18 + s_suppkey % 5 AS INT) AS nx, CAST(12 + s_suppkey % 4 AS INT) AS ny,
       5e0 + 5e-1 * (s_suppkey % 40) AS west,
       5e0 + 5e-1 * (s_suppkey % 40) + 2e-2 * (18 + s_suppkey % 5) AS east,
       5.5e1 + 5e-1 * (floor(s_suppkey / 4e1) % 60) AS south,
       5.5e1 + 5e-1 * (floor(s_suppkey / 4e1) % 60) + 2e-2 * (12 + s_suppkey % 4) AS north
FROM {supplier}
"""

CELL_SQL = """
SELECT CAST(l_suppkey AS INT) AS grid_id,
       CAST(1 + l_partkey % (18 + l_suppkey % 5) AS INT) AS i,
       CAST(1 + l_orderkey % (12 + l_suppkey % 4) AS INT) AS j,
       round(2.2e1 - sum(l_quantity) / count(*), 4) AS h
FROM {lineitem} GROUP BY 1, 2, 3
"""

SOURCE_CELL_SQL = """
SELECT CAST(floor(l_suppkey / 1e1) AS INT) AS dataset,
       CAST(l_orderkey % 4 AS INT) AS day, CAST(l_linenumber AS INT) AS lev,
       CAST(1 + l_partkey % 12 AS INT) AS i, CAST(1 + floor(l_orderkey / 4e0) % 10 AS INT) AS j,
       round(sum(l_quantity) / count(*), 4) AS q
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5
"""

RECORD_SQL = """
SELECT CAST(user_id AS INT) AS series, date_trunc('hour', ts) AS ts,
       event_type AS file, event_id AS idx, value
FROM {events}
"""

DAILY_SQL = """
SELECT CAST(floor(o_custkey / 3e1) AS INT) AS series, o_orderdate + INTERVAL 12 HOUR AS ts,
       round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100e0, 2) AS value
FROM {orders} GROUP BY 1, 2
"""

HOURLY_SQL = """
SELECT CAST(user_id AS INT) AS cell,
       CAST((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS INT) AS h,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM {events} GROUP BY 1, 2
"""

POINT_SQL = """
SELECT CAST(l_suppkey AS INT) AS grid_id,
       5e0 + 5e-1 * (l_suppkey % 40)
         + 2e-2 * (18 + l_suppkey % 5) * (11e-1 * (((l_orderkey * 7919 + l_linenumber * 131) % 10007) / 10007e0) - 5e-2) AS lon,
       5.5e1 + 5e-1 * (floor(l_suppkey / 4e1) % 60)
         + 2e-2 * (12 + l_suppkey % 4) * (11e-1 * (((l_partkey * 104729 + l_orderkey * 31 + l_linenumber) % 10009) / 10009e0) - 5e-2) AS lat,
       NULLIF(l_quantity, 5e1) AS depth
FROM {lineitem}
"""

LINE_SQL = """
SELECT l_orderkey AS line_id, CAST(l_linenumber % 2 AS INT) AS part, l_orderkey % 50 AS depth,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos,
       1.02e1 + 8e-1 * (l_partkey % 1009) / 1009e0 AS x,
       5.9e1 + 5e-1 * (l_partkey % 1013) / 1013e0 AS y
FROM {lineitem}
"""

# One sheared quadrilateral per order, near a grid: corner, width, height and shear.
LAND_SQL = """
SELECT CAST(o_orderkey AS INT) AS id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'skerry' WHEN o_orderkey % 3 = 1 THEN 'land' ELSE 'harbour' END AS layer,
       5e0 + 5e-1 * (o_custkey % 40) + 3e-2 * (o_orderkey % 13) AS x0,
       5.5e1 + 5e-1 * (floor((o_custkey % 100) / 4e1) % 60) + 2e-2 * (o_orderkey % 11) AS y0,
       5e-2 + 1e-3 * (o_orderkey % 7) AS w, 4.3e-2 AS t, 1e-2 * (o_orderkey % 4) AS shear
FROM {orders}
"""

# Outlets of a grid come from the parts whose number falls on it.
OUTLET_SQL = """
SELECT CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS INT) AS grid_id,
       CAST(p_partkey + 1 AS INT) AS river_id, p_name AS name,
       CAST(p_partkey AS INT) AS position,
       5e0 + 5e-1 * ((p_partkey % (SELECT count(*) FROM {supplier})) % 40)
         + 4.4e-1 * ((p_partkey * 37) % 101) / 101e0 AS lon,
       5.5e1 + 5e-1 * (floor((p_partkey % (SELECT count(*) FROM {supplier})) / 4e1) % 60)
         + 3e-1 * ((p_partkey * 53) % 101) / 101e0 AS lat
FROM {part}
"""

RIVER_SQL = """
SELECT CAST(p_partkey + 5 AS INT) AS river, p_partkey AS seed FROM {part}
"""

PAYLOAD_SQL = """
SELECT 'page' AS kind, page_id AS id, html AS body FROM {pages}
UNION ALL SELECT 'document', doc_id, text FROM {documents}
"""


def duck(sql: str) -> str:
    """The text as DuckDB reads it: driver tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def run(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The text as a DataFrame over the Parquet files in ``sf``."""
    text = sql
    for table in TABLES:
        text = text.replace("{%s}" % table, f"parquet.`{sf}/{table}.parquet`")
    return spark.sql(text)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- Spark side --------------------------------------------------------------


def domains(spark: SparkSession, sf: str) -> DataFrame:
    faces = F.array(*[F.lit(z) for z in Z_FACES])
    dataset = F.floor(F.col("grid_id") / 10.0).cast("int")
    return run(spark, sf, DOMAIN_SQL).withColumns({"z_faces": faces, "dataset": dataset})


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return grid_spine(domains(spark, sf))


def bathymetry(spark: SparkSession, sf: str) -> DataFrame:
    """Dense cells; a cell without order lines is land at 0."""
    cells = run(spark, sf, CELL_SQL)
    return (
        spine(spark, sf)
        .join(cells, ["grid_id", "i", "j"], "left")
        .select("grid_id", "nx", "ny", "i", "j", "lon", "lat", F.coalesce("h", F.lit(0.0)).alias("h"))
    )


def source_values(spark: SparkSession, sf: str) -> DataFrame:
    """Dense 12 x 10 x 7 ocean source of days 1, 2, 3 and 5 per dataset, with masked cells."""
    cells = run(spark, sf, SOURCE_CELL_SQL)
    datasets = run(spark, sf, DOMAIN_SQL).select(F.floor(F.col("grid_id") / 10.0).cast("int").alias("dataset")).distinct()

    def exploded(df: DataFrame, *axes: tuple[str, int, int]) -> DataFrame:
        for c, low, high in axes:
            df = df.withColumn(c, F.explode(F.sequence(F.lit(low), F.lit(high))))
        return df

    # Joined, not exploded at once: the size of a join is estimated as a product, that of an explosion as its input's.
    slabs = exploded(datasets, ("day", 0, 3), ("lev", 1, 7))
    dense = never_broadcast(slabs).join(exploded(datasets, ("i", 1, 12)), "dataset").transform(exploded, ("j", 1, 10))
    masked = (F.col("lev") == 7) | ((F.col("i") * 5 + F.col("j") * 3 + F.col("lev")) % 4 == 0)
    return dense.join(cells, ["dataset", "day", "lev", "i", "j"], "left").select(
        "dataset",
        (
            F.lit("1995-01-01 12:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(days=F.col("day") + (F.col("day") == 3).cast("int"))
        ).alias("ts"),
        "lev",
        "i",
        "j",
        F.when(~masked, F.coalesce("q", F.lit(25.0))).alias("value"),
    )


def source_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Regular lon/lat source axes that hold every grid of the dataset."""
    d = domains(spark, sf)
    box = d.groupBy("dataset").agg(
        F.min("west").alias("w"), F.max("east").alias("e"), F.min("south").alias("s"), F.max("north").alias("n")
    )
    return box.select(
        "dataset",
        F.col("w").alias("x0"),
        ((F.col("e") - F.col("w")) / 11).alias("dx"),
        F.lit(12).alias("nx"),
        F.col("s").alias("y0"),
        ((F.col("n") - F.col("s")) / 9).alias("dy"),
        F.lit(10).alias("ny"),
        F.array(*[F.lit(v) for v in SOURCE_DEPTHS]).alias("depths"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(run(spark, sf, RECORD_SQL), "ts")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return ntz(run(spark, sf, DAILY_SQL), "ts")


def forecast_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping runs per cell; accumulators restart at every run.

    Each hourly amount adds to every later lead of the runs it falls into.  A run is one row, with a sum
    per lead, until its amounts are grouped; runs without any come from the span of their cell.
    """
    hourly = run(spark, sf, HOURLY_SQL)
    # A run at hour r accumulates hours r .. r + 8 (leads 1..9); runs start every six hours.
    first = (F.floor(F.col("h") / 6.0) * 6).cast("int")
    amounts = hourly.select("cell", F.explode(F.array(first, first - 6)).alias("run_h"), "h", "cents")
    amounts = amounts.withColumn("lead_h", F.col("h") - F.col("run_h") + 1).filter("lead_h <= 9").drop("h")
    spans = hourly.groupBy("cell").agg(F.min(first).alias("lo"), F.max(first).alias("hi"))
    spine = spans.select("cell", F.explode(F.sequence("lo", "hi", F.lit(6))).alias("run_h"), F.lit(True).alias("held"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("run_h"))
    sums = [F.coalesce(F.sum(F.when(F.col("lead_h") <= lead, F.col("cents"))), F.lit(0)).alias(f"acc_{lead}") for lead in range(3, 10)]
    runs = (
        spine.unionByName(amounts, allowMissingColumns=True)
        .select("cell", start.alias("run_ts"), "lead_h", "cents", "held")
        .groupBy("cell", "run_ts")
        .agg(F.max("held").alias("held"), *sums)
        .filter("held")
    )
    leads = F.array(*[F.struct(F.lit(lead).alias("lead_h"), F.col(f"acc_{lead}").alias("acc")) for lead in range(3, 10)])
    return runs.select("cell", "run_ts", F.inline(leads))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, POINT_SQL)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, LINE_SQL)


def land(spark: SparkSession, sf: str) -> DataFrame:
    """One feature per row, ``geom`` a single ring."""
    x0, y0, w, t, shear = (F.col(c) for c in ("x0", "y0", "w", "t", "shear"))
    ring = F.array(
        F.struct(x0.alias("x"), y0.alias("y")),
        F.struct((x0 + w).alias("x"), y0.alias("y")),
        F.struct((x0 + w + shear).alias("x"), (y0 + t).alias("y")),
        F.struct((x0 + shear).alias("x"), (y0 + t).alias("y")),
    )
    return run(spark, sf, LAND_SQL).select("id", "layer", F.array(ring).alias("geom"))


def outlets(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, OUTLET_SQL)


def river_source(spark: SparkSession, sf: str) -> DataFrame:
    """Five noon stamps per river on two levels; the top one (2) counts."""
    rows = run(spark, sf, RIVER_SQL).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.lit(2)))
    )
    start = F.lit("1994-12-31 12:00:00").cast("timestamp_ntz")
    series = rows.select(
        "river",
        (start + F.make_dt_interval(days=F.col("day"))).alias("ts"),
        "level",
        (((F.col("seed") + 1) * 31 + F.col("day") * 7 + F.col("level")) % 100 / 10.0).alias("temp"),
    )
    return never_broadcast(series)


def curvilinear(spark: SparkSession, sf: str) -> DataFrame:
    """The bathymetry cells seen as a curvilinear source with grid-relative vectors."""
    i, j = F.col("i"), F.col("j")
    return bathymetry(spark, sf).select(
        F.col("grid_id").alias("dataset"),
        "i",
        "j",
        (F.col("lon") - 0.005 * j).alias("lon"),
        (F.col("lat") + 0.006 * i).alias("lat"),
        F.col("h").alias("u"),
        ((i * 7 + j * 3) % 11 - 5).cast("double").alias("v"),
    )


# Forcing variables of the queries, their location and a number that tells their values apart.
FORCING_VARIABLES = (("T", "ccc", 0), ("u", "fcc", 3))


def forcing(spark: SparkSession, sf: str) -> DataFrame:
    """Two variables on two days; dry cells are NULL, rates come from the southern edge band.

    The bathymetry is written once: each variable, and each pass of a query over the forcing, would
    otherwise group the order lines and join the cells again.
    """
    parts = []
    d, b = domains(spark, sf), materialise(bathymetry(spark, sf))
    for name, loc, seed in FORCING_VARIABLES:
        mask = water_mask(b, d, loc).withColumns(
            {"ni": F.col("nx") + int(loc[0] == "f"), "nj": F.col("ny"), "nz": F.lit(len(Z_FACES) - 1)}
        )
        rated = relaxation_lambda(mask, "south", 5, 86400.0)
        n = F.col("i") * 7 + F.col("j") * 11 + F.col("k") * 13 + F.col("day") + seed
        parts.append(
            rated.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(2)))).select(
                "grid_id", "nx", "ny", "nz", "ni", "nj",
                F.lit(name).alias("variable"),
                F.lit(loc).alias("loc"),
                (F.lit("1994-12-31 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("day"))).alias("ts"),
                "k", "j", "i",
                F.when(F.col("wet"), n % 50 / 10.0).alias("value"),
                "lambda",
            )
        )
    return parts[0].unionByName(parts[1])


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, PAYLOAD_SQL)


# --- DuckDB side -------------------------------------------------------------

D_DOMAIN = f"domain AS ({duck(DOMAIN_SQL)})"
D_SPINE = f"""{D_DOMAIN},
spine AS (
  SELECT grid_id, nx, ny, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
         west + (i - 5e-1) * ((east - west) / nx) AS lon, south + (j - 5e-1) * ((north - south) / ny) AS lat
  FROM domain, LATERAL (SELECT unnest(generate_series(1, nx)) AS i), LATERAL (SELECT unnest(generate_series(1, ny)) AS j))"""
D_BATHY = f"""{D_SPINE},
bathy AS MATERIALIZED (
  SELECT s.grid_id, s.nx, s.ny, s.i, s.j, s.lon, s.lat, coalesce(c.h, 0e0) AS h
  FROM spine s LEFT JOIN ({duck(CELL_SQL)}) c ON s.grid_id = c.grid_id AND s.i = c.i AND s.j = c.j)"""
D_LEVELS = "levels(k, zb, zt) AS (VALUES " + ", ".join(
    f"({k + 1}, {Z_FACES[k]:e}::DOUBLE, {Z_FACES[k + 1]:e}::DOUBLE)" for k in range(len(Z_FACES) - 1)
) + ")"
D_DEPTHS = "depths(lev, d) AS (VALUES " + ", ".join(
    f"({k + 1}, {d:e}::DOUBLE)" for k, d in enumerate(SOURCE_DEPTHS)
) + ")"
D_SOURCE = f"""src AS (
  SELECT d.dataset, TIMESTAMP '1995-01-01 12:00:00' + (d.day + CASE WHEN d.day = 3 THEN 1 ELSE 0 END) * INTERVAL 1 DAY AS ts,
         CAST(d.lev AS INT) AS lev, CAST(d.i AS INT) AS i, CAST(d.j AS INT) AS j,
         CASE WHEN d.lev = 7 OR (d.i * 5 + d.j * 3 + d.lev) % 4 = 0 THEN NULL ELSE coalesce(c.q, 25e0) END AS value
  FROM (SELECT dataset, day, lev, i, j
        FROM (SELECT DISTINCT CAST(floor(s_suppkey / 1e1) AS INT) AS dataset FROM supplier),
             generate_series(0, 3) AS a(day), generate_series(1, 7) AS b(lev),
             generate_series(1, 12) AS e(i), generate_series(1, 10) AS f(j)) d
  LEFT JOIN ({duck(SOURCE_CELL_SQL)}) c
    ON d.dataset = c.dataset AND d.day = c.day AND d.lev = c.lev AND d.i = c.i AND d.j = c.j)"""
D_SOURCE_GRID = """srcgrid AS (
  SELECT CAST(floor(grid_id / 1e1) AS INT) AS dataset, min(west) AS x0, (max(east) - min(west)) / 11 AS dx,
         min(south) AS y0, (max(north) - min(south)) / 9 AS dy
  FROM domain GROUP BY 1)"""
D_RECORDS = f"rec AS ({duck(RECORD_SQL)})"
D_DAILY = f"daily AS ({duck(DAILY_SQL)})"
# An event counts for the run of its six hours and for the one before, which reaches nine hours.
D_RUNS = f"""hourly AS MATERIALIZED ({duck(HOURLY_SQL)}),
reach AS MATERIALIZED (SELECT cell, h, cents, CAST(floor(h / 6e0) * 6 AS INT) - back AS run_h FROM hourly, (VALUES (0), (6)) AS o(back)),
runs AS MATERIALIZED (
  SELECT c.cell, TIMESTAMP '2024-01-01 00:00:00' + c.run_h * INTERVAL 1 HOUR AS run_ts, CAST(l.lead_h AS INT) AS lead_h,
         CAST(coalesce(sum(e.cents), 0) AS BIGINT) AS acc
  FROM (SELECT cell, unnest(generate_series(min(CAST(floor(h / 6e0) * 6 AS INT)), max(CAST(floor(h / 6e0) * 6 AS INT)), 6)) AS run_h
        FROM hourly GROUP BY cell) c
  CROSS JOIN generate_series(3, 9) AS l(lead_h)
  LEFT JOIN reach e ON e.cell = c.cell AND e.run_h = c.run_h AND e.h < c.run_h + l.lead_h
  GROUP BY c.cell, c.run_h, l.lead_h)"""
D_POINTS = f"pts AS ({duck(POINT_SQL)})"
D_LINES = f"lines AS ({duck(LINE_SQL)})"
D_LAND = f"""feature AS ({duck(LAND_SQL)}),
land AS (
  SELECT id, layer, 0 AS pos, x0 AS x, y0 AS y FROM feature
  UNION ALL SELECT id, layer, 1, x0 + w, y0 FROM feature
  UNION ALL SELECT id, layer, 2, x0 + w + shear, y0 + t FROM feature
  UNION ALL SELECT id, layer, 3, x0 + shear, y0 + t FROM feature)"""
D_OUTLETS = f"outlets AS ({duck(OUTLET_SQL)})"
D_RIVER = f"""river AS (
  SELECT river, TIMESTAMP '1994-12-31 12:00:00' + day * INTERVAL 1 DAY AS ts, CAST(level AS INT) AS level,
         ((seed + 1) * 31 + day * 7 + level) % 100 / 1e1 AS temp
  FROM ({duck(RIVER_SQL)}) CROSS JOIN generate_series(1, 5) AS d(day) CROSS JOIN generate_series(1, 2) AS v(level))"""
D_PAYLOADS = f"payloads AS ({duck(PAYLOAD_SQL)})"
D_CURVI = f"""{D_BATHY},
curvi AS (
  SELECT grid_id AS dataset, i, j, lon - 5e-3 * j AS lon, lat + 6e-3 * i AS lat, h AS u,
         CAST((i * 7 + j * 3) % 11 - 5 AS DOUBLE) AS v
  FROM bathy)"""
# Face heights: NULL marks the closed outer faces.
D_FACES = f"""{D_BATHY}, {D_LEVELS},
xface AS (
  SELECT grid_id, nx, ny, i, j, max(h) AS h, count(*) AS n
  FROM (SELECT grid_id, nx, ny, i, j, h FROM bathy UNION ALL SELECT grid_id, nx, ny, i + 1, j, h FROM bathy)
  GROUP BY 1, 2, 3, 4, 5),
yface AS (
  SELECT grid_id, nx, ny, i, j, max(h) AS h, count(*) AS n
  FROM (SELECT grid_id, nx, ny, i, j, h FROM bathy UNION ALL SELECT grid_id, nx, ny, i, j + 1, h FROM bathy)
  GROUP BY 1, 2, 3, 4, 5),
tmask AS (SELECT b.grid_id, nx, ny, i, j, CAST(k AS INT) AS k, h < zt AS wet, zb, zt, h FROM bathy b CROSS JOIN levels),
umask AS (SELECT f.grid_id, nx, ny, i, j, CAST(k AS INT) AS k, n = 2 AND h < zt AS wet FROM xface f CROSS JOIN levels),
vmask AS (SELECT f.grid_id, nx, ny, i, j, CAST(k AS INT) AS k, n = 2 AND h < zt AS wet FROM yface f CROSS JOIN levels)"""
D_FORCING = f"""{D_FACES},
forcing AS (
  SELECT grid_id, nx, ny, CAST(6 AS INT) AS nz, nx + face AS ni, ny AS nj, variable, loc,
         TIMESTAMP '1994-12-31 12:00:00' + day * INTERVAL 1 DAY AS ts, k, j, i,
         CASE WHEN wet THEN (i * 7 + j * 11 + k * 13 + day + seed) % 50 / 1e1 END AS value,
         CASE WHEN wet AND j - 1 < 5 THEN (1e0 / 864e2) * (5 - (j - 1)) / 5 ELSE 0e0 END AS "lambda"
  FROM (SELECT grid_id, nx, ny, i, j, k, wet, 0 AS face, 'T' AS variable, 'ccc' AS loc, 0 AS seed FROM tmask
        UNION ALL SELECT grid_id, nx, ny, i, j, k, wet, 1, 'u', 'fcc', 3 FROM umask)
  CROSS JOIN generate_series(1, 2) AS d(day))"""
