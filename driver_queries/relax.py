"""Relaxation and river queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coastgrid.operators import masks, relax, rivers
from coastgrid.plans import RiverConfig, TableRiverSource, add_rivers
from driver_queries import fixtures as fx
from driver_queries.masks import COAST, surface_mask


def _lambda(edge):
    def query(spark, sf):
        mask = masks.water_mask(fx.bathymetry(spark, sf), fx.domains(spark, sf), "fcc").withColumns(
            {"ni": F.col("nx") + 1, "nj": F.col("ny")}
        )
        out = relax.relaxation_lambda(mask, edge, 5, 86400.0)
        return out.select("grid_id", "i", "j", "k", F.round("lambda", 12).alias("lambda"))

    return query


def _lambda_sql(away):
    return f"""WITH {fx.D_FACES}
SELECT grid_id, i, j, k, CASE WHEN wet AND {away} < 5 THEN round((1e0 / 864e2) * (5 - ({away})) / 5, 12) ELSE 0e0 END AS "lambda" FROM umask"""


def snapped(spark, sf, radius=3):
    coast = masks.coastal_cells(surface_mask(spark, sf))
    outlets = fx.outlets(spark, sf).select("grid_id", "river_id", "position", "lon", "lat")
    return rivers.snap_outlets(outlets, fx.domains(spark, sf), coast, radius)


def r2_snap_outlets(spark, sf):
    return snapped(spark, sf).select("grid_id", "river_id", "i", "j", F.round("distance", 6).alias("distance"), "reason")


D_SNAP = f"""{fx.D_FACES}, {COAST}, {fx.D_OUTLETS},
loc AS (SELECT o.*, d.nx, d.ny, d.west, d.south, (east - west) / nx AS dx, (north - south) / ny AS dy,
               lon > west + (east - west) / nx / 2 AND lon < east - (east - west) / nx / 2
               AND lat > south + (north - south) / ny / 2 AND lat < north - (north - south) / ny / 2 AS inside
        FROM outlets o JOIN domain d USING (grid_id)),
nodei AS (SELECT grid_id, river_id, arg_min(m, abs(west + (m - 5e-1) * dx - lon)) AS ni
          FROM loc, LATERAL (SELECT unnest(generate_series(1, nx)) AS m) WHERE inside GROUP BY 1, 2),
nodej AS (SELECT grid_id, river_id, arg_min(m, abs(south + (m - 5e-1) * dy - lat)) AS nj
          FROM loc, LATERAL (SELECT unnest(generate_series(1, ny)) AS m) WHERE inside GROUP BY 1, 2),
cand AS MATERIALIZED (SELECT a.grid_id, a.river_id, c.i, c.j, (c.i - ni) * (c.i - ni) + (c.j - nj) * (c.j - nj) AS d2,
                row_number() OVER (PARTITION BY a.grid_id, a.river_id ORDER BY (c.i - ni) * (c.i - ni) + (c.j - nj) * (c.j - nj), c.j - nj, c.i - ni) AS rn
         FROM nodei a JOIN nodej b USING (grid_id, river_id) JOIN coast c ON c.grid_id = a.grid_id
         WHERE (c.i - ni) * (c.i - ni) + (c.j - nj) * (c.j - nj) <= 1225e-2),
snap AS MATERIALIZED (SELECT l.grid_id, l.river_id, l.position, c.i, c.j, sqrt(CAST(c.d2 AS DOUBLE)) AS distance,
                CASE WHEN NOT inside THEN 'outside' WHEN c.i IS NULL THEN 'no coast' END AS reason
         FROM loc l LEFT JOIN cand c ON c.grid_id = l.grid_id AND c.river_id = l.river_id AND c.rn = 1)"""
R2_SQL = f"WITH {D_SNAP} SELECT grid_id, river_id, i, j, round(distance, 6) AS distance, reason FROM snap"


def _times(spark, sf):
    return fx.forcing(spark, sf).select(F.expr("ts - INTERVAL '12' HOUR").cast("timestamp_ntz").alias("ts")).distinct()


def _series(spark, sf):
    return rivers.read_river_series(fx.river_source(spark, sf), {"temp": "T"}, {"S": 0.0})


def r3_match_series_by_date(spark, sf):
    """Midnight forcing times meet the noon stamps of the same date."""
    return rivers.match_series_by_date(_times(spark, sf), _series(spark, sf))


D_SERIES = f"""{fx.D_RIVER},
series AS MATERIALIZED (SELECT CAST(river - 4 AS INT) AS river_id, ts, 'T' AS variable, CAST(temp AS DOUBLE) AS value FROM river WHERE level = 2
           UNION ALL SELECT CAST(river - 4 AS INT), ts, 'S', 0e0 FROM river WHERE level = 2)"""
R3_SQL = f"""WITH {D_SERIES}
SELECT date_trunc('day', ts)::TIMESTAMP AS ts, river_id, variable, value FROM series WHERE ts < TIMESTAMP '1995-01-03 00:00:00'"""


def r4_match_outlets(spark, sf):
    """Two series numbers per outlet are asked for; those past the last river are missing."""
    outlets = fx.outlets(spark, sf).select(F.explode(F.array(F.col("river_id"), F.col("river_id") * 2)).alias("river_id"))
    return rivers.match_outlets(outlets, _series(spark, sf), strict=False)


R4_SQL = f"""WITH {fx.D_OUTLETS}, asked AS (SELECT river_id FROM outlets UNION ALL SELECT river_id * 2 FROM outlets)
SELECT river_id, river_id IN (SELECT CAST(p_partkey + 1 AS INT) FROM part) AS matched FROM asked"""


def r5_upsert_rivers(spark, sf):
    out = rivers.upsert_rivers(
        fx.forcing(spark, sf), snapped(spark, sf).filter("reason IS NULL"),
        rivers.match_series_by_date(fx.forcing(spark, sf).select("ts").distinct(), _series(spark, sf)), 3600.0,
    )
    return out.select("grid_id", "variable", "ts", "k", "j", "i", "value", F.round("lambda", 10).alias("lambda"))


D_UPSERT = f"""{D_SNAP}, {fx.D_FORCING.replace(fx.D_FACES + ',', '')}, {D_SERIES},
own AS MATERIALIZED (SELECT grid_id, i, j, arg_max(river_id, position) AS river_id FROM snap WHERE reason IS NULL GROUP BY 1, 2, 3)"""
# Rivers touch few cells: those are joined, all others pass by.
R5_SQL = f"""WITH {D_UPSERT},
flow AS MATERIALIZED (SELECT o.grid_id, o.i, o.j, s.variable, s.ts, s.value FROM own o JOIN series s USING (river_id))
SELECT f.grid_id, f.variable, f.ts, f.k, f.j, f.i, CASE WHEN s.grid_id IS NOT NULL THEN s.value ELSE f.value END AS value,
       round(CASE WHEN s.grid_id IS NOT NULL THEN 1 / 36e2 ELSE f."lambda" END, 10) AS "lambda"
FROM forcing f LEFT JOIN flow s ON s.grid_id = f.grid_id AND s.i = f.i AND s.j = f.j AND f.k = 6 AND s.variable = f.variable AND s.ts = f.ts"""


def add_rivers_job(spark, sf):
    """The composed job, with the same search radius."""
    source = TableRiverSource(
        fx.outlets(spark, sf).select("grid_id", "river_id", "position", "lon", "lat"), _series(spark, sf), search_radius=3
    )
    out = add_rivers(fx.forcing(spark, sf), source, fx.bathymetry(spark, sf), fx.domains(spark, sf), "south", RiverConfig(3600.0))
    return out.select("grid_id", "variable", "ts", "k", "j", "i", "value", F.round("lambda", 10).alias("lambda"))


def r6_collision_report(spark, sf):
    return rivers.collision_report(snapped(spark, sf))


R6_SQL = f"""WITH {D_SNAP}
SELECT grid_id, i, j, count(*) AS outlets, arg_max(river_id, position) AS winner FROM snap WHERE reason IS NULL GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def _signed_forcing(spark, sf):
    """Rates past one in size on two of every five diagonals, exactly one on a third."""
    d = (F.col("i") + F.col("j")) % 5
    lam = F.when(d == 0, F.lit(2.5)).when(d == 1, F.lit(-2.5)).when(d == 2, F.lit(1.0)).otherwise(F.col("lambda"))
    return fx.forcing(spark, sf).withColumn("lambda", lam)


def r7_forcing_tendency(spark, sf):
    forcing = _signed_forcing(spark, sf)
    cell = ["grid_id", "variable", "ts", "i", "j", "k"]
    state = forcing.select(*cell, ((F.col("i") + F.col("j") + F.col("k")) % 20 / 2.0).alias("field"))
    geometry = forcing.select("grid_id", "i", "j", "k").distinct().select(
        "grid_id", "i", "j", "k",
        (F.col("k") * 100.0).alias("area_x"), (F.col("k") * 50.0).alias("area_y"), (F.col("k") * 1000.0 + F.col("j")).alias("volume"),
    )
    out = relax.forcing_tendency(state, forcing, geometry)
    return out.withColumn("tendency", F.round("tendency", 8))


R7_SQL = f"""WITH {fx.D_FORCING},
f AS (SELECT *, CASE (i + j) % 5 WHEN 0 THEN 25e-1 WHEN 1 THEN -25e-1 WHEN 2 THEN 1e0 ELSE "lambda" END AS l, (i + j + k) % 20 / 2e0 AS field FROM forcing)
SELECT grid_id, variable, ts, i, j, k,
       round(coalesce(CASE WHEN l > 1 THEN value * k * 100 / (k * 1000e0 + j) WHEN l < -1 THEN value * k * 50 / (k * 1000e0 + j)
                  WHEN abs(l) < 1 THEN -l * (field - value) END, 0e0), 8) + 0e0 AS tendency FROM f"""


def _boundary(edge):
    def query(spark, sf):
        return relax.boundary_series(fx.forcing(spark, sf), edge)

    return query


def _boundary_sql(where, along):
    return f"WITH {fx.D_FORCING} SELECT grid_id, variable, ts, k, {along} AS t, value FROM forcing WHERE {where}"


QUERIES = {
    "R1_relaxation_lambda_south": (_lambda("south"), _lambda_sql("j - 1")),
    "R1_relaxation_lambda_east": (_lambda("east"), _lambda_sql("nx + 1 - i")),
    "R2_snap_outlets": (r2_snap_outlets, R2_SQL),
    "R3_match_series_by_date": (r3_match_series_by_date, R3_SQL),
    "R4_match_outlets": (r4_match_outlets, R4_SQL),
    "R5_upsert_rivers": (r5_upsert_rivers, R5_SQL),
    "R5_add_rivers": (add_rivers_job, R5_SQL),
    "R6_collision_report": (r6_collision_report, R6_SQL),
    "R7_forcing_tendency": (r7_forcing_tendency, R7_SQL),
    "R8_boundary_series_north": (_boundary("north"), _boundary_sql("j = nj", "i")),
    "R8_boundary_series_west": (_boundary("west"), _boundary_sql("i = 1", "j")),
}
