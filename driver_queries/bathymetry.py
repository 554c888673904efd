"""Bathymetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coastgrid.functions.session import materialise, never_broadcast
from coastgrid.operators import bathymetry as bathy
from coastgrid.operators import grid, masks, soundings
from coastgrid.plans import BathymetryConfig, TableBathymetrySource, prepare_bathymetry
from driver_queries import fixtures as fx

NEAR = {"w": (-1, 0), "e": (1, 0), "s": (0, -1), "n": (0, 1), "se": (1, -1), "ne": (1, 1)}


def _near(source, sides):
    """A table with the neighbouring heights joined on."""
    joins = " ".join(
        f"LEFT JOIN {source} {s} ON {s}.grid_id = c.grid_id AND {s}.i = c.i + {NEAR[s][0]} AND {s}.j = c.j + {NEAR[s][1]}" for s in sides
    )
    return f"SELECT c.grid_id, c.nx, c.ny, c.i, c.j, c.h, {', '.join(f'{s}.h AS {s}' for s in sides)} FROM {source} c {joins}"


INTERIOR = "i > 1 AND i < nx AND j > 1 AND j < ny"


def _stage(source, sides, condition, value):
    return f"SELECT grid_id, nx, ny, i, j, CASE WHEN {condition} THEN {value} ELSE h END AS h FROM ({_near(source, sides)})"


def diagonal_sql(source):
    return _stage(source, ["s", "e", "se"], "h >= 0 AND se >= 0 AND s < 0 AND e < 0", "(s + e) / 2")


def secondary_sql(source):
    return _stage(source, ["n", "e", "ne"], "h >= 0 AND ne >= 0 AND n < 0 AND e < 0", "(n + e) / 2")


def isolated_sea_sql(source):
    sides = " + ".join(f"CASE WHEN {s} >= 0 THEN 1 ELSE 0 END" for s in "wesn")
    return _stage(source, list("wesn"), f"{INTERIOR} AND h < 0 AND {sides} >= 3", "0e0")


def isolated_land_sql(source):
    return _stage(source, list("wesn"), f"{INTERIOR} AND h >= 0 AND w < 0 AND e < 0 AND s < 0 AND n < 0", "(s + w + n + e) / 4")


def smooth_sql(source):
    """The chain of 22 stencils, each its own materialised step."""
    steps = [f"p0 AS MATERIALIZED ({diagonal_sql(source)})", f"p1 AS MATERIALIZED ({secondary_sql('p0')})"]
    for n in range(1, 11):
        steps.append(f"q{n} AS MATERIALIZED ({isolated_sea_sql(f'p{n}')})")
        steps.append(f"p{n + 1} AS MATERIALIZED ({isolated_land_sql(f'q{n}')})")
    return ", ".join(steps)


def spikes_sql(source, ratio):
    depths = ", ".join(f"CASE WHEN {s} < 0 THEN -{s} END" for s in "wesn")
    return f"""SELECT grid_id, nx, ny, i, j,
  CASE WHEN h < 0 AND len(d) >= 2 AND -h < {ratio} * list_median(d) THEN -list_median(d) ELSE h END AS h
FROM (SELECT *, list_filter([{depths}], lambda v: v IS NOT NULL) AS d FROM ({_near(source, list('wesn'))}))"""


def _cells(df):
    return df.select("grid_id", "i", "j", F.round("h", 6).alias("h"))


def _query(operator, **options):
    def query(spark, sf):
        return _cells(operator(fx.bathymetry(spark, sf), **options))

    return query


def _sql(text):
    return f"WITH {fx.D_BATHY} SELECT grid_id, i, j, round(h, 6) AS h FROM ({text})"


def b1_idw_grid(spark, sf):
    points = fx.points(spark, sf)
    soundings_ = soundings.depth_points(points, keep=("grid_id", "lon", "lat"))
    return _cells(soundings.idw_grid(soundings_, fx.domains(spark, sf)))


IDW = """near AS (
  SELECT s.grid_id, s.i, s.j, p.h, power(s.lon - p.lon, 2) + power(s.lat - p.lat, 2) AS d2,
         row_number() OVER (PARTITION BY s.grid_id, s.i, s.j
                            ORDER BY power(s.lon - p.lon, 2) + power(s.lat - p.lat, 2), p.lon, p.lat, p.h) AS rn
  FROM {spine} s JOIN (SELECT grid_id, lon, lat, -depth AS h FROM pts WHERE depth IS NOT NULL) p ON s.grid_id = p.grid_id
    AND power(s.lon - p.lon, 2) + power(s.lat - p.lat, 2) <= 1),
idw AS (SELECT grid_id, i, j, sum(h / (d2 + 4e-2)) / sum(1 / (d2 + 4e-2)) AS h FROM near WHERE rn <= 16 GROUP BY 1, 2, 3)"""
B1_SQL = f"""WITH {fx.D_SPINE}, {fx.D_POINTS}, {IDW.format(spine='spine')}
SELECT s.grid_id, s.i, s.j, round(coalesce(idw.h, 0e0), 6) AS h
FROM spine s LEFT JOIN idw ON idw.grid_id = s.grid_id AND idw.i = s.i AND idw.j = s.j"""


def _land(spark, sf, domains):
    features = soundings.read_land_features(fx.land(spark, sf), domains, ["land", "skerry"])
    polygons = soundings.polygon_edges(features.filter(F.col("layer") == "land"))
    # A skerry counts with its first vertex.
    skerries = features.filter(F.col("layer") == "skerry").select(
        "grid_id", F.col("geom")[0][0]["x"].alias("x"), F.col("geom")[0][0]["y"].alias("y")
    )
    return polygons, skerries


def b2_rasterize_land(spark, sf):
    """Domains lie on one another, the more the larger the table: features meet each place once."""
    shared, members = soundings.shared_grids(fx.domains(spark, sf))
    polygons, skerries = _land(spark, sf, shared)
    cells = soundings.rasterize_land(polygons, shared, skerries).withColumnRenamed("grid_id", "shared_id")
    return members.join(cells, "shared_id").select("grid_id", "i", "j")


# Even-odd by counting, per cell, the edges to its right; points by their cell.
LAND_CELLS = """edge AS (
  SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM land a JOIN land b ON a.id = b.id AND b.pos = (a.pos + 1) % 4
  WHERE a.layer = 'land'),
box AS (SELECT id, min(x) AS bx1, max(x) AS bx2, min(y) AS by1, max(y) AS by2 FROM land WHERE layer = 'land' GROUP BY 1),
inside AS (
  SELECT s.grid_id, s.i, s.j, b.id
  FROM {spine} s JOIN box b ON s.lon BETWEEN bx1 AND bx2 AND s.lat BETWEEN by1 AND by2
  JOIN edge e ON e.id = b.id AND ((e.y1 <= s.lat) <> (e.y2 <= s.lat))
    AND s.lon < e.x1 + (s.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1),
rock AS (
  SELECT grid_id, CAST(floor((x - west) / ((east - west) / nx)) AS INT) + 1 AS i,
         CAST(floor((y - south) / ((north - south) / ny)) AS INT) + 1 AS j
  FROM land JOIN {domain} d ON layer = 'skerry' AND pos = 0 AND x >= west AND x < east AND y >= south AND y < north),
burnt AS (SELECT grid_id, i, j FROM inside UNION SELECT grid_id, i, j FROM rock)"""
B2_SQL = f"WITH {fx.D_SPINE}, {fx.D_LAND}, {LAND_CELLS.format(spine='spine', domain='domain')} SELECT DISTINCT grid_id, i, j FROM burnt"


def _target(domains):
    """A coarser grid on the same box."""
    return domains.withColumns({"nx": (F.col("nx") - 5).cast("int"), "ny": (F.col("ny") - 3).cast("int")})


def b3_regrid_bathymetry(spark, sf):
    d = fx.domains(spark, sf)
    return _cells(bathy.regrid_bathymetry(fx.bathymetry(spark, sf), d, _target(d), minimum_depth=3.0))


def b3_regrid_tiles(spark, sf):
    """The same over native tiles of 4 cells; most targets have corners in two or four of them."""
    d = fx.domains(spark, sf)
    return _cells(bathy.regrid_bathymetry(fx.bathymetry(spark, sf), d, _target(d), minimum_depth=3.0, size=4))


def regrid_sql(source, domain, target, name, minimum_depth):
    """Bilinear lookup of four corners, clamped at the outer centres."""
    return f"""{name}_f AS (
  SELECT t.grid_id, t.nx, t.ny, t.i, t.j,
         greatest(0e0, least((t.lon - d.west) / ((d.east - d.west) / d.nx) - 5e-1, CAST(d.nx - 1 AS DOUBLE))) AS fx,
         greatest(0e0, least((t.lat - d.south) / ((d.north - d.south) / d.ny) - 5e-1, CAST(d.ny - 1 AS DOUBLE))) AS fy,
         d.nx AS sx, d.ny AS sy
  FROM {target} t JOIN {domain} d USING (grid_id)),
{name}_n AS (SELECT *, least(CAST(floor(fx) AS INT), sx - 2) AS a, least(CAST(floor(fy) AS INT), sy - 2) AS b FROM {name}_f),
{name}_h AS (
  SELECT n.grid_id, n.nx, n.ny, n.i, n.j,
         (1 - (fx - a)) * (1 - (fy - b)) * c00.h + (fx - a) * (1 - (fy - b)) * c10.h
           + (1 - (fx - a)) * (fy - b) * c01.h + (fx - a) * (fy - b) * c11.h AS h
  FROM {name}_n n
  JOIN {source} c00 ON c00.grid_id = n.grid_id AND c00.i = a + 1 AND c00.j = b + 1
  JOIN {source} c10 ON c10.grid_id = n.grid_id AND c10.i = a + 2 AND c10.j = b + 1
  JOIN {source} c01 ON c01.grid_id = n.grid_id AND c01.i = a + 1 AND c01.j = b + 2
  JOIN {source} c11 ON c11.grid_id = n.grid_id AND c11.i = a + 2 AND c11.j = b + 2),
{name} AS (SELECT grid_id, nx, ny, i, j, CASE WHEN h < 0 THEN least(h, -{minimum_depth}) ELSE h END AS h FROM {name}_h)"""


TARGET_SPINE = """target AS (
  SELECT grid_id, nx - 5 AS nx, ny - 3 AS ny, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
         west + (i - 5e-1) * ((east - west) / (nx - 5)) AS lon, south + (j - 5e-1) * ((north - south) / (ny - 3)) AS lat
  FROM domain, LATERAL (SELECT unnest(generate_series(1, nx - 5)) AS i), LATERAL (SELECT unnest(generate_series(1, ny - 3)) AS j))"""
B3_SQL = f"""WITH {fx.D_BATHY}, {TARGET_SPINE}, {regrid_sql('bathy', 'domain', 'target', 're', '3e0')}
SELECT grid_id, i, j, round(h, 6) AS h FROM re"""


def b8_connected_basins(spark, sf):
    return bathy.connected_basins(fx.bathymetry(spark, sf), size=8)


# Reachability within each domain; the lowest cell number names the basin.
BASINS = """sea AS (SELECT grid_id, nx, i, j, i + (j - 1) * nx AS cell FROM {source} WHERE h < 0),
link AS (SELECT a.grid_id, a.cell AS u, b.cell AS v FROM sea a JOIN sea b ON a.grid_id = b.grid_id
         AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
reach AS (SELECT grid_id, cell AS u, cell AS v FROM sea
          UNION SELECT r.grid_id, r.u, l.v FROM reach r JOIN link l ON l.grid_id = r.grid_id AND l.u = r.v),
basin AS (SELECT s.grid_id, s.i, s.j, CAST(min(r.v) AS BIGINT) AS basin FROM sea s JOIN reach r ON r.grid_id = s.grid_id AND r.u = s.cell
          GROUP BY 1, 2, 3),
ranked AS (SELECT grid_id, basin, row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, basin) AS rk FROM basin GROUP BY 1, 2)"""
B8_SQL = f"WITH RECURSIVE {fx.D_BATHY}, {BASINS.format(source='bathy')} SELECT grid_id, i, j, basin FROM basin"
KEPT = """SELECT b.grid_id, b.i, b.j, round(CASE WHEN b.h < 0 AND r.rk > {n} THEN 0e0 ELSE b.h END, 6) AS h
FROM {source} b LEFT JOIN basin c ON c.grid_id = b.grid_id AND c.i = b.i AND c.j = b.j
LEFT JOIN ranked r ON r.grid_id = c.grid_id AND r.basin = c.basin"""
B8_KEEP_SQL = f"WITH RECURSIVE {fx.D_BATHY}, {BASINS.format(source='bathy')} {KEPT.format(n=2, source='bathy')}"

SLOPE_LIMIT = 0.3


# Limited heights have few decimals; a shift keeps them off rounding boundaries, where engines differ.
OFF_HALVES = 1.23456789e-7


def _off_halves(df):
    return df.select("grid_id", "i", "j", F.round(F.col("h") + OFF_HALVES, 6).alias("h"))


def b10_limit_bottom_slope(spark, sf):
    return _off_halves(bathy.limit_bottom_slope(fx.bathymetry(spark, sf), SLOPE_LIMIT))


def b10_limit_slope_tiles(spark, sf):
    """Over tiles of 5 cells, one pass a round: tiles settle at different times and are woken by their neighbours."""
    return _off_halves(bathy.limit_bottom_slope(fx.bathymetry(spark, sf), SLOPE_LIMIT, passes_per_round=1, max_passes=6, size=5))


def slope_sql(passes):
    """All sweeps one after the other: each turn pairs a cell with one neighbour, by axis and parity of its index."""
    step = lambda n, axis: f"CASE WHEN (turn // 2) % 2 = {axis} THEN CASE WHEN {n} % 2 = turn % 2 THEN 1 ELSE -1 END ELSE 0 END"
    deep, other = "(-s.h)", "(-p.h)"
    shift = f"(abs({deep} - {other}) - {SLOPE_LIMIT} * ({deep} + {other})) / 2"
    return f"""WITH RECURSIVE {fx.D_BATHY},
sweep AS (
  SELECT 0 AS turn, grid_id, i, j, h FROM bathy
  UNION ALL
  SELECT s.turn + 1, s.grid_id, s.i, s.j,
         CASE WHEN s.h < 0 AND p.h < 0 AND abs({deep} - {other}) / ({deep} + {other}) > {SLOPE_LIMIT} + 1e-9
              THEN -greatest(CASE WHEN {deep} > {other} THEN {deep} - {shift} ELSE {deep} + {shift} END, 0e0) ELSE s.h END
  FROM (SELECT *, i + {step('i', 0)} AS pi, j + {step('j', 1)} AS pj FROM sweep WHERE turn < {4 * passes}) s
  LEFT JOIN sweep p ON p.grid_id = s.grid_id AND p.i = s.pi AND p.j = s.pj)
SELECT grid_id, i, j, round(h + {OFF_HALVES!r}, 6) AS h FROM sweep WHERE turn = {4 * passes}"""


def b10_slope_invariants(spark, sf):
    """What any sweep order must keep: volume, land, and no pair steeper than the limit."""
    cells = materialise(fx.bathymetry(spark, sf))
    # As a file they are far smaller than as rows.
    before = never_broadcast(cells.select("grid_id", "i", "j", F.col("h").alias("h0")))
    after = bathy.limit_bottom_slope(cells, SLOPE_LIMIT)
    near = bathy.with_neighbours(after, ["grid_id"], "h")
    r = F.greatest(
        F.coalesce(bathy.slope_factor(F.col("h"), F.col("east")), F.lit(0.0)),
        F.coalesce(bathy.slope_factor(F.col("h"), F.col("north")), F.lit(0.0)),
    )
    both = near.withColumn("r", r).join(before, ["grid_id", "i", "j"])
    return both.groupBy("grid_id").agg(
        F.round(F.sum(F.when(F.col("h") < 0, F.col("h")).otherwise(F.lit(0.0))), 4).alias("volume"),
        F.count_if(F.col("h") < 0).alias("sea_cells"),
        (F.max("r") <= SLOPE_LIMIT + 1e-9).alias("within_limit"),
        F.bool_and((F.col("h0") < 0) | (F.col("h") == F.col("h0"))).alias("land_fixed"),
    )


B10_SQL = f"""WITH {fx.D_BATHY}
SELECT grid_id, round(sum(CASE WHEN h < 0 THEN h ELSE 0e0 END), 4) AS volume, count(*) FILTER (h < 0) AS sea_cells,
       true AS within_limit, true AS land_fixed FROM bathy GROUP BY 1"""


def b11_prepare_bathymetry(spark, sf):
    """Soundings to cleaned bathymetry: grid, burn land, regrid, keep a basin, smooth, despike."""
    d = fx.domains(spark, sf)
    region = grid.native_region(d, 1, 1)
    edges, skerries = _land(spark, sf, region)
    source = TableBathymetrySource(
        points=soundings.depth_points(fx.points(spark, sf), keep=("grid_id", "lon", "lat")),
        edges=edges,
        skerries=skerries,
        regrid_options={"minimum_depth": 3.0},
        smoothing_options={"spike_ratio": 0.5},
    )
    return _cells(prepare_bathymetry(source, d, BathymetryConfig(padding_cells=1, major_basins=1)))


B11_SQL = f"""WITH RECURSIVE {fx.D_SPINE}, {fx.D_POINTS}, {fx.D_LAND},
region AS (SELECT grid_id, CAST(greatest(nx + 2, 24) AS INT) AS nx, CAST(greatest(ny + 2, 24) AS INT) AS ny,
                  west - (east - west) / nx AS west, east + (east - west) / nx AS east,
                  south - (north - south) / ny AS south, north + (north - south) / ny AS north FROM domain),
rspine AS (SELECT grid_id, nx, ny, CAST(i AS INT) AS i, CAST(j AS INT) AS j, west + (i - 5e-1) * ((east - west) / nx) AS lon,
                  south + (j - 5e-1) * ((north - south) / ny) AS lat
           FROM region, LATERAL (SELECT unnest(generate_series(1, nx)) AS i), LATERAL (SELECT unnest(generate_series(1, ny)) AS j)),
{IDW.format(spine='rspine')}, {LAND_CELLS.format(spine='rspine', domain='region')},
native AS (SELECT s.grid_id, s.nx, s.ny, s.i, s.j, CASE WHEN b.i IS NOT NULL THEN 0e0 ELSE coalesce(idw.h, 0e0) END AS h
           FROM rspine s LEFT JOIN idw ON idw.grid_id = s.grid_id AND idw.i = s.i AND idw.j = s.j
           LEFT JOIN burnt b ON b.grid_id = s.grid_id AND b.i = s.i AND b.j = s.j),
{regrid_sql('native', 'region', 'spine', 're', '3e0')},
{BASINS.format(source='re')},
kept AS (SELECT b.grid_id, b.nx, b.ny, b.i, b.j, CASE WHEN b.h < 0 AND r.rk > 1 THEN 0e0 ELSE b.h END AS h
         FROM re b LEFT JOIN basin c ON c.grid_id = b.grid_id AND c.i = b.i AND c.j = b.j
         LEFT JOIN ranked r ON r.grid_id = c.grid_id AND r.basin = c.basin),
{smooth_sql('kept')}
SELECT grid_id, i, j, round(h, 6) AS h FROM ({spikes_sql('p11', '5e-1')})"""


def flagship(spark, sf):
    """Cleaned bathymetry to wet cells and volume per domain and layer."""
    b = bathy.fill_isolated_land(bathy.remove_isolated_sea(fx.bathymetry(spark, sf)))
    mask = masks.water_mask(b, fx.domains(spark, sf))
    return mask.groupBy("grid_id", "k").agg(
        F.count_if("wet").alias("wet_cells"), F.round(F.sum("thickness"), 6).alias("column_metres")
    )


FLAGSHIP_SQL = f"""WITH {fx.D_BATHY}, {fx.D_LEVELS}, a AS ({isolated_sea_sql('bathy')}), b AS ({isolated_land_sql('a')})
SELECT grid_id, CAST(k AS INT) AS k, count(*) FILTER (h < zt) AS wet_cells,
       round(sum(CASE WHEN h < zt THEN greatest(zt - greatest(h, zb), 2e-1 * (zt - zb)) ELSE 0e0 END), 6) AS column_metres
FROM b CROSS JOIN levels GROUP BY 1, 2"""


def b4_both(spark, sf):
    return _cells(bathy.fill_secondary_diagonal_pairs(bathy.fill_diagonal_pairs(fx.bathymetry(spark, sf))))


B4_BOTH_SQL = f"""WITH {fx.D_BATHY}, a AS ({diagonal_sql('bathy')})
SELECT grid_id, i, j, round(h, 6) AS h FROM ({secondary_sql('a')})"""

QUERIES = {
    "B1_idw_grid": (b1_idw_grid, B1_SQL),
    "B2_rasterize_land": (b2_rasterize_land, B2_SQL),
    "B3_regrid_bathymetry": (b3_regrid_bathymetry, B3_SQL),
    "B3_regrid_tiles": (b3_regrid_tiles, B3_SQL),
    "B4_fill_diagonal_pairs": (_query(bathy.fill_diagonal_pairs), _sql(diagonal_sql("bathy"))),
    "B4_fill_both_diagonals": (b4_both, B4_BOTH_SQL),
    "B5_remove_isolated_sea": (_query(bathy.remove_isolated_sea), _sql(isolated_sea_sql("bathy"))),
    "B6_fill_isolated_land": (_query(bathy.fill_isolated_land), _sql(isolated_land_sql("bathy"))),
    "B7_smooth_gaps": (
        _query(bathy.smooth_gaps),
        f"WITH {fx.D_BATHY}, {smooth_sql('bathy')} SELECT grid_id, i, j, round(h, 6) AS h FROM p11",
    ),
    # The stencils once more over tiles of 8 cells, so that every domain is crossed by tile borders.
    "B4_diagonal_pairs_tiles": (_query(bathy.fill_diagonal_pairs, size=8), _sql(diagonal_sql("bathy"))),
    "B5_isolated_sea_tiles": (_query(bathy.remove_isolated_sea, size=8), _sql(isolated_sea_sql("bathy"))),
    "B6_isolated_land_tiles": (_query(bathy.fill_isolated_land, size=8), _sql(isolated_land_sql("bathy"))),
    "B7_smooth_gaps_tiles": (
        _query(bathy.smooth_gaps, size=8),
        f"WITH {fx.D_BATHY}, {smooth_sql('bathy')} SELECT grid_id, i, j, round(h, 6) AS h FROM p11",
    ),
    "B9_shallow_spikes_tiles": (_query(bathy.fill_shallow_spikes, ratio=0.5, size=8), _sql(spikes_sql("bathy", "5e-1"))),
    "B8_connected_basins": (b8_connected_basins, B8_SQL),
    "B8_keep_major_basins": (_query(bathy.keep_major_basins, n=2), B8_KEEP_SQL),
    "B9_fill_shallow_spikes": (_query(bathy.fill_shallow_spikes, ratio=0.5), _sql(spikes_sql("bathy", "5e-1"))),
    # A domain of the driver's tables is settled well before the last of these passes, which then change nothing.
    "B10_limit_bottom_slope": (b10_limit_bottom_slope, slope_sql(100)),
    "B10_limit_slope_tiles": (b10_limit_slope_tiles, slope_sql(6)),
    "B10_slope_invariants": (b10_slope_invariants, B10_SQL),
    "B11_prepare_bathymetry": (b11_prepare_bathymetry, B11_SQL),
    "wet_volume_by_layer": (flagship, FLAGSHIP_SQL),
}
