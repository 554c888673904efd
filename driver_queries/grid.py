"""Grid, axis and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coastgrid.functions.crs import LambertConformalSphere, PolarStereographic, TransverseMercator
from coastgrid.operators import grid
from driver_queries import fixtures as fx
from driver_queries.sources import EVENT_FIELD_SQL, event_field

UTM33 = TransverseMercator.utm(33)
STEREO = PolarStereographic(lon0=70.0, lat_ts=60.0)
LCC = LambertConformalSphere(lon0=-42.0, lat0=66.3, lat1=66.3, lat2=66.3)


def g1_grid_spine(spark, sf):
    d = fx.domains(spark, sf)
    out = grid.grid_spine(d, "fcc")
    return out.select("grid_id", "i", "j", "k", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "z")])


G1_SQL = f"""WITH {fx.D_DOMAIN}, {fx.D_LEVELS}
SELECT grid_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k,
       round(west + (i - 1) * (east - west) / nx, 6) AS lon, round(south + (j - 5e-1) * (north - south) / ny, 6) AS lat,
       round((zb + zt) / 2, 6) AS z
FROM domain, LATERAL (SELECT unnest(generate_series(1, nx + 1)) AS i), LATERAL (SELECT unnest(generate_series(1, ny)) AS j)
CROSS JOIN levels"""


def _axis(df, array):
    return df.select("grid_id", F.posexplode(array).alias("p", "v")).select(
        "grid_id", (F.col("p") + 1).alias("idx"), F.round("v", 6).alias("value")
    )


def g2_center_axis(spark, sf):
    return _axis(grid.center_axis(fx.domains(spark, sf), "south", "north", "ny"), "axis")


G2_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id, CAST(m AS INT) AS idx, round(south + (m - 5e-1) * (north - south) / ny, 6) AS value
FROM domain, LATERAL (SELECT unnest(generate_series(1, ny)) AS m)"""


def g3_faces_from_centers(spark, sf):
    centers = grid.center_axis(fx.domains(spark, sf), "west", "east", "nx").select(
        "grid_id", F.posexplode("axis").alias("p", "lon")
    )
    rows = centers.select("grid_id", (F.col("p") + 1).alias("i"), "lon")
    return grid.faces_from_centers(rows, ["grid_id"], "i", "lon").select("grid_id", "idx", F.round("face", 6).alias("face"))


G3_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id, CAST(m AS INT) AS idx, round(west + (m - 1) * (east - west) / nx, 6) AS face
FROM domain, LATERAL (SELECT unnest(generate_series(1, nx + 1)) AS m)"""


def g4_uniform_axis(spark, sf):
    return _axis(grid.uniform_axis(fx.domains(spark, sf), "west", "east", 0.13, 0.03), "axis")


G4_SQL = f"""WITH {fx.D_DOMAIN}, s AS (
  SELECT grid_id, floor((west - 13e-2) / 3e-2) * 3e-2 AS first, east FROM domain)
SELECT grid_id, CAST(m + 1 AS INT) AS idx, round(first + m * 3e-2, 6) AS value
FROM s, LATERAL (SELECT unnest(generate_series(0, CAST(ceil((east + 13e-2 - first) / 3e-2) AS BIGINT))) AS m)"""


def g5_expand_domain(spark, sf):
    return grid.expand_domain(fx.domains(spark, sf), 3).select(
        "grid_id", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north")]
    )


G5_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id, round(west - 3 * (east - west) / nx, 6) AS west, round(east + 3 * (east - west) / nx, 6) AS east,
       round(south - 3 * (north - south) / ny, 6) AS south, round(north + 3 * (north - south) / ny, 6) AS north FROM domain"""


def g6_native_region(spark, sf):
    return grid.native_region(fx.domains(spark, sf), factor=1, padding_cells=2).select(
        "grid_id", "nx", "ny", F.round("west", 6).alias("west"), F.round("north", 6).alias("north")
    )


G6_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id, CAST(greatest(nx + 4, 24) AS INT) AS nx, CAST(greatest(ny + 4, 24) AS INT) AS ny,
       round(west - 2 * (east - west) / nx, 6) AS west, round(north + 2 * (north - south) / ny, 6) AS north FROM domain"""


def g7_vertical_levels(spark, sf):
    return grid.vertical_levels(fx.domains(spark, sf))


G7_SQL = f"""WITH {fx.D_DOMAIN}, {fx.D_LEVELS}
SELECT grid_id, CAST(k AS INT) AS k, zb AS z_bottom, zt AS z_top, (zb + zt) / 2 AS z_center FROM domain CROSS JOIN levels"""


def _projected(crs):
    def query(spark, sf):
        out = grid.project(fx.spine(spark, sf), crs)
        return out.select("grid_id", "i", "j", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))

    return query


def _unprojected(crs):
    def query(spark, sf):
        there = grid.project(fx.spine(spark, sf), crs).drop("lon", "lat")
        return grid.unproject(there, crs).select(
            "grid_id", "i", "j", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")
        )

    return query


# Transverse Mercator written with conformal latitude and complex Mercator coordinates.
UTM_EXPR = """
  SELECT grid_id, i, j, nn, ee,
         500000 + 9996e-4 * 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * (ee
           + (n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180) * cos(2*nn) * sinh(2*ee)
           + (13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440) * cos(4*nn) * sinh(4*ee)
           + (61*n*n*n/240 - 103*n*n*n*n/140) * cos(6*nn) * sinh(6*ee)
           + (49561*n*n*n*n/161280) * cos(8*nn) * sinh(8*ee)) AS x,
         9996e-4 * 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * (nn
           + (n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180) * sin(2*nn) * cosh(2*ee)
           + (13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440) * sin(4*nn) * cosh(4*ee)
           + (61*n*n*n/240 - 103*n*n*n*n/140) * sin(6*nn) * cosh(6*ee)
           + (49561*n*n*n*n/161280) * sin(8*nn) * cosh(8*ee)) AS y
  FROM (SELECT grid_id, i, j, n, atan2(t, cos(l)) AS nn, atanh(sin(l) / sqrt(1 + t * t)) AS ee
        FROM (SELECT grid_id, i, j, l, n, sinh(atanh(sin(p)) - 2*sqrt(n)/(1+n) * atanh(2*sqrt(n)/(1+n) * sin(p))) AS t
              FROM (SELECT grid_id, i, j, radians({lon} - 15) AS l, radians({lat}) AS p, 1 / (2 * 298257222101e-9 - 1) AS n
                    FROM {src})))"""


def _utm_sql(src, lon="lon", lat="lat"):
    return UTM_EXPR.format(src=src, lon=lon, lat=lat)


G8_UTM_SQL = f"WITH {fx.D_SPINE} SELECT grid_id, i, j, round(x, 2) AS x, round(y, 2) AS y FROM ({_utm_sql('spine')})"
STEREO_T = "tan(pi()/4 - {p}/2) / pow((1 - e*sin({p})) / (1 + e*sin({p})), e/2)"
G8_STEREO_SQL = f"""WITH {fx.D_SPINE},
a AS (SELECT grid_id, i, j, radians(lon - 70) AS l, radians(lat) AS p, radians(60) AS pc,
             sqrt(2/298257223563e-9 - 1/(298257223563e-9 * 298257223563e-9)) AS e FROM spine),
b AS (SELECT *, {STEREO_T.format(p='p')} AS t, {STEREO_T.format(p='pc')} AS tc, cos(pc)/sqrt(1 - e*e*sin(pc)*sin(pc)) AS mc FROM a)
SELECT grid_id, i, j, round(6378137 * mc * t / tc * sin(l), 2) AS x, round(-6378137 * mc * t / tc * cos(l), 2) AS y FROM b"""
# One standard parallel: the cone constant is its sine, and rho follows from the tangent cone.
G8_LCC_SQL = f"""WITH {fx.D_SPINE},
a AS (SELECT grid_id, i, j, sin(radians(663e-1)) AS n, radians(lon + 42) AS l,
             ln(tan(pi()/4 + radians(lat)/2) / tan(pi()/4 + radians(663e-1)/2)) AS q FROM spine),
b AS (SELECT *, 6371000 / tan(radians(663e-1)) AS r0, 6371000 / tan(radians(663e-1)) * exp(-n * q) AS r FROM a)
SELECT grid_id, i, j, round(r * sin(n * l), 2) AS x, round(r0 - r * cos(n * l), 2) AS y FROM b"""
G8_BACK_SQL = f"WITH {fx.D_SPINE} SELECT grid_id, i, j, round(lon, 6) AS lon, round(lat, 6) AS lat FROM spine"


def g9_bbox_in_crs(spark, sf):
    return grid.bbox_in_crs(fx.domains(spark, sf), UTM33).select(
        "grid_id", *[F.round(c, 2).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    )


G9_SQL = f"""WITH {fx.D_DOMAIN},
corner AS (SELECT grid_id, 0 AS i, 0 AS j, west AS lon, south AS lat FROM domain UNION ALL SELECT grid_id, 0, 1, west, north FROM domain
  UNION ALL SELECT grid_id, 1, 0, east, south FROM domain UNION ALL SELECT grid_id, 1, 1, east, north FROM domain)
SELECT grid_id, round(min(x), 2) AS x_min, round(min(y), 2) AS y_min, round(max(x), 2) AS x_max, round(max(y), 2) AS y_max
FROM ({_utm_sql('corner')}) GROUP BY 1"""


def g10_grid_rotation_angle(spark, sf):
    return grid.grid_rotation_angle(fx.curvilinear(spark, sf)).select("dataset", "i", "j", F.round("angle", 6).alias("angle"))


ANGLE = """angle AS (
  SELECT c.*, atan2(coalesce(e.lat - c.lat, c.lat - w.lat), coalesce(e.lon - c.lon, c.lon - w.lon) * cos(radians(c.lat))) AS angle
  FROM curvi c LEFT JOIN curvi e ON e.dataset = c.dataset AND e.j = c.j AND e.i = c.i + 1
  LEFT JOIN curvi w ON w.dataset = c.dataset AND w.j = c.j AND w.i = c.i - 1)"""
G10_SQL = f"WITH {fx.D_CURVI}, {ANGLE} SELECT dataset, i, j, round(angle, 6) AS angle FROM angle"


def g11_rotate_vectors(spark, sf):
    turned = grid.rotate_vectors(grid.grid_rotation_angle(fx.curvilinear(spark, sf)))
    return turned.select("dataset", "i", "j", F.round("east", 6).alias("east"), F.round("north", 6).alias("north"))


G11_SQL = f"""WITH {fx.D_CURVI}, {ANGLE}
SELECT dataset, i, j, round(u * cos(angle) - v * sin(angle), 6) AS east, round(v * cos(angle) + u * sin(angle), 6) AS north FROM angle"""


def g12_grid_extent_summary(spark, sf):
    out = grid.grid_extent_summary(fx.domains(spark, sf))
    return out.select("grid_id", "nx", "ny", *[F.round(c, 4).alias(c) for c in out.columns if c[0] == "d"])


G12_SQL = f"""WITH {fx.D_SPINE},
s AS (SELECT s.grid_id, s.nx, s.ny, 6371000 * radians((east - west) / s.nx) * cos(radians(lat)) AS dx,
             6371000 * radians((north - south) / s.ny) AS dy FROM spine s JOIN domain USING (grid_id))
SELECT grid_id, nx, ny, round(min(dx), 4) AS dx_min, round(max(dx), 4) AS dx_max, round(avg(dx), 4) AS dx_mean,
       round(min(dy), 4) AS dy_min, round(max(dy), 4) AS dy_max, round(avg(dy), 4) AS dy_mean FROM s GROUP BY 1, 2, 3"""


def g13_stagger_columns(spark, sf):
    names = F.array(*[F.lit(v) for v in ("T", "S", "u", "v")])
    variables = fx.domains(spark, sf).select("grid_id", "nx", "ny", F.explode(names).alias("variable"))
    return grid.stagger_columns(variables).select("grid_id", "variable", "loc", "ni", "nj")


G13_SQL = f"""WITH {fx.D_DOMAIN}
SELECT grid_id, variable, loc, CAST(nx + fx AS INT) AS ni, CAST(ny + fy AS INT) AS nj
FROM domain CROSS JOIN (VALUES ('T', 'ccc', 0, 0), ('S', 'ccc', 0, 0), ('u', 'fcc', 1, 0), ('v', 'cfc', 0, 1)) AS t(variable, loc, fx, fy)"""

RENAMES = {"view": "u_wind_10m", "click": "precipitation", "error": "swrad", "signup": "lwrad", "purchase": "spare"}


def g14_rename_variables(spark, sf):
    return grid.rename_variables(event_field(spark, sf), RENAMES, ["view", "click", "error", "unknown"])


def g15_attach_units(spark, sf):
    renamed = grid.rename_variables(event_field(spark, sf), RENAMES, list(RENAMES))
    return grid.attach_units(renamed)


EVENTS = fx.duck(EVENT_FIELD_SQL)
G14_SQL = f"""SELECT CASE variable WHEN 'view' THEN 'u_wind_10m' WHEN 'click' THEN 'precipitation' ELSE 'swrad' END AS variable,
       ts, i, j, value FROM ({EVENTS}) WHERE variable IN ('view', 'click', 'error')"""
G15_SQL = f"""SELECT m.prepared AS variable, ts, i, j, value, units, long_name FROM ({EVENTS}) e
JOIN (VALUES ('view', 'u_wind_10m', 'm s-1', 'Eastward component of 10 metre wind'),
             ('click', 'precipitation', 'kg m-2 s-1', 'Precipitation flux'),
             ('error', 'swrad', 'W m-2', 'Surface downwelling shortwave radiation'),
             ('signup', 'lwrad', 'W m-2', 'Surface downwelling longwave radiation'),
             ('purchase', 'spare', NULL, NULL)) AS m(source, prepared, units, long_name) ON m.source = e.variable"""

QUERIES = {
    "G1_grid_spine": (g1_grid_spine, G1_SQL),
    "G2_center_axis": (g2_center_axis, G2_SQL),
    "G3_faces_from_centers": (g3_faces_from_centers, G3_SQL),
    "G4_uniform_axis": (g4_uniform_axis, G4_SQL),
    "G5_expand_domain": (g5_expand_domain, G5_SQL),
    "G6_native_region": (g6_native_region, G6_SQL),
    "G7_vertical_levels": (g7_vertical_levels, G7_SQL),
    "G8_project_utm": (_projected(UTM33), G8_UTM_SQL),
    "G8_project_stereographic": (_projected(STEREO), G8_STEREO_SQL),
    "G8_project_lambert": (_projected(LCC), G8_LCC_SQL),
    "G8_unproject_utm": (_unprojected(UTM33), G8_BACK_SQL),
    "G8_unproject_stereographic": (_unprojected(STEREO), G8_BACK_SQL),
    "G8_unproject_lambert": (_unprojected(LCC), G8_BACK_SQL),
    "G9_bbox_in_crs": (g9_bbox_in_crs, G9_SQL),
    "G10_grid_rotation_angle": (g10_grid_rotation_angle, G10_SQL),
    "G11_rotate_vectors": (g11_rotate_vectors, G11_SQL),
    "G12_grid_extent_summary": (g12_grid_extent_summary, G12_SQL),
    "G13_stagger_columns": (g13_stagger_columns, G13_SQL),
    "G14_rename_variables": (g14_rename_variables, G14_SQL),
    "G15_attach_units": (g15_attach_units, G15_SQL),
}
