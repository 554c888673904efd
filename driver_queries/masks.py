"""Subset, mask and validity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coastgrid.operators import masks
from driver_queries import fixtures as fx


def _box(spark, sf):
    """Curvilinear cells with the middle part of their grid as the box."""
    box = fx.domains(spark, sf).select(
        F.col("grid_id").alias("dataset"),
        (F.col("west") + 0.1).alias("w"),
        (F.col("west") + 0.25).alias("e"),
        (F.col("south") + 0.1).alias("s"),
        (F.col("south") + 0.2).alias("n"),
    )
    return fx.curvilinear(spark, sf).join(box, "dataset")


def _subset(margin):
    def query(spark, sf):
        c = [F.col(x) for x in ("w", "e", "s", "n")]
        out = masks.subset_box(_box(spark, sf), *c, values=("u", "v"), margin=margin)
        return out.select("dataset", "i", "j", "u", "v")

    return query


def _subset_sql(grown, blank):
    value = "CASE WHEN inside THEN {c} END" if blank else "{c}"
    return f"""WITH {fx.D_CURVI},
a AS (SELECT c.*, lon BETWEEN west + 1e-1 AND west + 25e-2 AND lat BETWEEN south + 1e-1 AND south + 2e-1 AS inside
      FROM curvi c JOIN domain d ON d.grid_id = c.dataset),
b AS (SELECT dataset, min(i) AS i1, max(i) AS i2, min(j) AS j1, max(j) AS j2 FROM a WHERE inside GROUP BY 1)
SELECT dataset, i, j, {value.format(c='u')} AS u, {value.format(c='v')} AS v FROM a JOIN b USING (dataset)
WHERE i BETWEEN i1 - {grown} AND i2 + {grown} AND j BETWEEN j1 - {grown} AND j2 + {grown}"""


def f3_water_mask(spark, sf):
    mask = masks.water_mask(fx.bathymetry(spark, sf), fx.domains(spark, sf))
    return mask.select("grid_id", "i", "j", "k", "wet", F.round("thickness", 6).alias("thickness"))


F3_SQL = f"""WITH {fx.D_FACES}
SELECT grid_id, i, j, k, wet, CASE WHEN wet THEN round(greatest(zt - greatest(h, zb), 2e-1 * (zt - zb)), 6) ELSE 0e0 END AS thickness
FROM tmask"""


def f3_water_mask_drop(spark, sf):
    """Slivers below the least fraction are dry."""
    return masks.water_mask(fx.bathymetry(spark, sf), fx.domains(spark, sf), mode="drop").select("grid_id", "i", "j", "k", "wet")


F3_DROP_SQL = f"WITH {fx.D_FACES} SELECT grid_id, i, j, k, h <= zt - 2e-1 * (zt - zb) AS wet FROM tmask"


def _faces(loc, edge=None):
    def query(spark, sf):
        return masks.water_mask(fx.bathymetry(spark, sf), fx.domains(spark, sf), loc, edge).select("grid_id", "i", "j", "k", "wet")

    return query


F3_U_SQL = f"WITH {fx.D_FACES} SELECT grid_id, i, j, k, wet FROM umask"
F3_V_SQL = f"WITH {fx.D_FACES} SELECT grid_id, i, j, k, wet FROM vmask"
OPEN_SOUTH = "SELECT grid_id, i, j, k, CASE WHEN j = 1 THEN h < zt ELSE wet END AS wet FROM vmask JOIN (SELECT grid_id, i, j AS _j, k, h, zt FROM tmask WHERE j = 1) t USING (grid_id, i, k)"
F4_SQL = f"WITH {fx.D_FACES} {OPEN_SOUTH}"


def f4_open_edge(spark, sf):
    """The same through the mask-to-mask operator."""
    b, d = fx.bathymetry(spark, sf), fx.domains(spark, sf)
    closed, tracer = masks.water_mask(b, d, "cfc"), masks.water_mask(b, d)
    return masks.open_edge(closed, tracer, "cfc", "south").select("grid_id", "i", "j", "k", "wet")


def f5_surface_slice(spark, sf):
    return masks.surface_slice(fx.forcing(spark, sf), ["grid_id", "variable"]).select(
        "grid_id", "variable", "ts", "k", "j", "i", "value"
    )


F5_SQL = f"""WITH {fx.D_FORCING}
SELECT grid_id, variable, ts, k, j, i, value FROM forcing WHERE k = 6 AND ts = TIMESTAMP '1995-01-01 12:00:00'"""


def surface_mask(spark, sf):
    mask = masks.water_mask(fx.bathymetry(spark, sf), fx.domains(spark, sf))
    return mask.filter(F.col("k") == len(fx.Z_FACES) - 1).select("grid_id", "nx", "ny", "i", "j", "wet")


def f6_coastal_cells(spark, sf):
    return masks.coastal_cells(surface_mask(spark, sf)).select("grid_id", "i", "j")


COAST = """coast AS (
  SELECT a.grid_id, a.i, a.j FROM tmask a JOIN tmask b ON a.grid_id = b.grid_id AND a.k = 6 AND b.k = 6
    AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1
  WHERE a.wet GROUP BY 1, 2, 3 HAVING bool_or(NOT b.wet))"""
F6_SQL = f"WITH {fx.D_FACES}, {COAST} SELECT grid_id, i, j FROM coast"


def f7_validity(spark, sf):
    return masks.validity(fx.source_values(spark, sf))


F7_SQL = f"""WITH {fx.D_SOURCE}
SELECT dataset, lev, i, j, value IS NOT NULL AS valid FROM src WHERE ts = TIMESTAMP '1995-01-01 12:00:00'"""


def f7_level_validity(spark, sf):
    return masks.level_validity(masks.validity(fx.source_values(spark, sf)))


F7_LEVEL_SQL = f"""WITH {fx.D_SOURCE}
SELECT dataset, lev, count(value) > 0 AS level_valid FROM src WHERE ts = TIMESTAMP '1995-01-01 12:00:00' GROUP BY 1, 2"""

QUERIES = {
    "F1_subset_box": (_subset(None), _subset_sql(0, True)),
    "F2_subset_box_margin": (_subset(2), _subset_sql(2, False)),
    "F3_water_mask": (f3_water_mask, F3_SQL),
    "F3_water_mask_drop": (f3_water_mask_drop, F3_DROP_SQL),
    "F3_water_mask_u": (_faces("fcc"), F3_U_SQL),
    "F3_water_mask_v": (_faces("cfc"), F3_V_SQL),
    "F4_open_edge": (f4_open_edge, F4_SQL),
    "F4_water_mask_open": (_faces("cfc", "south"), F4_SQL),
    "F5_surface_slice": (f5_surface_slice, F5_SQL),
    "F6_coastal_cells": (f6_coastal_cells, F6_SQL),
    "F7_validity": (f7_validity, F7_SQL),
    "F7_level_validity": (f7_level_validity, F7_LEVEL_SQL),
}
