"""Subsets, validity and land/water masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.errors import ValidationError, require
from coastgrid.functions.columns import check_edge, finite, raise_if_any
from coastgrid.functions.session import summary_table
from coastgrid.functions.tiles import with_neighbours

# Fixed value: least wet fraction of a partial bottom cell.
MIN_CELL_FRACTION = 0.2


def subset_box(
    df: DataFrame,
    west: Column | float,
    east: Column | float,
    south: Column | float,
    north: Column | float,
    keys: Sequence[str] = ("dataset",),
    values: Sequence[str] = ("value",),
    margin: int | None = None,
) -> DataFrame:
    """Cells of a 2-D lon/lat field in the index window that bounds a box.

    Without ``margin`` every cell of the window is kept and values outside the
    (inclusive) box become NULL.  With ``margin`` the window grows by that many
    cells on each side, clamped to the grid, and nothing is blanked.  A dataset
    with no cell in the box has no window and yields no rows
    (``checks.require_rows`` turns that into an error).
    """
    lon, lat = F.col("lon"), F.col("lat")
    inside = (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)
    grown = margin or 0
    bounds = summary_table(
        df.groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col("i"))).alias("i_lo"),
            F.max(F.when(inside, F.col("i"))).alias("i_hi"),
            F.min(F.when(inside, F.col("j"))).alias("j_lo"),
            F.max(F.when(inside, F.col("j"))).alias("j_hi"),
        )
        .filter(F.col("i_lo").isNotNull())
    )
    window = F.col("i").between(F.col("i_lo") - grown, F.col("i_hi") + grown) & F.col("j").between(
        F.col("j_lo") - grown, F.col("j_hi") + grown
    )
    out = df.join(bounds, list(keys)).filter(window).drop("i_lo", "i_hi", "j_lo", "j_hi")
    if margin is None:
        out = out.withColumns({c: F.when(inside, F.col(c)) for c in values})
    return out


def is_wet(
    height: Column, z_bottom: Column, z_top: Column, fraction: float = MIN_CELL_FRACTION, mode: str = "floor"
) -> Column:
    """Wetness of a layer over a bottom height; a NULL height (closed face) is dry."""
    deep = height < z_top if mode == "floor" else height <= z_top - fraction * (z_top - z_bottom)
    return F.coalesce(deep, F.lit(False))


def face_heights(bathymetry: DataFrame, loc: str, edge: str | None = None) -> DataFrame:
    """Bottom height at the cells or faces of ``loc``; NULL marks a closed outer face.

    A face is wet exactly where the higher of its two cells is, at every level, so
    staggering is settled on the 2-D table before levels are added.  ``edge`` opens
    the outer row of the component staggered across it.
    """
    require(loc in ("ccc", "fcc", "cfc"), f"unknown location {loc!r}")
    if edge is not None:
        check_edge(edge)
    if loc == "ccc":
        return bathymetry.select("grid_id", "nx", "ny", "i", "j", F.col("h").alias("face_h"))
    axis, other, n, sides = ("i", "j", "nx", ("west", "east")) if loc == "fcc" else ("j", "i", "ny", ("south", "north"))
    line = Window.partitionBy("grid_id", other).orderBy(axis)
    here, before = F.col("h"), F.lag("h").over(line)
    closed = F.lit(None).cast("double")
    first = here if edge == sides[0] else closed
    last = here if edge == sides[1] else closed
    inner = F.when(F.col(axis) == 1, first).otherwise(F.greatest(before, here))
    # The last cell of a line also carries the outer face.
    faces = F.array(
        F.struct(F.col(axis).alias("_at"), F.col("_inner").alias("face_h")),
        F.struct((F.col(axis) + 1).alias("_at"), F.col("_outer").alias("face_h")),
    )
    mine = F.when(F.col(axis) == F.col(n), faces).otherwise(F.slice(faces, 1, 1))
    rows = bathymetry.select("grid_id", "nx", "ny", "i", "j", inner.alias("_inner"), last.alias("_outer"))
    return (
        rows.select("grid_id", "nx", "ny", other, F.inline(mine))
        .withColumnRenamed("_at", axis)
        .select("grid_id", "nx", "ny", "i", "j", "face_h")
    )


def water_mask(
    bathymetry: DataFrame,
    domains: DataFrame,
    loc: str = "ccc",
    edge: str | None = None,
    fraction: float = MIN_CELL_FRACTION,
    mode: str = "floor",
) -> DataFrame:
    """Wetness of every cell or face of every level.

    A tracer cell is wet where the bottom lies below its top; its partial bottom
    cell keeps at least ``fraction`` of the layer (``mode="floor"``), or is dry when
    thinner than that (``mode="drop"``).  A velocity face needs both cells wet.
    """
    require(mode in ("floor", "drop"), f"unknown mode {mode!r}")
    heights = face_heights(bathymetry, loc, edge)
    faces = F.col("z_faces")
    layers = F.transform(
        F.sequence(F.lit(1), F.size(faces) - 1),
        lambda k: F.struct(
            k.alias("k"), F.element_at(faces, k).alias("z_bottom"), F.element_at(faces, k + 1).alias("z_top")
        ),
    )
    layered = heights.join(domains.select("grid_id", "z_faces"), "grid_id").select(
        "grid_id", "nx", "ny", "i", "j", "face_h", F.inline(layers)
    )
    h, z_bottom, z_top = F.col("face_h"), F.col("z_bottom"), F.col("z_top")
    wet = is_wet(h, z_bottom, z_top, fraction, mode)
    columns = [F.col(c) for c in ("grid_id", "nx", "ny", "i", "j", "k")] + [wet.alias("wet")]
    if loc == "ccc":
        thickness = F.greatest(z_top - F.greatest(h, z_bottom), fraction * (z_top - z_bottom))
        columns.append(F.when(wet, thickness).otherwise(F.lit(0.0)).alias("thickness"))
    return layered.select(*columns)


def open_edge(face_mask: DataFrame, tracer_mask: DataFrame, loc: str, edge: str) -> DataFrame:
    """Give the outer face row along ``edge`` the wetness of the tracer cell inside it.

    Only the component staggered across the edge changes.
    """
    check_edge(edge)
    across = "fcc" if edge in ("west", "east") else "cfc"
    if loc != across:
        return face_mask
    axis, n = ("i", "nx") if across == "fcc" else ("j", "ny")
    other = "j" if axis == "i" else "i"
    low = edge in ("west", "south")
    outer = F.lit(1) if low else F.col(n) + 1
    inner = F.lit(1) if low else F.col(n)
    row = tracer_mask.filter(F.col(axis) == inner).select("grid_id", other, "k", F.col("wet").alias("_inner"))
    opened = face_mask.filter(F.col(axis) == outer).join(row, ["grid_id", other, "k"], "left")
    opened = opened.withColumn("wet", F.coalesce("_inner", "wet")).select(*face_mask.columns)
    return face_mask.filter(F.col(axis) != outer).unionByName(opened)


def surface_slice(df: DataFrame, keys: Sequence[str] = ("grid_id",), at: Column | None = None) -> DataFrame:
    """The top level at one time: the first of each key group, or ``at``."""
    stats = [F.max("k").alias("_top")]
    if at is None:
        stats.append(F.min("ts").alias("_ts"))
    bounds = summary_table(df.groupBy(*keys).agg(*stats))
    if at is not None:
        bounds = bounds.withColumn("_ts", at)
    return (
        df.join(bounds, list(keys))
        .filter((F.col("k") == F.col("_top")) & (F.col("ts") == F.col("_ts")))
        .select(*df.columns)
    )


def coastal_cells(mask: DataFrame) -> DataFrame:
    """Water cells with a land cell among the eight neighbours inside the domain.

    ``mask`` is a horizontal mask ``grid_id, nx, ny, i, j, wet``.
    """
    around = ("west", "east", "south", "north", "south_west", "south_east", "north_west", "north_east")
    near = with_neighbours(mask, ["grid_id"], "wet", diagonal=True)
    any_land = F.lit(False)
    for side in around:
        any_land = any_land | F.coalesce(~F.col(side), F.lit(False))
    return near.filter(F.col("wet") & any_land).select("grid_id", "nx", "ny", "i", "j")


def validity(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Which source cells hold data, decided at each dataset's first time step."""
    first = summary_table(df.groupBy(*keys).agg(F.min("ts").alias("_first")))
    return (
        df.join(first, list(keys))
        .filter(F.col("ts") == F.col("_first"))
        .select(*keys, "lev", "i", "j", finite(F.col("value")).alias("valid"))
    )


def level_validity(valid: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Whether a level has any valid cell."""
    return valid.groupBy(*keys, "lev").agg(F.bool_or("valid").alias("level_valid"))


def require_valid_source(valid: DataFrame, keys: Sequence[str] = ("dataset",)) -> None:
    """Every dataset needs a valid cell, or there is nothing to fill from."""
    empty = valid.groupBy(*keys).agg(F.bool_or("valid").alias("_any")).filter(~F.col("_any"))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    raise_if_any(empty, F.format_string("every cell of %s is masked, nothing to fill from", name), ValidationError)
