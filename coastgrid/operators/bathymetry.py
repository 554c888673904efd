"""Cleaning, connecting and slope-limiting bathymetry.

Cell tables are dense, ``grid_id, nx, ny, i, j, h``; ``h < 0`` is sea.  One-pass
stencils are window functions over halo tiles; repeated stencils run on one tile
at a time in Arrow batches, with a halo as wide as the number of cells information
can travel, which makes them exact.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.errors import ValidationError, require
from coastgrid.functions.session import materialise, summary_table
from coastgrid.functions.tiles import TILE, TILE_COLUMNS, spread_to_tiles, tile_of, with_neighbours
from coastgrid.operators.grid import grid_spine
from coastgrid.operators.interp import corner_quads, fractional_index, weighted_corners

# Fixed values of the cleaning rules.
GAP_FILL_PASSES = 10
ISOLATED_SEA_SIDES = 3
SPIKE_MIN_NEIGHBOURS = 2
SLOPE_MAX_PASSES = 400
SLOPE_TOLERANCE = 1e-9
#: Rounds of the slope limiter after which carried cells are written again, to keep the plan short.
ROUNDS_CARRIED = 8

CELL = ("grid_id", "nx", "ny", "i", "j", "h")
CELL_SCHEMA = "grid_id int, nx int, ny int, i int, j int, h double"


def _sea(c: str) -> Column:
    return F.coalesce(F.col(c) < 0, F.lit(False))


def _land(c: str) -> Column:
    return F.coalesce(F.col(c) >= 0, F.lit(False))


def _interior() -> Column:
    return (F.col("i") > 1) & (F.col("i") < F.col("nx")) & (F.col("j") > 1) & (F.col("j") < F.col("ny"))


def _replace(df: DataFrame, condition: Column, value: Column, diagonal: bool = False, size: int = TILE) -> DataFrame:
    near = with_neighbours(df.select(*CELL), ["grid_id"], "h", diagonal, size)
    return near.withColumn("h", F.when(condition, value).otherwise(F.col("h"))).select(*CELL)


def fill_diagonal_pairs(df: DataFrame, size: int = TILE) -> DataFrame:
    """Open the north-west corner of a 2x2 block whose SW and NE corners are sea and others land."""
    blocked = _land("h") & _land("south_east") & _sea("south") & _sea("east")
    return _replace(df, blocked, (F.col("south") + F.col("east")) / 2, diagonal=True, size=size)


def fill_secondary_diagonal_pairs(df: DataFrame, size: int = TILE) -> DataFrame:
    """Open the south-west corner of a 2x2 block whose NW and SE corners are sea and others land."""
    blocked = _land("h") & _land("north_east") & _sea("north") & _sea("east")
    return _replace(df, blocked, (F.col("north") + F.col("east")) / 2, diagonal=True, size=size)


def remove_isolated_sea(df: DataFrame, sides: int = ISOLATED_SEA_SIDES, size: int = TILE) -> DataFrame:
    """Interior sea cells with at least ``sides`` land sides become land."""
    land_sides = sum((_land(c).cast("int") for c in ("west", "east", "south", "north")), F.lit(0))
    return _replace(df, _interior() & _sea("h") & (land_sides >= sides), F.lit(0.0), size=size)


def fill_isolated_land(df: DataFrame, size: int = TILE) -> DataFrame:
    """Interior land cells between four sea cells take their mean."""
    enclosed = _interior() & _land("h") & _sea("west") & _sea("east") & _sea("south") & _sea("north")
    mean = (F.col("south") + F.col("west") + F.col("north") + F.col("east")) / 4
    return _replace(df, enclosed, mean, size=size)


def fill_shallow_spikes(
    df: DataFrame, ratio: float, min_neighbours: int = SPIKE_MIN_NEIGHBOURS, size: int = TILE
) -> DataFrame:
    """Sea cells far shallower than the median of their sea neighbours take that median."""
    near = with_neighbours(df.select(*CELL), ["grid_id"], "h", size=size)
    depths = F.array_sort(
        F.transform(
            F.filter(F.array("west", "east", "south", "north"), lambda v: v.isNotNull() & (v < 0)), lambda v: -v
        )
    )
    count = F.size("_d")
    low, high = F.floor((count + 1) / 2).cast("int"), F.floor(count / 2).cast("int") + 1
    median = (F.try_element_at("_d", low) + F.try_element_at("_d", high)) / 2
    spike = (F.col("h") < 0) & (count >= min_neighbours) & (-F.col("h") < ratio * F.col("_m"))
    return (
        near.withColumn("_d", depths)
        .withColumn("_m", F.when(count > 0, median))
        .withColumn("h", F.when(spike, -F.col("_m")).otherwise(F.col("h")))
        .select(*CELL)
    )


# --- repeated stencils, one halo tile per task -------------------------------


def _places(index: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Positions along one axis, tile after tile with a gap between them; all keep the parity of ``index``."""
    first = index.min() - 1
    tiles, own = np.unique(tile, return_inverse=True)
    shift, end = np.zeros(len(tiles), int), -1
    for n in range(len(tiles)):
        inside = index[own == n] - first
        shift[n] = max(0, end + 2 - inside.min())
        shift[n] += shift[n] % 2
        end = inside.max() + shift[n]
    return index - first + shift[own]


def _tile_array(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tiles in one 2-D array, each framed by a ring of no-data, and the row positions in it."""
    a = _places(rows["i"].to_numpy(), rows["tile_i"].to_numpy())
    b = _places(rows["j"].to_numpy(), rows["tile_j"].to_numpy())
    h = np.full((a.max() + 2, b.max() + 2), np.nan)
    h[a, b] = rows["h"].to_numpy()
    return h, a, b


def _shift(h: np.ndarray, di: int, dj: int) -> np.ndarray:
    """Value of the neighbour at (+di, +dj); NaN outside."""
    out = np.full_like(h, np.nan)
    rows, cols = h.shape
    out[max(0, -di) : rows - max(0, di), max(0, -dj) : cols - max(0, dj)] = h[
        max(0, di) : rows + min(0, di), max(0, dj) : cols + min(0, dj)
    ]
    return out


def _per_tile(
    tiled: DataFrame, function: Callable[..., pd.DataFrame], schema: str, size: int, halo: int, **settings
) -> DataFrame:
    """Run a tile function on every tile; no group is larger than one tile of the usual size with its halo.

    A call costs far more than the work on a small tile, so neighbouring small tiles, halos included, share one.
    Tiles are few bytes but much work, so the partition count is fixed here: adaptive
    execution would merge them by size into a handful of tasks.
    """
    together = max(1, TILE // (size + 2 * halo))
    block = ["grid_id", *[f"_{c}" for c in TILE_COLUMNS]]
    blocks = tiled.withColumns({f"_{c}": F.floor(F.col(c) / together) for c in TILE_COLUMNS})
    tasks = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, *block).groupBy(*block).applyInPandas(lambda rows: function(rows, **settings), schema)


def _clean_tile(rows: pd.DataFrame, passes: int, sides: int) -> pd.DataFrame:
    h, a, b = _tile_array(rows)
    interior = np.zeros(h.shape, bool)
    interior[a, b] = ((rows.i > 1) & (rows.i < rows.nx) & (rows.j > 1) & (rows.j < rows.ny)).to_numpy()

    # A comparison with NaN is false, so cells outside the domain are neither land nor sea.
    for corner, opposite in ((-1, -1), (1, 1)):
        side, east, diagonal = _shift(h, 0, corner), _shift(h, 1, 0), _shift(h, 1, opposite)
        blocked = (h >= 0) & (diagonal >= 0) & (side < 0) & (east < 0)
        h = np.where(blocked, (side + east) / 2, h)
    for _ in range(passes):
        around = [_shift(h, 0, -1), _shift(h, -1, 0), _shift(h, 0, 1), _shift(h, 1, 0)]
        land_sides = sum((n >= 0).astype(int) for n in around)
        h = np.where(interior & (h < 0) & (land_sides >= sides), 0.0, h)
        around = [_shift(h, 0, -1), _shift(h, -1, 0), _shift(h, 0, 1), _shift(h, 1, 0)]
        enclosed = interior & (h >= 0) & np.logical_and.reduce([n < 0 for n in around])
        h = np.where(enclosed, (around[0] + around[1] + around[2] + around[3]) / 4, h)

    core = rows["core"].to_numpy()
    return rows.assign(h=h[a, b]).loc[core, list(CELL)]


def fill_gaps(df: DataFrame, passes: int = GAP_FILL_PASSES, sides: int = ISOLATED_SEA_SIDES, size: int = TILE) -> DataFrame:
    """Diagonal fills, then ``passes`` rounds of removing isolated sea and filling isolated land.

    Information travels one cell per stencil, so a halo of ``2 + 2 * passes`` cells
    makes one shuffle enough for all of them.
    """
    halo = 2 + 2 * passes
    tiled = spread_to_tiles(df.select(*CELL), ["grid_id"], size, halo)
    return _per_tile(tiled, _clean_tile, CELL_SCHEMA, size, halo, passes=passes, sides=sides)


def smooth_gaps(
    df: DataFrame,
    spike_ratio: float = 0.0,
    max_slope_factor: float = 0.0,
    minimum_depth: float = 0.0,
    size: int = TILE,
    strict: bool = False,
) -> DataFrame:
    """Gap filling, then despiking and slope limiting when their parameter is positive; ``strict`` is the limiter's."""
    out = fill_gaps(df, size=size)
    if spike_ratio > 0:
        out = fill_shallow_spikes(out, spike_ratio, size=size)
    if max_slope_factor > 0:
        out = limit_bottom_slope(out, max_slope_factor, minimum_depth, size=size, strict=strict)
    return out


# --- slope limiter -----------------------------------------------------------


def slope_factor(here: Column, there: Column) -> Column:
    """|d1 - d2| / (d1 + d2) of two sea cells, NULL when either is land or both depths vanish."""
    both = (here < 0) & (there < 0)
    return F.when(both, F.try_divide(F.abs(here - there), F.abs(here + there)))


def _steepest(depth: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope factor of every pair along ``axis`` (NaN with land), and both depths."""
    low = depth[:-1, :] if axis == 0 else depth[:, :-1]
    high = depth[1:, :] if axis == 0 else depth[:, 1:]
    total = low + high
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, np.abs(low - high) / total, np.where(np.isnan(total), np.nan, 0.0)), low, high


def _limit_tile(
    rows: pd.DataFrame, limit: float, minimum_depth: float, passes: int, tolerance: float, width: int, alone_passes: int
) -> pd.DataFrame:
    h, a, b = _tile_array(rows)
    # Nothing reaches over the border of a domain of a single tile: it is swept to the end at once.
    if rows["nx"].iat[0] <= width and rows["ny"].iat[0] <= width:
        passes = alone_passes
    depth = np.where(h < 0, -h, np.nan)
    # Parity follows global indices, so every tile sweeps a pair in the same turn.
    first_i, first_j = int(rows["i"].min()) - 1, int(rows["j"].min()) - 1
    for _ in range(passes):
        moved = False
        for axis, first in ((0, first_i), (1, first_j)):
            for parity in (0, 1):
                r, low, high = _steepest(depth, axis)
                index = np.arange(r.shape[axis]) + first
                turn = (index % 2 == parity).reshape((-1, 1) if axis == 0 else (1, -1))
                steep = turn & (r > limit + tolerance)
                if not steep.any():
                    continue
                moved = True
                shift = (np.abs(low - high) - limit * (low + high)) / 2
                new_low = np.maximum(low - np.where(low > high, shift, -shift), minimum_depth)
                new_high = np.maximum(high + np.where(low > high, shift, -shift), minimum_depth)
                # Pairs of one parity share no cell, so both ends can be written at once.
                if axis == 0:
                    depth[:-1, :] = np.where(steep, new_low, depth[:-1, :])
                    depth[1:, :] = np.where(steep, new_high, depth[1:, :])
                else:
                    depth[:, :-1] = np.where(steep, new_low, depth[:, :-1])
                    depth[:, 1:] = np.where(steep, new_high, depth[:, 1:])
        if not moved:
            break
    steepest = np.zeros(h.shape)
    for axis in (0, 1):
        r = np.nan_to_num(_steepest(depth, axis)[0])
        # Both ends know of their pair, so a tile sees one that reaches over its border.
        for part in (steepest[:-1, :], steepest[1:, :]) if axis == 0 else (steepest[:, :-1], steepest[:, 1:]):
            np.maximum(part, r, out=part)
    out = np.where(np.isnan(depth), h, -depth)
    core = rows["core"].to_numpy()
    return rows.assign(h=out[a, b], steepest=steepest[a, b]).loc[core, [*CELL, "steepest"]]


def limit_bottom_slope(
    df: DataFrame,
    max_slope_factor: float,
    minimum_depth: float = 0.0,
    max_passes: int = SLOPE_MAX_PASSES,
    tolerance: float = SLOPE_TOLERANCE,
    passes_per_round: int = 8,
    size: int = TILE,
    strict: bool = False,
) -> DataFrame:
    """Move adjacent sea cells together until no pair is steeper than the limit.

    The deeper cell rises and the shallower one sinks by the same amount, so volume
    is kept; neither gets shallower than ``minimum_depth``.  A pass sweeps the pairs
    in four turns (axis x parity) whose pairs share no cell.  Information travels at
    most two cells per axis and pass, so ``passes_per_round`` passes are exact within
    one halo tile, for one shuffle.  Domains of one tile are swept to the end in the first round.  Of the others, only tiles with a steep pair in reach of their halo take part in the
    next round: nothing moves in the others, whose cells are carried on without being
    shuffled or written again.  With ``strict``, a pair still steeper after ``max_passes`` is an
    error; without, the result is as far as they got.
    """
    require(0 < max_slope_factor, "max_slope_factor must be positive")
    halo = 2 * passes_per_round + 2
    schema = CELL_SCHEMA + ", steepest double"
    tile, alone = ["grid_id", *TILE_COLUMNS], (F.col("nx") <= size) & (F.col("ny") <= size)
    current, active, done, rounds = df.select(*CELL), None, 0, 0
    while True:
        tiled = spread_to_tiles(current, ["grid_id"], size, halo)
        if active is not None:
            tiled = tiled.join(active, tile, "left_semi")
        passes = min(passes_per_round, max_passes - done)
        swept = materialise(
            _per_tile(
                tiled, _limit_tile, schema, size, halo,
                limit=max_slope_factor, minimum_depth=minimum_depth, passes=passes, tolerance=tolerance, width=size, alone_passes=max_passes,
            )
        )
        done, rounds = done + passes, rounds + 1
        if active is None:
            current = swept.select(*CELL)
        else:
            own = current.withColumns({"tile_i": tile_of(F.col("i"), size), "tile_j": tile_of(F.col("j"), size)})
            current = own.join(active, tile, "left_anti").select(*CELL).unionByName(swept.select(*CELL))
            if rounds % ROUNDS_CARRIED == 0:
                current = materialise(current)
        # All steep pairs have an end that was swept: the others were not steep, and did not move.
        steep = swept.filter(F.col("steepest") > max_slope_factor + tolerance)
        active = materialise(_tiles_in_reach(steep.filter(~alone), size, halo))
        settled = active.isEmpty()
        if strict and (done >= max_passes and not settled or rounds == 1 and not steep.filter(alone).isEmpty()):
            raise ValidationError(f"bottom slopes are still above {max_slope_factor} after {max_passes} passes")
        if done >= max_passes or settled:
            return current


def _tiles_in_reach(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """The tiles whose halo holds one of ``cells``; one row a tile."""

    def tiles(axis: str, n: str) -> Column:
        low = F.greatest(F.lit(0), tile_of(F.col(axis) - halo, size))
        return F.explode(F.sequence(low, F.least(tile_of(F.col(n), size), tile_of(F.col(axis) + halo, size))))

    return cells.withColumn("tile_i", tiles("i", "nx")).withColumn("tile_j", tiles("j", "ny")).select("grid_id", *TILE_COLUMNS).distinct()


# --- connected basins --------------------------------------------------------


def _label_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Smallest global cell number of the connected water each sea cell lies in, within a tile."""
    h, a, b = _tile_array(rows)
    number = np.full(h.shape, np.inf)
    cell = rows["i"].to_numpy().astype("int64") + (rows["j"].to_numpy().astype("int64") - 1) * rows["nx"].to_numpy()
    number[a, b] = np.where(rows["h"].to_numpy() < 0, cell, np.inf)
    sea = np.isfinite(number)
    # Jump along a whole run of sea cells at a time, alternating axes, until nothing changes.
    while True:
        before = number.copy()
        for axis in (0, 1):
            for flip in (False, True):
                view = np.flip(number, axis) if flip else number
                water = np.flip(sea, axis) if flip else sea
                lines = view if axis == 0 else view.T
                wet = water if axis == 0 else water.T
                for r in range(1, lines.shape[0]):
                    lines[r] = np.where(wet[r] & wet[r - 1], np.minimum(lines[r], lines[r - 1]), lines[r])
        if np.array_equal(before, number):
            break
    label = number[a, b]
    wet_rows = np.isfinite(label)
    return pd.DataFrame(
        {
            "grid_id": rows["grid_id"][wet_rows],
            "i": rows["i"][wet_rows],
            "j": rows["j"][wet_rows],
            "label": label[wet_rows].astype("int64"),
        }
    )


def connected_basins(df: DataFrame, size: int = TILE) -> DataFrame:
    """``grid_id, i, j, basin`` of every sea cell; 4-connected, named by the lowest cell number.

    Water is first connected inside each tile; only the labels that meet across tile
    borders enter the iterative star contraction, so the looped graph is far smaller
    than the grid.
    """
    tiled = spread_to_tiles(df.select(*CELL), ["grid_id"], size, halo=0)
    local = materialise(_per_tile(tiled, _label_tile, "grid_id int, i int, j int, label long", size, 0))
    edges: list[DataFrame] = []
    for axis, other in (("i", "j"), ("j", "i")):
        last = local.filter(F.col(axis) % size == 0).select(
            "grid_id", (F.col(axis) + 1).alias(axis), other, F.col("label").alias("u")
        )
        first = local.filter((F.col(axis) > 1) & (F.col(axis) % size == 1)).select(
            "grid_id", axis, other, F.col("label").alias("v")
        )
        edges.append(last.join(first, ["grid_id", axis, other]).select("grid_id", "u", "v"))
    roots = contract_stars(edges[0].unionByName(edges[1]).filter("u <> v").distinct())
    return local.join(
        roots.select("grid_id", F.col("node").alias("label"), "root"), ["grid_id", "label"], "left"
    ).select("grid_id", "i", "j", F.coalesce("root", "label").alias("basin"))


def contract_stars(edges: DataFrame) -> DataFrame:
    """Lowest connected node of every node of ``grid_id, u, v``, by alternating star
    contractions (Kiveris et al. 2014)."""
    key = ["grid_id"]

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        # Aggregating the minimum (with map-side combine) and joining it back keeps a
        # hub with very many neighbours out of any single window group.
        low = pairs.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(low, [*key, "u"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            own = low.select(*key, F.col("u"), F.col("m").alias("v"))
            out = joined.select(*key, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
        return out.filter("u <> v").distinct()

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))

    def settled(pairs: DataFrame) -> bool:
        # Every child has one parent and no parent is a child: exact, whatever the hashes.
        children = pairs.groupBy(*key, "u").agg(F.count("*").alias("n"))
        inner = pairs.select(*key, F.col("v").alias("u")).join(children, [*key, "u"], "left_semi")
        return children.filter("n > 1").select(*key, "u").unionByName(inner).isEmpty()

    current = materialise(edges.select(*key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not settled(current):
        current = materialise(stars(stars(both_ways(current), large=True), large=False))
    # At the fixpoint every pair points from a node to the root of its component.
    return current.select(*key, F.col("u").alias("node"), F.col("v").alias("root"))


def keep_major_basins(df: DataFrame, n: int = 1, size: int = TILE) -> DataFrame:
    """Turn all but the ``n`` largest connected water bodies of each domain into land.

    Equal sizes are ranked by the lowest cell number.
    """
    require(n >= 1, "n must be at least 1")
    basins = connected_basins(df, size)
    sizes = basins.groupBy("grid_id", "basin").count()
    largest = Window.partitionBy("grid_id").orderBy(F.desc("count"), "basin")
    kept = sizes.withColumn("_rank", F.row_number().over(largest)).filter(F.col("_rank") <= n)
    wet = basins.join(kept.select("grid_id", "basin"), ["grid_id", "basin"], "left_semi").select(
        "grid_id", "i", "j", F.lit(True).alias("_kept")
    )
    dried = F.when((F.col("h") < 0) & F.col("_kept").isNull(), F.lit(0.0)).otherwise(F.col("h"))
    return df.join(wet, ["grid_id", "i", "j"], "left").withColumn("h", dried).select(*CELL)


# --- table normalisation and the final floor ---------------------------------


def read_bathymetry(df: DataFrame) -> DataFrame:
    """Normalise a stored bathymetry table.

    Missing heights become 0.  A domain whose finite heights are all >= 0 holds
    positive depths and is negated.
    """
    lowest = summary_table(df.groupBy("grid_id").agg(F.min(F.when(~F.isnan("h"), F.col("h"))).alias("_low")))
    h = F.when(~F.isnan("h"), F.col("h"))
    signed = F.when(F.col("_low") >= 0, -h).otherwise(h)
    return (
        df.join(lowest, "grid_id")
        .withColumn("h", F.coalesce(signed, F.lit(0.0)) + F.lit(0.0))
        .drop("_low")
    )


def _refuse(bad: DataFrame, strict: bool, why: str) -> None:
    """Raise with up to five of the ``grid_id`` of ``bad`` if ``strict``."""
    if strict:
        named = [str(r["grid_id"]) for r in bad.select("grid_id").orderBy("grid_id").limit(5).collect()]
        require(not named, f"{why}: grids {', '.join(named)}")


def _stored_axis(df: DataFrame, idx: str) -> DataFrame:
    """One row per grid: whether ``lon`` or ``lat`` is the same all along each ``idx``, and both in its order.

    Sums are made by index first, so an axis has as many entries as cells along it.
    """
    lines = df.groupBy("grid_id", F.col(idx).alias("n")).agg(
        *(f(c).alias(f"{c}_{f.__name__}") for c in ("lon", "lat") for f in (F.min, F.max))
    )
    ordered = F.array_sort(F.collect_list(F.struct("n", "lon_min", "lat_min")))
    return lines.groupBy("grid_id").agg(
        F.bool_and(F.col("lon_min") == F.col("lon_max")).alias(f"{idx}_lon"),
        F.bool_and(F.col("lat_min") == F.col("lat_max")).alias(f"{idx}_lat"),
        ((F.min("n") == 1) & (F.max("n") == F.count("*"))).alias(f"{idx}_whole"),
        F.transform(ordered, lambda x: F.struct(x["lon_min"].alias("lon"), x["lat_min"].alias("lat"))).alias(f"{idx}_values"),
    )


def stored_domains(df: DataFrame) -> DataFrame:
    """The domain that each grid's cell centres ``grid_id, i, j, lon, lat`` span, one row per grid.

    ``swapped`` tells that i runs along ``lat``; ``x_down`` and ``y_down`` that an axis is stored in falling order.
    ``fits`` is false, and all else but the flags null, unless each axis depends on one index alone, has a row for
    each index from 1 on, has two or more centres, and rises or falls strictly.  Faces lie midway between
    centres; both ends are extended by half the first spacing of the rising axis.
    """
    axes = _stored_axis(df, "i").join(_stored_axis(df, "j"), "grid_id")
    straight = F.col("i_lon") & F.col("j_lat")
    swapped = ~straight & F.col("i_lat") & F.col("j_lon")
    pick = lambda c, one, other: F.transform(F.when(swapped, F.col(f"{other}_values")).otherwise(F.col(f"{one}_values")), lambda v: v[c])
    axes = axes.withColumns({"swapped": swapped, "_x": pick("lon", "i", "j"), "_y": pick("lat", "j", "i")})
    steps = lambda a: F.transform(F.slice(a, 2, F.size(a) - 1), lambda v, k: v - F.get(F.col(a), k))
    fits = (straight | swapped) & F.col("i_whole") & F.col("j_whole")
    for a, name in (("_x", "x"), ("_y", "y")):
        down = F.forall(steps(a), lambda d: d < 0)
        fits = fits & (F.size(a) > 1) & (down | F.forall(steps(a), lambda d: d > 0))
        axes = axes.withColumn(f"{name}_down", down & (F.size(a) > 1))
    axes = axes.withColumn("fits", F.coalesce(fits, F.lit(False)))
    for a, name, n, low, high in (("_x", "x", "nx", "west", "east"), ("_y", "y", "ny", "south", "north")):
        rising = F.when(F.col(f"{name}_down"), F.reverse(a)).otherwise(F.col(a))
        axes = axes.withColumn(a, F.when(F.col("fits"), rising))
        half = (F.get(a, F.lit(1)) - F.get(a, F.lit(0))) / 2
        inner = F.transform(F.slice(a, 2, F.size(a) - 1), lambda v, k: (v + F.get(F.col(a), k)) / 2)
        faces = F.concat(F.array(F.get(a, F.lit(0)) - half), inner, F.array(F.element_at(a, -1) + half))
        axes = axes.withColumn(f"{name}_faces", F.when(F.col("fits"), faces)).withColumns(
            {n: F.when(F.col("fits"), F.size(a)), low: F.get(f"{name}_faces", F.lit(0)), high: F.element_at(f"{name}_faces", -1)}
        )
    return axes.select("grid_id", "nx", "ny", "west", "east", "south", "north", "x_faces", "y_faces", "swapped", "x_down", "y_down", "fits")


def read_stored_grid(df: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells and domains of tables stored with their centres ``lon, lat``, in any orientation.

    Cells get the i of their rank along rising ``lon``, the j along rising ``lat``, and the normalised heights of
    ``read_bathymetry``.  Grids that are no rectangle of two rising or falling axes are an error that names up to five,
    or left out unless ``strict``.
    """
    found = summary_table(stored_domains(df))
    _refuse(found.filter(~F.col("fits")), strict, "centres span no two rising or falling axes")
    found = found.filter("fits")
    turns = found.select("grid_id", "nx", "ny", "swapped", "x_down", "y_down")
    cells = df.drop("nx", "ny").join(turns, "grid_id")
    along = lambda one, other: F.when(F.col("swapped"), F.col(other)).otherwise(F.col(one))
    turned = {
        idx: F.when(F.col(f"{axis}_down"), F.col(n) + 1 - along(idx, other)).otherwise(along(idx, other)).cast("int")
        for idx, other, axis, n in (("i", "j", "x", "nx"), ("j", "i", "y", "ny"))
    }
    return read_bathymetry(cells.withColumns(turned).select(*CELL)), found.drop("swapped", "x_down", "y_down", "fits")


def normalise_axes(df: DataFrame, domains: DataFrame, strict: bool = False) -> DataFrame:
    """Accept a table stored with i and j swapped; extents that match neither way give ``fits`` false, or an error if ``strict``.

    ``domains`` holds the axis lengths ``nx, ny`` of each ``grid_id``.
    """
    extent = df.groupBy("grid_id").agg(F.max("i").alias("_ni"), F.max("j").alias("_nj"))
    straight = (F.col("_ni") == F.col("nx")) & (F.col("_nj") == F.col("ny"))
    swapped = (F.col("_ni") == F.col("ny")) & (F.col("_nj") == F.col("nx"))
    state = summary_table(
        extent.join(domains.select("grid_id", "nx", "ny"), "grid_id").select(
            "grid_id", "nx", "ny", straight.alias("_straight"), swapped.alias("_swapped")
        )
    )
    _refuse(state.filter("NOT (_straight OR _swapped)"), strict, "extents fit the domain neither way")
    straight = F.col("_straight")
    return df.drop("nx", "ny").join(state, "grid_id").withColumns(
        {
            "i": F.when(straight, F.col("i")).otherwise(F.col("j")),
            "j": F.when(straight, F.col("j")).otherwise(F.col("i")),
            "fits": straight | F.col("_swapped"),
        }
    ).drop("_straight", "_swapped")


def minimum_depth_floor(df: DataFrame, minimum_depth: float) -> DataFrame:
    """Deepen wet cells shallower than ``minimum_depth`` to exactly it; the coastline stays."""
    return df.withColumn(
        "h", F.when(F.col("h") < 0, F.least(F.col("h"), F.lit(-float(minimum_depth)))).otherwise(F.col("h"))
    )


def regrid_bathymetry(
    native: DataFrame, native_domains: DataFrame, target_domains: DataFrame, passes: int = 1, minimum_depth: float = 0.0, size: int = TILE
) -> DataFrame:
    """Bilinear interpolation from a native grid to a target grid, then the depth floor.

    Native cells are dealt out by tiles of ``size`` cells, so a domain spreads over its tiles.  A target
    cell whose native corners have no row gets NULL.

    ``passes > 1`` goes through intermediate grids whose sizes step evenly from the
    native to the target size.  A domain keeps the sign of its interpolated height,
    so a coast does not move with the floor.
    """
    require(passes >= 1, "passes must be >= 1")
    source, source_domains = native, native_domains
    box = ["west", "east", "south", "north"]
    for step in range(1, passes + 1):
        if step == passes:
            goal = target_domains.select("grid_id", "nx", "ny", *box)
        else:
            ends = native_domains.select("grid_id", F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), *box).join(
                target_domains.select("grid_id", "nx", "ny"), "grid_id"
            )
            part = step / passes
            goal = ends.select(
                "grid_id",
                F.greatest(F.round(F.col("_nx") + part * (F.col("nx") - F.col("_nx"))).cast("int"), F.lit(2)).alias("nx"),
                F.greatest(F.round(F.col("_ny") + part * (F.col("ny") - F.col("_ny"))).cast("int"), F.lit(2)).alias("ny"),
                *box,
            )
        source, source_domains = _resample(source, source_domains, goal, size), goal
    return minimum_depth_floor(source, minimum_depth)


def _resample(cells: DataFrame, domains: DataFrame, goal: DataFrame, size: int) -> DataFrame:
    """One bilinear step; values are clamped at the outer cell centres of the source."""
    geometry = domains.select(
        "grid_id",
        F.col("nx").alias("_nx"),
        F.col("ny").alias("_ny"),
        F.col("west").alias("_w"),
        F.col("south").alias("_s"),
        ((F.col("east") - F.col("west")) / F.col("nx")).alias("_dx"),
        ((F.col("north") - F.col("south")) / F.col("ny")).alias("_dy"),
    )
    nodes = grid_spine(goal).join(geometry, "grid_id")
    fx = (F.col("lon") - F.col("_w")) / F.col("_dx") - 0.5
    fy = (F.col("lat") - F.col("_s")) / F.col("_dy") - 0.5
    fx = F.greatest(F.lit(0.0), F.least(fx, (F.col("_nx") - 1).cast("double")))
    fy = F.greatest(F.lit(0.0), F.least(fy, (F.col("_ny") - 1).cast("double")))
    i0, wi = fractional_index(fx, F.col("_nx"))
    j0, wj = fractional_index(fy, F.col("_ny"))
    nodes = nodes.select("grid_id", "nx", "ny", "i", "j", i0.alias("i0"), j0.alias("j0"), wi.alias("wi"), wj.alias("wj"))
    quads = corner_quads(cells, nodes, None, ["grid_id"], [], "h", size)
    return nodes.join(quads, ["grid_id", "i0", "j0"]).select("grid_id", "nx", "ny", "i", "j", weighted_corners(F.col).alias("h"))
