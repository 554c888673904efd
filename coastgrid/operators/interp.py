"""Filling masked cells and interpolating in space.

Source values are ``dataset, [variable, ts,] lev, i, j, value`` with 1-based i, j.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.functions.columns import clamp, finite
from coastgrid.functions.session import never_broadcast, summary_table
from coastgrid.functions.tiles import TILE, TILE_COLUMNS, tile_of

#: The corners of a source cell, as ``v<east><north>``.
CORNERS = ("v00", "v10", "v01", "v11")


def fractional_index(fraction: Column, n: Column) -> tuple[Column, Column]:
    """Lower 1-based index, clamped to ``[1, n - 1]``, and weight of the upper neighbour.

    ``fraction`` is the 0-based fractional position; outside the axis the weight
    extrapolates, which ``checks.validate_target_coverage`` rules out.
    """
    lower = clamp(F.floor(fraction).cast("int"), 0, n - 2)
    return lower + 1, fraction - lower


def bilinear_weights(
    nodes: DataFrame, source_grid: DataFrame, keys: Sequence[str] = ("dataset",), target: Sequence[str] = ("grid_id", "i", "j")
) -> DataFrame:
    """Four ``(src_i, src_j, weight)`` rows per projected target node.

    ``source_grid`` has ``x0, dx, nx, y0, dy, ny`` per dataset.
    """
    located = locate_nodes(nodes, source_grid, keys, target)
    wi, wj = F.col("wi"), F.col("wj")

    def corner(di: int, dj: int, weight: Column) -> Column:
        return F.struct(
            (F.col("i0") + di).alias("src_i"), (F.col("j0") + dj).alias("src_j"), weight.alias("weight")
        )

    corners = F.array(
        corner(0, 0, (1 - wi) * (1 - wj)),
        corner(1, 0, wi * (1 - wj)),
        corner(0, 1, (1 - wi) * wj),
        corner(1, 1, wi * wj),
    )
    return located.select(*keys, *[c for c in target if c not in keys], F.inline(corners))


def locate_nodes(
    nodes: DataFrame, source_grid: DataFrame, keys: Sequence[str] = ("dataset",), target: Sequence[str] = ("grid_id", "i", "j")
) -> DataFrame:
    """Lower source cell ``i0, j0`` and upper weights ``wi, wj`` of every target node."""
    geometry = source_grid.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("x0", "dx", "nx", "y0", "dy", "ny")])
    i0, wi = fractional_index((F.col("x") - F.col("_x0")) / F.col("_dx"), F.col("_nx"))
    j0, wj = fractional_index((F.col("y") - F.col("_y0")) / F.col("_dy"), F.col("_ny"))
    return nodes.join(geometry, list(keys)).select(
        *keys,
        *[c for c in target if c not in keys],
        i0.alias("i0"),
        j0.alias("j0"),
        wi.alias("wi"),
        wj.alias("wj"),
    )


def vertical_weights(levels: DataFrame, depths: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Source levels and weights that bracket every target layer centre.

    ``levels`` has ``keys, k, z_center`` (z <= 0), ``depths`` has ``keys, depths``, a
    depth array ascending from the surface.  Outside the source range the end level
    gets all the weight.  At most two rows per layer.
    """
    joined = levels.join(depths.select(*keys, "depths"), list(keys))
    d, want = F.col("depths"), -F.col("z_center")
    above = F.size(F.filter(d, lambda v: v <= want))
    low = clamp(above, 1, F.size(d) - 1)
    d_low, d_high = F.element_at(d, low), F.try_element_at(d, low + 1)
    share = F.try_divide(want - d_low, d_high - d_low)
    # A single source level has no upper neighbour; least/greatest would skip the NULL.
    weight = F.when(share.isNull(), F.lit(0.0)).otherwise(clamp(share, F.lit(0.0), F.lit(1.0)))
    pair = joined.withColumns({"_low": low, "_w": weight}).select(
        *keys,
        "k",
        F.inline(
            F.array(
                F.struct(F.col("_low").alias("lev"), (1 - F.col("_w")).alias("weight")),
                F.struct((F.col("_low") + 1).alias("lev"), F.col("_w").alias("weight")),
            )
        ),
    )
    return pair.filter("weight > 0")


def apply_weights(
    values: DataFrame,
    weights: DataFrame,
    on: Sequence[str],
    carry: Sequence[str],
    target: Sequence[str],
    value: str = "value",
) -> DataFrame:
    """Sparse matrix times field: the weighted sum of source cells per target.

    ``on`` are the source columns shared by both sides, ``carry`` the columns of
    ``values`` kept apart (variable, ts), ``target`` the target columns of
    ``weights``.  A contributing no-data cell makes the result NULL, except with
    weight 0.

    Neighbouring targets mostly take the same source cells.  Each such set is given its values once, for every ``carry``,
    and meets the weights of its targets there: products are summed row by row, and neither they nor the target field are
    shuffled.  Sets are told apart by 128 bits of hash; one holds the few source cells of a target.
    """
    named = [F.col(c).isNotNull() for c in on]
    used = weights.filter("weight <> 0").filter(reduce(Column.__and__, named))
    kind = values.join(used, list(on)).agg(F.sum(F.col(value) * F.col("weight")).alias("s")).schema["s"].dataType
    # All but the last target column deal the weights out: targets next to one another mostly share their source cells.
    lines = list(target[:-1]) or list(target)
    terms = used.repartition(*lines).groupBy(*target).agg(F.array_sort(F.collect_list(F.struct(*on, "weight"))).alias("_terms"))
    cells = F.transform("_terms", lambda t: F.struct(*[t[c].alias(c) for c in on]))
    rows = terms.select(*target, F.transform("_terms", lambda t: t["weight"]).alias("_weights"), cells.alias("_cells"))
    name = ["_set", "_set_too"]
    rows = rows.withColumns({n: F.xxhash64(F.lit(k), F.col("_cells")) for k, n in enumerate(name)})
    sets = rows.groupBy(*name).agg(F.first("_cells").alias("_cells"))
    asked = sets.select(*name, F.posexplode("_cells").alias("_at", "_cell")).select(*name, "_at", *[F.col(f"_cell.{c}").alias(c) for c in on])
    given = values.select(*on, *carry, F.col(value).alias("_value")).join(never_broadcast(asked), list(on))
    at_set = given.select(*name, *carry, F.struct("_at", "_value").alias("_term")).repartition(*name)
    at_set = at_set.groupBy(*name, *carry).agg(F.array_sort(F.collect_list("_term")).alias("_values"))
    product = lambda t: t["_value"] * F.element_at("_weights", t["_at"] + 1)
    total = F.aggregate("_values", F.lit(0).cast(kind), lambda s, t: (s + product(t)).cast(kind))
    whole = F.forall("_values", lambda t: t["_value"].isNotNull())
    return (
        never_broadcast(rows.drop("_cells"))
        .join(never_broadcast(at_set), name)
        .select(*carry, *target, F.when(whole, total).alias(value))
    )


def source_slabs(values: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The slabs of a source, one row per ``(keys, carry)``; counted inside the tasks first."""
    return values.select(*keys, *carry).distinct()


def corner_quads(
    values: DataFrame,
    cells: DataFrame,
    slabs: DataFrame | None,
    keys: Sequence[str],
    carry: Sequence[str],
    value: str = "value",
    size: int = TILE,
) -> DataFrame:
    """The four corners of every asked-for source cell in one row: ``keys, carry, i0, j0, v00, v10, v01, v11``.

    ``cells`` (``keys, i0, j0``) are the lower left corners some target needs, ``slabs`` the
    ``(keys, carry)`` to expect, of no use without ``carry``.  Every cell gets a row in every slab of its keys; a corner
    whose source row is missing is NULL, whichever of the four it is.

    Source rows go to the tile of ``size`` cells that holds the lower left corners they belong to, and
    along a tile's lower borders to the tile before too.  They are dealt out by slab and tile, so a slab of any
    extent spreads over its tiles, and only then take their up to four places.
    """
    roles = F.array(*[F.struct((F.col("i") - di).alias("i0"), (F.col("j") - dj).alias("j0"), F.lit(f"v{di}{dj}").alias("_role")) for di in (0, 1) for dj in (0, 1)])
    group = [*keys, *carry, *TILE_COLUMNS]

    def spread(axis: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.lit(0), tile_of(F.col(axis) - 1, size)), tile_of(F.col(axis), size)))

    given = values.select(*keys, *carry, "i", "j", F.col(value).alias("_value")).withColumn("tile_i", spread("i")).withColumn("tile_j", spread("j"))
    asked = cells.select(*keys, "i0", "j0").distinct()
    if carry:
        # A row a slab: written, so that its true size decides whether it is broadcast.
        asked = asked.join(summary_table(slabs), list(keys))
    skeleton = asked.select(
        *keys,
        *carry,
        F.col("i0").alias("i"),
        F.col("j0").alias("j"),
        F.lit(None).cast(values.schema[value].dataType).alias("_value"),
        tile_of(F.col("i0"), size).alias("tile_i"),
        tile_of(F.col("j0"), size).alias("tile_j"),
        F.lit(True).alias("_asked"),
    )
    dealt = given.withColumn("_asked", F.lit(False)).unionByName(skeleton).repartition(*group)
    placed = dealt.select(*group, "_value", "_asked", F.inline(roles))
    # A cell takes a place in its own tile alone; what was asked for is a lower left corner.
    own = (tile_of(F.col("i0"), size) == F.col("tile_i")) & (tile_of(F.col("j0"), size) == F.col("tile_j"))
    placed = placed.filter(own & (~F.col("_asked") | (F.col("_role") == "v00")))
    corners = [F.first(F.when((F.col("_role") == c) & ~F.col("_asked"), F.col("_value")), ignorenulls=True).alias(c) for c in CORNERS]
    quads = placed.groupBy(*group, "i0", "j0").agg(F.bool_or("_asked").alias("_asked"), *corners)
    return quads.filter("_asked").select(*keys, *carry, "i0", "j0", *CORNERS)


def weighted_corners(at_corner: Callable[[str], Column]) -> Column:
    """Bilinear value from the corners and ``wi, wj``; a corner of weight 0 may be no-data."""
    wi, wj = F.col("wi"), F.col("wj")
    out = F.lit(0.0)
    for corner, weight in zip(CORNERS, ((1 - wi) * (1 - wj), wi * (1 - wj), (1 - wi) * wj, wi * wj)):
        out = out + F.when(weight != 0, at_corner(corner) * weight).otherwise(F.lit(0.0))
    return out


def bilinear_gather(
    values: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str] = ("dataset",),
    carry: Sequence[str] = ("variable", "ts"),
    target: Sequence[str] = ("grid_id", "i", "j"),
    value: str = "value",
    slabs: DataFrame | None = None,
    size: int = TILE,
) -> DataFrame:
    """Bilinear interpolation of regular source slabs at located nodes.

    ``nodes`` comes from ``locate_nodes``.  A slab is one ``(keys, carry)`` group of ``slabs``, by default of
    those that occur in ``values``; every node gets a row in each, NULL where a corner
    that weighs something is masked or has no row.
    """
    slabs = source_slabs(values, keys, carry) if slabs is None else slabs
    quads = corner_quads(values, nodes, slabs, keys, carry, value, size)
    return nodes.join(quads, [*keys, "i0", "j0"]).select(
        *carry, *[c for c in target if c not in carry], weighted_corners(F.col).alias(value)
    )


def pack_columns(
    values: DataFrame, keys: Sequence[str] = ("dataset",), carry: Sequence[str] = ("variable", "ts"), value: str = "value"
) -> DataFrame:
    """One array per water column, ``levels``: element n is the value of level n, NULL where it has no row.

    A column has as many values as the source has levels, a few dozen at most.
    """
    cell = F.struct("lev", F.col(value).alias("v"))
    at_level = lambda n: F.get(F.filter("_c", lambda c: c["lev"] == n), F.lit(0))["v"]
    return (
        values.groupBy(*keys, *carry, "i", "j")
        .agg(F.collect_list(cell).alias("_c"), F.max("lev").cast("int").alias("_n"))
        .select(*keys, *carry, "i", "j", F.transform(F.sequence(F.lit(1), F.col("_n")), at_level).alias("levels"))
    )


def layer_brackets(levels: DataFrame, depths: DataFrame, keys: Sequence[str] = ("grid_id", "dataset")) -> DataFrame:
    """The vertical weights of each grid as one small array ``layers`` of
    ``(k, lo, hi, w, z_bottom, z_top)``, for ``trilinear_gather``."""
    pairs = vertical_weights(levels, depths, keys)
    low = F.min("lev").alias("lo")
    bracket = pairs.groupBy(*keys, "k").agg(low, F.max("lev").alias("hi"), F.min_by("weight", -F.col("lev")).alias("_hw"))
    rows = bracket.join(levels.select(*keys, "k", "z_bottom", "z_top"), [*keys, "k"]).withColumn(
        "w", F.when(F.col("hi") > F.col("lo"), F.col("_hw")).otherwise(F.lit(0.0))
    )
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("k", "lo", "hi", "w", "z_bottom", "z_top"))).alias("layers")
    )


def trilinear_gather(
    columns: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str] = ("dataset",),
    carry: Sequence[str] = ("variable", "ts"),
    target: Sequence[str] = ("grid_id", "i", "j"),
    slabs: DataFrame | None = None,
    size: int = TILE,
) -> DataFrame:
    """Interpolate packed water columns at located nodes and layers, in one join.

    ``nodes`` comes from ``locate_nodes`` plus the ``layers`` of ``layer_brackets``; ``slabs``
    as in ``bilinear_gather``.  Columns may end at different levels or be missing: a level
    that a column lacks is no-data.  Only source-sized rows are shuffled; the target field is produced row by row
    afterwards and is not regrouped.
    """
    slabs = source_slabs(columns, keys, carry) if slabs is None else slabs
    quads = corner_quads(columns, nodes, slabs, keys, carry, "levels", size)
    rows = nodes.join(quads, [*keys, "i0", "j0"]).select("*", F.inline("layers"))
    w = F.col("w")

    def at_corner(corner: str) -> Column:
        low, high = F.get(corner, F.col("lo") - 1), F.get(corner, F.col("hi") - 1)
        return F.when(w == 0, low).when(w == 1, high).otherwise((1 - w) * low + w * high)

    extra = [c for c in nodes.columns if c not in (*keys, "i0", "j0", "wi", "wj", "layers")]
    names = list(dict.fromkeys([*carry, *target, *extra, "k", "z_bottom", "z_top"]))
    return rows.select(*names, weighted_corners(at_corner).alias("value"))


def nearest_valid_map(valid: DataFrame, keys: Sequence[str] = ("dataset", "lev")) -> DataFrame:
    """For every cell, the nearest valid cell of the same level in index space.

    An exact separable distance transform: first the nearest valid cell within each
    column, then the best column within each row.  Ties go to the lowest j, then the
    lowest i.  A level without valid cells yields no rows.
    """
    column = Window.partitionBy(*keys, "i").orderBy("j")
    at_j = F.when(F.col("valid"), F.col("j"))
    below = F.last(at_j, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(at_j, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    nearer_above = F.col("_above").isNotNull() & (
        F.col("_below").isNull() | (F.col("_above") - F.col("j") < F.col("j") - F.col("_below"))
    )
    columns = (
        valid.withColumns({"_below": below, "_above": above})
        .withColumn("_src_j", F.when(nearer_above, F.col("_above")).otherwise(F.col("_below")))
        .select(*keys, "i", "j", "_src_j")
    )
    # One row of one level per group, bounded by the horizontal extent of the source.
    cell = F.struct(F.col("i").alias("i"), F.col("_src_j").alias("j"))
    rows = columns.groupBy(*keys, "j").agg(F.array_sort(F.collect_list(cell)).alias("_row"))

    def best(c: Column, at: Column) -> Column:
        # No column farther away than the own column's find can be nearer.
        reach = F.coalesce(F.abs(c["j"] - F.col("j")), F.size("_row"))
        start = F.greatest(at - reach, F.lit(0)) + 1
        near = F.slice("_row", start, at + reach - start + 2)
        return F.array_min(
            F.transform(
                F.filter(near, lambda o: o["j"].isNotNull()),
                lambda o: F.struct(
                    ((o["i"] - c["i"]) * (o["i"] - c["i"]) + (o["j"] - F.col("j")) * (o["j"] - F.col("j"))).alias("d2"),
                    o["j"].alias("src_j"),
                    o["i"].alias("src_i"),
                ),
            )
        )

    return (
        rows.select(
            *keys, "j", F.inline(F.transform("_row", lambda c, at: F.struct(c["i"].alias("i"), best(c, at).alias("b"))))
        )
        .filter(F.col("b").isNotNull())
        .select(*keys, "i", "j", F.col("b.src_i").alias("src_i"), F.col("b.src_j").alias("src_j"))
    )


def fill_map(valid: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Where every source cell takes its value from: ``src_lev, src_i, src_j``.

    A level without a valid cell takes the filled deepest level that has one.
    """
    nearest = nearest_valid_map(valid, [*keys, "lev"])
    levels = valid.groupBy(*keys, "lev").agg(F.bool_or("valid").alias("_any"))
    deepest = levels.filter("_any").groupBy(*keys).agg(F.max("lev").alias("_deepest"))
    redirected = levels.join(deepest, list(keys)).select(
        *keys, "lev", F.when(F.col("_any"), F.col("lev")).otherwise(F.col("_deepest")).alias("src_lev")
    )
    # The cells were unpacked from rows of a level, so they are more than their estimated size tells.
    return redirected.join(never_broadcast(nearest.withColumnRenamed("lev", "src_lev")), [*keys, "src_lev"]).select(
        *keys, "lev", "i", "j", "src_lev", "src_i", "src_j"
    )


def fill_masked(
    values: DataFrame,
    mapping: DataFrame,
    keys: Sequence[str] = ("dataset",),
    carry: Sequence[str] = ("ts",),
    value: str = "value",
) -> DataFrame:
    """Replace every masked value through the fill map; valid cells map to themselves.

    Each source value is sent to the cells it fills, so one join on the source cell
    does the whole fill and no masked row needs to exist in ``values``.
    """
    source = values.select(
        *keys,
        *carry,
        F.col("lev").alias("src_lev"),
        F.col("i").alias("src_i"),
        F.col("j").alias("src_j"),
        value,
    )
    return source.join(mapping, [*keys, "src_lev", "src_i", "src_j"]).select(
        *keys, *carry, "lev", "i", "j", value
    )


def zero_fill(df: DataFrame, value: str = "value") -> DataFrame:
    """No-data and non-finite values become 0."""
    return df.withColumn(value, F.when(finite(F.col(value)), F.col(value)).otherwise(F.lit(0.0)))
