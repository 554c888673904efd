"""River outlets: snapping them to the coast and writing their series into a forcing table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.errors import MissingRecordError, require
from coastgrid.functions.columns import raise_if_any
from coastgrid.functions.session import never_broadcast, summary_table
from coastgrid.operators.grid import center

# Cells searched for a coastal cell, and the offset of source river numbers.
SEARCH_RADIUS = 10
SOURCE_ID_OFFSET = 4


def read_river_series(
    df: DataFrame,
    variables: Mapping[str, str],
    constants: Mapping[str, float],
    id_offset: int = SOURCE_ID_OFFSET,
) -> DataFrame:
    """Prepared river series from source rows ``river, ts, level, <source variables>``.

    Keeps the topmost level of each river, renames the variables, shifts the river
    number and adds the constant-valued variables at every record.
    """
    # The top level is found per river, with map-side partial maxima.
    top = summary_table(df.groupBy("river").agg(F.max("level").alias("_top")))
    surface = df.join(top, "river").filter(F.col("level") == F.col("_top"))
    entries = [F.struct(F.lit(p).alias("variable"), F.col(s).cast("double").alias("value")) for s, p in variables.items()]
    entries += [F.struct(F.lit(n).alias("variable"), F.lit(float(v)).alias("value")) for n, v in constants.items()]
    return surface.select(
        (F.col("river") - id_offset).cast("int").alias("river_id"), "ts", F.inline(F.array(*entries))
    )


def nearest_node(position: Column, low: Column, high: Column, n: Column) -> Column:
    """Index of the nearest cell centre of a regular axis; a tie takes the lower one."""
    step = (high - low) / n
    fraction = (position - low) / step + 0.5
    return F.ceil(fraction - 0.5).cast("int")


def snap_outlets(
    outlets: DataFrame, domains: DataFrame, coastal: DataFrame, radius: int = SEARCH_RADIUS
) -> DataFrame:
    """The coastal cell of every outlet of every domain, or why it has none.

    ``outlets`` is ``grid_id, river_id, lon, lat``.  ``reason`` is NULL for a placed
    outlet, ``outside`` or ``no coast``.  Outlets are first reduced to the distinct
    nodes they fall on; nodes and coastal cells meet in square buckets, and a partial
    minimum runs before the shuffle.  Ring order is distance order, so the cell is the
    minimum of ``(d2, dj, di)`` with ``d2 <= (radius + 1/2)^2``.
    """
    require(radius >= 0, "radius must be >= 0")
    located = outlets.join(domains.select("grid_id", "nx", "ny", "west", "east", "south", "north"), "grid_id")
    def ends(low: str, high: str, n: str) -> tuple[Column, Column]:
        return tuple(center(F.col(low), F.col(high), F.col(n), m) for m in (F.lit(1), F.col(n)))

    (x_first, x_last), (y_first, y_last) = ends("west", "east", "nx"), ends("south", "north", "ny")
    # Strictly inside: an outlet on an outermost node counts as outside.
    inside = (
        (F.col("lon") > x_first) & (F.col("lon") < x_last) & (F.col("lat") > y_first) & (F.col("lat") < y_last)
    )
    located = located.select(
        *outlets.columns,
        inside.alias("_inside"),
        nearest_node(F.col("lon"), F.col("west"), F.col("east"), F.col("nx")).alias("_i"),
        nearest_node(F.col("lat"), F.col("south"), F.col("north"), F.col("ny")).alias("_j"),
    )
    side = 2 * radius + 1

    def bucket(c: str, shift: int = 0) -> Column:
        return F.floor((F.col(c) + shift) / side)

    def span(c: str) -> Column:
        return F.explode(F.sequence(bucket(c, -radius), bucket(c, radius)))

    nodes = located.filter("_inside").select("grid_id", "_i", "_j").distinct()
    reach = nodes.withColumn("_bi", span("_i")).withColumn("_bj", span("_j"))
    shore = coastal.select("grid_id", "i", "j", bucket("i").alias("_bi"), bucket("j").alias("_bj"))
    di, dj = F.col("i") - F.col("_i"), F.col("j") - F.col("_j")
    d2 = di * di + dj * dj
    best = (
        never_broadcast(reach)
        .join(shore, ["grid_id", "_bi", "_bj"])
        .filter(d2 <= F.lit((radius + 0.5) ** 2))
        .groupBy("grid_id", "_i", "_j")
        .agg(
            F.min(
                F.struct(
                    d2.alias("d2"), dj.alias("dj"), di.alias("di"), F.col("i").alias("i"), F.col("j").alias("j")
                )
            ).alias("_b")
        )
    )
    reason = F.when(~F.col("_inside"), F.lit("outside")).when(F.col("_b").isNull(), F.lit("no coast"))
    placed = F.col("_inside")
    return located.join(best, ["grid_id", "_i", "_j"], "left").select(
        *outlets.columns,
        F.when(placed, F.col("_b.i")).alias("i"),
        F.when(placed, F.col("_b.j")).alias("j"),
        F.when(placed, F.sqrt(F.col("_b.d2").cast("double"))).alias("distance"),
        reason.alias("reason"),
    )


def match_series_by_date(times: DataFrame, series: DataFrame, strict: bool = True) -> DataFrame:
    """Every forcing time with the series records of its calendar date.

    ``times`` is ``ts``, ``series`` is ``river_id, variable, ts, value``.  A time
    without a record is an error; with ``strict=False`` it is left out.
    """
    # Few rows out of a whole forcing table: written, else the check and the result would each read that table.
    times = summary_table(times.select("ts").distinct())
    dated = series.withColumn("_day", F.to_date("ts")).drop("ts")
    wanted = times.withColumn("_day", F.to_date("ts"))
    if strict:
        raise_if_any(
            wanted.join(dated.select("_day").distinct(), "_day", "left_anti"),
            F.format_string("no river record on %s", F.col("_day").cast("string")),
            MissingRecordError,
        )
    return wanted.join(dated, "_day").drop("_day")


def match_outlets(outlets: DataFrame, series: DataFrame, strict: bool = True) -> DataFrame:
    """Whether each outlet occurs in the series; a missing one is an error when ``strict``."""
    known = series.select("river_id").distinct().withColumn("_known", F.lit(True))
    out = outlets.join(known, "river_id", "left").withColumn("matched", F.coalesce("_known", F.lit(False))).drop("_known")
    if strict:
        raise_if_any(
            out.filter(~F.col("matched")),
            F.format_string("river %s is not in the series", F.col("river_id").cast("string")),
            MissingRecordError,
        )
    return out


def collision_report(river_cells: DataFrame) -> DataFrame:
    """Cells claimed by more than one placed outlet: how many, and which one wins (the last).

    ``river_cells`` needs ``position``, the outlet's order.
    """
    return (
        river_cells.filter(F.col("i").isNotNull())
        .groupBy("grid_id", "i", "j")
        .agg(F.count(F.lit(1)).alias("outlets"), F.max_by("river_id", "position").alias("winner"))
        .filter("outlets > 1")
    )


def river_patches(river_cells: DataFrame, series: DataFrame) -> DataFrame:
    """One value per claimed cell, variable and time; the later outlet wins a shared cell."""
    owners = (
        river_cells.filter(F.col("i").isNotNull())
        .groupBy("grid_id", "i", "j")
        .agg(F.max_by("river_id", "position").alias("river_id"))
    )
    return owners.join(series, "river_id").select(
        "grid_id", "variable", "ts", "i", "j", F.col("value").alias("_river")
    )


def missing_river_variables(forcing: DataFrame, series: DataFrame) -> DataFrame:
    """River variables the forcing table does not carry (skipped by ``upsert_rivers``)."""
    carried = forcing.select("variable").distinct()
    return series.select("variable").distinct().join(carried, "variable", "left_anti")


def upsert_rivers(
    forcing: DataFrame, river_cells: DataFrame, series: DataFrame, timescale: float, strict: bool = True
) -> DataFrame:
    """Forcing with the surface value and relaxation rate of every river cell replaced.

    Only surface rows (``k = nz``) take part in the join, all deeper rows pass by it.
    ``series`` must already be matched to the forcing times.  ``strict`` raises when
    no river variable occurs in the forcing.
    """
    require(timescale > 0, "timescale must be > 0")
    if strict:
        shared = series.select("variable").distinct().join(forcing.select("variable").distinct(), "variable", "left_semi")
        if shared.isEmpty():
            raise MissingRecordError("none of the river variables are in the forcing table")
    patches = river_patches(river_cells, series)
    surface = forcing.filter(F.col("k") == F.col("nz")).join(patches, ["grid_id", "variable", "ts", "i", "j"], "left")
    hit = F.col("_river").isNotNull()
    patched = surface.withColumns(
        {
            "value": F.when(hit, F.col("_river")).otherwise(F.col("value")),
            "lambda": F.when(hit, F.lit(1.0 / timescale)).otherwise(F.col("lambda")),
        }
    ).select(*forcing.columns)
    return forcing.filter(F.col("k") != F.col("nz")).unionByName(patched)
