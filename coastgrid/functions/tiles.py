"""Halo tiles: one shuffle for any stencil, whatever the size of a domain.

A cell goes to the tile it lies in and, near a tile border, also to the tiles
whose halo it falls into.  After hash partitioning on ``(keys, tile)`` every row
and column of a tile is local, so window functions along either axis need no
further exchange, and no task ever holds more than one tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 128
TILE_COLUMNS = ("tile_i", "tile_j")


def tile_of(index: Column, size: int) -> Column:
    """0-based tile number of a 1-based cell index."""
    return F.floor((index - 1) / size).cast("int")


def spread_to_tiles(df: DataFrame, keys: Sequence[str], size: int = TILE, halo: int = 1) -> DataFrame:
    """Copy each cell to every tile that needs it and hash-partition by tile.

    Needs ``nx, ny, i, j``.  Adds ``tile_i, tile_j`` and ``core``, true in the one
    tile that owns the cell.
    """

    def tiles(axis: str, n: str) -> Column:
        low = F.greatest(F.lit(0), tile_of(F.col(axis) - halo, size))
        high = F.least(tile_of(F.col(n), size), tile_of(F.col(axis) + halo, size))
        return F.explode(F.sequence(low, high))

    out = df.withColumn("tile_i", tiles("i", "nx")).withColumn("tile_j", tiles("j", "ny"))
    core = (F.col("tile_i") == tile_of(F.col("i"), size)) & (F.col("tile_j") == tile_of(F.col("j"), size))
    return out.withColumn("core", core).repartition(*keys, *TILE_COLUMNS)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    diagonal: bool = False,
    size: int = TILE,
) -> DataFrame:
    """Add the neighbouring values of ``value`` as ``west, east, south, north``.

    ``diagonal`` adds ``south_west, south_east, north_west, north_east``.  A
    neighbour outside the domain, or absent from the table, is NULL.
    """
    tiled = spread_to_tiles(df, keys, size, halo=1)
    group = [*keys, *TILE_COLUMNS]
    along_i = Window.partitionBy(*group, "j").orderBy("i")
    along_j = Window.partitionBy(*group, "i").orderBy("j")

    def shifted(column: str, axis: str, step: int, window) -> Column:
        move = F.lag if step < 0 else F.lead
        return F.when(move(axis).over(window) == F.col(axis) + step, move(column).over(window))

    out = tiled.withColumns(
        {"west": shifted(value, "i", -1, along_i), "east": shifted(value, "i", 1, along_i)}
    )
    vertical = {"south": shifted(value, "j", -1, along_j), "north": shifted(value, "j", 1, along_j)}
    if diagonal:
        for side in ("west", "east"):
            vertical[f"south_{side}"] = shifted(side, "j", -1, along_j)
            vertical[f"north_{side}"] = shifted(side, "j", 1, along_j)
    return out.withColumns(vertical).filter("core").drop("core", *TILE_COLUMNS)
