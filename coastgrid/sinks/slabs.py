"""The two layouts of a field: one row per cell, or one array per tile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB_TILE = 64


def pack_slabs(
    df: DataFrame, keys: Sequence[str] = ("grid_id", "variable", "ts", "k"), tile: int = SLAB_TILE, value: str = "value"
) -> DataFrame:
    """One row per tile of a horizontal slab, with its cells in (j, i) order.

    A tile holds at most ``tile * tile`` cells, which bounds every group.
    """
    cell = F.struct(F.col("j"), F.col("i"), F.col(value).alias("v"))
    packed = (
        df.withColumns(
            {"tile_i": F.floor((F.col("i") - 1) / tile).cast("int"), "tile_j": F.floor((F.col("j") - 1) / tile).cast("int")}
        )
        .groupBy(*keys, "tile_i", "tile_j")
        .agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    )
    return packed.select(
        *keys,
        "tile_i",
        "tile_j",
        F.transform("_c", lambda c: c["i"]).alias("is"),
        F.transform("_c", lambda c: c["j"]).alias("js"),
        F.transform("_c", lambda c: c["v"]).alias("values"),
    )


def unpack_slabs(df: DataFrame, keys: Sequence[str] = ("grid_id", "variable", "ts", "k"), value: str = "value") -> DataFrame:
    """Back to one row per cell."""
    return df.select(*keys, F.inline(F.arrays_zip("is", "js", "values"))).withColumnsRenamed(
        {"is": "i", "js": "j", "values": value}
    )
