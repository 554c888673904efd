"""Boundary relaxation, forcing tendencies and boundary values."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.errors import require
from coastgrid.functions.columns import check_edge


def edge_distance(edge: str, i: Column, j: Column, ni: Column, nj: Column) -> Column:
    """Cells from the open edge, 0 on the outermost row."""
    return {"south": j - 1, "north": nj - j, "west": i - 1, "east": ni - i}[check_edge(edge)]


def relaxation_lambda(
    mask: DataFrame, edge: str, cells: int, timescale: float, ni: str = "ni", nj: str = "nj", wet: str = "wet"
) -> DataFrame:
    """Relaxation rate of every cell: ``1/timescale`` on the edge, tapering to 0 over ``cells``.

    Only water inside the band is relaxed.  ``ni, nj`` are the variable's own extents.
    """
    require(cells >= 0, "cells must be >= 0")
    require(timescale > 0, "timescale must be > 0")
    away = edge_distance(edge, F.col("i"), F.col("j"), F.col(ni), F.col(nj))
    if cells == 0:
        return mask.withColumn("lambda", F.lit(0.0))
    rate = (1.0 / timescale) * (cells - away) / cells
    return mask.withColumn("lambda", F.when(F.col(wet) & (away < cells), rate).otherwise(F.lit(0.0)))


def forcing_tendency(
    state: DataFrame,
    forcing: DataFrame,
    geometry: DataFrame,
    on: Sequence[str] = ("grid_id", "variable", "ts", "i", "j", "k"),
    cell: Sequence[str] = ("grid_id", "i", "j", "k"),
) -> DataFrame:
    """Tendency a forcing row adds to its cell, by the size of lambda.

    Above 1 the value is a flux through the x face, below -1 through the y face, in
    between the field relaxes toward it; exactly 1 or -1, or no data, adds nothing.
    ``geometry`` gives ``area_x, area_y, volume`` per cell.  ``cell`` is part of ``on``.

    The rows of the three tables meet in one list per cell, not in joins: each is dealt out once, all layers and times
    of a place to the same task, so that rows next to one another stay so and are few bytes.
    """
    require(set(cell) <= set(on), "the columns of a cell must be among those a row is told by")
    rest = [c for c in on if c not in cell]
    lam, value = F.col("lambda"), F.col("value")
    term = (
        F.when(lam > 1, F.try_divide(value * F.col("area_x"), F.col("volume")))
        .when(lam < -1, F.try_divide(value * F.col("area_y"), F.col("volume")))
        .when((lam > -1) & (lam < 1), -lam * (F.col("field") - value))
    )
    def part(df: DataFrame, name: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])
        return df.filter(known).select(*keys, F.struct(*columns).alias(name))

    rows = part(forcing, "_forcing", on, ("value", "lambda"))
    rows = rows.unionByName(part(state, "_state", on, ("field",)), allowMissingColumns=True)
    rows = rows.unionByName(part(geometry, "_geometry", cell, ("area_x", "area_y", "volume")), allowMissingColumns=True)
    rows = rows.repartition(*(list(cell[:-1]) or cell))
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    here = Window.partitionBy(*cell).orderBy(*rest) if rest else Window.partitionBy(*cell)
    met = rows.withColumn("_geometries", F.collect_list("_geometry").over(here.rowsBetween(*everything)))
    met = met.withColumn("_states", F.collect_list("_state").over(Window.partitionBy(*cell, *rest)))
    kinds = dict(zip(forcing.columns, [f.dataType for f in forcing.schema]))
    pairs = met.filter(F.col("_forcing").isNotNull()).select(*[F.col(c).cast(kinds[c]).alias(c) for c in on], "_forcing.*", "_geometries", F.inline("_states"))
    return pairs.select(*on, "value", "lambda", "field", F.inline("_geometries")).select(
        *on, (F.lit(0.0) + F.coalesce(term, F.lit(0.0))).alias("tendency")
    )


def boundary_series(forcing: DataFrame, edge: str, ni: str = "ni", nj: str = "nj") -> DataFrame:
    """Prescribed values on the outermost row or column of the open edge.

    ``t`` is the index along the edge.  ``checks.require_variables`` rejects a table
    that lacks a tracer.
    """
    axis, along, last = {
        "south": ("j", "i", False),
        "north": ("j", "i", True),
        "west": ("i", "j", False),
        "east": ("i", "j", True),
    }[check_edge(edge)]
    n = ni if axis == "i" else nj
    outermost = F.col(axis) == (F.col(n) if last else F.lit(1))
    return forcing.filter(outermost).select("grid_id", "variable", "ts", "k", F.col(along).alias("t"), "value")
