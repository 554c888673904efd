"""All registered queries, by operator family."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from driver_queries import bathymetry, checks, grid, interp, masks, relax, sources, timeaxis
from driver_queries.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (sources, grid, masks, bathymetry, timeaxis, interp, relax, checks)


def with_package(query: Query) -> Query:
    """The query, run after the library was shipped to the workers."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf)

    return run


def queries() -> dict[str, Query]:
    return {name: with_package(query) for family in FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
