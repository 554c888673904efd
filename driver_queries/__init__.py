"""Queries over the driver's tables and their SQL twins."""

from driver_queries.registry import oracle_sql, queries, with_package

__all__ = ["oracle_sql", "queries", "with_package"]
