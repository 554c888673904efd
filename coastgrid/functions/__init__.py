"""Column functions, tiling and session helpers shared by the operators."""

from coastgrid.functions import columns, crs, neighbours, session, tiles

__all__ = ["columns", "crs", "neighbours", "session", "tiles"]
