"""The operators, by family."""

from coastgrid.operators import (
    bathymetry,
    checks,
    grid,
    interp,
    masks,
    relax,
    rivers,
    soundings,
    timeaxis,
)

__all__ = [
    "bathymetry",
    "checks",
    "grid",
    "interp",
    "masks",
    "relax",
    "rivers",
    "soundings",
    "timeaxis",
]
