"""Composed jobs and the source protocols they call."""

from coastgrid.plans.adapters import (
    AtmosphereSource,
    BathymetrySource,
    ForcingSource,
    RiverSource,
    TableAtmosphereSource,
    TableBathymetrySource,
    TableForcingSource,
    TableRiverSource,
)
from coastgrid.plans.jobs import (
    AtmosphereConfig,
    BathymetryConfig,
    ForcingConfig,
    RiverConfig,
    add_rivers,
    prepare_bathymetry,
    prepare_month,
    publish_pending_months,
    regrid_atmosphere,
    regrid_forcing,
)

__all__ = [
    "AtmosphereConfig",
    "AtmosphereSource",
    "BathymetryConfig",
    "BathymetrySource",
    "ForcingConfig",
    "ForcingSource",
    "RiverConfig",
    "RiverSource",
    "TableAtmosphereSource",
    "TableBathymetrySource",
    "TableForcingSource",
    "TableRiverSource",
    "add_rivers",
    "prepare_bathymetry",
    "prepare_month",
    "publish_pending_months",
    "regrid_atmosphere",
    "regrid_forcing",
]
