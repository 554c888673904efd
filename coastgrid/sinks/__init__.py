"""Writing prepared tables."""

from coastgrid.sinks.ledger import (
    check_published,
    drop_unnamed,
    pending_published,
    publish_months,
    published_months,
    read_published,
    unnamed_versions,
)
from coastgrid.sinks.slabs import pack_slabs, unpack_slabs
from coastgrid.sinks.writers import (
    not_finite,
    pending_months,
    write_atmosphere,
    write_bathymetry,
    write_forcing,
    write_month_staged,
    write_river_copy,
)

__all__ = [
    "check_published",
    "drop_unnamed",
    "not_finite",
    "pack_slabs",
    "pending_months",
    "pending_published",
    "publish_months",
    "published_months",
    "read_published",
    "unnamed_versions",
    "unpack_slabs",
    "write_atmosphere",
    "write_bathymetry",
    "write_forcing",
    "write_month_staged",
    "write_river_copy",
]
