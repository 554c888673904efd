"""Reading records, outlets, fields and fetched payloads."""

from coastgrid.sources.readers import (
    dedupe_records,
    read_field,
    read_outlets,
    read_payloads,
    read_records,
)

__all__ = ["dedupe_records", "read_field", "read_outlets", "read_payloads", "read_records"]
