"""Incremental preparation of months as their forecast files arrive."""

from coastgrid.streaming.months import stream_deaccumulated_months

__all__ = ["stream_deaccumulated_months"]
