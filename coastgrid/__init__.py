"""coastgrid: gridded coastal-ocean data preparation as Spark DataFrame jobs.

Every operator takes and returns DataFrames and carries its key columns
(``grid_id``, ``dataset`` or ``series``) so that many domains, variables and
years run in one job.
"""

from coastgrid import functions, operators, plans, sinks, sources, streaming

__all__ = ["functions", "operators", "plans", "sinks", "sources", "streaming"]
