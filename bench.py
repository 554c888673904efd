"""Headline queries, timed end to end into Spark's ``noop`` sink.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from driver_queries import queries  # noqa: E402
from driver_queries.session import local_session  # noqa: E402

HEADLINE = (
    "wet_volume_by_layer",
    "B1_idw_grid",
    "B2_rasterize_land",
    "B7_smooth_gaps",
    "B8_keep_major_basins",
    "B9_fill_shallow_spikes",
    "B10_limit_bottom_slope",
    "F6_coastal_cells",
    "G8_project_utm",
    "G11_rotate_vectors",
    "T7_blend_steps",
    "T9_interpolate_cyclical",
    "T14_deaccumulate",
    "I3_bilinear_gather",
    "I5_fill_masked",
    "I6_regrid_forcing",
    "I7_regrid_atmosphere",
    "K2_write_forcing",
    "R2_snap_outlets",
    "R5_add_rivers",
    "R7_forcing_tendency",
    "M9_read_state_last",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    every = queries()
    every["G5_expand_domain"](spark, sf).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {spent[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
