from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driver_queries.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def cells(spark):
    """A domain from a matrix written row by row along i: ``h[i][j]``."""

    def build(matrix, grid_id=1):
        nx, ny = len(matrix), len(matrix[0])
        rows = [(grid_id, nx, ny, i + 1, j + 1, float(matrix[i][j])) for i in range(nx) for j in range(ny)]
        return spark.createDataFrame(rows, "grid_id int, nx int, ny int, i int, j int, h double")

    return build


@pytest.fixture(scope="session")
def matrix():
    """Back from cells to a matrix."""

    def build(df, grid_id=1, value="h"):
        rows = [r for r in df.collect() if r["grid_id"] == grid_id]
        out = [[None] * max(r["j"] for r in rows) for _ in range(max(r["i"] for r in rows))]
        for r in rows:
            out[r["i"] - 1][r["j"] - 1] = r[value]
        return out

    return build


@pytest.fixture(scope="session")
def domain(spark):
    def build(nx, ny, west=10.0, east=11.0, south=59.0, north=60.0, z_faces=(-20.0, -10.0, 0.0), grid_id=1):
        return spark.createDataFrame(
            [(grid_id, nx, ny, west, east, south, north, list(z_faces), 1)],
            "grid_id int, nx int, ny int, west double, east double, south double, north double, z_faces array<double>, dataset int",
        )

    return build
