from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastgrid.errors import ValidationError
from coastgrid.operators import bathymetry as bathy


def test_diagonal_pairs(cells, matrix):
    h = [[-5, 1], [1, -3]]
    assert matrix(bathy.fill_diagonal_pairs(cells(h))) == [[-5, -4], [1, -3]]
    assert matrix(bathy.fill_secondary_diagonal_pairs(cells(h))) == h
    other = [[1, -5], [-3, 1]]
    assert matrix(bathy.fill_secondary_diagonal_pairs(cells(other))) == [[-4, -5], [-3, 1]]
    assert matrix(bathy.fill_diagonal_pairs(cells(other))) == other


def test_isolated_cells(cells, matrix):
    alone = [[0, 0, 0], [0, -5, 0], [0, 0, 0]]
    assert matrix(bathy.remove_isolated_sea(cells(alone)))[1][1] == 0
    border = [[0, -5, 0], [0, 0, 0], [0, 0, 0]]
    assert matrix(bathy.remove_isolated_sea(cells(border))) == border
    rock = [[-1, -2, -1], [-6, 0, -8], [-1, -4, -1]]
    filled = matrix(bathy.fill_isolated_land(cells(rock)))
    assert filled[1][1] == -5 and filled[0] == rock[0]
    coast = [[0, -1, 0], [-1, -1, -1], [0, -1, 0]]
    assert matrix(bathy.fill_isolated_land(cells(coast))) == coast


def test_shallow_spikes(cells, matrix):
    around = lambda centre: [[-10, -10, -10], [-10, centre, -10], [-10, -10, -10]]
    assert matrix(bathy.fill_shallow_spikes(cells(around(-1)), 0.5)) == around(-10)
    assert matrix(bathy.fill_shallow_spikes(cells(around(-6)), 0.5)) == around(-6)
    shelf = [[-2, -2, -2], [-2, -1.5, -2], [-2, -2, -2]]
    assert matrix(bathy.fill_shallow_spikes(cells(shelf), 0.5)) == shelf
    inlet = [[0, 0, 0], [0, -1, -10], [0, 0, 0]]
    assert matrix(bathy.fill_shallow_spikes(cells(inlet), 0.5)) == inlet
    assert matrix(bathy.fill_shallow_spikes(cells(inlet), 0.5, min_neighbours=1))[1][1] == -10


def _random(n, m, land, seed):
    rng = random.Random(seed)
    return [[0.0 if rng.random() < land else -round(rng.uniform(1, 40), 3) for _ in range(m)] for _ in range(n)]


def _reference_chain(h):
    """The stencils in their own order, one operator at a time."""
    h = bathy.fill_secondary_diagonal_pairs(bathy.fill_diagonal_pairs(h))
    for _ in range(2):
        h = bathy.fill_isolated_land(bathy.remove_isolated_sea(h))
    return h


def test_tiled_cleaning_equals_single_operators(cells, matrix):
    """Small tiles force halos to matter; two domains must not mix."""
    both = cells(_random(23, 17, 0.4, 1), 1).unionByName(cells(_random(11, 19, 0.5, 2), 2))
    tiled = bathy.fill_gaps(both, passes=2, size=5)
    single = _reference_chain(both)
    for g in (1, 2):
        assert matrix(tiled, g) == matrix(single, g)


def test_stencil_does_not_depend_on_tile_size(cells, matrix):
    h = cells(_random(19, 13, 0.3, 3))
    whole = matrix(bathy.fill_shallow_spikes(h, 0.5))
    assert matrix(bathy.fill_shallow_spikes(h, 0.5, size=4)) == whole


def test_slope_pair(cells, matrix):
    steep = [[-1], [-9]]
    d1, d2 = (-r[0] for r in matrix(bathy.limit_bottom_slope(cells(steep), 0.5)))
    assert d1 + d2 == pytest.approx(10) and abs(d1 - d2) / (d1 + d2) == pytest.approx(0.5) and d1 > 1 and d2 < 9
    gentle = [[-9], [-10]]
    assert matrix(bathy.limit_bottom_slope(cells(gentle), 0.5)) == gentle
    floored = matrix(bathy.limit_bottom_slope(cells(steep), 0.5, minimum_depth=2.0))
    assert all(r[0] <= -2 for r in floored)
    with pytest.raises(ValidationError):
        bathy.limit_bottom_slope(cells(gentle), 0.0)
    chain = [[-1], [-900], [-1], [-5], [-900], [-1], [-900]]
    assert len(matrix(bathy.limit_bottom_slope(cells(chain), 0.1, max_passes=1))) == 7
    with pytest.raises(ValidationError, match="passes"):
        bathy.limit_bottom_slope(cells(chain), 0.1, max_passes=1, strict=True)


def _worst(h):
    h = np.array(h)
    worst = 0.0
    for a, b in ((h[:-1], h[1:]), (h[:, :-1], h[:, 1:])):
        wet = (a < 0) & (b < 0)
        worst = max(worst, np.max(np.where(wet, np.abs(a - b) / np.where(wet, np.abs(a + b), 1), 0)))
    return worst


@pytest.mark.parametrize("size", [128, 7])
def test_slope_invariants(cells, matrix, size):
    h = _random(20, 16, 0.2, 5)
    out = matrix(bathy.limit_bottom_slope(cells(h), 0.4, size=size, passes_per_round=2))
    assert _worst(out) <= 0.4 + 1e-9
    assert np.sum(out) == pytest.approx(np.sum(h), abs=1e-8)
    assert all((a == 0) == (b == 0) for x, y in zip(out, h) for a, b in zip(x, y))


def test_slope_does_not_depend_on_tiles_or_rounds(cells, matrix):
    h = cells(_random(18, 14, 0.2, 8))
    a = matrix(bathy.limit_bottom_slope(h, 0.4, size=128, passes_per_round=8))
    b = matrix(bathy.limit_bottom_slope(h, 0.4, size=5, passes_per_round=1))
    assert np.allclose(a, b, atol=0, rtol=0)


def _components(h):
    n, m = len(h), len(h[0])
    label = {}
    for i in range(n):
        for j in range(m):
            if h[i][j] >= 0 or (i, j) in label:
                continue
            stack, members = [(i, j)], []
            label[i, j] = None
            while stack:
                a, b = stack.pop()
                members.append((a, b))
                for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c[0] < n and 0 <= c[1] < m and h[c[0]][c[1]] < 0 and c not in label:
                        label[c] = None
                        stack.append(c)
            name = min(a + 1 + b * n for a, b in members)
            for c in members:
                label[c] = name
    return label


@pytest.mark.parametrize("size", [3, 6])
def test_basins_across_tiles(cells, size):
    h = _random(21, 18, 0.42, 11)
    found = {(r.i - 1, r.j - 1): r.basin for r in bathy.connected_basins(cells(h), size=size).collect()}
    assert found == _components(h)


def test_keep_major_basins(cells, matrix):
    h = [[-1, -1, 0, -1], [-1, 0, 0, -1], [0, 0, -2, 0]]
    assert matrix(bathy.keep_major_basins(cells(h), 1)) == [[-1, -1, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 0]]
    assert matrix(bathy.keep_major_basins(cells(h), 2)) == [[-1, -1, 0, -1], [-1, 0, 0, -1], [0, 0, 0, 0]]


def test_read_bathymetry(spark, cells, domain):
    rows = [(1, 1, 1, 5.0), (1, 2, 1, None), (2, 1, 1, -3.0), (2, 2, 1, 4.0)]
    df = spark.createDataFrame(rows, "grid_id int, i int, j int, h double")
    out = {(r.grid_id, r.i): r.h for r in bathy.read_bathymetry(df).collect()}
    assert out == {(1, 1): -5.0, (1, 2): 0.0, (2, 1): -3.0, (2, 2): 4.0}


def test_axes_may_be_swapped(cells, domain):
    turned = cells([[-1, -2, -3], [-4, -5, -6]]).select("grid_id", F.col("j").alias("i"), F.col("i").alias("j"), "h")
    out = bathy.normalise_axes(turned, domain(2, 3)).collect()
    assert all(r.fits for r in out) and {(r.i, r.j): r.h for r in out}[1, 3] == -3
    assert not any(r.fits for r in bathy.normalise_axes(turned, domain(5, 5)).collect())


def test_misfit_axes_are_an_error_when_strict(cells, domain):
    df = cells([[-1, -2, -3], [-4, -5, -6]])
    with pytest.raises(ValidationError, match="grids 1"):
        bathy.normalise_axes(df, domain(5, 5), strict=True)
    assert bathy.normalise_axes(df, domain(3, 2), strict=True).filter("fits").count() == 6


@pytest.mark.parametrize("swapped", [False, True])
@pytest.mark.parametrize("x_down", [False, True])
def test_domain_from_stored_centres(spark, swapped, x_down):
    """Uneven axes; the last spacing does not set the end."""
    lon, lat = [1.0, 2.0, 4.0], [59.0, 58.0]
    xs = lon[::-1] if x_down else lon
    rows = [(1, *((b, a) if swapped else (a, b)), x, y, -10 * x - y) for a, x in enumerate(xs, 1) for b, y in enumerate(lat, 1) if (x, y) != (2.0, 58.0)]
    found, domains = bathy.read_stored_grid(spark.createDataFrame(rows, "grid_id int, i int, j int, lon double, lat double, h double"))
    d = domains.first()
    assert (d.nx, d.ny, d.x_faces, d.y_faces) == (3, 2, [0.5, 1.5, 3.0, 4.5], [57.5, 58.5, 59.5])
    assert (d.west, d.east, d.south, d.north) == (0.5, 4.5, 57.5, 59.5)
    assert {(r.i, r.j): r.h for r in found.collect()} == {(lon.index(x) + 1, 2 if y == 59.0 else 1): h for *_, x, y, h in rows}


def test_centres_that_span_no_axes(spark):
    schema = "grid_id int, i int, j int, lon double, lat double, h double"
    square = [(1, 1, 1.0, 5.0), (2, 1, 2.0, 5.0), (1, 2, 1.0, 6.0), (2, 2, 2.0, 6.0)]
    tables = {
        1: square,
        2: [(i, j, x + 0.1 * j, y) for i, j, x, y in square],  # turned
        3: [(i, j, 1.0, y) for i, j, _, y in square],  # two centres alike
        4: square[::2],  # one centre along an axis
        5: [(2 * i, j, x, y) for i, j, x, y in square],  # index 1 is missing
        6: [(i, j, None, y) for i, j, _, y in square],
    }
    df = spark.createDataFrame([(g, *r, -1.0) for g, rows in tables.items() for r in rows], schema)
    with pytest.raises(ValidationError, match="grids 2, 3, 4, 5, 6"):
        bathy.read_stored_grid(df)
    kept, domains = bathy.read_stored_grid(df, strict=False)
    assert [r.grid_id for r in domains.collect()] == [1] and kept.count() == 4
    none = spark.createDataFrame([], schema)
    assert bathy.read_stored_grid(none)[0].count() == 0


def test_regrid_is_exact_on_a_plane_and_floors(cells, matrix, domain):
    plane = [[-(10.0 + i + 2 * j) for j in range(8)] for i in range(10)]
    d = domain(10, 8)
    same = matrix(bathy.regrid_bathymetry(cells(plane), d, d))
    assert np.allclose(same, plane)
    finer = domain(20, 16)
    for passes in (1, 3):
        out = np.array(matrix(bathy.regrid_bathymetry(cells(plane), d, finer, passes=passes)))
        assert out.shape == (20, 16)
        assert out[9, 7] == pytest.approx(-(10 + 4.25 + 2 * 3.25))
    shallow = matrix(bathy.regrid_bathymetry(cells([[-1.0, 0.0], [-5.0, 0.0]]), domain(2, 2), domain(2, 2), minimum_depth=3.0))
    assert shallow == [[-3.0, 0.0], [-5.0, 0.0]]


def test_only_tiles_with_steep_pairs_are_swept_again(spark, monkeypatch):
    """A shoal in one corner of a wide domain: later rounds write few cells, and the result is that of one tile."""
    rows = [(1, 96, 64, i, j, -1.0 if i <= 4 and j <= 4 else -30.0) for i in range(1, 97) for j in range(1, 65)]
    cells = spark.createDataFrame(rows, "grid_id int, nx int, ny int, i int, j int, h double")
    whole = {(r.i, r.j): r.h for r in bathy.limit_bottom_slope(cells, 0.2).collect()}
    written, keep = [], bathy.materialise

    def counted(df):
        out = keep(df)
        if "steepest" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(bathy, "materialise", counted)
    tiled = {(r.i, r.j): r.h for r in bathy.limit_bottom_slope(cells, 0.2, passes_per_round=2, size=8).collect()}
    assert tiled == whole
    assert written[0] == 96 * 64 and len(written) > 1 and max(written[1:]) < 96 * 64 / 4


def test_a_pair_over_a_tile_border_wakes_both_tiles(spark):
    heights = [-20.0 if i <= 6 else -1.0 for i in range(1, 13)]
    for line in (heights, heights[::-1]):
        cells = spark.createDataFrame([(1, 12, 1, i, 1, h) for i, h in enumerate(line, 1)], "grid_id int, nx int, ny int, i int, j int, h double")
        results = [
            {r.i: r.h for r in bathy.limit_bottom_slope(cells, 0.2, passes_per_round=n, size=size).collect()} for n, size in ((8, 128), (1, 3), (2, 2))
        ]
        assert results[0] == results[1] == results[2]


def test_strict_reaches_through_smoothing(cells):
    with pytest.raises(ValidationError, match="still above"):
        bathy.smooth_gaps(cells([[-1000.0] * 3, [-1.0] * 3, [-1000.0] * 3, [-1.0] * 3]), max_slope_factor=1e-6, strict=True)


def test_small_tiles_share_a_call(spark):
    cells = spark.createDataFrame([(1, 20, 15, i, j, -1.0) for i in range(1, 21) for j in range(1, 16)], "grid_id int, nx int, ny int, i int, j int, h double")
    tiled = bathy.spread_to_tiles(cells, ["grid_id"], 5, 4)
    calls = bathy._per_tile(tiled, lambda rows: rows.assign(n=len(rows)).head(1)[["n"]], "n long", 5, 4).collect()
    assert [r.n for r in calls] == [tiled.count()]
    assert bathy._per_tile(tiled, lambda rows: rows.assign(n=len(rows)).head(1)[["n"]], "n long", 65, 0).count() == 12


def test_a_domain_of_one_tile_takes_one_round(cells, matrix, monkeypatch):
    """It is swept as often as over smaller tiles, without being written again."""
    steep = [[-50.0 if (i + j) % 7 == 0 else -1.0 - i for j in range(9)] for i in range(12)]
    tiled = matrix(bathy.limit_bottom_slope(cells(steep), 0.05, max_passes=4, passes_per_round=2, size=6))
    written, keep = [], bathy.materialise
    monkeypatch.setattr(bathy, "materialise", lambda df: (written.append(df.columns), keep(df))[1])
    assert matrix(bathy.limit_bottom_slope(cells(steep), 0.05, max_passes=4, passes_per_round=2)) == tiled
    assert sum("steepest" in columns for columns in written) == 1
