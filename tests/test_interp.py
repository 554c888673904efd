from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coastgrid.errors import CoverageError, ValidationError
from coastgrid.operators import checks, interp, masks, soundings


def _valid(spark, grid, lev=1, dataset=1):
    rows = [(dataset, lev, i + 1, j + 1, bool(v)) for i, line in enumerate(grid) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "dataset int, lev int, i int, j int, valid boolean")


def test_nearest_valid(spark):
    one = [[0, 0, 0], [0, 1, 0], [0, 0, 0]]
    assert {(r.src_i, r.src_j) for r in interp.nearest_valid_map(_valid(spark, one)).collect()} == {(2, 2)}
    two = [[1, 0, 0], [0, 1, 0], [0, 0, 0]]
    got = {(r.i, r.j): (r.src_i, r.src_j) for r in interp.nearest_valid_map(_valid(spark, two)).collect()}
    assert got[1, 1] == (1, 1) and got[2, 2] == (2, 2) and got[3, 3] == (2, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_valid_against_brute_force(spark, seed):
    rng = random.Random(seed)
    grid = [[rng.random() < 0.12 for _ in range(17)] for _ in range(13)]
    good = [(i + 1, j + 1) for i in range(13) for j in range(17) if grid[i][j]]
    for r in interp.nearest_valid_map(_valid(spark, grid)).collect():
        best = min(((r.i - a) ** 2 + (r.j - b) ** 2, b, a) for a, b in good)
        assert (r.src_j, r.src_i) == best[1:]


def test_fill(spark):
    values = {(1, 1, 1): 1.0, (1, 1, 2): 2.0, (1, 2, 1): None, (1, 2, 2): 4.0, **{(2, i, j): None for i in (1, 2) for j in (1, 2)}}
    rows = [(1, "t", *k, v) for k, v in values.items()]
    df = spark.createDataFrame(rows, "dataset int, ts string, lev int, i int, j int, value double")
    valid = masks.validity(df)
    assert {r.lev: r.level_valid for r in masks.level_validity(valid).collect()} == {1: True, 2: False}
    got = {(r.lev, r.i, r.j): r.value for r in interp.fill_masked(df, interp.fill_map(valid)).collect()}
    # (2, 1) lies one cell from both (1, 1) and (2, 2); the lower linear index wins.
    assert got[1, 2, 1] == 1.0 and got[1, 1, 2] == 2.0 and got[1, 2, 2] == 4.0 and len(got) == 8
    assert all(got[2, i, j] == got[1, i, j] for i in (1, 2) for j in (1, 2))
    masks.require_valid_source(valid)
    with pytest.raises(ValidationError):
        masks.require_valid_source(valid.filter("lev = 2"))


@pytest.fixture(scope="module")
def plane(spark):
    """A field linear in x and y on a 5 x 4 grid of 100 m."""
    grid = spark.createDataFrame([(1, 0.0, 100.0, 5, 0.0, 100.0, 4)], "dataset int, x0 double, dx double, nx int, y0 double, dy double, ny int")
    rows = [(1, "v", "t", i + 1, j + 1, 1 + 2 * 100.0 * i + 3 * 100.0 * j) for i in range(5) for j in range(4)]
    return grid, spark.createDataFrame(rows, "dataset int, variable string, ts string, i int, j int, value double")


def test_bilinear_is_exact_both_ways(spark, plane):
    grid, values = plane
    points = [(50.0, 25.0), (150.0, 175.0), (250.0, 100.0), (375.0, 290.0), (400.0, 300.0), (0.0, 0.0)]
    nodes = spark.createDataFrame([(1, 1, n, 1, x, y) for n, (x, y) in enumerate(points)], "dataset int, grid_id int, i int, j int, x double, y double")
    gathered = interp.bilinear_gather(values, interp.locate_nodes(nodes, grid))
    got = {r.i: r.value for r in gathered.collect()}
    assert got == pytest.approx({n: 1 + 2 * x + 3 * y for n, (x, y) in enumerate(points)})
    weights = interp.bilinear_weights(nodes, grid).withColumnRenamed("i", "n").drop("j")
    weights = weights.withColumnsRenamed({"src_i": "i", "src_j": "j"})
    summed = interp.apply_weights(values, weights, ["dataset", "i", "j"], ["ts"], ["n"])
    assert {r.n: r.value for r in summed.collect()} == pytest.approx(got)
    checks.validate_target_coverage(nodes, grid)
    with pytest.raises(CoverageError):
        checks.validate_target_coverage(nodes.withColumn("x", F.col("x") + 200), grid)


def test_missing_corner_spreads_only_where_it_weighs(spark, plane):
    grid, values = plane
    holed = values.withColumn("value", F.when(~((F.col("i") == 2) & (F.col("j") == 1)), F.col("value")))
    nodes = spark.createDataFrame([(1, 1, 1, 1, 50.0, 0.0), (1, 1, 2, 1, 0.0, 0.0)], "dataset int, grid_id int, i int, j int, x double, y double")
    got = {r.i: r.value for r in interp.bilinear_gather(holed, interp.locate_nodes(nodes, grid)).collect()}
    assert got == {1: None, 2: 1.0}


def test_vertical_weights_clamp(spark):
    levels = spark.createDataFrame([(1, 1, -30.0), (1, 2, -5.0), (1, 3, -1.0), (1, 4, 0.0)], "dataset int, k int, z_center double")
    depths = spark.createDataFrame([(1, [0.0, 10.0, 20.0])], "dataset int, depths array<double>")
    got = {}
    for r in interp.vertical_weights(levels, depths).collect():
        got.setdefault(r.k, {})[r.lev] = r.weight
    assert got == {1: {3: 1.0}, 2: {1: 0.5, 2: 0.5}, 3: {1: pytest.approx(0.9), 2: pytest.approx(0.1)}, 4: {1: 1.0}}
    single = spark.createDataFrame([(1, [5.0])], "dataset int, depths array<double>")
    assert {(r.lev, r.weight) for r in interp.vertical_weights(levels, single).collect()} == {(1, 1.0)}


def _idw_brute(points, x, y, k=16, s2=0.04, radius=1.0):
    near = sorted(((x - a) ** 2 + (y - b) ** 2, a, b, h) for a, b, h in points if (x - a) ** 2 + (y - b) ** 2 <= radius**2)[:k]
    if not near:
        return 0.0
    w = [1 / (d + s2) for d, *_ in near]
    return sum(v * n[3] for v, n in zip(w, near)) / sum(w)


def test_apply_weights_by_sets(spark):
    """Targets that share their source cells or not, rows that come twice or are missing, nulls and weights of 0."""
    weights = [("a", 1, 1, 1, 0.25), ("a", 1, 1, 2, 0.75), ("a", 2, 1, 1, 0.5), ("a", 2, 1, 2, 0.5), ("a", 3, 1, 2, 1.0), ("a", 3, 1, 9, 0.0),
               ("b", 1, 2, 1, 0.5), ("b", 1, 1, 1, 0.5), ("b", 2, 1, 7, 1.0), (None, 1, 1, 1, 2.0), ("b", 3, None, 1, 1.0), ("b", 4, 1, 3, 1.0), ("b", 4, 1, 3, 1.0)]
    values = [(1, 1, "x", 4.0), (1, 2, "x", 8.0), (1, 1, "y", 1.0), (1, 2, "y", None), (2, 1, "x", 6.0), (1, 3, "x", 5.0), (1, 3, "x", 5.0), (1, 9, "x", None), (None, 1, "x", 9.0)]
    w = spark.createDataFrame(weights, "g string, t int, dataset int, i int, weight double")
    v = spark.createDataFrame(values, "dataset int, i int, ts string, value double")
    out = interp.apply_weights(v, w, ["dataset", "i"], ["ts"], ["g", "t"])
    assert out.columns == ["ts", "g", "t", "value"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("x", "a", 1, 7.0), ("y", "a", 1, None), ("x", "a", 2, 6.0), ("y", "a", 2, None), ("x", "a", 3, 8.0), ("y", "a", 3, None),
         ("x", "b", 1, 5.0), ("y", "b", 1, 0.5), ("x", "b", 4, 20.0), ("x", None, 1, 8.0), ("y", None, 1, 2.0)], key=str
    )


def test_apply_weights_shuffles_no_products(spark):
    """The targets' field, 40 times as many rows as targets, is not dealt out again."""
    w = spark.range(300).selectExpr("id AS g", "id % 3 AS t", "id % 4 AS i", "5e-1 AS weight")
    v = spark.range(160).selectExpr("id % 4 AS i", "id AS ts", "1e0 AS value")
    out = interp.apply_weights(v, w, ["i"], ["ts"], ["g", "t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Exchange ")]
    assert "Aggregate" not in top.split("Join")[0] and out.count() == 300 * 40


@pytest.mark.parametrize("case", ["spread", "hot", "coincident", "few", "far"])
def test_idw_against_brute_force(spark, domain, case):
    """Uneven soundings: a dense spot, copies of one sounding, too few, or all outside."""
    rng = random.Random(case)
    d = domain(9, 7, 10.0, 10.45, 59.0, 59.35)
    spread = [(rng.uniform(9.95, 10.5), rng.uniform(58.95, 59.4), -rng.uniform(1, 50)) for _ in range(60)]
    points = {
        "spread": spread,
        "hot": spread[:8] + [(10.11 + rng.uniform(0, 0.004), 59.07 + rng.uniform(0, 0.004), -rng.uniform(1, 50)) for _ in range(400)],
        "coincident": spread[:20] + [(10.2, 59.1, -7.0)] * 40 + [(10.2, 59.1, -9.0)] * 3,
        "few": spread[:5],
        "far": [(11.2, 59.2, -3.0), (13.0, 59.2, -9.0)],
    }[case]
    df = spark.createDataFrame([(1, *p) for p in points], "grid_id int, lon double, lat double, h double")
    out = soundings.idw_grid(df, d).collect()
    assert len(out) == 63
    for r in out:
        assert r.h == pytest.approx(_idw_brute(points, r.lon, r.lat), abs=1e-9), (r.i, r.j)


@pytest.mark.parametrize("case", ["spread", "hot", "few", "apart"])
def test_idw_over_tiles(spark, domain, case):
    """A domain of many tiles next to one of a single tile: all cells, each with its own nearest soundings."""
    rng = random.Random(case)
    d = domain(26, 18, 10.0, 11.3, 59.0, 59.9).unionByName(domain(3, 2, 10.0, 10.15, 59.0, 59.1, grid_id=2)).unionByName(domain(2, 2, grid_id=3))
    spread = [(rng.uniform(9.9, 11.4), rng.uniform(58.9, 60.0), -rng.uniform(1, 50)) for _ in range(500)]
    points = {
        "spread": spread,
        "hot": spread[:30] + [(10.11 + rng.uniform(0, 0.01), 59.07 + rng.uniform(0, 0.01), -rng.uniform(1, 50)) for _ in range(900)],
        "few": spread[:7],
        "apart": [(10.02, 59.03, -3.0), (11.29, 59.88, -9.0), (12.5, 59.0, -4.0)],
    }[case]
    rows = [(g, *p) for g in (1, 2, 9) for p in points] + [(None, 10.0, 59.0, -1.0), (1, None, 59.0, -1.0), (1, float("nan"), 59.0, -1.0)]
    df = spark.createDataFrame(rows, "grid_id int, lon double, lat double, h double")
    out = soundings.idw_grid(df, d, radius=0.6, tile=4).collect()
    assert sorted((r.grid_id, r.i, r.j) for r in out) == sorted((g, i, j) for g, nx, ny in ((1, 26, 18), (2, 3, 2), (3, 2, 2)) for i in range(1, nx + 1) for j in range(1, ny + 1))
    for r in out:
        expected = 0.0 if r.grid_id == 3 else _idw_brute(points, r.lon, r.lat, radius=0.6)
        assert r.h == pytest.approx(expected, abs=1e-9), (r.grid_id, r.i, r.j)


def test_idw_moves_soundings_once(spark, domain):
    """Soundings are dealt out in one shuffle; no pair of a cell and a sounding is."""
    df = spark.range(1000).selectExpr("CAST(1 AS INT) AS grid_id", "10 + id / 2000 AS lon", "59.5 AS lat", "-3e0 AS h")
    plan = soundings.idw_grid(df, domain(20, 15))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan and "Window" not in plan


def test_idw_parts_of_soundings(monkeypatch):
    """Soundings that pass a tile in parts leave the same nearest as all at once, equal distances by order."""
    rng = np.random.default_rng(3)
    lon, lat = np.sort(rng.integers(0, 12, 900) / 8), rng.integers(0, 12, 900) / 8
    lat = lat[np.lexsort((lat, lon))]
    h, given = -rng.random(900), rng.random(900) > 0.1
    grid = {"nx": 3, "ny": 2, "west": 0.25, "east": 1.0, "south": 0.25, "north": 0.75, "rows": 1}

    def heights(pairs):
        monkeypatch.setattr(soundings, "IDW_PAIRS", pairs)
        near = soundings._Nearest((1, 0, 0), grid, 32, 16, 0.5)
        near.add(lon, lat, h, given)
        return near.heights(2.0, 0.2, 1, 0.0).tolist()

    assert heights(1) == heights(10**6)


def test_contours_and_points(spark):
    part = [(20000.0 + 100 * n, 6610000.0 + 100 * n) for n in range(4)]
    lines = spark.createDataFrame([(42.0, [part, part[:1]]), (None, [part])], "depth double, geom array<array<struct<x double, y double>>>")
    got = sorted((r.x, r.h) for r in soundings.contour_vertices(lines, 2).collect())
    assert got == [(20000.0, -42.0), (20000.0, -42.0), (20200.0, -42.0), (20300.0, -42.0)]
    points = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 2.0, -12.5), (1.0, 2.0, None)], "lon double, lat double, depth double")
    assert sorted(r.h for r in soundings.depth_points(points).collect()) == [-12.5, -5.0]


def test_rasterize_moves_whole_numbers(spark, domain):
    """A crossing is shuffled as its feature, its row and a count of cells; spans that end on centres keep their side."""
    d = domain(8, 8, 0.0, 8.0, 0.0, 8.0)
    ring = [(1.5, 1.5), (6.5, 1.5), (6.5, 4.5), (1.5, 4.5)]
    far = [(-40.0, 5.2), (90.0, 5.2), (90.0, 6.8), (-40.0, 6.8)]
    df = spark.createDataFrame([(1, 1, [ring]), (1, 2, [far])], "grid_id int, id int, geom array<array<struct<x double, y double>>>")
    land = soundings.rasterize_land(soundings.polygon_edges(df), d)
    assert {(r.i, r.j) for r in land.collect()} == {(i, j) for i in range(2, 7) for j in range(2, 5)} | {(i, j) for i in range(1, 9) for j in (6, 7)}
    lines = land._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = next(n for n, line in enumerate(lines) if "Window [" in line) + 1
    assert re.search(r"Project \[grid_id#\w+, id#\w+, j#\w+, CASE WHEN .* AS _c#\w+\]$", lines[below]), lines[below]


def test_rasterize_even_odd(spark, domain):
    """A ring with a hole, a slanted triangle and a skerry on a 10 x 10 grid of 1 x 1."""
    d = domain(10, 10, 0.0, 10.0, 0.0, 10.0)
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    features = [(1, 1, [square(1.0, 7.0), square(3.0, 5.0)]), (1, 2, [[(7.2, 7.1), (9.9, 7.3), (8.4, 9.8)]])]
    df = spark.createDataFrame(features, "grid_id int, id int, geom array<array<struct<x double, y double>>>")
    skerry = spark.createDataFrame([(1, 0.5, 9.5), (1, 42.0, 1.0)], "grid_id int, x double, y double")
    got = {(r.i, r.j) for r in soundings.rasterize_land(soundings.polygon_edges(df), d, skerry).collect()}
    assert {(r.i, r.j) for r in soundings.rasterize_land(None, d, skerry).collect()} == {(1, 10)}
    expected = {(1, 10)}
    for _, _, rings in features:
        edges = [(r[n], r[(n + 1) % len(r)]) for r in rings for n in range(len(r))]
        for i in range(10):
            for j in range(10):
                x, y = i + 0.5, j + 0.5
                hits = sum((p[1] <= y) != (q[1] <= y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in edges)
                if hits % 2:
                    expected.add((i + 1, j + 1))
    assert got == expected


def test_packed_levels_stand_at_their_numbers(spark):
    rows = [(1, "T", 0, 1, 1, 1, 1.0), (1, "T", 0, 1, 1, 3, 3.0), (1, "T", 0, 2, 1, 2, None), (1, "T", 0, 2, 1, 1, 5.0)]
    values = spark.createDataFrame(rows, "dataset int, variable string, ts int, i int, j int, lev int, value double")
    got = {r.i: r.levels for r in interp.pack_columns(values).collect()}
    assert got == {1: [1.0, None, 3.0], 2: [5.0, None]}


def _located(spark, points):
    rows = [(1, 1, n, 1, i0, j0, wi, wj) for n, (i0, j0, wi, wj) in enumerate(points)]
    return spark.createDataFrame(rows, "dataset int, grid_id int, i int, j int, i0 int, j0 int, wi double, wj double")


@pytest.mark.parametrize("size", [2, 3, 128])
def test_gather_keeps_every_target_of_a_sparse_source(spark, size):
    rng = random.Random(size)
    field = {(t, i, j): float(t * 1000 + i * 10 + j) for t in (1, 2) for i in range(1, 10) for j in range(1, 8) if rng.random() < 0.7}
    values = spark.createDataFrame([(1, "v", t, i, j, v) for (t, i, j), v in field.items()], "dataset int, variable string, ts int, i int, j int, value double")
    points = [(i, j, rng.choice([0.0, 0.25, 1.0]), rng.choice([0.0, 0.5, 1.0])) for i in range(1, 9) for j in range(1, 7)]
    got = interp.bilinear_gather(values, _located(spark, points), size=size).collect()
    assert len(got) == 2 * len(points)
    for r in got:
        i0, j0, wi, wj = points[r.i]
        corners = [((i0 + a, j0 + b), (wi if a else 1 - wi) * (wj if b else 1 - wj)) for a in (0, 1) for b in (0, 1)]
        held = [(field.get((r.ts, *at)), w) for at, w in corners if w]
        expected = None if any(v is None for v, _ in held) else sum(v * w for v, w in held)
        assert r.value == (None if expected is None else pytest.approx(expected))


def test_slabs_without_any_row_are_expected_ones(spark, plane):
    _, values = plane
    slabs = spark.createDataFrame([(1, "v", "t"), (1, "v", "later")], "dataset int, variable string, ts string")
    got = interp.bilinear_gather(values, _located(spark, [(1, 1, 0.0, 0.0)]), slabs=slabs).collect()
    assert {(r.ts, r.value) for r in got} == {("t", 1.0), ("later", None)}
    none = interp.bilinear_gather(values.filter("i < 0"), _located(spark, [(1, 1, 0.0, 0.0)]), slabs=slabs)
    assert [r.value for r in none.collect()] == [None, None]


def test_layers_below_a_short_column_are_no_data(spark):
    rows = [(1, "v", "t", lev, i, j, 10.0 * lev) for lev in (1, 2, 3) for i in (1, 2) for j in (1, 2) if lev < 3 or i == 1]
    columns = interp.pack_columns(spark.createDataFrame(rows, "dataset int, variable string, ts string, lev int, i int, j int, value double"))
    layers = [(3, 1, 1, 0.0, -1.0, 0.0), (2, 2, 3, 0.5, -2.0, -1.0), (1, 3, 3, 0.0, -3.0, -2.0)]
    made = "array<struct<k: int, lo: int, hi: int, w: double, z_bottom: double, z_top: double>>"
    table = spark.createDataFrame([(1, layers)], f"grid_id int, layers {made}")
    nodes = _located(spark, [(1, 1, 0.0, 0.5), (1, 1, 0.5, 0.0)]).join(table, "grid_id")
    got = {(r.i, r.k): r.value for r in interp.trilinear_gather(columns, nodes).collect()}
    assert got == {(0, 3): 10.0, (0, 2): 25.0, (0, 1): 30.0, (1, 3): 10.0, (1, 2): None, (1, 1): None}


def test_gathers_are_dealt_by_tile(spark, plane):
    """No exchange by slab or domain alone: a wide one would land in one task."""
    _, values = plane
    gathered = interp.bilinear_gather(values, _located(spark, [(1, 1, 0.5, 0.5), (3, 2, 0.5, 0.5)]))
    plan = gathered._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert any("tile_i" in keys and "tile_j" in keys for keys in dealt)
    assert all("i0" in keys or "tile_i" in keys for keys in dealt), dealt


def test_domains_on_one_another_share_their_land(spark):
    rows = [(n, 10, 10, west, west + 10.0, 0.0, 10.0) for n, west in ((4, 0.0), (2, 0.0), (3, 5.0))]
    d = spark.createDataFrame(rows, "grid_id int, nx int, ny int, west double, east double, south double, north double")
    shared, members = soundings.shared_grids(d)
    assert sorted(r.grid_id for r in shared.collect()) == [2, 3]
    assert {(r.grid_id, r.shared_id) for r in members.collect()} == {(2, 2), (4, 2), (3, 3)}
    features = spark.createDataFrame([(1, "land", [[(4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (4.0, 8.0)]])], "id int, layer string, geom array<array<struct<x:double,y:double>>>")

    def land(domains):
        return soundings.rasterize_land(soundings.polygon_edges(soundings.read_land_features(features, domains, ["land"])), domains)

    once = members.join(land(shared).withColumnRenamed("grid_id", "shared_id"), "shared_id").select("grid_id", "i", "j")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in land(d).collect()} and once.count() > 0
