from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coastgrid.errors import MissingRecordError, ValidationError
from coastgrid.operators import masks, relax, rivers


@pytest.fixture(scope="module")
def channel(cells, domain):
    h = [[0.0, 0.0], [-13.0, -13.0], [-20.0, -20.0], [-20.0, -20.0]]
    return cells(h), domain(4, 2, 10.0, 10.4, 59.0, 59.2)


def _wet(df):
    return {(r.i, r.j, r.k): r.wet for r in df.collect()}


def test_tracer_mask(channel):
    m = masks.water_mask(*channel)
    wet = _wet(m)
    assert len(wet) == 16 and not wet[1, 1, 1] and not wet[1, 1, 2] and wet[2, 1, 1] and wet[3, 1, 1] and wet[4, 1, 1]
    thick = {(r.i, r.k): r.thickness for r in m.filter("j = 1").collect()}
    assert thick[2, 1] == 3.0 and thick[3, 1] == 10.0 and thick[1, 2] == 0.0


def test_sliver_rule(cells, domain):
    """A bottom 1 m below the layer top keeps a floor of a fifth, or is dropped."""
    b, d = cells([[-11.0]]), domain(1, 1)
    floor = {r.k: (r.wet, r.thickness) for r in masks.water_mask(b, d).collect()}
    assert floor[1] == (True, 2.0) and floor[2] == (True, 10.0)
    assert _wet(masks.water_mask(b, d, mode="drop"))[1, 1, 1] is False


def test_face_masks(channel):
    tracer = _wet(masks.water_mask(*channel))
    u = _wet(masks.water_mask(*channel, loc="fcc", edge="south"))
    assert len(u) == 20 and not u[2, 1, 1] and u[3, 1, 1] and not u[1, 1, 1] and not u[5, 1, 1]
    south = _wet(masks.water_mask(*channel, loc="cfc", edge="south"))
    assert all(south[i, 1, k] == tracer[i, 1, k] and not south[i, 3, k] for i in range(1, 5) for k in (1, 2))
    north = _wet(masks.water_mask(*channel, loc="cfc", edge="north"))
    assert all(north[i, 3, k] == tracer[i, 2, k] and not north[i, 1, k] for i in range(1, 5) for k in (1, 2))
    west = _wet(masks.water_mask(*channel, loc="fcc", edge="west"))
    assert all(west[1, 1, k] == tracer[1, 1, k] for k in (1, 2))
    with pytest.raises(ValidationError):
        masks.water_mask(*channel, edge="up")


def test_open_edge_on_masks(channel):
    tracer, closed = masks.water_mask(*channel), masks.water_mask(*channel, loc="fcc")
    for edge in ("west", "east"):
        assert _wet(masks.open_edge(closed, tracer, "fcc", edge)) == _wet(masks.water_mask(*channel, loc="fcc", edge=edge))
    assert _wet(masks.open_edge(closed, tracer, "fcc", "south")) == _wet(closed)


def _mask(spark, wet):
    nx, ny = len(wet), len(wet[0])
    rows = [(1, nx, ny, i + 1, j + 1, wet[i][j]) for i in range(nx) for j in range(ny)]
    return spark.createDataFrame(rows, "grid_id int, nx int, ny int, i int, j int, wet boolean")


def test_coastal_cells(spark):
    wet = [[False] * 5] + [[True] * 5 for _ in range(4)]
    assert {(r.i, r.j) for r in masks.coastal_cells(_mask(spark, wet)).collect()} == {(2, j) for j in range(1, 6)}


def _snap(spark, domain, wet, i, j, radius):
    """Snap an outlet lying on node (i, j) of a 0.1 degree grid."""
    nx, ny = len(wet), len(wet[0])
    d = domain(nx + 2, ny + 2, 0.0, 0.1 * (nx + 2), 0.0, 0.1 * (ny + 2))
    # A border of water keeps the node strictly inside; it is far from any land.
    coast = masks.coastal_cells(_mask(spark, wet)).select("grid_id", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"))
    outlet = spark.createDataFrame([(1, 7, 1, 0.1 * (i + 0.5), 0.1 * (j + 0.5))], "grid_id int, river_id int, position int, lon double, lat double")
    r = rivers.snap_outlets(outlet, d, coast, radius).first()
    return None if r.i is None else (r.i - 1, r.j - 1, r.distance)


def test_snapping_rules(spark, domain):
    wet = [[False] * 5] + [[True] * 5 for _ in range(4)]
    assert _snap(spark, domain, wet, 2, 3, 10) == (2, 3, 0.0)
    assert _snap(spark, domain, wet, 4, 3, 10) == (2, 3, 2.0)
    assert _snap(spark, domain, wet, 5, 3, 1) is None
    tie = [[True] * 5 for _ in range(5)]
    tie[2][0] = tie[2][4] = False
    assert _snap(spark, domain, tie, 3, 3, 10) == (3, 2, 1.0)


def test_outlets_outside_and_on_the_edge(spark, domain, cells):
    d = domain(5, 4, 10.0, 10.5, 59.0, 59.4)
    wet = [[i != 1] * 4 for i in range(5)]
    coast = masks.coastal_cells(_mask(spark, wet))
    lons = [10.0 + 0.1 * (i + 0.5) for i in range(5)]
    lat = 59.0 + 0.1 * 1.5
    rows = [(1, 1, 1, lons[1], lat), (1, 2, 2, lons[3], lat), (1, 3, 3, 20.0, lat), (1, 4, 4, 10.0 + 0.5 * ((10.5 - 10.0) / 5), lat)]
    outlets = spark.createDataFrame(rows, "grid_id int, river_id int, position int, lon double, lat double")
    got = {r.river_id: (r.i, r.j, r.distance, r.reason) for r in rivers.snap_outlets(outlets, d, coast).collect()}
    assert got[1] == (1, 2, 1.0, None) and got[2] == (3, 2, 1.0, None)
    assert got[3][3] == "outside" and got[4][3] == "outside"
    none = {r.river_id: r.reason for r in rivers.snap_outlets(outlets, d, coast, radius=0).collect()}
    assert none[1] == "no coast"


def test_relaxation_band(spark):
    rows = [(1, i, j, 1, True, 3, 4) for i in range(1, 4) for j in range(1, 5)]
    wet = spark.createDataFrame(rows, "grid_id int, i int, j int, k int, wet boolean, ni int, nj int")

    def band(edge, c):
        out = relax.relaxation_lambda(wet, edge, 2, 86400.0)
        return {r[c] for r in out.filter(F.col("lambda") != 0).collect()}

    assert band("south", "j") == {1, 2} and band("north", "j") == {3, 4}
    assert band("west", "i") == {1, 2} and band("east", "i") == {2, 3}
    south = {r.j: r["lambda"] for r in relax.relaxation_lambda(wet, "south", 2, 86400.0).collect()}
    assert south == {1: 1 / 86400, 2: pytest.approx(0.5 / 86400), 3: 0.0, 4: 0.0}
    dry = relax.relaxation_lambda(wet.withColumn("wet", F.lit(False)), "south", 2, 86400.0)
    assert dry.filter(F.col("lambda") != 0).isEmpty()
    assert relax.relaxation_lambda(wet, "south", 0, 1.0).filter(F.col("lambda") != 0).isEmpty()
    for bad in (("up", 2, 1.0), ("south", -1, 1.0), ("south", 2, 0.0)):
        with pytest.raises(ValidationError):
            relax.relaxation_lambda(wet, *bad)


def test_upsert_touches_only_its_cells(spark):
    rows = [(1, v, f"2020-01-0{d} 12:00:00", k, j, i, 2, float(i + j + k), 0.0) for v in "TSu" for d in (1, 2) for k in (1, 2) for j in (1, 2) for i in (1, 2)]
    forcing = spark.createDataFrame(rows, "grid_id int, variable string, ts string, k int, j int, i int, nz int, value double, lambda double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cells_ = spark.createDataFrame([(1, 5, 1, 1, 2), (1, 6, 2, 1, 2)], "grid_id int, river_id int, position int, i int, j int")
    series = spark.createDataFrame(
        [(r, v, f"2020-01-0{d} 12:00:00", 100.0 * r + d) for r in (5, 6) for v in "TN" for d in (1, 2)],
        "river_id int, variable string, ts string, value double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = rivers.upsert_rivers(forcing, cells_, series, 3600.0)
    changed = out.exceptAll(forcing).collect()
    # The later outlet wins; N is not in the forcing; S and u keep their values.
    assert {(r.variable, r.k, r.i, r.j, r.value) for r in changed} == {("T", 2, 1, 2, 601.0), ("T", 2, 1, 2, 602.0)}
    assert all(r["lambda"] == 1 / 3600 for r in changed) and out.count() == forcing.count()
    assert [r.variable for r in rivers.missing_river_variables(forcing, series).collect()] == ["N"]
    with pytest.raises(MissingRecordError):
        rivers.upsert_rivers(forcing, cells_, series.filter("variable = 'N'"), 3600.0)
    assert rivers.collision_report(cells_).first().winner == 6


def test_series_matching_errors(spark):
    times = spark.createDataFrame([("2020-01-01 00:00:00",), ("2020-01-03 00:00:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    series = spark.createDataFrame([(1, "T", "2020-01-01 12:00:00", 1.0)], "river_id int, variable string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(MissingRecordError, match="2020-01-03"):
        rivers.match_series_by_date(times, series)
    assert rivers.match_series_by_date(times, series, strict=False).count() == 1
    with pytest.raises(MissingRecordError, match="river 2"):
        rivers.match_outlets(spark.createDataFrame([(2,)], "river_id int"), series)


def test_forcing_tendency_rows_that_repeat(spark):
    """Each forcing row meets each of its states and geometries; keys that are null or on one side only meet nothing."""
    key = "grid_id int, variable string, ts int, i int, j int, k int"
    state = spark.createDataFrame([(1, "T", 1, 1, 1, 1, 3.0), (1, "T", 1, 1, 1, 1, 5.0), (1, "T", 2, 1, 1, 1, 9.0), (1, "u", 1, 1, 1, 1, 2.0), (1, "T", 1, 2, 1, 1, 1.0), (1, None, 1, 1, 1, 1, 1.0)], f"{key}, field double")
    forcing = spark.createDataFrame([(1, "T", 1, 1, 1, 1, 1.0, 0.5), (1, "u", 1, 1, 1, 1, 4.0, 2.0), (1, "T", 3, 1, 1, 1, 1.0, 0.5), (1, "T", 1, 2, 1, 1, 1.0, 0.5), (1, None, 1, 1, 1, 1, 1.0, 0.5)], f"{key}, value double, lambda double")
    geometry = spark.createDataFrame([(1, 1, 1, 1, 10.0, 5.0, 100.0), (1, 1, 1, 1, 20.0, 5.0, 100.0), (1, 1, 1, 2, 10.0, 5.0, 100.0)], "grid_id int, i int, j int, k int, area_x double, area_y double, volume double")
    out = relax.forcing_tendency(state, forcing, geometry)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan  # each table is dealt out once
    assert out.columns == ["grid_id", "variable", "ts", "i", "j", "k", "tendency"]
    assert sorted((r.variable, r.ts, r.i, r.tendency) for r in out.collect()) == [("T", 1, 1, -2.0), ("T", 1, 1, -2.0), ("T", 1, 1, -1.0), ("T", 1, 1, -1.0), ("u", 1, 1, 0.4), ("u", 1, 1, 0.8)]


def test_tendency_regimes(spark):
    lam = [2.0, -2.0, 0.5, 1.0, -1.0, 0.5]
    value = [10.0, 10.0, 10.0, 10.0, 10.0, None]
    rows = [(1, n, 1, 1, "T", "t", v, la) for n, (la, v) in enumerate(zip(lam, value))]
    forcing = spark.createDataFrame(rows, "grid_id int, i int, j int, k int, variable string, ts string, value double, lambda double")
    state = forcing.select("grid_id", "variable", "ts", "i", "j", "k", F.lit(4.0).alias("field"))
    geometry = forcing.select("grid_id", "i", "j", "k", F.lit(6.0).alias("area_x"), F.lit(3.0).alias("area_y"), F.lit(2.0).alias("volume"))
    out = {r.i: r.tendency for r in relax.forcing_tendency(state, forcing, geometry).collect()}
    assert out == {0: 30.0, 1: 15.0, 2: 3.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_times_of_a_forcing_are_computed_once(spark):
    """Times come out of a whole forcing table, which the check and the result both need."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(ts):
        seen.add(1)
        return ts

    forcing = spark.createDataFrame([("1995-01-01 00:00:00",)] * 6, "ts string").withColumn("ts", counted("ts").cast("timestamp_ntz"))
    series = spark.createDataFrame([(1, "T", "1995-01-01 12:00:00", 2.0)], "river_id int, variable string, ts string, value double")
    matched = rivers.match_series_by_date(forcing, series.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()
    assert len(matched) == 1 and seen.value == 6
