"""Driver queries against their SQL twins on the smallest tables, and the shape of their plans."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest

from driver_queries import fixtures, oracle_sql, queries
from driver_queries.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")

CHEAP = (
    "S2_dedupe_records", "S5_depth_points", "S8_read_bathymetry", "K6_pending_months", "G8_project_utm", "G9_bbox_in_crs",
    "F1_subset_box", "F6_coastal_cells", "B1_idw_grid", "B2_rasterize_land", "B7_smooth_gaps", "B8_keep_major_basins",
    "B10_slope_invariants", "wet_volume_by_layer", "T1_complete_daily", "T7_blend_steps", "T9_interpolate_cyclical",
    "T14_deaccumulate", "I4_nearest_valid_map", "I6_regrid_forcing", "I7_regrid_atmosphere", "R2_snap_outlets",
    "M2_validate_axis", "M10_drop_web_pages",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    clean = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({oracle_sql()[name]})")
    assert _rows(df.select(*columns).collect()) == _rows(cursor.fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["B1_idw_grid", "B2_rasterize_land", "S5_depth_points", "S7_read_land_features", "R2_snap_outlets", "T9_interpolate_cyclical", "I5_fill_masked", "F3_water_mask"])
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("table", ["spine", "source_values"])
def test_exploded_rows_are_not_taken_for_few(spark, table):
    """Estimated below their true size, they would be broadcast through the driver."""
    rows = getattr(fixtures, table)(spark, SF)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= rows.count() * 8 * len(rows.columns)


def test_river_series_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(queries()["S4_read_river_series"](spark, SF))


@pytest.mark.parametrize(("name", "key"), [("R2_snap_outlets", "_bi"), ("I5_fill_map", "src_lev")])
def test_unpacked_rows_are_not_broadcast(spark, name, key):
    """Nodes in each bucket they reach, and cells out of the rows of a level."""
    df = queries()[name](spark, SF)
    df.collect()  # adaptive plans turn to broadcasts while they run
    joins = re.findall(r"(\w+Join) ([^\n]*)", _plan(df))
    kinds = {kind for kind, rest in joins if f"{key}#" in rest}
    assert kinds == {"SortMergeJoin"}


def test_hours_of_months_are_not_held_one_by_one(spark):
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*\bts#", _plan(queries()["T12_month_hours"](spark, SF)))


def test_one_exchange_serves_both_stencil_axes(spark, cells):
    from coastgrid.functions.tiles import with_neighbours

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(with_neighbours(cells([[1, 2], [3, 4]]), ["grid_id"], "h", diagonal=True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_a_query_needs(spark):
    plan = _plan(queries()["G1_grid_spine"](spark, SF))
    assert "ReadSchema: struct<s_suppkey:bigint>" in plan


def test_every_query_has_a_twin():
    assert set(queries()) == set(oracle_sql())


def test_forcing_groups_the_order_lines_once(spark):
    """Its bathymetry is written: neither variable, nor a pass of a query over it, reads the order lines again."""
    assert "l_orderkey" not in _plan(fixtures.forcing(spark, SF))


def test_days_out_of_gaps_are_not_broadcast(spark):
    """Nor blended one by one: a pair of records is grouped once for all days between."""
    df = queries()["T7_blend_steps"](spark, SF)
    df.collect()
    plan = _plan(df)
    joins = re.findall(r"(\w+Join) \[series#\d+, (?:src_ts|lower_ts)", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
    assert not re.search(r"Aggregate\(keys?=\[series#\d+, (?:step_)?ts#\d+\]", plan.split("== Initial Plan ==")[0])


def test_runs_are_shuffled_by_the_run_once(spark):
    """Their leads are unpacked after the last exchange, and no join takes them for few."""
    plan = _plan(queries()["T14_deaccumulate"](spark, SF))
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning\(cell#\d+, run_ts", plan)) == 1


def test_months_read_the_written_runs(spark, monkeypatch):
    """Not the events again for every group of months."""
    from driver_queries import interp

    seen = []
    publish = interp.publish_pending_months
    monkeypatch.setattr(interp, "publish_pending_months", lambda runs, *rest, **options: (seen.append(_plan(runs)), publish(runs, *rest, **options)))
    queries()["T14_publish_pending_months"](spark, SF)
    assert len(seen) == 2 and not any("events" in plan for plan in seen)
