from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from coastgrid.errors import MissingRecordError, ValidationError
from coastgrid.functions.crs import LambertConformalSphere, PolarStereographic, TransverseMercator
from coastgrid.operators import grid


def test_uniform_axis(domain):
    axis = grid.uniform_axis(domain(5, 5, west=10.2, east=11.02), "west", "east", 0.1, 0.02).first().axis
    assert axis[0] == pytest.approx(10.1) and axis[-1] > 11.12 - 1e-9 and len(axis) == 52
    with pytest.raises(ValidationError):
        grid.uniform_axis(domain(1, 1), "west", "east", 0.1, 0.0)
    with pytest.raises(ValidationError):
        grid.uniform_axis(domain(1, 1), "west", "east", -0.1, 0.1)


def test_spine_and_faces(domain):
    d = domain(4, 2)
    assert grid.grid_spine(d).count() == 8
    u = grid.grid_spine(d, "fcc").orderBy("k", "j", "i").collect()
    assert len(u) == 5 * 2 * 2 and u[0].lon == 10.0 and u[4].lon == 11.0 and u[0].z == -15.0
    assert grid.grid_spine(d, "cfc").count() == 4 * 3 * 2
    centres = grid.center_axis(d, "west", "east", "nx").select("grid_id", F.posexplode("axis").alias("idx", "x"))
    faces = [r.face for r in grid.faces_from_centers(centres, ["grid_id"], "idx", "x").orderBy("idx").collect()]
    assert faces == pytest.approx([10.0, 10.25, 10.5, 10.75, 11.0])


def test_native_region(domain):
    r = grid.native_region(domain(10, 40), factor=2, padding_cells=1).first()
    assert (r.nx, r.ny) == (24, 84) and r.west == pytest.approx(9.9) and r.north == pytest.approx(60.025)
    for bad in ({"factor": 0}, {"padding_cells": -1}, {"stride": 0}):
        with pytest.raises(ValidationError):
            grid.native_region(domain(10, 10), **bad)


@pytest.mark.parametrize(
    "crs",
    [
        TransverseMercator.utm(33),
        PolarStereographic(70.0, 60.0, x0=3192800.0, y0=1784000.0),
        PolarStereographic(70.0, 90.0),
        LambertConformalSphere(-42.0, 66.3, 66.3, 66.3),
        LambertConformalSphere(15.0, 63.0, 58.0, 68.0),
    ],
)
def test_projection_round_trip(spark, crs):
    points = [(x, y) for x in (5.0, 10.4, 15.0, 29.9) for y in (55.1, 59.9, 71.2)]
    df = spark.createDataFrame(points, "lon double, lat double")
    back = grid.unproject(grid.project(df, crs), crs, lon="lon2", lat="lat2").collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in back)


def test_projection_known_points(spark):
    df = spark.createDataFrame([(15.0, 60.0), (15.0, 0.0)], "lon double, lat double")
    out = grid.project(df, TransverseMercator.utm(33)).orderBy("y").collect()
    # The meridian arc to 60 degrees is 6 654 072.819 m.
    assert out[0].x == pytest.approx(500000) and abs(out[0].y) < 1e-6
    assert out[1].x == pytest.approx(500000) and out[1].y == pytest.approx(0.9996 * 6654072.819, abs=2e-3)
    polar = PolarStereographic(0.0, 90.0)
    r = grid.project(spark.createDataFrame([(0.0, 90.0), (90.0, 80.0)], "lon double, lat double"), polar).collect()
    assert abs(r[0].x) < 1e-6 and r[1].x > 1.1e6 and abs(r[1].y) < 1e-6
    tangent = LambertConformalSphere(-42.0, 66.3, 66.3, 66.3)
    origin = grid.project(spark.createDataFrame([(-42.0, 66.3)], "lon double, lat double"), tangent).first()
    assert abs(origin.x) < 1e-6 and abs(origin.y) < 1e-6


def test_bbox_holds_the_corners(domain):
    r = grid.bbox_in_crs(domain(3, 3), TransverseMercator.utm(33)).first()
    assert r.x_min < r.x_max and r.y_min < r.y_max and r.y_max - r.y_min == pytest.approx(111e3, rel=0.1)


def test_rotation(spark):
    east = [(1, i, j, 10 + 0.1 * i, 59 + 0.5 * j) for i in range(3) for j in range(2)]
    df = spark.createDataFrame(east, "dataset int, i int, j int, lon double, lat double")
    assert all(abs(r.angle) < 1e-12 for r in grid.grid_rotation_angle(df).collect())
    north = [(1, i, j, 10 + 0.5 * j, 59 + 0.1 * i) for i in range(3) for j in range(2)]
    df = spark.createDataFrame(north, "dataset int, i int, j int, lon double, lat double")
    assert all(r.angle == pytest.approx(math.pi / 2) for r in grid.grid_rotation_angle(df).collect())
    uv = spark.createDataFrame([(0.3, 1.0, -1.5), (-1.2, -2.0, 2.5), (math.pi / 2, 3.0, 4.0)], "angle double, u double, v double")
    turned = grid.rotate_vectors(uv)
    back = grid.rotate_vectors(turned.withColumn("minus", -F.col("angle")), "minus", "east", "north", "u2", "v2").collect()
    assert all(abs(r.u - r.u2) < 1e-12 and abs(r.v - r.v2) < 1e-12 for r in back)
    assert back[2].east == pytest.approx(-4) and back[2].north == pytest.approx(3)


def test_rename_and_units(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "variable string, value double")
    assert {r.variable for r in grid.rename_variables(df, {"a": "T", "b": "S"}, ["a", "c"]).collect()} == {"T"}
    with pytest.raises(MissingRecordError, match="known variables"):
        grid.rename_variables(df, {"a": "T"}, ["z"])
    units = grid.attach_units(spark.createDataFrame([("swrad",), ("odd",)], "variable string")).collect()
    assert {r.variable: r.units for r in units} == {"swrad": "W m-2", "odd": None}
