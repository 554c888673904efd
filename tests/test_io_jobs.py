from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coastgrid import plans, sinks, sources, streaming
from coastgrid.errors import MissingRecordError, ValidationError
from coastgrid.functions.session import materialise, scratch_dir
from coastgrid.operators import checks, grid
from coastgrid.sinks import writers


@pytest.fixture(scope="module")
def field(spark):
    rows = [("T", f"2020-0{m}-01 12:00:00", k, j, i, float(100 * m + 10 * i + j)) for m in (1, 2) for k in (1, 2) for j in (1, 2, 3) for i in (1, 2)]
    df = spark.createDataFrame(rows, "variable string, ts string, k int, j int, i int, value double")
    return df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "grid_id": F.lit(1), "lambda": F.lit(0.0)})


def test_forcing_round_trip_and_resume(spark, field, tmp_path):
    path = str(tmp_path / "forcing")
    sinks.write_forcing(field, path)
    back = spark.read.parquet(path)
    assert back.count() == 24 and dict(back.dtypes)["value"] == "float"
    january = sources.read_records(spark, path, [2020], [1])
    assert january.count() == 12
    assert "PartitionFilters: [isnotnull(year" in january._jdf.queryExecution().toString() or "year" in january._jdf.queryExecution().toString()
    with pytest.raises(MissingRecordError):
        sources.read_records(spark, path, [1999])
    pending = sinks.pending_months(back, spark.createDataFrame([(2020,)], "year int"))
    assert {r.month for r in pending.collect()} == set(range(3, 13))


def test_staged_month_replaces_only_itself(spark, field, tmp_path):
    path = str(tmp_path / "staged")
    sinks.write_month_staged(field, path)
    sinks.write_month_staged(field.filter(F.month("ts") == 2).withColumn("value", F.lit(-1.0)), path)
    got = spark.read.parquet(path).groupBy("month").agg(F.min("value").alias("low"), F.count("*").alias("n")).collect()
    assert {r.month: (r.low, r.n) for r in got} == {1: (111.0, 12), 2: (-1.0, 12)}


def test_atmosphere_refuses_holes(spark, field, tmp_path):
    with pytest.raises(ValidationError, match="T at 2020-01-01 12:00:00"):
        sinks.write_atmosphere(field.withColumn("value", F.when(F.col("i") == 1, F.col("value"))), str(tmp_path / "a"))
    sinks.write_atmosphere(field, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 24


def test_river_copy_never_overwrites(field, tmp_path):
    with pytest.raises(ValidationError, match="overwrite"):
        sinks.write_river_copy(field, str(tmp_path / "x"), str(tmp_path / "x") + "/")


def test_slabs_round_trip(field):
    packed = sinks.pack_slabs(field, tile=2)
    assert packed.count() == 2 * 2 * 2
    back = sinks.unpack_slabs(packed)
    assert back.exceptAll(field.select(*back.columns)).isEmpty() and back.count() == 24


def test_outlet_files(spark, tmp_path):
    good = tmp_path / "rivers.csv"
    good.write_text("River number,Name,LatOutlet,LonOutlet,Zero\n5, Glomma ,59.2,10.95,0\n\n6,Drammenselva,59.74,10.25\n")
    rows = sources.read_outlets(spark, str(good)).orderBy("river_id").collect()
    assert [(r.river_id, r.name, r.lon, r.lat) for r in rows] == [(5, "Glomma", 10.95, 59.2), (6, "Drammenselva", 10.25, 59.74)]
    (tmp_path / "bad.csv").write_text("River number,Name,LatOutlet,LonOutlet,Zero\n5,Glomma,59.2\n")
    with pytest.raises(ValidationError, match="malformed"):
        sources.read_outlets(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("River number,Name,LatOutlet,LonOutlet,Zero\n")
    with pytest.raises(ValidationError, match="no rivers"):
        sources.read_outlets(spark, str(tmp_path / "empty.csv"))


def test_web_pages_are_rejected(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "page").write_text("<!DOCTYPE html>")
    (tmp_path / "p" / "data").write_text("River number,Name\n1,<b>")
    payloads = sources.read_payloads(spark, str(tmp_path / "p"))
    assert [r.body[:5] for r in checks.drop_web_pages(payloads).collect()] == ["River"]
    assert checks.rejected_pages(payloads).count() == 1
    odd = spark.createDataFrame([("",), (None,), (" <html>",)], "body string")
    assert checks.rejected_pages(odd).count() == 2


def test_state_reading(spark, domain):
    rows = [(1, v, "ccc", f"2020-01-0{d} 00:00:00", 1, 1, i, float("nan") if i == 1 else 10.0 * d) for v in ("T", "lam") for d in (1, 2) for i in (1, 2)]
    df = spark.createDataFrame(rows, "grid_id int, variable string, loc string, ts string, k int, j int, i int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d = domain(2, 1, z_faces=(-1.0, 0.0)).withColumn("nz", F.lit(1))
    assert {(r.variable, r.i): r.value for r in checks.read_state(df, d, ["T", "S"]).collect()} == {("T", 1): 0.0, ("T", 2): 20.0}
    at = F.lit("2020-01-01 00:00:00.5").cast("timestamp_ntz")
    assert checks.read_state(df, d, ["T"], at).agg(F.max("value")).first()[0] == 10.0
    with pytest.raises(MissingRecordError):
        checks.read_state(df, d, ["T"], F.lit("2020-01-01 00:00:02").cast("timestamp_ntz"))
    with pytest.raises(ValidationError, match="extents"):
        checks.read_state(df, d.withColumn("nx", F.lit(7)), ["T"])


def test_axis_and_geometry_checks(spark):
    axis = spark.createDataFrame([(1, n, 0.1 * n) for n in range(40)] + [(2, n, 1.0 * n * n) for n in range(3)] + [(3, 1, 1.0)], "a int, idx int, value double")
    for bucket in (4, 4096):
        got = {r.a: r.regular for r in checks.validate_axis(axis, ["a"], "idx", "value", bucket_size=bucket).collect()}
        assert got == {1: True, 2: False, 3: False}
    files = spark.createDataFrame([(1, f, "x", n, n * 1.0 + (f == "c") * 1e-9, "utm") for f in "abc" for n in range(3)], "dataset int, file string, axis string, idx int, value double, crs string")
    assert {r.file for r in checks.validate_same_geometry(files, strict=False).filter(~F.col("same")).collect()} == {"c"}
    with pytest.raises(ValidationError):
        checks.validate_same_geometry(files)


def test_read_field_rejects_other_grids(spark, domain, field):
    d = domain(2, 3).withColumn("nz", F.lit(2))
    tagged = field.withColumn("loc", F.lit("ccc"))
    assert sources.read_field(tagged, d, ["T"]).count() == 24
    with pytest.raises(ValidationError):
        sources.read_field(tagged, domain(9, 9).withColumn("nz", F.lit(2)), ["T"])
    assert sources.read_field(tagged, domain(9, 9).withColumn("nz", F.lit(2)), ["T"], strict=False).count() == 0


def test_dedupe_takes_the_first(spark):
    df = spark.createDataFrame([(1, "t", "b", 1, 5.0), (1, "t", "a", 2, 6.0), (1, "t", "a", 1, 7.0)], "series int, ts string, file string, idx int, value double")
    assert sources.dedupe_records(df).first().value == 7.0


def test_regrid_forcing_is_exact_on_linear_fields(spark, cells, domain):
    """lon, lat and depth enter linearly; a masked corner is filled; land gives NULL and rate 0."""
    d = domain(4, 3, 10.0, 10.4, 59.0, 59.3, z_faces=(-20.0, -10.0, 0.0))
    b = cells([[-20.0] * 3, [-20.0] * 3, [0.0] * 3, [-20.0] * 3])
    depths = [0.0, 10.0, 30.0]
    rows = [
        (1, "temp", "2020-01-01 12:00:00", lev + 1, i + 1, j + 1, 2 * (9.9 + 0.1 * i) + 3 * (58.9 + 0.1 * j) + dep)
        for lev, dep in enumerate(depths) for i in range(8) for j in range(7)
    ]
    values = spark.createDataFrame(rows, "dataset int, variable string, ts string, lev int, i int, j int, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    later = values.withColumns({"ts": F.col("ts") + F.make_dt_interval(days=F.lit(2)), "value": F.col("value") + 1})
    g = spark.createDataFrame([(1, 9.9, 0.1, 8, 58.9, 0.1, 7, depths)], "dataset int, x0 double, dx double, nx int, y0 double, dy double, ny int, depths array<double>")
    source = plans.TableForcingSource(values.unionByName(later), g, {"temp": "T"})
    assert isinstance(source, plans.ForcingSource)
    out = plans.regrid_forcing(source, b, d, plans.ForcingConfig(edge="south", relaxation_cells=2)).collect()
    assert len(out) == 4 * 3 * 2 * 3
    for r in out:
        if r.i == 3:
            assert r.value is None and r["lambda"] == 0
            continue
        day = (r.ts.day - 1) / 2
        expected = 2 * (10.0 + 0.1 * (r.i - 0.5)) + 3 * (59.0 + 0.1 * (r.j - 0.5)) + (15.0 if r.k == 1 else 5.0) + day
        assert r.value == pytest.approx(expected, abs=1e-9)
        assert r["lambda"] == pytest.approx({1: 1, 2: 0.5, 3: 0}[r.j] / 86400)


def test_adapters_are_protocols(spark):
    empty = spark.createDataFrame([], "x int")
    assert isinstance(plans.TableBathymetrySource(empty), plans.BathymetrySource)
    assert isinstance(plans.TableRiverSource(empty, empty), plans.RiverSource)
    assert isinstance(plans.TableAtmosphereSource(empty, empty, {}), plans.AtmosphereSource)
    with pytest.raises(ValidationError):
        plans.ForcingConfig(edge="up")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, f"2020-01-01 {run:02d}:00:00", lead, 3600.0 * lead * (c + run)) for c in (1, 2) for run in (0, 6) for lead in range(3, 10)]
    runs = spark.createDataFrame(rows, "cell int, run_ts string, lead_h int, acc double").withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))
    source = str(tmp_path / "in")
    runs.repartition("run_ts").write.parquet(source)
    query = streaming.stream_deaccumulated_months(spark, source, runs.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 24 and {r.flux for r in got.collect()} == {1.0, 2.0, 7.0, 8.0}


def test_materialised_tables_live_in_the_named_folder(spark):
    df = materialise(spark.range(5))
    assert df.count() == 5 and scratch_dir(spark) in df.inputFiles()[0]


def test_native_spine_is_lazy(domain):
    """Operators build plans; none of these may start a job."""
    d = domain(3, 3)
    before = d.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)
    grid.grid_spine(grid.expand_domain(d, 2), "ccc")
    assert d.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None) == before


@pytest.mark.parametrize(
    "source, path", [("/a/b", "/a/./b/"), ("/a/b", "file:///a/b"), ("/a/b", "/a/b/c"), ("/a/b/c", "/a/b"), ("s3://x/a", "s3://x//a"), ("b", "./b")]
)
def test_river_copy_keeps_off_its_source(spark, source, path):
    with pytest.raises(ValidationError):
        sinks.write_river_copy(spark.range(0), source, path)


def test_a_day_of_many_domains_is_several_tasks(spark):
    rows = spark.range(64).selectExpr("id AS grid_id", "'T' AS variable", "timestamp_ntz'2020-01-01 12:00:00' AS ts", "1 AS k", "1 AS j", "1 AS i")
    spread = writers._by_month(rows, ("grid_id",)).select(F.spark_partition_id().alias("p"))
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "grid_id" in plan and "RepartitionByExpression" in plan


def _months(path, spark):
    return {(r.year, r.month): r.n for r in sinks.read_published(spark, path).groupBy("year", "month").agg(F.count("*").alias("n")).collect()}


@pytest.fixture
def two_months(spark):
    rows = [("a", f"2020-{m:02}-{d:02} 12:00:00", 1, 1, i, float(m * 100 + i)) for m in (1, 2) for d in (1, 2) for i in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "variable string, ts string, k int, j int, i int, value double")
    return frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_readers_see_named_versions_only(spark, two_months, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.unnamed_versions(spark, path) == []
    with pytest.raises(MissingRecordError):
        sinks.read_published(spark, path)
    lines = sinks.publish_months(two_months.filter(F.month("ts") == 1), path).collect()
    assert [(r.variable, r.year, r.month, r.row_count, r.seq) for r in lines] == [("a", 2020, 1, 6, 1)]
    # A writer that was lost before its marker, and one that replaces a month.
    half = two_months.withColumns({"year": F.year("ts"), "month": F.month("ts")}).filter("i < 3")
    half.write.partitionBy("variable", "year", "month").parquet(f"{path}/data/version=vhalf")
    assert _months(path, spark) == {(2020, 1): 6}
    pending = sinks.pending_published(spark, path, spark.createDataFrame([(2020,)], "year int"), ["a"])
    assert {r.month for r in pending.collect()} == set(range(2, 13))
    sinks.publish_months(two_months.withColumn("value", F.lit(-1.0)), path)
    assert sinks.read_published(spark, path).agg(F.max("value")).first()[0] == -1.0
    assert sinks.check_published(spark, path).collect() == []
    gone = sinks.drop_unnamed(spark, path)
    assert "vhalf" in gone and len(gone) == 2 and _months(path, spark) == {(2020, 1): 6, (2020, 2): 6}
    with pytest.raises(ValidationError, match="already published: a 2020-01"):
        sinks.publish_months(two_months, path, replace=False)
    assert sinks.unnamed_versions(spark, path) == []
    assert sinks.publish_months(two_months.filter("i > 9"), path).collect() == [] and sinks.unnamed_versions(spark, path) == []


def test_lost_files_are_found(spark, two_months, tmp_path):
    path = str(tmp_path / "table")
    version = sinks.publish_months(two_months, path).first()["version"]
    writers.remove_folder(spark, f"{path}/data/version={version}/variable=a/year=2020/month=2")
    assert [(r.month, r.row_count, r.found) for r in sinks.check_published(spark, path).collect()] == [(2, 6, 0)]


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_refused_rows_leave_nothing_behind(spark, two_months, tmp_path, odd):
    path, seen = str(tmp_path / "table"), spark.sparkContext.accumulator(0)
    bad = two_months.withColumn("value", F.when((F.col("i") == 2) & (F.month("ts") == 2), F.lit(odd)).otherwise(F.col("value")))
    with pytest.raises(ValidationError, match="2 of 12 rows are refused"):
        sinks.publish_months(bad, path, refuse=sinks.not_finite())
    assert sinks.unnamed_versions(spark, path) == []
    plain = str(tmp_path / "plain")
    sinks.write_atmosphere(two_months, plain)
    with pytest.raises(ValidationError):
        sinks.write_atmosphere(bad, plain)
    assert spark.read.parquet(plain).count() == 12 and [p.name for p in tmp_path.iterdir() if "staged" in p.name] == []

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    sinks.write_atmosphere(two_months.mapInArrow(count, two_months.schema), plain)
    assert seen.value == 12  # the input is computed once


def test_a_month_job_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    rows = [(1, f"2020-0{m}-02 00:00:00", lead, i, 1, float(lead * i), 1.0, 0.0) for m in (1, 2, 3) for lead in range(3, 10) for i in (1, 2)]
    runs = spark.createDataFrame(rows, "dataset int, run_ts string, lead_h int, i int, j int, acc double, ux double, vy double")
    runs = runs.withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))
    angles = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 1, 0.0)], "dataset int, i int, j int, angle double")
    path, years = str(tmp_path / "table"), spark.createDataFrame([(2020,)], "year int")
    options = ({"rain": "acc"}, {}, ("ux", "vy"), path, years)
    publish, calls = plans.jobs.sinks.publish_months, []

    def lost(*args, **more):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return publish(*args, **more)

    monkeypatch.setattr(plans.jobs.sinks, "publish_months", lost)
    with pytest.raises(RuntimeError):
        plans.publish_pending_months(runs, angles, *options)
    assert _months(path, spark) == {(2020, 1): 36}
    monkeypatch.setattr(plans.jobs.sinks, "publish_months", publish)
    assert plans.publish_pending_months(runs, angles, *options, months_at_once=12) == [(2020, 2), (2020, 3)]
    assert _months(path, spark) == {(2020, m): 36 for m in (1, 2, 3)}
    rain = sinks.read_published(spark, path).filter("variable = 'rain' AND i = 2").select("value").distinct().collect()
    assert [r.value for r in rain] == [2 / 3600]


def test_state_is_found_in_one_pass(spark, monkeypatch):
    """Extents and times come from one summary, so the table is read once for them and once for the record."""
    stamp = F.lit("2020-01-01 12:00:00").cast("timestamp_ntz")
    results = spark.range(1, 3).select(
        F.lit(1).alias("grid_id"), F.lit("T").alias("variable"), F.lit("ccc").alias("loc"), stamp.alias("ts"),
        F.lit(1).alias("k"), F.lit(1).alias("j"), F.col("id").cast("int").alias("i"), F.lit(10.0).alias("value"),
    )
    d = spark.createDataFrame([(1, 2, 1, 1)], "grid_id int, nx int, ny int, nz int")
    reads = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            reads.add(batch.num_rows)
            yield batch

    out = checks.read_state(results.mapInArrow(counted, results.schema), d, ["T"], stamp).collect()
    assert [r.value for r in out] == [10.0, 10.0] and reads.value == 2 * 2


def test_regridding_query_reads_written_inputs(spark, monkeypatch):
    """The job reads its source and bathymetry many times: from the scratch folder, not from what they are made of."""
    from driver_queries import interp as queries

    source = spark.range(4).selectExpr("CAST(1 AS INT) AS dataset", "CAST('2020-01-01' AS timestamp_ntz) AS ts", "1 AS lev", "CAST(id AS INT) AS i", "1 AS j", "1e0 AS value")
    cells = spark.range(3).selectExpr("CAST(1 AS INT) AS grid_id", "CAST(id AS INT) AS i", "-1e0 AS h")
    for name, df in (("source_values", source), ("bathymetry", cells), ("domains", cells)):
        monkeypatch.setattr(queries.fx, name, lambda *a, df=df: df)
    asked = []

    def regrid(source, bathymetry, domains, config, windows):
        asked.extend([source.values(), bathymetry])
        return spark.createDataFrame([(1, "T", "ccc", 1, 1, 1, 1, 1.0, 0.0)], "grid_id int, variable string, loc string, ts int, k int, j int, i int, value double, lambda double")

    monkeypatch.setattr(queries, "regrid_forcing", regrid)
    queries._regridded(spark, "nowhere", None)
    assert [df.count() for df in asked] == [8, 3]
    assert all(df.inputFiles() and all("/coastgrid/" in f for f in df.inputFiles()) for df in asked)
