"""The registered text queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from coastgrid.functions.session import materialise
from coastgrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_exact_duplicates_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = "doc_id, keep_id, group_size, kept, text_sha256"
    want = con.execute(f"SELECT {columns} FROM ({queries.oracle_sql()['op4_exact_dedup']})").fetchall()
    got = queries.queries()["op4_exact_dedup"](spark, SF).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == columns
        now = [r[0] for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and now
        if name == "personal_data":
            assert set(now) == ids and docs.filter("text LIKE '%<email>%'").count() > 0
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, None, None, "s", 3), (2, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_near_stage_links_from_four_fifths_on(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows, want = [], set()
    # A changed word costs five of n shingles: n = 50 gives 45 / 55 = 0.818, n = 40 gives 35 / 45 = 0.778.
    for n in range(40):
        for at, shingles in ((0, 50), (1000, 40)):
            words = [f"w{n}x{at}y{k}" for k in range(shingles + 4)]
            other = [*words[:20], "changed", *words[21:]]
            rows += [(at + 2 * n, " ".join(words), "en", "s", 1), (at + 2 * n + 1, " ".join(other), "en", "s", 1)]
            want |= {at + 2 * n} if at == 0 else {at + 2 * n, at + 2 * n + 1}
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert {r["doc_id"] for r in got} == want


def test_line_stage_drops_a_line_with_another_year(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(n, f"own words {n}\nAll rights reserved, {year} edition", "en", "s", 1) for n, year in enumerate((2019, 2023))]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {0: rows[0][1], 1: "own words 1"}
