"""The stages of the pipeline one after another, each against what it must do to its own input."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == after.count() > 0.5 * before
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op7_url_filter"])
def test_same_as_sql(spark, name):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    for t in ("pages", "labels"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    want = duckdb.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    order = want.columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))
