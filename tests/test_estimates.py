"""Digits, magnitudes, bases and bands on plain cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import estimates
from tidemark.queries.registry import QUERIES


def test_grouping_of_digits(spark):
    cases = {0.0: "0.00", 999.999: "1,000.00", 1000.0: "1,000.00", 99999.5: "99,999.50", 1234567.5: "12,34,567.50", -123456789.126: "-12,34,56,789.13", 12.0: "12.00", -0.001: "0.00"}
    got = spark.createDataFrame([(v,) for v in cases], "v double").coalesce(1).select(estimates.grouped_digits(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == list(cases.values())
    assert spark.range(1).select(estimates.grouped_digits(F.lit(1234567), 0).alias("s")).first().s == "12,34,567"


def test_magnitudes_of_texts(spark):
    cases = [("12-15%", "%", 13.5), ("about 1,250.5 crore", "INR", 1250.5), ("FY24", "INR", None), ("7", None, None), ("7", "", None), (None, "%", None), ("-3", "%", -3.0), ("10 to 20 to 90", "x", 15.0), ("(4) in Q3 fy'27", "x", 4.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "v string, u string").coalesce(1)
    assert [r.m for r in df.select(estimates.magnitude(F.col("v"), F.col("u")).alias("m")).collect()] == [c[2] for c in cases]


def test_one_basis_of_each(spark):
    rows = [("a", "C"), ("a", "S"), ("a", "N"), ("b", "C"), ("b", "S"), ("c", None), ("c", "C"), ("c", "S"), ("d", "N")]
    got = sorted((r.e, r.basis or "") for r in estimates.one_basis(spark.createDataFrame(rows, "e string, basis string"), "e", "basis", "C").collect())
    assert got == [("a", "N"), ("a", "S"), ("b", "C"), ("c", ""), ("c", "S"), ("d", "N")]


def test_estimates_use_only_what_was_known(spark):
    # growth of 10 % a year; the year-ago quarter of the last target comes too late
    rows = [("a", q, 100 * 1.1 ** (q / 4), q * 90) for q in range(20)] + [("b", q, 50.0, q * 90 if q != 12 else 9999) for q in range(17)]
    got = {(r.entity_id, r.qi): r for r in estimates.trend_walk(spark.createDataFrame(rows, "entity_id string, qi int, value double, known_at int")).collect()}
    assert set(got) == {("a", q) for q in range(8, 20)} | {("b", q) for q in range(8, 16)}
    assert got["a", 15].growths == 4 and got["a", 15].estimate == pytest.approx(100 * 1.1 ** (11 / 4) * 1.075)
    assert got["a", 8].growths == 1 and got["a", 8].estimate == pytest.approx(110.0)
    bands = {r.g: r for r in estimates.error_bands(spark.createDataFrame([("x", 0.1)] * 9 + [("y", 0.5)], "g string, error double"), "g").collect()}
    assert (bands["x"].pooled, bands["x"].band_pct, bands["y"].pooled) == (False, pytest.approx(10.0), True)


def test_sector_factors_makes_its_quarters_once(spark):
    # medians, edges and rows read the table of quarters, and none of them the lines again
    plan = QUERIES["sector_factors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "Window" not in plan.split("== Physical Plan ==")[1]
