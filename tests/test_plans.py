"""Queries whose plans avoid one task a group, on ties and beyond their bounds, and rates against a loop."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational, search
from tidemark.operators.quantiles import average_ranks
from tidemark.operators.stats import winsor_z
from tidemark.queries.registry import QUERIES
from tidemark.queries.texts import trades

SF = "/root/testdata/sf0.001"


def test_nearest_peers_with_many_equal_balances(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "s", rng.randrange(2), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, 7.0, float(k)])) for k in range(150)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = set()
    for k, _, n, b in rows:
        near = sorted((abs(b - c), j) for j, _, m, c in rows if m == n and j != k)[:10]
        want |= {(k, j, p + 1) for p, (_, j) in enumerate(near)}
    assert {tuple(r) for r in QUERIES["nearest_peers"](spark, str(tmp_path)).collect()} == want


def test_ranks_share_ties(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.choice([None, 1.0, 2.0, rng.random() * 5])) for k in range(400)]
    got = {r["id"]: r["rank"] for r in average_ranks(spark.createDataFrame(rows, "id long, g string, v double"), ["g"], "v", "rank", 8).collect()}
    for k, g, v in rows:
        others = [w for _, h, w in rows if h == g and w is not None]
        assert got[k] == (None if v is None else sum(w < v for w in others) + (sum(w == v for w in others) + 1) / 2)


def test_table_difference_sees_nulls_and_marks(spark):
    a = spark.createDataFrame([(1, "\0", 1), (2, None, 1), (3, "x", 1), (4, "y", None)], "k long, s string, v int")
    b = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "x", 2), (5, "z", 1)], "k long, s string, v int")
    assert {tuple(r) for r in relational.table_diff(a, b, ["k"]).collect()} == {(1, "changed"), (3, "changed"), (4, "removed"), (5, "added")}


def test_more_query_vectors_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    v = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)], "vec_id long, v array<double>")
    q = v.where("vec_id < 25").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    once = {tuple(r) for r in search.cosine_top_k(v, q, 3).collect()}
    monkeypatch.setattr(search, "BROADCAST_VECTORS", 7)
    assert {tuple(r) for r in search.cosine_top_k(v, q, 3).collect()} == once and len(once) == 75


def test_nearest_vectors_by_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTORS_BLOCK", 30)
    monkeypatch.setattr(search, "QUERY_ROWS", 3)
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    vectors += [vectors[3]] * 20 + [[2 * x for x in vectors[4]], [0.0] * 5, [0.0] * 5, None, [1.0, None, 0.0, 0.0, 1.0], [1.0, 2.0], [1e-160] * 5, [1e-200] * 5, [1e200] * 5, [float("nan")] * 5]
    rng.shuffle(vectors)
    rows = spark.createDataFrame(list(enumerate(vectors)) + [(None, [1.0] * 5)], "vec_id long, v array<double>")

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        below = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
        return dot(a, b) / below if below else None

    def order(found):
        c = found[1]
        return (2, 0, found[0]) if c is None else (0, 0, found[0]) if c != c else (1, -c, found[0])

    got = {}
    for r in search.cosine_top_k(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], repr(r["cosine"])))
    assert got.keys() == set(range(len(vectors)))
    for q, a in enumerate(vectors):
        want = sorted([(k, cosine(b, a)) for k, b in enumerate(vectors) if k != q], key=order)[:7]
        assert got[q] == [(k, repr(c)) for k, c in want]
    # a task's nearest of a block, so that no pair of rows is ever a row of Spark
    v, q = pa.table({"vec_id": [1, 2], "v": [[1.0, 0.0], [1.0, 1.0]]}), pa.table({"query_id": [2], "q": [[1.0, 1.0]]})
    assert search._nearest(1)(q, v).to_pylist() == [{"query_id": 2, "vec_id": 1, "cosine": 1 / 2**0.5}]
    assert search._nearest(1)(q.slice(1), v).num_rows == 0


def test_rates_of_return_against_a_loop(spark):
    flows = {}
    for r in trades(spark, SF).collect():
        flows.setdefault(r["entity_id"], []).append((r["date"], (1.0 if r["side"] == "S" else -0.4) * r["quantity"] * r["price"]))
    got = {r["entity_id"]: r["xirr"] for r in QUERIES["flow_xirr"](spark, SF).collect()}
    assert got.keys() == flows.keys()
    for k, f in flows.items():
        first = min(d for d, _ in f)

        def npv(rate, f=f, first=first):
            return sum(v / (1 + rate) ** ((d - first) / dt.timedelta(days=365)) for d, v in f)

        lo, hi = -0.99, 10.0
        if npv(lo) * npv(hi) >= 0:
            assert got[k] is None
            continue
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (npv(mid) > 0) == (npv(lo) > 0) else (lo, mid)
        assert got[k] == pytest.approx((lo + hi) / 2, abs=1e-6)


def test_winsorised_scores_are_the_same_in_any_order(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("ab"), 1000 + rng.gauss(0, 1)) for k in range(3000)] + [(-1, "a", None), (-2, "c", 1.0), (-3, "c", 1.0), (-4, "d", 5.0)]
    scores = []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "id long, g string, v double").repartition(parts)
        scores.append({r["id"]: r["z"] for r in winsor_z(df, ["g"], "v", 0.05).collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == len(rows)
    assert all(scores[0][k] is None for k in range(-4, 0))
    for g in "ab":
        v = np.array([x for _, h, x in rows if h == g and x is not None])
        held = np.clip(v, *np.quantile(v, [0.05, 0.95]))
        want = dict(zip([k for k, h, x in rows if h == g and x is not None], (held - held.mean()) / held.std(ddof=1), strict=True))
        assert all(scores[0][k] == pytest.approx(z, abs=1e-9) for k, z in want.items())
