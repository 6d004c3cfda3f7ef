"""Block products, residuals and draws against numpy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import matrix

T = 70


def dense(rows, keys):
    m = np.zeros((T, len(keys)))
    for k, t, v in rows:
        m[t, keys.index(k)] += v
    return m


def made(n, seed, share):
    rng = random.Random(seed)
    return [(k, t, rng.gauss(0, 1)) for k in range(n) for t in range(T) if rng.random() < share]


@pytest.mark.parametrize(("tall", "wide", "factors"), [(16, 5, []), (256, 512, []), (7, 3, [1]), (32, 4, [0, 2])])
def test_correlations_equal_numpy(spark, tall, wide, factors):
    left, right = made(17, 1, 0.4) + [(90, 3, 5.0), (91, T - 1, 1.0), (91, 0, 1.0)], made(4, 2, 0.9)
    names, others = sorted({r[0] for r in left}), [str(k) for k in range(4)]
    a, d = dense(left, names), dense([(str(k), t, v) for k, t, v in right], others)
    if factors:
        f = d[:, factors]
        f = (f - f.mean(0)) / f.std(0)
        a = a - f @ np.linalg.solve(f.T @ f + 1e-3 * np.eye(len(factors)), f.T @ a)
    df = spark.createDataFrame(left, "key long, t int, value double")
    dr = spark.createDataFrame([(str(k), t, v) for k, t, v in right], "key string, t int, value double")
    got = {(r["key"], r["other"], r["lag"]): (r["n"], r["r"]) for r in matrix.lagged_correlations(df, dr, 4, T, [str(k) for k in factors], tall=tall, wide=wide).collect()}
    assert len(got) == len(names) * 4 * 4
    for i, key in enumerate(names):
        for j, other in enumerate(others):
            for lag in range(4):
                n, r = got[key, other, lag]
                x, y = a[lag:, i], d[: T - lag, j]
                if x.std() < 1e-9:
                    assert r is None
                else:
                    assert n == T - lag and r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_null_and_draws_do_not_depend_on_partitions(spark):
    left, right = made(9, 3, 0.5), made(3, 4, 0.9)
    a, d = dense(left, list(range(9))), dense(right, list(range(3)))
    want = [max(abs(np.corrcoef(a[:, i], np.roll(d, 1 + number(5, k) % (T - 1), 0)[:, j])[0, 1]) for i in range(9) for j in range(3)) for k in range(6)]
    for parts in (1, 7):
        df = spark.createDataFrame(left, "key long, t int, value double").repartition(parts)
        dr = spark.createDataFrame([(str(k), t, v) for k, t, v in right], "key string, t int, value double").repartition(parts)
        got = sorted(tuple(r) for r in matrix.shift_null(df, dr, T, 6, 5).collect())
        assert [g[1] for g in got] == pytest.approx(want, abs=1e-9)


def test_bootstrap_and_permutation_equal_loops(spark):
    rows = [(k, t, float((k + 1) * t % 11)) for k in range(3) for t in range(T)]
    got = {(r["draw"], r["key"]): r["mean"] for r in matrix.block_bootstrap(spark.createDataFrame(rows, "key long, t int, value double"), T, 8, 4, 2).collect()}
    for draw in range(4):
        taken = [(number(2, draw, b) % T + k) % T for b in range(-(-T // 8)) for k in range(min(8, T - 8 * b))]
        assert len(taken) == T
        for k in range(3):
            assert got[draw, k] == pytest.approx(sum((k + 1) * t % 11 for t in taken) / T)
    marked = [(i, i % 3 == 0, float(i * 7 % 13 + (3 if i % 3 == 0 else 0))) for i in range(200)]
    df = spark.createDataFrame(marked, "id long, marked boolean, value double")
    d = lambda rows: np.mean([v for m, v in rows if m]) - np.mean([v for m, v in rows if not m])
    share, observed = sum(m for _, m, _ in marked) / 200, d([(m, v) for _, m, v in marked])
    drawn = [d([(number(1, k, i) < share * 2**32, v) for i, _, v in marked]) for k in range(50)]
    row = matrix.permutation_p(df, "marked", "value", 50, 1).first()
    assert row["observed"] == pytest.approx(observed) and row["n_draws"] == 50
    assert row["p"] == pytest.approx((1 + sum(abs(x) >= abs(observed) for x in drawn)) / 51)
    assert matrix.permutation_p(df.where(F.col("marked")), "marked", "value", 5, 1).count() == 0


def test_a_dealt_left_is_shuffled_once_and_pairs_are_not(spark, capsys):
    lines = spark.createDataFrame([(k, t, v) for k, t, v in made(40, 6, 0.5) for _ in range(2)], "key long, t int, value double")
    right = spark.createDataFrame([(str(k), t, v) for k, t, v in made(3, 7, 0.9)], "key string, t int, value double").localCheckpoint()
    left = matrix.standardised(matrix.dealt(lines, "key", 8).groupBy("sb", "key", "t").agg(F.sum("value").alias("value")), "key", "value")
    r = matrix.lagged_correlations(left, right, 4, T)
    got = {tuple(row)[:3]: row["r"] for row in r.collect()}
    plain = matrix.lagged_correlations(left.drop("sb"), right, 4, T, tall=16, wide=8)
    assert got == pytest.approx({tuple(row)[:3]: row["r"] for row in plain.collect()}, abs=1e-9) and len(got) == 40 * 3 * 4
    r.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[1]
    # one exchange for all of left; right's two are of its few rows, for its tails and its blocks
    assert plan.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") <= 4


def test_labels_are_dealt_by_comparing_digits(spark, capsys):
    df = spark.createDataFrame([(i, i % 5 > 0, float(i % 9)) for i in range(50)], "id long, marked boolean, value double")
    rows = [(i, float(i % 9)) for i in range(50)]
    drawn = [[(number(2, k, i) < 0.8 * 2**32, v) for i, v in rows] for k in range(20)]
    d = [np.mean([v for m, v in x if m]) - np.mean([v for m, v in x if not m]) for x in drawn]
    p = matrix.permutation_p(df, "marked", "value", 20, 2)
    row = p.first()
    assert row["n_draws"] == 20 and row["p"] == pytest.approx((1 + sum(abs(x) >= abs(row["observed"]) - 1e-12 for x in d)) / 21)
    p.explain()
    assert "conv(" not in capsys.readouterr().out
