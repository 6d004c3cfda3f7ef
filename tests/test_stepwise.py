"""Walks from folded sums against loops over the panel."""

import numpy as np
import pytest

from tidemark.operators import stepwise
from tidemark.queries.registry import QUERIES
from tidemark.queries.stepwise import FACTORS, factor_rows

SF = "/root/testdata/sf0.001"


def corr(a, b):
    return np.corrcoef(a, b)[0, 1] if len(a) > 1 and a.std() > 1e-9 and b.std() > 1e-9 else float("nan")


def composite(frames, signs):
    got = []
    for f in frames:
        total = np.zeros(len(f))
        for name, sign in signs.items():
            v = f[name].to_numpy(float)
            if v.std() > 1e-9:
                total = total + sign * (v - v.mean()) / v.std()
        got.append(corr(total, f["fwd"].to_numpy(float)))
    got = [g for g in got if np.isfinite(g)]
    return float(np.mean(got)) if got else float("nan")


def loop(panel, window, least, pooled):
    import pandas as pd

    out = {}
    for grp, g in panel.dropna().groupby("grp"):
        frames = [(q, f) for q, f in g.groupby("quarter") if len(f) >= 20]
        for t in range(len(frames)):
            train = [f for _, f in frames[(0 if window is None else max(0, t - window)) : t]]
            if len(train) < least:
                continue
            views = [pd.concat(train)] if pooled else train
            alone = {}
            for f in FACTORS:
                values = [v for v in (corr(x[f].to_numpy(float), x["fwd"].to_numpy(float)) for x in views) if np.isfinite(v)]
                if len(values) >= (1 if pooled else least):
                    alone[f] = float(np.mean(values))
            good = {f: v for f, v in alone.items() if abs(v) >= 0.02}
            pool = good if len(good) >= 3 else alone
            signs, best = {}, 0.0
            while len(signs) < 6:
                tried = {f: composite(views, {**signs, f: 1 if v > 0 else -1}) for f, v in pool.items() if f not in signs}
                f = max(tried, key=lambda f: tried[f] if np.isfinite(tried[f]) else -9, default=None)
                if f is None or not tried[f] > best + 0.005:
                    break
                signs[f], best = 1 if pool[f] > 0 else -1, tried[f]
            if signs:
                out[grp, frames[t][0]] = (len(train), ";".join(f"{f}:{s:+d}" for f, s in signs.items()), best, composite([frames[t][1]], signs))
    return out


@pytest.mark.parametrize(("name", "window", "pooled"), [("stepwise_walk", 8, False), ("stepwise_pooled", None, True)])
def test_walks_equal_a_loop(spark, name, window, pooled):
    want = loop(factor_rows(spark, SF).toPandas(), window, 4, pooled)
    got = {(r["grp"], r["period"]): r for r in QUERIES[name](spark, SF).collect()}
    assert got.keys() == want.keys() and got
    for k, (n, chosen, train, test) in want.items():
        r = got[k]
        assert (r["n_train"], r["chosen"]) == (n, chosen)
        assert (r["train_score"], r["test_score"]) == (pytest.approx(train, abs=2e-6), pytest.approx(test, abs=2e-6))


def test_flat_and_few(spark):
    rows = [("g", p, float(k), 1.0, float(k)) for p in range(5) for k in range(20)]
    folded = stepwise.fold(spark.createDataFrame(rows, "grp string, period int, a double, b double, y double"), "grp", "period", ["a", "b"], "y", 20)
    got = stepwise.walk_forward(folded, ["a", "b"], None, 2).collect()
    assert [(r["period"], r["chosen"], r["test_score"]) for r in got] == [(p, "a:+1", pytest.approx(1.0)) for p in (2, 3, 4)]
    assert stepwise.combined(stepwise.walk_forward(folded, ["a", "b"], None, 2)).count() == 2
    assert stepwise.walk_forward(folded, ["a", "b"], None, 9).count() == 0
