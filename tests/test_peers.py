"""Exact quantiles and peers against numpy."""

import random

import numpy as np
import pytest

from tidemark.operators import peers
from tidemark.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_of_large_and_small_groups(spark, by):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(30_000)] + [("b", float(rng.randint(0, 3))) for _ in range(20_000)] + [("c", 5.0), ("c", 6.0)] + [("d", None)] + [(None, float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.01, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, by, "v", qs, small=1000).collect()
    groups = {None: [v for _, v in rows if v is not None]} if not by else {g: [v for h, v in rows if h == g and v is not None] for g in "abc"}
    held = {(r["g"] if by else None): r["q"] for r in got}
    for g, values in groups.items():
        assert held[g] == pytest.approx(np.quantile(values, qs).tolist(), abs=1e-12)


FAMILIES = {"one": ("a", "b"), "two": ("c",), "three": ("d", "e", "f")}
NAMES = [f for fs in FAMILIES.values() for f in fs]


def brute(z, top, least):
    out, base = {}, {}
    family = [k for k, fs in enumerate(FAMILIES.values()) for _ in fs]
    for i, a in z.items():
        found = []
        for j, b in z.items():
            both = [k for k in range(6) if a[k] is not None and b[k] is not None]
            if i == j or len(both) < 3 or len({family[k] for k in both}) < 2 or sum(v is not None for v in a) < least:
                continue
            num = sum(a[k] * b[k] for k in both)
            found.append((-round(num / max(sum(a[k] ** 2 for k in both) * sum(b[k] ** 2 for k in both), 1e-12) ** 0.5, 9), j))
        if found:
            base[i] = (len(found), -sum(f[0] for f in found) / len(found))
        out |= {(i, j): (p + 1, -s) for p, (s, j) in enumerate(sorted(found)[:top])}
    return out, base


@pytest.mark.parametrize("rows", [1000, 16])
def test_neighbours_with_missing_features_and_ties(spark, rows):
    rng = random.Random(6)
    raw = [(k, *[rng.choice([None, rng.gauss(0, 3)]) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in NAMES]) for k in range(70)]
    raw += [(100 + k, *raw[0][1:]) for k in range(12)] + [(200, *[None] * 6), (201, float("nan"), float("inf"), *[1.0] * 4)]
    df = spark.createDataFrame(raw, "id long, " + ", ".join(f"{f} double" for f in NAMES))
    table = np.array([[np.nan if v is None or not np.isfinite(v) else v for v in r[1:]] for r in raw])
    med = np.nanmedian(table, 0)
    scale = 1.4826 * np.nanmedian(abs(table - med), 0)
    weights = np.repeat([len(fs) ** -0.5 for fs in FAMILIES.values()], [len(fs) for fs in FAMILIES.values()])
    z = np.clip((table - med) / scale, -3, 3) * weights
    want_z = {r[0]: [None if np.isnan(v) else v for v in row] for r, row in zip(raw, z, strict=True)}
    zs = peers.robust_z(df, "id", FAMILIES).persist()
    for r in zs.collect():
        assert [r[f] for f in NAMES] == pytest.approx(want_z[r["id"]])
    want, base = brute(want_z, 7, 4)
    found, baselines = peers.neighbours(zs, "id", FAMILIES, 7, 4, 0.5, 2, rows=rows)
    got = {(r["id"], r["peer"]): (r["place"], r["similarity"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-9)
    assert {r["id"]: (r["n"], pytest.approx(r["baseline"], abs=1e-8)) for r in baselines.collect()} == base
    flat = peers.robust_z(spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 1.0), (3, 2.0, 5.0)], "id long, a double, b double"), "id", {"x": ("a", "b")})
    assert [r["a"] for r in flat.collect()] == [0.0, 0.0, 0.0]


def test_quantiles_by_a_column_of_any_name(spark):
    rng = random.Random(4)
    rows = [(g, rng.gauss(0, 1)) for g in "xy" for _ in range(3000)]
    want = {g: np.quantile([v for h, v in rows if h == g], [0.1, 0.5]).tolist() for g in "xy"}
    for by in ("f", "a", "b", "at", "lo", "hi"):
        got = exact_quantiles(spark.createDataFrame(rows, f"{by} string, v double"), [by], "v", [0.1, 0.5], small=1000)
        assert {r[by]: r["q"] for r in got.collect()} == {g: pytest.approx(q, abs=1e-12) for g, q in want.items()}


def test_mean_similarities_without_all_pairs(spark):
    rng = random.Random(8)
    z = {k: [None if rng.random() < 0.3 else rng.gauss(0, 1) for _ in NAMES] for k in range(60)}
    z |= {100 + k: [0.0] * 6 for k in range(3)} | {110: [None] * 6, 111: [1e-7] * 6, 112: [2e-7, -1e-7, 1e-7, 0.0, None, 1e-7], 113: [4e-4] * 6, 114: [5e-4, None, 3e-4, 1e-4, 0.0, 0.0]}
    _, base = brute(z, 1, 4)
    df = spark.createDataFrame([(k, *row) for k, row in z.items()], "id long, " + ", ".join(f"{f} double" for f in NAMES))
    plan = peers.mean_similarities(df, "id", FAMILIES, 4, 0.5, 2)
    assert {r["id"]: (r["n"], pytest.approx(r["baseline"], abs=1e-8)) for r in plan.collect()} == base


def _shuffled(spark) -> int:
    """Rows that all stages until now have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_neighbours_shuffle_no_bests_of_pairs_of_blocks(spark):
    rng = random.Random(9)
    z = [(k, *[rng.gauss(0, 1) for _ in NAMES]) for k in range(2000)]
    df = spark.createDataFrame(z, "id long, " + ", ".join(f"{f} double" for f in NAMES)).persist()
    df.count()
    before = _shuffled(spark)
    # partitions as there are with many rows
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert len(peers.neighbours(df, "id", FAMILIES, 7, 4, 0.5, 2, rows=32)[0].collect()) == 2000 * 7
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    # a few times the rows, and no bests of each of 63 blocks
    assert _shuffled(spark) - before < 20 * 2000


@pytest.mark.parametrize("tile", [(4, 8), (1024, 512)])
def test_bests_of_equal_zero_and_short_rows(monkeypatch, tile):
    monkeypatch.setattr(peers, "TILE", tile)
    rng = random.Random(10)
    z = [[None if rng.random() < 0.2 else rng.gauss(0, 1) for _ in NAMES] for _ in range(120)] + [[float(rng.randint(-1, 1)) if rng.random() < 0.8 else None for _ in NAMES] for _ in range(150)]
    z += [[0.0] * 6] * 3 + [[1e-7] * 6, [2e-7, -1e-7, 1e-7, 0.0, None, 1e-7], [4e-4] * 6, [5e-4, None, 3e-4, 1e-4, 0.0, 0.0]] + [[1.0, 2.0, None, 1.0, 0.5, 1.0]] * 20
    rng.shuffle(z)
    want, _ = brute(dict(enumerate(z)), 7, 0)
    cells = np.array([[np.nan if v is None else v for v in row] for row in z])
    family = [k for k, fs in enumerate(FAMILIES.values()) for _ in fs]

    def counts(both):
        said = int(both.sum()), len({f for f, b in zip(family, both, strict=True) if b})
        return said if said[0] >= 3 and said[1] >= 2 else None

    bests = peers._Bests(cells, 8, counts, -1.0)
    ids = np.arange(len(z))
    for begin in range(0, len(z), 70):
        bests.meet(ids[begin : begin + 70], cells[begin : begin + 70])
    got = {}
    for i, peer, similarity in zip(peers._kinds(cells)[0].tolist(), bests.peer.tolist(), bests.similarity.tolist(), strict=True):
        others = [(j, s) for j, s in zip(peer, similarity, strict=True) if j != i and s > -2][:7]
        got |= {(i, j): (p + 1, s) for p, (j, s) in enumerate(others)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-9)


def test_nearest_by_more_features_than_a_long_has_bits(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(30, 70))
    names = [f"f{i}" for i in range(70)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(v.tolist())], "id long, " + ", ".join(f"{f} double" for f in names))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosine = unit @ unit.T - 9 * np.eye(30)
    got = {(r["id"], r["place"]): r["peer"] for r in peers.nearest(df, "id", {"all": names}, 3, 1, 0.0, 1).collect()}
    assert got == {(k, p + 1): j for k in range(30) for p, j in enumerate(np.argsort(-cosine[k])[:3].tolist())}
