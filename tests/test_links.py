"""Trees, beams, components and set similarity against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, similarity
from tidemark.queries import links
from tidemark.queries.registry import QUERIES


def brute_components(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 400)] + [(500, 500)] + [(rng.randint(600, 680), rng.randint(600, 680)) for _ in range(50)] + [(7, 300)] * 3
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == brute_components([e for e in edges if e[0] != e[1]])
    assert graph.components(df.where("false")).count() == 0


def test_tree_equals_a_walk(spark):
    rng = random.Random(2)
    nodes = [(k, None if k < 4 else rng.randrange(k), rng.uniform(-5, 5), rng.random(), float(rng.randint(0, 5)), rng.choice([None, rng.random()])) for k in range(200)]
    got = {r["node"]: r for r in graph.tree(spark.createDataFrame(nodes, "node long, parent long, magnitude double, probability double, lag double, elasticity double"), 5, 2.0).collect()}
    seen = {}
    for k, parent, magnitude, p, lag, e in nodes:
        if parent is None:
            root, level, chance, delay = k, 1, p, lag
        elif parent in seen:
            root, level, chance, delay = seen[parent][0], seen[parent][1] + 1, seen[parent][2] * p, seen[parent][3] + lag
        else:
            continue
        if level <= 5:
            seen[k] = (root, level, chance, delay)
            r = got[k]
            assert (r["root"], r["level"]) == (root, level) and r["chance"] == pytest.approx(chance) and r["delay"] == delay
            assert r["effect"] == pytest.approx(magnitude * chance * (1 if e is None else e))
    assert got.keys() == seen.keys()


def test_beam_keeps_the_best(spark):
    rng = random.Random(3)
    edges = [(f"n{a:02}", f"n{b:02}", rng.random()) for a in range(30) for b in rng.sample(range(30), 6)]
    starts = ["n00", "n05", "n29"]
    want = []
    for s in starts:
        front = {s: 1.0}
        for hop in (1, 2, 3):
            step = {}
            for a, b, w in edges:
                if a in front:
                    step[b] = step.get(b, 0) + front[a] * w
            best = sorted(step.items(), key=lambda x: (-x[1], x[0]))[:4]
            front = dict(best)
            want += [(s, hop, n, pytest.approx(v), p + 1) for p, (n, v) in enumerate(best)]
    got = graph.beam(spark.createDataFrame(edges, "source string, target string, strength double"), spark.createDataFrame([(s,) for s in starts], "node string"), 3, 4)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1], r[4])) == want


@pytest.mark.parametrize(("overlap", "jaccard"), [(2, 0.0), (1, 0.6), (3, 0.5)])
def test_similar_sets_equal_all_pairs(spark, overlap, jaccard):
    rng = random.Random(5)
    # "all" is in every set, and a group of alike ones is larger than a tile
    sets = [(k, rng.choice("xy"), ["all", *rng.sample("abcdefghijklmno", rng.randint(0, 6))]) for k in range(120)] + [(200 + k, "x", ["all", "p", "q", "r"]) for k in range(25)]
    sets += [(400, "x", []), (401, "x", None), (402, None, ["all", "p"]), (403, "y", ["a", "a", None, "b", "all"])]
    df = spark.createDataFrame(sets, "id long, grp string, members array<string>")
    clean = {i: (g, {m for m in s if m}) for i, g, s in sets if s is not None and g is not None}
    want = set()
    for a, (g, s) in clean.items():
        for b, (h, t) in clean.items():
            n = len(s & t)
            if a < b and g == h and n >= overlap and n >= jaccard * len(s | t) - 1e-9:
                want.add((a, b, n))
    got = similarity.similar_sets(df, overlap, jaccard, tile=10)
    assert {tuple(r) for r in got.collect()} == want
    links = similarity.similar_sets(df, overlap, jaccard, forest=True, tile=10)
    assert {tuple(r) for r in links.collect()} <= want and links.count() <= len(want)
    assert brute_components([tuple(r)[:2] for r in links.collect()]) == brute_components([w[:2] for w in want])


def test_a_pair_of_sets_comes_out_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COLUMNS", 3)
    # every two sets meet under several members and in tiles; none may be given twice, as nothing takes doubles out any more
    df = spark.createDataFrame([(k, "x", [f"m{j}" for j in range(6)] + [f"own{k}"]) for k in range(40)], "id long, grp string, members array<string>")
    got = similarity.similar_sets(df, 2, tile=7)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 40 * 39 // 2 and {r[2] for r in rows} == {6}
    assert "HashAggregate(keys=[a#" not in got._jdf.queryExecution().toString()


def test_a_beam_walks_each_hop_once(spark):
    # what is left to run reads the hops' tables, not the lines again for every hop
    plan = QUERIES["beam_walk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "Join" not in plan


def test_places_of_nodes_are_in_the_order_of_their_names(spark):
    keys = [0, 1, 2, 9, 10, 11, 19, 100, 110, 123456789, 99999999999999999, -1, -10]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    placed = rows.select(F.inline(F.array(*[F.struct(F.concat(F.lit(t), "k").alias("name"), links._place(t, F.col("k")).alias("place")) for t in "sp"])))
    got = placed.select("name", links._name(F.col("place")).alias("back")).orderBy("place").collect()
    assert [r["name"] for r in got] == [r["back"] for r in got] == sorted(f"{t}{k}" for t in "sp" for k in keys)
    with pytest.raises(Exception, match="more than 17"):
        spark.range(1).select(links._place("s", F.lit(10**17))).collect()
