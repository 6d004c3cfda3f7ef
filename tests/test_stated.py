"""SQL functions in the plan, marked tables, and quotas against a plain simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import allot
from tidemark.plans import stamps
from tidemark.sources import otsl


def test_functions_are_inlined(spark):
    stamps.register_stamps(spark)
    df = spark.createDataFrame([("2024-03-01",), ("2024-03-01T05:31",), ("2024-03-01 00:00:00",), ("",), (None,), ("no day at all",)], "s string")
    out = df.select(F.expr("local_to_utc(s)").cast("string").alias("a"), F.expr("stamp_precision(s)").alias("p"))
    assert [tuple(r) for r in out.collect()] == [
        ("2024-03-01 18:29:59", "day"), ("2024-03-01 00:01:00", "minute"), ("2024-02-29 18:30:00", "second"), (None, "unknown"), (None, "unknown"), (None, "minute"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "local_to_utc" not in plan and "CASE WHEN" in plan


def cells(text):
    return list(otsl.spans(otsl.grid(text)))


def test_spans_of_marked_tables():
    text = "A caption\n<fcel>a<lcel><fcel>b<nl><ucel><xcel><ecel><nl><fcel>c<fcel>d  e<ucel><nl>"
    assert cells(text) == [(0, 0, "a", 2, 2), (0, 2, "b", 1, 1), (1, 2, "", 2, 1), (2, 0, "c", 1, 1), (2, 1, "d e", 1, 1)]
    for bad, why in [
        ("", "no cell"), ("words only", "no cell"), ("<lcel>", "nothing to merge"), ("<fcel>a<nl><ucel><fcel>b", "2 cells, not 1"), ("<ucel>", "nothing to merge"),
        ("<fcel>a<fcel>b<nl><ucel><xcel>", "two cells"), ("<fcel>a<nl>stray<fcel>b", "text before"), ("<fcel>a<lcel>x", "text in a merged"),
        ("<fcel>a<lcel><nl><fcel>b<ucel>", "below the right part"), ("<fcel>a<lcel><nl><ucel><lcel>", "cell from above"), ("<fcel>a<lcel><nl><ucel><fcel>b", "no rectangle"),
    ]:
        with pytest.raises(otsl.Malformed, match=why):
            cells(bad)


def test_the_table_function_never_fails(spark):
    spark.udtf.register("otsl_cells", otsl.otsl_cells)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>", "t"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "k long, t string").createOrReplaceTempView("marked")
    got = {}
    for r in spark.sql("SELECT k, c.* FROM marked, LATERAL otsl_cells(t) c").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    for k, text in enumerate(texts):
        try:
            want = [] if text is None else [(*c, None) for c in cells(text)]
        except otsl.Malformed as reason:
            want = [(None, None, None, None, None, str(reason))]
        assert sorted(got.get(k, []), key=str) == sorted(want, key=str)


def test_cells_by_column_equal_the_table_function(spark, monkeypatch):
    monkeypatch.setattr(otsl, "TEXTS", 7)
    spark.udtf.register("otsl_cells", otsl.otsl_cells)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>", " ", "a < b"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    texts += [None, "<fcel>a<lcel><nl><ucel><xcel><nl>", "<fcel>a<nl> stray <nl><fcel>b", "<nl><nl>", "<fcel> x  y <nl><nl><ecel>"]
    df = spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "k long, text2 string, t string")
    df.createOrReplaceTempView("marked_too")
    by_column = otsl.read_cells(df, "t")
    assert by_column.columns[:3] == ["k", "text2", "row"]
    want = spark.sql("SELECT k, text2, c.* FROM marked_too, LATERAL otsl_cells(t) c").collect()
    assert sorted(map(str, by_column.collect())) == sorted(map(str, want)) and len(want) > len(texts)


def simulate(rows, quotas):
    """One at a time, as the rule is told."""
    strata = {}
    for i, s, g, v in rows:
        if s in quotas:
            strata.setdefault(s, {}).setdefault(g, []).append((-v, i))
    order = {}
    for s, groups in strata.items():
        ranked = [sorted(groups[g]) for g in sorted(groups, key=lambda g: (-len(groups[g]), g is not None, g or ""))]
        order[s] = []
        while any(ranked):
            for g in ranked:
                if g:
                    order[s].append(g.pop(0)[1])
    have = {s: len(order.get(s, [])) for s in quotas}
    taken = {s: min(q, have[s]) for s, q in quotas.items()}
    total = min(sum(quotas.values()), sum(have.values()))
    while sum(taken.values()) < total:
        for s in quotas:
            if taken[s] < have[s] and sum(taken.values()) < total:
                taken[s] += 1
    return {(i, s, p + 1) for s in quotas for p, i in enumerate(order.get(s, [])[: taken[s]])}, taken


@pytest.mark.parametrize("seed", range(4))
def test_picks_equal_a_simulation(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", "z", None]), rng.choice(["g", "h", "h", "i", None]), rng.randint(0, 5)) for k in range(rng.choice([30, 200]))]
    quotas = {"b": rng.randint(0, 60), "a": 10, "none": 20, "c": rng.randint(0, 9)}
    want, taken = simulate(rows, quotas)
    have = {s: sum(r[1] == s for r in rows) for s in quotas}
    assert allot.allotments(have, quotas) == taken
    got = allot.stratified(spark.createDataFrame(rows, "id long, s string, g string, v long"), "s", "g", [F.col("v").desc(), F.col("id")], quotas)
    assert {(r["id"], r["s"], r["turn"]) for r in got.collect()} == want
