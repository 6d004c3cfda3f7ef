"""What SQL doesn't hold against the queries: traps of time, parsers, folds and state."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import finance as fin
from tidemark.operators import books, graph, relational, search, stats, temporal, windows
from tidemark.plans import guard
from tidemark.sources import files, pages
from tidemark.streaming import events

D = dt.date


def test_asof_carries_over_buckets_and_falls_back(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", D(2024, 5, 5)), ("a", None), ("b", D(2020, 1, 1)), (None, D(2020, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("a", D(2019, 3, 1), 1), ("a", D(2019, 4, 1), 2), ("b", D(2021, 1, 1), 9)], "k string, since date, v int")
    got = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "since", ["v"]).collect()}
    assert got == {("a", D(2020, 1, 1)): 2, ("a", D(2024, 5, 5)): 2, ("a", None): None, ("b", D(2020, 1, 1)): None, (None, D(2020, 1, 1)): None}
    back = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", "since", ["v"], earliest_fallback=True).collect()}
    assert back["b", D(2020, 1, 1)] == 9


def test_resolve_panel_hides_what_was_not_known(spark):
    requested = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, 10), (5, 11)], "ord int, series_id long")
    series = spark.createDataFrame([(7, True, 400), (8, False, 400), (9, True, 400), (10, True, 10)], "series_id long, active boolean, max_lookback_days int")
    obs = spark.createDataFrame(
        [(7, D(2020, 3, 31), D(2020, 5, 1), 1, 5.0), (7, D(2020, 3, 31), D(2020, 9, 1), 2, 6.0), (8, D(2020, 3, 31), D(2020, 4, 1), 1, 1.0), (10, D(2020, 3, 31), D(2020, 4, 1), 1, 2.0)],
        "series_id long, period_end date, as_of_date date, vintage int, value double",
    )
    got = {r.series_id: (r.status, r.value) for r in temporal.resolve_panel(requested, series, obs, F.lit(D(2020, 6, 30))).collect()}
    assert got == {7: ("ok", 5.0), 8: ("quarantined", None), 9: ("no_observation", None), 10: ("stale", None), 11: ("unknown_series", None)}
    later = temporal.resolve_panel(requested, series, obs, F.lit(D(2020, 10, 1)))
    assert later.where("series_id = 7").first().value == 6.0


def test_rsi_of_only_gains(spark):
    prices = spark.createDataFrame([(1, D(2020, 1, 1) + dt.timedelta(i), 100.0 + i) for i in range(20)], "entity_id int, date date, close double")
    assert {r.rsi for r in windows.wilder_rsi(prices).collect()} == {None, 100.0}
    assert {r.rsi for r in windows.ewm_rsi(prices).collect()} == {50.0}


def test_next_valid_skips_missing(spark):
    rows = spark.createDataFrame([(1, D(2020, 1, i), v) for i, v in enumerate([None, None, 3.0, 4.0], 1)], "entity_id int, date date, close double")
    got = [r.x for r in rows.withColumn("x", windows.next_valid("close")).orderBy("date").collect()]
    assert got == [3.0, 3.0, 3.0, 4.0]


def test_finance_refuses(spark):
    row = spark.createDataFrame([(0.0, 5.0, -1.0, None)], "zero double, five double, minus double, none double")
    values = row.select(fin.ratio("five", "zero"), fin.growth("zero", "five"), fin.cagr("minus", "five", F.lit(2)), fin.add("five", "none"), fin.fair_pb(F.lit(10.0), F.lit(12.0), F.lit(11.0))).first()
    assert list(values) == [None] * 5
    reasons = row.select(fin.forensic_reasons("none", "five", "zero")).first()[0]
    assert reasons == "pledge"


def test_formula_refusals(spark):
    row = spark.createDataFrame([(10.0, 0.0, None)], "tax double, pbt double, cfo double")
    value, why = fin.evaluate("effective_tax_rate")
    assert tuple(row.select(value, why).first()) == (None, "zero_denominator")
    row = row.withColumn("pat", F.lit(2.0))
    value, why = fin.evaluate("cfo_to_profit")
    assert tuple(row.select(value, why).first()) == (None, "missing_input")


def test_multiset_except_takes_as_many(spark):
    left = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "k string, n int")
    right = spark.createDataFrame([("x",), ("x",), ("z",)], "k string")
    got = sorted((r.k, r.n) for r in relational.multiset_except(left, right, ["k"], [F.col("n")]).collect())
    assert got == [("x", 2), ("x", 3), ("x", 4), ("y", 9)]


def test_student_p_known_values(spark):
    rows = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (12.706, 1.0)], "t double, n double")
    p = [r[0] for r in rows.select(stats.student_p("t", "n")).collect()]
    assert p == pytest.approx([0.05, 1.0, 0.05], abs=2e-4)


def test_xirr_against_closed_form(spark):
    flows = spark.createDataFrame([(1, D(2020, 1, 1), -100.0), (1, D(2021, 1, 1), 110.0), (2, D(2020, 1, 1), -5.0)], "entity_id int, date date, amount double")
    got = {r.entity_id: r.xirr for r in books.xirr(flows).collect()}
    assert got[2] is None and got[1] == pytest.approx(1.1 ** (365 / 366) - 1, abs=1e-9)


def test_fifo_against_a_loop(spark):
    import random

    rng = random.Random(5)
    trades = [(1, D(2020, 1, 1) + dt.timedelta(i), i, rng.choice("BBS"), float(rng.randint(1, 9)), float(rng.randint(1, 99))) for i in range(60)]
    lots, want = [], []
    for _, _, key, side, q, price in sorted((t for t in trades if t[3] == "B"), key=lambda t: t[2]):
        lots.append([key, q, price])
    for _, _, key, side, q, price in sorted((t for t in trades if t[3] == "S"), key=lambda t: t[2]):
        for lot in lots:
            used = min(q, lot[1])
            if used > 0:
                want.append((lot[0], key, used))
                lot[1] -= used
                q -= used
    df = spark.createDataFrame(trades, "entity_id int, date date, key int, side string, quantity double, price double")
    got = sorted((r.buy_key, r.sell_key, r.quantity) for r in books.fifo(df).collect())
    assert got == sorted(want)


def test_walk_has_no_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", -0.5)], "source string, target string, strength double")
    got = sorted((r.node, r.hop, r.effect) for r in graph.walk(edges, spark.createDataFrame([("a",)], "node string"), 3).collect())
    assert got == [("b", 1, 0.5), ("c", 2, -0.25)]


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    assert search.bm25(none, some).count() == 0


def test_html_spans_and_pipes():
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert pages.html_cells(html) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "a"), (0, 1, 1, "c")]
    assert pages.html_cells(None) == []


def markdown_cells(text):
    out, table, row, inside = [], -1, 0, False
    for line in (text or "").split("\n"):
        bare = line.strip()
        if "|" not in bare:
            inside = False
            continue
        if not inside:
            table, row, inside = table + 1, 0, True
        if re.fullmatch(r"\|?[\s:|-]*-[\s:|-]*", bare):
            continue
        out += [(table, row, c, cell.strip()) for c, cell in enumerate(re.split(r"(?<!\\)\|", bare.strip("|")))]
        row += 1
    return out


def sentence_chunks(text, target):
    out, size = [], 0
    for part in re.findall(r"[^.!?\n]+[.!?]*\s*|\n+|[.!?]+\s*", text or ""):
        if out and size + len(part) <= target:
            out[-1], size = out[-1] + part, size + len(part)
        else:
            out.append(part)
            size = len(part)
    return [x.strip() for x in out if x.strip()]


def test_pipe_tables_and_chunks_of_texts(spark):
    texts = ["x | y\n---|---\n1 | 2", None, "", "One two. Three four.", "a|b\n\n |c\\|d| e|\nplain\n|-:|\n||", "no pipe", "!! ? One\n\ntwo... three " * 9, "x" * 40 + ". y."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, pages.markdown_tables(df).collect())) == [(k, *c) for k, t in enumerate(texts) for c in markdown_cells(t)]
    for target in (9, 30, 1200):
        want = [(k, n, c) for k, t in enumerate(texts) for n, c in enumerate(sentence_chunks(t, target))]
        assert sorted(map(tuple, pages.chunks(df, target).collect())) == want


def test_formats_round_trip(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "cast(id as string) as s")
    for kind in ("parquet", "orc", "csv", "json"):
        df.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(f"{tmp_path}/{kind}")
        assert sorted(files.read(spark, f"{tmp_path}/{kind}", kind, df.schema).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        files.read(spark, "x", "avro")


def test_new_vintages_refuse_what_is_older(spark):
    now = spark.createDataFrame([(1, D(2020, 1, 1), 5.0)], "k int, known date, v double")
    new = spark.createDataFrame([(1, D(2020, 2, 1), 5.0), (1, D(2020, 3, 1), 6.0), (1, D(2019, 1, 1), 7.0), (2, D(2020, 1, 1), None)], "k int, known date, v double")
    got = sorted((r.k, r.v) for r in files.new_vintages(now, new, ["k"], "v", "known").collect())
    assert got == [(1, 6.0), (2, None)]


def test_guard_lets_reading_through(spark):
    assert guard.guarded_sql(spark, "select 1 as a;", 5).count() == 1
    for bad in ("drop table x", "select 1; select 2", ""):
        with pytest.raises(Exception):
            guard.guarded_sql(spark, bad).count()
    assert len(guard.with_deadline(spark.range(3), 60)) == 3


def test_keyed_state_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, True)] * 3 + [(2, False)], "key long, hit boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, hit boolean").parquet(f"{tmp_path}/in")
    got = {r.key: (round(r.power, 6), r.n) for r in events.run_available(events.explain_power(stream), str(tmp_path), "update").collect()}
    assert got == {1: (0.8, 3), 2: (0.45, 1)}


def test_flow_score_of_plain_cases(spark):
    from tidemark.functions import finance

    names = "conviction double, distance double, close double, a double, b double, c double, rsi double"
    rows = [
        (100.0, 5.0, 120.0, 110.0, 100.0, 90.0, 60.0),  # 35 + 25 + 1.5 * 15 + 15
        (0.0, 15.0, 120.0, 110.0, 100.0, 130.0, 50.0),  # a young trend below the long average: 15 + 7.5
        (0.0, 20.0, 80.0, 110.0, 100.0, 100.0, 30.0),  # only the averages are in order: 7.5
        (None, None, None, None, None, None, None),  # no RSI counts as 50
        (0.0, 0.0, 120.0, 110.0, 110.0, None, 80.0),  # no long average, a zero distance
    ]
    df = spark.createDataFrame(rows, names).coalesce(1)
    got = [r.s for r in df.select(finance.flow_score("conviction", "distance", "close", "a", "b", "c", "rsi").alias("s")).collect()]
    assert got == [97.5, 22.5, 7.5, 7.5, 15.0]


def test_fiscal_labels_of_plain_cases(spark):
    from tidemark.functions import periods

    cases = [
        ("2026-07-01", "2026-09-30", 3, "Q2FY27"), ("2026-04-01", "2026-09-30", 3, "H1FY27"), ("2026-04-01", "2026-12-31", 3, "9MFY27"), ("2025-04-01", "2026-03-31", 3, "FY26"),
        ("2025-10-01", "2026-03-31", 3, "H2FY26"), ("2025-10-01", "2026-09-30", 3, "TTM to Q2FY27"), (None, "2026-09-30", 3, "30 Sep 2026"), ("2026-01-01", "2026-03-31", 12, "Q1FY26"),
        ("2026-09-01", "2026-09-30", 3, "Sep 2026"), ("2026-04-01", "2026-08-31", 3, "YTD to 31 Aug 2026"), ("2026-05-01", "2026-08-31", 3, None), ("2026-05-01", "2026-05-01", 3, None),
        ("2026-05-02", "2026-05-01", 3, None), (None, None, 3, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "s string, e string, ends int").selectExpr("cast(s as date) s", "cast(e as date) e", "ends").coalesce(1)
    got = [r.label3 if r.ends == 3 else r.label12 for r in df.select("ends", *[periods.fiscal_label(F.col("s"), F.col("e"), n).alias(f"label{n}") for n in (3, 12)]).collect()]
    assert got == [c[3] for c in cases]
    labels = ["FY26", "Q1FY27", "Q2FY27", "H1FY27", "9M FY27", "H2FY2027", "FY27", "what"]
    order = [r.o for r in spark.createDataFrame([(x,) for x in labels], "label string").coalesce(1).select(periods.label_order(F.col("label")).alias("o")).collect()]
    assert order == sorted(order) and len(set(order)) == len(order)


def test_period_ends_in_texts(spark):
    from tidemark.functions import periods

    cases = {"ended 30th June, 2024": "2024-06-30", "Ending on 31-12-2023 and ended 31 Dec 2023": "2023-12-31", "ended 31.03.2024, year ended 31/03/2023": None, "ended 30 February 2024": None, "met on 5 May 2024": None, "": None}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").coalesce(1)
    assert [r.d and str(r.d) for r in df.select(periods.parse_period_end(F.col("t")).alias("d")).collect()] == [*cases.values(), None]


def test_months_covered_by_cells(spark):
    from tidemark.operators import statements

    rows = [("a", "2024-01-01", "2024-01-15", 1.0), ("a", "2024-01-10", "2024-01-31", 2.0), ("b", "2024-01-01", "2024-01-15", 1.0), ("b", "2024-01-17", "2024-01-31", 2.0), ("c", "2024-01-01", "2024-02-01", 1.0), ("d", "2024-01-02", "2024-01-31", 1.0), ("e", "2024-01-01", "2024-01-30", 1.0)]
    cells = spark.createDataFrame(rows, "k string, s string, e string, value double").selectExpr("k", "cast(s as date) period_start", "cast(e as date) period_end", "value")
    got = {(r.k, str(r.month)): (r.total, r.refusal) for r in statements.covered_months(cells, ["k"]).collect()}
    bad = (None, "incomplete_month")
    assert got == {("a", "2024-01-01"): (3.0, None), **{(k, "2024-01-01"): bad for k in "bcde"}, ("c", "2024-02-01"): bad}


def test_ratios_refuse(spark):
    from tidemark.functions.ratios import reading

    df = spark.createDataFrame([(10.0, 2.0), (10.0, -2.0), (10.0, 0.0), (None, 2.0)], "close double, eps_ttm double").coalesce(1)
    assert [(r.r.value, r.r.refusal) for r in df.select(reading("pe").alias("r")).collect()] == [(5.0, None), (None, "not_positive"), (None, "not_positive"), (None, "missing_input")]
    df = spark.createDataFrame([(1.0, 0.0)], "current_assets double, current_liabilities double")
    assert df.select(reading("current_ratio").alias("r")).first().r.refusal == "zero_denominator"


def test_sessions_held_without_the_grid(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(1, d(0), 1.0), (1, d(4), 2.0), (1, d(5), None), (1, d(7), None), (2, d(2), None), (2, d(3), 1.0), (2, d(4), 1.0), (3, d(6), None), (None, d(1), 1.0), (None, d(3), 1.0), (9, d(1), 1.0)]
    p = spark.createDataFrame(rows, "entity_id long, date date, close double")
    cal = temporal.sessions(p, "date")  # 0 to 7
    plan = temporal.held_sessions(p, cal)
    got = {r.entity_id: (r.n_sessions, r.n_held, r.longest_gap) for r in plan.collect()}
    assert got == {1: (8, 2, 3), 2: (3, 2, 0), 3: (1, 0, None), None: (3, 0, None), 9: (1, 1, 0)}
    assert not re.search("NestedLoop|CartesianProduct", plan._jdf.queryExecution().executedPlan().toString())


def test_values_dealt_by_hash(spark):
    from hashlib import md5

    rows = [(m, k, dt.date(2024, m, 1 + k), (k * 7 % 5) - 2.0, float(k * k + m)) for m in (1, 2) for k in range(20)]
    df = spark.createDataFrame(rows, "month int, entity_id long, date date, mom double, fwd double").repartition(5)
    got = {r.seed: (r.mean, r.n) for r in stats.dealt_means(df, "month", ["entity_id", "date"], "mom", "fwd", [1, 2]).collect()}
    for seed in (1, 2):
        kept = []
        for m in (1, 2):
            group = sorted(r for r in rows if r[0] == m)
            dealt = sorted(group, key=lambda r: md5(f"{seed}:{r[1]}:{r[2]}".encode()).hexdigest())
            kept += [b[4] for a, b in zip(group, dealt, strict=True) if a[3] > 0]
        assert got[seed] == (pytest.approx(sum(kept) / len(kept)), 40)


def test_equal_turnovers_share_a_place(spark, tmp_path):
    from tidemark.queries import relations

    # 0.1 + 0.2 + 0.3 is another number from 0.3 + 0.2 + 0.1; the days are what is added up
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    lines = [(e, 1.0, v, "N", day(k)) for e in range(1, 41) for k, v in enumerate([0.1, 0.2, 0.3] if e % 2 else [0.3, 0.2, 0.1])]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.place for r in relations.size_buckets(spark, str(tmp_path)).collect()} == {1}


def test_edges_of_groups_are_sent_to_rows_and_not_rows_to_groups(spark, capsys):
    rows = spark.createDataFrame([(k % 2, float(k), float(k * 7 % 50)) for k in range(100)], "g int, f double, t double")
    cut = relational.quantile_cut(rows, ["g"], "f", 4, "part")
    assert {r["part"] for r in cut.collect()} == {1, 2, 3, 4}
    cut.explain()
    ranked = stats.average_ranks(rows, ["g"], "f", "r")
    assert sorted(r["r"] for r in ranked.where("g = 0").collect()) == [float(k) for k in range(1, 51)]
    # each side of the join is met where it is read
    assert "SortMergeJoin" not in capsys.readouterr().out.split("== Initial Plan ==")[-1]
    few = rows.withColumn("t", F.col("f") % 2)
    assert stats.rank_ic(few, ["g"], "f", "t").count() == 0
    assert stats.rank_ic(rows, ["g"], "f", "t").count() == 2
    assert {r["g"]: r["spread"] for r in stats.quantile_spread(rows.withColumn("t", F.col("f")), ["g"], "f", "t").collect()} == {0: 80.0, 1: 80.0}


def test_a_panel_is_dealt_into_more_tasks_the_more_rows_it_has(spark, monkeypatch, tmp_path):
    from tidemark.queries import base

    monkeypatch.setattr(base, "TASK_ROWS", 100)
    rows = spark.createDataFrame([(k % 700, dt.datetime(1995, 1, 1 + k % 28), 2.0 * k, 2.0, "R") for k in range(1400)], "l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_returnflag string")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    panel = base.panel(spark, str(tmp_path))
    assert panel.rdd.getNumPartitions() == 14 and panel.agg(F.sum("volume")).first()[0] == 2800.0


def test_rates_of_many_runs_in_step_and_in_pieces(spark, monkeypatch):
    import random

    monkeypatch.setattr(books, "STEP", 7)
    rng, day = random.Random(3), dt.date(2020, 1, 1)
    flows = [(e, day + dt.timedelta(days=rng.randrange(900)), rng.choice([-1, 1]) * rng.uniform(1, 99)) for e in range(40) for _ in range(1 + e % 9)]
    got = {r.entity_id: r.xirr for r in books.xirr(spark.createDataFrame(flows, "entity_id long, date date, amount double").coalesce(2)).collect()}
    assert len(got) == 40
    for e in range(40):
        own = [(d, a) for k, d, a in flows if k == e]
        first = min(d for d, _ in own)
        npv = lambda rate: sum(a / (1 + rate) ** ((d - first).days / 365) for d, a in own)  # noqa: B023, E731
        if npv(-0.99) * npv(10.0) >= 0:
            assert got[e] is None
        else:
            lo, hi = -0.99, 10.0
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if npv(mid) * npv(-0.99) > 0 else (lo, mid)
            assert got[e] == pytest.approx((lo + hi) / 2, abs=1e-7)
