"""The positional index against scans of the texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stems import folded, stem
from tidemark.operators import fulltext
from tidemark.queries.base import table
from tidemark.queries.registry import QUERIES

SF = "/root/testdata/sf0.001"

#: Words and stems as the paper gives them.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll""".split()


def test_stems_of_the_paper():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert [stem(w) for w in ("", "a", "is", "süße", "x9s")] == ["", "a", "is", "süße", "x9s"]


def test_folding(spark):
    texts = ["Élan Über ÑANDÚ ﬁ ß", "été", "İ", None, "Žluťoučký kůň"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded("t")).collect()]
    assert got[0] == "elan uber nandu ﬁ ß" and got[1] == "ete" and got[3] is None and got[4] == "zlutoucky kun"


def scan(text, stemmed=False):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    found = re.findall(r"[^\W_]+", plain)
    return [stem(w) for w in found] if stemmed else found


def made(n, seed=4):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "betas", "gam", "gamma", "élan", "x1", "the", "running", "runs"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for k in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "-- !"), (n + 3, "the " * 2000 + "end")]


@pytest.mark.parametrize("stemmed", [False, True])
def test_searches_equal_a_scan(spark, monkeypatch, stemmed):
    monkeypatch.setattr(fulltext, "BLOCK_DOCS", 4)
    docs = made(150)
    blocks = fulltext.index(spark.createDataFrame(docs, "doc_id long, text string"), stemmed, shard_docs=40).persist()
    assert blocks.agg(F.max(F.size("entries"))).first()[0] <= 4 and blocks.select("shard").distinct().count() > 2
    queries = {1: ["alpha", "beta"], 2: ["the", "the", "gamma"], 3: ["elan"], 4: ["missing", "the"], 5: ["runs", "x1"], 6: ["the", "end"], 7: ["beta", "gam"]}
    q = spark.createDataFrame(list(queries.items()), "query_id long, terms array<string>")
    texts = {d: scan(t, stemmed) for d, t in docs}
    asked = {k: [stem(w) if stemmed else w for w in v] for k, v in queries.items()}

    want = {(k, d): n for k, v in asked.items() for d, w in texts.items() if (n := sum(w[i : i + len(v)] == v for i in range(len(w))))}
    got = fulltext.phrases(blocks, fulltext.needles(q, stemmed))
    assert {(r["query_id"], r["doc_id"]): r["hits"] for r in got.collect()} == want

    def begins(w, v, i):
        return w[i : i + len(v) - 1] == v[:-1] and len(w) >= i + len(v) and w[i + len(v) - 1].startswith(v[-1])

    heads = {k: v[:-1] + [queries[k][-1]] for k, v in asked.items()}
    want = {(k, d): n for k, v in heads.items() for d, w in texts.items() if (n := sum(begins(w, v, i) for i in range(len(w))))}
    got = fulltext.phrases(blocks, fulltext.needles(q, stemmed, prefix=True))
    assert {(r["query_id"], r["doc_id"]): r["hits"] for r in got.collect()} == want

    apart = {k: v for k, v in asked.items() if len(set(v)) == len(v)}
    want = {}
    for k, v in apart.items():
        for d, w in texts.items():
            spans = [j - i - 1 for i in range(len(w)) for j in range(i, min(i + 8, len(w))) if set(v) <= set(w[i : j + 1])]
            if spans and min(spans) <= 3:
                want[k, d] = min(spans)
    got = fulltext.near(blocks, fulltext.needles(q.where(F.size("terms") == F.size(F.array_distinct("terms"))), stemmed), 3)
    assert {(r["query_id"], r["doc_id"]): r["between"] for r in got.collect()} == want

    want = {(k, d) for k, v in asked.items() for d, w in texts.items() if set(v) <= set(w)}
    assert {tuple(r) for r in fulltext.all_of(blocks, fulltext.needles(q, stemmed)).collect()} == want


def test_a_written_index(spark, tmp_path):
    df = spark.createDataFrame(made(60), "doc_id long, text string")
    blocks = fulltext.index(df, False, 20)
    fulltext.write(blocks, str(tmp_path / "index"))
    again = spark.read.parquet(str(tmp_path / "index"))
    q = fulltext.needles(spark.createDataFrame([(1, ["the", "alpha"])], "query_id long, terms array<string>"), False)
    found = fulltext.phrases(again, q)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, fulltext.phrases(blocks, q).collect()))
    empty = fulltext.index(df.where("false"))
    assert fulltext.phrases(empty, q).count() == 0


def test_stemmed_query_equals_a_scan(spark):
    docs = {r["doc_id"]: scan(r["text"], True) for r in table(spark, SF, "documents").collect()}
    want = {}
    for r in table(spark, SF, "benchmark").collect():
        v = scan(r["text"], True)[:2]
        for d, w in docs.items():
            n = sum(w[i : i + 2] == v for i in range(len(w) - 1))
            if n:
                want[r["item_id"], d] = n
    got = {(r["query_id"], r["doc_id"]): r["hits"] for r in QUERIES["fts_stemmed"](spark, SF).collect()}
    assert got == want and want


@pytest.mark.parametrize("stemmed", [False, True])
def test_searches_in_one_pass_equal_the_index(spark, monkeypatch, stemmed):
    monkeypatch.setattr(fulltext, "STEP_WORDS", 50)
    docs = spark.createDataFrame(made(150), "doc_id long, text string")
    blocks = fulltext.index(docs, stemmed, shard_docs=40).persist()
    queries = [["alpha", "beta"], ["the", "the", "gamma"], ["elan"], ["missing", "the"], ["runs", "x1"], ["the", "end"], ["beta", "gam"], ["the", "the"], ["gam"], ["alpha", "beta"]]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, terms array<string>")
    for prefix in (False, True):
        wanted = fulltext.needles(q, stemmed, prefix)
        got, want = fulltext.phrases_in(docs, wanted, stemmed), fulltext.phrases(blocks, wanted)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    if not stemmed:
        wanted = fulltext.needles(q.where(F.size("terms") == F.size(F.array_distinct("terms"))), False)
        got, want = fulltext.near_in(docs, wanted, 3), fulltext.near(blocks, wanted, 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert fulltext.phrases_in(docs, fulltext.needles(q.where("false"), stemmed), stemmed).count() == 0


@pytest.mark.parametrize("name", ["fts_phrase", "fts_prefix", "fts_near", "fts_stemmed"])
def test_queries_shuffle_only_what_is_found(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_distinctive_terms_shuffle_no_single_words_of_documents(spark):
    """Rows of one document count it once, and the words are not grouped by document."""
    from tidemark.operators import search

    rows = [("a", 1, "x x y"), ("a", 1, "x z"), ("a", 2, "y"), ("b", 3, "w w"), ("b", 4, "v"), ("b", 5, None), ("b", None, "w")]
    found = search.distinctive_terms(spark.createDataFrame(rows, "lang string, doc_id long, text string").where("text is not null"), "lang", 0.5, 9)
    assert {(r["lang"], r["term"]): (r["tf"], r["docs"]) for r in found.collect()} == {("a", "x"): (3, 1), ("a", "y"): (2, 2), ("a", "z"): (1, 1), ("b", "w"): (3, 2), ("b", "v"): (1, 1)}
    plan = QUERIES["distinctive_terms"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[lang#\d+, doc_id#\d+L?, term", plan)
