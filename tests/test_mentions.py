"""Mentions against a search of every start and length."""

import random
import re

from tidemark.operators import mentions


def brute(text, names):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    at, out = 0, []
    while at < len(w):
        best = max((k for k in range(1, len(w) - at + 1) if tuple(w[at : at + k]) in names), default=0)
        if best:
            out.append((at, best, names[tuple(w[at : at + best])]))
        at += best or 1
    return out


def test_both_ways_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["acme", "steel", "works", "of", "north", "sea", "bank"]
    given = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 4)))) for k in range(60)] + [(99, "Acme-Steel"), (100, "ACME steel!"), (101, " - "), (None, "bank"), (102, None), (5, "sea sea sea"), (5, "Sea, sea; SEA")]
    borne = {}
    for e, n in given:
        w = tuple(re.findall(r"[a-z0-9]+", (n or "").lower()))
        if w and e is not None:
            borne.setdefault(w, set()).add(e)
    names = {w: next(iter(e)) for w, e in borne.items() if len(e) == 1}
    refused = {w for w, e in borne.items() if len(e) > 1}
    docs = [(k, " ".join(rng.choices(vocabulary + ["x", "y."], k=rng.randint(0, 60)))) for k in range(80)] + [(80, None), (81, ""), (82, "acme " * 3000)]
    want = {(d, *m) for d, t in docs for m in brute(t, names)}
    known, ambiguous = mentions.dictionary(spark.createDataFrame(given, "entity_id long, name string"))
    assert {tuple(r[0]) for r in ambiguous.collect()} == refused and ("acme", "steel") in refused
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bound in (mentions.BROADCAST_WORDS, 0):
        assert {tuple(r) for r in mentions.mentions(df, known, bound).collect()} == want
    assert mentions.mentions(df, known.where("false")).count() == 0
