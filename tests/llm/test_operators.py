"""The operators of tidemark.llm against brute force on small tables, and on their hard cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, components, decontamination, language_id, line_dedup, minhash_dedup, packing, pii, quality, secret_scan, tiles, url_reputation, vector_dedup

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu") for b in ("me", "no", "ra") for c in ("s", "t", "", "nd")]
DOCS = "doc_id long, text string"


def prose(seed: int, n: int, per_line: int = 12) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


def classes(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# shared parts


def test_words_and_lines_of_ragged_texts():
    texts = ["", "one two\nthree four five\n", None, "\n\nx y z", "solo"]
    data, at = common.utf8(pa.array(texts))
    hashes, first = common.words(data, at)
    assert np.diff(first).tolist() == [0, 5, 0, 3, 1]
    _, runs, text, number = line_dedup.line_runs(data, at)
    assert list(zip(text.tolist(), number.tolist(), np.diff(runs).tolist(), strict=True)) == [(1, 0, 2), (1, 1, 3), (3, 2, 3), (4, 0, 1)]
    assert len(set(hashes.tolist())) == 9


def test_words_of_scripts_without_spaces_and_marks():
    count = lambda text, **how: np.diff(common.words(*common.utf8(pa.array([text])), **how)[1]).tolist()
    assert count("今天天气好。我们去公园，好吗") == [12] and count("今天天气好", unspaced=False) == [1]
    assert count("abc日本def") == [4] and count("« naïve – “x” »") == [2] and count("สวัสดี") == [6] and count("한국 사람") == [2]
    one = common.words(*common.utf8(pa.array(["wo—rd", "“wo” rd", "日本", "日 本。"])))
    assert one[0][:2].tolist() == one[0][2:4].tolist() and one[0][4:6].tolist() == one[0][6:].tolist()


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 600 + i) for i in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*pairs, (None, 1), (7, 7)], "a long, b long")).collect()}
    ids = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == classes([p for p in pairs if p[0] != p[1]], ids)


def test_forest_and_tiles_meet_all_pairs(spark):
    assert tiles.forest(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]
    rows = spark.createDataFrame([(1, i, 1) for i in range(25)] + [(2, 99, 1)], "g long, id long, w long")
    out = tiles.tile_pairs(rows, ["g"], "id", "w", 5, 5).collect()
    met = {(a.id, b.id) for a in out for b in out if (a.g, a.lo, a.hi) == (b.g, b.lo, b.hi)}
    assert all((i, j) in met for i in range(25) for j in range(25)) and not any(r.id == 99 for r in out)


# 1 line dedup


def test_edit_distance_against_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 90))] for _ in "ab")
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        assert line_dedup.edit_distance(a, b) == d[-1]


def test_simhash_against_votes():
    rng = np.random.default_rng(0)
    sizes = [1, 3, 300, 7, 256]
    at = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, at[-1], dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    want = [sum(1 << b for b in range(64) if 2 * sum((int(h) >> b) & 1 for h in hashes[i:j]) > j - i) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert line_dedup.simhash(hashes, at).tolist() == want


def kept_lines(spark, docs, schema=DOCS + ", extra string, key int", more=("x", 1)):
    got = line_dedup.dedup_lines(spark.createDataFrame([(d, t, *more) for d, t in docs], schema))
    kept = defaultdict(list)
    for r in got.collect():
        kept[r.doc_id].append(r.text)
    return got.columns, kept


def test_lines_of_all_kinds(spark):
    base = prose(7, 120, 60).split("\n")
    changed = base[0].split(" ")
    changed[5] = "zzz"
    docs = [(1, "\n".join(base)), (2, f"{base[0].upper()}!\nfresh words stand here alone"), (3, " ".join(changed) + "\nok"), (4, None), (5, ""), (6, "ok\n...\nok\n..."), (7, base[1]), (7, base[1]), (None, base[1]), (None, "only here"), (8, "今天天气好。"), (9, "今天天气好"), (10, "x " * 200_000 + "\nok")]
    columns, kept = kept_lines(spark, docs)
    assert columns == ["doc_id", "text", "extra", "key", "n_lines_removed"]
    # a row without a doc_id comes last in order
    assert kept[1] == ["\n".join(base)] and kept[2] == ["fresh words stand here alone"] and kept[3] == ["ok"] and kept[7] == ["", ""]
    assert kept[4] == [None] and kept[5] == [""] and kept[6] == ["...\n..."] and sorted(kept[None]) == ["", "only here"]
    assert kept[8] == ["今天天气好。"] and kept[9] == [""] and kept[10] == ["x " * 200_000]
    assert kept_lines(spark, [])[1] == {}


def test_similar_is_what_the_edit_distance_says():
    rng = random.Random(9)
    for _ in range(3000):
        a = [rng.randrange(9) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = [rng.randrange(9)] * rng.randrange(2)
        if b:
            want = line_dedup.edit_similarity(a, b) >= 0.8 - 1e-9
            assert line_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == want, (a, b)


def test_similar_lines_against_brute_force(spark):
    rng = random.Random(21)
    lines = []
    for k in range(240):
        n = (5, 10, 20, 35, 60, 120)[k % 6]
        line = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n)]
        other = list(line)
        for i in rng.sample(range(n), n // 5):
            if rng.random() < 0.6:
                other[i] = f"new{k}x{i}"
            else:
                other[i] = ""
        lines += [line, [w for w in other if w]]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.edit_similarity(lines[i], lines[j]) >= 0.8]
    root = classes(near, range(len(lines)))
    removed = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], DOCS)).where("n_lines_removed = 1").collect()}
    away = {i for i in root if root[i] != i}
    # nearly every pair is at the bound itself, where the bands find the fewest
    assert len(away) > 200 and removed <= away and len(removed) >= 0.9 * len(away)


def test_buckets_of_any_size_and_batch_meet_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    rows = sorted(set(zip(rng.integers(0, 90, 600).tolist(), rng.integers(0, 400, 600).tolist(), strict=True)) | {(200, 5)})
    key, h = (np.array(x) for x in zip(*sorted(rows + rows[:300]), strict=True))
    members = defaultdict(set)
    for k, x in rows:
        members[k].add(x)
    want = {frozenset(m) for m in members.values() if len(m) > 1}
    for bucket, step in ((1000, 37), (1000, 5), (4, 37), (4, 1)):
        monkeypatch.setattr(line_dedup, "BUCKET", bucket)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (key, h)], names=["key", "h"]) for i in range(0, len(key), step)]
        found = defaultdict(set)
        for b in line_dedup._bucketed(iter(batches)):
            for r in b.to_pylist():
                found[r["cluster"]].add(r["h"])
                assert r["head"] in {min(m) for m in members.values() if r["h"] in m}
        assert {frozenset(m) for m in found.values()} == want, (bucket, step)


@pytest.mark.parametrize("small", [0, 5, 128])
def test_clusters_of_any_size(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "TILE_ROWS", 7)
    monkeypatch.setattr(line_dedup, "SMALL", small)
    lines = [" ".join(f"w{i}" if i != k % 20 else f"n{k}" for i in range(20)) for k in range(60)]
    chain = [" ".join(f"c{i}" if i >= 4 * k else f"d{i}" for i in range(40)) for k in range(9)]  # each like the next alone
    docs = list(enumerate(lines + chain))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert [r.doc_id for r in out if r.n_lines_removed == 0] == [0, 60]


def test_sieve_lets_wanted_lines_pass(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, 5000)
    sieve = line_dedup.Sieve.of(spark.createDataFrame([(int(x),) for x in h], "h long"), len(h))
    assert sieve.passes(h).all() and sieve.passes(rng.integers(-(1 << 63), 1 << 63, 5000)).mean() < 0.02
    assert line_dedup.Sieve.of(spark.createDataFrame([], "h long"), 1 << 40) is None


# 2 decontamination


def test_leaks_with_replaced_words(spark):
    item = prose(11, 40).replace("\n", " ")
    words = item.split(" ")
    swapped = [w if i % 9 else "qqq" for i, w in enumerate(words)]
    docs = [(1, f"Start. {item.upper()}!! end"), (2, prose(12, 30) + " " + " ".join(swapped) + " tail"), (3, prose(13, 300)), (4, None), (5, ""), (None, item), (6, "alpha beta gamma delta epsilon")]
    bench = [(10, item), (11, "alpha beta gamma delta epsilon"), (12, None), (13, "too short"), (10, item)]
    got = decontamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 10), (2, 10), (None, 10), (6, 11)}
    assert {r.start for r in got if r.doc_id == 2} == {30} and min(r.overlap for r in got) > 0.8
    left = decontamination.drop_contaminated(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", overlap int"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == ["doc_id", "text", "overlap"]


BENCH = "item_id long, text string"


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], BENCH)
    docs = spark.createDataFrame([(1, "a b c d e f g")], DOCS)
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, prose(1, 30))], BENCH)).count() == 0


def aligned(words, item):
    """The best overlap of an item over all starts, and its first start, by brute force."""
    best = (0, 0)
    for start in range(1 - len(item), len(words)):
        met = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(item)]
        enough = sum(met) >= max(len(item) / 2, min(len(item), 3)) or any(sum(met[i : i + 24]) >= 20 for i in range(len(item) - 23))
        if enough and (sum(met) / len(item), -start) > best:
            best = (sum(met) / len(item), -start)
    return best


def test_leaks_by_replacement_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(20)]
    items = {k: [rng.choice(vocabulary) for _ in range(rng.randint(15, 59))] for k in range(40)}
    items |= {100: ["solo7"], 101: ["two", "parts"], 102: [rng.choice(vocabulary) for _ in range(7)], 103: items[3]}
    docs, planted = {}, defaultdict(list)
    for d in range(240):
        k, rate = d % 40, (0, 0.1, 0.2, 0.3, 0.4, 0.5)[d // 40]
        item = list(items[k])
        for i in rng.sample(range(len(item)), int(rate * len(item))):
            item[i] = f"q{rng.randrange(10**6)}"
        docs[d] = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + item + [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        planted[rate].append((d, k))
    docs |= {900: ["a", "two", "parts", "b"], 901: ["parts", "two"], 902: ["solo7"], 903: items[102], 904: items[102][:6], 905: [*items[5][:24], *vocabulary[:30]], 906: ["x"] * 200_000 + items[7], 907: items[9] + ["y"] + items[9]}
    got = decontamination.contaminated(
        spark.createDataFrame([(d, " ".join(w), "x", 1) for d, w in docs.items()], DOCS + ", item_id string, start int"),
        spark.createDataFrame([(k, " ".join(w), 1) for k, w in items.items()], BENCH + ", doc_id int"),
    ).collect()
    found = {(r.doc_id, r.item_id): (r.overlap, r.start) for r in got}
    want = {(d, k): aligned(docs[d], items[k]) for d in docs if d != 906 for k in items}
    want = {p: b for p, b in want.items() if b[0]}
    assert all(d == 906 or (d, k) in want and want[d, k] == (pytest.approx(o, abs=1e-6), -s) for (d, k), (o, s) in found.items())
    for rate, pairs in planted.items():
        pairs = [p for p in pairs if p in want]
        assert sum(p in found for p in pairs) >= (0.9 if rate == 0.5 else 0.95 if rate == 0.4 else 1) * len(pairs) and len(pairs) > 15, rate
    assert {(900, 101), (902, 100), (903, 102), (904, 102), (906, 7), (3, 103)} <= set(found) and (901, 101) not in found
    assert found[906, 7][1] == 200_000 and found[907, 9][1] == 0


def test_leaks_of_short_items_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(30)]
    items = {k: [rng.choice(vocabulary) for _ in range(3 + k % 17)] for k in range(170)}  # 3 to 19 tokens
    docs, planted = {}, defaultdict(list)
    for d in range(850):
        k, rate = d % 170, (0, 0.1, 0.25, 0.4, 0.5)[d // 170]
        item = list(items[k])
        for i in rng.sample(range(len(item)), int(rate * len(item))):
            item[i] = f"q{rng.randrange(10**6)}"
        docs[d] = [rng.choice(vocabulary) for _ in range(rng.randrange(25))] + item + [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        planted[len(item), rate].append((d, k))
    got = decontamination.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOCS), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], BENCH)).collect()
    found = {(r.doc_id, r.item_id): (r.overlap, r.start) for r in got}
    for (d, k), (o, s) in found.items():
        assert aligned(docs[d], items[k]) == (pytest.approx(o, abs=1e-6), -s)
    missed = [(n, rate, p) for (n, rate), pairs in planted.items() for p in pairs if aligned(docs[p[0]], items[p[1]])[0] and p not in found]
    asked = defaultdict(int)
    for (n, rate), pairs in planted.items():
        asked[rate] += sum(aligned(docs[d], items[k])[0] > 0 for d, k in pairs)
    for rate in (0, 0.1, 0.25, 0.4, 0.5):
        assert sum(m[1] == rate for m in missed) <= 0.02 * asked[rate] and asked[rate] >= 120, (rate, missed)


def test_ties_of_starts_take_the_first(spark):
    item = "one two three four five six seven eight"
    docs = [(1, f"{item} {item} {item}"), (2, "one two three x five x x x one two three four x x x x")]
    got = {r.doc_id: (r.start, r.overlap) for r in decontamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item)], BENCH)).collect()}
    assert got == {1: (0, 1.0), 2: (0, 0.5)}


# 3 language


def test_language_of_clear_texts(spark):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 60).replace("a", "ö").replace("o", "ü"), "en" if i % 2 else "xx") for i in range(120)]
    rows += [(1000, None, "en"), (1001, "123 ...", "en"), (1002, prose(5, 30), None), (None, prose(5, 30), "en")]
    got = language_id.label_documents(spark.createDataFrame(rows, DOCS + ", lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "xx") for i in range(120))
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1000].score == 0.0
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120)) and all(0 <= r.score <= 1 for r in got)


def test_language_without_labels(spark):
    got = language_id.label_documents(spark.createDataFrame([(1, "some text", None)], DOCS + ", lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language_id.label_documents(spark.createDataFrame([], DOCS + ", lang string")).count() == 0


# 4 packing


def test_differencing_is_near_equal():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1024) for _ in range(200)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 30)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 60
    windows = packing.pack_sizes(sizes)
    assert sorted(i for w in windows for i in w) == list(range(200)) and max(sum(sizes[i] for i in w) for w in windows) <= packing.CAPACITY
    assert packing.pack_sizes([]) == [] and packing.pack_sizes([4096]) == [[0]]
    assert packing.cuts(1) == [(0, 1)] and sum(n for _, n in packing.cuts(9999)) == 9999


def test_packing_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = {1: "Hello, world. It's 3.14!", 2: None, 3: "", 4: prose(3, 6000), 5: "a b\tc  d <|endoftext|> İstanbul ΣΣ naïve x.y, don't", 6: "\n\n . , .. ,, ?!"}
    got = packing.pack(spark.createDataFrame(list(texts.items()), DOCS), path).toPandas()
    plain = Tokenizer.from_file(path)
    for doc, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = got[got.doc_id == doc].sort_values("start")
        assert pieces.doc_tokens.unique().tolist() == [len(ids)] and pieces.length.sum() == len(ids)
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


# 5 secrets


def test_secret_base_and_links(spark):
    texts = ["token: a token=abcdefgh", "secret=token:abcdefgh", "AKIA" + "A" * 16 + " AKIA1", "f" * 24 + " " + "0" * 23, "é API_KEY: 'x1y2z3'", None, "",
             "client_id = svc-billing\nkey: Zx81kQpL0vT5nW3sYb72\nhost=db.internal:5432", "Zx81kQpL0vT5nW3sYb72 alone: x", "client_id = svc-billing\n\nkey: Zx81kQpL0vT5nW3sYb72"]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    plain = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(plain) for m in re.finditer(p, text or "", (re.I if k == 0 else 0) | re.A) if len(m[g]) >= n)
        spelt = ",".join(f"{name}:{s}:{e}" for s, _, name, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(spelt.encode()).hexdigest(), text
    assert got[7].spans == "identifier:0:23,secret:29:49,endpoint:50:71" and got[8].n_linked == 0 and got[9].n_linked == 0


def test_secret_parts_of_any_length_are_whole():
    run = "Zx81kQpL0vT5nW3sYb72"
    for n in (16, 128, 129, 500, 4000):
        text = f"client_id = svc-billing\nkey: {(run * 200)[:n]}\nend"
        assert (29, 29 + n, 4) in secret_scan.linked(text, []), n
    name, host, path = "svc-" + "b" * 100, "db." + "h" * 150, "p" * 300
    text = f"client_id = {name}\nkey: {run}\nhost={host}\nhttps://x.internal/{path} end"
    assert sorted(text[s:e] for s, e, _ in secret_scan.linked(text, [])) == sorted([f"client_id = {name}", run, f"host={host}", f"https://x.internal/{path}"])


def test_secret_links_against_brute_force():
    rng = random.Random(5)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    for seed in range(12):
        parts = []
        for _ in range(80):
            parts.append(rng.choice([f"client_id = svc-{rng.randrange(99)}", "".join(rng.choice(letters) for _ in range(30)) + "7a", f"https://h{rng.randrange(9)}.internal/p", "plain words " * rng.randrange(20), "\n\n", "AKIA" + "Z" * 16]))
        text = " ".join(parts)
        base = secret_scan.base_spans(text)
        every = sorted(secret_scan.weak_parts(text) + [(s, e, 3 if k == 1 else 4) for s, e, k in base])
        breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
        block = lambda at, breaks=breaks: sum(b <= at for b in breaks)
        met = [p for p in every if any((p[2] == 4) != (q[2] == 4) and block(p[0]) == block(q[0]) and (0 <= q[0] - p[1] <= 240 or 0 <= p[0] - q[1] <= 240) for q in every)]
        taken, want = [(s, e) for s, e, _ in base], []
        for k in (3, 4, 5):
            mine = [p for p in dict.fromkeys(met) if p[2] == k and not any(p[0] < y and x < p[1] for x, y in taken)]
            want += mine
            taken += [p[:2] for p in mine]
        assert secret_scan.linked(text, base) == want and want, seed


def test_a_secret_part_does_not_confirm_itself():
    for alone in (
        "client_id = 9f8e7d6c5b4a3928Zz1706aaee", "https://example.com/a1B2c3D4e5F6g7H8i9", "see https://example.com/a1B2c3D4e5F6g7H8i9?k=Zx81kQpL0vT5nW3sYb72 there",
        "user_id=9f8e7d6c5b4a39281706aaee9f8e7d6c", "client_id=Zx81kQpL0vT5nW3sYb72", "account_key: 'Zx81kQpL0vT5nW3sYb72'", "host=a1B2c3D4e5F6g7H8i9j0",
    ):
        assert secret_scan.linked(alone, secret_scan.base_spans(alone)) == [], alone
    # and one that another follows is confirmed by that alone
    text = "client_id = 9f8e7d6c5b4a3928Zz1706aaee then Zx81kQpL0vT5nW3sYb72"
    assert secret_scan.linked(text, []) == [(0, 38, 3), (44, 64, 4)]


def test_planted_credentials_are_all_found():
    rng = random.Random(8)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    for _ in range(200):
        value = "".join(rng.choice(letters) for _ in range(24)) + "".join(rng.choice("23456789") for _ in range(8))
        parts = [(f"client_id = svc-{rng.randrange(999)}", 3), (value, 4), (f"https://h{rng.randrange(9)}.internal/path", 5)]
        rng.shuffle(parts)
        text, want = "words before it. ", []
        for part, kind in parts:
            want.append((len(text), len(text) + len(part), kind))
            text += part + rng.choice([" ", "\n", " and some words between, "])
        assert sorted(secret_scan.linked(text, [])) == want


def test_secret_scan_of_long_and_odd_rows(spark):
    dense = "\n".join(f"client_id = svc-{i}\nkey: Zx81kQpL0vT5nW3sYb{i:04d}" for i in range(4000))
    rows = [(1, dense, "x"), (1, None, "y"), (None, dense[:5000], "z")]
    got = secret_scan.scan(spark.createDataFrame(rows, DOCS + ", spans string")).collect()
    assert sorted((r.doc_id or 0, r.n_linked) for r in got)[-1] == (1, 8000) and len(got) == 3
    assert secret_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


# 6 vectors


def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 120)] + 0.01 * rng.normal(size=(120, 16))
    x = np.vstack([base, near, np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[0][1], None), (904, [1.0, 2.0], 1), (905, [None] * 16, 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, "e") for r in rows + odd], "vec_id long, embedding array<float>, label int, vector string")
    got = {r.vec_id: r for r in vector_dedup.link_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    link = (u @ u.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    root = classes(zip(*map(np.ndarray.tolist, np.nonzero(link)), strict=True), range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert got[None].component_id is None and got[None].kept is False
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_recall_on_long_lists(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", 50)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 32))
    x = np.vstack([base, base[rng.integers(0, 500, 1000)] + 0.08 * rng.normal(size=(1000, 32)), base[:1] + 0.02 * rng.normal(size=(300, 32))])
    x = x.astype(np.float32).astype(float)
    got = vector_dedup.link_vectors(spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>, label int")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[i] <= link[i].sum() for i in found) and sum(found.values()) >= 0.97 * link.sum() > 80_000


# 7 urls


def test_urls_and_rules(spark):
    urls = {1: "https://A.Example.com/en/7?x", 2: "http://b.com/en/1", 3: "http://x.example.net/de/8/", 4: "ftp://example.net/de/9#f", 5: "no scheme", 6: None, 7: "http://notexample.com:80/en/7", 8: "http://h.org", 9: "http://com/en/", 10: "://?q"}
    pages = spark.createDataFrame([(k, v, "x", "y") for k, v in urls.items()], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.filter_urls(pages, none).collect()}
    assert got == {
        1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("b.com", "/en/1", "com/en/", "block"), 3: ("x.example.net", "/de/8/", "example.net/de/8", "block"),
        4: ("example.net", "/de/9", "net/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notexample.com:80", "/en/7", None, "allow"),
        8: ("h.org", "", None, "allow"), 9: ("com", "/en/", "com/en/", "block"), 10: ("", "", None, "allow"),
    }
    assert url_reputation.filter_urls(pages.limit(0), none).count() == 0


def test_every_rule_says_its_word(spark):
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(host, path): what for what, host, path in url_reputation.RULES} == rules
    bad = [(i, f"http://b.net/fr/{i}") for i in range(60)]  # a host that is blocked where no rule fits
    pages = spark.createDataFrame([*bad, (100, "http://b.net/de/1"), (101, "http://x.example.net/de/7"), (102, "http://x.example.net/de/81")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i, _ in bad], "page_id long, bad int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.filter_urls(pages, outcomes).collect()}
    assert got[0] == (None, "block") and got[100] == got[101] == ("net/de/", "allow") and got[102] == ("example.net/de/8", "block")


def test_reputation_shrinks_to_the_parents(spark):
    rows = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 60 + [("new.a.com", None)] + [("one.b.org", 1)]
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.a.com"].bound > 0.5 > got["good.a.com"].bound and got["bad.a.com"].rate < 1
    assert got["new.a.com"].n == 0 and 0.3 < got["new.a.com"].rate < 0.7 and got["one.b.org"].bound < 0.5


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "me.github.io": ("me.github.io", "github.io"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", url_reputation.registered_domain(F.col("host")).alias("d"), url_reputation.suffix(F.col("host")).alias("s")).collect()}
    assert got == hosts


def test_outcomes_take_the_whole_number(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/7.html"), (2, "http://a.com/en/1234567890123456789"), (3, "http://a.com/en/99999999999999999999"), (1, "http://a.com/en/8"), (4, "http://a.com/x")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (123456789012345678, 0, 0), (1234567890123456789, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted((r.page_id, r.bad) for r in url_reputation.page_outcomes(pages, labels).collect()) == [(1, 1), (2, 0)]
    assert url_reputation.filter_urls(pages, url_reputation.page_outcomes(pages, labels)).count() == 5


# 8 near duplicates


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a, b = np.unique(rng.integers(1, 1 << 62, 400).astype(np.uint64)), None
    b = np.sort(np.concatenate([a[:300], np.unique(rng.integers(1, 1 << 62, 100).astype(np.uint64))]))
    wa, wb = 1 + rng.integers(0, 3, len(a)), 1 + rng.integers(0, 3, len(b))
    exact = minhash_dedup.similarity((a, wa), (b, wb))
    s = minhash_dedup.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)]), 2000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.05
    pairs = {int(k): (x, 0.0) for k, x in zip(a, wa, strict=True)}
    pairs |= {int(k): (pairs.get(int(k), (0.0, 0))[0], x) for k, x in zip(b, wb, strict=True)}
    slow = sum(1 / sum(max(xj / x, yj / y) for xj, yj in pairs.values()) for x, y in pairs.values() if x and y)
    assert exact == pytest.approx(slow)
    assert minhash_dedup.signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0]))[0].tolist() == [0] * minhash_dedup.REGISTERS


def test_near_duplicates_against_brute_force(spark):
    docs = [(i, prose(i, 150)) for i in range(30)]
    for i in range(30, 60):
        words = docs[i % 7][1].split(" ")
        words[i % len(words)] = f"new{i}"
        docs.append((i, " ".join(words)))
    docs += [(100, docs[3][1].upper()), (101, "one two"), (102, "One, two!"), (103, None), (104, ""), (105, "..."), (None, docs[3][1]), (5, docs[5][1]), (106, prose(99, 30000)), (107, prose(99, 30000) + " x")]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    shingled = {}
    for k, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        if k is not None and w:
            shingled[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    links = [(a, b) for a in shingled for b in shingled if a < b and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])]
    assert got == classes(links, [k for k, _ in docs if k is not None])
    left = minhash_dedup.drop_near_duplicates(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", class_id int"))
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == ["doc_id", "text", "class_id"] and set(ids) == {*got.values(), None} and len(ids) == len(set(ids))
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# 9 personal data


def test_pii_base_against_re(spark):
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4.5 300.1.1.1 001.002.003.004", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (017) 555-7713 and +12 3", "é+49 30 901820é", None, "", "9" * 5000, "a." * 3000 + "@x", "1." * 4000, "+" * 50 + "1 " * 4000, "x@" * 2000]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    digits = lambda h: re.sub("[^0-9]", "", h)

    def luhn(d):
        v = [int(c) * (i % 2 + 1) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in v) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 13 <= len(digits(h)) <= 19 and luhn(digits(h))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(digits(h)) <= 15),
    ]
    for i, text in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0]))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text and text[:40]
        assert got[i].spans.startswith(want)
    assert pii.scan(spark.createDataFrame([], DOCS)).count() == 0


def planted_personal_data(n: int):
    """Documents with personal data that the base patterns miss (and where), beside base matches and plain numbers."""
    rng = random.Random(17)
    docs, where = [], []
    for d in range(n):
        digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))  # noqa: B023, E731
        word = lambda: rng.choice(WORDS)  # noqa: B023, E731
        parts = [word() for _ in range(6)]
        parts += rng.choice([["call", f"+1 ({digits(3)}) 555-{digits(4)}"], ["mail", f"{word()}.{digits(2)}@{word()}.example.com"], ["server", f"10.{rng.randrange(256)}.3.{rng.randrange(256)}"], [f"order {digits(9)}"], [f"isbn {digits(13)}"], [f"total {digits(12)} units"]])
        parts += [word() for _ in range(5)]
        hidden = rng.choice([None, f"{word()}.{word()} (at) {word()}.example.com", f"{word()} at {word()} dot org", f"10[.]{rng.randrange(256)}[.]7[.]{rng.randrange(256)}", f"1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) 555-{digits(4)}"])
        text = " ".join(parts) + ". "
        if hidden:
            text += "Please contact "
            where.append((d, len(text), len(text) + len(hidden)))
            text += hidden
        docs.append((d, text + f", {word()} in section {digits(2)} of {digits(4)}."))
    return docs, where


def test_pii_method_adds_what_the_base_misses(spark):
    docs, where = planted_personal_data(1500)
    got = pii.scan(spark.createDataFrame(docs, DOCS)).collect()
    base = {"email", "ip", "card", "phone"}
    added = set()
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        extra = [(r.doc_id, a, b) for k, a, b in spans if k not in base]
        assert len(extra) == r.n_added and len(spans) == r.n_spans
        assert all(b <= c or d <= a for i, (_, a, b) in enumerate(spans) for k, c, d in spans[i + 1 :] if k not in base)
        added |= set(extra)
    hit = sum(w in added for w in where)
    assert hit >= 0.9 * len(where) and hit >= 0.95 * len(added)


def test_pii_of_long_and_odd_rows(spark):
    dense = " ".join(f"x{i}@mail.example.com +1 (212) 555-{i % 10000:04d} call 030/{i:07d} z{i} (at) q.org" for i in range(6000))
    docs, _ = planted_personal_data(300)
    rows = [(5000, dense), (5001, dense[:3000]), (5001, dense[:3000]), (None, dense[:200]), (5002, "\x01a@b.cd\x01"), *docs]
    got = [r for r in pii.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_email int, spans string")).collect() if r.doc_id is None or r.doc_id >= 5000]
    assert sorted((r.doc_id or 0, r.n_email, r.n_phone) for r in got)[-1] == (5002, 1, 0) and len(got) == 5
    long = next(r for r in got if r.doc_id == 5000)
    assert (long.n_email, long.n_phone) == (6000, 6000) and long.n_added >= 6000


def test_starts_are_sums_before(spark):
    rng = random.Random(2)
    for n in (1, 2, 127, 128, 129, 1000):
        xs = [rng.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "xs array<int>").select(pii._starts(F.col("xs")).alias("s")).first().s
        assert got == [sum(xs[:i]) for i in range(n)]


def test_boosted_trees_learn_a_rule():
    cells = [({f: (i >> k) & 1 for k, f in enumerate(pii.FEATURES)}, 10 * ((i & 3) == 3), 10 * ((i & 3) != 3)) for i in range(64)]
    trees = pii.boost(cells)
    least = pii.threshold(trees, cells)
    assert all((sum(t.value(x) for t in trees) >= least - 1e-6) == (yes > 0) for x, yes, _ in cells)
    assert pii.threshold(pii.boost([]), []) == float("inf")


# 10 quality


def test_quality_of_clear_texts(spark):
    rows = [(i, prose(i, 80)) for i in range(80)] + [(100 + i, re.sub(r"\w+", lambda m: m[0].upper() + "!!", prose(i % 3, 12)) * 6) for i in range(15)] + [(200 + i, prose(i, 60).replace(" ", "### ")) for i in range(15)]
    rows += [(300, None), (301, ""), (302, "..."), (None, prose(1, 50))]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", score double")
    got = {r.doc_id: r for r in quality.score(df).collect()}
    assert all(got[i].keep for i in range(80)) and not any(got[i].keep for i in [*range(100, 115), *range(200, 215), 300, 301, 302])
    kept = quality.keep_good(df)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {*range(80), None}
    assert quality.score(df.limit(0)).count() == 0


def test_label_model_finds_kinds_of_badness():
    rng = np.random.default_rng(0)
    kind = rng.choice([-1, 0, 1, 2, 3], 4000, p=[0.77, 0.08, 0.06, 0.05, 0.04])
    blame = np.where(quality.KIND == kind[:, None], 0.85, 0.03)
    v = (rng.random(blame.shape) >= blame).astype(np.int8)
    v[rng.random(v.shape) < 0.2] = -1  # abstains
    found, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.fit_labels(found, counts.astype(float))
    own = quality.KIND[:, None] == np.arange(4)
    assert ((model.posterior(v) > 0.5) == (kind < 0)).mean() > 0.9 and abs(model.share[0] - 0.77) < 0.05
    assert (model.good[:, 0] > 0.95).all() and (model.good[:, 1:][own] < 0.4).all() and (model.good[:, 1:][~own] > 0.9).all()


def test_quality_rejects_abuse(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(i, 120).split(" ")
        if i % 8 == 0:
            for word in ("Idiot", "worthless", "stupid", "scum"):
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i].keep for i in got if i % 8 == 0) and all(got[i].keep for i in got if i % 8)
    assert all((got[i].toxicity > 0.5) == (i % 8 == 0) for i in got)


def test_samples_are_bounded_for_equal_rows_and_missing_ids(spark):
    text = prose(1, 40)
    rows = [(None, text, "en")] * 3000 + [(7, text, "en")] * 3000 + [(i, prose(i, 30) + " ö ß", "de") for i in range(100, 300)]
    df = spark.createDataFrame(rows, DOCS + ", lang string").repartition(4)
    got = quality.score(df, sample=200).collect()
    assert len(got) == 6200 and len({(r.score, r.keep) for r in got if r.doc_id in (None, 7)}) == 1
    found = language_id.label_documents(df).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"en": 6000, "de": 200}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.label_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 200
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    scored = quality.score(docs).join(labels, "doc_id")
    clean, bad = scored.where("quality = 1 and toxic = 0"), scored.where("quality = 0")
    assert clean.where("keep").count() >= 0.99 * clean.count() > 200 and bad.where("not keep").count() >= 0.97 * bad.count() > 40


def test_language_and_quality_of_very_long_texts(spark):
    docs = [(1, prose(1, 300_000)), (1, prose(1, 300)), (2, "ñandú " * 400_000)] + [(i, prose(i, 60), ) for i in range(10, 60)]
    df = spark.createDataFrame([(*r, "en", 0.1) for r in docs], DOCS + ", lang string, score double")
    assert {r.lang_pred for r in language_id.label_documents(df).where("doc_id = 1").collect()} == {"en"}
    assert quality.score(df).count() == len(docs)


def test_packing_of_repeated_and_missing_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(1, "same words", 5), (1, "same words", 6), (None, "no id", 7), (None, None, 8)]
    got = packing.pack(spark.createDataFrame(rows, DOCS + ", length int"), public.path("word_bpe_49k.json")).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 2 and len({(r.sequence_id, r.offset) for r in got}) == 4


def test_seed_map_is_asked_once_for_all_masks(spark):
    asked = []

    class Counted:
        def holds(self, h):
            asked.append(h)
            return F.lit(True)

    rows = spark.createDataFrame([(list(range(30)), [True] * 30)], "h array<long>, f array<boolean>").withColumn("g", F.col("f"))
    starts, seeds = decontamination.document_seeds(Counted(), [1, 5])
    n = len(rows.withColumn("starts", starts).withColumn("short_starts", F.col("starts")).select(seeds.alias("s")).first()["s"])
    masks = [*decontamination.MASKS, *decontamination.SHORT_MASKS, "1"]
    assert n == sum(31 - len(m) for m in masks) and len(asked) == 1
