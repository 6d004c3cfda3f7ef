"""Token files: the code against plain Huffman lengths, exact round trips, and the tokenizer itself."""

import heapq
import os
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import token_files as tf
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain_total(counts):
    """Bits of all symbols by Huffman's merges, without a limit."""
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        c = heapq.heappop(heap) + heapq.heappop(heap)
        total += c
        heapq.heappush(heap, c)
    return total


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_least_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(400) < 0.2, 0, (rng.pareto(0.5, 400) * 3 + 1).astype(np.int64).clip(1, 10**9))
    free = tf.code_lengths(counts, 40)
    assert int((free.astype(np.int64) * counts).sum()) == plain_total(counts)
    last = None
    for limit in (16, 12, 10, 9):
        lengths = tf.code_lengths(counts, limit)
        used = counts > 0
        assert lengths.max() <= limit and (lengths[used] > 0).all() and not lengths[~used].any()
        assert sum(2.0 ** -int(v) for v in lengths[used]) == 1  # a full tree
        total = int((lengths.astype(np.int64) * counts).sum())
        assert last is None or total >= last
        last = total


def test_lengths_under_a_tight_limit_by_trying_all():
    counts = np.array([1, 1, 2, 5, 40, 90])
    from itertools import product

    best = min(sum(a * b for a, b in zip(ls, counts, strict=True)) for ls in product(range(1, 4), repeat=6) if sum(2.0**-v for v in ls) <= 1)
    assert int((tf.code_lengths(counts, 3) * counts).sum()) == best


def test_codes_are_canonical():
    lengths = tf.code_lengths(np.array([5, 0, 9, 1, 1, 3, 30]), 16)
    codes = tf.canonical_codes(lengths)
    spelt = {i: format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)}
    assert not any(a != b and spelt[b].startswith(spelt[a]) for a in spelt for b in spelt)
    by = sorted(spelt, key=lambda i: (len(spelt[i]), i))
    assert [spelt[i] for i in by] == sorted(spelt.values())


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_a_block_comes_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n) - 1, 60_000)
    lengths = tf.code_lengths(np.bincount(ids), 16)
    data, points, bits = tf.encode_block(ids, lengths, tf.canonical_codes(lengths))
    assert bits == int(lengths[ids].sum()) and len(data) == -(-bits // 8)
    table_ = tf.decoding_table(lengths)
    assert (tf.decode_block(data, points, n, table_) == ids).all()
    for first in range(0, len(points), 7):  # from any checkpoint
        assert (tf.decode_block(data, points, n, table_, first, first + 3) == ids[first * 128 : (first + 3) * 128]).all()


def test_a_file_by_ranges(monkeypatch, tmp_path):
    monkeypatch.setattr(tf, "BLOCK", 1000)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in (1, 5, 999, 1, 4000, 130, 64)]
    whole = np.concatenate(docs)
    path = tmp_path / "x.tok"
    with open(path, "wb") as sink:
        writer = tf.Writer(sink, tf.code_lengths(np.bincount(whole), 16))
        for k, d in enumerate(docs):
            writer.add(None if k == 3 else k, d)
        writer.close()
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = tf.Reader(source)
        assert reader.doc_ids == [0, 1, 2, None, 4, 5, 6] and len(reader.blocks) == 6
        for a, b in [(0, len(whole)), (0, 1), (999, 1001), (1000, 2000), (1500, 1501), (5000, 5200), (7, 7)]:
            got = [*reader.ids(a, b)]
            assert (np.concatenate(got) if got else np.zeros(0)).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError), fs.LocalFileSystem().open_input_file(str(path)) as source:
        cut = pa.BufferReader(source.read()[:-3])
        tf.Reader(cut)


TEXTS = [
    "", "a", " ", "  ", "\n", "one two", " lead", "trail ", "double  space", "line\nbreak", "line\n\nbreak", "\n x", "x \ny", "tab\tx y", "don't they'll 'S 12 34x",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|>\nc", "nb\xa0sp x\xa0 y", "　全角 文字\n日本語", "é ß z w", "nul\x00 x", "\x85 a\x1cb c", "🙂 🙂🙂\n🙂", "a\r\nb c", "x" * 3000 + " y",
]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_pieces_have_the_tokens_of_the_text():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["a", "Be", " ", " ", "\n", ".", "'s", "9", "é", "　", "\t", "<|endoftext|>", "中", "--"]) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    ids, at = tf.PieceTokens(PATH).ids(pa.array(texts + [None]))
    for k, want in enumerate(plain_ids(texts + [None])):
        assert ids[at[k] : at[k + 1]].tolist() == want, repr((texts + [None])[k])


def expected(rows):
    out, start = [], 0
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k, ids in zip(order, plain_ids([rows[k][1] for k in order]), strict=True):
        out.append((rows[k][0], start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_files_of_ragged_documents(spark, monkeypatch):
    rows = [(k * 3 % 101, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (500, None), (501, "long words and more " * 90_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start int, ids string").repartition(5)
    got = tf.write_and_read(df, PATH)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(rows)


def test_repeated_rows_and_ranges(spark):
    rows = [(1, "same text"), (1, "same text"), (2, "other"), (0, "first of all")]
    folder, files = tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    assert files.agg({"n_docs": "sum"}).first()[0] == 4
    assert sorted(tuple(r) for r in tf.read_documents(spark, folder).collect()) == sorted(expected(rows))
    whole = [i for ids in plain_ids(["first of all", "same text", "same text", "other"]) for i in ids]
    assert tf.read_range(spark, folder, 3, 5).tolist() == whole[3:8]
    assert tf.read_range(spark, folder, 0, 10**6).tolist() == whole


def test_an_empty_table(spark):
    assert tf.write_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_files_of_the_table(spark):
    df = table(spark, SF, "documents")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in tf.write_and_read(df, PATH).collect()), key=lambda r: r[1]) == expected(rows)
