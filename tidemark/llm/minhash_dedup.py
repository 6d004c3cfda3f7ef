"""Near-duplicate documents by ProbMinHash over weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, owners, stage, text_slices, utf8, words
from .components import connected_components
from .tiles import Linker, grouped, tile_pairs

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and rows of the signature: two documents of similarity 0.8 share a band with probability 0.998.
BANDS, ROWS = 20, 6
REGISTERS = BANDS * ROWS
#: A pair whose signatures agree in a smaller share of registers isn't verified: five standard
#: deviations below the least similarity.
LEAST_AGREEMENT = 0.6
TILE_SHINGLES, TILE_ROWS = 1_000_000, 700

_STEP = np.array([0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of texts given as word hashes: (hash, count, where each text begins, with an end).

    A text with fewer words than a shingle has one, of all its words; one without a word has none.
    """
    n, count = len(hashes), np.diff(at)
    owner = owners(at)
    last = n - SHINGLE + 1
    whole = np.zeros(0, np.uint64)
    who = np.zeros(0, np.int64)
    if last > 0:
        mixed = np.zeros(last, np.uint64)
        for k in range(SHINGLE):
            mixed += hashes[k : k + last] * _STEP[k]
        inside = owner[:last] == owner[SHINGLE - 1 :]
        whole, who = mix64(mixed[inside]), owner[:last][inside]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        own = np.array([sum(int(h) * int(s) for h, s in zip(hashes[at[i] : at[i + 1]], _STEP, strict=False)) % (1 << 64) for i in short], np.uint64)
        whole, who = np.concatenate([whole, mix64(own + np.uint64(1))]), np.concatenate([who, short])
    order = np.lexsort((whole, who))
    whole, who = whole[order], who[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (who[1:] != who[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(whole)))
    return whole[starts], counts, np.searchsorted(who[starts], np.arange(len(at)))


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: one and the logarithm of how often it occurs."""
    return 1 + np.log(counts)


def signatures(items: np.ndarray, weight: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each text and register the shingle that arrives first (0 for a text without any).

    The arrivals of a shingle are a Poisson process of rate `weight`, each in a random register, all drawn
    from the shingle's hash. Texts go on together, drawing twice as many arrivals each round, and a
    shingle stops once its next arrival comes after every register of its text is taken.
    """
    texts = len(at) - 1
    owner = owners(at)
    first = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    alive, time, drawn, more = np.arange(len(items)), np.zeros(len(items)), 0, 1
    while len(alive):
        for k in range(drawn, drawn + more):
            draw = mix64(items[alive] + np.uint64((k + 1) * int(_STEP[0]) % (1 << 64)))
            uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            time = time - np.log(uniform) / weight[alive]
            place = owner[alive] * registers + (mix64(draw ^ _STEP[1]) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, place, time)
            won = first[place] == time
            winner[place[won]] = items[alive][won]
        drawn, more = drawn + more, min(2 * more, 64)
        open_until = first.reshape(texts, registers).max(axis=1)
        on = time <= open_until[owner[alive]]
        alive, time = alive[on], time[on]
    return winner.reshape(texts, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash per text and band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _STEP[3]
    for k in range(ROWS):
        mixed = mix64(mixed + parts[:, :, k] * _STEP[k % len(_STEP)])
    return mixed


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, two hashes of the whole word sequence and the bands of each text that has a word."""
    for batch in text_slices(batches):
        hashes, at = words(*utf8(batch.column(1)))
        items, counts, starts = shingles(hashes, at)
        some = np.flatnonzero(np.diff(at) > 0)
        if not len(some):
            continue
        found = bands(signatures(items, weights(counts), starts))[some]
        position = np.arange(len(hashes), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
        whole = [np.add.reduceat(mix64(hashes * _STEP[a] + position * _STEP[b]), at[some]).view(np.int64) for a, b in ((0, 1), (2, 3))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some)), *map(pa.array, whole), pa.FixedSizeListArray.from_arrays(pa.array(found.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))],
            names=["doc_id", "k1", "k2", "bands"],
        )


def _payload(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, cluster, the number of shingles, their hashes and weights and the signature."""
    for batch in text_slices(batches):
        hashes, at = words(*utf8(batch.column(1)))
        items, counts, starts = shingles(hashes, at)
        weight = weights(counts)
        signature = (signatures(items, weight, starts) >> np.uint64(32)).astype("<u4")
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.diff(starts)), cut(items.astype("<u8")), cut(weight.astype("<f4")), pa.array([s.tobytes() for s in signature], pa.binary())],
            names=["doc_id", "cluster", "n", "items", "weights", "signature"],
        )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two texts, each its sorted shingles and their weights.

    The sum over common shingles i of 1 / sum over j of max(x_j / x_i, y_j / y_i); with equal weights
    it is the Jaccard similarity of the sets.
    """
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    union = len(a[0]) + len(b[0]) - len(i)
    if (a[1] == 1).all() and (b[1] == 1).all():
        return len(i) / union
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    alone_x, alone_y = a[1].sum(dtype=np.float64) - x.sum(), b[1].sum(dtype=np.float64) - y.sum()
    # by y_j / x_j: below y_i / x_i the first term is the larger, above it the second
    ratio = y / x
    order = np.argsort(ratio)
    x, y = x[order], y[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((below + alone_x) / x + (above + alone_y) / y)).sum())


def _verify(least: float):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        ids, tile = rows.column("doc_id").to_numpy(), rows.column("tile").to_numpy()
        lo, hi = int(rows.column("lo")[0].as_py()), int(rows.column("hi")[0].as_py())
        order = np.lexsort((ids, tile))
        ids, tile = ids[order], tile[order]
        signature = np.frombuffer(b"".join(rows.column("signature").take(pa.array(order)).to_pylist()), "<u4").reshape(len(ids), REGISTERS)
        items, weight = rows.column("items").take(pa.array(order)), rows.column("weights").take(pa.array(order))
        text = lambda i: (np.frombuffer(items[i].as_py(), "<u8"), np.frombuffer(weight[i].as_py(), "<f4"))
        first = np.flatnonzero(tile == lo)
        second = first if lo == hi else np.flatnonzero(tile == hi)
        linker, edges = Linker(len(ids)), []
        for i in first.tolist():
            others = second[second > i] if lo == hi else second
            if not len(others):
                continue
            agree = (signature[others] == signature[i]).mean(axis=1)
            likely = np.flatnonzero(agree >= LEAST_AGREEMENT)
            mine = None
            for j in others[likely[np.argsort(-agree[likely], kind="stable")]].tolist():
                if linker.top(i) == linker.top(j):
                    continue
                mine = mine or text(i)
                if similarity(mine, text(j)) >= least:
                    linker.join(i, j)
                    edges.append((i, j))
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return work


def near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, class_id): the smallest doc_id of the class that each document belongs to.

    Texts of equal words are one class from the start, however many there are; their smallest doc_id stands
    for them. Texts that share a band form candidate clusters; inside a cluster, pairs of tiles verify every
    pair by exact probability Jaccard unless it is connected already, so a large group of near copies costs
    about one verified pair a text. A pair is skipped there if its signatures agree in so few registers that its similarity is below
    `least` but for one case in a million (LEAST_AGREEMENT). Texts below five words are one shingle. Texts without a word and null
    texts are classes of their own. Rows of one doc_id count as one document, which links all its texts;
    rows without a doc_id, which the result could not name, are left out. Columns of other names play no part. An empty table gives no row.
    """
    rows = documents.where("doc_id is not null").select("doc_id", F.lower("text").alias("text"))
    sketches = stage(rows.mapInArrow(_sketch, "doc_id long, k1 long, k2 long, bands array<long>"))
    classes = sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = stage(classes)
    members = classes.select("rep", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head").repartition("head", "band")
    clusters = connected_components(members.join(buckets, "band").where("rep != head"), "rep", "head")

    texts = (
        rows.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
        .select("doc_id", "text", "cluster")
        .mapInArrow(_payload, "doc_id long, cluster long, n long, items binary, weights binary, signature binary")
    )
    tiled = tile_pairs(texts, ["cluster"], "doc_id", "n", TILE_SHINGLES, TILE_ROWS)
    links = grouped(tiled, ["cluster", "lo", "hi"], _verify(least), "a long, b long")
    same = sketches.join(classes.where("copies > 1").select("k1", "k2", "rep").repartition("rep"), ["k1", "k2"])
    copies = same.where("doc_id != rep").select("doc_id", "rep").distinct()
    groups = connected_components(links.union(copies), "a", "b")
    return (
        documents.select("doc_id")
        .where("doc_id is not null")
        .distinct()
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    )


def drop_near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of the document with the smallest doc_id of each class, with all columns.

    Of several rows of that doc_id the one of the smallest text hash stays. Rows without a doc_id, which no class can name, stay all.
    """
    away = near_duplicates(documents, least).where("doc_id != class_id").select("doc_id")
    left = documents.join(away, "doc_id", "left_anti").select(*documents.columns)
    again = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    again = stage(again)
    if again.isEmpty():
        return left
    repeated = left["doc_id"] == again["_again"]
    one = left.join(again, repeated, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.xxhash64("text")).alias("_row"))
    return left.join(again, repeated, "left_anti").union(one.select("_row.*"))
