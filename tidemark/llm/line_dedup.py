"""Fuzzy line deduplication by sketch blocks of neighbouring words, SimHash and word edit similarity."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, located_words, mix64, new_folder, stage, text_slices, utf8
from .components import connected_components
from .tiles import Linker, forest, grouped, tile_pairs

SIMILARITY = 0.8
#: Two lines of n words at SIMILARITY differ by n / 5 edits, each of which touches two of the n + 1 pairs of neighbouring words (line
#: ends are neighbours too): they share 0.43 of all their pairs at least. One of BANDS bands of ROWS minima is then equal
#: with probability 1 - (1 - 0.43**ROWS)**BANDS = 0.91, and more above and where edits stand together.
BANDS, ROWS = 12, 2
#: Bits of a band's hash in a key, below the number of the band.
BAND_BITS = 42
#: Most bits in which the SimHashes of two lines may differ. At SIMILARITY 13 are to be expected; three deviations more are let
#: pass, so that the edits decide.
MOST_BITS = 22
#: Lines of one key that are named together; the rows of a larger bucket go on under its key, to be cut into tiles.
BUCKET = 2048
TILE_ROWS, TILE_WORDS = 700, 500_000
#: Lines of a cluster that is compared together with others; a larger one is compared alone, in tiles.
SMALL = 128
#: Distinct lines that a task remembers, so that each comes to a bucket about once a task.
REMEMBERED = 1_000_000

_LANES = np.array([sum(((byte >> bit) & 1) << (8 * bit) for bit in range(8)) for byte in range(256)], np.uint64)
_TIMES = (mix64(np.arange(1, BANDS * ROWS + 1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLUS = (mix64(np.arange(1001, BANDS * ROWS + 1001)) >> np.uint64(32)).astype(np.uint32)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def fewest_words(least: float) -> int:
    """A line of fewer words has no similar one but itself: one other word is too much."""
    return math.ceil(1 / (1 - least) - 1e-9) if least < 1 else 1


def simhash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each run of word hashes, every word weighing one. No run is empty."""
    size = np.diff(at)
    if not len(size):
        return np.zeros(0, np.uint64)
    # a word of 64 bits holds eight counters of a byte, so runs are summed in parts of at most 255
    parts = -(-size // 255)
    before = np.cumsum(parts) - parts
    first = np.repeat(at[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(first), 64), np.int32)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[raw[:, byte]], first)
        counts[:, 8 * byte : 8 * byte + 8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.add.reduceat(counts, before, axis=0)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def band_keys(hashes: np.ndarray, at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of each run of word hashes: a row of BANDS, each of minima over its pairs of neighbours. No run is empty.

    A pair that a run repeats counts as another one each time, so that repeated words don't hide edits. Pairs of two common
    words (of a sorted array) come after all others, so that lines don't meet by what most lines hold, but not in a line
    half of which is such pairs.
    """
    if len(at) < 2:
        return np.zeros((0, BANDS), np.int64)
    left, right = np.insert(hashes, at[:-1], np.uint64(1)), np.insert(hashes, at[1:], np.uint64(2))
    often = np.isin(hashes, common)
    pairs, begin = mix64(left * _A + right * _B), at[:-1] + np.arange(len(at) - 1)
    last = np.insert(often, at[:-1], True) & np.insert(often, at[1:], True)
    few = 2 * np.add.reduceat(last.astype(np.int64), begin) < np.diff(at) + 1
    last = (last & np.repeat(few, np.diff(at) + 1)).astype(np.uint32) << np.uint32(31)
    own = mix64(pairs + mix64(np.repeat(np.arange(len(at) - 1), np.diff(at) + 1) + 1))
    order = np.argsort(own)
    first = np.flatnonzero(np.concatenate([[True], own[order[1:]] != own[order[:-1]]]))
    again = np.empty(len(own), np.uint64)
    again[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    x = (mix64(pairs + again * _B) >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(at) - 1, BANDS), np.int64)
    for band in range(BANDS):
        joined = np.zeros(len(at) - 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            joined = mix64(joined * _A + mix64(np.minimum.reduceat((x * _TIMES[k] + _PLUS[k]) >> np.uint32(1) | last, begin)))
        keys[:, band] = (joined >> np.uint64(64 - BAND_BITS)).astype(np.int64) | (band << BAND_BITS)
    return keys


def line_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines that have a word: all their word hashes, where each line's begin (with an end), the index of
    its text and its number there (from 0, as split at every line end)."""
    hashes, start = located_words(data, at)
    breaks = np.flatnonzero(data == 10) + 1
    begin = np.sort(np.concatenate([at[:-1], breaks]))
    first = np.arange(len(at) - 1) + np.searchsorted(breaks, at[:-1], side="right")
    line = np.searchsorted(begin, start, side="right") - 1
    count = np.bincount(line, minlength=len(begin))
    kept = np.flatnonzero(count)
    text = np.searchsorted(first, kept, side="right") - 1
    return hashes, np.concatenate([[0], np.cumsum(count[kept])]), text, kept - first[text]


def line_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each run's words in their order. No run is empty."""
    if len(at) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
    return mix64(np.add.reduceat(mix64(hashes * _A + place.astype(np.uint64) * _B), at[:-1]))


def _lines(fewest: int):
    """doc_id, key, line, h of every line, and its words (32 bits of each) if it has so many and is new to the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in text_slices(batches):
            hashes, at, text, number = line_runs(*utf8(batch.column(2)))
            if not len(text):
                continue
            h, size = line_hashes(hashes, at).view(np.int64), np.diff(at)
            new = np.zeros(len(h), bool)
            new[np.unique(h, return_index=True)[1]] = True
            new &= size >= fewest
            place = np.minimum(np.searchsorted(seen, h), max(len(seen) - 1, 0))
            if len(seen):
                new &= seen[place] != h
            seen = np.sort(np.concatenate([seen if len(seen) < REMEMBERED else seen[:0], h[new]]))
            offsets = np.concatenate([[0], 4 * np.cumsum(np.where(new, size, 0))]).astype(np.int32)
            spelt = hashes[np.repeat(new, size)].astype("<u4")
            words = pa.Array.from_buffers(pa.binary(), len(h), [pa.array(new).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(spelt)])
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(h), words],
                names=["doc_id", "key", "line", "h", "words"],
            )

    return run


def spelt_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words given by 32 bits, and where each line's begin (with an end)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    raw = np.frombuffer(data, "<u4", count=at[-1]) if data is not None else np.zeros(0, np.uint32)
    return mix64(raw[at[0] :].astype(np.uint64) + np.uint64(1)), at - at[0]


#: Share of all words from which on a word is common: there are fewer than its inverse.
COMMON = 0.001


def _often(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that are half as often in some batch as common ones, with their count, and all words under 0."""
    for batch in batches:
        hashes, _ = spelt_words(batch.column(0))
        found, n = np.unique(hashes, return_counts=True)
        often = n > COMMON / 2 * len(hashes)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], len(hashes)))], names=["word", "n"])


def common_words(spelt: DataFrame) -> np.ndarray:
    """The sorted hashes of the words that are more than COMMON of all; the driver gets as many at most."""
    counts = spelt.select("words").mapInArrow(_often, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where("word = 0").first()
    if total is None:
        return np.zeros(0, np.uint64)
    rows = counts.where((F.col("word") != 0) & (F.col("n") > COMMON * total["n"])).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _keyed(common: np.ndarray):
    """Lines (h, words) under each of their keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                keys = band_keys(*spelt_words(part.column(1)), common)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "h"])

    return run


def _bucketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, h) sorted so, as rows (h, cluster, head) of lines that share a bucket with another.

    head is the bucket's first line. A cluster is named by its lines, so one that several bands find is one; one too
    large to hold is named by its key, and its rows go on as they come.
    """
    key, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large, its_head = -1, 0  # the key of a bucket whose rows go on, and its first line
    for batch in chain(batches, [None]):
        if batch is not None:
            key, h = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([h, batch.column(1).to_numpy()])
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h = key[fresh], h[fresh]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        big, heads = (size > BUCKET) | (key[starts] == large), h[starts]
        if key[0] == large:
            heads[0] = its_head
        names = mix64(np.add.reduceat(mix64(h.view(np.uint64) + _A), starts)).view(np.int64)
        cluster = np.repeat(np.where(big, key[starts], names), size)
        held = np.zeros(len(key), bool)
        if batch is not None and not big[-1]:  # the last bucket may go on in the next batch
            held[starts[-1] :] = True
        large, its_head = (int(key[-1]), int(heads[-1])) if big[-1] else (-1, 0)
        go = np.repeat(big | (size > 1), size) & ~held
        if go.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[go]), pa.array(cluster[go]), pa.array(np.repeat(heads, size)[go])], names=["h", "cluster", "head"])
        key, h = key[held], h[held]


def edit_distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Insertions, deletions and replacements between two sequences, by bit vectors (Myers, 1999; Hyyro, 2003)."""
    m = len(a)
    if not m or not len(b):
        return max(m, len(b))
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for x in b:
        eq = where.get(x, 0)
        vertical = eq | minus
        cross = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(cross | plus))
        down = plus & cross
        score += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return score


def edit_similarity(a: Sequence[int], b: Sequence[int]) -> float:
    """One less the word edit distance over the longer line."""
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def most_edits(n: np.ndarray, least: float) -> np.ndarray:
    """The edits that two lines may be apart, the longer of which has n words."""
    return np.floor((1 - least) * n + 1e-9).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two lines' words are similar; what they begin and end with alike needs no edit."""
    n, short = max(len(a), len(b)), min(len(a), len(b))
    most = int(most_edits(np.int64(n), least))
    if n - short > most:
        return False
    begin = a[:short] != b[:short]
    if len(a) == len(b) and begin.sum() <= most:
        return True
    first = int(begin.argmax()) if begin.any() else short
    end = a[::-1][: short - first] != b[::-1][: short - first]
    last = int(end.argmax()) if end.any() else short - first
    if n - first - last <= most:
        return True
    a, b = a[first : len(a) - last].tolist(), b[first : len(b) - last].tolist()
    own, other = set(a), set(b)
    shared = len(own & other) + min(len(a) - len(own), len(b) - len(other))  # words in common at most
    return max(len(a), len(b)) - shared <= most and edit_distance(a, b) <= most


def _pairs(least: float):
    """Rows (h, words, head, other): the pairs (a, b) that are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                (x, i), (y, j) = spelt_words(batch.column(1)), spelt_words(batch.column(3))
                n, m = np.diff(i), np.diff(j)
                long, short = np.maximum(n, m), np.minimum(n, m)
                most = most_edits(long, least)
                # of lines of one length the words that differ in place, which are no fewer than the edits
                own = np.repeat(np.arange(len(n)), short)
                place = np.arange(len(own)) - np.repeat(np.cumsum(short) - short, short)
                differ = np.bincount(own[x[i[:-1][own] + place] != y[j[:-1][own] + place]], minlength=len(n))
                near = (n == m) & (differ <= most)
                likely = ~near & (long - short <= most)
                likely[likely] = (np.bitwise_count(simhash(x, i)[likely] ^ simhash(y, j)[likely])) <= MOST_BITS
                near[[k for k in np.flatnonzero(likely).tolist() if similar(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], least)]] = True
                if near.any():
                    yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in (0, 2)], names=["a", "b"])

    return run


def _verify(least: float):
    """The links between lines of one cluster that are not in one component yet."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).to_numpy()
        order = np.lexsort((column("h"), column("tile")))
        h, tile = column("h")[order], column("tile")[order]
        component = np.unique(column("component")[order], return_inverse=True)[1]
        lo, hi = int(column("lo")[0]), int(column("hi")[0])
        hashes, at = spelt_words(rows.column("words").combine_chunks().take(pa.array(order)))
        sim, n = simhash(hashes, at), np.diff(at)
        first = np.flatnonzero(tile == lo)
        second = first if lo == hi else np.flatnonzero(tile == hi)
        linker, edges = Linker(int(component.max()) + 1), []
        for i in first.tolist():
            others = second[second > i] if lo == hi else second
            others = others[component[others] != component[i]]
            others = others[np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i])]
            bits = np.bitwise_count(sim[others] ^ sim[i])
            for j in others[np.argsort(bits, kind="stable")][: int((bits <= MOST_BITS).sum())].tolist():
                one, other = int(component[i]), int(component[j])
                if linker.top(one) != linker.top(other) and similar(hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]], least):
                    linker.join(one, other)
                    edges.append((i, j))
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], names=["a", "b"])

    return work


def _verify_small(least: float):
    """Rows (low, cluster, h, component, words) sorted so, of clusters of SMALL lines at most: the links between components.

    Clusters are compared many at a time: each line with the next, the one after, and so on within its cluster.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        refused: set[tuple[int, int]] = set()

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cluster, h, component = (rows.column(c).to_numpy() for c in ("cluster", "h", "component"))
            hashes, at = spelt_words(rows.column("words").combine_chunks())
            sim, n = simhash(hashes, at), np.diff(at)
            left, right = [], []
            i, step = np.arange(len(h) - 1), 1
            while len(i):
                i = i[cluster[i] == cluster[i + step]]
                j = i + step
                near = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
                near[near] = np.bitwise_count(sim[i[near]] ^ sim[j[near]]) <= MOST_BITS
                left.append(i[near])
                right.append(j[near])
                step += 1
                i = i[i + step < len(h)]
            if not left:
                return
            i, j = np.concatenate(left), np.concatenate(right)
            order = np.argsort(np.bitwise_count(sim[i] ^ sim[j]), kind="stable")
            found = []
            for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
                one, other = top(int(component[i])), top(int(component[j]))
                pair = (int(h[i]), int(h[j]))
                if one == other or pair in refused:
                    continue
                if similar(hashes[at[i] : at[i + 1]], hashes[at[j] : at[j + 1]], least):
                    above[max(one, other)] = min(one, other)
                    found.append(pair)
                elif len(refused) < REMEMBERED:
                    refused.add(pair)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                cluster = part.column(1).to_numpy()
                other = np.flatnonzero(cluster != cluster[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last cluster may go on
                if cut:
                    yield from links(pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks())
                    held = []
                held.append(part.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held).combine_chunks())

    return run


class Sieve:
    """A Bloom filter over line hashes: what it lets pass may be wanted, what it holds back is not."""

    TIMES = 4
    #: Its size is twelve bits a line within these powers of two, so that at most 128 MB go to the driver and to each executor.
    LEAST_BITS, MOST_BITS = 16, 30

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, wanted: DataFrame, count: int) -> Sieve | None:
        """From a table with column h and so many rows; none if they are too many for it.

        Bits are joined into words on Spark; the driver gets at most 2**(MOST_BITS - 6) words.
        """
        bits = max(cls.LEAST_BITS, math.ceil(math.log2(12 * count + 1)))
        if bits > cls.MOST_BITS:
            return None
        mask = F.lit((1 << bits) - 1)
        places = wanted.select(F.explode(F.array(*[F.shiftrightunsigned("h", 11 * k).bitwiseAND(mask) for k in range(cls.TIMES)])).alias("bit"))
        set_bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
        words = np.zeros(1 << (bits - 6), np.int64)
        rows = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(set_bits).toArrow()
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(words.view(np.uint64), bits)

    def passes(self, h: np.ndarray) -> np.ndarray:
        h, ok = h.view(np.uint64), np.ones(len(h), bool)
        for k in range(self.TIMES):
            bit = (h >> np.uint64(11 * k)) & np.uint64((1 << self.bits) - 1)
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _passing(sieve):
    """The rows (h, words) that pass a broadcast sieve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.value.passes(batch.column(0).to_numpy())))

    return run


def similar_lines(lines: DataFrame, least: float, folder: str | None = None) -> DataFrame:
    """Rows (node, component) for the distinct lines that a similar line exists for.

    lines has h and the words of each line that may have a similar one, once at least. Every line of a bucket is compared with the
    bucket's head, and a pair that many buckets have is compared once: so a large group of near copies costs about one
    comparison a line. In the clusters that this leaves in several components, all pairs of different ones are compared.
    Candidates are not followed from one bucket into the next before their words are compared, so clusters of chance don't
    grow together. Tables between go to `folder`.
    """
    spelt = lines.where("words is not null").select("h", "words")
    dealt = spelt.mapInArrow(_keyed(common_words(spelt)), "key long, h long").repartition("key").sortWithinPartitions("key", "h")
    clusters = stage(dealt.mapInArrow(_bucketed, "h long, cluster long, head long"), folder)
    wanted = clusters.select("h").distinct()
    sieve = Sieve.of(wanted, wanted.count())
    if sieve is not None:
        spelt = spelt.mapInArrow(_passing(lines.sparkSession.sparkContext.broadcast(sieve)), "h long, words binary")
    words = stage(spelt.dropDuplicates(["h"]), folder)
    pairs = clusters.where("h <> head").select("h", "head").distinct()
    both = pairs.join(words, "h").join(words.select(F.col("h").alias("head"), F.col("words").alias("other")), "head")
    links = stage(both.select("h", "words", "head", "other").mapInArrow(_pairs(least), "a long, b long"), folder)

    known = stage(connected_components(links, folder=folder), folder).select(F.col("node").alias("h"), "component")
    rows = clusters.select("h", "cluster").distinct().join(known, "h", "left").select("h", "cluster", F.coalesce("component", "h").alias("component"))
    rows = stage(rows, folder)
    mixed = rows.groupBy("cluster").agg(F.count("*").alias("lines"), F.min("component").alias("low"), F.max("component").alias("high")).where("lines > 2 and low <> high")
    members = rows.join(mixed.select("cluster", "lines", "low"), "cluster").join(words, "h").withColumn("n", (F.length("words") / 4).cast("int"))
    members = stage(members, folder)
    small = members.where(F.col("lines") <= SMALL).select("low", "cluster", "h", "component", "words")
    # clusters of one group lie together, so that what one of them has linked the next needn't compare; a group is salted
    small = small.repartition("low", F.pmod("cluster", F.lit(4))).sortWithinPartitions("low", "cluster", "h")
    tiles = tile_pairs(members.where(F.col("lines") > SMALL), ["cluster"], "h", "n", TILE_WORDS, TILE_ROWS)
    more = small.mapInArrow(_verify_small(least), "a long, b long").union(grouped(tiles, ["cluster", "lo", "hi"], _verify(least), "a long, b long"))
    return connected_components(known.select(F.col("h").alias("a"), F.col("component").alias("b")).union(more), folder=folder)


def repeated_lines(documents: DataFrame, least: float, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, key, extra): the numbers of the lines that go from the texts with this id and hash.

    Of a group of lines the smallest doc_id keeps one (only if none of its texts has an id, one without), the first in
    order of (text hash, line) there.
    """
    keyed = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.lower("text").alias("text"))
    lines = stage(keyed.mapInArrow(_lines(fewest_words(least)), "doc_id long, key long, line int, h long, words binary"), folder)
    distinct = stage(lines.groupBy("h").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")), folder)
    similar = stage(similar_lines(lines, least, folder), folder).withColumnsRenamed({"node": "h", "component": "group"})
    grouped_lines = distinct.join(similar, "h").select("h", "group", "keep")
    keep = grouped_lines.groupBy("group").agg(F.min("keep").alias("keep"))
    fuzzy = grouped_lines.drop("keep").join(keep, "group").select("h", "group", "keep")
    exact = distinct.where("n > 1").join(similar, "h", "left_anti").select("h", F.col("h").alias("group"), "keep")
    decided = fuzzy.union(exact).repartition("keep", "h")
    found = lines.select("doc_id", "key", "line", "h").join(decided, "h")
    found = stage(found.select("doc_id", "key", "line", "group", F.col("doc_id").eqNullSafe(F.col("keep")).alias("here")), folder)
    here = found.where("here")
    first = here.groupBy("group").agg(F.min(F.struct("key", "line")).alias("first"))
    again = here.join(first, "group").where(F.struct("key", "line") != F.col("first"))
    extra = found.where("not here").select("doc_id", "key", "line").union(again.select("doc_id", "key", "line"))
    return extra.groupBy("doc_id", "key").agg(F.collect_set("line").alias("extra"))


def dedup_lines(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """All rows and columns of the table, text without the lines that occur before, and n_lines_removed.

    Lines of equal words (whatever their case, spaces and marks) are one line; a character of a script without spaces is
    a word. Two lines are similar if their word edit similarity is `least` or more, and are found with
    the probability at BANDS; lines connected by similarity are a group, of which the occurrence with the smallest
    (doc_id, text hash, line) stays, one without a doc_id only if none has one. Lines without a word stay, and so does a null text.
    Rows with equal doc_id and text are the same occurrence and keep the same lines. Columns of any other name are carried
    along. An empty table gives no row.
    """
    spark = documents.sparkSession
    folder, kept = new_folder(spark), new_folder(spark)
    extra = repeated_lines(documents, least, folder).withColumnsRenamed({"doc_id": "_extra_id", "key": "_extra_key", "extra": "_extra"})
    extra = stage(extra, kept)
    clear(spark, folder)
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_extra"))
    text = F.when(F.col("_extra").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    same = documents["doc_id"].eqNullSafe(F.col("_extra_id")) & (F.xxhash64(documents["text"]) == F.col("_extra_key"))
    columns = [text.alias(c) if c == "text" else F.col(c) for c in documents.columns]
    # the texts are many and long, the lists short: those are hashed, and no text is sorted
    return documents.join(extra.hint("shuffle_hash"), same, "left").select(*columns, F.coalesce(F.size("_extra"), F.lit(0)).alias("n_lines_removed"))
