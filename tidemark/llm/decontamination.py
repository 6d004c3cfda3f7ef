"""Benchmark decontamination by spaced-seed hashing; SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, once

#: Masks of weight four for items of LONG tokens and more: 1 is hashed, 0 may differ. With half of its tokens replaced, an item
#: of 20 tokens keeps one of them whole somewhere with probability 0.92, one of 30 tokens nearly always.
MASKS = ("1111", "110101", "1100101", "1010011")
#: Masks of weight three for shorter items: all that three tokens within six can be. There are few such items, so few places are hashed.
SHORT_MASKS = ("111", "1101", "1011", "11001", "10011", "10101", "110001", "100011", "101001", "100101")
LONG = 20
#: Items of fewer tokens are sought whole and unaltered; of others so many tokens have to be met at least.
LEAST_TOKENS = 3
#: Share of an item's tokens that a document repeats at the same distances from the hit.
LEAST_OVERLAP = 0.5
#: A stretch of an item that is enough by itself, and how many of its tokens have to be met.
PASSAGE, LEAST_OF_PASSAGE = 24, 20
#: Most bytes of a side that is sent to all executors; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bits of the maps of wanted tokens and seeds, as powers of two. Fuller maps let more pass, and lose nothing.
LEAST_BITS, MOST_BITS = 12, 22


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_key(name: str, h: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(name), *[F.get(h, at + i) for i, c in enumerate(mask) if c == "1"])


class BitMap:
    """Which of the hashes of a table's column may be there, as a constant of bounded size."""

    def __init__(self, df: DataFrame, column: str):
        distinct = df.select(F.col(column).alias("h")).distinct()
        self.bits = min(max(LEAST_BITS, math.ceil(math.log2(16 * distinct.count() + 1))), MOST_BITS)
        mask = F.lit((1 << self.bits) - 1)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
        rows = distinct.groupBy(F.shiftright(F.col("h").bitwiseAND(mask), 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
        words = [0] * (1 << (self.bits - 6))
        for r in rows:
            words[r["word"]] = r["bits"]
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one constant

    def holds(self, h: Column) -> Column:
        place = F.shiftright(h.bitwiseAND(F.lit((1 << self.bits) - 1)), 6).cast("int")
        return F.bit_get(F.get(self.words, place), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def item_seeds(items: DataFrame) -> DataFrame:
    """Rows (item_id, key, item_at): the seeds of all masks at all places, or the whole of a short item."""
    size = F.size("h")

    def seeds(name: str, mask: str, fits: Column) -> DataFrame:
        starts = F.explode(F.sequence(F.lit(0), size - len(mask))).alias("item_at")
        return items.where(fits).select("item_id", "h", starts).select("item_id", seed_key(name, F.col("h"), F.col("item_at"), mask).alias("key"), "item_at")

    found = [seeds(mask, mask, size >= LONG) for mask in MASKS]
    found += [seeds(mask, mask, (size < LONG) & (size >= max(LEAST_TOKENS, len(mask)))) for mask in SHORT_MASKS]
    found += [seeds(f"whole{n}", "1" * n, size == n) for n in range(1, LEAST_TOKENS)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def document_seeds(wanted_seeds: BitMap, short: list[int]) -> tuple[Column, Column]:
    """The places whose token is wanted, and an array of (key, at) for them; from arrays h (hashed tokens), f and g (which are wanted).

    A place counts for a mask if all tokens under it are wanted, and then if the seed is: so few are hashed. f are the tokens of
    all items, g those of items shorter than LONG, whose masks only go over the places of g.
    """
    none = F.expr("cast(array() as array<struct<key:bigint,at:int>>)")
    starts = F.filter(F.sequence(F.lit(0), F.size("f") - 1), lambda at: F.get("f", at))

    def found(name: str, mask: str, starts: str = "starts", flags: str = "f") -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"][1:]
        places = F.col(starts)
        if kept:
            def whole(at: Column) -> Column:
                fits = F.coalesce(F.get(flags, at + kept[0]), F.lit(False))
                for i in kept[1:]:
                    fits = fits & F.coalesce(F.get(flags, at + i), F.lit(False))
                return fits

            places = F.filter(places, whole)
        return F.transform(places, lambda at: F.struct(seed_key(name, F.col("h"), at, mask).alias("key"), at.alias("at")))

    masks = [(mask, mask) for mask in MASKS] + [(f"whole{n}", "1" * n) for n in short if n < LEAST_TOKENS]
    if any(n >= LEAST_TOKENS for n in short):
        masks += [(mask, mask, "short_starts", "g") for mask in SHORT_MASKS]
    # the map is asked once for all masks: each place where it stands is a copy of the constant, in plans, their texts and tasks
    return starts, F.filter(F.concat(none, *[found(*m) for m in masks]), lambda s: wanted_seeds.holds(s["key"]))


def _within(df: DataFrame, row_bytes: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """The side as one to broadcast if its rows are summed to be small, else as it is."""
    total = df.agg(F.sum(row_bytes).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if total <= most else df


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Rows (doc_id, item_id, overlap, start, item_tokens) for documents that hold a benchmark item.

    start is the token of the document where the item's first would stand. The seeds of the items are
    joined with those of every document at every token; each hit lines both up, and the overlap is the share of the item's
    tokens found at their places, so single tokens may be replaced. It has to reach `least` and LEAST_TOKENS
    tokens, or LEAST_OF_PASSAGE of some PASSAGE tokens of the item in a row. The same holds for items of any length from three tokens on. Only the best start is returned (of equal ones the first). Items below
    LEAST_TOKENS tokens are found unaltered only; those without a token and null texts match nothing. Rows of one doc_id
    count as one document; a null doc_id or item_id is kept as such. Empty tables give no row.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = checkpoint(items.withColumn("h", hashed("item")))
    sought = checkpoint(item_seeds(items))
    wanted = BitMap(items.select(F.explode("h").alias("h")), "h"), BitMap(sought, "key")
    short = sorted(r["n"] for r in items.select(F.size("h").alias("n")).where(F.col("n") < LONG).distinct().collect())
    in_short = BitMap(items.where(F.size("h") < LONG).select(F.explode("h").alias("h")), "h") if short else None
    starts, seeds = document_seeds(wanted[1], short)
    scanned = (
        documents.select("doc_id", tokens(F.col("text")).alias("words"))
        .select("doc_id", hashed("words").alias("h"))
        .where(F.size("h") > 0)
        .select("doc_id", "h", F.transform("h", wanted[0].holds).alias("f"), (F.transform("h", in_short.holds) if short else F.lit(None)).alias("g"))
        .select("doc_id", "h", "f", "g", starts.alias("starts"))
        .select("doc_id", "h", "f", "g", "starts", (F.filter("starts", lambda at: F.get("g", at)) if short else F.lit(None)).alias("short_starts"))
        .select("doc_id", once(seeds).alias("seeds"))
        .select("doc_id", F.explode("seeds").alias("seed"))
    )
    hits = (
        scanned.select("doc_id", "seed.key", "seed.at")
        .join(_within(sought, F.lit(32)), "key")
        .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start"))
        .distinct()
    )
    return _verified(documents, items.drop("h"), hits, least)


def _verified(documents: DataFrame, items: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    hits = checkpoint(hits)
    suspects = hits.select(F.col("doc_id").alias("suspect")).distinct()
    words = (
        documents.select("doc_id", "text")
        .join(_within(suspects, F.lit(16)), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
        .select("doc_id", tokens(F.col("text")).alias("words"))
    )
    spelt = F.octet_length(F.array_join("item", " ")) + 16 * F.size("item")
    lined = hits.withColumnsRenamed({"doc_id": "suspect", "item_id": "hit"}).join(_within(items, spelt), F.col("hit").eqNullSafe(F.col("item_id")))
    met = F.transform("item", lambda w, i: F.coalesce((F.get("words", F.col("start") + i) == w).cast("int"), F.lit(0)))
    count = lambda flags: F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    stretches = F.transform(F.sequence(F.lit(1), F.size("met") - PASSAGE + 1), lambda a: count(F.slice("met", a, PASSAGE)))
    common, size = count("met"), F.size("met")
    enough = (common >= least * size) & (common >= F.least(size, F.lit(LEAST_TOKENS)))
    passage = F.when(size >= PASSAGE, F.array_max(stretches) >= LEAST_OF_PASSAGE).otherwise(F.lit(False))
    return (
        words.join(lined, F.col("doc_id").eqNullSafe(F.col("suspect")))
        .select("doc_id", "item_id", "start", met.alias("met"))
        .where(enough | passage)
        .select("doc_id", "item_id", "start", (common / size).alias("overlap"), size.alias("item_tokens"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("overlap", (-F.col("start")).alias("back"), "item_tokens")).alias("best"))
        .select("doc_id", "item_id", F.round("best.overlap", 6).alias("overlap"), (-F.col("best.back")).alias("start"), "best.item_tokens")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """The documents that hold no benchmark item, with all columns."""
    leaks = checkpoint(contaminated(documents, benchmark, least).select(F.col("doc_id").alias("_leak")).distinct())
    return documents.join(_within(leaks, F.lit(16)), F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")
