"""Lagged correlations of very many series with others, from blocks of the two matrices and sums that add up.

A panel is rows (key, t, value): `t` counts periods from 0, and a missing row is a zero. It is cut into blocks of TALL
periods and about WIDE series; a block meets the block of the other side with the same periods, and what they give are
sums over time, which Spark adds up. So a task holds two blocks, and no series and no pair is ever a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TALL = 256
WIDE = 512
#: Weight on the diagonal of the factors' products.
RIDGE = 1e-3
#: A sum of squares below this is no variation.
FLAT = 1e-12


#: Rows of a right side (keys by blocks of periods) up to which its blocks go to all executors; beyond, blocks are shuffled.
BROADCAST_ROWS = 100_000
#: Blocks of series that lie in one partition.
TOGETHER = 16
#: Pairs of one batch that a task gives out.
BATCH = 1 << 14


def standardised(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values less their key's mean, over its deviation (population) where that isn't 0; flat keys are left out.

    A key has a row a period, so its moments are taken over its rows where they lie, and no row is shuffled again.
    """
    of = Window.partitionBy(*["sb"] * ("sb" in rows.columns), key)
    moments = rows.withColumns({"_m": F.avg(value).over(of), "_s": F.stddev_pop(value).over(of)}).where(F.col("_s") > 0)
    return moments.withColumn(value, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def dealt(rows: DataFrame, key: str, wide: int = WIDE) -> DataFrame:
    """The rows with column sb, about `wide` keys each, shuffled by it once; a group of (sb, key) or (sb, tb) stays in its partition.

    There are more partitions the more keys there are, so that a task holds no more of a larger table.
    """
    parts = max(1, -(-(rows.agg(F.approx_count_distinct(key).alias("n")).first()["n"] or 0) // wide))
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // TOGETHER)
    return rows.withColumn("sb", F.pmod(F.xxhash64(key), F.lit(parts))).repartition(partitions, "sb")


def _blocks(rows: DataFrame, keys: int, tall: int, wide: int, halo: int = 0) -> DataFrame:
    """(tb, sb, keys, cells): dense blocks, column by column; with `halo` each also holds that many periods before its own.

    Rows that have a column sb are cut by it.
    """
    kind = rows.schema["key"].dataType.simpleString()
    parts = max(1, -(-keys // wide))
    tb = F.floor(F.col("t") / tall).cast("long")
    if halo:  # the last periods of a block are the first of the next block's halo, and so on
        tb = F.explode(F.sequence(tb, F.floor((F.col("t") + halo) / tall).cast("long")))
    sb = F.col("sb") if "sb" in rows.columns else F.pmod(F.xxhash64("key"), F.lit(parts))
    cut = rows.select("key", "t", "value", tb.alias("tb"), sb.alias("sb"))

    def dense(group: pa.Table) -> pa.Table:
        at = group.column("key").combine_chunks().dictionary_encode()
        first = group.column("tb")[0].as_py() * tall - halo
        cells = np.zeros((tall + halo, len(at.dictionary)))
        np.add.at(cells, (group.column("t").to_numpy() - first, at.indices.to_numpy()), group.column("value").to_numpy())
        return pa.table({"tb": group.column("tb")[:1], "sb": group.column("sb")[:1], "keys": pa.array([at.dictionary.to_pylist()], pa.list_(at.dictionary.type)), "cells": pa.array([cells.tobytes()])})

    return cut.groupBy("tb", "sb").applyInArrow(dense, f"tb long, sb long, keys array<{kind}>, cells binary")


def _products(a: DataFrame, b: DataFrame, lags: int, periods: int, tall: int, few: bool, factors: np.ndarray | None = None) -> DataFrame:
    """(key, other, x_0, xx_0, xy_0, ...): one row a pair that meets, with the sums of each lag in columns.

    a, b: _blocks() of left and (with lags - 1 as halo) of right. x and xx are sums of left and its squares from period `lag` on, and
    xf<k>_<lag> those of left times the k-th factor (columns of `factors`, a row a period). Where all periods are one block every
    pair meets once and nothing is shuffled; `few` sends the blocks of right to all executors.
    """
    a, b = a.select("tb", "keys", "cells"), b.select("tb", F.col("keys").alias("others"), F.col("cells").alias("other_cells"))
    kinds = a.schema["keys"].dataType.elementType.simpleString(), b.schema["others"].dataType.elementType.simpleString()
    size = 0 if factors is None else factors.shape[1]
    names = [f"{k}_{lag}" for lag in range(lags) for k in ("x", "xx", *[f"xf{i}" for i in range(size)], "xy")]

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, others = batch.column(1)[k].values, batch.column(3)[k].values
                x = np.frombuffer(batch.column(2)[k].as_buffer()).reshape(tall, len(keys))
                y = np.frombuffer(batch.column(4)[k].as_buffer()).reshape(tall + lags - 1, len(others))
                first = batch.column(0)[k].as_py() * tall
                f = np.zeros((tall, size))
                if size:
                    held = factors[first : first + tall]
                    f[: len(held)] = held
                step, count = max(1, BATCH // len(others)), len(others)
                for low in range(0, len(keys), step):
                    part = x[:, low : low + step]
                    n = part.shape[1]
                    sums = []
                    for lag in range(lags):
                        later = part[max(lag - first, 0) :]
                        own = [later.sum(0), (later * later).sum(0), *(later.T @ f[max(lag - first, 0) :]).T]
                        sums += [pa.array(np.repeat(v, count)) for v in own] + [pa.array((part.T @ y[lags - 1 - lag : lags - 1 - lag + tall]).ravel())]
                    one, two = np.repeat(np.arange(low, low + n, dtype=np.int32), count), np.tile(np.arange(count, dtype=np.int32), n)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(one)), others.take(pa.array(two)), *sums], ["key", "other", *names])

    met = a.join(F.broadcast(b) if few else b, "tb")
    found = met.mapInArrow(multiply, f"key {kinds[0]}, other {kinds[1]}, " + ", ".join(f"{c} double" for c in names))
    return found if periods <= tall else found.groupBy("key", "other").agg(*[F.sum(c).alias(c) for c in names])


def _tails(rows: DataFrame, lags: int, periods: int) -> DataFrame:
    """(key, y_0, yy_0, ...): sums of values and of their squares over the periods up to `lag` before the end."""
    sums = {"y": F.col("value"), "yy": F.col("value") * F.col("value")}
    return rows.groupBy("key").agg(*[F.sum(F.when(F.col("t") < periods - lag, c).otherwise(0.0)).alias(f"{k}_{lag}") for lag in range(lags) for k, c in sums.items()])


def _correlation(n: Column, xy: Column, x: Column, xx: Column, y: Column, yy: Column) -> Column:
    vx, vy = xx - x * x / n, yy - y * y / n
    return F.when((vx > FLAT) & (vy > FLAT), (xy - x * y / n) / F.sqrt(vx * vy))


def lagged_correlations(left: DataFrame, right: DataFrame, lags: int, periods: int, factors: Sequence[str] = (), ridge: float = RIDGE, tall: int = TALL, wide: int = WIDE) -> DataFrame:
    """(key, other, lag, n, r): correlation of left(t) with right(t - lag) over the n periods that both have, null if either is flat.

    With `factors` (keys of `right`, few), left is first freed of them: its ridge regression on the factors, standardised
    over all periods, is subtracted. The residuals are never made: their sums follow from those of left, of the
    factors and of right. What comes to the driver is the factors, a row a period. A left that is dealt() already isn't shuffled again.
    """
    n_left = 0 if "sb" in left.columns else left.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    n_right = right.select("key").distinct().count()
    blocks = -(-periods // tall)
    few = n_right * blocks <= BROADCAST_ROWS
    # a zero in every block of periods, so that each pair meets
    zeros = right.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).select("key", (F.col("_b") * tall).cast(right.schema["t"].dataType).alias("t"), F.lit(0.0).alias("value"))
    a, b = _blocks(left, n_left, tall, wide), _blocks(right.select("key", "t", "value").unionAll(zeros), n_right, tall, wide, lags - 1)
    f = _factor_rows(right, factors, periods) if factors else None
    other = _tails(right, lags, periods).withColumnRenamed("key", "other")
    size = len(factors)
    c = F.col
    at = lambda name, lag: c(f"{name}_{lag}")
    if factors:
        # sums of the factors alone, and of the factors with right, for every lag
        alone = [(f[lag:].sum(0), f[lag:].T @ f[lag:]) for lag in range(lags)]
        inverse = np.linalg.inv(f.T @ f + ridge * np.eye(size))
        spark = right.sparkSession
        as_rows = spark.createDataFrame([(t, *map(float, f[t])) for t in range(periods)], "_ft long, " + ", ".join(f"f{k} double" for k in range(size)))
        moved = right.select("key", "value", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"), "t").withColumn("_ft", (c("t") + c("lag")).cast("long"))
        with_right = moved.join(F.broadcast(as_rows), "_ft").groupBy(c("key").alias("other")).agg(*[F.sum(F.when(c("lag") == lag, c("value") * c(f"f{k}")).otherwise(0.0)).alias(f"yf{k}_{lag}") for lag in range(lags) for k in range(size)])
        other = other.join(with_right, "other", "left").fillna(0.0)
    pairs = _products(a, b, lags, periods, tall, few, f).join(F.broadcast(other) if few else other, "other")
    # one coefficient a factor and series, from the sums over all periods
    betas = [sum((at(f"xf{j}", 0) * float(inverse[i, j]) for j in range(size)), F.lit(0.0)).alias(f"b{i}") for i in range(size)]
    if betas:
        pairs = pairs.select("*", *betas)
    rows = []
    for lag in range(lags):
        x, xx, xy = at("x", lag), at("xx", lag), at("xy", lag)
        for i in range(size):
            xx = xx - 2 * c(f"b{i}") * at(f"xf{i}", lag) + sum((c(f"b{i}") * c(f"b{j}") * float(alone[lag][1][i, j]) for j in range(size)), F.lit(0.0))
            x, xy = x - c(f"b{i}") * float(alone[lag][0][i]), xy - c(f"b{i}") * at(f"yf{i}", lag)
        n = F.lit(periods - lag)
        rows.append(F.struct(F.lit(lag).alias("lag"), n.alias("n"), _correlation(n, xy, x, xx, at("y", lag), at("yy", lag)).alias("r")))
    return pairs.select("key", "other", F.inline(F.array(*rows)))


def _factor_rows(right: DataFrame, factors: Sequence[str], periods: int) -> np.ndarray:
    """A row for every period, a column a factor: less its mean, over its deviation; a period without a row counts 0."""
    chosen = right.where(F.col("key").isin(list(factors))).groupBy("t").agg(*[F.sum(F.when(F.col("key") == f, F.col("value")).otherwise(0.0)) for f in factors])
    rows = np.zeros((periods, len(factors)))
    for t, *values in chosen.collect():
        rows[t] = values
    spread = rows.std(0)
    return (rows - rows.mean(0)) / np.where(spread > 0, spread, 1.0)


# ---- chance


def draw(seed: int, *parts: Column | str) -> Column:
    """A whole number below 2^32 that only the seed and the parts decide: the same on any machine, in any order."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


def draws(spark, n: int) -> DataFrame:
    """One row a draw."""
    return spark.range(n).select(F.col("id").alias("draw"))


def circular_shifts(right: DataFrame, periods: int, n: int, seed: int) -> DataFrame:
    """(draw, key, t, value): right moved along by one shift a draw, from 1 to periods - 1, the same for all its keys."""
    moved = draws(right.sparkSession, n).withColumn("shift", 1 + draw(seed, "draw") % (periods - 1))
    return right.crossJoin(F.broadcast(moved)).select("draw", "key", ((F.col("t") + F.col("shift")) % periods).alias("t"), "value")


def shift_null(left: DataFrame, right: DataFrame, periods: int, n: int, seed: int) -> DataFrame:
    """(draw, most): the greatest absolute correlation of any pair after each shift of `right` against `left`."""
    shifted = circular_shifts(right, periods, n, seed).select(F.concat_ws(":", "draw", "key").alias("key"), "t", "value")
    r = lagged_correlations(left, shifted, 1, periods)
    return r.groupBy(F.split_part("other", F.lit(":"), F.lit(1)).cast("long").alias("draw")).agg(F.max(F.abs("r")).alias("most"))


def block_bootstrap(rows: DataFrame, periods: int, length: int, n: int, seed: int) -> DataFrame:
    """(draw, key, mean): means of each series over `n` resamples of circular blocks of `length` periods.

    rows: (key, t, value), one a period. The place of a resample is decided by draw and block alone, so a resample is a
    count of how often it holds each period, joined with the rows; partial sums are added up.
    """
    spark = rows.sparkSession
    blocks_of = spark.range(-(-periods // length)).select(F.col("id").alias("block"))
    starts = draws(spark, n).crossJoin(F.broadcast(blocks_of)).withColumn("first", draw(seed, "draw", "block") % periods)
    within = F.explode(F.sequence(F.lit(0), F.least(F.lit(length), periods - F.col("block") * length).cast("int") - 1))
    taken = starts.select("draw", (F.col("first")).alias("first"), within.alias("k")).select("draw", ((F.col("first") + F.col("k")) % periods).alias("t"))
    weights = taken.groupBy("draw", "t").agg(F.count("*").alias("w"))
    return rows.join(weights, "t").groupBy("draw", "key").agg((F.sum(F.col("value") * F.col("w")) / periods).alias("mean"))


def permutation_p(rows: DataFrame, group: str, value: str, n: int, seed: int) -> DataFrame:
    """(observed, n_draws, p): the difference of means between marked and other rows, and how often labels dealt anew differ as much.

    rows: (id, group (boolean), value). A draw gives every row a number; rows are marked where theirs is below the share of
    marked rows, so that no draw sorts or numbers the rows.
    """
    size = rows.agg(F.avg(F.col(group).cast("double")).alias("share"), (F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("d")).first()
    if size["d"] is None:
        return rows.sparkSession.createDataFrame([], "observed double, n_draws long, p double")
    # eight hexadecimal digits are below a number as they are below its own digits; beyond all of them is all of ":"
    bound = math.ceil(size["share"] * float(1 << 32))
    digits = f"{bound:08x}" if bound < 1 << 32 else ":"
    hashed = F.md5(F.concat(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":")), F.col("_id")))
    named = rows.select(group, value, F.col("id").cast("string").alias("_id"))
    dealt = named.crossJoin(F.broadcast(draws(rows.sparkSession, n))).withColumn("_in", hashed < F.lit(digits))
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    by_draw = dealt.groupBy("draw").agg((mean(F.col("_in")) - mean(~F.col("_in"))).alias("d"))
    as_much = F.count_if(F.abs("d") >= abs(size["d"]) - FLAT)
    return by_draw.agg(F.lit(float(size["d"])).alias("observed"), F.count("d").alias("n_draws"), ((1 + as_much) / (1 + F.count("d"))).alias("p"))
