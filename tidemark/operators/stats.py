"""Statistics of factors, events and strategies."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged
from .quantiles import average_ranks, exact_quantiles, looked_up
from .relational import quantile_cut


#: Parts that the range between a group's percentiles is cut into, so that sums over it are exact whatever the order of rows.
PARTS = 2**45


def winsor_z(rows: DataFrame, by: Sequence[str], value: str, tail: float = 0.01) -> DataFrame:
    """Values held within the tail percentiles of their group, then as z-scores in column z; a null stays null.

    The percentiles are aggregated and joined, not windowed, so a group may be of any size. Mean and deviation come from whole numbers, the
    place of each value between the percentiles in PARTS: their sums are the same in any order, and so is every digit of z.
    """
    edges = exact_quantiles(rows, by, value, [tail, 1 - tail]).select(*by, F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi"))
    held = rows.join(edges, list(by)).withColumn("_x", F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo"))))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS + 0.5)).cast("decimal(18,0)")
    sums = held.groupBy(*by).agg(F.count(place).cast("double").alias("_n"), F.sum(place).cast("double").alias("_s1"), F.sum(place * place).cast("double").alias("_s2"))
    held = held.join(sums, list(by))
    mean = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_s1") / F.col("_n") / PARTS)
    variance = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1)
    deviation = F.when((F.col("_n") > 1) & (variance > 0), (F.col("_hi") - F.col("_lo")) * (F.sqrt(variance) / PARTS))
    return held.withColumn("z", (F.col("_x") - mean) / deviation).drop("_lo", "_hi", "_x", "_n", "_s1", "_s2")


def rank_ic(rows: DataFrame, by: Sequence[str], factor: str, target: str, least: int = 20) -> DataFrame:
    """Rank correlation of a factor with a target in each group that has enough pairs and more than two values of each."""
    both = staged(rows.where(F.col(factor).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(factor).alias("_a"), F.col(target).alias("_b")))
    ends = looked_up(both.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("_a", "_b") for n, f in (("lo", F.min), ("hi", F.max))]))
    ranked = average_ranks(staged(average_ranks(both, by, "_a", "_f")), by, "_b", "_t").join(ends, list(by))
    # a third value lies between the least and the greatest
    between = lambda c: F.count_if((F.col(c) > F.col(f"{c}_lo")) & (F.col(c) < F.col(f"{c}_hi")))
    r = ranked.groupBy(*by).agg(F.corr("_f", "_t").alias("ic"), F.count("*").alias("n"), between("_a").alias("_u"), between("_b").alias("_v"))
    return r.where((F.col("n") >= least) & (F.col("_u") > 0) & (F.col("_v") > 0)).drop("_u", "_v")


def quantile_spread(rows: DataFrame, by: Sequence[str], factor: str, target: str, parts: int = 5) -> DataFrame:
    """Mean target of the top value range less that of the bottom one."""
    both = staged(rows.where(F.col(factor).isNotNull() & F.col(target).isNotNull()).select(*by, factor, target))
    means = quantile_cut(both, by, factor, parts, "_part").groupBy(*by, "_part").agg(F.avg(target).alias("_mean"))
    return means.groupBy(*by).agg((F.max_by("_mean", "_part") - F.max(F.when(F.col("_part") == 1, F.col("_mean")))).alias("spread"))


def hac_t(values: Column, lags: int) -> Column:
    """t of the mean of an ordered array with Bartlett weights (Newey and West) over so many lags."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = total / n
    dev = F.transform(values, lambda v: v - mean)

    def cross(k: int) -> Column:
        pairs = F.zip_with(F.slice(dev, 1, F.greatest(n - k, F.lit(0))), F.slice(dev, k + 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / n

    var = cross(0)
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * cross(k)
    return F.when((n > lags + 1) & (var > 0), mean / F.sqrt(var / n))


def benjamini_hochberg(rows: DataFrame, p: str, name: str = "q") -> DataFrame:
    """False-discovery rate of a set of tests; a test without a p counts as 1.

    A set of registered tests is small; it is ranked in one window.
    """
    filled = rows.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    order = Window.orderBy("_p")
    raw = filled.withColumn("_r", F.col("_p") * F.count("*").over(Window.partitionBy(F.lit(0))) / F.row_number().over(order))
    return raw.withColumn(name, F.least(F.min("_r").over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_p", "_r")


def clustered_mean(rows: DataFrame, by: Sequence[str], cluster: str, value: str) -> DataFrame:
    """Mean with the standard error of a sandwich over clusters: by clusters first, so that no row meets another."""
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = sums.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("s") / F.col("n")
    spread = F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn")
    se = F.when(F.col("g") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) * F.col("g") / (F.col("g") - 1)) / F.col("n"))
    return whole.select(*by, mean.alias("mean"), se.alias("se"), F.try_divide(mean, F.when(se > 0, se)).alias("t"), "n", F.col("g").alias("clusters"))


def cross_section(rows: DataFrame, by: str, factors: Sequence[str], target: str, least: int = 20) -> DataFrame:
    """Coefficients of an OLS of target on factors in each cross-section: rows (by, factor, coefficient, n).

    Normal equations are sums, so each group is folded to a (k+1) square before Python solves it.
    """
    names = ["const", *factors]
    x = {"const": F.lit(1.0), **{f: F.col(f).cast("double") for f in factors}}
    y = F.col(target).cast("double")
    complete = rows.where(" and ".join(f"{c} is not null" for c in [*factors, target]))
    sums = {f"xx_{i}_{j}": F.sum(x[a] * x[b]) for i, a in enumerate(names) for j, b in enumerate(names) if j >= i} | {f"xy_{i}": F.sum(x[a] * y) for i, a in enumerate(names)}
    folded = complete.groupBy(by).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()]).where(F.col("n") >= least)
    kind = complete.schema[by].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
                b = np.array([r[f"xy_{i}"] for i in range(len(names))])
                beta = np.linalg.lstsq(a, b, rcond=None)[0]
                out += [(r[by], f, float(v), int(r["n"])) for f, v in zip(names, beta, strict=True)]
            yield pd.DataFrame(out, columns=[by, "factor", "coefficient", "n"])

    return folded.mapInPandas(solve, f"{by} {kind}, factor string, coefficient double, n long")


def student_p(t: str, df: str):
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([_beta(n / (n + v * v), n / 2, 0.5) if n > 0 and v == v else None for v, n in zip(ts, ns, strict=True)], dtype="float64")

    return p(F.col(t), F.col(df))


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's method."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + step * d, 1e-300) if 1 + step * d > 0 else 1 / min(1 + step * d, -1e-300)
        c = 1 + step / c
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def dealt_means(rows: DataFrame, by: str, order: Sequence[str], signal: str, value: str, seeds: Sequence[int]) -> DataFrame:
    """(seed, mean, n): the mean value of the rows whose signal is above zero, with the values dealt anew within each group.

    The k-th row by `order` gets the value of the k-th row by md5 of seed and `order`. A row is shuffled once, whatever the number of
    seeds: a group is dealt in its task, which holds two columns of it and sixteen bytes of hash a row.
    """
    # the empty text brings the colon after the seed
    given = rows.select(by, *order, F.col(signal).cast("double").alias("_s"), F.col(value).cast("double").alias("_v"), F.concat_ws(":", F.lit(""), *order).cast("binary").alias("_tail"))

    def deal(group: pa.Table) -> pa.Table:
        first = pc.sort_indices(group, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
        at = lambda c: group.column(c).take(first)
        s, v, tails = at("_s").to_numpy(), at("_v").to_numpy(), at("_tail").to_pylist()
        above = (s > 0) | np.isnan(s)  # Spark has NaN above all numbers
        sums = []
        for seed in seeds:
            head = str(seed).encode()
            keys = np.frombuffer(b"".join([md5(head + t).digest() for t in tails]), ">u8").astype(np.uint64).reshape(-1, 2)
            sums.append(float(v[np.lexsort((keys[:, 1], keys[:, 0]))][above].sum()))
        k = len(seeds)
        return pa.table({"seed": pa.array(seeds, pa.int64()), "total": pa.array(sums, pa.float64()), "hits": pa.array([int(above.sum())] * k, pa.int64()), "n": pa.array([len(v)] * k, pa.int64())})

    dealt = given.groupBy(by).applyInArrow(deal, "seed long, total double, hits long, n long")
    mean = F.try_divide(F.sum("total"), F.sum("hits"))
    return dealt.groupBy("seed").agg(mean.alias("mean"), F.sum("n").alias("n"))
