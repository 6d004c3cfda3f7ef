"""Sparse combinations of factors, chosen step by step and scored on the next period, from folded sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most factors of a combination, what a further one must add, the least of a candidate, and how many are tried.
STEPS, GAIN, FLOOR, POOL = 6, 0.005, 0.02, 8
FLAT = 1e-12


def fold(rows: DataFrame, group: str, period: str, factors: Sequence[str], target: str, least: int) -> DataFrame:
    """(group, period, n, sums, squares): the sums of factors and target, and those of all their products, of each cross-section.

    Rows that lack any of them are left out, and so are cross-sections of fewer than `least`. This is the one reading of the panel.
    """
    names = [*factors, target]
    x = [F.col(c).cast("double") for c in names]
    whole = rows.where(" and ".join(f"{c} is not null" for c in [group, period, *names]))
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    squares = [F.sum(a * b).alias(f"q{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x[i:], i)]
    folded = whole.groupBy(group, period).agg(F.count("*").alias("n"), *sums, *squares).where(F.col("n") >= least)
    size = len(names)
    return folded.select(
        F.col(group).alias("grp"), F.col(period).alias("period"), "n", F.array(*[f"s{i}" for i in range(size)]).alias("sums"),
        F.array(*[f"q{min(i, j)}_{max(i, j)}" for i in range(size) for j in range(size)]).alias("squares"),
    )


def correlations(n: float, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The correlation matrix that sums stand for; not a number where a column is flat."""
    c = squares - np.outer(sums, sums) / n
    d = np.sqrt(np.where(np.diag(c) > FLAT * n, np.diag(c), np.nan))
    return c / np.outer(d, d)


def score(r: np.ndarray, signs: dict[int, int]) -> float:
    """Correlation of the target (last) with the signed sum of standardised factors; factors that are flat here are passed over."""
    s = np.zeros(len(r) - 1)
    for f, sign in signs.items():
        if np.isfinite(r[f, f]):
            s[f] = sign
    used = np.flatnonzero(s)
    if not len(used) or not np.isfinite(r[-1, -1]):
        return float("nan")
    spread = s[used] @ r[np.ix_(used, used)] @ s[used]
    return float(s[used] @ r[used, -1] / np.sqrt(spread)) if spread > FLAT else float("nan")


def _mean(values: list[float], least: int = 1) -> float:
    kept = [v for v in values if np.isfinite(v)]
    return float(np.mean(kept)) if len(kept) >= least else float("nan")


def candidates(alone: list[float]) -> dict[int, float]:
    """The factors to try: those whose own correlation reaches FLOOR, else the best; never more than POOL."""
    known = {f: v for f, v in enumerate(alone) if np.isfinite(v)}
    good = {f: v for f, v in known.items() if abs(v) >= FLOOR}
    pool = good if len(good) >= 3 else known
    return dict(sorted(pool.items(), key=lambda fv: (-abs(fv[1]), fv[0]))[:POOL])


def choose(views: list[np.ndarray], pool: dict[int, float]) -> tuple[dict[int, int], float]:
    """Adds the factor that raises the mean score most, in the direction of its own correlation, while it rises by GAIN."""
    signs: dict[int, int] = {}
    best = 0.0
    for _ in range(STEPS):
        tried = [(_mean([score(r, {**signs, f: 1 if v > 0 else -1}) for r in views]), -f) for f, v in pool.items() if f not in signs]
        tried = [t for t in tried if np.isfinite(t[0]) and t[0] > best + GAIN]
        if not tried:
            break
        best, f = max(tried)
        signs[-f] = 1 if pool[-f] > 0 else -1
    return signs, best


def walk_forward(folded: DataFrame, factors: Sequence[str], window: int | None, least: int, pooled: bool = False) -> DataFrame:
    """(grp, period, n_train, chosen, train_score, test_score, equal_score): for each period, the combination of the periods before it.

    `window` periods are looked back on, or all; fewer than `least` give no row. The score is the mean of the periods' own, or with
    `pooled` that of all their rows together, whose sums are differences of running ones. equal_score is that of all factors
    alike, each in its own direction. A group comes to its task as its folded periods, which the calendar bounds.
    """
    size = len(factors) + 1

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period", kind="stable").reset_index(drop=True)
        n = rows["n"].to_numpy(np.float64)
        sums = np.stack(rows["sums"].to_list())
        squares = np.stack(rows["squares"].to_list()).reshape(-1, size, size)
        own = [correlations(n[k], sums[k], squares[k]) for k in range(len(rows))]
        upto = [np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)]) for a in (n, sums, squares)]
        out = []
        for t in range(len(rows)):
            a = 0 if window is None else max(0, t - window)
            if t - a < least:
                continue
            views = [correlations(*(u[t] - u[a] for u in upto))] if pooled else own[a:t]
            alone = [_mean([r[f, -1] for r in views], 1 if pooled else least) for f in range(size - 1)]
            signs, train = choose(views, candidates(alone))
            if signs:
                told = ";".join(f"{factors[f]}:{s:+d}" for f, s in signs.items())
                equal = {f: 1 if v > 0 else -1 for f, v in enumerate(alone) if np.isfinite(v)}
                out.append((key[0], rows["period"][t], t - a, told, train, score(own[t], signs), score(own[t], equal)))
        return pd.DataFrame(out, columns=["grp", "period", "n_train", "chosen", "train_score", "test_score", "equal_score"])

    kinds = {f.name: f.dataType.simpleString() for f in folded.schema.fields}
    return folded.groupBy("grp").applyInPandas(run, f"grp {kinds['grp']}, period {kinds['period']}, n_train long, chosen string, train_score double, test_score double, equal_score double")


def combined(walk: DataFrame) -> DataFrame:
    """(grp, periods, factors, test_mean, equal_mean, better): how each group's walk went, and all groups' as grp null."""
    n = F.size(F.split("chosen", ";"))
    sums = [F.count("*").alias("periods"), F.avg(n).alias("factors"), F.avg("test_score").alias("test_mean"), F.avg("equal_score").alias("equal_mean"), F.avg((F.col("test_score") > F.col("equal_score")).cast("double")).alias("better")]
    return walk.groupBy("grp").agg(*sums).unionByName(walk.agg(*sums).withColumn("grp", F.lit(None).cast(walk.schema["grp"].dataType)))
