"""Daily screens: lens scores, their ensemble, gates and ranks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the four lenses by regime.
NORMAL = {"flow": 0.45, "fundamental": 0.35, "smart": 0.2, "moat": 0.0}
CRISIS = {"flow": 0.25, "fundamental": 0.25, "smart": 0.3, "moat": 0.2}


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 over the table, a constant one to 0.5; the extremes are one broadcast row."""
    ends = rows.agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = rows.crossJoin(F.broadcast(ends))
    scaled = {f"{c}_norm": F.when(F.col(f"_{c}_hi") > F.col(f"_{c}_lo"), (F.col(c) - F.col(f"_{c}_lo")) / (F.col(f"_{c}_hi") - F.col(f"_{c}_lo"))).otherwise(0.5) for c in columns}
    return joined.withColumns(scaled).select(*rows.columns, *scaled)


def ensemble(weights: Mapping[str, float]) -> Column:
    """Weighted sum of normalised lenses, 0 to 100."""
    return 100 * sum((F.col(f"{c}_norm") * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())


def noise_floor(turnover: Column, change_pct: Column, delivery_pct: Column) -> Column:
    """The composite below which a scrip is noise: higher for thin, volatile and speculative trading."""
    liquidity = F.when(turnover < 50000, 15.0).when(turnover < 200000, 7.5).otherwise(0.0)
    volatility = F.least(F.abs(change_pct) * 0.1, F.lit(15.0))
    extra = F.when(delivery_pct < 20, 10.0).otherwise(0.0)
    return F.greatest(F.least(45 + liquidity + volatility + extra, F.lit(80.0)), F.lit(30.0))


def ranked(rows: DataFrame, score: str, key: str, top: int) -> DataFrame:
    """The best rows by score, numbered; the limit comes before the numbering."""
    best = rows.orderBy(F.col(score).desc(), key).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), key)).cast("long"))
