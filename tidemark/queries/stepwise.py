"""Sparse combinations of price factors, walked forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import stepwise, windows
from .base import panel, query

FACTORS = ("mom", "reversal", "delivery", "reach", "size", "busy", "gap")


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven factors of each price row, its quarter, one of three groups of parts, and the next row's return."""
    w = windows.by_date()
    back = lambda n: F.lag("close", n).over(w)
    return panel(spark, sf_dir).select(
        (F.col("entity_id") % 3).alias("grp"), F.to_date(F.date_trunc("quarter", "date")).alias("quarter"), "entity_id", "date",
        (F.col("close") / back(3) - 1).alias("mom"), (back(1) / F.col("close") - 1).alias("reversal"), (F.col("delivery_qty") / F.col("volume")).alias("delivery"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("reach"), F.log("turnover").alias("size"), (F.col("volume") / F.lag("volume", 1).over(w)).alias("busy"),
        F.datediff("date", F.lag("date", 1).over(w)).cast("double").alias("gap"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"),
    )


def _shown(walk: DataFrame) -> DataFrame:
    return walk.withColumns({c: rounded(F.when(~F.isnan(c), F.col(c)), 6) for c in ("train_score", "test_score", "equal_score")})


@query()
def stepwise_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the mean of the eight quarters before."""
    folded = stepwise.fold(factor_rows(spark, sf_dir), "grp", "quarter", FACTORS, "fwd", 20)
    return _shown(stepwise.walk_forward(folded, FACTORS, 8, 4))


@query()
def stepwise_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By all rows of all quarters before, together."""
    folded = stepwise.fold(factor_rows(spark, sf_dir), "grp", "quarter", FACTORS, "fwd", 20)
    return _shown(stepwise.walk_forward(folded, FACTORS, None, 4, pooled=True))
