"""Exact quantiles of groups of any size, without a group ever being in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

#: Groups up to which a row each is sent to all tasks.
BROADCAST_GROUPS = 100_000
#: Values of a group up to which Spark's own exact percentile is taken: a map of that many distinct values.
SMALL = 100_000
ACCURACY = 10_000


def looked_up(groups: DataFrame) -> DataFrame:
    """One row a group, made once, counted, and sent to all tasks up to a bound: so rows are not gathered by a few large groups."""
    made = staged(groups)
    return F.broadcast(made) if made.count() <= BROADCAST_GROUPS else made


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], small: int = SMALL) -> DataFrame:
    """(by..., q): an array of the quantiles `qs`, between neighbours in proportion; nulls don't count.

    Groups of up to `small` values are folded as they are. For larger ones an approximate quantile, whose sketches merge,
    brackets each rank; only the values inside the bracket are counted one by one, equal ones together, and the rank
    is found from what lies below.
    """
    keys = list(by) or ["_all"]
    given = rows.where(F.col(value).isNotNull()).select(*(by or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    margin = 3.0 / ACCURACY
    edges = [float(p) for q in qs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sizes = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    # one row for `small` values at least, so it is looked up once and sent to all tasks
    found_large = sizes.where(F.col("_n") > small)
    held = found_large.collect()
    exact = lambda df: df.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    if not held:
        return exact(given).drop("_all")
    large = rows.sparkSession.createDataFrame(held, found_large.schema)
    # names of its own: a group's column may be called anything
    wanted = [F.struct(F.get("_e", F.lit(2 * i)).alias("_lo"), F.get("_e", F.lit(2 * i + 1)).alias("_hi"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("_at")) for i, q in enumerate(qs)]
    brackets = large.select(*keys, F.posexplode(F.array(*wanted)).alias("_i", "_w")).select(*keys, "_i", "_w.*")
    met = given.join(F.broadcast(brackets), keys)
    key = [*keys, "_i"]
    below = met.groupBy(*key).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    inside = met.where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*key, "_v").agg(F.count("*").alias("_c"), F.first("_at").alias("_at"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("_to", upto).join(F.broadcast(below), key).withColumn("_to", F.col("_to") + F.col("_below"))
    # the first value whose running count passes a rank (from 0) stands at it
    at = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_v")))
    found = placed.groupBy(*key).agg(at(F.floor("_at")).alias("_a"), at(F.ceil("_at")).alias("_b"), F.first(F.col("_at") - F.floor("_at")).alias("_f"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    q = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", value_at.alias("v")))).alias("_q")).select(*keys, F.col("_q.v").alias("q"))
    return q.unionByName(exact(given.join(F.broadcast(large), keys, "left_anti"))).drop("_all")


#: Ranges that a group's values are cut into for ranking.
RANGES = 64


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds `name`: the rank from 1 of a value in its group, ties sharing their mean; a null has none.

    Approximate quantiles cut a group into ranges, which are ranked apart; what lies in the ranges before is added. Equal values are
    in one range, so any cut gives the same ranks.
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
    ranged = rows.join(looked_up(cuts), list(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    equal = ranged.where(F.col(value).isNotNull()).groupBy(*by, "_range", value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    sizes = equal.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    ranks = equal.withColumn("_to", upto).join(before, [*by, "_range"]).select(*by, "_range", value, (F.col("_before") + F.col("_to") - (F.col("_c") - 1) / 2).alias(name))
    return ranged.drop("_cuts").join(ranks, [*by, "_range", value], "left").drop("_range")
