"""Picks by quota: what one stratum leaves unused goes to the others, and groups of a stratum take turns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allotments(available: Mapping[str, int], quotas: Mapping[str, int]) -> dict[str, int]:
    """How many each stratum gives: its quota or all it has, and then one more each in the order of quotas while any is left to give.

    The rounds are not played: as many whole rounds as fit are found by halving, and what is left over goes in order.
    """
    taken = {s: min(n, available.get(s, 0)) for s, n in quotas.items()}
    slack = {s: available.get(s, 0) - taken[s] for s in quotas}
    left = min(sum(quotas.values()), sum(available.get(s, 0) for s in quotas)) - sum(taken.values())
    low, high = 0, max(slack.values(), default=0)
    while low < high:
        rounds = (low + high + 1) // 2
        low, high = (rounds, high) if sum(min(v, rounds) for v in slack.values()) <= left else (low, rounds - 1)
    left -= sum(min(v, low) for v in slack.values())
    for s in quotas:
        more = slack[s] > low and left > 0
        left -= more
        taken[s] += min(slack[s], low) + more
    return taken


def stratified(rows: DataFrame, stratum: str, group: str, by: Sequence[Column], quotas: Mapping[str, int]) -> DataFrame:
    """The picked rows with `turn`, their place within the stratum; strata without a quota give none.

    Groups of a stratum take turns, the larger first (then by name), each giving its rows in the order of `by`. A group
    can't give more than all quotas together, so windows limit it before rows are shuffled, however large it is. Counts of the
    strata that have a quota come to the driver.
    """
    most = sum(quotas.values())
    wanted = rows.where(F.col(stratum).isin(list(quotas)))
    sizes = wanted.groupBy(stratum, group).agg(F.count("*").alias("_size"))
    available = {r[stratum]: r["n"] for r in sizes.groupBy(stratum).agg(F.sum("_size").alias("n")).collect()}
    given = allotments(available, quotas)
    mine = F.row_number().over(Window.partitionBy(stratum, group).orderBy(*by))
    few = wanted.withColumn("_round", mine).where(F.col("_round") <= most)
    # a null group is a group
    sized = few.join(sizes.withColumnsRenamed({stratum: "_s", group: "_g"}), F.col(stratum).eqNullSafe(F.col("_s")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_s", "_g")
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("_round", F.col("_size").desc(), F.col(group).asc_nulls_first()))
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in given.items() for v in kv]), F.col(stratum)), F.lit(0))
    return sized.withColumn("turn", turn).where(F.col("turn") <= most).where(F.col("turn") <= quota).drop("_round", "_size")
