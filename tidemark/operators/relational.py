"""Joins, sets and keyed tables beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, looked_up


def multiset_except(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left rows but, of each key, as many as right has of it: the first in `order` go."""
    held = right.groupBy(*on).agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return left.withColumn("_place", place).join(held, list(on), "left").where(F.col("_place") > F.coalesce("_held", F.lit(0))).drop("_place", "_held")


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in a total order, numbered from 1 in column place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def to_long(rows: DataFrame, ids: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Wide to long: a row (ids, atom, value, unit) per measure that isn't null; measures maps column to unit."""
    units = F.create_map(*[F.lit(x) for pair in measures.items() for x in pair])
    long = rows.unpivot(list(ids), list(measures), "atom", "value")
    return long.where("value is not null").withColumn("unit", units[F.col("atom")])


def table_diff(base: DataFrame, head: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed between two tables of equal columns."""
    rest = [c for c in base.columns if c not in key]
    whole = F.struct(F.lit(True).alias("_there"), *rest)
    both = base.select(*key, whole.alias("_before")).join(head.select(*key, whole.alias("_after")), list(key), "full")
    before, after = F.col("_before"), F.col("_after")
    change = F.when(before.isNull(), "added").when(after.isNull(), "removed").when(~before.eqNullSafe(after), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def quantile_cut(rows: DataFrame, by: Sequence[str], value: str, parts: int, name: str) -> DataFrame:
    """Which of `parts` value ranges a row is in, from 1: edges are interpolated percentiles of its group,
    a value on an edge is in the lower range, and equal edges are one."""
    edges = exact_quantiles(rows, by, value, [k / parts for k in range(1, parts)]).select(*by, F.array_distinct("q").alias("_edges"))
    return rows.join(looked_up(edges), list(by)).withColumn(name, F.size(F.filter("_edges", lambda e: F.col(value) > e)) + 1).drop("_edges")
