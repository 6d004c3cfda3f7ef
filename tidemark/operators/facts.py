"""The closed set of operators over long facts.

A fact has entity_id, atom, period_end, value and known_at. A reading is seen at `as_of` only if it was
known by then; of one period the latest known counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(facts: DataFrame, atom: str, as_of: Column, since: Column | None = None) -> DataFrame:
    """The restated series of one atom as known at as_of: a row (entity_id, period_end, value, known_at) per period."""
    rows = facts.where((F.col("atom") == atom) & (F.col("known_at") <= as_of) & (F.col("period_end") <= as_of))
    if since is not None:
        rows = rows.where(F.col("period_end") >= since)
    newest = F.max(F.struct("known_at", "value")).alias("r")
    return rows.groupBy("entity_id", "period_end").agg(newest).select("entity_id", "period_end", F.col("r.value").alias("value"), F.col("r.known_at").alias("known_at"))


def value_at(series: DataFrame, as_of: Column, max_age_days: int) -> DataFrame:
    """The newest reading of each entity, refused as stale beyond max_age_days."""
    last = series.groupBy("entity_id").agg(F.max(F.struct("period_end", "value", "known_at")).alias("r"))
    stale = F.datediff(as_of, F.col("r.period_end")) > max_age_days
    return last.select("entity_id", F.col("r.period_end").alias("period_end"), F.when(~stale, F.col("r.value")).alias("value"), F.when(stale, "stale").alias("refusal"))


def extremes(series: DataFrame) -> DataFrame:
    """Greatest and least reading with their earliest period."""
    up, down = F.min(F.struct((-F.col("value")).alias("v"), "period_end")), F.min(F.struct(F.col("value").alias("v"), "period_end"))
    r = series.groupBy("entity_id").agg(up.alias("u"), down.alias("d"))
    return r.select("entity_id", (-F.col("u.v")).alias("max_value"), F.col("u.period_end").alias("max_at"), F.col("d.v").alias("min_value"), F.col("d.period_end").alias("min_at"))


def change(series: DataFrame) -> DataFrame:
    """First and last reading, their difference, percent change, growth basis and days between."""
    r = series.groupBy("entity_id").agg(F.min_by("value", "period_end").alias("first"), F.max_by("value", "period_end").alias("last"), F.min("period_end").alias("since"), F.max("period_end").alias("until"), F.count("*").alias("n"))
    return r.where("n > 1").select("entity_id", "since", "until", (F.col("last") - F.col("first")).alias("change"), (100 * F.try_divide(F.col("last") - F.col("first"), F.abs("first"))).alias("pct_change"), F.datediff("until", "since").alias("span_days"))


def rank(latest: DataFrame, limit: int) -> DataFrame:
    """Entities by value, ties in one place, ordered by entity within; the limit comes first."""
    top = latest.where("value is not null").orderBy(F.col("value").desc(), "entity_id").limit(limit)
    return top.withColumn("place", F.rank().over(Window.orderBy(F.col("value").desc())).cast("long"))


def visibility(facts: DataFrame) -> DataFrame:
    """When each atom of an entity was first and last known."""
    return facts.groupBy("entity_id", "atom").agg(F.min("known_at").alias("first_visible"), F.max("known_at").alias("last_visible"), F.count("*").alias("n"))


def zscore(series: DataFrame) -> DataFrame:
    """The newest reading against mean and sample deviation of all seen."""
    r = series.groupBy("entity_id").agg(F.max_by("value", "period_end").alias("x"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return r.where("sd > 0").select("entity_id", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))


def correlate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two series of an entity over their common periods, with their number."""
    both = a.select("entity_id", "period_end", F.col("value").alias("x")).join(b.select("entity_id", "period_end", F.col("value").alias("y")), ["entity_id", "period_end"])
    return both.groupBy("entity_id").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def crossings(series: DataFrame, level: Column) -> DataFrame:
    """The periods at which a series comes to lie on the other side of a level."""
    above = F.col("value") > level
    before = F.lag(above).over(Window.partitionBy("entity_id").orderBy("period_end"))
    rows = series.withColumns({"above": above, "before": before})
    return rows.where("before is not null and before <> above").select("entity_id", "period_end", F.when(F.col("above"), "up").otherwise("down").alias("direction"))


def describe(series: DataFrame) -> DataFrame:
    return series.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.min_by("value", "period_end").alias("first"), F.max_by("value", "period_end").alias("last"),
    )


def control_change(series: DataFrame, points: float) -> DataFrame:
    """The rule that names a change of at least so many points between two neighbouring periods."""
    w = Window.partitionBy("entity_id").orderBy("period_end")
    moved = F.col("value") - F.lag("value").over(w)
    return series.withColumn("moved", moved).where(F.abs("moved") >= points).select("entity_id", "period_end", "moved")


def year_on_year(series: DataFrame, tolerance_days: int = 45) -> DataFrame:
    """Each reading against the one nearest to twelve months before, if within the tolerance."""
    past = series.select(F.col("entity_id").alias("of"), F.col("period_end").alias("past_end"), F.col("value").alias("past"))
    target = F.add_months("period_end", -12)
    near = (F.col("entity_id") == F.col("of")) & F.col("past_end").between(F.date_sub(target, tolerance_days), F.date_add(target, tolerance_days))
    gap = F.abs(F.datediff("past_end", target))
    nearest = series.join(past, near).groupBy("entity_id", "period_end", "value").agg(F.min(F.struct(gap.alias("gap"), "past_end", "past")).alias("p"))
    return nearest.select("entity_id", "period_end", (100 * F.try_divide(F.col("value") - F.col("p.past"), F.abs("p.past"))).alias("yoy_pct"))


def trailing_sum(series: DataFrame, parts: int = 4, least_days: int = 250, most_days: int = 290) -> DataFrame:
    """Sum of the last so many periods, only if they are all there within the span between first and last."""
    w = Window.partitionBy("entity_id").orderBy("period_end").rowsBetween(-(parts - 1), 0)
    span = F.datediff(F.max("period_end").over(w), F.min("period_end").over(w))
    rows = series.withColumns({"total": F.sum("value").over(w), "held": F.count("value").over(w), "span": span})
    return rows.where((F.col("held") == parts) & F.col("span").between(least_days, most_days)).select("entity_id", "period_end", "total")
