"""Own estimates of the next quarter from what was known before, how far they miss, and which factors have paid lately."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .stats import hac_t

#: What part of the median growth is carried on, and how many yearly growths it takes; quarters before the first estimate.
DAMPING, LEAST_GROWTHS, LEAST_BEFORE = 0.75, 3, 8
#: Scored estimates that a group needs for a band of its own, and the narrowest band in percent.
LEAST_SCORED, LEAST_BAND = 8, 5.0


def trend_walk(series: DataFrame) -> DataFrame:
    """(entity_id, qi, estimate, growths, realised, error): each quarter from those that were known before it was.

    series: entity_id, qi (number of the quarter), value, known_at, one row a quarter. The estimate is the value of a year before, grown
    by a damped median of the last four yearly growths, or as it is where fewer than three are known and above zero. Eleven
    quarters back is all that a target meets, so an entity's rows are joined by offsets and not with one another. No base, no row.
    """
    before = F.count("*").over(Window.partitionBy("entity_id").orderBy("qi").rowsBetween(Window.unboundedPreceding, -1))
    targets = series.withColumn("before", before).where(F.col("before") >= LEAST_BEFORE).select("entity_id", "qi", F.col("value").alias("realised"), F.col("known_at").alias("out"))
    asked = targets.withColumn("back", F.explode(F.sequence(F.lit(4), F.lit(11)))).withColumn("of", F.col("qi") - F.col("back"))
    known = series.select("entity_id", F.col("qi").alias("of"), F.col("value").alias("v"), "known_at")
    met = asked.join(known, ["entity_id", "of"]).where(F.col("known_at") < F.col("out"))
    at = [F.max(F.when(F.col("back") == k, F.col("v"))).alias(f"v{k}") for k in range(4, 12)]
    wide = met.groupBy("entity_id", "qi").agg(F.max("realised").alias("realised"), *at).where("v4 is not null")
    growths = F.array_sort(F.array_compact(F.array(*[F.when((F.col(f"v{k}") > 0) & (F.col(f"v{k + 4}") > 0), F.col(f"v{k}") / F.col(f"v{k + 4}") - 1) for k in range(4, 8)])))
    n = F.size("growths")
    median = (F.get("growths", F.floor((n - 1) / 2).cast("int")) + F.get("growths", F.floor(n / 2).cast("int"))) / 2
    grown = wide.withColumn("growths", growths).withColumn("estimate", F.when(n >= LEAST_GROWTHS, F.col("v4") * (1 + DAMPING * median)).otherwise(F.col("v4")))
    error = F.when(F.col("realised") != 0, F.abs(F.col("estimate") - F.col("realised")) / F.abs("realised"))
    return grown.select("entity_id", "qi", "estimate", n.alias("growths"), "realised", error.alias("error"))


def error_bands(scored: DataFrame, group: str) -> DataFrame:
    """(group, n, median_pct, p75_pct, band_pct, pooled) of rows (group, error): all groups together stand in for one with few."""
    rows = scored.where("error is not null")
    own = exact_quantiles(rows, [group], "error", [0.5, 0.75]).join(rows.groupBy(group).agg(F.count("*").alias("n")), group)
    whole = exact_quantiles(rows, [], "error", [0.5, 0.75]).select(F.col("q").alias("all_q"))
    few = F.col("n") < LEAST_SCORED
    q = F.when(few, F.col("all_q")).otherwise(F.col("q"))
    median, p75 = 100 * F.get(q, F.lit(0)), 100 * F.get(q, F.lit(1))
    return own.crossJoin(F.broadcast(whole)).select(group, "n", median.alias("median_pct"), p75.alias("p75_pct"), F.greatest(p75, F.lit(LEAST_BAND)).alias("band_pct"), few.alias("pooled"))


def rewarded(ic: DataFrame, by: Sequence[str], window: int = 24, lags: int = 5, least: int = 12, t_min: float = 2.0, share: float = 0.6) -> DataFrame:
    """(by, month, rated, rewarded, sign, mean, t, months, share): whether a factor has paid over the `window` months known at each.

    ic: by, known (number of the month in which it is known), ic. Rewarded is a mean with |t| of at least `t_min` under `lags` lags whose
    sign at least `share` of the months have; below `least` months nothing is rated. A frame holds `window` values.
    """
    frame = Window.partitionBy(*by).orderBy("known").rangeBetween(1 - window, 0)
    held = ic.where("ic is not null").withColumn("_v", F.collect_list("ic").over(frame))
    n = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / n
    rows = held.select(*by, F.col("known").alias("month"), n.alias("months"), mean.alias("mean"), hac_t(F.col("_v"), lags).alias("t"), "_v")
    same = F.size(F.filter("_v", lambda v: F.signum(v) == F.signum("mean"))) / n
    rated = F.col("months") >= least
    rows = rows.withColumns({"rated": rated, "share": F.when(rated, F.when(F.col("mean") == 0, 0.0).otherwise(same))})
    paid = rated & (F.col("mean") != 0) & F.coalesce(F.abs("t") >= t_min, F.lit(False)) & (F.col("share") >= share)
    rows = rows.withColumn("rewarded", paid)
    only = lambda c: F.when(F.col("rated"), F.col(c))
    return rows.select(*by, "month", "rated", "rewarded", F.when(F.col("rewarded"), F.signum("mean").cast("int")).otherwise(0).alias("sign"), only("mean").alias("mean"), only("t").alias("t"), "months", "share")


def one_basis(facts: DataFrame, entity: str, basis: str, first: str) -> DataFrame:
    """The facts of one basis of each entity: the `first` if it files at least as many of it as of all others, else the others."""
    is_first = F.coalesce(F.col(basis) == first, F.lit(False))
    counts = facts.groupBy(entity).agg((2 * F.count_if(is_first) >= F.count("*")).alias("_take"))
    return facts.join(counts, entity).where(is_first == F.col("_take")).drop("_take")


def grouped_digits(value: Column, places: int = 2) -> Column:
    """12,34,567.50: the last three digits of the whole part, then twos."""
    text = F.format_string(f"%.{places}f", F.abs(F.round(value.cast("double"), places)))
    whole, rest = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    head, tail = F.left(whole, F.length(whole) - 3), F.right(whole, F.lit(3))
    twos = F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,"))
    joined = F.when(F.length(whole) > 3, F.concat(twos, F.lit(","), tail)).otherwise(whole)
    sign = F.when(F.round(value.cast("double"), places) < 0, "-").otherwise("")
    return F.concat(sign, joined, F.when(F.lit(places) > 0, F.concat(F.lit("."), rest)).otherwise(""))


def magnitude(value: Column, unit: Column) -> Column:
    """The number that a text gives, or the middle of its first two; null without a unit, and tokens of periods are no numbers."""
    text = F.regexp_replace(F.lower(value), r"\b(fy|q)\s*'?\d{2,4}\b", " ")
    text = F.regexp_replace(text, r"(?<=\d)-(?=\d)", " ")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|(?<=[\s(]))[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "").cast("double"))
    at = lambda k: F.get(numbers, F.lit(k))
    return F.when(F.coalesce(unit, F.lit("")) != "", F.coalesce(F.round((at(0) + at(1)) / 2, 6), at(0)))
