"""Rolling indicators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.numbers import rounded

def by_date() -> WindowSpec:
    """Rows of an entity by date."""
    return Window.partitionBy("entity_id").orderBy("date")


def trailing(n: int, by: WindowSpec | None = None) -> WindowSpec:
    """The row and the n-1 before it."""
    return (by or by_date()).rowsBetween(-(n - 1), 0)


def prior(n: int, by: WindowSpec | None = None) -> WindowSpec:
    """The n rows before the row."""
    return (by or by_date()).rowsBetween(-n, -1)


def complete(value: Column, frame: WindowSpec, n: int, of: str) -> Column:
    """The value if the frame holds n readings of a column, else null."""
    return F.when(F.count(of).over(frame) == n, value)


def indicators(prices: DataFrame) -> DataFrame:
    """Moving averages of 20, 50 and 200 rows, 250-row extremes, delivery spike ratio and distance from the high."""
    average = lambda c, n: F.avg(c).over(trailing(n))
    base = average("delivery_qty", 20)
    high = F.max("high").over(trailing(250))
    return prices.withColumns(
        {
            **{f"sma_{n}": rounded(average("close", n), 2) for n in (20, 50, 200)},
            "high_52w": high,
            "low_52w": F.min("low").over(trailing(250)),
            "delivery_spike_ratio": F.coalesce(rounded(F.try_divide(F.col("delivery_qty"), base), 2), F.lit(1.0)),
            "delivery_pct": rounded(F.try_divide(100 * F.col("delivery_qty"), F.col("volume")), 2),
            "distance_pct": rounded(F.try_divide(100 * (high - F.col("close")), high), 2),
        }
    )


def _folded_rsi(prices: DataFrame, step, unset: Column, without_losses: float, period: int) -> DataFrame:
    """RSI from smoothed gains and losses, which `step` takes from one row to the next.

    Smoothing depends on all rows before, so the closes of a key, one a session, are folded in one array.
    """
    rows = prices.where("close is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("p"))

    def fold(acc: Column, i: Column) -> Column:
        change = F.get(F.col("p"), i)["close"] - F.get(F.col("p"), i - 1)["close"]
        g, s = step(acc["g"], F.greatest(change, F.lit(0.0)), i), step(acc["l"], F.greatest(-change, F.lit(0.0)), i)
        rsi = F.when(i < period, unset).when(s == 0, without_losses).otherwise(100 - 100 / (1 + g / s))
        return F.struct(g.alias("g"), s.alias("l"), F.concat(acc["out"], F.array(rsi)).alias("out"))

    start = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("l"), F.array(unset).alias("out"))
    values = F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), start, fold, lambda acc: acc["out"])
    folded = F.when(F.size("p") > 1, values).otherwise(F.array(unset))
    return rows.select("entity_id", F.explode(F.arrays_zip(F.col("p"), folded.alias("rsi"))).alias("x")).select(
        "entity_id", F.col("x.p.date").alias("date"), F.col("x.rsi").alias("rsi")
    )


def wilder_rsi(prices: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's RSI, seeded by the mean of the first `period` changes; 100 without losses, null before."""

    def step(old: Column, new: Column, i: Column) -> Column:
        return F.when(i <= period, old + new / period).otherwise((old * (period - 1) + new) / period)

    return _folded_rsi(prices, step, F.lit(None).cast("double"), 100.0, period)


def ewm_rsi(prices: DataFrame, period: int = 14) -> DataFrame:
    """RSI of exponentially weighted means over all changes so far; 50 without losses and before `period` changes.

    The weights are normalised alike for gains and losses, so their ratio is that of the plain recursion.
    """
    return _folded_rsi(prices, lambda old, new, i: old * (1 - 1 / period) + new, F.lit(50.0), 50.0, period)


def drawdown(prices: DataFrame, value: str = "close") -> DataFrame:
    """Each row with its running peak and the fall from it in percent."""
    peak = F.max(value).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumns({"peak": peak, "drawdown_pct": rounded(100 * (peak - F.col(value)) / peak, 4)})


def next_valid(value: str, by: WindowSpec | None = None) -> Column:
    """The first reading at or after the row."""
    return F.first(value, ignorenulls=True).over((by or by_date()).rowsBetween(0, Window.unboundedFollowing))


def session_sigma(prices: DataFrame, n: int = 20, floor: float = 0.5, most: float = 8.0, default: float = 2.0) -> DataFrame:
    """Population deviation of n percent returns, held in [floor, most]; the default below five returns."""
    ret = 100 * (F.col("close") / F.lag("close").over(by_date()) - 1)
    r = prices.withColumn("ret", ret)
    frame = trailing(n)
    sigma = F.when(F.count("ret").over(frame) < 5, default).otherwise(F.greatest(F.least(F.stddev_pop("ret").over(frame), F.lit(most)), F.lit(floor)))
    return r.withColumn("sigma_pct", rounded(sigma, 4))


#: Rows whose least value is known together.
STRETCH = 64


def first_at_or_below(marks: DataFrame, prices: DataFrame) -> DataFrame:
    """(entity_id, at, filled): the date of the first row after row `at` whose low is at or below `level`; marks without one are left out.

    marks: entity_id, at, level. prices: entity_id, i (number of the row), date, low. A mark meets the rest of its own stretch, then the
    least lows of the stretches after it, and then the rows of the first stretch that comes low enough: never all later rows.
    """
    rows = prices.select("entity_id", F.floor(F.col("i") / STRETCH).alias("_s"), "i", "date", "low")
    own = marks.select("entity_id", "at", "level", F.floor(F.col("at") / STRETCH).alias("_s"))
    low_enough = F.col("low") <= F.col("level")
    here = own.join(rows, ["entity_id", "_s"]).where((F.col("i") > F.col("at")) & low_enough).groupBy("entity_id", "at").agg(F.min("date").alias("filled"))
    least = rows.groupBy("entity_id", F.col("_s").alias("_next")).agg(F.min("low").alias("low"))
    ahead = own.join(here, ["entity_id", "at"], "left_anti").join(least, "entity_id").where((F.col("_next") > F.col("_s")) & low_enough)
    at = ahead.groupBy("entity_id", "at").agg(F.min("_next").alias("_s"), F.first("level").alias("level"))
    there = at.join(rows, ["entity_id", "_s"]).where(low_enough).groupBy("entity_id", "at").agg(F.min("date").alias("filled"))
    return here.unionByName(there)
