"""Books of lots, cash flows and taxes, as joins and folds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lots of mean size that a range of running quantities holds.
LOTS = 16


def fifo(trades: DataFrame) -> DataFrame:
    """Sales matched with the oldest lots: entity_id, buy_key, sell_key, quantity, gain, days.

    trades: entity_id, date, key, side ('B' or 'S'), quantity, price. First in, first out is where the running
    quantities of buys and sells overlap, so lots need no loop: two running sums and an interval join, which meets in ranges of
    some lots, each pair in the first that both touch. What is sold beyond the lots matches nothing.
    """
    w = Window.partitionBy("entity_id").orderBy("date", "key").rowsBetween(Window.unboundedPreceding, 0)

    mean = trades.agg(F.avg("quantity").alias("q")).first()["q"]
    width = float(mean or 1.0) * LOTS
    range_of = lambda c: F.floor(F.col(c) / width)

    def side(which: str, p: str) -> DataFrame:
        rows = trades.where(F.col("side") == which).withColumn("upto", F.sum("quantity").over(w)).withColumn("from", F.col("upto") - F.col("quantity"))
        return rows.withColumn(f"{p}_range", F.explode(F.sequence(range_of("from"), range_of("upto")))).select(f"{p}_range",
            F.col("entity_id").alias(f"{p}_entity"), F.col("key").alias(f"{p}_key"), F.col("date").alias(f"{p}_date"), F.col("price").alias(f"{p}_price"),
            F.col("from").alias(f"{p}_from"), F.col("upto").alias(f"{p}_to"),
        )

    same = (F.col("buy_entity") == F.col("sell_entity")) & (F.col("buy_range") == F.col("sell_range"))
    met = side("B", "buy").join(side("S", "sell"), same & (F.col("buy_from") < F.col("sell_to")) & (F.col("sell_from") < F.col("buy_to")))
    met = met.where(F.col("buy_range") == F.greatest(range_of("buy_from"), range_of("sell_from")))
    quantity = F.least("buy_to", "sell_to") - F.greatest("buy_from", "sell_from")
    return met.select(
        F.col("buy_entity").alias("entity_id"), "buy_key", "sell_key", "sell_date", quantity.alias("quantity"),
        (quantity * (F.col("sell_price") - F.col("buy_price"))).alias("gain"), F.datediff("sell_date", "buy_date").alias("days"),
    )


def fiscal_year(day: Column, first_month: int = 4) -> Column:
    """The year in which the fiscal year of a day ends."""
    return F.year(F.add_months(day, 13 - first_month)) if first_month > 1 else F.year(day)


def gains_tax(gains: DataFrame, short_rate: float, long_rate: float, exemption: float, long_after: int = 365) -> DataFrame:
    """Tax of each gain: short-term at one rate; long-term at another beyond an exemption that a fiscal year uses up in order.

    gains: entity_id, sell_date, key, gain, days. The exemption used so far is the running long-term gain held at it.
    """
    long = F.when(F.col("days") > long_after, F.greatest("gain", F.lit(0.0))).otherwise(0.0)
    rows = gains.withColumns({"fy": fiscal_year(F.col("sell_date")), "long_gain": long})
    w = Window.partitionBy("entity_id", "fy").orderBy("sell_date", "key").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("long_gain").over(w)
    taxed = F.greatest(run - exemption, F.lit(0.0)) - F.greatest(run - F.col("long_gain") - exemption, F.lit(0.0))
    short = F.when(F.col("days") <= long_after, F.greatest("gain", F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("tax", short * short_rate + taxed * long_rate)


#: Flows that are discounted together in a task.
STEP = 1 << 18


def _halved(years: np.ndarray, amounts: np.ndarray, at: np.ndarray, rounds: int) -> np.ndarray:
    """The rate of each run of flows that begins at `at` (with an end), by bisection, all runs in step; NaN without a sign change."""
    size = np.diff(at)

    def npv(rate: np.ndarray) -> np.ndarray:
        return np.add.reduceat(amounts * np.exp(-years * np.repeat(np.log1p(rate), size)), at[:-1])

    lo, hi = np.full(len(size), -0.99), np.full(len(size), 10.0)
    low = npv(lo)
    found = low * npv(hi) < 0
    for _ in range(rounds):
        # the lower end only moves to rates whose value has its sign
        mid = (lo + hi) / 2
        up = np.sign(npv(mid)) == np.sign(low)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(found, (lo + hi) / 2, np.nan)


def xirr(flows: DataFrame, rounds: int = 80) -> DataFrame:
    """Yearly internal rate of return of each entity's dated flows, by bisection in [-0.99, 10]; null without a sign change.

    flows: entity_id, date, amount; they are summed by date, so an entity's array is as long as its calendar.
    """
    daily = flows.groupBy("entity_id", "date").agg(F.sum("amount").alias("amount"))
    listed = daily.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("f"))
    years = F.transform("f", lambda x: F.datediff(x["date"], F.get("f", F.lit(0))["date"]) / 365)
    rows = listed.select("entity_id", years.cast("array<double>").alias("y"), F.transform("f", lambda x: x["amount"].cast("double")).alias("a"))
    kind = rows.schema["entity_id"].dataType.simpleString()

    def rates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            years, amounts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            found, low = [], 0
            while low < batch.num_rows:
                high = max(int(np.searchsorted(at, at[low] + STEP, side="right")) - 1, low + 1)
                high = min(high, batch.num_rows)
                found.append(_halved(years[at[low] : at[high]], amounts[at[low] : at[high]], at[low : high + 1] - at[low], rounds))
                low = high
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found), from_pandas=True)], ["entity_id", "xirr"])

    return rows.mapInArrow(rates, f"entity_id {kind}, xirr double")
