"""Quarterly statements: trailing sums, earlier quarters, cumulative filings taken apart, and covered months.

A quarter has entity_id and qi, the number of its quarter (4 * year + quarter), so that frames are ranges of qi and a
missing quarter is seen as one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.periods import fiscal_start, whole_months


def _by_quarter(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("entity_id").orderBy("qi").rangeBetween(first, last)


def back(column: str, quarters: int) -> Column:
    """The value so many quarters before; null if that quarter isn't held."""
    return F.max(column).over(_by_quarter(-quarters, -quarters))


def trailing(column: str, quarters: int = 4) -> Column:
    """The sum of the last quarters; null unless all of them have a value."""
    w = _by_quarter(1 - quarters, 0)
    return F.when(F.count(column).over(w) == quarters, F.sum(column).over(w))


def trailing_before(column: str, quarters: int, ago: int) -> Column:
    """The trailing sum as it was so many quarters ago."""
    w = _by_quarter(1 - quarters - ago, -ago)
    return F.when(F.count(column).over(w) == quarters, F.sum(column).over(w))


def year_to_date(column: str, year: str, quarter: str) -> Column:
    """The sum of a fiscal year up to a quarter; null if one before it is missing."""
    w = Window.partitionBy("entity_id", year).orderBy(quarter).rangeBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(column).over(w) == F.col(quarter), F.sum(column).over(w))


def own_percentile(column: str, quarters: int, least: int) -> Column:
    """Rank of the value among the last quarters' values over their number, ties sharing their mean; null below `least` values.

    The frame holds `quarters` values at most.
    """
    seen = F.collect_list(column).over(_by_quarter(1 - quarters, 0))
    below, equal = F.size(F.filter(seen, lambda v: v < F.col(column))), F.size(F.filter(seen, lambda v: v == F.col(column)))
    return F.when((F.size(seen) >= least) & F.col(column).isNotNull(), (below + (equal + 1) / 2) / F.size(seen))


#: What is left of a longer span from the same day without a shorter one: name, months of both.
DIFFERENCES = (("q2_from_h1", 6, 3), ("q3_from_9m", 9, 6), ("q4_from_fy", 12, 9), ("h2_from_fy", 12, 6))


def derive_periods(facts: DataFrame, ends: int = 3) -> DataFrame:
    """Rows (entity_id, formula, period_start, period_end, value) that follow from filed spans.

    facts has entity_id, period_start, period_end, value; a span is filed once. Quarters and the second half are differences of
    cumulative spans from the begin of a fiscal year; a trailing year that is no fiscal one is the sum of four quarters, filed or else
    derived, or the last year plus the year to date less the same span a year before.
    """
    spans = facts.where("value is not null").withColumn("months", whole_months(F.col("period_start"), F.col("period_end")))
    spans = spans.where("months is not null").withColumn("first", F.col("period_start") == fiscal_start(F.col("period_end"), ends))
    cumulative = spans.where("first")
    long = cumulative.select("entity_id", "period_start", F.col("period_end").alias("until"), F.col("value").alias("whole"), F.col("months").alias("of"))
    both = long.join(cumulative.select("entity_id", "period_start", "period_end", "value", "months"), ["entity_id", "period_start"])
    formula = F.lit(None).cast("string")
    for name, of, less in DIFFERENCES:
        formula = F.when((F.col("of") == of) & (F.col("months") == less), name).otherwise(formula)
    differences = both.withColumn("formula", formula).where("formula is not null").select("entity_id", "formula", F.date_add("period_end", 1).alias("period_start"), F.col("until").alias("period_end"), (F.col("whole") - F.col("value")).alias("value"))

    quarters = spans.where("months = 3").select("entity_id", "period_start", "period_end", "value", F.lit(0).alias("order"))
    own = differences.where("formula <> 'h2_from_fy'").select("entity_id", "period_start", "period_end", "value", F.lit(1).alias("order"))
    best = F.min(F.struct("order", "value"))
    held = quarters.union(own).groupBy("entity_id", "period_start", "period_end").agg(best.alias("b")).select("entity_id", "period_start", "period_end", F.col("b.value").alias("value"))
    month = 12 * F.year("period_start") + F.month("period_start")
    w = Window.partitionBy("entity_id").orderBy("month").rangeBetween(-9, 0)
    sums = held.withColumn("month", month).withColumns({"n": F.count("*").over(w), "total": F.sum("value").over(w), "begin": F.min("period_start").over(w)})
    sums = sums.where((F.col("n") == 4) & (F.col("begin") != fiscal_start(F.col("period_end"), ends)))
    ttm_sum = sums.select("entity_id", F.lit("ttm_sum_of_4").alias("formula"), F.col("begin").alias("period_start"), "period_end", F.col("total").alias("value"))

    years = cumulative.where("months = 12").select("entity_id", F.date_add("period_end", 1).alias("period_start"), F.col("value").alias("year"))
    part = cumulative.where("months < 12").select("entity_id", "period_start", "period_end", "value", "months")
    past = part.select("entity_id", F.add_months("period_start", 12).alias("period_start"), "months", F.col("value").alias("past"))
    printed = part.join(years, ["entity_id", "period_start"]).join(past, ["entity_id", "period_start", "months"])
    begin = F.add_months(F.date_add("period_end", 1), -12)
    ttm_printed = printed.select("entity_id", F.lit("ttm_from_fy_and_ytd").alias("formula"), begin.alias("period_start"), "period_end", (F.col("year") + F.col("value") - F.col("past")).alias("value"))
    return differences.unionByName(ttm_sum).unionByName(ttm_printed)


def covered_months(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by, month, n_cells, total, refusal) of cells (period_start, period_end, value) that touch a month.

    total is given only if no cell crosses the month's edge and the cells leave no day of it out.
    """
    months = F.sequence(F.trunc("period_start", "month"), F.trunc("period_end", "month"), F.expr("interval 1 month"))
    touched = cells.withColumn("month", F.explode(months))
    crosses = (F.trunc("period_start", "month") != F.col("month")) | (F.trunc("period_end", "month") != F.col("month"))
    w = Window.partitionBy(*by, "month").orderBy("period_start", "period_end")
    reached = F.max("period_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hole = F.col("period_start") > F.date_add(F.coalesce(reached, F.date_add("month", -1)), 1)
    r = touched.withColumns({"crosses": crosses, "hole": hole}).groupBy(*by, "month").agg(
        F.count("*").alias("n_cells"), F.sum("value").alias("total"), F.bool_or("crosses").alias("crosses"), F.bool_or("hole").alias("hole"), F.max("period_end").alias("last"),
    )
    incomplete = F.col("crosses") | F.col("hole") | (F.col("last") < F.last_day("month"))
    return r.select(*by, "month", "n_cells", F.when(~incomplete, F.col("total")).alias("total"), F.when(incomplete, "incomplete_month").alias("refusal"))
