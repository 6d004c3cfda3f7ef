"""Point-in-time joins: as of, intervals, bitemporal resolution, calendars and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
    bucket: str = "year", earliest_fallback: bool = False,
) -> DataFrame:
    """Each left row with `columns` of the last right row of its key at or before its time.

    Rows meet in a window per key and time bucket; what earlier buckets end with is carried in as one row
    per bucket, so a key with very many rows is spread over its buckets. Of right rows at one time the one
    with the greatest columns counts. Without an earlier row the columns are null, or, if
    earliest_fallback, those of the key's first right row. Rows with a null key or time match nothing.
    """
    keys = list(by)
    value = F.struct(*columns)
    when = lambda t: F.date_trunc(bucket, F.col(t))
    facts = right.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), when(right_time).alias("_bucket"), value.alias("_value"))
    facts = facts.where(F.col("_t").isNotNull()).groupBy(*keys, "_bucket", "_t").agg(F.max("_value").alias("_value"))
    last = facts.groupBy(*keys, "_bucket").agg(F.max_by("_value", "_t").alias("_value"))
    wanted = left.select(*keys, when(left_time).alias("_bucket")).distinct().withColumn("_value", F.lit(None).cast(last.schema["_value"].dataType))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.unionByName(wanted)
        .groupBy(*keys, "_bucket")
        .agg(F.max("_value").alias("_value"))
        .withColumn("_value", F.last("_value", ignorenulls=True).over(before))
        .where("_value is not null")
        .select(*keys, F.lit(None).cast("timestamp").alias("_t"), "_bucket", "_value")
    )
    rows = left.withColumns({"_t": F.col(left_time).cast("timestamp"), "_bucket": when(left_time), "_left": F.lit(True)})
    met = rows.unionByName(facts.unionByName(carried), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_t").asc_nulls_first(), F.col("_left").asc_nulls_first())
    found = met.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).where("_left")
    found = found.withColumn("_found", F.when(F.col(left_time).isNotNull(), F.col("_found")))
    if earliest_fallback:
        first = facts.groupBy(*keys).agg(F.min_by("_value", "_t").alias("_first"))
        found = found.join(first, keys, "left").withColumn("_found", F.coalesce("_found", "_first"))
    return found.select(*left.columns, *[F.col("_found")[c].alias(c) for c in columns])


#: Days of the ranges in which points meet intervals.
RANGE_DAYS = 128


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, begin: str, end: str, how: str = "inner") -> DataFrame:
    """Left rows with the right rows of their key whose [begin, end) holds `at`; a null end is open.

    An inner join meets in ranges of RANGE_DAYS, so that a key with very many rows is many keys: an interval goes to every range
    that it touches up to the last point there is, a point to its own.
    """
    inside = lambda l, r: (l[at] >= r[begin]) & (r[end].isNull() | (l[at] < r[end]))
    if how != "inner":
        joined = left.join(right, [*[left[k] == right[k] for k in by], inside(left, right)], how)
        return joined if how in ("left_semi", "left_anti") else joined.drop(*[right[k] for k in by])
    range_of = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / RANGE_DAYS)
    last = left.agg(F.max(range_of(left[at])).alias("last")).first()["last"]
    if last is None:
        return left.join(right.drop(*by), F.lit(False))
    first, until = range_of(F.col(begin)), F.least(F.coalesce(range_of(F.col(end)), F.lit(last)), F.lit(last))
    spread = right.where(first <= until).withColumn("_range", F.explode(F.sequence(first, until)))
    points = left.withColumn("_range", range_of(F.col(at)))
    met = points.join(spread, [*[points[k] == spread[k] for k in by], points["_range"] == spread["_range"], inside(points, spread)])
    return met.drop(*[spread[k] for k in by], points["_range"], spread["_range"])


def tile_intervals(rows: DataFrame, by: Sequence[str], begin: str) -> DataFrame:
    """Half-open validity [begin, valid_to): each row holds until the key's next one."""
    return rows.withColumn("valid_to", F.lead(begin).over(Window.partitionBy(*by).orderBy(begin)))


def latest(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


#: Statuses of resolve_panel in the order that they are decided.
STATUSES = ("unknown_series", "quarantined", "no_observation", "null_value", "stale", "ok")


def resolve_panel(requested: DataFrame, series: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """One row per requested series, whatever is known of it at `as_of`.

    requested: ord, series_id. series: series_id, active, max_lookback_days. observations: series_id,
    period_end, as_of_date, vintage, value. Only what was published by `as_of` is seen; of each period the
    latest vintage, of those the newest period. The value is null unless the status is ok; a reading older than
    max_lookback_days is stale.
    """
    known = observations.where(F.col("as_of_date") <= as_of).where(F.col("period_end") <= as_of)
    newest = known.groupBy("series_id").agg(
        F.max_by(F.struct("period_end", "vintage", "as_of_date", "value"), F.struct("period_end", "vintage", "as_of_date")).alias("seen")
    )
    joined = requested.join(series, "series_id", "left").join(newest, "series_id", "left")
    age = F.datediff(as_of, F.col("seen.period_end"))
    status = (
        F.when(F.col("active").isNull(), STATUSES[0])
        .when(~F.col("active"), STATUSES[1])
        .when(F.col("seen").isNull(), STATUSES[2])
        .when(F.col("seen.value").isNull(), STATUSES[3])
        .when(age > F.col("max_lookback_days"), STATUSES[4])
        .otherwise(STATUSES[5])
    )
    return joined.select(
        "ord", "series_id", status.alias("status"), F.when(status == "ok", F.col("seen.value")).alias("value"),
        F.col("seen.period_end").alias("period_end"), F.col("seen.vintage").alias("vintage"), age.alias("age_days"),
    )


def vintages(observations: DataFrame) -> DataFrame:
    """Observations (series_id, period_end, as_of_date, value) with their vintage number and what they revise."""
    w = Window.partitionBy("series_id", "period_end").orderBy("as_of_date")
    return observations.withColumns({"vintage": F.row_number().over(w), "revision_of": F.lag("value").over(w)})


def sessions(rows: DataFrame, date: str) -> DataFrame:
    """The calendar of a table: its distinct dates with a running number i from 0.

    A calendar is a few thousand rows however long the table; only it is numbered in one window.
    """
    return rows.select(F.col(date).alias("date")).where("date is not null").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def day_zero(stamp: Column, close_at: str = "15:30") -> Column:
    """The date an announcement can first be traded on: its own until close_at, else the day after."""
    return F.when(F.date_format(stamp, "HH:mm") <= close_at, F.to_date(stamp)).otherwise(F.date_add(F.to_date(stamp), 1))


def next_session(calendar: DataFrame) -> DataFrame:
    """For every day from the first to the last session the session on or after it: day, session, i."""
    nxt = calendar.withColumn("before", F.lag("date").over(Window.orderBy("date")))
    first = F.coalesce(F.date_add("before", 1), F.col("date"))
    return nxt.select(F.explode(F.sequence(first, F.col("date"))).alias("day"), F.col("date").alias("session"), "i")


def forward_return(prices: DataFrame, calendar: DataFrame, h: int, close: str = "close") -> DataFrame:
    """Return over h sessions of the calendar: rows (entity_id, date, fwd_return); without a price on that very session there is none."""
    p = prices.join(F.broadcast(calendar), "date").select("entity_id", "date", "i", close)
    later = p.select("entity_id", (F.col("i") - h).alias("i"), F.col(close).alias("_later"))
    return p.join(later, ["entity_id", "i"]).select("entity_id", "date", (F.col("_later") / F.col(close) - 1).alias("fwd_return"))


def densify(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every entity on every session between its first and last row; absent days have nulls."""
    span = prices.groupBy("entity_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = F.broadcast(calendar)
    grid = span.join(cal, (cal["date"] >= span["lo"]) & (cal["date"] <= span["hi"])).select("entity_id", "date", "i")
    return grid.join(prices, ["entity_id", "date"], "left")


def held_sessions(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(entity_id, n_sessions, n_held, longest_gap): what `densify` would show of each entity, from the rows that there are.

    A gap is the number of sessions since the last one with a close; between two rows it is longest on the session before the
    second, so the grid itself is not made.
    """
    # without an entity nothing is held, as no row of the grid equals it
    close = F.when(F.col("entity_id").isNotNull(), F.col("close"))
    p = prices.join(F.broadcast(calendar), "date").select("entity_id", "i", close.isNotNull().alias("_held"))
    earlier = Window.partitionBy("entity_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_held"), F.col("i")), ignorenulls=True).over(earlier)
    gap = F.when(F.col("_held"), F.coalesce(F.col("i") - last - 1, F.lit(0))).otherwise(F.col("i") - last)
    counts = (F.max("i") - F.min("i") + 1).cast("long").alias("n_sessions"), F.count_if("_held").alias("n_held")
    return p.withColumn("_gap", gap).groupBy("entity_id").agg(*counts, F.max("_gap").alias("longest_gap"))
