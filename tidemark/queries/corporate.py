"""Queries over corporate actions, memberships, calendars, weights and placebos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import screen, stats, temporal, windows
from .base import ORDERS, PANEL, orders, panel, query, table
from .fact_queries import series, with_series
from .research import MONTHLY, SCORED, factor_panel, scored

ACTIONS = """act AS (SELECT l_partkey AS entity_id, CAST(l_shipdate AS DATE) AS ex_date, sum(ln(0.9)) AS l FROM lineitem WHERE l_linenumber = 4 GROUP BY 1, 2)"""


@query(f"""WITH {PANEL}, {ACTIONS} SELECT p.entity_id, p.date, round(p.close * exp(coalesce((SELECT sum(l) FROM act a WHERE a.entity_id = p.entity_id AND a.ex_date > p.date), 0)), 4) AS adjusted FROM panel p""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes times the factors of all later actions: the total of an entity less what has run by the day."""
    acts = table(spark, sf_dir, "lineitem").where("l_linenumber = 4").groupBy(F.col("l_partkey").alias("entity_id"), F.to_date("l_shipdate").alias("ex_date")).agg(F.sum(F.log(F.lit(0.9))).alias("l"))
    run = acts.withColumn("run", F.sum("l").over(Window.partitionBy("entity_id").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)))
    total = acts.groupBy("entity_id").agg(F.sum("l").alias("total"))
    p = temporal.asof_join(panel(spark, sf_dir).select("entity_id", "date", "close"), run, ["entity_id"], "date", "ex_date", ["run"]).join(total, "entity_id", "left")
    left = F.coalesce("total", F.lit(0.0)) - F.coalesce("run", F.lit(0.0))
    return p.select("entity_id", "date", rounded(F.col("close") * F.exp(left), 4).alias("adjusted"))


@query(f"""WITH {ORDERS}, n AS (SELECT entity_id, filed, CASE WHEN max(kind) <= '2-HIGH' THEN 1 ELSE 0 END AS inside FROM filings GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN inside = lag(inside) OVER w THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY entity_id ORDER BY filed)), g AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY filed ROWS UNBOUNDED PRECEDING) AS k FROM c),
i AS (SELECT entity_id, k, any_value(inside) AS inside, min(filed) AS added_on FROM g GROUP BY 1, 2), t AS (SELECT *, lead(added_on) OVER (PARTITION BY entity_id ORDER BY added_on) AS removed_on FROM i)
SELECT entity_id, added_on, removed_on FROM t WHERE inside = 1""")
def membership_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open memberships rebuilt from dated notices: runs of equal notices, each until the next run."""
    w = Window.partitionBy("entity_id").orderBy("filed")
    n = orders(spark, sf_dir).groupBy("entity_id", "filed").agg((F.max("kind") <= "2-HIGH").alias("inside"))
    g = n.withColumn("new", F.when(F.col("inside") == F.lag("inside").over(w), 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.groupBy("entity_id", "k", "inside").agg(F.min("filed").alias("added_on"))
    return temporal.tile_intervals(runs, ["entity_id"], "added_on").where("inside").select("entity_id", "added_on", F.col("valid_to").alias("removed_on"))


@query("""WITH held AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity > 48), s AS (SELECT unnest(generate_series((SELECT min(d) FROM held), (SELECT max(d) FROM held), INTERVAL 1 DAY))::DATE AS d)
SELECT d AS missing FROM s WHERE dayofweek(d) NOT IN (0, 6) AND d NOT IN (SELECT d FROM held)""")
def missing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working days between the first and last day held on which nothing is held."""
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.to_date("l_shipdate").alias("d")).distinct()
    days = held.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("d"))
    return days.where("dayofweek(d) not in (1, 7)").join(held, "d", "left_anti").select(F.col("d").alias("missing"))


@query(f"""WITH {PANEL}, u AS (SELECT entity_id, date, close, sign(close - lag(close) OVER w) AS s FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
g AS (SELECT entity_id, date, s, row_number() OVER (PARTITION BY entity_id ORDER BY date) - row_number() OVER (PARTITION BY entity_id, s ORDER BY date) AS k FROM u),
r AS (SELECT entity_id, s, k, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY 1, 2, 3) SELECT entity_id, max(n) FILTER (WHERE s = 1) AS longest_rise, max(n) FILTER (WHERE s = -1) AS longest_fall FROM r GROUP BY 1""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rise and fall of each entity, as islands of equal direction."""
    w = windows.by_date()
    u = panel(spark, sf_dir).select("entity_id", "date", F.signum(F.col("close") - F.lag("close").over(w)).alias("s"))
    k = F.row_number().over(w) - F.row_number().over(Window.partitionBy("entity_id", "s").orderBy("date"))
    r = u.withColumn("k", k).where("s is not null").groupBy("entity_id", "s", "k").agg(F.count("*").alias("n"))
    longest = lambda side: F.max(F.when(F.col("s") == side, F.col("n")))
    return r.groupBy("entity_id").agg(longest(1).alias("longest_rise"), longest(-1).alias("longest_fall"))


@query(with_series("fin.revenue") + """, d AS (SELECT a.entity_id, a.period_end, a.value - b.value AS yoy FROM s a JOIN s b ON a.entity_id = b.entity_id AND b.period_end = last_day(CAST(a.period_end - INTERVAL 12 MONTH AS DATE))),
w AS (SELECT *, stddev_samp(yoy) OVER f AS sd, count(yoy) OVER f AS n FROM d WINDOW f AS (PARTITION BY entity_id ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT entity_id, period_end, round(yoy / sd, 6) AS surprise FROM w WHERE n >= 2 AND sd > 0""")
def earnings_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change on the year over the deviation of the changes before it."""
    s = series(spark, sf_dir)
    past = s.select("entity_id", F.col("period_end").alias("past_end"), F.col("value").alias("past"))
    d = s.withColumn("past_end", F.last_day(F.add_months("period_end", -12))).join(past, ["entity_id", "past_end"]).select("entity_id", "period_end", (F.col("value") - F.col("past")).alias("yoy"))
    f = Window.partitionBy("entity_id").orderBy("period_end").rowsBetween(-8, -1)
    w = d.withColumns({"sd": F.stddev_samp("yoy").over(f), "n": F.count("yoy").over(f)})
    return w.where("n >= 2 and sd > 0").select("entity_id", "period_end", rounded(F.col("yoy") / F.col("sd"), 6).alias("surprise"))


@query(f"""WITH {MONTHLY}, e AS (SELECT entity_id, date, date_trunc('month', date)::DATE AS month, fwd, mom FROM x), n AS (SELECT unnest(range(1, 11)) AS seed),
a AS (SELECT seed, entity_id, month, mom, row_number() OVER (PARTITION BY seed, month ORDER BY entity_id, date) AS k FROM e, n), b AS (SELECT seed, month, fwd, row_number() OVER (PARTITION BY seed, month ORDER BY md5(concat_ws(':', seed, entity_id, date)), entity_id, date) AS k FROM e, n)
SELECT seed, round(avg(fwd) FILTER (WHERE mom > 0), 6) AS placebo_mean, count(*) AS n FROM a JOIN b USING (seed, month, k) GROUP BY 1""")
def placebo_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal's mean return with returns dealt anew within each month, ten times; the shuffle is an order by hash, the same wherever it runs."""
    e = factor_panel(spark, sf_dir).select("entity_id", "date", F.to_date(F.date_trunc("month", "date")).alias("month"), "fwd", "mom")
    return stats.dealt_means(e, "month", ["entity_id", "date"], "mom", "fwd", range(1, 11)).select("seed", rounded("mean", 6).alias("placebo_mean"), "n")


@query(f"""WITH {MONTHLY}, c AS (SELECT period, regr_slope(fwd, mom) AS b FROM x GROUP BY 1 HAVING count(*) >= 20), d AS (SELECT period, b - avg(b) OVER () AS d, count(*) OVER () AS n, avg(b) OVER () AS mean, row_number() OVER (ORDER BY period) AS i FROM c),
v AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 3.0) END * sum(a.d * b.d) / any_value(a.n) AS g FROM range(0, 3) t(k) JOIN d a ON TRUE JOIN d b ON b.i = a.i + k GROUP BY k)
SELECT 'mom' AS factor, round(any_value(mean), 6) AS mean, round(any_value(mean) / sqrt((SELECT sum(g) FROM v) / any_value(n)), 4) AS t, any_value(n)::INT AS n FROM d""")
def fama_macbeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coefficient of yearly cross-sections with a t that allows for two lags."""
    coefficients = stats.cross_section(factor_panel(spark, sf_dir), "period", ["mom"], "fwd").where("factor = 'mom'")
    listed = coefficients.groupBy("factor").agg(F.array_sort(F.collect_list(F.struct("period", "coefficient"))).alias("c")).select("factor", F.col("c.coefficient").alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return listed.select("factor", rounded(mean, 6).alias("mean"), rounded(stats.hac_t(F.col("v"), 2), 4).alias("t"), F.size("v").alias("n"))


@query("""WITH w AS (SELECT s_suppkey, s_nationkey, greatest(s_acctbal, 0) AS v FROM supplier), p AS (SELECT s_suppkey, s_nationkey, v / sum(v) OVER () AS w FROM w), g AS (SELECT s_nationkey, sum(w) AS sector FROM p GROUP BY 1)
SELECT s_suppkey, round(w * least(1.0, 0.05 / nullif(sector, 0)), 9) AS weight FROM p JOIN g USING (s_nationkey)""")
def sector_capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by balance, sectors above their cap scaled down to it."""
    w = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.greatest("s_acctbal", F.lit(0.0)).alias("v"))
    total = w.agg(F.sum("v").alias("total"))
    sector = w.groupBy("s_nationkey").agg(F.sum("v").alias("sector"))
    share = w.join(F.broadcast(sector), "s_nationkey").crossJoin(F.broadcast(total))
    weight = F.col("v") / F.col("total") * F.least(F.lit(1.0), F.try_divide(0.05 * F.col("total"), F.col("sector")))
    return share.select("s_suppkey", F.round(weight + 1e-9, 9).alias("weight"))


@query("""WITH e AS (SELECT event_type, avg(value) AS edge FROM events GROUP BY 1), p AS (SELECT event_type, greatest(edge, 0) / sum(greatest(edge, 0)) OVER () * 100 AS raw FROM e), f AS (SELECT event_type, raw, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, event_type) AS k FROM p)
SELECT event_type, (base + CASE WHEN k <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END)::INT AS weight FROM f""")
def largest_remainder_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole percentages in proportion to mean edges above zero: what is left goes to the largest remainders. One row a lens."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.greatest(F.avg("value"), F.lit(0.0)).alias("edge"))
    whole = Window.partitionBy(F.lit(0))
    raw = e.withColumn("raw", 100 * F.col("edge") / F.sum("edge").over(whole)).withColumn("base", F.floor("raw"))
    k = F.row_number().over(Window.orderBy((F.col("raw") - F.col("base")).desc(), "event_type"))
    left = F.lit(100) - F.sum("base").over(whole)
    return raw.select("event_type", (F.col("base") + F.when(k <= left, 1).otherwise(0)).cast("int").alias("weight"))


@query(f"""WITH {PANEL}, r AS (SELECT entity_id, date, volume, lag(date) OVER w AS prev, lag(volume) OVER w AS pv FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date))
SELECT date, count(*) AS n, count(*) FILTER (WHERE volume IS NOT DISTINCT FROM pv) AS same FROM r WHERE prev IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE volume IS NOT DISTINCT FROM pv) >= 2""")
def repeated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which rows repeat those of the entity's day before, null the same as null."""
    w = windows.by_date()
    r = panel(spark, sf_dir).select("date", F.lag("date").over(w).alias("prev"), F.col("volume").eqNullSafe(F.lag("volume").over(w)).alias("same")).where("prev is not null")
    return r.groupBy("date").agg(F.count("*").alias("n"), F.count_if("same").alias("same")).where("same >= 2")


@query(f"""WITH {SCORED}, e AS (SELECT min(flow) AS f0, max(flow) AS f1, min(smart) AS s0, max(smart) AS s1, min(fundamental) AS u0, max(fundamental) AS u1 FROM c),
n AS (SELECT entity_id, 100 * (0.25 * (flow - f0) / (f1 - f0) + 0.25 * (fundamental - u0) / (u1 - u0) + 0.3 * (smart - s0) / (s1 - s0) + 0.2 * 0.5) / 1.0 AS composite, entity_id % 4 AS moat FROM c, e)
SELECT entity_id, round(composite, 4) AS composite, row_number() OVER (ORDER BY round(composite, 4) DESC, entity_id) AS place FROM n WHERE moat >= 2 QUALIFY place <= 20""")
def crisis_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crisis weights behind a moat gate; a lens that is the same for all counts half."""
    rows = screen.min_max(scored(spark, sf_dir).withColumn("moat", F.lit(3.0)), list(screen.CRISIS)).where("entity_id % 4 >= 2")
    out = rows.select("entity_id", rounded(screen.ensemble(screen.CRISIS), 4).alias("composite"))
    return screen.ranked(out, "composite", "entity_id", 20)


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS peer, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS place
FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey QUALIFY place <= 10""")
def nearest_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten peers of the same group by nearness of one measure; of equally near ones the smaller keys.

    Of equal values only the eleven smallest keys can be among anyone's ten. With those alone in order, the ten are
    among the twenty before and the twenty after, so places are joined and no group is paired with itself.
    """
    key, n = ["s_nationkey"], 10
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    equal = F.row_number().over(Window.partitionBy(*key, "s_acctbal").orderBy("s_suppkey"))
    up = Window.partitionBy(*key).orderBy("s_acctbal", "s_suppkey")
    few = s.withColumn("nth", equal)
    at = few.withColumn("place", F.sum(F.when(F.col("nth") <= n + 1, 1).otherwise(0)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    others = at.where(F.col("nth") <= n + 1).select(*key, F.col("s_suppkey").alias("peer"), F.col("s_acctbal").alias("other"), F.col("place").alias("near"))
    anchors = at.select(*key, "s_suppkey", "s_acctbal", F.explode(F.sequence(F.col("place") - 2 * n - 1, F.col("place") + 2 * n + 1)).alias("near"))
    met = anchors.join(others, [*key, "near"]).where("s_suppkey <> peer")
    place = F.row_number().over(Window.partitionBy("s_suppkey").orderBy(F.abs(F.col("s_acctbal") - F.col("other")), "peer"))
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= n).select("s_suppkey", "peer", "place")
