"""Queries of factor research, event statistics and screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions.numbers import rounded
from ..operators import screen, stats, temporal, windows
from ..operators.relational import quantile_cut
from .base import PANEL, panel, query, table

#: Monthly factor panel: momentum over rows as factor, the next row's return as target.
MONTHLY = f"""{PANEL}, f AS (SELECT entity_id, date, date_trunc('year', date)::DATE AS period, close / lag(close, 3) OVER w - 1 AS mom, delivery_qty / volume AS del, lead(close) OVER w / close - 1 AS fwd
FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)), x AS (SELECT * FROM f WHERE mom IS NOT NULL AND fwd IS NOT NULL)"""


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.by_date()
    rows = panel(spark, sf_dir).select(
        "entity_id", "date", F.to_date(F.date_trunc("year", "date")).alias("period"), (F.col("close") / F.lag("close", 3).over(w) - 1).alias("mom"),
        (F.col("delivery_qty") / F.col("volume")).alias("del"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"),
    )
    return rows.where("mom is not null and fwd is not null")


@query(f"""WITH {MONTHLY}, e AS (SELECT period, quantile_cont(mom, 0.01) AS lo, quantile_cont(mom, 0.99) AS hi FROM x GROUP BY 1),
h AS (SELECT entity_id, date, x.period, lo, hi, greatest(least(mom, hi), lo) AS v FROM x JOIN e ON e.period = x.period), u AS (SELECT period, lo, hi, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 35184372088832::DOUBLE + 0.5)::HUGEINT END AS u FROM h),
a AS (SELECT period, lo, hi, count(u)::DOUBLE AS n, sum(u)::DOUBLE AS s1, sum(u * u)::DOUBLE AS s2 FROM u GROUP BY 1, 2, 3),
m AS (SELECT period, lo + (hi - lo) * (s1 / n / 35184372088832::DOUBLE) AS m, CASE WHEN n > 1 AND s2 > s1 * s1 / n THEN (hi - lo) * (sqrt((s2 - s1 * s1 / n) / (n - 1)) / 35184372088832::DOUBLE) END AS s FROM a)
SELECT entity_id, date, round((v - m) / s, 6) AS z FROM h JOIN m ON m.period = h.period""")
def winsorised_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum within the first and last percentile of its year, as z-scores; sums are of whole numbers in the query and in its SQL, so that no order of rows turns a sixth place."""
    return stats.winsor_z(factor_panel(spark, sf_dir), ["period"], "mom").select("entity_id", "date", rounded("z", 6).alias("z"))


@query(f"""WITH {MONTHLY}, r AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY mom) + (count(*) OVER (PARTITION BY period, mom) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY period ORDER BY fwd) + (count(*) OVER (PARTITION BY period, fwd) - 1) / 2.0 AS b FROM x)
SELECT period, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 20""")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_ic(factor_panel(spark, sf_dir), ["period"], "mom", "fwd").withColumn("ic", rounded("ic", 6))


@query(f"""WITH {MONTHLY}, e AS (SELECT period, quantile_cont(mom, 0.2) AS lo, quantile_cont(mom, 0.8) AS hi FROM x GROUP BY 1)
SELECT x.period, round(avg(fwd) FILTER (WHERE mom > hi) - avg(fwd) FILTER (WHERE mom <= lo), 6) AS spread FROM x JOIN e ON e.period = x.period GROUP BY 1""")
def quintile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_spread(factor_panel(spark, sf_dir), ["period"], "mom", "fwd").withColumn("spread", rounded("spread", 6))


@query(f"""WITH {MONTHLY}, m AS (SELECT date_trunc('month', date)::DATE AS month, avg(fwd) AS v FROM x GROUP BY 1), d AS (SELECT month, v - avg(v) OVER () AS d, count(*) OVER () AS n, avg(v) OVER () AS mean, row_number() OVER (ORDER BY month) AS i FROM m),
c AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END * sum(a.d * b.d) / any_value(a.n) AS g FROM range(0, 6) t(k) JOIN d a ON TRUE JOIN d b ON b.i = a.i + k GROUP BY k)
SELECT any_value(n)::INT AS n, round(any_value(mean), 6) AS mean, round(any_value(mean) / sqrt((SELECT sum(g) FROM c) / any_value(n)), 4) AS t FROM d""")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean monthly return with a t that allows for five lags; the months of a calendar are a bounded array."""
    monthly = factor_panel(spark, sf_dir).groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.avg("fwd").alias("v"))
    listed = monthly.agg(F.array_sort(F.collect_list(F.struct("month", "v"))).alias("m")).select(F.col("m.v").alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return listed.select(F.size("v").alias("n"), rounded(mean, 6).alias("mean"), rounded(stats.hac_t(F.col("v"), 5), 4).alias("t"))


@query(f"""WITH {MONTHLY}, c AS (SELECT entity_id % 7 AS grp, date_trunc('month', date)::DATE AS month, sum(fwd) AS s, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT grp, sum(s) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM c GROUP BY 1), v AS (SELECT c.grp, sum(pow(s - mean * c.n, 2)) AS q FROM c JOIN g USING (grp) GROUP BY 1)
SELECT grp, round(mean, 6) AS mean, round(sqrt(q * k / (k - 1)) / n, 6) AS se, round(mean / (sqrt(q * k / (k - 1)) / n), 4) AS t, n::BIGINT AS n, k AS clusters FROM g JOIN v USING (grp)""")
def clustered_event_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_panel(spark, sf_dir).select((F.col("entity_id") % 7).alias("grp"), F.to_date(F.date_trunc("month", "date")).alias("month"), "fwd")
    r = stats.clustered_mean(rows, ["grp"], "month", "fwd")
    return r.withColumns({"mean": rounded("mean", 6), "se": rounded("se", 6), "t": rounded("t", 4)})


@query(f"""WITH {MONTHLY}, r AS (SELECT period, regr_slope(fwd, mom) AS b, regr_intercept(fwd, mom) AS a, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 20)
SELECT period, 'mom' AS factor, round(b, 6) AS coefficient, n FROM r UNION ALL SELECT period, 'const', round(a, 6), n FROM r""")
def cross_section_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cross_section(factor_panel(spark, sf_dir), "period", ["mom"], "fwd").withColumn("coefficient", rounded("coefficient", 6))


@query(f"""WITH {MONTHLY}, p AS (SELECT entity_id % 50 AS test, 1 / (1 + abs(avg(fwd)) * 20) AS p FROM x GROUP BY 1), r AS (SELECT test, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p)
SELECT test, round(p, 6) AS p, round(least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM r""")
def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = factor_panel(spark, sf_dir).groupBy((F.col("entity_id") % 50).alias("test")).agg((1 / (1 + F.abs(F.avg("fwd")) * 20)).alias("p"))
    return stats.benjamini_hochberg(tests, "p").select("test", rounded("p", 6).alias("p"), rounded("q", 6).alias("q"))


@query(f"""WITH {MONTHLY} SELECT period, count(*) AS n, count(*) FILTER (WHERE fwd > 0) AS hits, round((h / n0 + 1.96 * 1.96 / (2 * n0) - 1.96 * sqrt(h / n0 * (1 - h / n0) / n0 + 1.96 * 1.96 / (4 * n0 * n0))) / (1 + 1.96 * 1.96 / n0), 6) AS lower
FROM (SELECT *, count(*) OVER (PARTITION BY period)::DOUBLE AS n0, (count(*) FILTER (WHERE fwd > 0) OVER (PARTITION BY period))::DOUBLE AS h FROM x) GROUP BY period, n0, h""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = factor_panel(spark, sf_dir).groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.col("fwd") > 0).alias("hits"))
    return r.withColumn("lower", rounded(fin.wilson_lower("hits", "n"), 6))


@query(f"""WITH {MONTHLY}, g AS (SELECT period, entity_id % 5 AS sector, mom, count(*) OVER s AS n, avg(mom) OVER s AS m, stddev_samp(mom) OVER s AS sd, entity_id, date FROM x WINDOW s AS (PARTITION BY period, entity_id % 5))
SELECT entity_id, date, round((mom - m) / sd, 6) AS z FROM g WHERE n >= 5 AND sd > 0""")
def sector_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z within sector and period where there are five names; moments are aggregated and joined."""
    rows = factor_panel(spark, sf_dir).withColumn("sector", F.col("entity_id") % 5)
    m = rows.groupBy("period", "sector").agg(F.count("*").alias("n"), F.avg("mom").alias("m"), F.stddev_samp("mom").alias("sd")).where("n >= 5 and sd > 0")
    return rows.join(m, ["period", "sector"]).select("entity_id", "date", rounded((F.col("mom") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query(f"""WITH {MONTHLY}, s AS (SELECT period, entity_id % 5 AS sector, median(mom) AS med FROM x GROUP BY 1, 2)
SELECT period, sector, round(med, 6) AS med, round(med - lag(med) OVER (PARTITION BY sector ORDER BY period), 6) AS change FROM s""")
def sector_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = factor_panel(spark, sf_dir).groupBy("period", (F.col("entity_id") % 5).alias("sector")).agg(F.percentile("mom", F.lit(0.5)).alias("med"))
    change = F.col("med") - F.lag("med").over(Window.partitionBy("sector").orderBy("period"))
    return s.select("period", "sector", rounded("med", 6).alias("med"), rounded(change, 6).alias("change"))


@query(f"""WITH {MONTHLY}, m AS (SELECT avg(mom) AS a, avg(del) AS b, avg(fwd) AS c FROM x)
SELECT round(corr(mom, fwd), 6) AS mom_fwd, round(corr(del, fwd), 6) AS del_fwd, round(corr(mom, del), 6) AS mom_del, count(*) AS n FROM x""")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_panel(spark, sf_dir).agg(rounded(F.corr("mom", "fwd"), 6).alias("mom_fwd"), rounded(F.corr("del", "fwd"), 6).alias("del_fwd"), rounded(F.corr("mom", "del"), 6).alias("mom_del"), F.count("*").alias("n"))


SCORED = f"""{PANEL}, i AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back, round(avg(close) OVER (w ROWS 4 PRECEDING), 2) AS s5, round(avg(close) OVER (w ROWS 9 PRECEDING), 2) AS s10, round(avg(close) OVER (w ROWS 19 PRECEDING), 2) AS s20,
round(100 * (max(high) OVER (w ROWS 249 PRECEDING) - close) / nullif(max(high) OVER (w ROWS 249 PRECEDING), 0), 2) AS dist, coalesce(round(delivery_qty / nullif(avg(delivery_qty) OVER (w ROWS 19 PRECEDING), 0), 2), 1.0) AS spike,
round(100 * delivery_qty / nullif(volume, 0), 2) AS dpct, 100 * (close / lag(close) OVER w - 1) AS chg FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
l AS (SELECT *, CASE WHEN coalesce(dist, 0) = 0 THEN 15.0 ELSE dist END AS d0, CASE WHEN close > s5 AND s5 >= s10 THEN 1.0 ELSE 0.0 END + CASE WHEN s20 > 0 AND s10 >= s20 THEN 0.5 ELSE 0.0 END + 0.5 AS trend FROM i WHERE back = 1),
c AS (SELECT entity_id, date, turnover, chg, dpct, greatest(least(0.35 * spike * dpct + 2.5 * greatest(0.0, 15 - d0) + 15 * trend, 100.0), 0.0) AS flow, least(30 * (spike >= 2)::INT + 40 * (chg < 0)::INT + least(0.2 * spike * dpct, 40.0), 100.0) AS smart,
CASE WHEN turnover > 50000 THEN 60.0 ELSE 40.0 END AS fundamental FROM l)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.by_date()
    rows = panel(spark, sf_dir)
    rows = windows.indicators(rows).withColumns(
        {**{f"s{n}": rounded(F.avg("close").over(windows.trailing(n)), 2) for n in (5, 10, 20)}, "chg": 100 * (F.col("close") / F.lag("close").over(w) - 1)}
    )
    last = temporal.latest(rows, ["entity_id"], F.col("date").desc())
    conviction = F.col("delivery_spike_ratio") * F.col("delivery_pct")
    flow = fin.flow_score(conviction, "distance_pct", "close", "s5", "s10", "s20", F.lit(None).cast("double"))
    smart = F.least(30 * (F.col("delivery_spike_ratio") >= 2).cast("int") + 40 * F.coalesce((F.col("chg") < 0).cast("int"), F.lit(None).cast("int")) + F.least(0.2 * conviction, F.lit(40.0)), F.lit(100.0))
    # least() passes over a null, as the smart lens of an entity with one row is
    return last.select("entity_id", "date", "turnover", "chg", F.col("delivery_pct").alias("dpct"), flow.alias("flow"), smart.alias("smart"), F.when(F.col("turnover") > 50000, 60.0).otherwise(40.0).alias("fundamental"))


@query(f"""WITH {SCORED}, e AS (SELECT min(flow) AS f0, max(flow) AS f1, min(smart) AS s0, max(smart) AS s1, min(fundamental) AS u0, max(fundamental) AS u1 FROM c),
n AS (SELECT entity_id, date, turnover, chg, dpct, 100 * (0.45 * (flow - f0) / (f1 - f0) + 0.35 * (fundamental - u0) / (u1 - u0) + 0.2 * (smart - s0) / (s1 - s0)) AS composite FROM c, e),
t AS (SELECT *, greatest(least(45 + CASE WHEN turnover < 50000 THEN 15.0 WHEN turnover < 200000 THEN 7.5 ELSE 0 END + least(abs(chg) * 0.1, 15.0) + CASE WHEN dpct < 20 THEN 10.0 ELSE 0 END, 80.0), 30.0) AS floor FROM n)
SELECT entity_id, date, round(composite, 4) AS composite, round(floor, 4) AS floor, composite >= floor AS signal, row_number() OVER (ORDER BY round(composite, 4) DESC, entity_id) AS place FROM t QUALIFY place <= 20""")
def ensemble_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily screen: lenses from rolling indicators, min-max ensemble, noise floor, the top twenty."""
    weights = {k: w for k, w in screen.NORMAL.items() if w}
    rows = screen.min_max(scored(spark, sf_dir), list(weights))
    composite = screen.ensemble(weights)
    floor = screen.noise_floor(F.col("turnover"), F.col("chg"), F.col("dpct"))
    out = rows.select("entity_id", "date", rounded(composite, 4).alias("composite"), rounded(floor, 4).alias("floor"), (composite >= floor).alias("signal"))
    return screen.ranked(out, "composite", "entity_id", 20)


@query("""WITH f AS (SELECT c_custkey, c_acctbal / 100 AS pledge, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 END AS cover, (c_custkey % 5) - 0.5 AS de FROM customer)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN pledge < 0 OR pledge > 25 THEN 'pledge' END, CASE WHEN cover IS NULL OR cover < 2 THEN 'interest coverage' END, CASE WHEN de < 0 OR de > 2 THEN 'debt to equity' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM f""")
def solvency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("pledge"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey") % 7).alias("cover"), ((F.col("c_custkey") % 5) - 0.5).alias("de"))
    return rows.select("c_custkey", fin.forensic_reasons("pledge", "cover", "de").alias("reasons"))


@query(f"""WITH {PANEL}, b AS (SELECT entity_id, date, close, 100 * (close / lag(close) OVER w - 1) AS r FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
s AS (SELECT entity_id, date, close, CASE WHEN count(r) OVER w < 5 THEN 2.0 ELSE greatest(least(stddev_pop(r) OVER w, 8.0), 0.5) END AS sg FROM b WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 19 PRECEDING))
SELECT entity_id, date, round(close * (1 + 2 * round(sg, 4) / 100), 4) AS target, round(close * (1 - round(sg, 4) / 100), 4) AS stop FROM s""")
def call_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.session_sigma(panel(spark, sf_dir))
    target, stop = fin.bracket("close", "sigma_pct", F.lit("BUY"))
    return rows.select("entity_id", "date", rounded(target, 4).alias("target"), rounded(stop, 4).alias("stop"))


@query(f"""WITH {PANEL}, p AS (SELECT *, row_number() OVER w AS i FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
h AS (SELECT a.entity_id, a.i, p.i AS pos, p.date, CASE WHEN p.low <= a.close * 0.6 THEN 'stop' WHEN p.high >= a.close * 1.5 THEN 'target' END AS how FROM p a JOIN p ON p.entity_id = a.entity_id AND p.i > a.i),
c AS (SELECT entity_id, i, arg_min(how, pos) AS how, min(date) AS closed FROM h WHERE how IS NOT NULL GROUP BY 1, 2)
SELECT p.entity_id, p.i::INT AS entry, coalesce(c.how, 'open') AS outcome, c.closed FROM p LEFT JOIN c USING (entity_id, i)""")
def marked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call opened at every row: the first later row at stop or target, the stop counting first on one row, or still open.

    The rows of an entity, one a session, are held in order as one array, which the calendar bounds; no pairs of rows are made.
    """
    row = F.struct("date", "low", "high", "close")
    paths = panel(spark, sf_dir).groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("path"))

    def call(now, k):
        how = lambda r: F.when(r["low"] <= now["close"] * 0.6, "stop").when(r["high"] >= now["close"] * 1.5, "target")
        later = F.filter(F.slice("path", k + 2, F.size("path")), lambda r: how(r).isNotNull())
        first = F.get(F.transform(F.slice(later, 1, 1), lambda r: F.struct(how(r).alias("how"), r["date"].alias("date"))), F.lit(0))
        return F.struct((k + 1).alias("entry"), F.coalesce(first["how"], F.lit("open")).alias("outcome"), first["date"].alias("closed"))

    return paths.select("entity_id", F.inline(F.transform("path", call)))


@query(f"""WITH {MONTHLY}, e AS (SELECT period, quantile_cont(del, 1.0 / 3) AS a, quantile_cont(del, 2.0 / 3) AS b FROM x GROUP BY 1)
SELECT x.period, 1 + CASE WHEN a = b THEN (del > a)::INT ELSE (del > a)::INT + (del > b)::INT END AS part, count(*) AS n, round(avg(fwd), 6) AS mean FROM x JOIN e ON e.period = x.period GROUP BY 1, 2""")
def tercile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = quantile_cut(factor_panel(spark, sf_dir), ["period"], "del", 3, "part")
    return cut.groupBy("period", "part").agg(F.count("*").alias("n"), rounded(F.avg("fwd"), 6).alias("mean"))
