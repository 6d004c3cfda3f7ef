"""Own estimates and their bands, rewarded factors, bases, sector factors, and what was known when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import estimates, quantiles
from ..operators import statements as ops
from ..operators.graph import staged
from .base import ORDERS, orders, query, table
from .ratios import FACTORS, QUARTERS, quarters
from .research import MONTHLY, factor_panel

WALK = f"""{QUARTERS}, s AS (SELECT entity_id, qi, revenue AS value, period_end + CAST(20 + (entity_id * 7 + qi * 13) % 150 AS INT) AS known_at, row_number() OVER (PARTITION BY entity_id ORDER BY qi) AS nth FROM q),
h AS (SELECT t.entity_id, t.qi, t.value AS realised, t.qi - b.qi AS back, b.value AS v FROM s t JOIN s b ON b.entity_id = t.entity_id AND b.qi BETWEEN t.qi - 11 AND t.qi - 4 AND b.known_at < t.known_at WHERE t.nth > 8),
g AS (SELECT a.entity_id, a.qi, a.v / b.v - 1 AS g FROM h a JOIN h b ON a.entity_id = b.entity_id AND a.qi = b.qi AND b.back = a.back + 4 WHERE a.v > 0 AND b.v > 0),
m AS (SELECT entity_id, qi, count(*) AS n, median(g) AS med FROM g GROUP BY 1, 2),
e AS (SELECT h.entity_id, h.qi, realised, coalesce(n, 0) AS growths, v * (1 + CASE WHEN n >= 3 THEN 0.75 * med ELSE 0 END) AS estimate FROM h LEFT JOIN m USING (entity_id, qi) WHERE back = 4),
er AS (SELECT *, CASE WHEN realised <> 0 THEN abs(estimate - realised) / abs(realised) END AS error FROM e)"""


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quarters(spark, sf_dir)
    late = (20 + (F.col("entity_id") * 7 + F.col("qi") * 13) % 150).cast("int")
    return estimates.trend_walk(q.select("entity_id", "qi", F.col("revenue").alias("value"), F.date_add("period_end", late).alias("known_at")))


@query(f"WITH {WALK} SELECT entity_id, qi::BIGINT AS qi, growths::BIGINT AS growths, round(estimate, 4) AS estimate, round(error, 6) AS error FROM er")
def own_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter's revenue estimated from what had been published before it, some of it late."""
    e = _walk(spark, sf_dir)
    return e.select("entity_id", F.col("qi").cast("long").alias("qi"), F.col("growths").cast("long").alias("growths"), rounded("estimate", 4).alias("estimate"), rounded("error", 6).alias("error"))


@query(f"""WITH {WALK}, b AS (SELECT CASE WHEN entity_id = 3 THEN -1 ELSE entity_id % 7 END AS bucket, error FROM er WHERE error IS NOT NULL AND (entity_id <> 3 OR qi % 5 = 0)),
w AS (SELECT quantile_cont(error, 0.5) AS m, quantile_cont(error, 0.75) AS p FROM b), o AS (SELECT bucket, count(*) AS n, quantile_cont(error, 0.5) AS m, quantile_cont(error, 0.75) AS p FROM b GROUP BY 1)
SELECT bucket, n, round(100 * CASE WHEN n < 8 THEN w.m ELSE o.m END, 4) AS median_pct, round(100 * CASE WHEN n < 8 THEN w.p ELSE o.p END, 4) AS p75_pct, round(greatest(100 * CASE WHEN n < 8 THEN w.p ELSE o.p END, 5.0), 4) AS band_pct, n < 8 AS pooled FROM o, w""")
def estimate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the estimates miss in each group, or in all where a group has few."""
    scored = _walk(spark, sf_dir).where("entity_id <> 3 OR qi % 5 = 0").withColumn("bucket", F.when(F.col("entity_id") == 3, -1).otherwise(F.col("entity_id") % 7))
    b = estimates.error_bands(scored, "bucket")
    return b.select("bucket", "n", *[rounded(c, 4).alias(c) for c in ("median_pct", "p75_pct", "band_pct")], "pooled")


@query(f"""WITH {MONTHLY}, u AS (SELECT 'mom' AS factor, date, mom AS v, fwd FROM x UNION ALL SELECT 'del', date, del, fwd FROM x), ic AS (SELECT factor, year(date) * 12 + month(date) + 1 AS known, corr(v, fwd) AS ic FROM u GROUP BY 1, 2 HAVING count(*) >= 10),
k AS (SELECT a.factor, a.known AS month, list(b.ic ORDER BY b.known) AS v FROM ic a JOIN ic b ON a.factor = b.factor AND b.known BETWEEN a.known - 23 AND a.known WHERE a.ic IS NOT NULL AND b.ic IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, len(v) AS n, list_avg(v) AS mean FROM k), d AS (SELECT *, list_transform(v, lambda y: y - mean) AS d FROM m),
g AS (SELECT *, list_sum(list_transform(d, lambda y: y * y)) / n + coalesce(list_sum(list_transform([1, 2, 3, 4, 5], lambda j: 2 * (1 - j / 6.0) * coalesce(list_sum(list_transform(range(1, n - j + 1), lambda i: d[i] * d[i + j])), 0) / n)), 0) AS var FROM d),
t AS (SELECT factor, month, n, mean, CASE WHEN n > 6 AND var > 0 THEN mean / sqrt(var / n) END AS t, len(list_filter(v, lambda y: sign(y) = sign(mean))) / n AS share FROM g)
SELECT factor, month::BIGINT AS month, n::BIGINT AS months, n >= 12 AS rated, coalesce(n >= 12 AND abs(t) >= 2 AND share >= 0.6, FALSE) AS rewarded, CASE WHEN n >= 12 AND abs(t) >= 2 AND share >= 0.6 THEN sign(mean) ELSE 0 END::BIGINT AS sign,
CASE WHEN n >= 12 THEN round(mean, 6) END AS mean, CASE WHEN n >= 12 THEN round(t, 4) END AS t, CASE WHEN n >= 12 THEN round(share, 6) END AS share FROM t""")
def rewarded_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two factors has paid over the 24 months known at each month."""
    f = factor_panel(spark, sf_dir)
    both = f.select("date", "fwd", F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("v")) for c in ("mom", "del")])))
    known = F.year("date") * 12 + F.month("date") + 1
    ic = both.groupBy("factor", known.alias("known")).agg(F.corr("v", "fwd").alias("ic"), F.count("*").alias("n")).where("n >= 10").withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))
    r = estimates.rewarded(ic, ["factor"])
    return r.select(
        "factor", F.col("month").cast("long").alias("month"), F.col("months").cast("long").alias("months"), "rated", "rewarded", F.col("sign").cast("long").alias("sign"),
        rounded("mean", 6).alias("mean"), rounded("t", 4).alias("t"), rounded("share", 6).alias("share"),
    )


@query(f"""WITH {ORDERS}, c AS (SELECT entity_id, 2 * count(*) FILTER (WHERE status = 'F') >= count(*) AS take FROM filings GROUP BY 1)
SELECT f.entity_id, count(*) AS n, min(filed) AS first_filed, round(sum(amount), 2) AS total, any_value(take) AS is_first FROM filings f JOIN c ON c.entity_id = f.entity_id AND (f.status = 'F') = c.take GROUP BY 1""")
def preferred_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings of one basis of each entity, never of both."""
    f = estimates.one_basis(orders(spark, sf_dir), "entity_id", "status", "F")
    return f.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("filed").alias("first_filed"), rounded(F.sum("amount"), 2).alias("total"), (F.min("status") == "F").alias("is_first"))


@query(f"""WITH {FACTORS}, p AS (SELECT a.entity_id, a.qi, CASE WHEN count(b.op_margin) >= 8 AND a.op_margin IS NOT NULL THEN (count(*) FILTER (WHERE b.op_margin < a.op_margin) + (count(*) FILTER (WHERE b.op_margin = a.op_margin) + 1) / 2) / count(b.op_margin) END AS margin_pctile,
CASE WHEN count(b.pat_ttm) >= 8 AND a.pat_ttm IS NOT NULL THEN (count(*) FILTER (WHERE b.pat_ttm < a.pat_ttm) + (count(*) FILTER (WHERE b.pat_ttm = a.pat_ttm) + 1) / 2) / count(b.pat_ttm) END AS pat_pctile
FROM g a JOIN g b ON a.entity_id = b.entity_id AND b.qi BETWEEN a.qi - 19 AND a.qi GROUP BY a.entity_id, a.qi, a.op_margin, a.pat_ttm),
m AS (SELECT sector, qi, CASE WHEN count(ps) >= 3 THEN median(ps) END AS ps, CASE WHEN count(pe) >= 3 THEN median(pe) END AS pe FROM g GROUP BY 1, 2), u AS (SELECT qi, CASE WHEN count(q_pat_yoy) >= 30 THEN quantile_cont(q_pat_yoy, 2 / 3::DOUBLE) END AS edge FROM g GROUP BY 1)
SELECT g.entity_id, g.period_end, round(m.pe - y.pe, 6) AS sector_pe_chg_12m, round(m.ps - z.ps, 6) AS sector_ps_chg_36m, round(m.pe - z.pe, 6) AS sector_pe_chg_36m, round(p.pat_pctile, 6) AS pat_pctile,
CASE WHEN u.edge IS NOT NULL AND g.q_pat_yoy IS NOT NULL AND p.margin_pctile IS NOT NULL THEN (g.q_pat_yoy > u.edge AND p.margin_pctile > 0.8)::INT::DOUBLE END AS peak_growth_trap
FROM g LEFT JOIN p ON p.entity_id = g.entity_id AND p.qi = g.qi LEFT JOIN m ON m.sector = g.sector AND m.qi = g.qi LEFT JOIN m y ON y.sector = g.sector AND y.qi = g.qi - 4 LEFT JOIN m z ON z.sector = g.sector AND z.qi = g.qi - 12 LEFT JOIN u ON u.qi = g.qi""")
def sector_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a nation's median multiples moved over one and three years, where profit stands in its own five years, and growth at a peak of margin."""
    sectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("sector"))
    q = quarters(spark, sf_dir).join(sectors, "entity_id").withColumn("mcap", F.col("close") * F.col("shares"))
    above = lambda c: F.when((F.col("mcap") > 0) & (F.col(c) > 0), F.log(F.col("mcap") / F.col(c)))
    q = q.withColumns({"ps": above("revenue_ttm"), "pe": above("pat_ttm"), "margin": F.try_divide("ebit_ttm", "revenue_ttm"), "growth": F.when(F.col("pat") > 0, F.try_divide(F.col("pat"), ops.back("pat", 4)) - 1)})
    q = q.withColumns({"margin_pctile": ops.own_percentile("margin", 20, 8), "pat_pctile": ops.own_percentile("pat_ttm", 20, 8)})
    # quarters are made once, with what the rest needs of them
    q = staged(q.select("entity_id", "period_end", "qi", "sector", "ps", "pe", "growth", "margin_pctile", "pat_pctile"))
    medians = None
    for c in ("ps", "pe"):
        held = quantiles.exact_quantiles(q, ["sector", "qi"], c, [0.5]).join(q.groupBy("sector", "qi").agg(F.count(c).alias("n")), ["sector", "qi"]).where("n >= 3").select("sector", "qi", F.get("q", F.lit(0)).alias(c))
        medians = held if medians is None else medians.join(held, ["sector", "qi"], "full")
    then = lambda n: medians.select("sector", (F.col("qi") + n).alias("qi"), F.col("ps").alias(f"ps_{n}"), F.col("pe").alias(f"pe_{n}"))
    edges = quantiles.exact_quantiles(q, ["qi"], "growth", [2 / 3]).join(q.groupBy("qi").agg(F.count("growth").alias("n")), "qi").where("n >= 30").select("qi", F.get("q", F.lit(0)).alias("edge"))
    own = q.select("entity_id", "period_end", "qi", "sector", "growth", "margin_pctile", "pat_pctile")
    whole = own.join(medians.withColumnsRenamed({"ps": "ps_0", "pe": "pe_0"}), ["sector", "qi"], "left").join(then(4), ["sector", "qi"], "left").join(then(12), ["sector", "qi"], "left").join(edges, "qi", "left")
    told = F.col("edge").isNotNull() & F.col("growth").isNotNull() & F.col("margin_pctile").isNotNull()
    trap = F.when(told, ((F.col("growth") > F.col("edge")) & (F.col("margin_pctile") > 0.8)).cast("double"))
    change = lambda c, n: rounded(F.col(f"{c}_0") - F.col(f"{c}_{n}"), 6)
    return whole.select(
        "entity_id", "period_end", change("pe", 4).alias("sector_pe_chg_12m"), change("ps", 12).alias("sector_ps_chg_36m"), change("pe", 12).alias("sector_pe_chg_36m"),
        rounded("pat_pctile", 6).alias("pat_pctile"), trap.alias("peak_growth_trap"),
    )


@query("""WITH v AS (SELECT o_custkey % 10 AS series, CAST(o_orderdate AS DATE) AS period, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS known, o_totalprice AS x FROM orders), y AS (SELECT DISTINCT year(period) AS year FROM v), s AS (SELECT DISTINCT series FROM v)
SELECT series, year, make_date(year, 12, 31) AS asof, count(x) FILTER (WHERE known <= make_date(year, 12, 31)) AS n_known, count(x) FILTER (WHERE known > make_date(year, 12, 31) AND period <= make_date(year, 12, 31)) AS n_late, 0::BIGINT AS n_newer, count(x) FILTER (WHERE known <= make_date(year, 12, 31)) = 0 AS vacuous
FROM y CROSS JOIN s LEFT JOIN v USING (series) GROUP BY 1, 2""")
def release_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each year's end: the releases known by then, those of the time that came later, and that none newer is among the known.

    Rows are counted by the year in which they are known and in which they fall; running sums over years then tell every date.
    """
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("series"), F.to_date("o_orderdate").alias("period"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")).alias("known"))
    years = v.select(F.year("period").alias("year")).distinct()
    by_known = v.groupBy("series", F.year("known").alias("year")).agg(F.count("*").alias("k"), F.max("known").alias("newest"))
    by_period = v.groupBy("series", F.year("period").alias("year")).agg(F.count("*").alias("p"))
    upto = Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    all_years = by_known.join(by_period, ["series", "year"], "full").join(v.select("series").distinct().crossJoin(F.broadcast(years)), ["series", "year"], "right")
    ran = all_years.withColumns({"n_known": F.coalesce(F.sum("k").over(upto), F.lit(0)), "so_far": F.coalesce(F.sum("p").over(upto), F.lit(0)), "newest": F.max("newest").over(upto)})
    asof = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    # what is known by the end of a year is of that year or before, so the rest of what is of the time came later
    return ran.select("series", F.col("year").cast("long").alias("year"), asof.alias("asof"), "n_known", (F.col("so_far") - F.col("n_known")).alias("n_late"), (F.col("newest") > asof).cast("long").alias("n_newer"), (F.col("n_known") == 0).alias("vacuous")).fillna(0, ["n_newer"])


@query("""WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) < 6), m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) + 4 AS target FROM lineitem) SELECT target, min(d) AS traded, min(d) - target AS days FROM m LEFT JOIN s ON d >= target GROUP BY 1""")
def trade_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first weekday with trades on or after the fifth of each month: calendars are in order together, and a window looks on."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    sessions = lines.where(F.weekday("d") < 5).select("d", F.col("d").alias("session"), F.lit(None).cast("date").alias("target"))
    targets = lines.select(F.date_add(F.trunc("d", "month"), 4).alias("d")).distinct().select("d", F.lit(None).cast("date").alias("session"), F.col("d").alias("target"))
    ahead = Window.orderBy(F.col("d"), F.col("session").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    found = sessions.unionAll(targets).withColumn("traded", F.first("session", ignorenulls=True).over(ahead)).where("target is not null")
    return found.select("target", "traded", F.datediff("traded", "target").cast("long").alias("days"))


def _grouped_sql(v: str) -> str:
    """Digits in threes and twos, by slices of the whole part."""
    w = f"split_part(printf('%.2f', abs({v})), '.', 1)"
    twos = f"reverse(rtrim(regexp_replace(reverse({w}[:-4]), '([0-9][0-9])', '\\1,', 'g'), ','))"
    return f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN length({w}) > 3 THEN {twos} || ',' || {w}[-3:] ELSE {w} END || '.' || split_part(printf('%.2f', abs({v})), '.', 2)"


@query(f"""WITH v AS (SELECT s_suppkey, floor(s_acctbal * (CASE s_suppkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1000 WHEN 2 THEN 20000 ELSE 0.01 END) * 100 + 0.5) / 100 AS v, s_suppkey % 5 AS k, s_acctbal AS b FROM supplier)
SELECT s_suppkey, {_grouped_sql('v')} AS printed, CASE k WHEN 0 THEN floor(b) WHEN 1 THEN floor(b) + 1.5 WHEN 3 THEN floor(b) END AS magnitude FROM v""")
def claim_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts printed in the grouping of lakhs and crores, and read back from claims: a number, a range, none without a unit."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    factor = F.when(k % 4 == 0, -1.0).when(k % 4 == 1, 1000.0).when(k % 4 == 2, 20000.0).otherwise(0.01)
    v = F.floor(b * factor * 100 + 0.5) / 100
    whole = F.floor(b)
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("about "), F.format_number(whole, 0), F.lit(" in Q3 FY27"))).when(k % 5 == 1, F.concat(whole.cast("string"), F.when(whole < 0, " to ").otherwise("-"), (whole + 3).cast("string"), F.lit(" crore by FY2027")))
        .when(k % 5 == 2, whole.cast("string")).when(k % 5 == 3, F.concat(F.lit("("), whole.cast("string"), F.lit(")"))).otherwise("no number in FY26")
    )
    unit = F.when(k % 5 == 2, F.lit(None).cast("string")).otherwise("INR crore")
    return table(spark, sf_dir, "supplier").select("s_suppkey", estimates.grouped_digits(v).alias("printed"), estimates.magnitude(text, unit).alias("magnitude"))
