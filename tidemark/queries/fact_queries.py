"""Queries by the operators over long facts, formulas and bitemporal series.

Orders stand for filings: the quarter's total of a customer is a fact of the quarter's end, known when the
order priority says so (urgent ones at once, others later), so that restatements occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions.numbers import rounded
from ..operators import facts as ops
from ..operators import temporal
from .base import query, table

AS_OF = "2000-06-30"

FACTS = """facts AS (
  SELECT o_custkey AS entity_id, CASE WHEN o_orderstatus = 'F' THEN 'fin.revenue' ELSE 'fin.orders' END AS atom,
         last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
         CAST(o_orderdate AS DATE) + 90 + CAST(left(o_orderpriority, 1) AS INT) AS known_at, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2, 3, 4)"""
SERIES = """series AS (
  SELECT entity_id, period_end, max((known_at, value)) AS r FROM facts
  WHERE atom = '{atom}' AND known_at <= DATE '2000-06-30' AND period_end <= DATE '2000-06-30' GROUP BY 1, 2),
s AS (SELECT entity_id, period_end, r[2] AS value, r[1] AS known_at FROM series)"""


def with_series(atom: str = "fin.revenue") -> str:
    return f"WITH {FACTS}, " + SERIES.format(atom=atom).replace("max((known_at, value)) AS r", "arg_max(value, (known_at, value)) AS v, max(known_at) AS k").replace("r[2] AS value, r[1] AS known_at", "v AS value, k AS known_at")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter_end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 2))
    known = F.date_add(F.to_date("o_orderdate"), F.left("o_orderpriority", F.lit(1)).cast("int") + 90)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderstatus") == "F", "fin.revenue").otherwise("fin.orders").alias("atom"), quarter_end.alias("period_end"), known.alias("known_at"))
        .agg(rounded(F.sum("o_totalprice"), 2).alias("value"))
    )


def as_of():
    return F.lit(AS_OF).cast("date")


def series(spark: SparkSession, sf_dir: str, atom: str = "fin.revenue") -> DataFrame:
    return ops.visible(facts(spark, sf_dir), atom, as_of())


@query(with_series() + " SELECT entity_id, period_end, value, known_at FROM s")
def v4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir)


@query(with_series() + """, l AS (SELECT entity_id, max(period_end) AS period_end, arg_max(value, period_end) AS value FROM s GROUP BY 1)
SELECT entity_id, period_end, CASE WHEN DATE '2000-06-30' - period_end <= 400 THEN value END AS value, CASE WHEN DATE '2000-06-30' - period_end > 400 THEN 'stale' END AS refusal FROM l""")
def v4_value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.value_at(series(spark, sf_dir), as_of(), 400)


@query(with_series() + """ SELECT entity_id, max(value) AS max_value, arg_min(period_end, (-value, period_end)) AS max_at, min(value) AS min_value, arg_min(period_end, (value, period_end)) AS min_at FROM s GROUP BY 1""")
def v4_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extremes(series(spark, sf_dir))


@query(with_series() + """, r AS (SELECT entity_id, arg_min(value, period_end) AS a, arg_max(value, period_end) AS b, min(period_end) AS since, max(period_end) AS until, count(*) AS n FROM s GROUP BY 1)
SELECT entity_id, since, until, round(b - a, 2) AS change, round(100 * (b - a) / nullif(abs(a), 0), 4) AS pct_change, until - since AS span_days FROM r WHERE n > 1""")
def v4_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ops.change(series(spark, sf_dir))
    return r.withColumns({"change": rounded("change", 2), "pct_change": rounded("pct_change", 4), "span_days": F.col("span_days").cast("long")})


@query(with_series() + """, l AS (SELECT entity_id, arg_max(value, period_end) AS value FROM s GROUP BY 1), t AS (SELECT * FROM l ORDER BY value DESC, entity_id LIMIT 25)
SELECT entity_id, value, rank() OVER (ORDER BY value DESC) AS place FROM t""")
def v4_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rank(ops.value_at(series(spark, sf_dir), as_of(), 100000).select("entity_id", "value"), 25)


@query(with_series() + """, l AS (SELECT entity_id, arg_max(value, period_end) AS value FROM s GROUP BY 1) SELECT entity_id, value FROM l WHERE value > 200000 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = entity_id AND c_mktsegment = 'BUILDING')""")
def v4_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a set whose latest value passes."""
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity_id"))
    return ops.value_at(series(spark, sf_dir), as_of(), 100000).where("value > 200000").join(members, "entity_id", "left_semi").select("entity_id", "value")


@query(f"WITH {FACTS} SELECT entity_id, atom, min(known_at) AS first_visible, max(known_at) AS last_visible, count(*) AS n FROM facts GROUP BY 1, 2")
def v4_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.visibility(facts(spark, sf_dir))


@query(with_series() + """, r AS (SELECT entity_id, arg_max(value, period_end) AS x, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY 1) SELECT entity_id, round((x - m) / sd, 6) AS z FROM r WHERE sd > 0""")
def v4_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.zscore(series(spark, sf_dir)).withColumn("z", rounded("z", 6))


CORRELATED = with_series() + """, o AS (SELECT entity_id, period_end, arg_max(value, (known_at, value)) AS y FROM facts
WHERE atom = 'fin.orders' AND known_at <= DATE '2000-06-30' AND period_end <= DATE '2000-06-30' GROUP BY 1, 2)
SELECT entity_id, round(corr(value, y), 6) AS corr, count(*) AS n FROM s JOIN o USING (entity_id, period_end) GROUP BY 1 HAVING count(*) >= 3"""


@query(CORRELATED)
def v4_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ops.correlate(series(spark, sf_dir), series(spark, sf_dir, "fin.orders"))
    return r.where("n >= 3").withColumn("corr", rounded("corr", 6))


@query(with_series() + """, x AS (SELECT entity_id, period_end, value > 150000 AS above, lag(value > 150000) OVER (PARTITION BY entity_id ORDER BY period_end) AS before FROM s)
SELECT entity_id, period_end, CASE WHEN above THEN 'up' ELSE 'down' END AS direction FROM x WHERE before IS NOT NULL AND before <> above""")
def v4_threshold_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crossings(series(spark, sf_dir), F.lit(150000))


@query(with_series() + """ SELECT entity_id, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, arg_min(value, period_end) AS first, arg_max(value, period_end) AS last FROM s GROUP BY 1""")
def v4_describe_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.describe(series(spark, sf_dir)).withColumn("mean", rounded("mean", 4))


@query(with_series() + """ SELECT count(*) AS n_readings, count(DISTINCT entity_id) AS n_entities, count(*) FILTER (WHERE value > 300000) AS n_large, bool_or(value > 900000) AS any_huge FROM s""")
def v4_count_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).agg(F.count("*").alias("n_readings"), F.count_distinct("entity_id").alias("n_entities"), F.count_if(F.col("value") > 300000).alias("n_large"), F.bool_or(F.col("value") > 900000).alias("any_huge"))


@query(with_series() + """ SELECT c_mktsegment, period_end, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, count(*) AS n FROM s JOIN customer ON c_custkey = entity_id GROUP BY 1, 2""")
def v4_aggregate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measure over entity sets, side by side."""
    sets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_mktsegment")
    return series(spark, sf_dir).join(sets, "entity_id").groupBy("c_mktsegment", "period_end").agg(rounded(F.sum("value"), 2).alias("total"), rounded(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT DISTINCT atom, period_end FROM facts")
def v4_list_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("atom", "period_end").distinct()


@query(with_series() + """, m AS (SELECT entity_id, period_end, value - lag(value) OVER (PARTITION BY entity_id ORDER BY period_end) AS moved FROM s) SELECT entity_id, period_end, round(moved, 2) AS moved FROM m WHERE abs(moved) >= 100000""")
def v4_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.control_change(series(spark, sf_dir), 100000).withColumn("moved", rounded("moved", 2))


@query(with_series() + """, f AS (SELECT entity_id, min(period_end) AS rev FROM s WHERE value > 100000 GROUP BY 1), o AS (SELECT entity_id, min(period_end) AS ord FROM facts WHERE atom = 'fin.orders' AND known_at <= DATE '2000-06-30' AND period_end <= DATE '2000-06-30' GROUP BY 1)
SELECT entity_id, ord - rev AS lag_days FROM f JOIN o USING (entity_id)""")
def v4_lag_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from an entity's first large revenue to its first open order."""
    first = lambda df, name: df.groupBy("entity_id").agg(F.min("period_end").alias(name))
    both = first(series(spark, sf_dir).where("value > 100000"), "rev").join(first(series(spark, sf_dir, "fin.orders"), "ord"), "entity_id")
    return both.select("entity_id", F.datediff("ord", "rev").cast("long").alias("lag_days"))


@query(with_series() + """, p AS (SELECT a.entity_id, a.period_end, a.value, b.period_end AS past_end, b.value AS past, abs(b.period_end - CAST(a.period_end - INTERVAL 12 MONTH AS DATE)) AS gap
FROM s a JOIN s b ON a.entity_id = b.entity_id AND abs(b.period_end - CAST(a.period_end - INTERVAL 12 MONTH AS DATE)) <= 45)
SELECT entity_id, period_end, round(100 * (value - arg_min(past, (gap, past_end))) / abs(arg_min(past, (gap, past_end))), 4) AS yoy_pct FROM p GROUP BY entity_id, period_end, value""")
def year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.year_on_year(series(spark, sf_dir)).withColumn("yoy_pct", rounded("yoy_pct", 4))


@query(with_series() + """, w AS (SELECT entity_id, period_end, sum(value) OVER f AS total, count(value) OVER f AS held, max(period_end) OVER f - min(period_end) OVER f AS span FROM s WINDOW f AS (PARTITION BY entity_id ORDER BY period_end ROWS 3 PRECEDING))
SELECT entity_id, period_end, round(total, 2) AS total FROM w WHERE held = 4 AND span BETWEEN 250 AND 290""")
def trailing_twelve_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trailing_sum(series(spark, sf_dir)).withColumn("total", rounded("total", 2))


@query(with_series() + """, r AS (SELECT entity_id, arg_min(value, period_end) AS a, arg_max(value, period_end) AS b, (max(period_end) - min(period_end)) / 365.25 AS years FROM s GROUP BY 1)
SELECT entity_id, round(CASE WHEN a > 0 AND b > 0 AND years > 0 THEN 100 * (pow(b / a, 1 / years) - 1) END, 4) AS cagr_pct FROM r""")
def formula_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series(spark, sf_dir).groupBy("entity_id").agg(F.min_by("value", "period_end").alias("a"), F.max_by("value", "period_end").alias("b"), F.min("period_end").alias("since"), F.max("period_end").alias("until"))
    return r.select("entity_id", rounded(fin.cagr_between("a", "b", "since", "until"), 4).alias("cagr_pct"))


#: Statement lines of a part's orders by year, from columns that the tables have.
STATEMENT = """st AS (SELECT l_suppkey AS entity_id, year(l_shipdate) AS fy, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * l_tax), 2) AS tax,
round(sum(l_extendedprice * (0.1 - l_discount)), 2) AS pbt, round(sum(l_extendedprice * 0.02), 2) AS finance_cost, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS inventory,
sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS receivables, sum(l_quantity) AS payables FROM lineitem GROUP BY 1, 2)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").cast("long").alias("fy")).agg(
        rounded(F.sum(price), 2).alias("revenue"), rounded(F.sum(price * F.col("l_tax")), 2).alias("tax"), rounded(F.sum(price * (0.1 - F.col("l_discount"))), 2).alias("pbt"),
        rounded(F.sum(price * 0.02), 2).alias("finance_cost"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("inventory"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("receivables"), F.sum("l_quantity").alias("payables"),
    )


@query(f"""WITH {STATEMENT} SELECT entity_id, fy, round(100 * (pbt + finance_cost) / nullif(revenue, 0), 6) AS ebit_margin_pct, round((pbt + finance_cost) / nullif(finance_cost, 0), 6) AS interest_coverage,
round(100 * tax / nullif(pbt, 0), 4) AS effective_tax_rate, round(365 * receivables / nullif(revenue, 0), 6) AS dso, round(365 * inventory / nullif(revenue, 0), 6) AS dio, round(365 * payables / nullif(revenue, 0), 6) AS dpo,
round(365 * (inventory + receivables - payables) / nullif(revenue, 0), 6) AS working_capital_cycle,
CASE WHEN receivables IS NULL OR inventory IS NULL OR payables IS NULL OR revenue IS NULL THEN 'missing_input' WHEN revenue = 0 THEN 'zero_denominator' END AS refusal FROM st""")
def formula_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named formulas, with the reason where one refuses."""
    names = {"ebit_margin_pct": 6, "interest_coverage": 6, "effective_tax_rate": 4, "dso": 6, "dio": 6, "dpo": 6, "working_capital_cycle": 6}
    values = [rounded(fin.evaluate(n)[0], places).alias(n) for n, places in names.items()]
    return statements(spark, sf_dir).select("entity_id", "fy", *values, fin.evaluate("working_capital_cycle")[1].alias("refusal"))


@query(f"""WITH {STATEMENT}, d AS (SELECT entity_id, fy, revenue, lag(revenue) OVER w AS prev, lag(fy) OVER w AS prev_fy, pbt, lag(pbt) OVER w AS prev_pbt FROM st WINDOW w AS (PARTITION BY entity_id ORDER BY fy))
SELECT entity_id, fy, round(100 * (revenue / prev - 1), 4) AS revenue_growth_pct, round(100 * (pbt / revenue - prev_pbt / prev) * 100, 4) AS margin_delta_bps,
round(100 * (pbt - prev_pbt) / nullif(revenue - prev, 0), 4) AS incremental_margin_pct FROM d WHERE prev_fy = fy - 1""")
def growth_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("fy")
    d = statements(spark, sf_dir).withColumns({"prev": F.lag("revenue").over(w), "prev_fy": F.lag("fy").over(w), "prev_pbt": F.lag("pbt").over(w)}).where("prev_fy = fy - 1")
    return d.select(
        "entity_id", "fy", rounded(fin.growth("prev", "revenue"), 4).alias("revenue_growth_pct"), rounded(100 * (fin.margin("pbt", "revenue") - fin.margin("prev_pbt", "prev")), 4).alias("margin_delta_bps"),
        rounded(fin.margin(fin.delta("prev_pbt", "pbt"), fin.delta("prev", "revenue")), 4).alias("incremental_margin_pct"),
    )


BITEMPORAL = """obs AS (SELECT o_custkey AS series_id, last_day(CAST(o_orderdate AS DATE)) AS period_end, CAST(o_orderdate AS DATE) + 45 AS as_of_date, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS value, o_orderkey AS k FROM orders),
v AS (SELECT series_id, period_end, as_of_date, arg_max(value, k) AS value FROM (SELECT series_id, period_end, as_of_date, k, value FROM obs) GROUP BY 1, 2, 3)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series_id"), F.last_day(F.to_date("o_orderdate")).alias("period_end"), F.date_add(F.to_date("o_orderdate"), 45).alias("as_of_date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("value"), F.col("o_orderkey").alias("k"),
    )
    newest = rows.groupBy("series_id", "period_end", "as_of_date").agg(F.max(F.struct(F.col("value").isNotNull().alias("set"), F.col("k"), F.col("value"))).alias("r"))
    return temporal.vintages(newest.select("series_id", "period_end", "as_of_date", F.col("r.value").alias("value")))


@query(f"""WITH {BITEMPORAL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY as_of_date) AS vintage FROM v),
seen AS (SELECT series_id, arg_max(struct_pack(p := period_end, w := vintage, x := value), (period_end, vintage)) AS r FROM n WHERE as_of_date <= DATE '2000-06-30' AND period_end <= DATE '2000-06-30' GROUP BY 1),
req AS (SELECT c_custkey - 1 AS series_id, row_number() OVER (ORDER BY c_custkey) AS ord FROM customer)
SELECT ord, series_id, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = series_id) THEN 'unknown_series' WHEN series_id % 17 = 0 THEN 'quarantined' WHEN r IS NULL THEN 'no_observation' WHEN r.x IS NULL THEN 'null_value'
WHEN DATE '2000-06-30' - r.p > 300 THEN 'stale' ELSE 'ok' END AS status,
CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = series_id) AND series_id % 17 <> 0 AND DATE '2000-06-30' - r.p <= 300 THEN r.x END AS value, r.p AS period_end, r.w AS vintage, DATE '2000-06-30' - r.p AS age_days
FROM req LEFT JOIN seen USING (series_id)""")
def bitemporal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per requested series with what was known at the date, and why there is no value."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    low = customers.agg(F.min("c_custkey")).first()[0] or 0  # the keys run on without a gap
    requested = customers.select((F.col("c_custkey") - low + 1).alias("ord"), (F.col("c_custkey") - 1).alias("series_id"))
    known = customers.select(F.col("c_custkey").alias("series_id"), (F.col("c_custkey") % 17 != 0).alias("active"), F.lit(300).alias("max_lookback_days"))
    out = temporal.resolve_panel(requested, known, observations(spark, sf_dir), as_of())
    return out.withColumns({"vintage": F.col("vintage").cast("long"), "age_days": F.col("age_days").cast("long")})


@query(f"""WITH {BITEMPORAL} SELECT series_id, period_end, as_of_date, value, row_number() OVER w AS vintage, lag(value) OVER w AS revision_of FROM v WINDOW w AS (PARTITION BY series_id, period_end ORDER BY as_of_date)""")
def vintage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("vintage", F.col("vintage").cast("long"))


@query(f"""WITH {BITEMPORAL}, p AS (SELECT DISTINCT series_id, period_end FROM v), g AS (SELECT series_id, period_end, period_end - lag(period_end) OVER (PARTITION BY series_id ORDER BY period_end) AS gap FROM p)
SELECT series_id, max(gap) AS longest_gap, count(*) FILTER (WHERE gap > 100) AS n_gaps FROM g GROUP BY 1""")
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = observations(spark, sf_dir).select("series_id", "period_end").distinct()
    gap = F.datediff("period_end", F.lag("period_end").over(Window.partitionBy("series_id").orderBy("period_end"))).cast("long")
    return periods.withColumn("gap", gap).groupBy("series_id").agg(F.max("gap").alias("longest_gap"), F.count_if(F.col("gap") > 100).alias("n_gaps"))


@query("""SELECT event_id, CASE WHEN strftime(ts, '%H:%M') <= '15:30' THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + 1 END AS day_zero FROM events""")
def day_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", temporal.day_zero(F.col("ts")).alias("day_zero"))


@query("""WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6)), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o.o_orderkey, cal.date AS session FROM o ASOF JOIN cal ON o.d <= cal.date""")
def next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session on or after each filing, from the calendar's own days."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).where("dayofweek(date) not in (1, 7)")
    calendar = temporal.next_session(temporal.sessions(lines, "date"))
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    first = calendar.agg(F.min("session").alias("s")).first()["s"]
    return days.join(calendar, "day", "left").select("o_orderkey", F.coalesce("session", F.when(F.col("day") <= F.lit(first), F.lit(first))).alias("session")).where("session is not null")
