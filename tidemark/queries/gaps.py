"""Formulas over a company's parts: tax gap, value of parts against the market, revenue a unit, shares of a whole, average balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions.numbers import rounded
from ..operators import statements as ops
from .base import query, table
from .ratios import QUARTERS, quarters

#: Per cent of profit that tax would take by statute.
STATUTORY = 25.0


@query(f"""WITH {QUARTERS}, i AS (SELECT l_suppkey AS entity_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start, l_returnflag AS item, round(sum(l_extendedprice * l_discount), 2) AS v FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT entity_id, period_start, count(*) AS n_items, sum(CASE WHEN item = 'R' THEN -v ELSE v END * 25 / 100) AS attributed FROM i GROUP BY 1, 2)
SELECT entity_id, period_end, round(pbt * 25 / 100 - employee_cost, 2) AS tax_gap, n_items, round(attributed, 2) AS attributed, round(pbt * 25 / 100 - employee_cost - attributed, 2) AS unattributed FROM q JOIN e USING (entity_id, period_start)""")
def tax_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax at the statutory rate less tax expense, and what of it named items explain: a deduction lessens tax, an addback (R) raises it."""
    key = ["entity_id", "period_start"]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period_start"), F.col("l_returnflag").alias("item"), (F.col("l_extendedprice") * F.col("l_discount")).alias("v"))
    items = lines.groupBy(*key, "item").agg(rounded(F.sum("v"), 2).alias("v"))
    effect = F.when(F.col("item") == "R", -F.col("v")).otherwise(F.col("v")) * STATUTORY / 100
    bridge = items.groupBy(*key).agg(F.count("*").alias("n_items"), F.sum(effect).alias("effect"))
    gap = F.col("pbt") * STATUTORY / 100 - F.col("employee_cost")
    return quarters(spark, sf_dir).join(bridge, key).select("entity_id", "period_end", rounded(gap, 2).alias("tax_gap"), "n_items", rounded("effect", 2).alias("attributed"), rounded(gap - F.col("effect"), 2).alias("unattributed"))


@query(f"""WITH {QUARTERS}, p AS (SELECT l_suppkey AS entity_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start, l_linestatus || l_returnflag AS part, round(sum(l_extendedprice) * 40, 2) AS v FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT entity_id, period_start, count(*) AS n_parts, sum(v) AS parts_value FROM p GROUP BY 1, 2), l AS (SELECT entity_id, max(qi) AS qi FROM q GROUP BY 1)
SELECT q.entity_id, q.period_end, n_parts, round(parts_value, 2) AS parts_value, round(parts_value - q.close * q.shares, 2) AS sotp_gap, round(100 * ((parts_value - q.close * q.shares) / nullif(q.close * q.shares, 0)), 4) AS gap_pct
FROM q JOIN l USING (entity_id, qi) JOIN s ON s.entity_id = q.entity_id AND s.period_start = q.period_start""")
def sotp_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated values of a company's parts at its newest quarter less its market value."""
    key = ["entity_id", "period_start"]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period_start"), F.concat("l_linestatus", "l_returnflag").alias("part"), "l_extendedprice")
    parts = lines.groupBy(*key, "part").agg(rounded(F.sum("l_extendedprice") * 40, 2).alias("v")).groupBy(*key).agg(F.count("*").alias("n_parts"), F.sum("v").alias("total"))
    newest = quarters(spark, sf_dir).groupBy("entity_id").agg(F.max_by(F.struct("period_start", "period_end", (F.col("close") * F.col("shares")).alias("mcap")), "qi").alias("r")).select("entity_id", "r.*")
    gap = F.col("total") - F.col("mcap")
    return newest.join(parts, key).select("entity_id", "period_end", "n_parts", rounded("total", 2).alias("parts_value"), rounded(gap, 2).alias("sotp_gap"), rounded(100 * F.try_divide(gap, F.col("mcap")), 4).alias("gap_pct"))


@query("""WITH r AS (SELECT l_suppkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT l_returnflag) AS n_volumes, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE l_quantity - 1 END) AS volume FROM lineitem GROUP BY 1, 2)
SELECT entity_id, month, CASE WHEN n_volumes = 1 AND volume > 0 THEN round(revenue / volume, 6) END AS revenue_per_unit, CASE WHEN n_volumes > 1 THEN 'ambiguous_input' WHEN volume <= 0 THEN 'zero_denominator' END AS refusal FROM r""")
def revenue_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue over unit volume of a month; refused where several volumes are held and nothing picks one."""
    key = [F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")]
    volume = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(F.col("l_quantity") - 1)
    kinds = table(spark, sf_dir, "lineitem").groupBy(*key, "l_returnflag").agg(F.sum("l_extendedprice").alias("revenue"), F.sum(volume).alias("volume"))
    r = kinds.groupBy("entity_id", "month").agg(rounded(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"), F.sum("volume").alias("volume"))
    refusal = F.when(F.col("n") > 1, "ambiguous_input").when(F.col("volume") <= 0, "zero_denominator")
    return r.select("entity_id", "month", F.when(refusal.isNull(), rounded(fin.ratio("revenue", "volume"), 6)).alias("revenue_per_unit"), refusal.alias("refusal"))


@query(f"""WITH {QUARTERS} SELECT q.entity_id, q.period_end, round(q.revenue / nullif((q.total_assets + b.total_assets) / 2, 0), 6) AS asset_turnover,
CASE WHEN q.net_worth + b.net_worth > 0 THEN round(100 * (q.pat / ((q.net_worth + b.net_worth) / 2)), 4) END AS roe, round(100 * (q.ebitda / nullif((q.net_worth + q.borrowings - q.cash + b.net_worth + b.borrowings - b.cash) / 2, 0)), 3) AS roce,
CASE WHEN b.qi IS NULL THEN 'opening_balance_missing' WHEN NOT q.net_worth + b.net_worth > 0 THEN 'not_positive' END AS refusal, round(q.borrowings - q.cash, 2) AS net_debt, CASE WHEN q.receivables <= q.revenue THEN round(100 * (q.receivables / nullif(q.revenue, 0)), 4) END AS share_of
FROM q LEFT JOIN q b ON b.entity_id = q.entity_id AND b.qi = q.qi - 1""")
def average_balance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios over the mean of opening and closing balances, refused without an opening one; a share of more than the whole is none."""
    q = quarters(spark, sf_dir).withColumn("capital", F.col("net_worth") + F.col("borrowings") - F.col("cash"))
    q = q.withColumns({f"{c}_before": ops.back(c, 1) for c in ("total_assets", "net_worth", "capital")})
    mean = lambda c: (F.col(c) + F.col(f"{c}_before")) / 2
    equity = mean("net_worth")
    return q.select(
        "entity_id", "period_end", rounded(fin.ratio("revenue", mean("total_assets")), 6).alias("asset_turnover"), F.when(equity > 0, rounded(fin.margin("pat", equity), 4)).alias("roe"),
        rounded(fin.margin("ebitda", mean("capital")), 3).alias("roce"), F.when(F.col("net_worth_before").isNull(), "opening_balance_missing").when(equity <= 0, "not_positive").alias("refusal"),
        rounded(F.col("borrowings") - F.col("cash"), 2).alias("net_debt"), F.when(F.col("receivables") <= F.col("revenue"), rounded(fin.margin("receivables", "revenue"), 4)).alias("share_of"),
    )
