"""Ratios, factors, fiscal labels and derived periods of quarterly statements.

Order lines stand for statement lines: LINES says which sum of a supplier's lines in a quarter is which. The same sums
are the inputs in Spark and SQL; what is made of them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.numbers import rounded
from ..functions.ratios import RATIOS, reading
from ..operators import statements as ops
from .base import query, table

LINES = {
    "revenue": "l_extendedprice",
    "materials": "l_extendedprice * l_discount * 12",
    "purchases": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END * 0.1",
    "stock_change": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END * 0.05",
    "employee_cost": "l_extendedprice * l_tax",
    "fees": "l_extendedprice * 0.01",
    "other_expenses": "CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END * 0.1",
    "depreciation": "l_quantity * 10",
    "finance_cost": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice END * 0.02",
    "other_income": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END * 0.03",
    "exceptional": "CASE WHEN l_quantity > 45 THEN l_extendedprice ELSE 0 END * 0.05",
    "net_interest": "l_extendedprice * 0.04",
    "receivables": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END * 0.3",
    "inventory": "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END * 0.4",
    "payables": "CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END * 0.3",
    "net_worth": "l_extendedprice * (l_tax * 20 - 0.6)",
    "borrowings": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END * 0.5",
    "cash": "l_quantity * 50",
    "total_assets": "l_extendedprice * 1.5",
    "current_assets": "l_extendedprice * 0.7",
    "current_liabilities": "CASE WHEN l_discount > 0.07 THEN l_extendedprice ELSE 0 END",
    "order_intake": "CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END",
    "order_book": "CASE WHEN l_linestatus = 'O' THEN l_extendedprice END * 2",
    "shares": "l_quantity * 100",
    "dividends": "l_quantity * 3",
}
COSTS = ("materials", "purchases", "stock_change", "employee_cost", "fees", "other_expenses", "depreciation")

QUARTERS = f"""base AS (SELECT l_suppkey AS entity_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start, {", ".join(f"round(sum({e}), 2) AS {n}" for n, e in LINES.items())} FROM lineitem GROUP BY 1, 2),
q AS (SELECT b.*, CAST(period_start + INTERVAL 3 MONTH AS DATE) - 1 AS period_end, CAST(year(period_start) * 4 + quarter(period_start) AS INT) AS qi, year(period_start + INTERVAL 9 MONTH) AS fy, (quarter(period_start) + 2) % 4 + 1 AS fq,
round(revenue + other_income - ({" + ".join(COSTS)}) - coalesce(finance_cost, 0), 2) AS pbt, round(0.75 * pbt + exceptional, 2) AS pat, round(pbt + finance_cost, 2) AS ebit,
round(pbt + finance_cost + depreciation - other_income, 2) AS ebitda, round(pat - exceptional, 2) AS pat_plain, pat / shares AS eps, revenue / (shares / 100) AS close FROM base b),
t AS (SELECT a.entity_id, a.qi, {", ".join(f"CASE WHEN count(b.{c}) = 4 THEN round(sum(b.{c}), {p}) END AS {c}_ttm" for c, p in (("revenue", 2), ("pat", 2), ("pat_plain", 2), ("ebit", 2), ("ebitda", 2), ("finance_cost", 2), ("eps", 8), ("dividends", 2)))}
  FROM q a JOIN q b ON a.entity_id = b.entity_id AND b.qi BETWEEN a.qi - 3 AND a.qi GROUP BY 1, 2),
y AS (SELECT a.entity_id, a.qi, CASE WHEN count(*) = max(a.fq) THEN round(sum(b.revenue), 2) END AS ytd FROM q a JOIN q b ON a.entity_id = b.entity_id AND a.fy = b.fy AND b.fq <= a.fq GROUP BY 1, 2)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier and quarter with its lines, profit lines, fiscal year and trailing sums."""
    sums = [rounded(F.sum(F.expr(e)), 2).alias(n) for n, e in LINES.items()]
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period_start")).agg(*sums)
    costs = sum((F.col(c) for c in COSTS[1:]), F.col(COSTS[0]))
    q = base.withColumns({
        "period_end": F.date_add(F.add_months("period_start", 3), -1), "qi": F.year("period_start") * 4 + F.quarter("period_start"),
        "fy": periods.fiscal_year(F.col("period_start")), "fq": periods.fiscal_quarter(F.col("period_start")),
        "pbt": rounded(F.col("revenue") + F.col("other_income") - costs - F.coalesce("finance_cost", F.lit(0.0)), 2),
    })
    q = q.withColumns({
        "pat": rounded(0.75 * F.col("pbt") + F.col("exceptional"), 2), "ebit": rounded(F.col("pbt") + F.col("finance_cost"), 2),
        "ebitda": rounded(F.col("pbt") + F.col("finance_cost") + F.col("depreciation") - F.col("other_income"), 2), "close": F.col("revenue") / (F.col("shares") / 100),
    })
    q = q.withColumns({"pat_plain": rounded(F.col("pat") - F.col("exceptional"), 2), "eps": F.col("pat") / F.col("shares")})
    sums = {f"{c}_ttm": rounded(ops.trailing(c), p) for c, p in (("revenue", 2), ("pat", 2), ("pat_plain", 2), ("ebit", 2), ("ebitda", 2), ("finance_cost", 2), ("eps", 8), ("dividends", 2))}
    return q.withColumns({**sums, "ytd": rounded(ops.year_to_date("revenue", "fy", "fq"), 2)})


#: The ratios in SQL: what is above and below the line, or a value; each row of quarters is r, with those before it.
RATIO_SQL = {
    "ebitda": "ebitda", "ebit": "ebit", "ebitda_margin_pct": "100 * (ebitda / nullif(revenue, 0))", "ebit_margin_pct": "100 * (ebit / nullif(revenue, 0))", "pat_margin_pct": "100 * (pat / nullif(revenue, 0))",
    "gross_margin_pct": "100 * ((revenue - (materials + purchases + stock_change)) / nullif(revenue, 0))", "interest_coverage": "ebitda / nullif(finance_cost, 0)",
    "revenue_growth_yoy_pct": "100 * (revenue / nullif(revenue_y, 0) - 1)", "pat_growth_yoy_pct": "100 * (pat / nullif(pat_y, 0) - 1)", "revenue_growth_qoq_pct": "100 * (revenue / nullif(revenue_b, 0) - 1)", "pat_growth_qoq_pct": "100 * (pat / nullif(pat_b, 0) - 1)",
    "ttm_printed": "CASE WHEN fq = 4 THEN ytd ELSE fy_last + ytd - ytd_y END", "fy_printed": "CASE WHEN fq = 4 THEN ytd END", "fy_sum": "CASE WHEN fq = 4 THEN revenue_ttm END",
    "eps_basic_fy": "CASE WHEN fq = 4 THEN eps_ttm END", "eps_ttm": "eps_ttm", "pat_ttm": "pat_ttm", "pat_before_exceptional_ttm": "pat_plain_ttm",
    "dividend_payout_pct": "100 * (dividends_ttm / shares / nullif(CASE WHEN fq = 4 THEN eps_ttm END, 0))", "book_value_per_share": "net_worth / nullif(shares, 0)", "market_cap": "close * shares",
    "net_debt_to_ebitda": "(borrowings - cash) / nullif(ebitda_ttm, 0)", "debt_to_equity": "borrowings / nullif(net_worth, 0)", "nim_pct": "100 * (4 * net_interest / nullif((total_assets + assets_b) / 2, 0))",
    "roce": "100 * (ebit_ttm / nullif(net_worth + borrowings, 0))", "roe": "100 * (pat_ttm / nullif(net_worth, 0))", "roa": "100 * (pat_ttm / nullif(total_assets, 0))",
    "opex_to_net_total_income_pct": "100 * ((employee_cost + fees + other_expenses + depreciation) / nullif(revenue + other_income - finance_cost, 0))",
    "receivable_days": "365 * (receivables / nullif(revenue_ttm, 0))", "inventory_days": "365 * (inventory / nullif(revenue_ttm, 0))", "payable_days": "365 * (payables / nullif(revenue_ttm, 0))",
    "nwc_days": "365 * ((receivables + inventory - payables) / nullif(revenue_ttm, 0))", "current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "cost_to_income": "100 * ((employee_cost + other_expenses) / nullif(net_interest + other_income, 0))", "pe": "close / nullif(eps_ttm, 0)", "pb": "close * shares / nullif(net_worth, 0)",
    "ev_ebitda": "(close * shares + borrowings - cash) / nullif(ebitda_ttm, 0)", "kpi_growth_yoy_pct": "100 * (order_intake / nullif(intake_y, 0) - 1)", "kpi_growth_qoq_pct": "100 * (order_intake / nullif(intake_b, 0) - 1)",
    "book_to_bill": "order_intake / nullif(revenue, 0)", "order_book_coverage_years": "order_book / nullif(revenue_ttm, 0)",
}
#: The inputs that must be above zero.
ABOVE_ZERO = {
    "revenue_growth_yoy_pct": "revenue_y", "pat_growth_yoy_pct": "pat_y", "revenue_growth_qoq_pct": "revenue_b", "pat_growth_qoq_pct": "pat_b", "kpi_growth_yoy_pct": "intake_y", "kpi_growth_qoq_pct": "intake_b",
    "dividend_payout_pct": "eps_ttm", "book_value_per_share": "shares", "net_debt_to_ebitda": "ebitda_ttm", "debt_to_equity": "net_worth", "roe": "net_worth", "pe": "eps_ttm", "pb": "net_worth", "ev_ebitda": "ebitda_ttm", "order_book_coverage_years": "revenue_ttm",
}
#: The divisors that may be zero while nothing is missing; a null value that none of the rules explains is a missing input.
MAY_BE_ZERO = {"current_ratio": "current_liabilities = 0", "pat_growth_yoy_pct": "false"}


def _ratio_rows() -> str:
    one = "SELECT entity_id, period_end, known_at, '{n}' AS ratio, CASE WHEN {ok} THEN round({v}, 4) END AS value, CASE WHEN {zero} THEN 'zero_denominator' WHEN {ok} AND ({v}) IS NOT NULL THEN NULL WHEN {bad} THEN 'not_positive' ELSE 'missing_input' END AS refusal FROM r"
    rows = []
    for name, value in RATIO_SQL.items():
        above = ABOVE_ZERO.get(name)
        others = f"({value.replace(f'nullif({above}, 0)', '1')}) IS NOT NULL" if above else "false"
        bad = f"{above} <= 0 AND {others}" + (" AND fq = 4" if name == "dividend_payout_pct" else "") if above else "false"
        rows.append(one.format(n=name, v=value, ok=f"({above} > 0)" if above else "true", bad=bad, zero=MAY_BE_ZERO.get(name, "false")))
    return " UNION ALL ".join(rows)


@query(f"""WITH {QUARTERS}, r AS (SELECT q.*, t.* EXCLUDE (entity_id, qi), y.ytd, b.revenue AS revenue_b, b.pat AS pat_b, b.order_intake AS intake_b, b.total_assets AS assets_b,
a.revenue AS revenue_y, a.pat AS pat_y, a.order_intake AS intake_y, ya.ytd AS ytd_y, l.ytd AS fy_last, q.period_end + 45 AS known_at
FROM q JOIN t USING (entity_id, qi) JOIN y USING (entity_id, qi) LEFT JOIN q b ON b.entity_id = q.entity_id AND b.qi = q.qi - 1 LEFT JOIN q a ON a.entity_id = q.entity_id AND a.qi = q.qi - 4
LEFT JOIN y ya ON ya.entity_id = q.entity_id AND ya.qi = q.qi - 4 LEFT JOIN y l ON l.entity_id = q.entity_id AND l.qi = q.qi - q.fq) {_ratio_rows()}""")
def ratio_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ratio of every quarter, with the reason where one refuses; known 45 days after the quarter's end."""
    q = quarters(spark, sf_dir)
    earlier = {f"{c}_{name}": ops.back(c, n) for c in ("revenue", "pat", "order_intake") for name, n in (("before", 1), ("year_ago", 4))}
    last_year = F.when(F.col("fq") == 1, ops.back("ytd", 1)).when(F.col("fq") == 2, ops.back("ytd", 2)).when(F.col("fq") == 3, ops.back("ytd", 3))
    year_end = F.col("fq") == 4
    q = q.withColumns({
        **earlier, "total_assets_before": ops.back("total_assets", 1), "ttm_printed": F.when(year_end, F.col("ytd")).otherwise(last_year + F.col("ytd") - ops.back("ytd", 4)),
        "fy_printed": F.when(year_end, F.col("ytd")), "fy_sum": F.when(year_end, F.col("revenue_ttm")), "eps_fy": F.when(year_end, F.col("eps_ttm")), "dps": F.col("dividends_ttm") / F.col("shares"),
    })
    rows = q.select("entity_id", "period_end", F.date_add("period_end", 45).alias("known_at"), F.explode(F.array(*[reading(n) for n in RATIOS])).alias("r"))
    return rows.select("entity_id", "period_end", "known_at", F.col("r.ratio").alias("ratio"), rounded("r.value", 4).alias("value"), F.col("r.refusal").alias("refusal"))


@query("""WITH s AS (SELECT l_suppkey AS entity_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_start, l_returnflag AS segment, round(sum(l_extendedprice), 2) AS kpi FROM lineitem GROUP BY 1, 2, 3)
SELECT entity_id, period_start, segment, kpi, round(100 * (kpi / nullif(sum(kpi) OVER (PARTITION BY entity_id, period_start), 0)), 4) AS kpi_mix_pct,
round(100 * (kpi / nullif((SELECT sum(l_extendedprice) FROM lineitem WHERE l_suppkey = entity_id AND date_trunc('quarter', l_shipdate) = period_start), 0)), 4) AS kpi_share_pct FROM s""")
def segment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's part of the total as reported, and of the sum over segments."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period_start"), F.col("l_returnflag").alias("segment"), "l_extendedprice")
    key = ["entity_id", "period_start"]
    segments = lines.groupBy(*key, "segment").agg(rounded(F.sum("l_extendedprice"), 2).alias("kpi"), F.sum("l_extendedprice").alias("exact"))
    totals = segments.groupBy(*key).agg(F.sum("kpi").alias("of_segments"), F.sum("exact").alias("total"))
    part = lambda whole: rounded(100 * F.try_divide("kpi", whole), 4)
    return segments.join(totals, key).select(*key, "segment", "kpi", part(F.col("of_segments")).alias("kpi_mix_pct"), part(F.col("total")).alias("kpi_share_pct"))


FACTORS = f"""{QUARTERS}, f AS (SELECT q.entity_id, q.period_end, q.qi, q.close, q.pat, t.*  EXCLUDE (entity_id, qi), s_nationkey AS sector, q.close * q.shares AS mcap, ln(CASE WHEN q.close * q.shares > 0 AND revenue_ttm > 0 THEN q.close * q.shares / revenue_ttm END) AS ps,
ln(CASE WHEN q.close * q.shares > 0 AND pat_ttm > 0 THEN q.close * q.shares / pat_ttm END) AS pe, ebit_ttm / nullif(revenue_ttm, 0) AS op_margin FROM q JOIN t USING (entity_id, qi) JOIN supplier ON s_suppkey = entity_id),
g AS (SELECT f.*, CASE WHEN f.pat > 0 THEN f.pat / nullif(a.pat, 0) - 1 END AS q_pat_yoy FROM f LEFT JOIN f a ON a.entity_id = f.entity_id AND a.qi = f.qi - 4)"""


@query(f"""WITH {FACTORS}, p AS (SELECT a.entity_id, a.qi, CASE WHEN count(b.op_margin) >= 8 THEN (count(*) FILTER (WHERE b.op_margin < a.op_margin) + (count(*) FILTER (WHERE b.op_margin = a.op_margin) + 1) / 2) / count(b.op_margin) END AS op_margin_pctile
FROM g a JOIN g b ON a.entity_id = b.entity_id AND b.qi BETWEEN a.qi - 19 AND a.qi WHERE a.op_margin IS NOT NULL GROUP BY 1, 2),
m AS (SELECT sector, qi, CASE WHEN count(ps) >= 3 THEN median(ps) END AS med FROM g GROUP BY 1, 2)
SELECT g.entity_id, g.period_end, round(CASE WHEN y.revenue_ttm > 0 THEN g.revenue_ttm / y.revenue_ttm - 1 END, 6) AS ttm_rev_yoy, round(CASE WHEN y.pat_ttm > 0 THEN g.pat_ttm / y.pat_ttm - 1 END, 6) AS ttm_pat_yoy,
round(g.q_pat_yoy, 5) AS q_pat_yoy, round(g.q_pat_yoy - b.q_pat_yoy, 5) AS pat_accel, round(g.op_margin, 6) AS op_margin, round(g.op_margin - y.op_margin, 6) AS op_margin_chg, round(g.finance_cost_ttm / nullif(g.revenue_ttm, 0), 6) AS fin_cost_to_rev,
round(g.pat_ttm / nullif(g.mcap, 0), 6) AS earnings_yield, round(g.revenue_ttm / nullif(g.mcap, 0), 6) AS sales_yield, round(g.ps, 6) AS ps_ratio, round(g.ps - b.ps, 6) AS ps_chg_3m, round(g.ps - h.ps, 6) AS ps_chg_6m, round(g.ps - y.ps, 6) AS ps_chg_12m,
round(g.pe, 6) AS pe_ratio, round(g.pe - b.pe, 6) AS pe_chg_3m, round(g.pe - h.pe, 6) AS pe_chg_6m, round(g.pe - y.pe, 6) AS pe_chg_12m, round(ln(g.mcap), 6) AS size,
round(CASE WHEN abs(ln(g.close / y.close)) >= 0.02 THEN (g.ps - y.ps) / ln(g.close / y.close) END, 4) AS rerating_share_12m, round(CASE WHEN abs(ln(g.close / y.close)) >= 0.02 THEN ln(g.revenue_ttm / y.revenue_ttm) / ln(g.close / y.close) END, 4) AS sales_share_12m,
round(p.op_margin_pctile, 6) AS op_margin_pctile, round(g.ps - m.med, 6) AS ps_vs_sector, round(m.med - n.med, 6) AS sector_ps_chg_12m
FROM g LEFT JOIN g b ON b.entity_id = g.entity_id AND b.qi = g.qi - 1 LEFT JOIN g h ON h.entity_id = g.entity_id AND h.qi = g.qi - 2 LEFT JOIN g y ON y.entity_id = g.entity_id AND y.qi = g.qi - 4
LEFT JOIN p ON p.entity_id = g.entity_id AND p.qi = g.qi LEFT JOIN m ON m.sector = g.sector AND m.qi = g.qi LEFT JOIN m n ON n.sector = g.sector AND n.qi = g.qi - 4""")
def filing_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of growth, margin, valuation and re-rating of each supplier and quarter, and against its nation's median.

    A median is taken within a nation and quarter, over at least three suppliers with a value.
    """
    sectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("sector"))
    q = quarters(spark, sf_dir).join(sectors, "entity_id").withColumn("mcap", F.col("close") * F.col("shares"))
    above = lambda c: F.when((F.col("mcap") > 0) & (F.col(c) > 0), F.log(F.col("mcap") / F.col(c)))
    q = q.withColumns({
        "ps": above("revenue_ttm"), "pe": above("pat_ttm"), "margin": F.try_divide("ebit_ttm", "revenue_ttm"), "q_pat_yoy": F.when(F.col("pat") > 0, F.try_divide(F.col("pat"), ops.back("pat", 4)) - 1),
    })
    q = q.withColumns({"pctile": ops.own_percentile("margin", 20, 8), "price_move": F.log(F.col("close") / ops.back("close", 4))})
    split = F.when(F.abs("price_move") >= 0.02, F.col("price_move"))
    change = lambda c, n: F.col(c) - ops.back(c, n)
    yoy = lambda c: F.when(ops.back(c, 4) > 0, F.col(c) / ops.back(c, 4) - 1)
    factors = {
        "ttm_rev_yoy": yoy("revenue_ttm"), "ttm_pat_yoy": yoy("pat_ttm"), "op_margin": F.col("margin"), "op_margin_chg": change("margin", 4),
        "fin_cost_to_rev": F.try_divide("finance_cost_ttm", "revenue_ttm"), "earnings_yield": F.try_divide("pat_ttm", "mcap"), "sales_yield": F.try_divide("revenue_ttm", "mcap"),
        "ps_ratio": F.col("ps"), "ps_chg_3m": change("ps", 1), "ps_chg_6m": change("ps", 2), "ps_chg_12m": change("ps", 4),
        "pe_ratio": F.col("pe"), "pe_chg_3m": change("pe", 1), "pe_chg_6m": change("pe", 2), "pe_chg_12m": change("pe", 4), "size": F.log("mcap"), "op_margin_pctile": F.col("pctile"),
    }
    rough = {"rerating_share_12m": change("ps", 4) / split, "sales_share_12m": F.log(F.col("revenue_ttm") / ops.back("revenue_ttm", 4)) / split}
    own = q.select(
        "entity_id", "period_end", "qi", "sector", "ps", rounded("q_pat_yoy", 5).alias("q_pat_yoy"), rounded(change("q_pat_yoy", 1), 5).alias("pat_accel"),
        *[rounded(c, 6).alias(n) for n, c in factors.items()], *[rounded(c, 4).alias(n) for n, c in rough.items()],
    )
    medians = own.groupBy("sector", "qi").agg(F.when(F.count("ps") >= 3, F.percentile("ps", F.lit(0.5))).alias("med"))
    past = medians.select("sector", (F.col("qi") + 4).alias("qi"), F.col("med").alias("past"))
    both = own.join(medians, ["sector", "qi"], "left").join(past, ["sector", "qi"], "left")
    return both.withColumns({"ps_vs_sector": rounded(F.col("ps") - F.col("med"), 6), "sector_ps_chg_12m": rounded(F.col("med") - F.col("past"), 6)}).drop("qi", "sector", "ps", "med", "past")


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS s FROM orders), x AS (SELECT s, n, CAST(s + to_months(n) AS DATE) - 1 AS e, (month(s) + 8) % 12 AS k FROM m, (VALUES (1), (2), (3), (6), (9), (12)) v(n)),
z AS (SELECT *, (month(e) + 8) % 12 AS ke, 'FY' || lpad(CAST((year(e) + CASE WHEN month(e) > 3 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') AS y FROM x)
SELECT s AS period_start, e AS period_end, CASE WHEN n = 1 THEN strftime(s, '%b %Y') WHEN n = 3 AND k % 3 = 0 THEN 'Q' || CAST(k // 3 + 1 AS VARCHAR) || y WHEN n = 6 AND k = 0 THEN 'H1' || y WHEN n = 6 AND k = 6 THEN 'H2' || y WHEN n = 9 AND k = 0 THEN '9M' || y
WHEN n = 12 AND k = 0 THEN y WHEN n = 12 THEN 'TTM to ' || CASE WHEN ke % 3 = 2 THEN 'Q' || CAST(ke // 3 + 1 AS VARCHAR) || y ELSE strftime(e, '%-d %b %Y') END WHEN k = 0 THEN 'YTD to ' || strftime(e, '%-d %b %Y') END AS label,
CASE WHEN month(e) % 3 = 0 THEN CAST(date_trunc('month', e) - INTERVAL 2 MONTH AS DATE) - 1 END AS quarter_before FROM z""")
def fiscal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of spans that begin with a month of the orders, and the quarter end before those that close a quarter."""
    months = table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("period_start")).distinct()
    spans = months.select("period_start", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 6, 9, 12)])).alias("n")).withColumn("period_end", F.date_add(F.add_months("period_start", F.col("n")), -1))
    return spans.select("period_start", "period_end", periods.fiscal_label(F.col("period_start"), F.col("period_end")).alias("label"), periods.quarter_back(F.col("period_end"), 1).alias("quarter_before"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, left(o_orderpriority, 1) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IN ('1', '2', '3') THEN d WHEN p = '4' AND day(d) = 1 THEN d END AS period_end, CAST(date_trunc('week', d) AS DATE) AS week FROM s""")
def announcement_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period end that an announcement's subject names: by numbers, by a short or full month, twice, or as the day of a meeting only."""
    day = F.to_date("o_orderdate")
    p = F.left("o_orderpriority", F.lit(1))
    first = F.date_format(F.trunc(day, "month"), "d/M/yyyy")
    subject = (
        F.when(p == "1", F.concat(F.lit("Results for the quarter ended "), F.date_format(day, "dd.MM.yyyy"), F.lit(", board met on 01/01/2020")))
        .when(p == "2", F.concat(F.lit("Quarter Ended on "), F.date_format(day, "d"), F.lit("th "), F.date_format(day, "MMM, yyyy")))
        .when(p == "3", F.concat(F.lit("half year ending "), F.date_format(day, "d MMMM yyyy"), F.lit(" and quarter ended "), F.date_format(day, "d-M-yyyy")))
        .when(p == "4", F.concat(F.lit("Year ended "), first, F.lit(" restated for the year ended "), F.date_format(day, "d/M/yyyy")))
        .otherwise(F.concat(F.lit("Board meeting on "), F.date_format(day, "d MMMM yyyy"), F.lit("; ended 31/31/2021")))
    )
    # the tables begin in the nineties, the pattern reads years of this century: such subjects name another one
    shifted = F.regexp_replace(subject, r"\b19(\d\d)\b", "20$1")
    found = periods.parse_period_end(shifted)
    century = F.when(day < F.lit("2000-01-01").cast("date"), F.add_months(found, -1200)).otherwise(found)
    return table(spark, sf_dir, "orders").select("o_orderkey", century.alias("period_end"), periods.week_monday(day).alias("week"))


CUMULATIVE = """u AS (SELECT entity_id, fy, fq, period_end, revenue, qi FROM q), c AS (SELECT a.entity_id, CAST(make_date(CAST(a.fy - 1 AS INT), 4, 1) AS DATE) AS s, a.period_end AS e, a.fq * 3 AS m, round(sum(b.revenue), 2) AS v FROM u a JOIN u b ON a.entity_id = b.entity_id AND a.fy = b.fy AND b.fq <= a.fq GROUP BY ALL)"""


@query(f"""WITH {QUARTERS}, {CUMULATIVE},
d AS (SELECT a.entity_id, CASE WHEN a.m = 6 THEN 'q2_from_h1' WHEN a.m = 9 THEN 'q3_from_9m' WHEN b.m = 9 THEN 'q4_from_fy' ELSE 'h2_from_fy' END AS formula, b.e + 1 AS s, a.e AS e, a.v - b.v AS v FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.s = b.s AND (a.m = b.m + 3 OR (a.m = 12 AND b.m = 6))),
h AS (SELECT entity_id, s, e, v FROM c WHERE m = 3 UNION ALL SELECT entity_id, s, e, v FROM d WHERE formula <> 'h2_from_fy'),
w AS (SELECT a.entity_id, min(b.s) AS s, a.e, sum(b.v) AS v FROM h a JOIN h b ON a.entity_id = b.entity_id AND b.s BETWEEN CAST(a.s - INTERVAL 9 MONTH AS DATE) AND a.s GROUP BY a.entity_id, a.s, a.e HAVING count(*) = 4 AND month(min(b.s)) <> 4),
p AS (SELECT a.entity_id, CAST(a.e + 1 - INTERVAL 12 MONTH AS DATE) AS s, a.e, y.v + a.v - b.v AS v FROM c a JOIN c y ON y.entity_id = a.entity_id AND y.m = 12 AND y.e + 1 = a.s JOIN c b ON b.entity_id = a.entity_id AND b.m = a.m AND b.s = y.s WHERE a.m < 12)
SELECT entity_id, formula, s AS period_start, e AS period_end, round(v, 2) AS value FROM d UNION ALL SELECT entity_id, 'ttm_sum_of_4', s, e, round(v, 2) FROM w UNION ALL SELECT entity_id, 'ttm_from_fy_and_ytd', s, e, round(v, 2) FROM p""")
def period_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters, second halves and trailing years from cumulative filings of a fiscal year."""
    year = F.to_date(F.make_date(F.col("fy") - 1, F.lit(4), F.lit(1)))
    w = ops.Window.partitionBy("entity_id", "fy").orderBy("fq")
    filed = quarters(spark, sf_dir).select("entity_id", year.alias("period_start"), "period_end", rounded(F.sum("revenue").over(w), 2).alias("value"))
    return ops.derive_periods(filed).withColumn("value", rounded("value", 2))


@query("""WITH c AS (SELECT o_custkey AS key, CAST(date_trunc('month', o_orderdate) AS DATE) + CASE WHEN day(o_orderdate) > 15 THEN 15 ELSE 0 END AS s, CASE WHEN day(o_orderdate) > 15 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) + 14 END AS e, o_totalprice AS v FROM orders),
x AS (SELECT c_nationkey AS sector, c_mktsegment AS segment, s, e, sum(v) AS v FROM c JOIN customer ON c_custkey = key GROUP BY ALL),
t AS (SELECT sector, segment, CAST(unnest(generate_series(CAST(date_trunc('month', s) AS DATE), CAST(date_trunc('month', e) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month, s, e, v FROM x), n AS (SELECT sector, segment, month, count(*) AS n_cells, sum(v) AS total, bool_or(s < month OR e > last_day(month)) AS bad FROM t GROUP BY 1, 2, 3),
days AS (SELECT sector, segment, month, count(DISTINCT d) AS d FROM (SELECT sector, segment, month, unnest(generate_series(greatest(s, month), least(e, last_day(month)), INTERVAL 1 DAY)) AS d FROM t) GROUP BY 1, 2, 3)
SELECT sector, segment, month, n_cells, CASE WHEN NOT bad AND d = day(last_day(month)) THEN round(total, 2) END AS total, CASE WHEN bad OR d < day(last_day(month)) THEN 'incomplete_month' END AS refusal FROM n JOIN days USING (sector, segment, month)""")
def month_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of half months by nation and segment, summed to months that they cover exactly."""
    day, late = F.to_date("o_orderdate"), F.day("o_orderdate") > 15
    first = F.trunc(day, "month")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(late, F.date_add(first, 15)).otherwise(first).alias("period_start"), F.when(late, F.last_day(day)).otherwise(F.date_add(first, 14)).alias("period_end"), "o_totalprice",
    )
    by = ["sector", "segment"]
    cells = o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sector"), F.col("c_mktsegment").alias("segment")), "c_custkey")
    cells = cells.groupBy(*by, "period_start", "period_end").agg(F.sum("o_totalprice").alias("value"))
    return ops.covered_months(cells, by).withColumn("total", rounded("total", 2))
