"""The ratio panel: named ratios over the lines of a quarter, its trailing sums and the periods before, with refusals."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .finance import days_of, margin, ratio

Inputs = Mapping[str, Column]


@dataclass(frozen=True)
class Ratio:
    """Names of inputs, the column over them, its unit, and the input that must be above zero, if one must."""

    inputs: str
    value: Callable[[Inputs], Column]
    unit: str
    positive: str | None = None


def _growth(now: str, before: str) -> Ratio:
    return Ratio(f"{now} {before}", lambda x: 100 * (ratio(x[now], x[before]) - 1), "pct", before)


def _same(name: str, unit: str = "inr") -> Ratio:
    return Ratio(name, lambda x: x[name], unit)


RATIOS: dict[str, Ratio] = {
    "ebitda": _same("ebitda"),
    "ebit": _same("ebit"),
    "ebitda_margin_pct": Ratio("ebitda revenue", lambda x: margin(x["ebitda"], x["revenue"]), "pct"),
    "ebit_margin_pct": Ratio("ebit revenue", lambda x: margin(x["ebit"], x["revenue"]), "pct"),
    "pat_margin_pct": Ratio("pat revenue", lambda x: margin(x["pat"], x["revenue"]), "pct"),
    "gross_margin_pct": Ratio("revenue materials purchases stock_change", lambda x: margin(x["revenue"] - (x["materials"] + x["purchases"] + x["stock_change"]), x["revenue"]), "pct"),
    "interest_coverage": Ratio("ebitda finance_cost", lambda x: ratio(x["ebitda"], x["finance_cost"]), "x"),
    "revenue_growth_yoy_pct": _growth("revenue", "revenue_year_ago"),
    "pat_growth_yoy_pct": _growth("pat", "pat_year_ago"),
    "revenue_growth_qoq_pct": _growth("revenue", "revenue_before"),
    "pat_growth_qoq_pct": _growth("pat", "pat_before"),
    "ttm_printed": _same("ttm_printed"),
    "fy_printed": _same("fy_printed"),
    "fy_sum": _same("fy_sum"),
    "eps_basic_fy": _same("eps_fy", "inr_per_share"),
    "eps_ttm": _same("eps_ttm", "inr_per_share"),
    "pat_ttm": _same("pat_ttm"),
    "pat_before_exceptional_ttm": _same("pat_plain_ttm"),
    "dividend_payout_pct": Ratio("dps eps_fy", lambda x: margin(x["dps"], x["eps_fy"]), "pct", "eps_fy"),
    "book_value_per_share": Ratio("net_worth shares", lambda x: ratio(x["net_worth"], x["shares"]), "inr_per_share", "shares"),
    "market_cap": Ratio("close shares", lambda x: x["close"] * x["shares"], "inr"),
    "net_debt_to_ebitda": Ratio("borrowings cash ebitda_ttm", lambda x: ratio(x["borrowings"] - x["cash"], x["ebitda_ttm"]), "x", "ebitda_ttm"),
    "debt_to_equity": Ratio("borrowings net_worth", lambda x: ratio(x["borrowings"], x["net_worth"]), "x", "net_worth"),
    "nim_pct": Ratio("net_interest total_assets total_assets_before", lambda x: margin(4 * x["net_interest"], (x["total_assets"] + x["total_assets_before"]) / 2), "pct"),
    "roce": Ratio("ebit_ttm net_worth borrowings", lambda x: margin(x["ebit_ttm"], x["net_worth"] + x["borrowings"]), "pct"),
    "roe": Ratio("pat_ttm net_worth", lambda x: margin(x["pat_ttm"], x["net_worth"]), "pct", "net_worth"),
    "roa": Ratio("pat_ttm total_assets", lambda x: margin(x["pat_ttm"], x["total_assets"]), "pct"),
    "opex_to_net_total_income_pct": Ratio(
        "employee_cost fees other_expenses depreciation revenue other_income finance_cost",
        lambda x: margin(x["employee_cost"] + x["fees"] + x["other_expenses"] + x["depreciation"], x["revenue"] + x["other_income"] - x["finance_cost"]),
        "pct",
    ),
    "receivable_days": Ratio("receivables revenue_ttm", lambda x: days_of(x["receivables"], x["revenue_ttm"]), "days"),
    "inventory_days": Ratio("inventory revenue_ttm", lambda x: days_of(x["inventory"], x["revenue_ttm"]), "days"),
    "payable_days": Ratio("payables revenue_ttm", lambda x: days_of(x["payables"], x["revenue_ttm"]), "days"),
    "nwc_days": Ratio("receivables inventory payables revenue_ttm", lambda x: days_of(x["receivables"] + x["inventory"] - x["payables"], x["revenue_ttm"]), "days"),
    "current_ratio": Ratio("current_assets current_liabilities", lambda x: ratio(x["current_assets"], x["current_liabilities"]), "x"),
    "cost_to_income": Ratio("employee_cost other_expenses net_interest other_income", lambda x: margin(x["employee_cost"] + x["other_expenses"], x["net_interest"] + x["other_income"]), "pct"),
    "pe": Ratio("close eps_ttm", lambda x: ratio(x["close"], x["eps_ttm"]), "x", "eps_ttm"),
    "pb": Ratio("close shares net_worth", lambda x: ratio(x["close"] * x["shares"], x["net_worth"]), "x", "net_worth"),
    "ev_ebitda": Ratio("close shares borrowings cash ebitda_ttm", lambda x: ratio(x["close"] * x["shares"] + x["borrowings"] - x["cash"], x["ebitda_ttm"]), "x", "ebitda_ttm"),
    "kpi_growth_yoy_pct": _growth("order_intake", "order_intake_year_ago"),
    "kpi_growth_qoq_pct": _growth("order_intake", "order_intake_before"),
    "book_to_bill": Ratio("order_intake revenue", lambda x: ratio(x["order_intake"], x["revenue"]), "x"),
    "order_book_coverage_years": Ratio("order_book revenue_ttm", lambda x: ratio(x["order_book"], x["revenue_ttm"]), "x", "revenue_ttm"),
}


def reading(name: str) -> Column:
    """A struct (ratio, value, unit, refusal) over columns named as the inputs; value or refusal is null, the other isn't.

    A missing input is refused before one that isn't above zero, and that before a zero to divide by.
    """
    r = RATIOS[name]
    names = r.inputs.split()
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    bad = F.col(r.positive) <= 0 if r.positive else F.lit(False)
    value = r.value({n: F.col(n) for n in names}).cast("double")
    refusal = F.when(missing, "missing_input").when(bad, "not_positive").when(value.isNull(), "zero_denominator")
    return F.struct(F.lit(name).alias("ratio"), F.when(~missing & ~bad, value).alias("value"), F.lit(r.unit).alias("unit"), refusal.alias("refusal"))
