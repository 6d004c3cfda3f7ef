"""Null-safe finance columns: missing or unusable input gives null, never a guess."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null over zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def margin(a: Column | str, b: Column | str) -> Column:
    return 100 * ratio(a, b)


def growth(begin: Column | str, end: Column | str) -> Column:
    """Percent change; null from zero."""
    return 100 * (ratio(end, begin) - 1)


def cagr(begin: Column | str, end: Column | str, years: Column | str) -> Column:
    """Yearly compound growth in percent, only between positive values over positive time."""
    b, e, n = _col(begin), _col(end), _col(years)
    return F.when((b > 0) & (e > 0) & (n > 0), 100 * (F.pow(ratio(e, b), 1 / n) - 1))


def cagr_between(begin: Column | str, end: Column | str, since: Column | str, until: Column | str) -> Column:
    return cagr(begin, end, F.datediff(_col(until), _col(since)) / 365.25)


def delta(begin: Column | str, end: Column | str) -> Column:
    return _col(end) - _col(begin)


def add(*values: Column | str) -> Column:
    """The sum, null if any is."""
    return reduce(lambda a, b: a + b, map(_col, values))


def working_capital(inventory, receivables, payables) -> Column:
    return add(inventory, receivables) - _col(payables)


def invested_capital(net_worth, borrowings, cash) -> Column:
    """Net worth and debt less cash, only if above zero."""
    v = add(net_worth, borrowings) - F.coalesce(_col(cash), F.lit(0.0))
    return F.when(v > 0, v)


def roic(operating_profit, net_worth, borrowings, cash) -> Column:
    return margin(operating_profit, invested_capital(net_worth, borrowings, cash))


def per_share(total, shares) -> Column:
    return F.when(_col(shares) > 0, ratio(total, shares))


def days_of(balance, flow) -> Column:
    return 365 * ratio(balance, flow)


def range_position(x, low, high) -> Column:
    return margin(_col(x) - _col(low), _col(high) - _col(low))


def third(position: Column) -> Column:
    return F.when(position < 100 / 3, "lower").when(position <= 200 / 3, "middle").when(position.isNotNull(), "upper")


def fair_pb(roe, growth_rate, cost_of_equity) -> Column:
    r, g, k = _col(roe), _col(growth_rate), _col(cost_of_equity)
    return F.when((k > g) & (r >= g), ratio(r - g, k - g))


def implied_roe(pb, growth_rate, cost_of_equity) -> Column:
    return _col(pb) * (_col(cost_of_equity) - _col(growth_rate)) + _col(growth_rate)


def implied_growth(pe, required, payout) -> Column:
    return ratio(_col(pe) * _col(required) - _col(payout), _col(pe) + _col(payout))


def annualise(rate, months, compound: bool = True) -> Column:
    r, m = _col(rate), _col(months)
    return F.when(m > 0, F.pow(1 + r, 12 / m) - 1 if compound else r * 12 / m)


def wilson_lower(hits, n, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval of a share."""
    h, m = _col(hits).cast("double"), _col(n).cast("double")
    p = ratio(h, m)
    return F.when(m > 0, (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m))


def short_term_net(gross, cost: float, rate: float) -> Column:
    """A gross return less cost and tax, which only a gain bears."""
    g = _col(gross)
    return g - cost - F.greatest(g, F.lit(0.0)) * rate


def bracket(entry, sigma_pct, action, up: float = 2.0, down: float = 1.0) -> tuple[Column, Column]:
    """Target and stop around an entry price, mirrored for SELL."""
    side = F.when(_col(action) == "SELL", -1.0).otherwise(1.0)
    step = _col(sigma_pct) / 100
    return _col(entry) * (1 + side * up * step), _col(entry) * (1 - side * down * step)


def decayed_significance(start, months, half_life: float | None) -> Column:
    """Significance after months; a structural cause (no half-life) keeps it."""
    return _col(start) if half_life is None else _col(start) * F.exp(-math_ln2() / half_life * _col(months))


def math_ln2() -> float:
    return 0.6931471805599453


def ripple_significance(magnitude, probability, elasticity, lag_months) -> Column:
    return F.abs(_col(magnitude) * _col(probability) * _col(elasticity)) * 20 / (1 + F.log1p(_col(lag_months)))


def flow_score(conviction, distance_pct, close, sma20, sma50, sma200, rsi) -> Column:
    """Technical flow 0 to 100: conviction, nearness to the high (none or zero counts as 15), trend and RSI band (none or zero counts as 50).

    A close above the short average that isn't below the middle one is a trend, and a middle average not below the long one is half of one more.
    """
    none = lambda x: F.coalesce(_col(x).cast("double"), F.lit(0.0))
    d, r = (F.when(none(x) == 0, otherwise).otherwise(none(x)) for x, otherwise in ((distance_pct, 15.0), (rsi, 50.0)))
    c, a, b, e = none(close), none(sma20), none(sma50), none(sma200)
    trend = F.when((c > a) & (a >= b), 1.0).otherwise(0.0) + F.when((e > 0) & (b >= e), 0.5).otherwise(0.0)
    band = F.when(r.between(55, 75), 1.0).when((r >= 45) & (r < 55), 0.5).otherwise(0.0)
    total = 0.35 * F.coalesce(_col(conviction), F.lit(0.0)) + 2.5 * F.greatest(F.lit(0.0), 15 - d) + 15 * trend + 15 * band
    return F.greatest(F.least(total, F.lit(100.0)), F.lit(0.0))


def fundamental_score(revenue_growth, profit_growth, margin_delta_bps, roce) -> Column:
    """Fundamentals 0 to 100: growth above zero, margin gain and a bonus for return on capital."""
    up = lambda x: F.greatest(F.coalesce(_col(x), F.lit(0.0)), F.lit(0.0))
    r = F.coalesce(_col(roce), F.lit(14.0))
    bonus = F.when(r >= 20, 10.0).when(r >= 15, 5.0).otherwise(0.0)
    return F.least(0.4 * up(revenue_growth) + 0.4 * up(profit_growth) + 10 * up(_col(margin_delta_bps) / 50) + bonus, F.lit(100.0))


def forensic_reasons(pledge_pct, interest_coverage, debt_to_equity) -> Column:
    """Why a company fails the solvency gates, '; ' between; empty if it passes. Missing or negative input fails."""
    p, c, d = _col(pledge_pct), _col(interest_coverage), _col(debt_to_equity)
    gates = [
        F.when(p.isNull() | (p < 0) | (p > 25), "pledge"),
        F.when(c.isNull() | (c < 2), "interest coverage"),
        F.when(d.isNull() | (d < 0) | (d > 2), "debt to equity"),
    ]
    return F.array_join(F.array_compact(F.array(*gates)), "; ")


#: Factors from unit labels to one rupee.
UNITS: dict[str, float] = {"INR": 1.0, "INR_THOUSAND": 1e3, "INR_LAKH": 1e5, "INR_MN": 1e6, "INR_CRORE": 1e7}

#: Why a formula gives no value.
REFUSALS = ("missing_input", "unit_mismatch", "zero_denominator", "not_positive")


def to_rupees(value, unit) -> Column:
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return _col(value) * scale[_col(unit)]


Builder = Callable[[Mapping[str, Column]], Column]

#: The ratio panel: name, inputs and the column over them; those in per cent are scaled by 100.
FORMULAS: dict[str, tuple[tuple[str, ...], Builder]] = {
    "ebitda": (("pbt", "finance_cost", "depreciation", "other_income"), lambda x: x["pbt"] + x["finance_cost"] + x["depreciation"] - x["other_income"]),
    "ebit": (("pbt", "finance_cost"), lambda x: x["pbt"] + x["finance_cost"]),
    "ebit_margin_pct": (("pbt", "finance_cost", "revenue"), lambda x: margin(x["pbt"] + x["finance_cost"], x["revenue"])),
    "pat_margin_pct": (("pat", "revenue"), lambda x: margin(x["pat"], x["revenue"])),
    "interest_coverage": (("pbt", "finance_cost"), lambda x: ratio(x["pbt"] + x["finance_cost"], x["finance_cost"])),
    "effective_tax_rate": (("tax", "pbt"), lambda x: margin(x["tax"], x["pbt"])),
    "cfo_to_profit": (("cfo", "pat"), lambda x: ratio(x["cfo"], x["pat"])),
    "net_debt": (("debt", "cash"), lambda x: x["debt"] - x["cash"]),
    "net_debt_to_ebitda": (("debt", "cash", "pbt", "finance_cost", "depreciation"), lambda x: ratio(x["debt"] - x["cash"], x["pbt"] + x["finance_cost"] + x["depreciation"])),
    "debt_to_equity": (("debt", "net_worth"), lambda x: ratio(x["debt"], x["net_worth"])),
    "dso": (("receivables", "revenue"), lambda x: days_of(x["receivables"], x["revenue"])),
    "dio": (("inventory", "revenue"), lambda x: days_of(x["inventory"], x["revenue"])),
    "dpo": (("payables", "revenue"), lambda x: days_of(x["payables"], x["revenue"])),
    "working_capital_cycle": (("receivables", "inventory", "payables", "revenue"), lambda x: days_of(working_capital(x["inventory"], x["receivables"], x["payables"]), x["revenue"])),
    "capex_to_sales": (("capex", "revenue"), lambda x: margin(x["capex"], x["revenue"])),
    "roe": (("pat", "net_worth"), lambda x: margin(x["pat"], x["net_worth"])),
    "roce": (("pbt", "finance_cost", "net_worth", "debt"), lambda x: margin(x["pbt"] + x["finance_cost"], x["net_worth"] + x["debt"])),
    "asset_turnover": (("revenue", "total_assets"), lambda x: ratio(x["revenue"], x["total_assets"])),
    "order_book_to_revenue": (("order_book", "revenue"), lambda x: ratio(x["order_book"], x["revenue"])),
    "book_to_bill": (("order_intake", "revenue"), lambda x: ratio(x["order_intake"], x["revenue"])),
    "current_ratio": (("current_assets", "current_liabilities"), lambda x: ratio(x["current_assets"], x["current_liabilities"])),
    "payout_pct": (("dps", "eps"), lambda x: margin(x["dps"], x["eps"])),
    "book_value_per_share": (("net_worth", "shares"), lambda x: per_share(x["net_worth"], x["shares"])),
}


def evaluate(formula: str) -> tuple[Column, Column]:
    """(value, refusal) of a formula over columns named as its inputs; one of the two is null."""
    names, build = FORMULAS[formula]
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    value = build({n: F.col(n) for n in names})
    return F.when(~missing, value), F.when(missing, REFUSALS[0]).when(value.isNull(), REFUSALS[2])
