"""Fiscal periods as columns. A fiscal year ends with the month `ends` (3: it runs from April to March)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of months and their usual short forms.
MONTH_NAMES: dict[str, int] = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: The words after which a text gives the day that a period closes on, what may stand before the day and after it.
CLOSING_WORDS = ("ended", "ending")
BEFORE_DAY, AFTER_DAY = ("on",), ("st", "nd", "rd", "th")


def _into_year(day: Column, ends: int) -> Column:
    """Months from the begin of the fiscal year to the month of a day: 0 to 11."""
    return F.pmod(F.month(day) - 1 - ends, F.lit(12))


def fiscal_start(day: Column, ends: int = 3) -> Column:
    return F.add_months(F.trunc(day, "month"), -_into_year(day, ends))


def fiscal_year(day: Column, ends: int = 3) -> Column:
    """The year in which the fiscal year of a day ends."""
    return F.year(F.add_months(fiscal_start(day, ends), 11))


def fiscal_quarter(day: Column, ends: int = 3) -> Column:
    return F.floor(_into_year(day, ends) / 3).cast("int") + 1


def whole_months(start: Column, end: Column) -> Column:
    """Months from start to end, both included; null unless they are whole."""
    after = F.date_add(end, 1)
    months = 12 * (F.year(after) - F.year(start)) + F.month(after) - F.month(start) - (F.day(after) < F.day(start)).cast("int")
    return F.when(F.add_months(start, months) == after, months)


#: The kinds of periods.
KINDS = ("POINT", "M", "Q", "H1", "9M", "FY", "H2", "TTM", "YTD")


def period_kind(start: Column, end: Column, ends: int = 3) -> Column:
    """POINT, M, Q, H1, 9M, FY, H2, TTM or YTD; null for any other span, a single day or one that ends before it starts."""
    begin, months = fiscal_start(end, ends), whole_months(start, end)
    first, closes = start == begin, end == F.date_add(F.add_months(begin, 12), -1)
    on_quarter = F.pmod(_into_year(start, ends), F.lit(3)) == 0
    return (
        F.when(start.isNull() & end.isNotNull(), "POINT")
        .when((end <= start) | start.isNull(), F.lit(None).cast("string"))
        .when((F.day(start) == 1) & (end == F.last_day(start)), "M")
        .when((months == 3) & (F.day(start) == 1) & on_quarter, "Q")
        .when(first & (months == 6), "H1")
        .when(first & (months == 9), "9M")
        .when(first & closes, "FY")
        .when((months == 6) & closes, "H2")
        .when(months == 12, "TTM")
        .when(first, "YTD")
    )


def fiscal_label(start: Column, end: Column, ends: int = 3) -> Column:
    """'Q2FY27', 'H1FY27', '9MFY27', 'FY26', 'TTM to Q2FY27', 'Sep 2026', 'YTD to 31 Aug 2026', or the day of a point; null without a kind."""
    kind = period_kind(start, end, ends)
    year = F.concat(F.lit("FY"), F.lpad(F.pmod(fiscal_year(end, ends), F.lit(100)).cast("string"), 2, "0"))
    quarter = F.concat(F.lit("Q"), fiscal_quarter(end, ends).cast("string"), year)
    day = F.date_format(end, "d MMM yyyy")
    at_quarter = (end == F.last_day(end)) & (F.pmod(_into_year(end, ends), F.lit(3)) == 2)
    return (
        F.when(kind == "POINT", day)
        .when(kind == "M", F.date_format(end, "MMM yyyy"))
        .when(kind == "Q", quarter)
        .when(kind == "FY", year)
        .when(kind == "TTM", F.concat(F.lit("TTM to "), F.when(at_quarter, quarter).otherwise(day)))
        .when(kind == "YTD", F.concat(F.lit("YTD to "), day))
        .otherwise(F.concat(kind, year))
    )


def label_order(label: Column) -> Column:
    """A number by which labels such as Q2FY27, H1FY27 and FY27 sort; a half comes after its quarters, the year last, what is no label after all."""
    bare = F.upper(F.regexp_replace(label, " ", ""))
    shape = r"^(Q[1-4]|H[12]|9M)?FY(\d{4}|\d{2})$"
    head, digits = F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2)
    year = F.when(F.length(digits) == 2, digits.cast("int") + 2000).when(F.length(digits) == 4, digits.cast("int"))
    places = {"Q1": 1, "Q2": 2, "H1": 3, "Q3": 4, "9M": 5, "Q4": 6, "H2": 7, "": 8}
    place = reduce(lambda c, p: c.when(head == p[0], p[1]), list(places.items())[1:], F.when(head == "Q1", 1))
    return F.when(F.length(digits) > 0, 10 * year + place).otherwise(99999)


def quarter_back(day: Column, n: int) -> Column:
    """The quarter end n quarters before; null for a day that is no quarter end."""
    return F.when((day == F.last_day(day)) & (F.month(day) % 3 == 0), F.last_day(F.add_months(day, -3 * n)))


def parse_period_end(text: Column) -> Column:
    """The one day of this century that a text says a period 'ended' or is 'ending' on; null if there is none, or two.

    The text is cut at those words. What follows is read token by token, a token being a run of digits or of letters: the day,
    the month by name or number, the year.
    """
    names = F.create_map(*[F.lit(x) for pair in MONTH_NAMES.items() for x in pair])
    closing = rf"(?<![a-z])(?:{'|'.join(CLOSING_WORDS)})(?![a-z])"
    parts = F.split(F.lower(text), closing)

    def date(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit("[0-9]+|[a-z]+"), F.lit(0))
        at = lambda k: F.get(found, k)
        first = F.when(at(F.lit(0)).isin(*BEFORE_DAY), 1).otherwise(0)
        day = at(first)
        second = first + F.when(at(first + 1).isin(*AFTER_DAY), 2).otherwise(1)
        month, year = at(second), at(second + 1)
        number = F.coalesce(F.try_element_at(names, month), F.when(F.length(month) <= 2, month.try_cast("int")))
        this_century = (F.length(year) == 4) & (F.left(year, F.lit(2)) == "20")
        whole = this_century & (F.length(day) <= 2) & number.isNotNull()
        return F.when(whole, F.try_to_date(F.concat_ws("-", year, number.cast("string"), day), "yyyy-M-d"))

    dates = F.array_distinct(F.array_compact(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), date)))
    return F.when(F.size(dates) == 1, F.get(dates, F.lit(0)))


def week_monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))
