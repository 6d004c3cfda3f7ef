"""Text columns: tokens, figures, tags and snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic. Fixed list.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "les", "des", "que", "der", "die", "und", "los", "las")
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def keywords(text: Column | str, least: int = 4) -> Column:
    """Distinct tokens of some length that are no stop words."""
    kept = F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS))
    return F.array_distinct(kept)


def normalise(text: Column | str) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def n_numbers(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def first_number(text: Column | str) -> Column:
    """The first number, thousands commas left out; null without one."""
    found = F.regexp_replace(F.regexp_extract(text, NUMBER, 0), ",", "")
    return F.when(found != "", found.cast("double"))


def tags(text: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The names of the rules whose pattern is found, in their order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_compact(F.array(*[F.when(c.rlike(p), name) for name, p in rules]))


def category(text: Column | str, rules: Sequence[tuple[str, str]], otherwise: str = "other") -> Column:
    """The first rule that fits."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.lit(otherwise)
    for name, p in reversed(rules):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def snippet(text: Column | str, term: Column, width: int = 80) -> Column:
    """A window of the text around the first occurrence of a term."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.instr(F.lower(c), term)
    return F.when(at > 0, F.substr(c, F.greatest(at - width // 2, F.lit(1)), F.lit(width)))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def normalise_name(name: Column | str) -> Column:
    """A client's name: capitals and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " "), " +", " "))
