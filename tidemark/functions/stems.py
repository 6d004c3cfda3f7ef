"""Porter's suffix stripping (1980), and folding of letters with marks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they are without, by Unicode's own decomposition.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c)) != chr(c)]

# Fixed values of the published algorithm: a suffix, what it becomes, in the order of the paper.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def folded(text: Column | str) -> Column:
    """Lower case, without marks on Latin letters."""
    c = F.regexp_replace(F.lower(text), r"\p{M}", "")
    return F.translate(c, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def _shape(word: str) -> str:
    """v and c for every letter; y after a consonant is a vowel."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y at the end."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of one lower-case English word; words of other letters or of one or two letters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # plurals
    found = _longest(word, ("sses", "ies", "ss", "s"))
    if found:
        word = word[: -len(found)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[found]
    # past forms
    found = _longest(word, ("eed", "ed", "ing"))
    if found == "eed":
        if _measure(word[:-3]):
            word = word[:-1]
    elif found and "v" in _shape(word[: -len(found)]):
        word = word[: -len(found)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        found = _longest(word, rules)
        if found and _measure(word[: -len(found)]):
            word = word[: -len(found)] + rules[found]
    found = _longest(word, _STEP4)
    if found:
        rest = word[: -len(found)]
        if _measure(rest) > 1 and (found != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(term: Column | str) -> Column:
    """stem() of a column; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map({w: stem(w) for w in words.dropna().unique()})

    return run(F.col(term) if isinstance(term, str) else term)
