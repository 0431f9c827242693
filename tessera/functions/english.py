"""English analysis as an option of the sparse index: stop words and Porter's stemmer.

Stop words are dropped by a column expression.  Stemming has no built-in counterpart, so it is an
Arrow-batched UDF with a cache of the words a worker has seen.  Both work on token arrays.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The classic English stop words of text search.
STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)

# The suffix tables of the published algorithm (M. F. Porter, 1980).
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """The word as vowels and consonants: y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    hit = max((s for s, _ in table if word.endswith(s)), key=len, default=None)
    if hit and _measure(word[: -len(hit)]) > 0:
        return word[: -len(hit)] + dict(table)[hit]
    return word


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or "v" not in _shape(w[:-cut]):
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _doubled(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short(w) else w


def _last_suffix(w: str) -> str:
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4:-3] in ("s", "t")):
        return w[: -len(hit)]
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words with other letters stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    return _tidy(_last_suffix(_replaced(_replaced(w, _STEP2), _STEP3)))


def without_stop_words(tokens: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def stemmed(tokens: Column) -> Column:
    """Every token's stem; null stays null."""

    @F.pandas_udf("array<string>")
    def stems(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [porter(t) for t in a])

    return stems(tokens)


def english(tokens: Column) -> Column:
    """Stop words dropped, the rest stemmed."""
    return stemmed(without_stop_words(tokens))
