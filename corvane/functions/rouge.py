"""ROUGE-L F1 over stemmed tokens.  A longest common subsequence has no built-in form, so it runs as a pandas UDF;
rows are bit vectors, one machine operation per 60-odd tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHED_WORDS = 1 << 16
_TOKEN = re.compile(r"[a-z0-9]+")

#: Endings and what takes their place in steps 2 to 4 of Porter's algorithm, with the later additions in common use.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """c or v for each letter; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y; or a vowel and a consonant as the whole word."""
    shape = _shape(word)
    return shape == "vc" or shape.endswith("cvc") and word[-1] not in "wxy"


def _swapped(word: str, rules: list[tuple[str, str]]) -> str:
    """The first ending that fits is replaced if something with a measure is left."""
    for end, put in rules:
        if word.endswith(end):
            return word[: -len(end)] + put if _measure(word[: -len(end)]) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            return word[: -len(end)] + put
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for end in ("ed", "ing"):
        stem = word[: -len(end)]
        if word.endswith(end) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def stem(word: str, known: dict[str, str] = {}) -> str:  # noqa: B006
    """Porter's stemmer (1980) with the additions in common use; words of up to three letters stay."""
    if word not in known:
        if len(known) >= CACHED_WORDS:
            known.clear()
        known[word] = _stem(word)
    return known[word]


def _stem(word: str) -> str:
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]):
        word = _swapped(word[:-2], STEP2)
    elif word.endswith("logi"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        word = _swapped(word, STEP2)
    word = _swapped(word, STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)] + end[: end in ("sion", "tion")]
            word = rest if _measure(rest) > 1 else word
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def lcs(a: list[str], b: list[str]) -> int:
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def f1(target: str | None, claim: str | None) -> float:
    a, b = ([stem(w) for w in _TOKEN.findall((x or "").lower())] for x in (target, claim))
    n = lcs(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def rouge_l_f1(target: Column, claim: Column) -> Column:
    @F.pandas_udf("double")
    def score(t: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f1(x, y) for x, y in zip(t, c, strict=True)])

    return score(target, claim)
