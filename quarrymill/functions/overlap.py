"""Overlap of a generated text with a reference."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import trim_ws, ws_tokens


def exact_match(prediction: Column, truth: Column) -> Column:
    """1.0 when equal, trimmed and lower-cased, else 0.0."""
    return (trim_ws(F.lower(prediction)) == trim_ws(F.lower(truth))).cast("double")


def token_f1(prediction: Column, truth: Column) -> Column:
    """Distinct common words over the number of words, repeats included, on either side; 0 if there are none."""
    p, t = ws_tokens(prediction), ws_tokens(truth)
    common = F.size(F.array_intersect(p, t))
    precision, recall = common / F.nullif(F.size(p), F.lit(0)), common / F.nullif(F.size(t), F.lit(0))
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def bleu(prediction: str, truth: str) -> float:
    """BLEU-4 of one sentence against one reference; n-grams without a match count as 0.1."""
    p, t = (x.strip().lower().split() for x in (prediction or "", truth or ""))
    if not p or not t or not set(p) & set(t):
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, t)]
        clipped = sum((grams[0] & grams[1]).values())
        logs += math.log((clipped or 0.1) / max(1, len(p) - n + 1)) / 4
    brief = 1.0 if len(p) > len(t) else math.exp(1 - len(t) / len(p))
    return brief * math.exp(logs)


WORDS = re.compile(r"[a-z0-9]+")


def rouge_l(prediction: str, truth: str, stemmed: bool = True) -> float:
    """F measure of the longest common subsequence of words."""
    p, t = (WORDS.findall((x or "").lower()) for x in (prediction, truth))
    if stemmed:
        p, t = ([stem(w) if len(w) > 3 else w for w in x] for x in (p, t))
    if not p or not t:
        return 0.0
    common = common_subsequence(p, t)
    return 2 * common / (len(p) + len(t)) if common else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of a whole
    number: zero bits of ``row`` are where the length grows (H. Hyyro, 2004)."""
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(b) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def bleu_score(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([bleu(p, t) for p, t in zip(prediction, truth)], dtype=float)


@F.pandas_udf(T.DoubleType())
def rouge_l_score(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(p, t) for p, t in zip(prediction, truth)], dtype=float)


# Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) with the extensions that the
# common Python library has on by default. Suffix lists and irregular forms are fixed values.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as vowels (v) and consonants (c); y is a vowel after a consonant."""
    found = ""
    for k, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and k > 0 and found[-1] == "c")
        found += "v" if vowel else "c"
    return found


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _step_2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step_2(word[:-2])  # what ends with "al" now may have another suffix
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, STEP_2)


def _replace(word: str, pairs: list[tuple[str, str]]) -> str:
    """The longest matching suffix is replaced when the rest has a measure above 0."""
    hit = max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    if hit and _measure(word[: -len(hit[0])]) > 0:
        return word[: -len(hit[0])] + hit[1]
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "ie" if len(word) == 4 else "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _replace(_step_2(word), STEP_3)
    hit = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if hit and _measure(word[: -len(hit)]) > 1 and (hit != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(hit)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
