"""Letters, citations and scores out of what a model said."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("answer", "predicted_answer", "option", "choice")
#: Lines that name an answer, tried in this order.
LINES = [
    re.compile(p, re.IGNORECASE | re.MULTILINE)
    for p in (
        r"^\s*([A-Za-z])\s*$",
        r"^\s*(?:answer|choice|option)\s*[:=-]\s*([A-Za-z])(?:\b|[.)])",
        r"^\s*(?:the\s+)?(?:answer|choice|option)\s+is\s+([A-Za-z])(?:\b|[.)])",
        r"^\s*.*?\bcorrect\s+answer\s+is\s*[:=-]?\s*([A-Za-z])(?:\b|[.)])",
    )
]
FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE)
BRACES = re.compile(r"\{.*?\}", re.DOTALL)
ONE_LETTER = re.compile(r"\s*([A-Za-z])\s*")
#: Two lenient cascades, (pattern, ignores case).
EXAM_LETTERS = [
    (r"(?:answer|choice|option)\s*(?:is|:)?\s*[\*#]*\s*([A-E])\b", True),
    (r"\b([A-E])\s*(?:\.|\))\s*", True),
    (r"\*\*([A-E])\*\*", True),
    (r"^([A-E])\b", True),
    (r"\b([A-E])$", True),
    (r"\b([A-E])\b", False),
]
RUN_LETTERS = [
    (r"(?:answer is|answer:|correct option is)\s*([A-E])", True),
    (r"^\s*([A-E])[\.\)]", False),
    (r"\b([A-E])\b", False),
]
NUMBER = r"[-+]?\d*\.\d+|\d+"


def _objects(whole: str, text: str) -> Iterator[dict]:
    """JSON objects in a response, the last first: the inner ones, then the whole."""
    found = []
    for candidate in (whole, *BRACES.findall(text)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            found.append(value)
    return reversed(found)


def answer_of(response: str | None, labels: list[str]) -> str | None:
    """The one label that a response gives, strictly: a field of its last JSON object, else a line."""
    if response is None or not response.strip():
        return None
    allowed = {label.upper() for label in labels}
    said = [o[f] for o in _objects(FENCE.sub("", response.strip()), response) for f in FIELDS if isinstance(o.get(f), str)]
    letters = [m[1].upper() for s in said if (m := ONE_LETTER.fullmatch(s))]
    letters += [m[1].upper() for p in LINES if (m := p.search(response))]
    return next((x for x in letters if x in allowed), None)


def citations_of(response: str | None, allowed: list[str]) -> list[str] | None:
    """The citations of the last JSON object that cites allowed ids only, without repeats."""
    known = set(allowed)
    for found in _objects((response or "").strip().strip("`"), response or ""):
        cited = found.get("citations")
        if isinstance(cited, list) and all(isinstance(x, str) and x in known for x in cited):
            return list(dict.fromkeys(cited))
    return None


@F.pandas_udf(T.StringType())
def parse_answer(response: pd.Series, labels: pd.Series) -> pd.Series:
    """`answer_of` for columns (response, array of labels)."""
    return pd.Series([answer_of(r, [] if x is None else list(x)) for r, x in zip(response, labels)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_citations(response: pd.Series, allowed: pd.Series) -> pd.Series:
    """`citations_of` for columns (response, array of allowed ids)."""
    return pd.Series([citations_of(r, [] if x is None else list(x)) for r, x in zip(response, allowed)], dtype=object)


def letter(text: Column, patterns: list[tuple[str, bool]]) -> Column:
    """The first pattern's first match, upper-cased; empty when none matches."""
    found = [F.nullif(F.regexp_extract(text, ("(?iU)" if loose else "(?U)") + p, 1), F.lit("")) for p, loose in patterns]
    return F.upper(F.coalesce(*found, F.lit("")))


def exam_letter(text: Column) -> Column:
    from quarrymill.functions.text import trim_ws

    return letter(trim_ws(text), EXAM_LETTERS)


def run_letter(text: Column) -> Column:
    return letter(text, RUN_LETTERS)


def first_number(text: Column) -> Column:
    """The first number in a text, else 0; a sign counts only before a decimal fraction."""
    return F.coalesce(F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double"), F.lit(0.0))


def judged(text: Column, five: bool = False) -> Column:
    """A judge's score within [0, 1]; with ``five`` the judge used 1 to 5."""
    if five:
        return (F.greatest(F.lit(1.0), F.least(F.lit(5.0), first_number(text))) - 1) / 4
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), first_number(text)))
