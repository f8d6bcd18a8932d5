"""Tokens, sentences and windows of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"
#: Bytes of terms: a-z and 0-9.
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[ord("0") : ord("9") + 1] = True


def trim_ws(c: Column) -> Column:
    """Without white space (any kind) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`tokens` of lower-cased texts, inside a task: all terms, one text after another, and how many
    each text has."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    solid = IN_TERM[whole]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][ends[:-1] < len(whole)]
    first[begins] = solid[begins]  # a text's first byte goes on no term of the text before
    sizes = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    kept, starts = whole[solid], np.flatnonzero(first[solid])
    offsets = np.append(starts, len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return found.cast(pa.string()), sizes


def ws_tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(trim_ws(F.lower(c)), BLANK), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences: the text is cut after ``.``, ``!`` or ``?`` with white space; blank ones go."""
    parts = F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), trim_ws)
    return F.filter(parts, lambda s: s != "")


def safe_name(c: Column) -> Column:
    """A name fit for files: everything but word characters, ``-`` and ``.`` becomes ``_``."""
    return F.regexp_replace(c, r"(?U)[^\w\-.]", "_")


def windows(df: DataFrame, text: str, size: int = 512, overlap: int = 64, words: bool = False) -> DataFrame:
    """``df`` with a row for each window of ``text``: ``window`` (from 0) and ``window_text``.

    Windows have ``size`` characters (or words) and start ``size - overlap`` apart; the last one
    ends with the text, and none lies within the one before it. Empty texts give no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    step, unit = size - overlap, ws_split(F.col(text)) if words else None
    n = F.size(unit) if words else F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    cut = df.filter(F.col(text).isNotNull() & (n > 0)).withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("window") * step + 1
    piece = F.array_join(F.slice(unit, start, F.lit(size)), " ") if words else F.substring(F.col(text), start, F.lit(size))
    return cut.withColumn("window_text", piece)


def ws_split(c: Column) -> Column:
    """Words between white space, in their own case."""
    return F.filter(F.split(trim_ws(c), BLANK), lambda w: w != "")
