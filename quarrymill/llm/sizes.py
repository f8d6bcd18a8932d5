"""Joins whose small side is broadcast only after a look at its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import materialise

#: Rows of a narrow table (an id or two) that may be broadcast: tens of megabytes.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame, name: str = "ids", weight: Column | None = None) -> DataFrame:
    """``df``, written, with a broadcast hint if it has few enough rows; else joins shuffle it. Rows
    that hold arrays count as many times as ``weight`` says, and once at least."""
    df = materialise(df, name)
    n = F.count(F.lit(1)) if weight is None else F.sum(F.greatest(weight, F.lit(1)))
    return F.broadcast(df) if (df.agg(n).first()[0] or 0) <= MOST_BROADCAST else df
