"""Exact medians against a plain sort, also of groups that need several rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import medians


def plain(values):
    order = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not order:
        return None
    a, b = order[(len(order) - 1) // 2], order[len(order) // 2]
    return a if a == b else 0.5 * a + 0.5 * b


@pytest.mark.parametrize("few, bins", [(10_000, 1024), (3, 4), (1, 2)])
def test_medians_are_exact(spark, monkeypatch, few, bins):
    monkeypatch.setattr(medians, "FEW", few)
    monkeypatch.setattr(medians, "BINS", bins)
    rng = np.random.default_rng(13)
    rows = [("a", "x", float(v)) for v in rng.normal(size=101)] + [("a", None, float(v)) for v in rng.integers(0, 3, 40)]
    rows += [("b", "x", v) for v in (1e308, -1e308, 5e-324, 0.0, 1e-300, 1.0)] + [("b", "y", None)]
    rows += [("c", "z", v) for v in (float("inf"), 2.0, float("-inf"), float("inf"), 7.0)] + [(None, "x", 4.0)] * 9 + [("d", "q", float("inf"))] * 4 + [("e", "q", float("nan")), ("e", "q", 1.0), ("e", "q", float("nan"))]
    df = spark.createDataFrame(rows, "s string, t string, v double").repartition(3)
    got = {(r.grouping, r.s, r.t): r["m"] for r in medians.exact_medians(df, "v", [(), ("s",), ("s", "t")], "m").collect()}
    want = {}
    for s, t, v in rows:
        for key in ((0, None, None), (1, s, None), (2, s, t)):
            want.setdefault(key, []).append(v)
    want = {k: plain(v) for k, v in want.items() if any(x is not None for x in v)}
    assert set(got) == set(want)
    for k, v in want.items():
        assert (math.isnan(v) and math.isnan(got[k])) or got[k] == v, k


def test_many_equal_values_and_none(spark, monkeypatch):
    monkeypatch.setattr(medians, "FEW", 10)
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.lit(2.0)).alias("v"), F.lit("g").alias("g"))
    assert medians.exact_medians(df, "v", [("g",)]).first()["median"] == 2.0
    assert medians.exact_medians(df.limit(0), "v", [("g",), ()]).count() == 0
    spread = spark.range(20_001).select(F.pow(F.lit(1.01), (F.col("id") - 10_000) / 10).alias("v"))
    assert medians.exact_medians(spread, "v", [()]).first()["median"] == 1.0
