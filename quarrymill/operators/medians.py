"""Exact medians of groups of any size, by histograms that narrow down on the middle values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import materialise, sized

#: Bins of a group in a round.
BINS = 1024
#: Values that are sorted at once when so few are left of a group.
FEW = 10_000


def exact_medians(df: DataFrame, value: str, groupings: list[tuple[str, ...]], name: str = "median") -> DataFrame:
    """The median of ``value`` for the groups of several groupings of columns, of all rows for ``()``.

    A row for each group with the columns of all groupings (null where a grouping lacks one),
    ``grouping`` (its number from 0), and ``name``: the middle value, or the mean of the two.
    Null values don't count, and a group without any other has no row; NaN comes after infinity.

    Each round counts the values within the bounds of the middle ones in `BINS` bins, for all groups at
    once, and goes on with the bin that holds the wanted place. A group keeps its bins and no values,
    until `FEW` are left. Values of any distribution end in a few rounds; equal ones in one.
    """
    keys = list(dict.fromkeys(c for g in groupings for c in g))
    every = [F.struct(F.lit(i).alias("grouping"), *[(F.col(c) if c in g else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in keys]) for i, g in enumerate(groupings)]
    rows = df.select(F.explode(F.array(*every)).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null").select("_g.*", "_v")
    own = ["grouping", *keys]
    finite = F.when(_finite(F.col("_v")), F.col("_v"))
    start = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    places = F.array(F.struct(F.lit(0).alias("_side"), F.floor((F.col("_n") - 1) / 2).alias("_at")), F.struct(F.lit(1).alias("_side"), F.floor(F.col("_n") / 2).alias("_at")))
    start = start.withColumn("_p", F.explode(places)).select(*own, "_p.*", "_n", "_lo", "_hi", "_least", "_most")
    goals = materialise(start, "medians")
    done = []
    while True:
        settled = goals.filter("_least <=> _most").select(*own, "_side", F.col("_least").alias("_found"))
        few = goals.filter(~F.col("_least").eqNullSafe(F.col("_most")) & (F.col("_n") <= FEW))
        if not few.isEmpty():
            inside = _inside(rows, sized(few, "medians"), own)
            sorted_ = inside.groupBy(*own, "_side").agg(F.sort_array(F.collect_list("_v")).alias("_all"), F.first("_at").alias("_at"))  # FEW at most
            done.append(materialise(sorted_.select(*own, "_side", F.get("_all", F.col("_at").cast("int")).alias("_found")), "medians"))
        done.append(settled)
        many = goals.filter(~F.col("_least").eqNullSafe(F.col("_most")) & (F.col("_n") > FEW))
        if many.isEmpty():
            break
        goals = materialise(_narrower(rows, sized(many, "medians"), own), "medians")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    both = found.groupBy(*own).agg(F.min(F.when(F.col("_side") == 0, F.col("_found"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_found"))).alias("_b"))
    return both.select(*own, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b")).alias(name))


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def _inside(rows: DataFrame, goals: DataFrame, own: list[str]) -> DataFrame:
    """The values of each goal's group that are within the goal's bounds."""
    of = F.lit(True)
    for c in own:
        of = of & rows[c].eqNullSafe(goals[c])
    met = rows.join(goals, of).select(*[rows[c] for c in own], "_v", "_side", "_at", "_lo", "_hi", "_least", "_most")
    return met.filter((F.col("_v") >= F.col("_least")) & (F.col("_v") <= F.col("_most")))


def _narrower(rows: DataFrame, goals: DataFrame, own: list[str]) -> DataFrame:
    """Goals within the bin that holds their place. Where the range is too large, halves are compared."""
    scale = F.when(F.col("_hi") - F.col("_lo") == float("inf"), 2.0).otherwise(1.0)
    v, low, high = (F.col(c) / scale for c in ("_v", "_lo", "_hi"))
    share = F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * BINS), F.lit(BINS - 1))
    at = F.when(F.col("_v") == float("-inf"), -1).when(F.isnan("_v"), BINS + 1).when(F.col("_v") == float("inf"), BINS).otherwise(F.coalesce(share, F.lit(0)))
    inside = _inside(rows, goals, own).withColumn("_bin", at.cast("int"))
    finite = F.when(_finite(F.col("_v")), F.col("_v"))
    bins = inside.groupBy(*own, "_side", "_at", "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    before = Window.partitionBy(*own, "_side").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    hit = bins.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    return hit.select(*own, "_side", (F.col("_at") - F.col("_before")).alias("_at"), "_n", "_lo", "_hi", "_least", "_most")
