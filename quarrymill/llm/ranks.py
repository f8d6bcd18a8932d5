"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, groups: list[str], spread: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with a number from 0 without gaps in each group.

    A group is cut into ``buckets`` by a hash of ``spread``; rows are numbered inside a bucket
    and bucket sizes, summed up, give where each bucket starts. No task has to hold a group.
    """
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    keys = [*groups, "_bucket"]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, keys).withColumn(name, F.col("_from") + F.col("_at")).drop("_bucket", "_from", "_at")
