"""Gapless numbers over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import materialise


def numbered(df: DataFrame, order: str | list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with ``name``: ``first``, ``first + 1``, ... in the order of columns.

    Rows are sorted over ranges of ``order`` and written; a running sum of the ranges' sizes, a
    table of one row per range, gives where each begins. Among equal rows any comes first.
    """
    order = [order] if isinstance(order, str) else order
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", within)
    ranges = materialise(ranges.select("*", F.shiftright("_id", 33).alias("_range"), (F.col("_id") % (1 << 33)).alias("_at")).drop("_id"), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, F.col("_from") + F.col("_at") + first).drop("_range", "_from", "_at")
