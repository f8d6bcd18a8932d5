"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node with an edge (columns ``a, b``); ``root`` is the smallest node
    of the component. Loops and repeated edges are fine; no edges give no rows.

    In turn each node hands its larger neighbours to its smallest one, and its smaller ones
    (itself included) to their smallest, which takes a logarithmic number of rounds. A round is
    written before the next begins.
    """
    links = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(links)) != before and now[0]:
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = handed.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        links = materialise(small, "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Number and checksum of the links, to see whether a round changed them."""
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]
