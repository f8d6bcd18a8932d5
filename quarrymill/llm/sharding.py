"""Sharding by k-d tree partitioning.

The points are groups of equal texts; their coordinates are metadata (size, language, source,
smallest id), scaled to [0, 1], each with the group's hash as a tie-break. A node that is to
become several shards is cut along its widest dimension at the weighted median - at the quantile
of bytes that its two sides need - until each leaf is one shard. Medians come from histograms of
bytes that Spark aggregates for all nodes of a level at once; a few rounds narrow a histogram down
to single values. Only the cuts, one per node, are on the driver: rows are moved once, at the end.

Groups too heavy to leave the leaves even are given to the least filled shards first, whole; the tree
then fills each leaf up to what its shard still lacks. Only a group that no shard can hold is cut up.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.ranks import gapless
from quarrymill.session import materialise, release, table

SHARDS = 40
#: Bytes that each row counts besides its text.
OVERHEAD = 16
DIMENSIONS = ("bytes", "lang", "source", "first_id")
#: Coordinates are integers below 2^COORD_BITS: the scaled value over TIE_BITS of hash.
COORD_BITS, TIE_BITS = 62, 31
BINS = 4096
#: Groups with more bytes than this part of a shard are placed before the tree grows (at most shards / part).
HEAVY = 1 / 10
#: Groups with more than one of so many rows are looked up by a broadcast: there can't be more of them.
MOST_HOT = 4000
ROWS_A_BUCKET, LEAST_BUCKETS = 500_000, 64


@dataclass
class Node:
    """Part of the space: ``first .. first + shards - 1``; inner nodes have a cut."""

    first: int
    shards: int
    dimension: str | None = None
    cut: int | None = None
    children: list["Node"] = field(default_factory=list)

    def place(self) -> Column:
        """A column with the number of the leaf's first shard."""
        if self.cut is None:
            return F.lit(self.first)
        left, right = self.children
        return F.when(F.col(self.dimension) < F.lit(self.cut), left.place()).otherwise(right.place())

    def leaves(self) -> list["Node"]:
        return [self] if self.cut is None else [x for c in self.children for x in c.leaves()]


def points(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, size, text_crc32, h1, h2``) and their groups, which are those of equal size and
    128 bits of hash, with their bytes as ``weight``."""
    body = F.coalesce(F.col(text), F.lit(""))
    other = lambda name: F.col(name) if name in docs.columns else F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h1"),
        F.xxhash64(F.lit(7), body).alias("h2"),
        F.crc32(F.coalesce(other("lang").cast("string"), F.lit(""))).alias("lang"),
        F.crc32(F.coalesce(other("source").cast("string"), F.lit(""))).alias("source"),
    )
    rows = materialise(rows, "rows")
    groups = rows.groupBy("h1", "h2", "size").agg(
        F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"),
        F.min("doc_id").alias("first_id"), F.min("lang").alias("lang"), F.min("source").alias("source"),
    )
    return rows, materialise(groups, "groups")


def _scaled(value: Column, low: float, high: float, tie: Column) -> Column:
    """A value within [low, high] as an integer coordinate with its tie-break."""
    width = max(high - low, 1e-12)
    top = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / width)) * float((1 << (COORD_BITS - TIE_BITS)) - 1)).cast("bigint")
    return F.shiftleft(top, TIE_BITS) + F.pmod(tie, F.lit(1 << TIE_BITS))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row: shards of near equal bytes, slots
    from 0 without gaps in each shard, in no special order.

    Equal texts share a shard, but for groups with more bytes than a shard is to have; their rows
    are cut up like other points. Very long texts are never cut. A null text has no
    bytes of its own; null ids, languages and sources count as the smallest values. Ids need a
    numeric type (others are hashed for the tree). Rows that repeat are rows of their own; an
    empty table gives an empty result, and fewer points than shards leave shards empty.
    """
    rows, groups = points(docs, text, id_col)
    numeric = rows.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte", "double", "float", "decimal")
    place = F.col("first_id").cast("double") if numeric else F.xxhash64("first_id").cast("double")
    values = {
        "bytes": F.log2(F.col("size").cast("double")),
        "lang": F.col("lang").cast("double"),
        "source": F.col("source").cast("double"),
        "first_id": F.coalesce(place, F.lit(0.0)),
    }
    ranges = groups.agg(
        F.sum("weight").alias("total"),
        F.sum("rows").alias("rows"),
        *[f(values[d]).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))],
    ).first()
    if ranges["total"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    target = ranges["total"] / shards
    large = (F.col("weight") > target) & (F.col("rows") > 1)
    tied = lambda d, tie: _scaled(values[d], ranges[f"low_{d}"], ranges[f"high_{d}"], tie).alias(d)
    keys = ["h1", "h2", "size"]
    tie = lambda d: F.xxhash64(F.lit(zlib.crc32(d.encode())), "h1", "h2")
    heavy = ~large & (F.col("weight") > HEAVY * target)
    first, loads = placed_first(groups.filter(heavy).select(*keys, "rows", "weight"), shards)
    small = groups.filter(~large & ~heavy).select(*keys, "rows", "weight", *[tied(d, tie(d)) for d in DIMENSIONS])
    # At most as many groups as shards, so they may be broadcast.
    shared = F.broadcast(groups.filter(large).select(*keys, "first_id", "lang", "source"))
    member = lambda d: F.xxhash64(F.lit(zlib.crc32(d.encode())), "doc_id")
    of_large = rows.drop("lang", "source").join(shared, keys).select(
        "doc_id", "size", "text_crc32", F.col("size").alias("weight"), *[tied(d, member(d)) for d in DIMENSIONS]
    )
    cloud = materialise(small.select("weight", *DIMENSIONS).unionByName(of_large.select("weight", *DIMENSIONS)), "points")
    tree = grow(cloud, filled(loads, ranges["total"] - sum(loads)))
    release(cloud)
    whole = small.select(*keys, "rows", tree.place().alias("shard")).unionByName(first)
    hot = F.col("rows") > ranges["rows"] / MOST_HOT
    by_broadcast = F.broadcast(whole.filter(hot).select(*keys, "shard"))
    rest = rows.join(F.broadcast(groups.filter(large | hot).select(*keys)), keys, "left_anti")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    placed = rows.join(by_broadcast, keys).select(*columns)
    placed = placed.unionByName(rest.join(whole.filter(~hot).select(*keys, "shard"), keys).select(*columns))
    placed = placed.unionByName(of_large.select(*columns[:3], tree.place().alias("shard")))
    buckets = max(LEAST_BUCKETS, -(-ranges["rows"] // (shards * ROWS_A_BUCKET)))
    return gapless(placed, ["shard"], ["doc_id"], ["doc_id", "text_crc32"], buckets, "slot")


def placed_first(heavy: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """Groups with their shards, and the bytes that each shard has then: the heaviest group first, each
    to the least filled shard. There are at most shards / `HEAVY` of them."""
    open_, loads, found = [(0, k) for k in range(shards)], [0] * shards, []
    for r in sorted(heavy.collect(), key=lambda r: (-r["weight"], r["h1"], r["h2"])):
        load, k = heapq.heappop(open_)
        loads[k] = load + r["weight"]
        heapq.heappush(open_, (loads[k], k))
        found.append((r["h1"], r["h2"], r["size"], r["rows"], k))
    return heavy.sparkSession.createDataFrame(found, "h1 bigint, h2 bigint, size bigint, rows bigint, shard int"), loads


def filled(loads: list[int], rest: int) -> list[float]:
    """What each shard still gets of ``rest``, so that the fullest one has as little as it can."""
    level, below = 0.0, 0
    for k, load in enumerate(sorted(loads)):
        if k and level <= load:
            break
        below += load
        level = (rest + below) / (k + 1)
    return [max(0.0, level - load) for load in loads]


def grow(cloud: DataFrame, room: list[float]) -> Node:
    """The tree over weighted points with coordinates ``DIMENSIONS``, level by level; its leaves get
    weight in proportion to ``room``."""
    root = Node(0, len(room))
    while open_ := [n for n in root.leaves() if n.shards > 1]:
        at = root.place()
        sides = cloud.groupBy(at.alias("node")).agg(
            F.sum("weight").alias("weight"), *[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))]
        )
        found = {r["node"]: r for r in sides.collect()}  # a row per node: at most as many as shards
        wanted: dict[int, list] = {}
        for node in open_:
            r = found.get(node.first)
            half = node.shards // 2
            if r is None:
                node.dimension, node.cut = DIMENSIONS[0], 0
            else:
                node.dimension = max(DIMENSIONS, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
                wanted[node.first] = [r[f"low_{node.dimension}"], r[f"high_{node.dimension}"] + 1, r["weight"] * _share(room, node)]
        cuts = medians(cloud, at, {n.first: n.dimension for n in open_}, wanted)
        for node in open_:
            half = node.shards // 2
            node.cut = cuts.get(node.first, node.cut)
            node.children = [Node(node.first, half), Node(node.first + half, node.shards - half)]
    return root


def _share(room: list[float], node: Node) -> float:
    """The part of the room of a node's leaves that is in its left half."""
    own = room[node.first : node.first + node.shards]
    return sum(own[: node.shards // 2]) / sum(own) if sum(own) else 0.5


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low) // BINS))


def medians(cloud: DataFrame, at: Column, along: dict[int, str], wanted: dict[int, list]) -> dict[int, int]:
    """For each node the cut that leaves about the wanted weight below it.

    ``wanted``: by node the range [low, high) that holds the cut, and the weight to have below
    it there. Each round counts ``BINS`` bins of the range and goes on in the bin that holds the
    cut, until a bin is one value wide or the cut is within a ten-thousandth of the weight.
    """
    cuts: dict[int, int] = {}
    wanted = {n: [*w, w[2] * 1e-4] for n, w in wanted.items()}
    while wanted:
        of = lambda values: F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("node"))  # noqa: E731  by node
        nodes = range(max(wanted) + 1)
        lows = [wanted[n][0] if n in wanted else None for n in nodes]
        steps = [_width(*wanted[n][:2]) if n in wanted else None for n in nodes]
        axis = [DIMENSIONS.index(along[n]) if n in wanted else None for n in nodes]
        seen = cloud.select("weight", at.alias("node"), *DIMENSIONS)
        seen = seen.select("weight", "node", of(axis).alias("axis"), of(lows).alias("low"), of(steps).alias("step"), *DIMENSIONS)
        value = F.coalesce(*[F.when(F.col("axis") == k, F.col(d)) for k, d in enumerate(DIMENSIONS)])
        seen = seen.select("weight", "node", "low", "step", value.alias("value"))
        seen = seen.filter("value >= low").withColumn("bin", F.expr("(value - low) div step"))
        seen = seen.filter(F.col("bin") < BINS)
        sums: dict[int, list] = {}
        for r in seen.groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect():  # BINS per node at most
            sums.setdefault(r["node"], []).append((r["bin"], r["w"]))
        left = {}
        for node, (a, b, need, slack) in wanted.items():
            width, below = _width(a, b), 0
            for bin_, w in sorted(sums.get(node, [])):
                start = a + bin_ * width
                if below + w >= need:
                    before, after = need - below, below + w - need
                    if min(before, after) <= slack or width == 1:
                        cuts[node] = start if before <= after else start + width
                    else:
                        left[node] = [start, min(b, start + width), before, slack]
                    break
                below += w
            else:
                cuts[node] = b
        wanted = left
    return cuts


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
