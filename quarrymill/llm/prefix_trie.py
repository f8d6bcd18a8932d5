"""A trie of conversation prefixes: which turns conversations share, and what sharing them saves.

A turn is named by a digest of its role and text, a conversation by the digests of its turns one
after another (its path). Equal paths are counted first; distinct ones are sorted over ranges, and
each range (shard) becomes a tree of balanced parentheses. Nodes on the first or last path of a
shard that a neighbouring shard has too (spines) are partial, and are summed by their prefix; a
shard knows how many turns it shares with its neighbours, so that each node is owned by one shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.parentheses import BalancedParentheses
from quarrymill.llm.sizes import sized
from quarrymill.session import materialise, release, table

#: Bytes of a turn's digest.
NAME = 16
#: Turns of distinct paths that a shard holds, more or less.
SHARD_TURNS = 200_000
#: Ids are handed on in groups of neighbouring ones, of at most so many (a power of two, as bits).
GROUP_BITS = 8
NODE = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as arrays of ``name`` (hex digest of
    role and text) and ``size`` (bytes of the text). One task holds a conversation's digests,
    never its texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), name.alias("name"), F.octet_length(text).cast("bigint").alias("size"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size"))).alias("turns"))


def _hashed_length() -> Column:
    return (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``turns`` (`turns_of`) where the first h turns of each conversation are those of the
    conversation ``conv_id - conv_id % 5`` (as many as it has), with h the id's CRC-32 modulo 9."""
    heads = turns.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("source"), F.slice("turns", 1, 8).alias("head"))
    joined = turns.withColumn("source", F.expr("conv_id - conv_id % 5")).join(heads, "source", "left")
    h = _hashed_length()
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id`` unique, ``turns`` of name and size).

    Per node: ``conv_id``, the smallest id of the conversations that begin with it, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` of its subtree, ``saved_tokens``
    (over its subtree, bytes of each node's last turn for all its conversations but one) and
    ``ends_sha256`` of the ids of those that end here. Conversations without turns end at the root;
    an empty table has no nodes, not even a root; null ids are not among the rows of `turns_of`.
    """
    spark = turns.sparkSession
    convs = materialise(
        turns.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"),
            F.transform("turns", lambda t: t["size"]).alias("sizes"),
        ),
        "paths",
    )
    named = convs.select("conv_id", F.md5("path").alias("name"), F.shiftright("conv_id", GROUP_BITS).alias("at"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # a group's: few
    groups = named.groupBy("name", "at").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    ends = groups.repartition("name").sortWithinPartitions("name", "at").mapInArrow(_digests, "conv_id bigint, n bigint, ends_sha256 string")
    paths = ends.join(convs, "conv_id")
    n_turns = convs.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))
    ranged = materialise(paths.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "ranges")
    edges = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")  # a row for each shard
    shared = lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(_shared(a, b))
    edges = edges.select(
        "shard", shared(F.lag("last").over(order), F.col("first")).alias("before"), shared(F.col("last"), F.lead("first").over(order)).alias("after")
    )
    nodes = materialise(ranged.join(F.broadcast(edges), "shard").groupBy("shard").applyInArrow(_tree, NODE), "nodes")  # a row for each shard
    release(convs, ranged)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.filter("key is not null").groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        *sums, F.max("ends_sha256").alias("ends_sha256"),
    )
    spine = materialise(spine, "spines")
    parents = sized(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "spine-ids")
    every = nodes.filter("key is null").unionByName(spine)
    below = every.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    done = every.filter("parent_key is null").unionByName(below)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return done.select(*columns, F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of ids, sorted, to a row for each name: smallest id, number, digest of all ids."""
    name, first, n, digest = None, None, 0, None
    for batch in batches:
        out = []
        for own, ids, more, least in zip(*(batch.column(c).to_pylist() for c in ("name", "ids", "n", "conv_id")), strict=True):
            if own != name:
                if name is not None:
                    out.append((first, n, digest.hexdigest()))
                name, first, n, digest = own, least, more, hashlib.sha256(ids.encode())
            else:
                n += more
                digest.update(b"," + ids.encode())
        yield _ends(out)
    yield _ends([(first, n, digest.hexdigest())] if name is not None else [])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "ends_sha256"])


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many turns two paths have in common from their start."""
    return pd.Series([-1 if x is None or y is None else _common(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype="int32")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0] if len(differ) else n) // NAME


def _common_turns(names: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For sorted paths, the turns that each has in common with the one before it (-1 at first)."""
    most = np.minimum(length[1:], length[:-1])
    row = np.repeat(np.arange(len(most)), most)
    at = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
    differs = (names[start[row] + at] != names[start[row + 1] + at]).any(axis=1)
    found = most.copy()
    np.minimum.at(found, row[differs], at[differs])
    return np.append(-1, found)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of ``values[low:high]``, by minima of runs of 1, 2, 4, ... values."""
    runs = [values]
    while 2 << (len(runs) - 1) <= len(values):
        half = 1 << (len(runs) - 1)
        runs.append(np.minimum(runs[-1][:-half], runs[-1][half:]))
    size = np.frexp(high - low)[1] - 1
    found = np.empty(len(low), values.dtype)
    for k, run in enumerate(runs):
        own = size == k
        found[own] = np.minimum(run[low[own]], run[high[own] - (1 << k)])
    return found


def _prefix_keys(path: bytes, depths: int) -> list[bytes]:
    """Digests of a path's first 0, 1, ... ``depths`` turns."""
    digest, keys = hashlib.sha256(), []
    for depth in range(depths + 1):
        keys.append(digest.digest())
        digest.update(path[NAME * depth : NAME * (depth + 1)])
    return keys


def _tree(rows: pa.Table) -> pa.Table:
    """The nodes of one shard's paths; spine nodes with the key of their prefix."""
    rows = rows.combine_chunks()
    paths = rows["path"].to_pylist()
    order = sorted(range(len(paths)), key=paths.__getitem__)
    rows, paths = rows.take(pa.array(order)), [paths[k] for k in order]
    before, after = rows["before"][0].as_py(), rows["after"][0].as_py()
    conv, members = rows["conv_id"].to_numpy(), rows["n"].to_numpy()
    length = np.array([len(p) // NAME for p in paths], np.int64)
    start = np.cumsum(length) - length
    names = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    turn_size = np.append(rows["sizes"].combine_chunks().flatten().to_numpy(), 0).astype(np.int64)

    kept = _common_turns(names, start, length)
    opened, closed = length - kept, np.append(length[:-1] - kept[1:], length[-1] + 1)
    tree = BalancedParentheses(np.repeat(np.tile(np.array([1, 0], np.int8), len(paths)), np.column_stack([opened, closed]).ravel()))
    begin = tree.opens()
    end = tree.find_close(begin)
    n = len(begin)
    depth = tree.excess[begin] - 1
    path = np.repeat(np.arange(len(paths)), opened)
    subtree = np.arange(n) + (end - begin + 1) // 2  # nodes from here up to there
    last_node = np.cumsum(opened) - 1  # of each path
    low, high = np.searchsorted(last_node, np.arange(n)), np.searchsorted(last_node, subtree)
    by_depth = np.sort(depth * n + np.arange(n))
    parent = by_depth[np.maximum(np.searchsorted(by_depth, (depth - 1) * n + np.arange(n)) - 1, 0)] % n
    parent[0] = -1

    owned = np.ones(n, np.int64)
    owned[: before + 1] = 0  # the first path's nodes, as far as the shard before has them
    total = np.append(0, np.cumsum(members))
    n_convs = total[high] - total[low]
    size = np.where(depth > 0, turn_size[start[path] + np.maximum(depth - 1, 0)], 0)
    saved = np.append(0, np.cumsum((n_convs - owned) * size))
    leaves = tree.leaves(begin, end)
    if after == length[-1]:  # the next shard goes on from the last path: no leaf
        leaves -= (subtree == n) & (high == len(paths))
    children = np.bincount(parent[1:], owned[1:], n).astype(np.int64)

    key: list[bytes | None] = [None] * n
    for depth_, k in enumerate(_prefix_keys(paths[0], before) if before >= 0 else []):
        key[depth_] = k
    for depth_, k in enumerate(_prefix_keys(paths[-1], after) if after >= 0 else []):
        key[int(by_depth[np.searchsorted(by_depth, (depth_ + 1) * n) - 1] % n)] = k
    parent_key = [key[p] if p >= 0 else None for p in parent.tolist()]
    least = _least_between(conv, low, high)
    parent_conv = [None if p < 0 or key[p] is not None else c for p, c in zip(parent.tolist(), least[parent].tolist(), strict=True)]
    ends: list[str | None] = [None] * n
    for node, digest in zip(last_node.tolist(), rows["ends_sha256"].to_pylist(), strict=True):
        ends[node] = digest
    columns = {
        "key": pa.array(key, pa.binary()), "parent_key": pa.array(parent_key, pa.binary()), "conv_id": pa.array(least), "depth": pa.array(depth),
        "parent_conv_id": pa.array(parent_conv, pa.int64()), "n_convs": pa.array(n_convs), "n_children": pa.array(children), "n_leaves": pa.array(leaves.astype(np.int64)),
        "saved_tokens": pa.array(saved[subtree] - saved[np.arange(n)]), "ends_sha256": pa.array(ends, pa.string()),
    }
    return pa.table(columns)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)),
named AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS name,
           octet_length(encode(coalesce(text, '')))::BIGINT AS size
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({'name': md5(name), 'size': size} ORDER BY turn NULLS FIRST, role, md5(name)) AS turns,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 9 AS h
    FROM named CROSS JOIN crc GROUP BY conv_id, t),
convs AS (
    SELECT o.conv_id, coalesce(s.turns, [])[1:o.h] || o.turns[o.h + 1:] AS turns
    FROM own o LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 5),
members AS (SELECT conv_id, len(turns) AS full_depth, turns, unnest(range(0, len(turns) + 1)) AS depth FROM convs),
nodes AS (
    SELECT depth, turns[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE full_depth = depth), '')) AS ends_sha256
    FROM members GROUP BY 1, 2),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (
    SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * p[depth].size ELSE 0 END AS saved
    FROM nodes LEFT JOIN kids USING (p)),
above AS (SELECT unnest(range(0, depth + 1)) AS k, p, saved, n_children FROM full_nodes),
sums AS (SELECT p[1:k] AS p, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM full_nodes x JOIN sums ON sums.p = x.p LEFT JOIN nodes y ON x.depth > 0 AND y.depth = x.depth - 1 AND y.p = x.p[1:x.depth - 1]"""
