"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become whole numbers. Each task holds a block of candidates as an index: for every
dimension, its postings cut into segments of equal quantised impact. What a segment can add to a
query's score beyond the least of its dimension is known beforehand; segments are processed by
that bound, largest first, adding to the accumulators of the vectors in them. After every few
segments the k-th best accumulator is held against what each vector can reach at most: its
accumulator and, for each dimension where it was not met yet, the bound of the next segment there.
Once only a few vectors can still be members, the search stops and scores these few anew, exactly;
without that proof all segments are processed. Blocks meet tiles of queries through a shuffle, so
neither side has to fit a broadcast; the best k of all blocks are then ranked per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.session import materialise, table

SCALE, K = 1024, 10
#: Rows of a block of candidates and of a tile of queries at most; blocks are made smaller, down to
#: the least, while there are fewer than the cluster has cores.
BLOCK, LEAST_BLOCK, TILE = 65_536, 2_048, 65_536
#: Quantised impacts per dimension, segments processed between two looks for a proof, and how many
#: possible members per wanted one end the search.
LEVELS, STEP, FEW = 16, 64, 8


class Impacts:
    """The impact-ordered index of a block of whole-number vectors (rows by dimensions)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low, self.high = low.astype(float), high.astype(float)
        level = (vectors - low) // np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.rows, self.values, of, least, most = [], [], [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(level[order, d])) + 1):
                values = vectors[rows, d].astype(float)
                self.rows.append(rows)
                self.values.append(values)
                of.append(d)
                least.append(values.min())
                most.append(values.max())
        self.of, self.least, self.most = np.array(of, np.int64), np.array(least), np.array(most)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best for a query, ties to the smaller id, without its own id."""
        weight = query.astype(float)
        floor = np.minimum(weight * self.low, weight * self.high)
        # Impacts count from the dimension's least, so they are never negative.
        bound = np.maximum(weight[self.of] * self.least, weight[self.of] * self.most) - floor[self.of]
        order = np.argsort(-bound, kind="stable")
        found = np.zeros(len(self.ids))
        found[self.ids == own] = -np.inf
        unmet = np.ones((len(weight), len(found)), np.float32)
        slack = 0.5 + 1e-6 * bound.sum()  # for rounding in the float32 product and in large sums
        for at in range(0, len(order), STEP):
            if at and len(found) > k:
                left = order[at:]
                rest = np.zeros(len(weight), np.float32)
                np.maximum.at(rest, self.of[left], bound[left].astype(np.float32))
                best = np.partition(found, len(found) - k)[len(found) - k]
                members = np.flatnonzero(found + rest @ unmet >= best - slack)
                if len(members) <= FEW * k:
                    return self.rescore(members, query, own, k)
            for s in order[at : at + STEP]:
                d, rows = self.of[s], self.rows[s]
                found[rows] += weight[d] * self.values[s] - floor[d]
                unmet[d, rows] = 0
        if len(found) > k:
            best = np.partition(found, len(found) - k)[len(found) - k]
            return self.rescore(np.flatnonzero(found >= best - slack), query, own, k)
        return self.rescore(np.arange(len(found)), query, own, k)

    def rescore(self, members: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the members by exact whole-number scores."""
        members = members[self.ids[members] != own]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return members[best], scores[best]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    found = np.zeros((len(lengths), width), np.int64)
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks] or [pa.array([], pa.int64())]).to_numpy(zero_copy_only=False)
    found[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(lengths.cumsum() - lengths, lengths)] = flat
    return found


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x); null when the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products.

    Both tables have ``vec_id`` (a whole number) and ``vector`` (array<bigint>); a candidate with
    the query's id is no candidate of it. Ranks start at 1, ties go to the smaller id; fewer than
    k candidates all return. Rows with a null id or vector take no part. Shorter vectors count as
    ending in zeros. Candidates that repeat an id each count; of queries that repeat an id the
    smallest vector is searched. Scores must fit 64 bits. Empty tables give an empty result.
    """
    spark = candidates.sparkSession
    there = "vec_id is not null and vector is not null"
    candidates = materialise(candidates.filter(there).select(F.col("vec_id").cast("bigint"), "vector"), "candidates")
    queries = queries.filter(there).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("vector").alias("vector"))
    n, tiles = candidates.count(), max(1, -(-queries.count() // TILE))
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)))
    numbered = lambda df, parts: F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = candidates.withColumn("block", numbered(candidates, blocks)).withColumn("tile", every(tiles))
    right = queries.withColumn("tile", numbered(queries, tiles)).withColumn("block", every(blocks))

    def search(block: pa.Table, tile: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not block.num_rows or not tile.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        width = max(1, *(len(v) for t in (block, tile) for v in t["vector"]))
        index = Impacts(block["vec_id"].to_numpy(), _matrix(block["vector"], width))
        found = []
        for own, query in zip(tile["vec_id"].to_pylist(), _matrix(tile["vector"], width), strict=True):
            rows, scores = index.search(query, own, k)
            found.append((np.full(len(rows), own), index.ids[rows], scores))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names)

    met = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile"))
    best = met.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = f"""
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
v AS (
    SELECT vec_id, i, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM u
    WHERE vec_id NOT IN (SELECT vec_id FROM u WHERE x IS NULL OR NOT isfinite(x))
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
    GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
