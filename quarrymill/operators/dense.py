"""Exact cosine retrieval and reciprocal-rank fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.session import materialise, sized

#: Rows of a block of vectors and of a tile of queries at most.
BLOCK, TILE = 16_384, 4_096
#: Questions whose cosines with a block are held at a time.
STRIP = 64
PLACES = 9
#: Clusters of an index at most, and what bounds and cosines may differ by in their last places.
MOST_CLUSTERS, SLACK = 1024, 1e-7
#: Vectors that are drawn beyond twice as many as centres are picked from them.
SPARE = 64


def normalised(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)


def vector_checks(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: vectors, the range of their sizes, and how many are null, empty or not finite."""
    size = F.size(vector)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col(vector).isNotNull(), size)).alias("min_dim"),
        F.max(F.when(F.col(vector).isNotNull(), size)).alias("max_dim"),
        F.count_if(F.col(vector).isNull() | (size == 0)).alias("n_empty"),
        F.count_if(F.coalesce(odd, F.lit(False))).alias("n_odd"),
    )


def _first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones in their order; only scores that reach the k-th are sorted."""
    if k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        reach = np.flatnonzero(scores >= least)
    else:
        reach = np.arange(len(scores))
    return reach[np.argsort(-scores[reach], kind="stable")[:k]]


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 3, but_own: bool = False) -> DataFrame:
    """``question_id, chunk_id, pos, rank, score``: the k chunks (``pos, chunk_id, embedding``) of
    largest cosine for each question (``question_id, embedding``), ties by position. ``but_own``:
    questions are chunks too, and those whose ``pos`` is the ``question_id`` are left out for it.

    Both sides are normalised, then blocks of chunks meet tiles of questions through a shuffle; a
    block keeps its best k of each question by a matrix product, ties at the cut by position. A tile
    is taken in strips of ``STRIP`` questions. An empty corpus, and vectors of questions of another
    size than the corpus's, are errors.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    unit = normalised(F.col("embedding")).alias("v")
    left, right = chunks.select("pos", "chunk_id", unit), questions.select("question_id", unit)
    blocks, tiles = (max(1, -(-df.count() // most)) for df, most in ((left, BLOCK), (right, TILE)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if chunks.isEmpty():
        raise ValueError("a corpus needs at least one chunk")
    left = left.withColumn("block", part("pos", blocks)).withColumn("tile", every(tiles))
    right = right.withColumn("tile", part("question_id", tiles)).withColumn("block", every(blocks))
    return _ranked(_products(left, right, k, but_own), k)


def _products(left: DataFrame, right: DataFrame, k: int, but_own: bool) -> DataFrame:
    """The best k of each block of ``left`` (``block, tile, pos, chunk_id, v``) for each question of
    ``right`` (``block, tile, question_id, v``) with its block and tile."""
    kinds = {f.name: f.dataType.simpleString() for f in [*right.schema, *left.schema]}

    def local(block: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        names = ["question_id", "chunk_id", "pos", "score"]
        if block.empty or tile.empty:
            return pd.DataFrame(columns=names)
        block = block.sort_values("pos")
        vectors, places, ids = np.stack(block["v"].to_numpy()), block["pos"].to_numpy(), block["chunk_id"].to_numpy()
        strips = []
        for start in range(0, len(tile), STRIP):
            asked = tile["question_id"].to_numpy()[start : start + STRIP]
            wanted = np.stack(tile["v"].iloc[start : start + STRIP].to_numpy())
            if wanted.shape[1] != vectors.shape[1]:
                raise ValueError("query embedding dimension does not match the index")
            cosines = (wanted @ vectors.T).round(PLACES)
            if but_own:
                cosines[asked[:, None] == places[None, :]] = -np.inf
            best = [_first_best(row, k) for row in cosines]
            at, row = np.concatenate(best), np.repeat(np.arange(len(best)), [len(b) for b in best])
            strips.append(pd.DataFrame({"question_id": asked[row], "chunk_id": ids[at], "pos": places[at], "score": cosines[row, at]}))
        found = pd.concat(strips, ignore_index=True)
        return found[found["score"] != -np.inf]

    met = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile"))
    return met.applyInPandas(local, f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, pos bigint, score double")


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "pos")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("question_id", "chunk_id", "pos", "rank", "score")


@dataclass(frozen=True)
class Clusters:
    """``vectors`` (``pos, chunk_id, v, cluster``; unit length), and for each cluster its centre, the
    largest angle of a member to it, and its size. There are `MOST_CLUSTERS` of them at most."""

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def cluster(chunks: DataFrame) -> Clusters:
    """Vectors (``pos, chunk_id, embedding``) by the nearest of about as many centres as the root of
    their number; centres are vectors of the corpus, picked by a hash. An empty corpus and vectors
    of several sizes are errors. Zero vectors stand at a right angle to all centres."""
    spark, n = chunks.sparkSession, chunks.count()
    if not n:
        raise ValueError("a corpus needs at least one chunk")
    unit = chunks.select(F.col("pos").cast("bigint").alias("pos"), "chunk_id", normalised(F.col("embedding")).alias("v"))
    wanted = min(MOST_CLUSTERS, math.isqrt(n - 1) + 1)
    # The smallest hashes, of which a task hands on those alone that can be among them, not as many as are wanted.
    highest = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * wanted + SPARE) // n)
    drawn = materialise(unit.filter(F.xxhash64("pos") <= F.lit(highest)), "drawn")
    drawn = drawn if drawn.count() >= wanted else unit
    picked = drawn.orderBy(F.xxhash64("pos"), "pos").limit(wanted).select("v").collect()
    if len({len(r["v"]) for r in picked}) > 1:
        raise ValueError("vectors of an index are of one size")
    centres = np.array([r["v"] for r in picked], float)
    sent = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = part.column("v")
                if len(set(lists.value_lengths().to_pylist()) - {sent.value.shape[1]}):
                    raise ValueError("vectors of an index are of one size")
                v = lists.flatten().to_numpy().reshape(len(part), -1)
                cosine = v @ sent.value.T
                own = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(v)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*part.schema.names, "cluster", "angle"])

    schema = T.StructType([*unit.schema, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    vectors = materialise(unit.mapInArrow(nearest, schema), "clusters")
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in vectors.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each
        radius[r["cluster"]], size[r["cluster"]] = r["radius"], r["n"]
    return Clusters(vectors.drop("angle"), centres, radius, size)


def retrieve_pruned(clusters: Clusters, questions: DataFrame, k: int = 3, but_own: bool = False) -> tuple[DataFrame, DataFrame]:
    """As `retrieve`, over clustered vectors, and ``question_id, vectors, vectors_read``: the
    vectors there are, and those whose cosine was computed.

    By the triangle inequality of angles no member of a cluster is closer to a question than the
    question's angle to the centre less the cluster's radius. The closest clusters that hold enough
    vectors are taken first; their k-th best cosine proves away the clusters that can't reach it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    wanted = k + but_own
    asked = materialise(questions.select("question_id", normalised(F.col("embedding")).alias("v")), "questions")
    sent = asked.sparkSession.sparkContext.broadcast((clusters.centres, clusters.radius, clusters.size))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, size = sent.value
        full = np.flatnonzero(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column("v")
                if len(set(lists.value_lengths().to_pylist()) - {centres.shape[1]}):
                    raise ValueError("query embedding dimension does not match the index")
                cosine = lists.flatten().to_numpy().reshape(len(part), -1) @ centres[full].T
                apart = np.arccos(np.clip(cosine, -1, 1)) - radius[full]
                best = np.cos(np.maximum(apart, 0))
                order = np.argsort(-best, axis=1, kind="stable")
                held = np.cumsum(size[full][order], axis=1)
                first = np.empty(best.shape, bool)
                np.put_along_axis(first, order, held - size[full][order] < wanted, axis=1)
                row = np.repeat(np.arange(len(part)), len(full))
                columns = [part.column("question_id").take(pa.array(row)), pa.array(np.tile(full, len(part)).astype(np.int32)), pa.array(best.ravel()), pa.array(first.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["question_id", "cluster", "bound", "first"])

    kind = asked.schema["question_id"].dataType.simpleString()
    pairs = materialise(asked.mapInArrow(bounds, f"question_id {kind}, cluster int, bound double, first boolean"), "bounds")
    slots = F.element_at(F.array(*[F.lit(int(max(1, -(-n // BLOCK)))) for n in clusters.size]), F.col("cluster") + 1)
    tiles = max(1, -(-asked.count() // TILE))
    number = lambda slot: F.col("cluster").cast("bigint") * (1 << 32) + slot
    left = clusters.vectors.withColumn("block", number(F.pmod(F.xxhash64("pos"), slots))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def visited(some: DataFrame) -> DataFrame:
        dealt = some.withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
        dealt = dealt.select("question_id", number(F.col("slot")).alias("block"), F.pmod(F.xxhash64("question_id"), F.lit(tiles)).cast("int").alias("tile"))
        blocks = sized(dealt.select("block").distinct(), "blocks")
        right = dealt.join(asked.hint("merge"), "question_id")  # pairs and vectors are small as files, not as rows: neither is broadcast
        return materialise(_products(left.join(blocks, "block", "left_semi").select("pos", "chunk_id", "v", "block", "tile"), right, k, but_own), "best")

    seen = visited(pairs.filter("first"))
    kth = sized(_ranked(seen, k).filter(F.col("rank") == k).select("question_id", F.col("score").alias("threshold")), "thresholds")
    rest = pairs.filter("not first").join(kth, "question_id", "left").filter(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK))
    rest = materialise(rest.select("question_id", "cluster"), "rest")
    size = F.element_at(F.array(*[F.lit(int(n)) for n in clusters.size]), F.col("cluster") + 1)
    read = pairs.filter("first").select("question_id", "cluster").unionByName(rest)
    reads = read.groupBy("question_id").agg(F.sum(size).alias("vectors_read")).select("question_id", F.lit(int(clusters.size.sum())).alias("vectors"), "vectors_read")
    return _ranked(seen.unionByName(visited(rest)), k), reads


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = 60, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (``*by, chunk_id, rank``), each cut at k: the score is
    the sum of 1 / (constant + rank), ties by ``chunk_id`` as a string."""
    if k <= 0 or constant <= 0:
        raise ValueError("k and the constant must be positive")
    keys = [*by, "chunk_id"]
    a = first.filter(F.col("rank") <= k).select(*keys, F.col("rank").alias("rank_a"))
    b = second.filter(F.col("rank") <= k).select(*keys, F.col("rank").alias("rank_b"))
    of = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = a.join(b, keys, "full").withColumn("score", F.round(of("rank_a") + of("rank_b"), 12))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("chunk_id").cast("string"))
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*keys, "rank", "score")


def pack_results(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """``question_id, retrieved_chunk_ids, retrieved`` in rank order; titles and texts
    (``chunk_id, title, text``) are joined to the final rows only."""
    row = F.struct("rank", "chunk_id", "title", "text", "score")
    wide = texts.join(sized(ranked, "ranked"), "chunk_id").groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("retrieved"))  # k rows each
    return wide.select("question_id", F.transform("retrieved", lambda r: r["chunk_id"]).alias("retrieved_chunk_ids"), "retrieved")


def embed(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """``df`` with ``embedding``: ``make`` is called once per partition and gives a function from a
    list of texts to vectors. Blank texts, missing vectors and uneven sizes are errors."""
    schema = T.StructType([*df.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, width = make(), None
        for frame in frames:
            found: list[list[float]] = []
            for start in range(0, len(frame), batch):
                texts = frame[text].iloc[start : start + batch].tolist()
                if any(t is None or not str(t).strip() for t in texts):
                    raise ValueError("texts to embed must not be blank")
                vectors = model(texts)
                if len(vectors) != len(texts):
                    raise ValueError("the model returned another number of vectors")
                for v in vectors:
                    width = width or len(v)
                    if not len(v) or len(v) != width:
                        raise ValueError("vectors must be of one size")
                found += [list(map(float, v)) for v in vectors]
            yield frame.assign(embedding=found)

    return df.mapInPandas(run, schema)
