"""Toxicity scores by non-negative positive-unlabelled learning.

Documents are sets of hashed word and word-prefix features. Confirmed toxic documents and a
sample of unlabelled text give, by one Spark pass, the features that are more frequent in the
former; a second pass turns the samples into rows over these features. On them numpy fits a
logistic model by the class-prior-corrected risk: with prior p, positives P and unlabelled U,

    p E_P[loss(+)] + max(0, E_U[loss(-)] - p E_P[loss(-)])

where the part in brackets estimates the risk on the unseen negatives; once it turns negative
the step goes against it, so the model can't win by fitting U below what p allows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.batches import give_back, small
from quarrymill.llm.memory import Recent
from quarrymill.llm.sizes import sized
from quarrymill.session import table

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Hashed features in all, and the most that the model uses.
SPACE, MOST_FEATURES = 1 << 20, 4096
#: Bounds of the two training samples (rows). Above them rows are taken by a hash of the id.
MOST_POSITIVES, MOST_UNLABELLED = 20_000, 40_000
#: A feature is used from this many positives and this z score (positives against unlabelled).
LEAST_POSITIVES, LEAST_Z = 3, 5.0
THRESHOLD, LEAST_PRIOR = 0.3, 1e-4
#: The most that a text without a feature of the model scores: nothing speaks against it.
MOST_WITHOUT = THRESHOLD / 2
#: A prior is estimated where at least this share of the positives score; the labelled share is
#: taken as long as it is not so many times that estimate.
LEAST_ABOVE, FAR_FROM = 0.5, 2.5
#: Words whose features a task remembers, and fewer where it keeps all features of a word.
REMEMBERED, REMEMBERED_WHOLE = 100_000, 40_000
STEPS, RATE, L2, BACK = 400, 0.1, 1e-4, 1.0


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature."""

    bias: float
    weights: dict[int, float]
    prior: float


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word: itself and its prefixes."""
    cut = {word[:n] + "*" for n in PREFIXES if len(word) >= n}
    return tuple(sorted({zlib.crc32(x.encode()) % SPACE for x in (word, *cut)}))


def features(text: str, of_word) -> set[int]:
    """Distinct features of a text."""
    return set().union(*map(of_word, set(WORD.findall(text.lower()))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, among positives and unlabelled (columns: positive, body)."""
    found, of_word = np.zeros((2, SPACE), np.int64), Recent(word_features, REMEMBERED_WHOLE).__getitem__
    for batch in small(batches):
        for positive, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[int(positive), list(features(body, of_word))] += 1
    del of_word
    give_back()
    there = np.flatnonzero(found.any(axis=0))
    columns = [pa.array(x.astype(np.int64)) for x in (there, found[1, there], found[0, there])]
    yield pa.RecordBatch.from_arrays(columns, ["feature", "p", "u"])


def _rows(kept: frozenset[int]):
    """Turns (positive, body) into (positive, kept features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = Recent(lambda w: tuple(x for x in word_features(w) if x in kept), REMEMBERED).__getitem__
        for batch in small(batches):
            found = [sorted(features(body, of_word)) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "found"])
        del of_word
        give_back()

    return run


def fit(rows: pa.Table, kept: list[int], prior: float) -> Model:
    """The non-negative risk's logistic model over binary features, by full-batch Adam.

    ``rows``: (positive, found), ``found`` with the row's features out of ``kept``.
    """
    at = {f: k for k, f in enumerate(kept)}
    place = np.zeros(SPACE, np.int32)
    place[kept] = np.arange(len(kept))
    positive = rows["positive"].to_numpy().astype(bool)
    found = rows["found"].combine_chunks()
    column = place[found.flatten().to_numpy()]
    row = np.repeat(np.arange(len(positive), dtype=np.int32), found.value_lengths().to_numpy())
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, theta[column], len(positive)) + theta[-1]
        soft, up = np.logaddexp(0, z), 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        unseen = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        by_z = np.where(positive, -prior / n_p * up, up / n_u)  # of the risk on unseen negatives
        if unseen < 0:
            by_z = -BACK * by_z
        else:
            by_z = by_z - np.where(positive, prior / n_p * (1 - up), 0)
        slope = np.append(np.bincount(column, by_z[row], len(kept)), by_z.sum())
        slope[:-1] += L2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # The constant is settled by the prior: over unlabelled text the mean score is the prior.
    z = np.bincount(row, theta[column], len(positive))[~positive]
    low, high = -50.0, 50.0
    for _ in range(80 if len(z) else 0):
        middle = (low + high) / 2
        above = (1 / (1 + np.exp(-np.clip(z + middle, -50, 50)))).mean() > prior
        low, high = (low, middle) if above else (middle, high)
    bias = (low + high) / 2 if len(z) else theta[-1]
    return Model(float(bias), {f: float(theta[k]) for f, k in at.items()}, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores allow among the unlabelled rows: of those above
    a cut, positives can't be more than all. The tightest cut counts that `LEAST_ABOVE` of the
    positives reach."""
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    return float((above_u / above_p)[above_p >= LEAST_ABOVE].min())


def fitted(rows: pa.Table, kept: list[int], share: float) -> Model:
    """`fit` at the labelled ``share`` of positives, and anew at the estimated one if that share can't
    be that of all rows, since more of the toxic ones were labelled."""
    model = fit(rows, kept, share)
    positive = rows["positive"].to_numpy().astype(bool)
    if positive.all() or not positive.any():
        return model
    weight, found = np.zeros(SPACE), rows["found"].combine_chunks()
    weight[kept] = [model.weights[f] for f in kept]
    row = np.repeat(np.arange(len(positive)), found.value_lengths().to_numpy())
    z = np.bincount(row, weight[found.flatten().to_numpy()], len(positive))
    estimate = min(0.9, max(LEAST_PRIOR, class_prior(z[positive], z[~positive])))
    return model if share <= FAR_FROM * estimate else fit(rows, kept, estimate)


def train(
    texts: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", prior: float | None = None,
    most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED,
) -> Model:
    """A model from confirmed positives (``label`` 1 in ``labels``) and from ``texts`` without
    labels. ``prior`` is the share of positives among all texts; without it that among the labelled
    rows is taken, unless the scores of unlabelled text show that toxic rows were labelled more often
    (see `fitted`).

    The samples hold at most about ``most_positives`` and ``most_unlabelled`` rows, chosen by a
    hash of the id; all of them while there are no more. Null texts count as empty; rows with a
    null label are unlabelled; ids that repeat in ``labels`` count as positive when one of them is.
    Very long texts are read whole, and other columns are not read. Without positives, or without
    a feature that tells them apart, the model scores everything with a small constant.
    """
    marked = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    marked = marked.filter("_id is not null and _label is not null")
    rows = texts.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    seen = rows.select("_id").join(marked, "_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_label").alias("known"), F.count_if(F.col("_label") == 1).alias("p")
    ).first()
    share = min(0.9, max(LEAST_PRIOR, seen["p"] / max(1, seen["known"]) if prior is None else prior))
    nothing = Model(float(np.log(LEAST_PRIOR / (1 - LEAST_PRIOR))), {}, share)
    if not seen["p"]:
        return nothing
    part = lambda most, n: F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20)) + 1
    confirmed = sized(marked.filter("_label = 1").select("_id").filter(part(most_positives, seen["p"])))
    positives = rows.join(confirmed, "_id", "left_semi")
    unlabelled = rows.filter(part(most_unlabelled, seen["n"]))
    sample = positives.select(F.lit(True).alias("positive"), "body").unionByName(
        unlabelled.select(F.lit(False).alias("positive"), "body")
    )
    n_p, n_u = F.lit(float(min(seen["p"], most_positives))), F.lit(float(min(seen["n"], most_unlabelled)))
    counts = sample.mapInArrow(_counts, "feature bigint, p bigint, u bigint").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u")
    )
    both = (F.col("p") + F.col("u") + 1) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * F.greatest(1 - both, F.lit(1e-6)) * (1 / n_p + 1 / n_u))
    chosen = counts.filter(F.col("p") >= LEAST_POSITIVES).select("feature", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    # What reaches the driver is bounded by MOST_FEATURES and the samples' bounds.
    kept = [r["feature"] for r in chosen.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    if not kept:
        return nothing
    matrix = sample.mapInArrow(_rows(frozenset(kept)), "positive boolean, found array<int>")
    return fitted(matrix.toArrow(), kept, share) if prior is None else fit(matrix.toArrow(), kept, share)


def with_scores(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` and ``column``: the model's probability that the row's whole text is toxic.

    A text without features of the model, be it null or empty, scores `MOST_WITHOUT` at most; very long texts are read
    whole; rows that repeat are scored each by itself; an empty table gives an empty result. Other
    columns, ids included, pass as they are; ``column`` is to be a new name.
    """
    weights, bias, place = model.weights, model.bias, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = Recent(lambda w: tuple(x for x in word_features(w) if x in weights), REMEMBERED).__getitem__
        for batch in small(batches):
            own = [sorted(features(t or "", of_word)) for t in batch.column(place).to_pylist()]
            z = np.array([sum(map(weights.__getitem__, x)) + bias for x in own], float)
            found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            found = np.where([not x for x in own], np.minimum(found, MOST_WITHOUT), found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, column])
        del of_word
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score`` for each row; see ``with_scores``. No other columns are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("body"))
    return with_scores(rows, model, text="body").select("doc_id", "score")


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may not be learned from (a null id never is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model of the rows of ``known`` that are not held out."""
    model = train(known.filter(~held_out()), labels)
    scored = score(docs, model).withColumn("held_out", held_out())
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
