"""Retrieval metrics. Three protocols with different denominators are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gold_arrays(gold: DataFrame) -> DataFrame:
    """``question_id, gold``: the distinct gold ids of each question (of rows ``question_id, chunk_id``)."""
    return gold.select("question_id", F.col("chunk_id").cast("string").alias("c")).groupBy("question_id").agg(F.array_sort(F.collect_set("c")).alias("gold"))


def _hits(ids: Column, gold: Column) -> Column:
    """Positions from 0 at which a gold id stands."""
    marked = F.transform(ids, lambda x, i: F.when(F.array_contains(gold, x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _dcg(positions: Column) -> Column:
    return F.aggregate(positions, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(2.0)))


def _ideal(gold: Column, k: int) -> Column:
    n = F.least(F.size(gold), F.lit(k))
    return F.when(n > 0, _dcg(F.sequence(F.lit(0), n - 1)))


def _ready(rows: DataFrame, k: int) -> DataFrame:
    """``ids`` cut at k, ``hits`` and counts for rows with ``retrieved_chunk_ids`` and ``gold``."""
    ids = F.slice(F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")), 1, k)
    gold = F.coalesce("gold", F.array().cast("array<string>"))
    ready = rows.withColumn("_ids", ids).withColumn("_gold", gold)
    return ready.withColumn("_hits", _hits(F.col("_ids"), F.col("_gold"))).withColumn("_distinct", F.size(F.array_intersect("_ids", "_gold")))


def common(rows: DataFrame, k: int) -> DataFrame:
    """The common protocol, null without gold: recall of distinct hits, precision over what was
    returned, reciprocal rank within k, nDCG with repeated hits counted."""
    ready, labelled = _ready(rows, k), F.size("_gold") > 0
    first = F.get("_hits", F.lit(0))
    return ready.withColumns(
        {
            "recall": F.when(labelled, F.col("_distinct") / F.size("_gold")),
            "precision": F.when(labelled, F.coalesce(F.col("_distinct") / F.nullif(F.size("_ids"), F.lit(0)), F.lit(0.0))),
            "mrr": F.when(labelled, F.coalesce(1.0 / (first + 1), F.lit(0.0))),
            "ndcg": F.when(labelled, _dcg(F.col("_hits")) / _ideal(F.col("_gold"), k)),
        }
    ).drop("_ids", "_gold", "_hits", "_distinct")


def strict(rows: DataFrame, k: int) -> DataFrame:
    """The per-query protocol: precision over k, hits with repeats; recall and nDCG null without gold."""
    ready, labelled = _ready(rows, k), F.size("_gold") > 0
    first = F.get("_hits", F.lit(0))
    return ready.withColumns(
        {
            "labelled": labelled,
            "recall": F.when(labelled, F.size("_hits") / F.size("_gold")),
            "precision": F.size("_hits") / F.lit(k),
            "mrr": F.coalesce(1.0 / (first + 1), F.lit(0.0)),
            "ndcg": F.when(labelled, _dcg(F.col("_hits")) / _ideal(F.col("_gold"), k)),
        }
    ).drop("_ids", "_gold", "_hits", "_distinct")


def listed(rows: DataFrame, k: int) -> DataFrame:
    """The list protocol: precision over what was returned, recall over the gold list, F1, hit,
    average precision at k over min(gold, k); all 0 where undefined; reciprocal rank without cut."""
    ready = _ready(rows, k)
    whole = F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>"))
    first = F.get(_hits(whole, F.col("_gold")), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision = zero(F.size("_hits") / F.nullif(F.size("_ids"), F.lit(0)))
    recall = zero(F.size("_hits") / F.nullif(F.size("_gold"), F.lit(0)))
    gains = F.transform("_hits", lambda i, n: (n + 1) / (i + 1))
    total = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    ideal = F.nullif(F.least(F.size("_gold"), F.lit(k)), F.lit(0))
    ready = ready.withColumns({"precision": precision, "recall": recall, "hit": (F.size("_hits") > 0).cast("double"), "ap": zero(total / ideal), "rr": zero(1.0 / (first + 1))})
    p, r = F.col("precision"), F.col("recall")
    return ready.withColumn("f1", zero(2 * p * r / F.nullif(p + r, F.lit(0.0)))).drop("_ids", "_gold", "_hits", "_distinct")


def mean_common(measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over labelled queries, to six places, and their number."""
    return measured.groupBy(*by).agg(
        F.count("recall").alias("labeled_queries"),
        *[F.bround(F.avg(c), 6).alias(n) for c, n in (("recall", "recall_at_k"), ("precision", "precision_at_k"), ("mrr", "mrr"), ("ndcg", "ndcg_at_k"))],
    )


def mean_strict(measured: DataFrame) -> DataFrame:
    """Means over labelled queries, nulls as 0, with labelled and total counts."""
    of = lambda c: F.avg(F.when(F.col("labelled"), F.coalesce(c, F.lit(0.0))))
    return measured.agg(
        F.count_if("labelled").alias("labelled_queries"), F.count(F.lit(1)).alias("queries"), *[of(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")]
    )


def mean_listed(measured: DataFrame) -> DataFrame:
    """Means over all queries: queries without gold count 0."""
    names = (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("hit", "hit"), ("ap", "map"), ("rr", "mrr"))
    return measured.agg(*[F.avg(c).alias(n) for c, n in names])
