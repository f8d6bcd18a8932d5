"""Lexical grounding of an answer in the contexts it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import sentences, tokens

LEAST_OVERLAP = 0.15


def _terms(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def grounding(df: DataFrame, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """``df`` (``question, answer, citations array<int>, contexts array<string>``) with metrics.

    Claims are the answer's sentences; a claim is supported when at least ``least_overlap`` of its
    distinct words occur in validly cited contexts (positions from 1). Faithfulness is the share of
    supported claims, hallucination rate the rest, both 0 without claims. Relevance is the share of
    the question's words in a context: mean and maximum, 0 without contexts.
    """
    none = F.array().cast("array<string>")
    contexts = F.coalesce("contexts", none)
    cited = F.coalesce("citations", F.array().cast("array<int>"))
    valid = F.filter(cited, lambda c: (c >= 1) & (c <= F.size(contexts)))
    ready = df.withColumns(
        {
            "_claims": F.coalesce(sentences(F.col("answer")), none),
            "_evidence": F.array_distinct(F.flatten(F.transform(valid, lambda c: tokens(F.get(contexts, c - 1))))),
            "_asked": F.coalesce(_terms(F.col("question")), none),
            "n_citations": F.size(cited),
        }
    )
    shares = F.transform("_claims", lambda c: F.size(F.array_intersect(_terms(c), F.col("_evidence"))) / F.nullif(F.size(_terms(c)), F.lit(0)))
    supported = F.size(F.filter(shares, lambda s: s >= least_overlap))
    cover = F.transform(
        contexts, lambda c: F.coalesce(F.size(F.array_intersect("_asked", _terms(c))) / F.nullif(F.size("_asked"), F.lit(0)), F.lit(0.0))
    )
    ready = ready.withColumns({"n_claims": F.size("_claims"), "n_supported": supported, "_cover": cover})
    n = F.nullif(F.col("n_claims"), F.lit(0))
    total = F.aggregate("_cover", F.lit(0.0), lambda s, x: s + x)
    return ready.withColumns(
        {
            "faithfulness": F.coalesce(F.col("n_supported") / n, F.lit(0.0)),
            "n_unsupported": F.col("n_claims") - F.col("n_supported"),
            "hallucination_rate": F.coalesce((F.col("n_claims") - F.col("n_supported")) / n, F.lit(0.0)),
            "uncited": F.col("n_citations") == 0,
            "mean_relevance": F.coalesce(total / F.nullif(F.size("_cover"), F.lit(0)), F.lit(0.0)),
            "max_relevance": F.coalesce(F.array_max("_cover"), F.lit(0.0)),
        }
    ).drop("_claims", "_evidence", "_asked", "_cover")


def grounding_by_turn(turns: DataFrame, answers: DataFrame, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """As `grounding`, where the contexts of an answer are all turns before it in its conversation.

    ``turns`` has ``conv_id, turn, text``, ``answers`` has ``conv_id, turn, question, answer, citations
    array<int>`` (places among the turns before, from 1); both know a row by ``conv_id, turn``. Terms
    meet in joins on conversation and term: no turn is copied to the answers after it, and a
    conversation of many turns is met by as many tasks as it has terms. Answers in a null
    conversation have no contexts. Other columns of ``answers`` pass as they are.
    """
    none = F.array().cast("array<string>")
    key = ["conv_id", "turn"]
    places = turns.select(*key).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    terms = turns.select("conv_id", F.col("turn").alias("at"), F.explode(_terms(F.col("text"))).alias("term"))
    ready = answers.join(places, key, "left").withColumns(
        {
            "_before": F.coalesce(F.col("place") - 1, F.lit(0)),
            "_asked": F.coalesce(_terms(F.col("question")), none),
            "_claims": F.coalesce(sentences(F.col("answer")), none),
            "n_citations": F.size(F.coalesce("citations", F.array().cast("array<int>"))),
        }
    ).drop("place")
    asked = ready.select(*key, F.explode("_asked").alias("term"))
    met = asked.join(terms, ["conv_id", "term"]).filter("at < turn").groupBy(*key, "at").agg(F.count(F.lit(1)).alias("n"))
    cover = met.groupBy(*key).agg(F.sum("n").alias("_total"), F.max("n").alias("_most"))

    cited = ready.select(*key, "_before", F.explode(F.array_distinct("citations")).alias("place")).filter("place between 1 and _before")
    cited = cited.join(places.select("conv_id", F.col("turn").alias("at"), "place"), ["conv_id", "place"]).select(*key, "at")
    claims = ready.select(*key, F.posexplode("_claims").alias("claim", "text")).withColumn("terms", _terms(F.col("text")))
    wanted = claims.select(*key, "claim", F.size("terms").alias("of"), F.explode("terms").alias("term"))
    held = wanted.join(cited, key).join(terms, ["conv_id", "at", "term"]).select(*key, "claim", "of", "term").distinct()
    shares = held.groupBy(*key, "claim", "of").agg(F.count(F.lit(1)).alias("n"))
    supported = shares.filter(F.col("n") / F.col("of") >= least_overlap).groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_supported"))

    every = ready.join(cover, key, "left").join(supported, key, "left").fillna(0, ["n_supported", "_total", "_most"])
    if least_overlap <= 0:  # then claims without any common word are supported too, if they have words
        worded = F.size(F.filter("_claims", lambda c: F.size(_terms(c)) > 0))
        every = every.withColumn("n_supported", worded)
    n, words = F.nullif(F.size("_claims"), F.lit(0)), F.nullif(F.size("_asked"), F.lit(0))
    unsupported = F.size("_claims") - F.col("n_supported")
    return every.withColumns(
        {
            "n_claims": F.size("_claims"),
            "faithfulness": F.coalesce(F.col("n_supported") / n, F.lit(0.0)),
            "n_unsupported": unsupported,
            "hallucination_rate": F.coalesce(unsupported / n, F.lit(0.0)),
            "uncited": F.col("n_citations") == 0,
            "mean_relevance": F.coalesce(F.col("_total") / words / F.nullif(F.col("_before"), F.lit(0)), F.lit(0.0)),
            "max_relevance": F.coalesce(F.col("_most") / words, F.lit(0.0)),
        }
    ).drop("_claims", "_asked", "_before", "_total", "_most")
