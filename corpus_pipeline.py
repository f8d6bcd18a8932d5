"""A corpus pipeline: toxicity, exact dedup, near dedup, packing.

``STAGES`` are functions of (spark, docs, sf_dir); each works on what the stage before it kept, is
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import exact_dedup, ngram_join, packing, toxicity
from quarrymill.llm.sizes import sized
from quarrymill.session import materialise, short_batches, table


def new_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` lacks."""
    return name if name not in docs.columns else new_name(docs, f"{name}_")


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column, also named, that tells any two rows apart: file and place in it.

    Ids may be null or repeat, so rows are known by this key within a stage. Rows that are in no
    Parquet file yet are written first.
    """
    name = new_name(docs, "_key")

    def keyed(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")  # also where a column of the rows has this name
        return rows.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name))

    try:
        return keyed(docs), name
    except AnalysisException:
        return keyed(materialise(docs, "docs")), name


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``, and without that column."""
    return docs.join(sized(dropped.select(key)), key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows of ``docs``.

    Each row is judged by its own whole text, of any length: rows with a null or repeated id like
    all others, null and empty texts as texts without features, which stay. Where nothing can be
    learned all rows stay. Other columns pass as they are; an empty table stays empty.
    """
    short_batches(spark)
    model = toxicity.train(docs.filter(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    score = new_name(docs, "score")
    return toxicity.with_scores(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts exactly one row stays: that with the largest id, of several such any one.

    Null texts count as empty, and one of them stays; a row without an id stays only if all of its
    copies have none. Texts are compared whole, of any length. Other columns pass as they are; an
    empty table stays empty.
    """
    docs, key = identified(docs)
    rows = materialise(exact_dedup.exact_dedup(docs, carry=(key,)).select("kept", "text_sha256", key), "decided")
    tied = rows.filter("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")).filter("_n > 1")
    more = rows.filter("kept").join(tied, "text_sha256").filter(F.col(key) != F.col("_first"))
    return without(docs, rows.filter("not kept").select(key).unionByName(more.select(key)), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts exactly one row stays: that with the smallest id.

    Rows without an id come after all others, and of rows that repeat an id any one may stay. Null
    and blank texts are linked with nothing and stay. Texts are compared whole, of any length.
    Other columns pass as they are; an empty table stays empty.
    """
    short_batches(spark)
    docs, key = identified(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    found = ngram_join.ngram_join(docs.select(order.alias("doc_id"), "text"))
    return without(docs, found.filter("doc_id <> component_id").select(F.col("doc_id.key").alias(key)), key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences, of every row: a null or empty text is one piece
    (its end token), very long texts are cut, rows that repeat are packed each by itself, and an
    empty table gives no pieces. Columns besides id and text are not read."""
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram join", drop_near_copies),
    ("packing", pack),
]

#: Packing and the model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
