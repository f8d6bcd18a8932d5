"""Exact dedup by skew-safe combining, in DataFrame functions only.

Copies are combined three times, always on the digest *and* the whole text: inside each map
task (Spark's partial aggregate), per (digest, salt), and over the salts of a digest. The salt
is a function of the id, so a group of any size is spread over ``SALTS`` keys and no task gets
more than one row per salt of it. The decision then goes back to the rows over (digest, salt),
so the lookup is as even as the combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.session import materialise, table

#: As many as a long has bits: the salts a group occupies are kept as a bit mask.
SALTS = 64


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    digest: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``, and the
    columns that ``carry`` names.

    Two texts are equal when they are identical; of equal texts the row with the largest id
    stays. ``digest`` replaces SHA-256 as the grouping digest: a weaker one costs time only,
    since texts that share a digest are told apart by their content.

    Edge cases: a null text counts as empty, and empty texts are one group. A row whose id is
    null never wins against a row with an id; a group of null ids alone has a null ``keep_id``
    and keeps all its rows. Rows that repeat an id count one by one in ``group_size`` and share
    ``kept``. Very long texts are compared whole. An empty table gives an empty result. Other
    columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sha = F.unhex(F.sha2(body, 256))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        body.alias("body"),
        sha.alias("sha"),
        (sha if digest is None else digest).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
        F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"),
    )
    salted = rows.groupBy("digest", "salt", "body").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    # At most SALTS rows per text meet here; one exchange serves both aggregates below.
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(
            F.max("top").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.expr("bit_or(shiftleft(1L, salt))").alias("mask"),
        )
    )
    groups = materialise(
        winners.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.bit_or("mask").alias("mask"),
            F.count(F.lit(1)).alias("texts"),
        ),
        "groups",
    )
    alone = _per_salt(groups.filter("texts = 1")).select("digest", "salt", "keep_id", "group_size")
    found = rows.drop("body").join(alone, ["digest", "salt"])
    shared = groups.filter("texts > 1").select("digest")
    if not shared.isEmpty():  # several texts under one digest: their rows are matched by content
        texts = _per_salt(winners.join(shared, "digest", "left_semi"))
        texts = texts.select("digest", "salt", "body", "keep_id", "group_size")
        found = found.unionByName(rows.join(texts, ["digest", "salt", "body"]).drop("body"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(f"carry.{name}" for name in carry),
    )


def _per_salt(groups: DataFrame) -> DataFrame:
    """A row for each salt in the group's mask."""
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("mask", s) == 1)
    return groups.withColumn("salt", F.explode(salts))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
