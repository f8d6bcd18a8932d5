"""Validation of raw records, samples and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import trim_ws
from quarrymill.session import MOST_BROADCAST, materialise

#: Keys that one key with many rows is split into for a join.
PARTS = 32


def required_text(c: Column) -> Column:
    """The trimmed text; null when missing or blank."""
    return F.nullif(trim_ws(c), F.lit(""))


def fold_options(options: Column) -> Column:
    """Options (array of label, text) with labels trimmed and upper-cased; of labels that become
    equal the first gives the place and the last the text. Null when empty or a part is blank."""
    clean = F.transform(options, lambda o: F.struct(F.upper(trim_ws(o["label"])).alias("label"), trim_ws(o["text"]).alias("text")))
    labels = F.array_distinct(F.transform(clean, lambda o: o["label"]))
    last = lambda label: F.element_at(F.filter(clean, lambda o: o["label"] == label), -1)["text"]
    folded = F.transform(labels, lambda label: F.struct(label.alias("label"), last(label).alias("text")))
    blank = F.exists(clean, lambda o: o["label"].isNull() | (o["label"] == "") | o["text"].isNull() | (o["text"] == ""))
    return F.when((F.size(clean) > 0) & ~blank, folded)


def answer_index(value: Column, options: Column) -> Column:
    """The index that a text value names: an option's label, else digits within the options."""
    clean = F.upper(trim_ws(value))
    by_label = F.array_position(F.transform(options, lambda o: o["label"]), clean).cast("int") - 1
    by_number = F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("int"))
    found = F.when(by_label >= 0, by_label).otherwise(by_number)
    return F.when((found >= 0) & (found < F.size(options)), found)


def answer_letter(options: Column, index: Column) -> Column:
    """The label at an index from 0; null outside the options."""
    return F.when(index >= 0, F.get(F.transform(options, lambda o: o["label"]), index))


def with_ids(df: DataFrame, raw_id: str, split: str, line: str) -> DataFrame:
    """``df`` with ``record_id``: the trimmed id, or the split and the line number."""
    made = F.format_string("%s-%06d", F.col(split), F.col(line).cast("bigint"))
    return df.withColumn("record_id", F.coalesce(required_text(F.col(raw_id)), made))


def mark_repeats(df: DataFrame, key: str, order: str | tuple[str, ...]) -> DataFrame:
    """``df`` with ``copies`` (rows of that key) and ``repeat`` (all rows of it but the first).

    ``order`` names columns that tell the rows of a key apart. Null keys are no copies of each other.
    Counts and first rows are summed up in the tasks before any shuffle, and only keys that occur more
    than once come back: to all tasks while they are few; else each under `PARTS` keys of its own, so
    that one key of many rows is met by many tasks.
    """
    order = (order,) if isinstance(order, str) else order
    place = F.struct(*order)
    groups = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_copies"), F.min(place).alias("_first"))
    several = materialise(groups.filter("_copies > 1"), "repeats")
    if several.count() <= MOST_BROADCAST:
        met = df.join(F.broadcast(several), F.col(key) == F.col("_key"), "left")
    else:
        several = several.withColumn("_own", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
        met = parted.join(several, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_own")), "left").drop("_part", "_own")
    repeat = F.col("_first").isNotNull() & (place != F.col("_first"))
    return met.withColumns({"copies": F.coalesce("_copies", F.lit(1).cast("bigint")), "repeat": repeat}).drop("_key", "_copies", "_first")


def validate(df: DataFrame) -> DataFrame:
    """Records (``raw_id, question, options, answer, split, line``) with normalised fields and
    ``reject``: the first reason against a row, or null."""
    ready = with_ids(df, "raw_id", "split", "line").withColumns({"question": required_text(F.col("question")), "options": fold_options(F.col("options"))})
    ready = ready.withColumn("answer_index", answer_index(F.col("answer"), F.col("options")))
    ready = ready.withColumn("answer_letter", answer_letter(F.col("options"), F.col("answer_index")))
    ready = mark_repeats(ready, "record_id", "line")
    reason = (
        F.when(F.col("question").isNull(), "question")
        .when(F.col("options").isNull(), "options")
        .when(F.col("answer").isNotNull() & F.col("answer_index").isNull(), "answer")
        .when(F.col("repeat"), "duplicate id")
    )
    return ready.withColumn("reject", reason)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in the order of a column."""
    return df.orderBy(order).limit(n)


def fixed_sample(df: DataFrame, n: int, key: str, order: str, seed: int = 42) -> DataFrame:
    """n rows (all when there are no more) that depend on their keys and the seed alone, by ``order``."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n).orderBy(order)


def profile(df: DataFrame, text: str, title: str | None = None, index: str | None = None) -> DataFrame:
    """One row: rows, characters, repeated texts, and titles and index range where there are such.
    Texts are told apart by their SHA-256, so that no long text is shuffled."""
    parts = [
        F.count(F.lit(1)).alias("records"),
        F.sum(F.length(text)).alias("characters"),
        (F.count(text) - F.countDistinct(F.sha2(text, 256))).alias("duplicate_texts"),
    ]
    if title:
        parts.append(F.countDistinct(title).alias("unique_titles"))
    if index:
        parts += [F.min(index).alias("min_index"), F.max(index).alias("max_index")]
    return df.agg(*parts)


def without_annotation(questions: DataFrame, annotations: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions that have no annotation."""
    return questions.join(annotations.select(key), key, "left_anti")


def with_annotation(questions: DataFrame, annotations: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with their annotations' columns, null where there are none."""
    return questions.join(annotations, key, "left")
