"""JSON-lines records in and out, with line numbers, strict JSON and a reject table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import trim_ws
from quarrymill.operators.dense import normalised, vector_checks
from quarrymill.operators.validate import answer_index, answer_letter, fold_options, mark_repeats, required_text, with_ids
from quarrymill.session import sized

ANNOTATION_FIELDS = (
    "question_id", "question", "options", "expected_answer", "scope", "evidence_expected", "topic", "reason",
    "annotator", "annotation_version", "matched_terms",
)

#: Splits whose starts are sent to all tasks: some 64 TB of files at 128 MB each.
MOST_SPLITS = 500_000
#: Tables of a saved BM25 index.
INDEX_TABLES = ("postings", "blocks", "idf", "stats", "corpus")


class RecordError(ValueError):
    """A record that can't be read; the message names file and line."""


def _status(line: bytes) -> str | None:
    """Null for a JSON object, else what is wrong. Built-in parsers accept more than JSON."""
    try:
        return None if isinstance(json.loads(line.decode()), dict) else "not an object"
    except ValueError:
        return "invalid JSON"


PAIR = T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("is_text", T.BooleanType())])


@F.pandas_udf(T.ArrayType(PAIR))
def json_pairs(value: pd.Series) -> pd.Series:
    """The fields of a JSON object in file order; the last of equal keys keeps the first's place."""

    def of(text: str | None):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            return None
        if not isinstance(found, dict):
            return None
        return [{"label": k, "text": v if isinstance(v, str) else None, "is_text": isinstance(v, str)} for k, v in found.items()]

    return pd.Series([of(t) for t in value], dtype=object)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their split, with their number in it (``inside``), how many full lines
    stand before them (``before``), and what `json_status` says of full ones."""
    here, inside, before = None, 0, 0
    for batch in batches:
        files, blocks, full = (batch.column(c).to_pylist() for c in ("file", "block", "full"))
        numbers, earlier = [], []
        for file, block, is_full in zip(files, blocks, full, strict=True):
            if (file, block) != here:
                here, inside, before = (file, block), 0, 0
            inside += 1
            numbers.append(inside)
            earlier.append(before)
            before += is_full
        lines = batch.column("value").cast(pa.binary())
        status = [_status(line) if is_full else None for line, is_full in zip(lines.to_pylist(), full, strict=True)]
        columns = [*batch.columns, pa.array(numbers, pa.int64()), pa.array(earlier, pa.int64()), pa.array(status, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "inside", "before", "status"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value, status, at`` for each line that is not blank. Lines are counted from 1,
    blank ones included, per file; ``at`` counts the lines of this result from 0 over all files, by
    their names, without gaps. A byte order mark at a line's start is no part of it.

    A first pass counts the lines of each split; where the splits begin is a small table that is sent
    to the tasks, and a line's place inside its split is counted where it is read. No text is moved.
    """
    value = F.regexp_replace("value", "^\ufeff", "")
    raw = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("full", trim_ws(F.col("value")) != "")
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if("full").alias("n_full"))
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = sizes.select("file", "block", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("start"), F.coalesce(F.sum("n_full").over(of_all), F.lit(0)).alias("first"))
    starts = sized(starts, "line-starts", MOST_SPLITS)
    read = raw.mapInArrow(_numbered, "value string, file string, block bigint, full boolean, inside bigint, before bigint, status string")
    lines = read.filter("full").join(starts, ["file", "block"], "left")
    start = F.coalesce("start", F.raise_error(F.lit("files or splits changed while they were read")).cast("bigint"))
    return lines.select("file", (start + F.col("inside")).alias("line"), "value", "status", (F.col("first") + F.col("before")).alias("at"))


def split_rejects(df: DataFrame, reason: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their reason."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def require(df: DataFrame, reason: str = "reject") -> DataFrame:
    """The rows, when none is rejected; else a `RecordError` about the first one."""
    bad = df.filter(F.col(reason).isNotNull()).orderBy("file", "line").select("file", "line", reason).first()
    if bad:
        raise RecordError(f"{bad['file']}:{bad['line']}: {bad[reason]}")
    return df.drop(reason)


def _field(name: str) -> Column:
    return F.get_json_object("value", f"$.{name}")


def _kind(name: str) -> Column:
    """How a field is written: 'string', 'number', 'other' or null."""
    variant = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))
    return F.when(kind == "STRING", "string").when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), "number").when(kind != "VOID", "other")


def _stem() -> Column:
    return F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)


def load_questions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Questions of JSON lines (``id, question, options, answer_idx``), with ``reject`` per row.

    ``question_id`` defaults to split and line number, the split to the file's stem; the answer may
    be a label, digits or an index; further fields are kept as JSON in ``metadata``.
    """
    lines = read_lines(spark, path).withColumn("pairs", json_pairs(_field("options")))
    pairs = F.col("pairs")
    kind = _kind("answer_idx")
    ready = lines.select(
        "file", "line", "value", "status",
        F.when(_kind("id") == "string", _field("id")).alias("raw_id"),
        F.when(_kind("question") == "string", required_text(_field("question"))).alias("question"),
        F.when(~F.exists(pairs, lambda o: ~o["is_text"]), fold_options(pairs)).alias("options"),
        F.coalesce(F.lit(split), _field("split"), _stem()).alias("split"),
        _field("answer_idx").alias("answer"), kind.alias("kind"),
    )
    ready = mark_repeats(with_ids(ready, "raw_id", "split", "line"), "record_id", ("file", "line"))
    ready = ready.withColumn("answer_index", F.when(F.col("kind").isin("string", "number"), answer_index(F.col("answer"), F.col("options"))))
    reject = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("question").isNull(), "question must be text")
        .when(F.col("options").isNull(), "options must be an object of texts")
        .when(F.col("answer").isNotNull() & F.col("answer_index").isNull(), "answer index out of range or of a wrong kind")
        .when(F.col("repeat"), "duplicate id")
    )
    return ready.select(
        F.col("record_id").alias("question_id"), "question", "options", "answer_index",
        answer_letter(F.col("options"), F.col("answer_index")).alias("answer_letter"), "split", F.col("file").alias("source_file"),
        F.col("line").alias("source_line"), _rest("value", ("id", "question", "options", "answer_idx", "split")).alias("metadata"),
        reject.alias("reject"), "file", "line",
    )


@F.pandas_udf(T.StringType())
def _without(value: pd.Series, names: pd.Series) -> pd.Series:
    def of(text: str, drop) -> str | None:
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return json.dumps({k: v for k, v in found.items() if k not in set(drop)}, ensure_ascii=False) if isinstance(found, dict) else None

    return pd.Series([of(t, d) for t, d in zip(value, names)], dtype=object)


def _rest(value: str, names: tuple[str, ...]) -> Column:
    """The other fields of a JSON object, as JSON."""
    return _without(F.col(value), F.array(*[F.lit(n) for n in names]))


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Text chunks of JSON lines (``id, title, content`` or ``contents``), with ``reject`` per row.
    ``corpus_pos`` runs from 0 without gaps over all files, by their names."""
    ready = read_lines(spark, path).select(
        "file", "line", "at", "status", required_text(_field("id")).alias("chunk_id"), F.coalesce(trim_ws(_field("title")), F.lit("")).alias("title"),
        F.coalesce(required_text(_field("content")), required_text(_field("contents"))).alias("text"),
        _rest("value", ("id", "title", "content", "contents")).alias("metadata"),
    )
    ready = mark_repeats(ready, "chunk_id", ("file", "line"))
    reject = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("chunk_id").isNull(), "id must be text")
        .when(F.col("text").isNull(), "content must be text")
        .when(F.col("repeat"), "duplicate id")
    )
    return ready.select("chunk_id", "title", "text", F.col("file").alias("source_file"), "metadata", reject.alias("reject"), "file", "line", F.col("at").alias("corpus_pos"))


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Scope annotations of JSON lines, with ``reject``: all fields are required, ids unique."""
    lines = read_lines(spark, path).withColumn("pairs", json_pairs(_field("options")))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    texts = [_field(n).alias(n) for n in ANNOTATION_FIELDS if n not in ("options", "evidence_expected", "matched_terms")]
    ready = lines.select(
        "file", "line", "status", *texts, F.transform("pairs", lambda o: F.struct(o["label"].alias("label"), o["text"].alias("text"))).alias("options"),
        _field("evidence_expected").try_cast("boolean").alias("evidence_expected"), F.from_json(_field("matched_terms"), "array<string>").alias("matched_terms"),
        F.array_except(F.array(*[F.lit(n) for n in ANNOTATION_FIELDS]), keys).alias("missing"),
    )
    ready = mark_repeats(ready, "question_id", ("file", "line"))
    reject = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", ")))
        .when(required_text(F.col("question_id")).isNull(), "question_id must be text")
        .when(F.col("repeat"), "duplicate id")
    )
    return ready.select(*ANNOTATION_FIELDS, reject.alias("reject"), "file", "line")


def load_gold(spark: SparkSession, path: str, fields: tuple[str, str] = ("supporting_chunk_ids", "gold_chunk_ids"), required: bool = True) -> DataFrame:
    """Gold evidence as distinct rows ``question_id, chunk_id``; of several lines for a question
    the last counts. Unless ``required``, a lone string is one id and lines may lack ids."""
    raw = F.coalesce(*[F.nullif(_field(f), F.lit("[]")) for f in fields])
    listed = F.from_json(raw, "array<string>")
    if not required:
        listed = F.coalesce(listed, F.when(~raw.startswith("["), F.array(raw)))
    ready = read_lines(spark, path).select("file", "line", F.coalesce("status", F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) == 0, "gold ids must be a list")).alias("reject"), _field("question_id").alias("question_id"), listed.alias("ids"))
    ready = require(ready) if required else ready.drop("reject")
    last = Window.partitionBy("question_id").orderBy(F.desc("file"), F.desc("line"))
    return ready.withColumn("_at", F.row_number().over(last)).filter("_at = 1").select("question_id", F.explode("ids").alias("chunk_id")).distinct()


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per row, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of files. Files over 2 GB are beyond this reader."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def save_index(index, path: str, facts: dict) -> None:
    """A BM25 index and a one-row table of facts about it, as Parquet."""
    for name in INDEX_TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = index.postings.sparkSession
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def save_vectors(vectors: DataFrame, path: str, facts: dict) -> None:
    """A dense index (``pos, chunk_id, embedding``): its vectors at length one, and facts about it
    with their number and size. Vectors of several sizes, and an index without any, are errors."""
    checked = vector_checks(vectors).first()
    if not checked["n"] or checked["n_empty"] or checked["min_dim"] != checked["max_dim"]:
        raise ValueError("an index needs vectors, all of one size")
    unit = vectors.select("pos", "chunk_id", normalised(F.col("embedding")).alias("embedding"))
    unit.write.mode("overwrite").parquet(f"{path}/vectors")
    facts = {**facts, "count": checked["n"], "dimension": checked["max_dim"], "normalised": True}
    vectors.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A saved dense index and its facts."""
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])


def save_hybrid(index, vectors: DataFrame, path: str, facts: dict, constant: int = 60) -> None:
    """Both indexes of a hybrid search under one folder, with the fusion's constant among the facts."""
    save_index(index, f"{path}/bm25", {**facts, "rrf_constant": constant})
    save_vectors(vectors, f"{path}/dense", facts)


def load_hybrid(spark: SparkSession, path: str) -> tuple:
    """The BM25 index, the vectors and the facts of a saved hybrid index."""
    index, facts = load_index(spark, f"{path}/bm25")
    vectors, of_vectors = load_vectors(spark, f"{path}/dense")
    return index, vectors, {**of_vectors, **facts}


def load_index(spark: SparkSession, path: str):
    """A saved index and its facts."""
    from quarrymill.operators.bm25 import Index

    tables = [spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES]
    return Index(*tables), json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
