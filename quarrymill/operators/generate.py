"""Model calls over partitions, and the result rows made of them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.answers import judged, parse_answer, parse_citations

#: What a row is told when its answer can't be used.
NO_LABEL = "model response did not contain one valid option label"
NO_CITATIONS = "model response did not contain valid citations"
#: Exceptions of a judge's call that count as a failed score.
CAUGHT = (OSError, RuntimeError, ValueError)
#: Rows whose prompts a judge holds as Python strings at a time.
JUDGED = 16


def as_callable(model) -> Callable[[str], str]:
    """A model's ``generate`` method, or the model itself when it is callable."""
    if hasattr(model, "generate"):
        return model.generate
    if callable(model):
        return model
    raise TypeError("a model is a callable or has a generate method")


def generate(requests: DataFrame, make: Callable, prompt: str = "prompt", catch: tuple = (OSError, RuntimeError, ValueError)) -> DataFrame:
    """``requests`` with ``raw_response, call_error, latency_ms``.

    ``make`` is called once per partition and gives the model. Exceptions of the kinds in ``catch``
    end in ``call_error``; others fail the task. Write the result before evaluating it, and use
    `answered` where a task that is run again must not call the model again.
    """
    new = [T.StructField("raw_response", T.StringType()), T.StructField("call_error", T.StringType()), T.StructField("latency_ms", T.DoubleType())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = as_callable(make())
        for frame in frames:
            said, errors, took = zip(*[_call(call, text, catch) for text in frame[prompt]], strict=True) if len(frame) else ((), (), ())
            yield frame.assign(raw_response=pd.Series(said, frame.index, object), call_error=pd.Series(errors, frame.index, object), latency_ms=pd.Series(took, frame.index, float))

    return requests.mapInPandas(run, T.StructType([*requests.schema, *new]))


#: Columns of a table of responses.
RESPONSE = "digest string, raw_response string, call_error string, latency_ms double"


def responses(spark: SparkSession, store: str) -> DataFrame:
    """The written responses of a store, a row for each prompt's SHA-256; none where there is no store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/table")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RESPONSE)
    return spark.read.schema(RESPONSE).parquet(f"{store}/table").dropDuplicates(["digest"])


def answered(requests: DataFrame, make: Callable, store: str, prompt: str = "prompt", catch: tuple = (OSError, RuntimeError, ValueError)) -> DataFrame:
    """As `generate`, by a table of responses in the folder ``store`` that outlives the run.

    Equal prompts are called once, and prompts that the table has are not called at all, also those
    whose call ended in an error. Each response is written on its own as soon as it is there, so a
    task or a run after a failed one calls only prompts without one; at the end they join the table.
    A row without a prompt is not called; its ``call_error`` says so. ``store`` has to be a folder that
    Arrow's file systems reach from the tasks, and of one run at a time.
    """
    spark, journal = requests.sparkSession, f"{store}/journal"
    asked = requests.withColumn("_digest", F.sha2(F.col(prompt), 256))
    wanted = asked.filter("_digest is not null").select(F.col("_digest").alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"])
    missing = wanted.join(responses(spark, store).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(journal)
        files.create_dir(folder)
        call = None
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                name = f"{folder}/{digest}.json"
                if files.get_file_info(name).type != pa.fs.FileType.NotFound:
                    continue  # an attempt before this one has it
                call = call or as_callable(make())
                response, error, took = _call(call, text, catch)
                row = {"digest": digest, "raw_response": response, "call_error": error, "latency_ms": took}
                with files.open_output_stream(f"{name}.part") as out:
                    out.write(json.dumps(row).encode())
                files.move(f"{name}.part", name)
            yield batch.slice(0, 0).select(["digest"])

    missing.mapInArrow(run, "digest string").write.format("noop").mode("overwrite").save()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(journal)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(where):
        spark.read.schema(RESPONSE).option("pathGlobFilter", "*.json").json(journal).write.mode("append").parquet(f"{store}/table")
        system.delete(where, True)
    found = responses(spark, store).withColumnRenamed("digest", "_digest")
    joined = asked.join(found, "_digest", "left").drop("_digest")
    return joined.withColumn("call_error", F.when(F.col(prompt).isNull(), F.lit("no prompt")).otherwise(F.col("call_error")))


def _call(call: Callable[[str], str], text: str, catch: tuple) -> tuple[str | None, str | None, float]:
    """A model's response, or what an exception of the kinds in ``catch`` says, and the milliseconds."""
    began, response, error = time.perf_counter(), None, None
    try:
        response = call(text)
        response = response if isinstance(response, str) else str(response)
    except catch as e:
        error = f"{type(e).__name__}: {e}"
    return response, error, round((time.perf_counter() - began) * 1000, 3)


def outcome(rows: DataFrame, cited: bool = True) -> DataFrame:
    """Result columns of generated rows (``raw_response, call_error, labels, expected_answer`` and,
    for ``cited`` runs, ``retrieved_chunk_ids``): ``predicted_answer, citations, error,
    is_correct, abstention_reason``.

    A row with an answer but without valid citations keeps the answer and is not judged.
    """
    answer = F.when(F.col("call_error").isNull(), parse_answer("raw_response", "labels"))
    rows = rows.withColumn("predicted_answer", answer)
    found = parse_citations("raw_response", "retrieved_chunk_ids") if cited else F.array().cast("array<string>")
    rows = rows.withColumn("_cited", F.when(F.col("call_error").isNull(), found))
    error = F.coalesce(
        "call_error", F.when(F.col("predicted_answer").isNull(), F.lit(NO_LABEL)).when(F.col("_cited").isNull(), F.lit(NO_CITATIONS))
    )
    rows = rows.withColumn("error", error)
    fine = F.col("error").isNull() & F.col("predicted_answer").isNotNull() & F.col("expected_answer").isNotNull()
    return rows.withColumns(
        {
            "citations": F.when(F.col("error").isNull(), F.col("_cited")).otherwise(F.array().cast("array<string>")),
            "is_correct": F.when(fine, F.col("predicted_answer") == F.col("expected_answer")),
            "abstention_reason": F.col("error"),
        }
    ).drop("_cited", "call_error")


def judge(rows: DataFrame, prompts: dict, make: Callable) -> DataFrame:
    """``rows`` with a judge's scores within [0, 1], one per prompt (name: column), and what a failed
    call said as ``<name>_error``; its score is null, so that no failure counts as a score.

    All prompts are asked in one pass, a few rows at a time: contexts may be long, and a pass for
    each prompt holds a batch of them in a Python worker of its own.
    """
    said = T.StructType([T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    schema = T.StructType([*rows.schema, T.StructField("_said", T.ArrayType(said))])
    kind = pa.list_(pa.struct([("response", pa.string()), ("error", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = as_callable(make())
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), JUDGED):
                part = batch.slice(start, JUDGED)
                said = [[dict(zip(("response", "error"), _call(call, text, CAUGHT)[:2])) for text in texts] for texts in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(said, kind)], [*part.schema.names[:-1], "_said"])

    asked = rows.withColumn("_prompts", F.array(*prompts.values())).mapInArrow(run, schema)
    found = {}
    for i, name in enumerate(prompts):
        response = F.col("_said")[i]["response"]
        found[name] = F.when(response.isNotNull(), judged(response, five=name == "context_relevance"))
        found[f"{name}_error"] = F.col("_said")[i]["error"]
    return asked.withColumns(found).drop("_said")
