"""Reports over result rows: accuracy, failures, citations, latency; overall and by scope."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.answers import exam_letter
from quarrymill.functions.text import trim_ws
from quarrymill.operators.medians import exact_medians
from quarrymill.operators.numbering import numbered
from quarrymill.operators.ranking_metrics import common

Z = 1.96
UNANNOTATED = "unannotated"


def _flags(rows: DataFrame) -> DataFrame:
    """Scope with its default, and flags of success, correctness and citations."""
    none = F.array().cast("array<string>")
    cited, found = F.coalesce("citations", none), F.coalesce("retrieved_chunk_ids", none)
    return rows.withColumns(
        {
            "scope": F.coalesce(F.nullif("scope", F.lit("")), F.lit(UNANNOTATED)),
            "_ok": F.col("error").isNull(),
            "_right": F.coalesce("is_correct", F.lit(False)),
            "_cited": F.size(cited) > 0,
            "_valid": F.col("error").isNull() & (F.size(cited) > 0) & (F.size(F.array_except(cited, found)) == 0),
            "_found": F.size(found),
        }
    )


def _ratio(a: Column, b: Column, places: int = 6) -> Column:
    return F.bround(a / F.nullif(b, F.lit(0)), places)


def wilson(correct: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, within [0, 1]."""
    p, spread = correct / n, Z * Z / n
    centre = (p + spread / 2) / (1 + spread)
    margin = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + spread)
    return F.bround(F.greatest(F.lit(0.0), centre - margin), 6), F.bround(F.least(F.lit(1.0), centre + margin), 6)


def run_report(rows: DataFrame, k: int = 3, exact_median: bool = True) -> DataFrame:
    """One row per system and scope, and one per system over all (``level`` overall).

    ``rows``: result rows with ``system_name`` and, for retrieval metrics, ``gold`` (null without
    labels). Failures count as wrong; rates are null where nothing was measured. The exact median
    takes a few passes over the latencies (see `medians`); without it the median is approximate.
    """
    if "gold" not in rows.columns:
        rows = rows.withColumn("gold", F.lit(None).cast("array<string>"))
    measured = common(_flags(rows), k)
    n, ok, right, valid = F.count(F.lit(1)), F.count_if("_ok"), F.count_if("_right"), F.count_if("_valid")
    middle = F.lit(None).cast("double") if exact_median else F.percentile_approx("latency_ms", 0.5)
    low, high = wilson(right, n)
    sums = measured.groupingSets([("system_name",), ("system_name", "scope")], "system_name", "scope").agg(
        F.grouping_id().alias("_level"),
        n.alias("questions"),
        ok.alias("evaluated_answers"),
        right.alias("correct"),
        _ratio(right, n).alias("accuracy_on_all"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        _ratio(F.count_if(F.col("_right") & F.col("_ok")), ok).alias("accuracy_on_successes"),
        (n - ok).alias("failures"),
        _ratio(n - ok, n).alias("failure_rate"),
        valid.alias("citation_valid_successes"),
        _ratio(valid, ok).alias("citation_valid_rate"),
        _ratio(F.count_if("_cited"), n).alias("citation_coverage"),
        F.bround(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
        F.bround(middle, 3).alias("median_latency_ms"),
        F.bround(F.avg("_found"), 3).alias("mean_retrieved_chunks"),
        F.count("recall").alias("labeled_queries"),
        F.bround(F.avg("recall"), 6).alias("recall_at_k"),
        F.bround(F.avg("precision"), 6).alias("precision_at_k"),
        F.bround(F.avg("mrr"), 6).alias("mrr"),
        F.bround(F.avg("ndcg"), 6).alias("ndcg_at_k"),
    )
    if exact_median:
        sums = _with_medians(sums, measured, [("system_name",), ("system_name", "scope")], F.when(F.col("_level") == 0, 1).otherwise(0))
    return sums.withColumn("level", F.when(F.col("_level") == 0, "scope").otherwise("overall")).drop("_level")


def _with_medians(sums: DataFrame, rows: DataFrame, groupings: list[tuple[str, ...]], grouping: Column) -> DataFrame:
    """``sums`` of the groupings, each row with the number ``grouping``, and their exact medians."""
    own = ["grouping", *dict.fromkeys(c for g in groupings for c in g)]
    found = exact_medians(rows, "latency_ms", groupings, "_median").select(*[F.col(c).alias(f"_{c}") for c in own], "_median")
    counted = sums.withColumn("grouping", grouping)
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = counted.join(found, same, "left").withColumn("median_latency_ms", F.bround("_median", 3))
    return joined.select(*sums.columns)


def run_summary(rows: DataFrame) -> DataFrame:
    """The short summary: no intervals, and a citation rate of 0 where nothing succeeded."""
    flagged = _flags(rows)
    n, ok, right, valid = F.count(F.lit(1)), F.count_if("_ok"), F.count_if("_right"), F.count_if("_valid")
    by_scope = F.grouping_id() == 0
    sums = flagged.groupingSets([(), ("scope",)], "scope").agg(
        by_scope.alias("by_scope"),
        n.alias("questions"),
        right.alias("correct"),
        _ratio(right, n).alias("accuracy_on_all"),
        (n - ok).alias("failures"),
        _ratio(n - ok, n).alias("failure_rate"),
        F.when(by_scope, valid).alias("citation_valid_successes"),
        F.when(by_scope, F.coalesce(_ratio(valid, ok), F.lit(0.0))).alias("citation_valid_rate"),
        F.bround(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
        F.lit(None).cast("double").alias("median_latency_ms"),
        F.when(~by_scope, F.bround(F.avg("_found"), 3)).alias("mean_retrieved_chunks"),
    )
    return _with_medians(sums, flagged, [(), ("scope",)], F.when(F.col("by_scope"), 1).otherwise(0))


def compare_systems(reports: DataFrame, order: str) -> DataFrame:
    """Reports of several systems side by side; of reports of one name (``system_name``, else the
    file's stem ``stem``) and scope the last by ``order`` counts."""
    named = reports.withColumn("system_name", F.coalesce(F.nullif("system_name", F.lit("")), F.col("stem")))
    last = Window.partitionBy("system_name").orderBy(F.desc(order))
    return named.withColumn("_at", F.rank().over(last)).filter("_at = 1").drop("_at", "stem", order)


def comparable_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy over rows with both answers, compared without case; null without such rows."""
    both = F.col("predicted_answer").isNotNull() & F.col("expected_answer").isNotNull()
    right = both & (F.upper("predicted_answer") == F.upper("expected_answer"))
    evaluated, correct = F.count_if(both), F.count_if(right)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), evaluated.alias("evaluated"), correct.alias("correct"), (correct / F.nullif(evaluated, F.lit(0))).alias("accuracy")
    )


def benchmark_score(rows: DataFrame) -> DataFrame:
    """Score of a fixed benchmark (``predicted_letter, truth_letter``): counts, percentage, text."""
    right = F.count_if((F.col("predicted_letter") != "") & (F.col("predicted_letter") == F.col("truth_letter")))
    n = F.count(F.lit(1))
    percent = F.coalesce(100.0 * right / F.nullif(n, F.lit(0)), F.lit(0.0))
    return rows.agg(n.alias("total_questions"), right.alias("correct_count"), F.bround(percent, 2).alias("accuracy_pct"), F.concat(right, F.lit("/"), n).alias("score"))


def benchmark_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of a fixed benchmark (``raw_response, call_error, truth_letter``) with
    ``model_response, predicted_letter, is_correct``: a failed call's response is a text that tells
    the error, and is read like any other."""
    failed = F.concat(F.lit("[ERROR: Generation failed: "), F.regexp_replace("call_error", r"^\w+: ", ""), F.lit("]"))
    said = F.coalesce(F.when(F.col("call_error").isNotNull(), failed), F.col("raw_response"), F.lit(""))
    read = rows.withColumn("model_response", said).withColumn("predicted_letter", exam_letter(F.col("model_response")))
    right = (F.col("predicted_letter") != "") & (F.col("predicted_letter") == F.upper(trim_ws(F.col("truth_letter"))))
    return read.withColumn("is_correct", F.coalesce(right, F.lit(False)))


def breakdown(rows: DataFrame, order: str) -> DataFrame:
    """``index, line``: a table row in Markdown for each of the `benchmark_rows`, from 1 by ``order``."""
    cells = [F.col("index").cast("string"), F.col("truth_letter"), F.coalesce(F.nullif("predicted_letter", F.lit("")), F.lit("None"))]
    result = F.when(F.col("is_correct"), "Passed").otherwise("Failed")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells, result), F.lit(" |"))
    return numbered(rows, order, "index", 1).select("index", line.alias("line"))


def benchmark_document(rows: DataFrame, order: str, name: str, model: str, seed: int, results: tuple[str, ...] = ()) -> DataFrame:
    """``index, line``: the JSON report of a fixed benchmark (rows as for `benchmark_rows`), line by
    line, so that no row holds more than one question: its head with the counts and ``summary`` at 0,
    an object of ``per_question_results`` for each row by ``order`` from 1, and its end. ``results``
    names further columns of these objects."""
    read = numbered(benchmark_rows(rows), order, "index", 1)
    facts = benchmark_score(read).first()
    head = {
        "benchmark_name": name, "model_name": model, "seed": seed, "total_questions": facts["total_questions"], "correct_count": facts["correct_count"],
        "accuracy_pct": facts["accuracy_pct"], "summary": {"Accuracy": f"{facts['accuracy_pct']:.2f}%", "Score": facts["score"]},
    }
    n, fields = facts["total_questions"], ("index", *results, "truth_letter", "predicted_letter", "is_correct", "model_response")
    item = F.to_json(F.struct(*[F.col(c).alias("ground_truth_letter" if c == "truth_letter" else c) for c in fields]), KEPT)
    lines = read.select("index", F.concat(item, F.when(F.col("index") < n, F.lit(",")).otherwise(F.lit(""))).alias("line"))
    ends = [(0, json.dumps(head, ensure_ascii=False)[:-1] + ', "per_question_results": ['), (n + 1, "]}")]
    return lines.unionByName(rows.sparkSession.createDataFrame(ends, "index bigint, line string"))


def generation_means(rows: DataFrame, measures: tuple[str, ...], *more: Column) -> DataFrame:
    """One row: the number of rows and the mean of each measure, 0 without rows, and ``more``
    aggregates. Nulls, which are judge calls that failed, don't count in a mean."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures], *more)


#: What a report says of how it measures.
PROTOCOL = {
    "answer_metric": "exact MedQA option-letter accuracy",
    "failure_policy": "failures and abstentions count incorrect in accuracy_on_all_questions",
    "citation_metric": "citation IDs must be non-empty and belong to retrieved_chunk_ids",
    "retrieval_metric_policy": "Recall, Precision, MRR, and nDCG require gold evidence sidecar",
    "grounding_metric_policy": "lexical overlap is diagnostic only; no factuality claim",
}
#: Names in written reports of the columns that `run_report` names otherwise.
WRITTEN = {
    "accuracy_on_all": "accuracy_on_all_questions",
    "accuracy_on_successes": "accuracy_on_successful_answers",
    "failures": "failures_or_abstentions",
    "citation_valid_rate": "citation_valid_rate_on_successes",
    "citation_coverage": "citation_coverage_on_all",
}
KEPT = {"ignoreNullFields": "false"}


def report_documents(reports: DataFrame, k: int = 3) -> DataFrame:
    """``system_name, report``: the rows of `run_report` as one JSON document per system, with its
    protocol, the overall figures and those of each scope, by name. A part without labelled
    queries has their number and k only as its retrieval metrics."""
    retrieval = ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")
    apart = {"system_name", "scope", "level", "ci_low", "ci_high", "labeled_queries", *retrieval}
    figures = [F.col(c).alias(WRITTEN.get(c, c)) for c in reports.columns if c not in apart]
    figures.append(F.array("ci_low", "ci_high").alias("accuracy_95_ci"))
    labelled = [F.col("labeled_queries"), F.lit(k).alias("k")]
    found = F.when(F.col("labeled_queries") > 0, F.to_json(F.struct(*labelled, *retrieval), KEPT)).otherwise(F.to_json(F.struct(*labelled)))
    part = F.concat(F.regexp_replace(F.to_json(F.struct(*figures), KEPT), r"\}$", ""), F.lit(',"retrieval":'), found, F.lit("}"))
    parts = reports.withColumn("_part", part)
    by_scope = F.array_sort(F.collect_list(F.when(F.col("level") == "scope", F.struct("scope", "_part"))))  # one per scope
    whole = parts.groupBy("system_name").agg(
        F.max(F.when(F.col("level") == "overall", F.col("_part"))).alias("_overall"),
        F.max(F.when(F.col("level") == "overall", F.col("questions"))).alias("_rows"),
        by_scope.alias("_scopes"),
    )
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  a string as JSON
    protocol = F.to_json(F.struct(*[F.lit(v).alias(n) for n, v in PROTOCOL.items()], F.lit(k).alias("k")))
    scopes = F.array_join(F.transform("_scopes", lambda s: F.concat(text(s["scope"]), F.lit(":"), s["_part"])), ",")
    pieces = ["{", '"system_name":', text(F.col("system_name")), ',"result_rows":', F.col("_rows").cast("string"), ',"protocol":', protocol]
    pieces += [',"overall":', F.col("_overall"), ',"by_scope":{', scopes, "}}"]
    return whole.select("system_name", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]).alias("report"))


def run_totals(rows: DataFrame) -> DataFrame:
    """Correct rows and failures of a run."""
    return rows.agg(F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"), F.count_if(F.col("error").isNotNull()).alias("failures"))
