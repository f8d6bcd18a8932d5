"""Written reports, rows of a fixed benchmark, means of measures, gapless numbers."""

import json

from quarrymill.operators import report
from quarrymill.operators.numbering import numbered

RESULT = "system_name string, scope string, latency_ms double, error string, is_correct boolean, citations array<string>, retrieved_chunk_ids array<string>, gold array<string>"


def test_report_document(spark):
    rows = [
        ('a "b"', "x", 10.0, None, True, ["c1"], ["c1", "c2"], ["c2"]),
        ('a "b"', "x", 30.0, None, False, ["c9"], ["c1"], None),
        ('a "b"', None, None, "failed", None, [], [], None),
    ]
    found = report.report_documents(report.run_report(spark.createDataFrame(rows, RESULT))).collect()
    whole = json.loads(found[0].report)
    assert len(found) == 1 and whole["system_name"] == 'a "b"' and whole["result_rows"] == 3 and list(whole["by_scope"]) == ["unannotated", "x"]
    assert whole["protocol"]["k"] == 3 and whole["protocol"]["answer_metric"].startswith("exact")
    all_ = whole["overall"]
    assert (all_["questions"], all_["evaluated_answers"], all_["correct"], all_["failures_or_abstentions"]) == (3, 2, 1, 1)
    assert all_["accuracy_on_all_questions"] == 0.333333 and all_["accuracy_on_successful_answers"] == 0.5 and all_["accuracy_95_ci"] == [0.06149, 0.792345]
    assert all_["citation_valid_rate_on_successes"] == 0.5 and all_["citation_coverage_on_all"] == 0.666667
    assert all_["mean_latency_ms"] == all_["median_latency_ms"] == 20 and all_["mean_retrieved_chunks"] == 1
    assert all_["retrieval"] == {"labeled_queries": 1, "k": 3, "recall_at_k": 1.0, "precision_at_k": 0.5, "mrr": 0.5, "ndcg_at_k": 0.63093}
    failed = whole["by_scope"]["unannotated"]
    assert failed["retrieval"] == {"labeled_queries": 0, "k": 3} and failed["mean_latency_ms"] is None and failed["accuracy_on_successful_answers"] is None


def test_benchmark_rows(spark):
    rows = [(3, "Answer: b", None, "B"), (1, None, "OSError: option D", "D"), (2, "none", None, "A"), (4, None, None, "A")]
    read = report.benchmark_rows(spark.createDataFrame(rows, "id bigint, raw_response string, call_error string, truth_letter string"))
    got = {r.id: (r.model_response, r.predicted_letter, r.is_correct) for r in read.collect()}
    assert got[1] == ("[ERROR: Generation failed: option D]", "D", True) and got[2][1:] == ("", False) and got[3][1:] == ("B", True) and got[4][1:] == ("", False)
    lines = [r.line for r in report.breakdown(read, "id").orderBy("index").collect()]
    assert lines == ["| 1 | D | D | Passed |", "| 2 | A | None | Failed |", "| 3 | B | B | Passed |", "| 4 | A | None | Failed |"]
    assert report.benchmark_score(read).first().score == "2/4"


def test_means_and_numbers(spark):
    rows = spark.createDataFrame([(1.0, None), (0.0, 0.5)], "bleu_score double, faithfulness double")
    assert report.generation_means(rows, ("bleu_score", "faithfulness")).first() == (2, 0.5, 0.5)
    assert report.generation_means(rows.limit(0), ("bleu_score",)).first() == (0, 0.0)
    many = spark.range(1000).selectExpr("id % 7 as g", "1000 - id as x")
    got = numbered(many, ["g", "x"], "n", 1).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.g, r.x) for r in got] == sorted((r.g, r.x) for r in got)
