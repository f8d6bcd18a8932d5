import pytest
from pyspark.sql import functions as F

from quarrymill.functions import answers, grounding, overlap, prompts, scope, text
from quarrymill.operators import generate, report, validate
from quarrymill.plans import adapters


@pytest.mark.parametrize(
    "said, want",
    [
        ("A", "A"),
        ('{"answer": "b"}', "B"),
        ('Well: {"answer": "A"} or {"answer": "B"}', "B"),
        ("```json\n{\"choice\": \"C\"}\n```", "C"),
        ("Answer: b", "B"),
        ("The correct answer is\nC.", "C"),
        ("I can't say", None),
        ("E", None),
        ("", None),
        (None, None),
        ("{'answer': 'A'}", None),
    ],
)
def test_strict_answers(said, want):
    assert answers.answer_of(said, ["A", "B", "C"]) == want


def test_exchanges_have_all_turns_before(spark, tmp_path):
    turns = [("c", t, "assistant" if t % 2 else "user", f"text{t}") for t in range(12)] + [("d", 0, "assistant", "alone")]
    spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r for r in adapters.exchanges(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 5, 7, 9, 11}
    assert all(r.contexts == [f"text{t}" for t in range(n)] and r.question == f"text{n - 1}" for n, r in got.items())


def test_citations():
    assert answers.citations_of('{"citations": ["c1", "c1", "c2"]}', ["c1", "c2"]) == ["c1", "c2"]
    assert answers.citations_of('{"citations": []}', ["c1"]) == []
    assert answers.citations_of('{"citations": ["x"]}', ["c1"]) is None
    assert answers.citations_of('{"answer": "A"}', ["c1"]) is None


def test_outcome(spark):
    rows = [("r1", '{"answer": "A", "citations": ["c1"]}', None), ("r2", '{"answer": "A"}', None), ("r3", "?", None), ("r4", None, "OSError: x")]
    df = spark.createDataFrame(rows, "id string, raw_response string, call_error string").withColumns(
        {"labels": F.array(F.lit("A"), F.lit("B")), "expected_answer": F.lit("A"), "retrieved_chunk_ids": F.array(F.lit("c1"))}
    )
    got = {r.id: r for r in generate.outcome(df).collect()}
    assert got["r1"].is_correct and got["r1"].citations == ["c1"] and got["r1"].error is None
    assert got["r2"].predicted_answer == "A" and got["r2"].is_correct is None and got["r2"].error == generate.NO_CITATIONS
    assert got["r3"].error == generate.NO_LABEL and got["r4"].error == "OSError: x"


def test_lenient_letters_and_scores(spark):
    rows = [("the answer is c",), ("**B**",), ("none",), ("score -3 of 5",), ("it is -0.5",)]
    df = spark.createDataFrame(rows, "t string").select(
        answers.exam_letter(F.col("t")).alias("a"), answers.run_letter(F.col("t")).alias("b"), answers.first_number(F.col("t")).alias("n")
    )
    got = df.collect()
    assert [r.a for r in got][:3] == ["C", "B", ""] and got[0].b == "C" and got[1].b == "B"
    assert [r.n for r in got][3:] == [3.0, -0.5]


def test_overlap_values():
    assert overlap.bleu("a b c", "a b c") == pytest.approx(0.1**0.25)
    assert overlap.bleu("x", "a") == 0 and overlap.bleu("", "") == 0
    assert overlap.rouge_l("the cats running", "cat runs the") == pytest.approx(2 * 2 / 6)
    assert overlap.rouge_l("a b c d", "a c d e", stemmed=False) == pytest.approx(0.75)
    for word, want in [("relational", "relat"), ("hopping", "hop"), ("caresses", "caress"), ("happy", "happi"), ("agreed", "agre"), ("falling", "fall")]:
        assert overlap.stem(word) == want


def test_grounding(spark):
    rows = [("what helps sleep", "Rest helps sleep. Moons are cheese.", [1, 0, 9], ["rest helps sleep well"]), ("q", None, None, None)]
    got = grounding.grounding(spark.createDataFrame(rows, "question string, answer string, citations array<int>, contexts array<string>")).collect()
    assert (got[0].n_claims, got[0].n_supported, got[0].faithfulness, got[0].max_relevance) == (2, 1, 0.5, pytest.approx(2 / 3))
    assert (got[1].n_claims, got[1].faithfulness, got[1].hallucination_rate, got[1].uncited, got[1].mean_relevance) == (0, 0.0, 0.0, True, 0.0)


def test_windows(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "a" * 11), (3, ""), (4, None), (5, "abc")], "id int, t string")
    got = {(r.id, r.window): r.window_text for r in text.windows(df, "t", 10, 4).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 10, (2, 0): 10, (2, 1): 5, (5, 0): 3}
    with pytest.raises(ValueError):
        text.windows(df, "t", 4, 4)


def test_scope(spark):
    df = spark.createDataFrame([("Severe Depression and PTSD",), ("broken bone",)], "q string")
    got = scope.annotate(df, F.col("q")).collect()
    assert got[0].matched_terms == ["depression", "post-traumatic stress"] and got[0].evidence_expected
    assert got[1].scope == "out_of_corpus" and got[1].annotation_version == "scope_v1"


def test_prompts(spark):
    options = F.array(F.struct(F.lit("B").alias("label"), F.lit("two").alias("text")), F.struct(F.lit("A").alias("label"), F.lit("one").alias("text")))
    found = F.array(F.struct(F.lit("c1").alias("chunk_id"), F.lit("T").alias("title"), F.lit("body").alias("text")))
    q = F.lit("Why?")
    row = spark.range(1).select(
        prompts.plain_prompt(q, options).alias("p"), prompts.grounded_prompt(q, options, found).alias("g"), prompts.exam_prompt(q, options).alias("e"), prompts.response_schema(options, found).alias("s")
    ).first()
    assert '{"answer": "B"}' in row.p and "B. two\nA. one" in row.p
    assert "[c1] T\nbody" in row.g and "Allowed citation chunk IDs: c1\n" in row.g
    assert row.e.index("A. one") < row.e.index("B. two") and '"minItems":1' in row.s


def test_report(spark):
    rows = [
        ("q1", "s", "x", 1.0, None, True, ["c1", "c2"], ["c1"], ["c1"]),
        ("q2", "s", "", None, "bad", None, ["c1"], None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "question_id string, system_name string, scope string, latency_ms double, error string, is_correct boolean, retrieved_chunk_ids array<string>, citations array<string>, gold array<string>",
    )
    got = {(r.level, r.scope): r for r in report.run_report(df, 2).collect()}
    all_ = got["overall", None]
    assert (all_.accuracy_on_all, all_.ci_low, all_.ci_high) == (0.5, 0.094529, 0.905471)
    assert (all_.recall_at_k, all_.precision_at_k, all_.mrr, all_.ndcg_at_k, all_.labeled_queries) == (1, 0.5, 1, 1, 1)
    assert got["scope", "unannotated"].accuracy_on_successes is None and got["scope", "x"].citation_valid_rate == 1
    assert {r.scope: r.citation_valid_rate for r in report.run_summary(df).collect() if r.by_scope}["unannotated"] == 0.0


def test_validation(spark):
    opts = [("a ", "one"), ("b", "two"), ("A", "three")]
    rows = [(None, " q ", opts, "b", 1), ("x", "q", opts, "7", 2), ("x", "q", opts, None, 3), ("y", " ", opts, None, 4), ("z", "q", [], None, 5)]
    df = spark.createDataFrame(rows, "raw_id string, question string, options array<struct<label:string,text:string>>, answer string, line bigint").withColumn("split", F.lit("dev"))
    got = {r.line: r for r in validate.validate(df).collect()}
    assert got[1].record_id == "dev-000001" and got[1].answer_letter == "B" and got[1].options[0].text == "three" and got[1].reject is None
    assert [got[k].reject for k in (2, 3, 4, 5)] == ["answer", "duplicate id", "question", "options"]


def test_sample_is_fixed(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    a, b = ([r.k for r in validate.fixed_sample(df.repartition(n), 20, "k", "k").collect()] for n in (1, 7))
    assert a == b and len(a) == 20 and len(validate.fixed_sample(df, 99, "k", "k").collect()) == 50


def test_token_f1_of_empty_texts_is_zero(spark):
    from quarrymill.functions.overlap import token_f1

    rows = spark.createDataFrame([("", ""), ("a b", ""), ("a b", "b c")], "p string, t string")
    assert [r.f for r in rows.select(token_f1(F.col("p"), F.col("t")).alias("f")).collect()] == [0.0, 0.0, 0.5]


def test_a_failed_judge_call_is_no_score(spark):
    from quarrymill.operators.generate import judge

    def make():
        def call(text):
            if text == "fails":
                raise ValueError("no answer")
            return "0.5"

        return call

    rows = spark.createDataFrame([("fails",), ("fine",)], "prompt string")
    got = {r.prompt: r.hallucination for r in judge(rows, {"hallucination": F.col("prompt")}, make).collect()}
    assert got == {"fails": None, "fine": 0.5}


def test_stems_leave_every_match(spark):
    """Each rule alone against the rules behind stems, on its own phrases, near misses and letters that fold to i, k and s."""
    texts = ["pſychiatric", "anımal anİ MANİC manıa", "BIPOLAR bıpolar", "K panic ATTACK", "ptsd. OCD, ADHD", "post-TRAUMATIC stress", "maniac", "Cognitive-behavioral therapy",
             "attention deficit", "mental", "", "straße Autism"] + adapters.PHRASES + [" ".join(adapters.PHRASES)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.filter(F.array(*[F.when(F.col("t").rlike(f"(?iU){p}"), F.lit(name)) for name, p in scope.RULES]), lambda n: n.isNotNull())
    got = df.select("t", scope.matched_terms(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in got)
    assert {n for r in got for n in r.got} == {name for name, _ in scope.RULES} == set(scope.STEMS)
    folds = {chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and {chr(c).lower()[0], chr(c).upper().lower()[0]} & set("abcdefghijklmnopqrstuvwxyz") and len(chr(c).upper()) == 1}
    assert folds == set(scope.ODD)
