import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import bm25, dense
from quarrymill.operators import ranking_metrics as M
from quarrymill.plans import adapters, queries

CHUNKS = [(0, "c1", "T", "sleep and rest"), (1, "c2", "T", "anxiety and worry are common"), (2, "c3", "T", "bones heal in six weeks")]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build_index(spark.createDataFrame(CHUNKS, "pos bigint, chunk_id string, title string, text string"))


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "question_id bigint, question string")


def test_bm25_goldens(spark, index):
    idf = {r.term: r.idf for r in index.idf.collect()}
    assert math.isclose(idf["anxiety"], 0.5108256237659907)
    assert math.isclose(idf["and"], 0.10642200495124808)
    assert math.isclose(index.stats.first().avgdl, 13 / 3)
    rows = bm25.retrieve(index, ask(spark, "anxiety worry"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c2", "c1"]
    assert math.isclose(rows[0].score, 0.9555011667565294, abs_tol=1e-9) and rows[1].score == 0


def test_dense_topk_searches_all_but_its_own(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 5)).round(3)
    vectors[20] = vectors[10] * 2
    vectors[31] = vectors[30]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosines = (units @ units.T).round(6)
    got = {(r.question_id, r["rank"]): (int(r.chunk_id), r.score) for r in queries.dense_topk(spark, str(tmp_path)).collect()}
    assert set(got) == {(q, n) for q in range(0, 60, 10) for n in (1, 2, 3)}
    for q in range(0, 60, 10):
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-cosines[q, i], i))[:3]
        assert [got[q, n][0] for n in (1, 2, 3)] == best
    assert got[10, 1][0] == 20 and got[20, 1][0] == 10 and got[30, 1][0] == 31


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_top_k_is_full(spark, index, k):
    for text in ("anxiety", "?", "zzz", "and and"):  # blank ones are rejects, see test_guards
        rows = bm25.retrieve(index, ask(spark, text), k).collect()
        assert sorted(r["rank"] for r in rows) == list(range(1, min(k, 3) + 1))


def test_k_must_be_positive(spark, index):
    with pytest.raises(ValueError):
        bm25.retrieve(index, ask(spark, "x"), 0)


def plain_bm25(texts, question, k1, b, epsilon):
    """Scores of all texts by the formulas, in plain Python."""
    docs = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    n, mean_length = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    tf = [Counter(d) for d in docs]
    found = []
    for d, counts in zip(docs, tf):
        norm = k1 * (1 - b + b * len(d) / mean_length)
        terms = [w for w in re.findall("[a-z0-9]+", question.lower()) if counts[w]]
        found.append(sum((idf[w] if idf[w] >= 0 else floor) * counts[w] * (k1 + 1) / (counts[w] + norm) for w in terms))
    return found


@pytest.mark.parametrize("block, first, listed", [(64, 1, 10_000), (8, 4, 10_000), (3, 2, 0)])
def test_pruned_top_k_is_exact(spark, monkeypatch, block, first, listed):
    """Whatever the blocks: the same rows as by all scores, ties and questions of few hits included."""
    for name, value in (("BLOCK", block), ("FIRST", first), ("MOST_LISTED", listed)):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(300)])
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=chance / chance.sum())) for _ in range(500)]
    texts[20:40] = [texts[20]] * 20
    texts += ["rare rare w1 w2", "w1 " * 400, "", "ONLY"]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "pos bigint, chunk_id string, text string").repartition(3)
    asked = ["w1 w2 w3", texts[20], "rare w1", "only", "nothing here", "w1 w1 w290 w250", "w200 w201 w202 w203"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    index = bm25.build_index(chunks)
    got = {(r.question_id, r["rank"]): (r.pos, r.score) for r in bm25.retrieve(index, questions, 5).collect()}
    every = {(r.question_id, r.pos): r.score for r in bm25.scores(index, questions).collect()}
    for q, text in enumerate(asked):
        want = plain_bm25(texts, text, bm25.K1, bm25.B, bm25.EPSILON)
        assert all(abs(every.get((q, pos), 0) - s) < 1e-9 for pos, s in enumerate(want))
        best = sorted((-round(s, 9), pos) for pos, s in enumerate(want))[:5]
        assert [got[q, n + 1][0] for n in range(5)] == [pos for _, pos in best]
        assert [got[q, n + 1][1] for n in range(5)] == pytest.approx([-s for s, _ in best], abs=2e-9)
    other, reads = bm25.pruned_scores(index, questions, 5, k1=0.9, b=0.4)
    best = {}
    for r in other.collect():
        best.setdefault(r.question_id, []).append((-round(r.score, 9), r.pos))
    for q in (0, 1, 5):
        want = sorted((-round(s, 9), pos) for pos, s in enumerate(plain_bm25(texts, asked[q], 0.9, 0.4, bm25.EPSILON)))[:5]
        assert [pos for _, pos in sorted(best[q])[:5]] == [pos for _, pos in want]
    read = {r.question_id: r for r in reads.collect()}
    assert read[1].postings == sum(sum(w in set(t.lower().split()) for w in set(texts[20].split())) for t in texts)
    assert all(r.postings_read <= r.postings and r.blocks_read <= r.blocks for r in read.values())
    if block == 8:
        assert read[1].postings_read < 0.5 * read[1].postings  # a text that some chunks repeat


def test_frequent_terms_are_spread(spark):
    """No posting of a term is in the same shuffle key as one of a far block."""
    chunks = spark.range(4000).selectExpr("id as pos", "cast(id as string) as chunk_id", "'common word' as text")
    index = bm25.build_index(chunks)
    most = index.postings.groupBy("term", "block").count().agg({"count": "max"}).first()[0]
    assert most == bm25.BLOCK and index.blocks.filter("term = 'common'").count() == -(-4000 // bm25.BLOCK)


def test_dense_ties_by_position(spark):
    chunks = spark.createDataFrame([(0, "c1", [1.0, 0.0]), (1, "c2", [0.0, 2.0]), (2, "c3", [-1.0, 0.0])], "pos bigint, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "question_id bigint, embedding array<float>")
    assert [r.chunk_id for r in dense.retrieve(chunks, asked, 2).orderBy("rank").collect()] == ["c2", "c1"]


def test_fusion(spark):
    rows = [(1, "c1", 1), (1, "c2", 2)]
    ranked = spark.createDataFrame(rows, "question_id bigint, chunk_id string, rank int")
    got = dense.fuse(ranked, ranked, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c1", pytest.approx(2 / 61)), ("c2", pytest.approx(2 / 62))]


def test_metric_protocols(spark):
    rows = spark.createDataFrame(
        [("q1", ["c1", "c2"], ["c1"]), ("q2", ["x", "c1", "c1"], ["c1", "c9"]), ("q3", [], ["c1"]), ("q4", ["c1"], None)],
        "question_id string, retrieved_chunk_ids array<string>, gold array<string>",
    )
    common = {r.question_id: r for r in M.common(rows, 2).collect()}
    assert (common["q1"].recall, common["q1"].precision, common["q1"].mrr, common["q1"].ndcg) == (1, 0.5, 1, 1)
    assert (common["q2"].recall, common["q2"].precision, common["q2"].mrr) == (0.5, 0.5, 0.5)
    assert common["q3"].precision == 0 and common["q4"].recall is None
    strict = {r.question_id: r for r in M.strict(rows, 3).collect()}
    assert strict["q2"].precision == pytest.approx(2 / 3) and strict["q2"].recall == 1 and strict["q4"].recall is None
    listed = {r.question_id: r for r in M.listed(rows, 3).collect()}
    assert listed["q2"].ap == pytest.approx((1 / 2 + 2 / 3) / 2) and listed["q2"].rr == 0.5 and listed["q4"].f1 == 0


def test_embedding_guard(spark):
    df = spark.createDataFrame([("a",), (" ",)], "t string")
    with pytest.raises(Exception, match="blank"):
        dense.embed(df, "t", lambda: lambda texts: [[1.0]] * len(texts)).collect()


def test_guards(spark, index):
    asked = spark.createDataFrame([(1, " \t"), (2, None), (3, "worry")], "question_id bigint, question string")
    assert {r.question_id for r in bm25.retrieve(index, asked).collect()} == {3}
    assert {(r.question_id, r.reject) for r in bm25.blank_questions(asked).collect()} == {(1, "query must be non-empty"), (2, "query must be non-empty")}
    empty = spark.createDataFrame([], "pos bigint, chunk_id string, title string, text string, embedding array<double>")
    wide = spark.createDataFrame([(1, [1.0, 2.0])], "question_id bigint, embedding array<double>")
    with pytest.raises(ValueError):
        bm25.build_index(empty)
    with pytest.raises(ValueError):
        dense.retrieve(empty, wide)
    one = spark.createDataFrame([(0, "c", [1.0])], "pos bigint, chunk_id string, embedding array<double>")
    with pytest.raises(Exception, match="dimension does not match"):
        dense.retrieve(one, wide).collect()


def test_best_scores_in_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores, k = rng.integers(0, 5, rng.integers(1, 30)).astype(float), int(rng.integers(1, 9))
        assert dense._first_best(scores, k).tolist() == np.argsort(-scores, kind="stable")[:k].tolist()


@pytest.mark.parametrize("k, most, block", [(3, 1024, 16_384), (7, 5, 40), (400, 1024, 16_384)])
def test_pruned_cosines_are_exact(spark, monkeypatch, k, most, block):
    """The rows of the block product, ties, zero vectors and large clusters included."""
    monkeypatch.setattr(dense, "MOST_CLUSTERS", most)
    rng = np.random.default_rng(19)
    centres = rng.normal(size=(12, 6))
    vectors = np.concatenate([centres[rng.integers(12, size=340)] + rng.normal(scale=0.05, size=(340, 6)), np.zeros((3, 6)), -centres[:2]])
    vectors[50:60] = vectors[50]
    chunks = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(vectors)], "pos bigint, chunk_id string, embedding array<double>").repartition(3)
    asked = [(i, (vectors[i] * 3).tolist()) for i in (0, 50, 55, 120, 341)] + [(1000, rng.normal(size=6).tolist())]
    questions = spark.createDataFrame(asked, "question_id bigint, embedding array<double>")
    rows = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, r.pos, round(r.score, 8)) for r in df.collect())
    want = rows(dense.retrieve(chunks, questions, k, but_own=True))
    monkeypatch.setattr(dense, "BLOCK", block)
    found, reads = dense.retrieve_pruned(dense.cluster(chunks), questions, k, but_own=True)
    assert rows(found) == want
    read = {r.question_id: (r.vectors, r.vectors_read) for r in reads.collect()}
    assert set(read) == {q for q, _ in asked} and all(n == 345 for n, _ in read.values())
    if k == 3:
        assert read[120][1] < 0.6 * 345  # its own cluster and its neighbours
    with pytest.raises(Exception, match="dimension does not match"):
        dense.retrieve_pruned(dense.cluster(chunks), spark.createDataFrame([(1, [1.0])], "question_id bigint, embedding array<double>"))[0].collect()


@pytest.mark.parametrize("questions_at_once, strip", [(4096, 64), (2, 3)])
def test_search_without_an_index_is_exact(spark, monkeypatch, questions_at_once, strip):
    """The rows of all scores, over several tasks and passes, with gaps between positions and texts that share no term."""
    monkeypatch.setattr(bm25, "MOST_QUESTIONS", questions_at_once)
    monkeypatch.setattr(bm25, "STRIP", strip)
    rng = np.random.default_rng(13)
    words = np.array([f"w{i}" for i in range(200)])
    chance = 1 / np.arange(1, 201)
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)), p=chance / chance.sum())) for _ in range(200)]
    texts[20:30] = [texts[20]] * 10
    texts += ["rare Rare-w1_w2", "w1 " * 400, None, "ONLY", "Kelvin İx", "été w1"]
    rows = [(i * 3 + 1, f"c{i}", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "pos bigint, chunk_id string, text string").repartition(3)
    asked = ["w1 w2 w3", texts[20], "rare w1", "only", "nothing here", "w1 w1 w150 w120", "?", "kelvin x", " "]
    questions = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "question_id string, question string")
    got = {(r.question_id, r["rank"]): (r.pos, r.chunk_id, r.score) for r in bm25.search(chunks, questions, 5).collect()}
    assert len(got) == 5 * (len(asked) - 1)  # the blank one is no question
    for q, text in enumerate(asked[:-1]):
        want = plain_bm25([t or "" for t in texts], text, bm25.K1, bm25.B, bm25.EPSILON)
        best = sorted((-round(s, 9), i) for i, s in enumerate(want))[:5]
        assert [got[f"q{q}", n + 1][:2] for n in range(5)] == [(i * 3 + 1, f"c{i}") for _, i in best]
        assert [got[f"q{q}", n + 1][2] for n in range(5)] == pytest.approx([-s for s, _ in best], abs=2e-9)
    few = spark.createDataFrame([(0, "a", ""), (1, "b", None)], "pos bigint, chunk_id string, text string")
    assert [(r.pos, r.score) for r in bm25.search(few, ask(spark, "x"), 5).orderBy("rank").collect()] == [(0, 0), (1, 0)]
    assert bm25.search(chunks, ask(spark, " "), 5).count() == 0


def test_queries_write_no_postings(spark, monkeypatch, tmp_path):
    """What a query writes of the corpus is counts of terms, not a row for each term of each text."""
    spark.createDataFrame([(i, f"common word{i % 2}", "x") for i in range(50)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common word1")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, keep = {}, bm25.materialise
    monkeypatch.setattr(bm25, "materialise", lambda df, name="table": rows.setdefault(name, keep(df, name)))
    assert queries.bm25_topk(spark, str(tmp_path)).count() == 3
    assert queries.bm25_index_stats(spark, str(tmp_path)).count() == 3
    assert "postings" not in rows and rows["terms"].count() == 3


def test_few_pairs_shuffle_no_texts(spark, tmp_path):
    """Gold pairs and ranked chunks meet the texts by a broadcast, whatever Spark would choose."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(0, f"before {text} after", "s"), (1, text[:40], "s"), (2, None, "s"), (3, text, "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, text)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ranked = spark.createDataFrame([(7, "0", 1, 0.5), (7, "3", 2, 0.4)], "question_id bigint, chunk_id string, rank int, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gold = adapters.gold(spark, str(tmp_path))
        packed = dense.pack_results(ranked, adapters.chunks(spark, str(tmp_path)).select("chunk_id", "title", "text"))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (gold, packed)]
        assert sorted(map(tuple, gold.collect())) == [(7, "0"), (7, "3")]
        assert packed.first().retrieved_chunk_ids == ["0", "3"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_hashed_vectors_are_made_in_their_rows(spark):
    rows = [(1, "a", "B b c-b é9"), (2, "a", None), (2, "a", "")]  # keys may repeat
    made = adapters.hashed_vectors(spark.createDataFrame(rows, "pos bigint, chunk_id string, text string").repartition(1), ["pos", "chunk_id"], "text")
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    want = [0.0] * adapters.WIDTH
    for term in ("b", "b", "b", "c", "9"):
        want[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % adapters.WIDTH] += 1
    got = sorted((r.pos, r.chunk_id, r.embedding) for r in made.collect())
    assert got == [(1, "a", want), (2, "a", [0.0] * adapters.WIDTH), (2, "a", [0.0] * adapters.WIDTH)]


def test_pruned_cosines_broadcast_no_pairs(spark, monkeypatch):
    """Pairs of questions and clusters meet the questions' vectors by a shuffle, and few vectors go to the driver."""
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 4)))], "pos bigint, chunk_id string, embedding array<double>")
    plans, rows, keep = {}, {}, dense.materialise

    def watched(df, name="table"):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return rows.setdefault(name, keep(df, name)) if name == "drawn" else keep(df, name)

    monkeypatch.setattr(dense, "materialise", watched)
    clusters = dense.cluster(chunks)
    asked = chunks.filter("pos % 100 = 0").select(F.col("pos").alias("question_id"), "embedding")
    assert dense.retrieve_pruned(clusters, asked, 2)[0].count() == 60
    assert len(plans["best"]) == 2 and not any("BroadcastHashJoin [question_id" in p for p in plans["best"])
    order = [r.v for r in chunks.orderBy(F.xxhash64("pos"), "pos").limit(55).select(dense.normalised(F.col("embedding")).alias("v")).collect()]
    assert clusters.centres.tolist() == order and 55 <= rows["drawn"].count() < 300


def test_sweep_query_writes_no_postings(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"common word{i % 2}", "x") for i in range(50)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common word1")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names, keep = [], bm25.materialise
    monkeypatch.setattr(bm25, "materialise", lambda df, name="table": names.append(name) or keep(df, name))
    assert queries.topk_sweep(spark, str(tmp_path)).count() == 1 + 3 + 5 + 8 and "postings" not in names


def test_a_task_hands_on_each_term_once(monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]) for texts in (["a b a", None, "c"], ["", "b"], ["a-c a"], [])]
    want = {"a": (2, 4), "b": (2, 2), "c": (2, 2)}
    for most in (bm25.MOST_HELD, 4, 1):
        monkeypatch.setattr(bm25, "MOST_HELD", most)
        rows, found = 0, {}
        for part in bm25._counts(iter(batches)):
            for r in part.to_pylist():
                df, tf = found.get(r["term"], (0, 0))
                rows, found[r["term"]] = rows + 1, (df + r["df"], tf + r["tf"])
        assert found == want and (rows == 3 or most < 3)
    assert list(bm25._counts(iter([]))) == []
