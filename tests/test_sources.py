import json

import pytest

from quarrymill.operators import bm25, validate
from quarrymill.sources import records as R


@pytest.fixture()
def write(tmp_path):
    def run(name, lines):
        path = tmp_path / name
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
        return str(path)

    return run


def test_questions(spark, write):
    good = {"id": "a", "question": " Why? ", "options": {"A": "one", "b": "two"}, "answer_idx": "B", "extra": 1}
    path = write("dev.jsonl", [good, "", {**good, "id": None, "answer_idx": 0}, good, "{bad", {**good, "id": "r", "answer_idx": 5}, {**good, "id": "t", "options": {"A": 1}}])
    got = {r.source_line: r for r in R.load_questions(spark, path).collect()}
    assert got[1].answer_letter == "B" and got[1].question == "Why?" and json.loads(got[1].metadata) == {"extra": 1} and got[1].split == "dev"
    assert got[3].question_id == "dev-000003" and got[3].answer_index == 0 and got[3].reject is None
    assert got[4].reject == "duplicate id" and got[5].reject == "invalid JSON" and "range" in got[6].reject and "options" in got[7].reject
    with pytest.raises(R.RecordError, match=":4: duplicate"):
        R.require(R.load_questions(spark, path))


def test_chunks_and_gold(spark, write):
    path = write("c.jsonl", [{"id": "c1", "title": "T", "content": " ", "contents": "body "}, {"id": "c2", "content": ""}])
    got = R.load_chunks(spark, path).orderBy("line").collect()
    assert (got[0].text, got[0].corpus_pos, got[0].reject) == ("body", 0, None) and got[1].reject == "content must be text"
    gold = write("g.jsonl", [{"question_id": "q", "gold_chunk_ids": ["x"]}, {"question_id": "q", "supporting_chunk_ids": ["a", "a", "b"]}])
    assert sorted(r.chunk_id for r in R.load_gold(spark, gold).collect()) == ["a", "b"]
    loose = write("l.jsonl", [{"question_id": "q", "gold_chunk_ids": "x"}, {"question_id": "p"}])
    assert [r.chunk_id for r in R.load_gold(spark, loose, ("relevant_chunk_ids", "gold_chunk_ids"), required=False).collect()] == ["x"]
    with pytest.raises(R.RecordError):
        R.load_gold(spark, write("b.jsonl", [{"question_id": "q"}]))


def test_annotations_and_sinks(spark, write, tmp_path):
    full = dict.fromkeys(R.ANNOTATION_FIELDS, "x") | {"options": {"A": "1"}, "evidence_expected": True, "matched_terms": ["m"]}
    path = write("a.jsonl", [full, {"question_id": "y"}])
    got = R.load_annotations(spark, path).orderBy("line").collect()
    assert got[0].reject is None and got[0].matched_terms == ["m"] and got[1].reject.startswith("missing")
    R.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '{"a":1,"b":null}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    mark = R.fingerprints(spark, path).first()
    assert mark.bytes > 0 and len(mark.sha256) == 64


def test_index_round_trip(spark, tmp_path):
    index = bm25.build_index(spark.createDataFrame([(0, "c", "t", "a b a")], "pos bigint, chunk_id string, title string, text string"))
    R.save_index(index, str(tmp_path / "i"), {"k": 3})
    loaded, facts = R.load_index(spark, str(tmp_path / "i"))
    assert facts == {"k": 3} and sorted(map(tuple, loaded.postings.collect())) == sorted(map(tuple, index.postings.collect()))


def test_positions_run_over_several_files(spark, write, tmp_path):
    for name in ("a.jsonl", "b.jsonl"):
        write(name, [{"id": f"{name}{i}", "content": "x"} for i in range(5)])
    got = R.load_chunks(spark, f"{tmp_path}/*.jsonl").orderBy("file", "line").collect()
    assert [r.corpus_pos for r in got] == list(range(10)) and [r.line for r in got] == [*range(1, 6)] * 2


def test_saved_hybrid_index(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "c1", "sleep well", [3.0, 4.0]), (1, "c2", "worry", [0.0, 0.0])], "pos bigint, chunk_id string, text string, embedding array<double>")
    R.save_hybrid(bm25.build_index(chunks), chunks, str(tmp_path / "index"), {"corpus": "x"})
    index, vectors, facts = R.load_hybrid(spark, str(tmp_path / "index"))
    assert facts == {"corpus": "x", "count": 2, "dimension": 2, "normalised": True, "rrf_constant": 60}
    assert {r.chunk_id: r.embedding for r in vectors.collect()} == {"c1": [0.6, 0.8], "c2": [0.0, 0.0]} and index.corpus.count() == 2
    uneven = spark.createDataFrame([(0, "c1", [1.0]), (1, "c2", [1.0, 2.0])], "pos bigint, chunk_id string, embedding array<double>")
    for bad in (uneven, uneven.limit(0)):
        with pytest.raises(ValueError):
            R.save_vectors(bad, str(tmp_path / "bad"), {})


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    """Blank lines, byte order marks and lines that no split ends with; no exchange holds a text."""
    want, at = {}, 0
    for name, count in (("a.jsonl", 900), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 400)):
        lines = ["" if i % 7 == 3 else "\u2003 " if i % 11 == 5 else ("\ufeff" if i % 13 == 0 else "") + json.dumps({"id": f"{name}{i}", "content": "é" * (i % 50)}) for i in range(count)]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
        for number, line in enumerate(lines, start=1):
            if line.strip():
                want[name, number] = (line.removeprefix("\ufeff"), at)
                at += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = R.read_lines(spark, f"{tmp_path}/*.jsonl")
        rows = read.collect()
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file.rsplit("/", 1)[1], r.line): (r.value, r["at"]) for r in rows} == want and len(rows) == len(want)
    assert all(r.status is None for r in rows)
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Window" not in plan


def test_repeats_of_a_hot_key(spark, monkeypatch):
    """The first row by the order is no repeat, whether or not keys are split for the join."""
    rows = [(("hot" if i % 3 else f"k{i % 40}") if i % 10 else None, i % 50, -i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, file int, line int").repartition(5)
    want = {}
    for k, file, line in rows:
        of_key = [(f, n) for key, f, n in rows if key == k]
        want[file, line] = (1, False) if k is None else (len(of_key), (file, line) != min(of_key))
    for most in (200_000, 0):
        monkeypatch.setattr(validate, "MOST_BROADCAST", most)
        marked = validate.mark_repeats(df, "k", ("file", "line"))
        assert {(r.file, r.line): (r.copies, r.repeat) for r in marked.collect()} == want
        assert marked.columns == ["k", "file", "line", "copies", "repeat"]
