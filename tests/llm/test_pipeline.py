import collections

from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import exact_dedup, ngram_join, toxicity
from quarrymill.session import materialise


def test_stages_keep_what_they_should(spark, make, tmp_path):
    clean = [f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}" for i in range(40)]
    texts = clean + [clean[0]] * 3 + [" ".join(f"n{k}" for k in range(60)), " ".join(f"n{k}" for k in range(60)) + " more"]
    texts += ["awfulword " + f"t{i} u{i}" for i in range(60)] + [None, ""]
    docs = make(texts)
    labels = [(i, int("awfulword" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert left == {i for i, y in labels if not y}
    unique = materialise(corpus_pipeline.drop_copies(spark, kept, str(tmp_path)))
    ids = {r.doc_id for r in unique.collect()}
    assert left - ids == {0, 40, 41, 105} and unique.columns == docs.columns
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, unique, str(tmp_path)).collect()}
    assert ids - near == {44}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == near
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and exact_dedup and ngram_join and toxicity


def test_rows_have_an_identity_of_their_own(spark, make, tmp_path):
    words = [f"n{k}" for k in range(60)]
    clean = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(40)]
    toxic = [(100 + i, f"awfulword t{i} u{i}") for i in range(60)] + [(None, "awfulword without id"), (3, "awfulword that repeats an id")]
    more = [(500, "same row"), (500, "same row"), (None, "no id"), (None, "no id"), (501, None), (502, ""), (None, " ".join(words)), (None, " ".join(words) + " more")]
    docs = make(clean + toxic + more).withColumn("text_sha256", F.lit("mine")).withColumn("score", F.lit(1))
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic[:60]], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = materialise(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)))
    texts = collections.Counter(r.text for r in kept.collect())
    assert texts == collections.Counter(t for _, t in clean + more) and kept.columns == docs.columns
    unique = materialise(corpus_pipeline.drop_copies(spark, kept, str(tmp_path)))
    rows = [(r.doc_id, r.text, r.text_sha256, r.score) for r in unique.collect()]
    assert len(rows) == 40 + 5 and collections.Counter(r[1] for r in rows)["same row"] == 1
    assert {r[0] for r in rows if not r[1]} == {502} and {r[2:] for r in rows} == {("mine", 1)}
    near = materialise(corpus_pipeline.drop_near_copies(spark, unique, str(tmp_path)))
    assert sum((r.text or "").startswith("n0 ") for r in near.collect()) == 1
    assert near.count() == 44 and near.columns == docs.columns


def test_nothing_to_learn_from_drops_nothing(spark, make, empty, tmp_path):
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = make(["one", "two", "three", None])
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_columns_of_clashing_names(spark, make, tmp_path):
    """Names that the stages or the file reader use themselves."""
    texts = ["same text here", "same text here", " ".join(f"n{k}" for k in range(60)), " ".join(f"n{k}" for k in range(60)) + " more", None]
    docs = make(texts).withColumns({c: F.lit(7) for c in ("_metadata", "_key", "_n", "_first", "kept", "file", "at")})
    docs.write.parquet(str(tmp_path / "docs.parquet"))
    for rows in (docs, spark.read.parquet(str(tmp_path / "docs.parquet"))):
        unique = corpus_pipeline.drop_copies(spark, rows, str(tmp_path))
        assert sorted(r.doc_id for r in unique.collect()) == [1, 2, 3, 4] and unique.columns == docs.columns
        near = corpus_pipeline.drop_near_copies(spark, rows, str(tmp_path))
        assert sorted(r.doc_id for r in near.collect()) == [0, 2, 4] and {r["_metadata"] for r in near.collect()} == {7}
