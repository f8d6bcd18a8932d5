import collections
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import license_scan, sharding, topk, toxicity


def test_license_places(make, odd, empty):
    texts = ["Released under the MIT License.", "x under the MIT License, under the mit license", "Apache License, Version 2.0", "CC BY-NC", None, "mit license", "This is licensed under the GNU General Public License, version 3", "CC BY NCK"]
    got = {r.doc_id: r for r in license_scan.license_scan(make(texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (1, 1, 1, "mit", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (2, 1, 5, 9)
    assert got[2].base_labels == "apache-2" and got[3].base_labels == "cc-by-nc"
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[5].labels == "" and got[6].labels == "gpl-3" and got[6].n_base == 0 and got[7].n_base == 0
    assert license_scan.license_scan(odd).count() == 11 and license_scan.license_scan(empty).count() == 0


def test_license_neighbours(make):
    gnu = "licensed under the gnu {}general public license version {}"
    texts = [gnu.format("", 2), gnu.format("lesser ", 3), gnu.format("affero ", 3), gnu.format("", 3), gnu.format("", 5), gnu.format("lesser ", "2.1"), gnu.format("unknown ", 3)]
    texts += ["x " + gnu.format("", 2) + " or " + gnu.format("", 3), "Licensed under the very GNU General Public License version 3", "Released under the MIT no attribution"]
    texts += ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "Licensed under CC BY-SA 4.0", "Mozilla Public License, version 2.0"]
    got = {r.doc_id: r for r in license_scan.license_scan(make(texts)).collect()}
    assert [got[i].labels for i in range(7)] == ["gpl-2", "lgpl-3", "agpl-3", "gpl-3", "", "lgpl-2.1", ""]
    assert [got[i].labels for i in range(7, 13)] == ["gpl-2,gpl-3", "gpl-3", "", "boost-1", "cc-by-sa", ""]
    assert got[8].score == 0.9 and all(got[i].score == 1.0 for i in (0, 1, 2, 3, 5, 7, 10, 11)) and all(got[i].base_labels == "" for i in range(13))


def test_license_scan_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no standard tables here")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(db.execute(license_scan.ORACLE).fetchall())
    assert sorted(tuple(r) for r in license_scan.op3_license_scan(spark, folder).collect()) == want


def test_license_sql_has_the_same_rule(make):
    duckdb = pytest.importorskip("duckdb")
    wording = {label: phrase for label, _, phrase, _, _ in license_scan.TEMPLATES if len(phrase.split()) > 64}
    gnu = "licensed under the gnu {}general public license version {}"
    texts = [gnu.format(a, b) for a in ("", "lesser ", "affero ", "library ", "unknown ") for b in (2, "2.1", 3, 5)]
    texts += [gnu.format("", 2) + " or " + gnu.format("", 3), " ".join([gnu.format("", "")] * 40), gnu.format("very ", 3), "Released under the MIT no attribution", "released under the MIT license", "CC BY NC SA 4 0", "cc by nc " * 5]
    texts += [phrase.upper() for phrase in wording.values()] + ["x " + phrase.replace(" software ", " program ", 2) + " y" for phrase in wording.values()]
    texts += [phrase[: len(phrase) // 2] for phrase in wording.values()] + [license_scan.NOTICES[0][1], None, "", "\u212a cc by nc"]
    docs = make(texts)
    got = sorted(tuple(r) for r in license_scan.license_scan(docs).collect())
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    assert got == sorted(db.execute(license_scan.ORACLE).fetchall())
    by_text = {texts[r[0]]: r for r in got}
    assert by_text[gnu.format("", 2)][6] == "gpl-2" and by_text[gnu.format("lesser ", 3)][6] == "lgpl-3" and by_text[gnu.format("very ", 3)][6:] == ("", 0.0)
    assert by_text[" ".join([gnu.format("", "")] * 40)][6:] == ("", 0.0)  # no version: no core, no score
    for label, phrase in wording.items():
        assert by_text[phrase.upper()][6:] == (label, 1.0) and by_text["x " + phrase.replace(" software ", " program ", 2) + " y"][7] < 1.0


def test_shards_are_even_and_keep_copies(make):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 1500)] + ["copy" * 5] * 20 + ["hot text" * 20] * 800 + ["mid text" * 20] * 250 + ["half a shard" * 10] * 200
    rows = sharding.shard(make(texts), 8).collect()
    sizes, slots, of_text = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16
        sizes[r.shard] += r.size
        slots[r.shard].add(r.slot)
        of_text[texts[r.doc_id]].add(r.shard)
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    assert all(s == set(range(len(s))) for s in slots.values()) and len(rows) == len(texts)
    # Only the group that no shard can hold is cut up.
    assert 176 * 800 > mean > 176 * 250 and {text for text, found in of_text.items() if len(found) > 1} == {"hot text" * 20}


def test_cuts_are_weighted_medians(spark):
    rng = np.random.default_rng(5)
    points = [(int(w), *(int(x) for x in row)) for w, row in zip(rng.integers(1, 20, 500), np.column_stack([rng.integers(0, 1 << 40, 500), rng.integers(0, 4, (500, 2)) << 38, rng.integers(0, 1 << 41, 500)]))]
    cloud = spark.createDataFrame(points, "weight bigint, bytes bigint, lang bigint, source bigint, first_id bigint")
    room = [3.0, 1.0, 0.0, 2.0, 2.0]

    def check(node, own):
        if node.cut is None:
            return
        axis = max(range(1, 5), key=lambda d: max(p[d] for p in own) - min(p[d] for p in own)) if own else 1
        if own:
            assert sharding.DIMENSIONS[axis - 1] == node.dimension
            part, half = room[node.first : node.first + node.shards], node.shards // 2
            need, below = sum(p[0] for p in own) * sum(part[:half]) / sum(part), 0
            for value in sorted({p[axis] for p in own}):
                w = sum(p[0] for p in own if p[axis] == value)
                if below + w >= need:
                    want = below if need - below <= below + w - need else below + w
                    break
                below += w
            assert sum(p[0] for p in own if p[axis] < node.cut) == want
        check(node.children[0], [p for p in own if p[axis] < node.cut])
        check(node.children[1], [p for p in own if p[axis] >= node.cut])

    check(sharding.grow(cloud, room), points)


def test_rest_fills_shards():
    assert sharding.filled([5, 0, 2], 5) == [0.0, 3.5, 1.5] and sharding.filled([0, 0], 3) == [1.5, 1.5]
    assert sharding.filled([9, 1], 0) == [0.0, 0.0] and sharding.filled([4, 4, 1], 9) == [2.0, 2.0, 5.0]


def test_shards_odd(odd, empty):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == 11 and {r.size for r in rows if r.doc_id == 0} == {16}
    assert sharding.shard(empty, 4).count() == 0


def test_top_k_against_all(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=6).astype(float).tolist() for _ in range(300)]
    vectors += [vectors[0]] * 30 + [None, [float("nan")] * 6, [1.0, None], [0.5], []]
    rows = [(i, v, "extra") for i, v in enumerate(vectors)] + [(None, vectors[0], "extra")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, vector_id string")
    whole = df.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    got = collections.defaultdict(list)
    for r in topk.top_k(whole, whole.filter("vec_id % 20 = 0"), 7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    fine = {i: np.floor(1024 * np.array(v + [0.0] * (6 - len(v)))).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-int(fine[q] @ fine[i]), i) for i in fine if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in fine if i % 20 == 0} and topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_toxicity_learns_and_is_defined_everywhere(spark, make, odd, empty):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, 30)]
        if i % 5 == 0:
            words[int(rng.integers(30))] = "vile" + "abcdef"[i % 6]
        texts.append(" ".join(words))
        labels.append((i, int(i % 5 == 0)))
    known = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id bigint, toxic int").filter("doc_id % 2 = 0 or doc_id is null")
    got = {r.doc_id: r for r in toxicity.score_documents(make(texts), make(texts), known).collect()}
    right = [(got[i].predicted == 1) == (i % 5 == 0) for i in range(400)]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    none = known.filter("toxic = 7")
    assert {r.predicted for r in toxicity.score_documents(odd, odd, none).collect()} == {0}
    assert toxicity.score_documents(empty, empty, none).count() == 0


def test_the_constant_matches_the_prior():
    rows = pa.table({"positive": [True] * 5 + [False] * 95, "found": pa.array([[1]] * 5 + [[1]] * 10 + [[]] * 85, pa.list_(pa.int32()))})
    model = toxicity.fit(rows, [1], 0.1)
    z = np.array([model.bias + model.weights[1]] * 10 + [model.bias] * 85)
    assert abs((1 / (1 + np.exp(-z))).mean() - 0.1) < 1e-3
