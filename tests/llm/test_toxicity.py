import numpy as np
import pyarrow as pa

import corpus_pipeline
from quarrymill.llm import toxicity


def plain_slope(rows, kept, theta, bias, prior):
    """The risk's parts and its gradient, a row at a time."""
    parts = {True: [], False: []}
    for positive, found in rows:
        parts[positive].append(found)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    score = lambda found: sum(theta[f] for f in found) + bias
    seen = prior * np.mean([np.log1p(np.exp(-score(x))) for x in parts[True]])
    unseen = np.mean([np.log1p(np.exp(score(x))) for x in parts[False]]) - prior * np.mean([np.log1p(np.exp(score(x))) for x in parts[True]])
    slope = dict.fromkeys([*kept, "bias"], 0.0)
    for positive, sign, n in ((True, -prior, len(parts[True])), (False, 1.0, len(parts[False]))):
        for x in parts[positive]:
            by_z = sign * sigmoid(score(x)) / n
            for f in [*x, "bias"]:
                slope[f] += by_z
    if unseen < 0:
        return {f: -v for f, v in slope.items()}, seen, unseen
    for x in parts[True]:
        for f in [*x, "bias"]:
            slope[f] -= prior * (1 - sigmoid(score(x))) / len(parts[True])
    return slope, seen, unseen


def test_first_step_follows_the_plain_gradient(monkeypatch):
    """Adam's first step goes by the sign of each slope, at its full rate."""
    monkeypatch.setattr(toxicity, "STEPS", 1)
    rng = np.random.default_rng(14)
    kept = [3, 8, 11, 20]
    rows = [(bool(i < 12), [f for f in kept if rng.random() < (0.6 if i < 12 and f < 10 else 0.3)]) for i in range(80)]
    table = pa.table({"positive": [p for p, _ in rows], "found": pa.array([x for _, x in rows], pa.list_(pa.int32()))})
    for prior in (0.05, 0.4, 0.85):
        slope, _, _ = plain_slope(rows, kept, dict.fromkeys(kept, 0.0), np.log(prior / (1 - prior)), prior)
        model = toxicity.fit(table, kept, prior)
        for f in kept:
            assert abs(model.weights[f] + toxicity.RATE * np.sign(slope[f])) < 1e-4


def test_more_steps_lower_the_plain_risk():
    rng = np.random.default_rng(15)
    kept = [1, 2, 3]
    rows = [(i < 30, [f for f in kept if rng.random() < (0.9 if f == 1 and (i < 30 or i % 10 == 0) else 0.2)]) for i in range(400)]
    table = pa.table({"positive": [p for p, _ in rows], "found": pa.array([x for _, x in rows], pa.list_(pa.int32()))})
    model = toxicity.fit(table, kept, 0.15)
    risk = lambda theta, bias: (lambda s, u: s + max(0.0, u))(*plain_slope(rows, kept, theta, bias, 0.15)[1:])
    assert risk(model.weights, model.bias) < risk(dict.fromkeys(kept, 0.0), np.log(0.15 / 0.85)) - 0.02


def test_class_prior():
    rng = np.random.default_rng(16)
    positive = rng.normal(3, 1, 500)
    unlabelled = np.append(rng.normal(3, 1, 300), rng.normal(-3, 1, 2700))
    assert abs(toxicity.class_prior(positive, unlabelled) - 0.1) < 0.02


def corpus(spark, make, n, n_toxic, n_clean_labels):
    """Every toxic text and few clean ones have a label."""
    rng = np.random.default_rng(17)
    texts = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, 40)]
        if i < n_toxic:
            for k in rng.integers(0, 40, 3):
                words[k] = "vile" + "abcdefgh"[int(rng.integers(8))]
        texts.append(" ".join(words))
    labels = [(i, 1) for i in range(n_toxic)] + [(i, 0) for i in range(n_toxic, n_toxic + n_clean_labels)]
    return make([*texts, None, ""]), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_clean_texts_stay_where_toxic_ones_were_labelled_more_often(spark, make, tmp_path):
    for n, n_toxic, n_clean in ((600, 80, 40), (1000, 100, 50)):
        docs, labels = corpus(spark, make, n, n_toxic, n_clean)
        folder = str(tmp_path / f"{n}")
        labels.write.parquet(f"{folder}/labels.parquet")
        kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
        assert len(kept & set(range(n_toxic))) <= 0.1 * n_toxic
        assert len(kept - set(range(n_toxic))) >= 0.98 * (n + 2 - n_toxic) and {n, n + 1} <= kept


def test_texts_without_features_are_never_toxic(make, odd):
    model = toxicity.Model(4.0, {7: 1.0}, 0.6)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {toxicity.MOST_WITHOUT}
