import collections
import math

import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import language_id

WORDS = {"aa": "the and of this thing with", "bb": "der und das ist nicht über", "cc": "que les des été ça où"}


def sample(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(1, 20)))).title() + "! 12", lang))
    return rows


def grams(text):
    """The n-grams by their definition: runs of 1 to 3 characters of words with their borders."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in words:
        padded = f" {w} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                if (g := padded[i : i + size]) != " ":
                    yield g


def test_ngrams_are_those_of_words():
    texts = ["Ab  c1d", "", None, "éÉß", "12 34", "x" * 40, "İ I ŉ"]
    names: dict = {}
    got = collections.Counter()
    for number, bucket in language_id.ngrams(texts, 40):
        got.update(zip(number.tolist(), bucket.tolist()))
    want = collections.Counter((i, g) for i, t in enumerate(texts) for g in grams(t))
    for number in range(len(texts)):
        own = sorted(n for (i, _), n in got.items() if i == number)
        assert own == sorted(n for (i, _), n in want.items() if i == number)
    for (i, b), n in got.items():
        names.setdefault(b, set()).add(i)
    assert len(names) == len({g for _, g in want})


def test_strips_do_not_change_ngrams(monkeypatch):
    texts = ["one two three " * 20, None, "four", "five six " * 30]
    whole = collections.Counter(p for n, b in language_id.ngrams(texts, 20) for p in zip(n.tolist(), b.tolist()))
    monkeypatch.setattr(language_id, "STRIP", 16)
    assert whole == collections.Counter(p for n, b in language_id.ngrams(texts, 20) for p in zip(n.tolist(), b.tolist()))


def test_equals_plain_naive_bayes(spark):
    rows = sample(9, 150) + [(900, "the x y", "bb"), (901, "...", "dd"), (902, None, "aa"), (903, "qq zz", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(3)
    model = language_id.train(df)
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        if lang and any(grams(text)):
            counts[lang].update(grams(text))
            texts[lang] += 1
    asked = [(i, t) for i, t, _ in sample(10, 60)] + [(70, "xyz"), (71, "der the"), (72, "ÉTÉ")]
    got = {r.i: r for r in language_id.predict(spark.createDataFrame(asked, "i int, text string"), model).collect()}
    assert model.langs == ("aa", "bb", "cc")  # dd has no letters
    for i, text in asked:
        logs = []
        for lang in model.langs:
            total = sum(counts[lang].values()) + 0.5 * (1 << model.bits)
            logs.append(math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(text)))
        best = max(range(3), key=logs.__getitem__)
        assert got[i].lang_pred == model.langs[best]
        assert abs(got[i].score - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-9


def test_held_out_accuracy(spark):
    rows = sample(11, 400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held_out", language_id.held_out())
    found = language_id.predict(df, language_id.train(df.filter("not held_out"))).filter("held_out")
    assert found.count() > 50 and found.filter("lang_pred = lang").count() > 0.97 * found.count()


def test_odd_texts(spark, odd, empty):
    model = language_id.train(odd.withColumn("lang", F.when(F.col("text") == "one", "xx").when(F.col("text").startswith("x"), "yy")))
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.score == 0) if not lettered else r.lang_pred in ("xx", "yy")
    nothing = language_id.train(empty)
    assert nothing.langs == () and {(r.lang_pred, r.score) for r in language_id.predict(odd, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict(empty, model).count() == 0


def test_many_languages_fit(spark, monkeypatch):
    """The more languages, the fewer buckets; sums over slices of the looked-up rows are the same."""
    rows = [(i, " ".join([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}"] * 5), f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    monkeypatch.setattr(language_id, "MOST_ENTRIES", 1 << 21)
    model = language_id.train(df)
    assert model.bits == 12 and len(model.langs) == 300
    assert language_id.predict(df, model).filter("lang_pred = lang").count() > 290
