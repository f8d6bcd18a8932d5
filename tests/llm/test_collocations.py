import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import collocations
from quarrymill.llm.double_array import DoubleArray


def brute(rows, least, longest, percent=50, scale=1_000_000, best=2000):
    """The contract, word by word: rows of (lang, text)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i : i + size]] = max(longer[lang, w[i : i + size]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        cuts = [(scale * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        if not longer[lang, w] or 100 * longer[lang, w] < percent * a:
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best])}


def rows_of(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("longest, most_bits, per_trie", [(3, 28, 1 << 20), (4, 28, 1 << 20), (3, 15, 150)])
def test_equals_brute_force(spark, monkeypatch, longest, most_bits, per_trie):
    """Also with small filters, and with several tries."""
    monkeypatch.setattr(collocations, "MOST_BITS", most_bits)
    monkeypatch.setattr(collocations, "MOST_IN_TRIE", per_trie)
    rng = np.random.default_rng(5)
    words = ["ab", "Ab", "É", "é", "x-y", "the", " ", "z\x1cz", "q", "r", "s", "t"]
    rows = []
    for i in range(120):
        text = "".join(words[int(rng.integers(12)) if rng.random() < 0.7 else 5] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",x "]) for _ in range(int(rng.integers(0, 60))))
        rows.append((["en", "de", None, "und"][i % 4], text))
    rows += [("en", None), ("en", ""), ("xx", "one two"), ("en", "the q " * 3000), ("la", "a b c d " * 40), ("la", "a b c d. " * 40)]
    df = spark.createDataFrame([(i, t, lang, 1, "c", "w") for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, n int, phrase string, word string").repartition(4)
    for least, best in ((3, 2000), (8, 5)):
        got = rows_of(collocations.collocations(df, least, longest, best=best))
        assert got == brute(rows, least, longest, best=best) and got


def test_odd_texts(odd, empty):
    want = brute([(r.lang, r.text) for r in odd.collect()], 2, 3)
    assert rows_of(collocations.collocations(odd, least=2)) == want and want
    assert rows_of(collocations.collocations(empty)) == set()


def test_large_counts_are_exact(spark, monkeypatch):
    """Products beyond 64 bits."""
    big = 3_000_000_007
    words = spark.createDataFrame([("en", b"p", 4 * big + 1), ("en", b"q", big + 1)], "lang string, word binary, n bigint").select("lang", "word", F.xxhash64("lang", "word").alias("hash"), "n")
    counted = words.agg(F.array(F.min(F.when(F.col("word") == b"p", F.col("hash"))), F.min(F.when(F.col("word") == b"q", F.col("hash")))).alias("phrase")).withColumn("a", F.lit(big))
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (words, counted))
    got = collocations.collocations(words).first()
    assert (got.phrase, got.score) == ("p q", 1_000_000 * big * big // ((4 * big + 1) * (big + 1)))


def test_double_array_counts():
    rng = np.random.default_rng(6)
    text = rng.integers(1, 40, 20_000)
    text[rng.random(20_000) < 0.1] = 0
    grams = {size: collections.Counter(g for i in range(len(text) - size + 1) if 0 not in (g := tuple(text[i : i + size].tolist()))) for size in (2, 3, 4)}
    phrases = [np.array(sorted(list(g)[::3]), np.int64) for g in grams.values()]
    trie = DoubleArray(phrases)
    counts = np.zeros(len(trie.check), np.int64)
    trie.count(text, counts)
    for own, state in zip(phrases, trie.accepting, strict=True):
        assert [grams[own.shape[1]][tuple(p)] for p in own.tolist()] == counts[state].tolist() and len(set(state.tolist())) == len(own)
    DoubleArray([np.empty((0, 2), np.int64)]).count(text, counts := np.zeros(500, np.int64))
    assert counts.sum() == 0
