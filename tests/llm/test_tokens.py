import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrymill.llm import bpe, lm_scoring, packing, vocab

PARTS = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "é", "ß", "'s", "'LL", "<|endoftext|>", "<|", "1", "23", "…", "日本", "😀", "\x1c", "\x85", "İ", "aaaa", "e", "́", "Σ", "K", "²"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_bpe_equals_the_library(make):
    path = vocab.tokenizer_path(bpe.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = fuzz(400) + ["ab" * 3000, None, ""]
    got = bpe.encode(make(texts), decoded=True).withColumn("list", bpe.ids_array("ids")).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.list) == ids == list(array("I", bytes(r.ids))) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert len(got) == len(texts)


def test_bpe_odd(odd, empty):
    assert bpe.decode(bpe.encode(odd)).count() == 11 and bpe.encode(empty).count() == 0


def test_packing_ids_and_places(make):
    library = Tokenizer.from_file(vocab.tokenizer_path(packing.VOCABULARY))
    texts = fuzz(300, seed=2) + ["word " * 9000, None]
    got = packing.pack_documents(make(texts)).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in by_doc[i]] == list(range(0, len(ids), 4096))
        for r in by_doc[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(rng.integers(1, [60, 100, 40, 64][seed], 300), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    made = packing.plan(histogram, 100)
    used = {}
    for parts, times in made:
        assert sum(parts) <= 100
        for x in parts:
            used[x] = used.get(x, 0) + times
    assert used == histogram and packing.plan({}, 100) == []


def test_packing_odd(odd, empty):
    assert packing.pack_documents(odd).count() >= 11 and packing.pack_documents(empty).count() == 0


def spelt(word, weights, of_bytes):
    """All spellings, one by one."""
    if not word:
        return 1.0
    total = np.exp(sum(of_bytes[b] for b in word[0].encode())) * spelt(word[1:], weights, of_bytes)
    return total + sum(np.exp(weights[word[:n]]) * spelt(word[n:], weights, of_bytes) for n in range(1, len(word) + 1) if word[:n] in weights)


def test_lattice_sums_all_spellings():
    weights = {"▁": -1.0, "▁a": -2.0, "a": -1.5, "ab": -2.5, "b": -3.0, "abb": -4.0}
    made = lm_scoring.Lattice(weights, [-6.0] * 256)
    for word in ("a", "ab", "abba", "é", "abbabb"):
        assert made.word(word) == pytest.approx(np.log(spelt("▁" + word, weights, [-6.0] * 256)))


def test_lm_scores(make, empty):
    from pyspark.sql import functions as F

    texts = ["A b b", None, "b c", "zz a", "a b"]
    docs = make(texts)
    model = lm_scoring.train(docs, F.col("doc_id") != 3)
    got = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    assert (model.train_tokens, model.types, model.ends) == (11, 4, 4)
    assert (got[3].n_tokens, got[3].n_known) == (3, 2) and got[1].n_tokens == 1
    assert got[3].base_score == pytest.approx(np.log10(1 / 16) + np.log10(3 / 16) + np.log10(5 / 16))
    assert got[1].score == pytest.approx(model.end_score) and got[3].score < got[4].score < 0
    nothing = lm_scoring.score(empty, lm_scoring.train(empty, F.lit(True)))
    assert nothing.count() == 0
