import collections
import hashlib
import random

from pyspark.sql import functions as F

from quarrymill.llm import components, exact_dedup, line_dedup, ngram_join


def word_set(t):
    return frozenset((t or "").encode().lower().split())


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_texts(n=120, seed=3):
    """Groups of near copies, copies and unrelated texts."""
    rng, found = random.Random(seed), []
    for g in range(6):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 6, 30, 80]))]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            found.append(" ".join(words))
    return found


def components_of(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_exact_dedup(make, odd, empty):
    got = [r for r in exact_dedup.exact_dedup(odd).collect()]
    ones = [r for r in got if r.text_sha256 == hashlib.sha256(b"one").hexdigest()]
    assert {r.keep_id for r in ones} == {4} and {r.group_size for r in ones} == {4} and sum(r.kept for r in ones) == 1
    blanks = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id: r.kept for r in blanks} == {0: False, 1: True} and len(got) == 11
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_tells_clashing_digests_apart(make):
    docs = make(["ab", "cd", "ab", "xyz", "cd", None])
    weak = exact_dedup.exact_dedup(docs, digest=F.length(F.coalesce("text", F.lit(""))))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, weak.select(columns).collect())) == sorted(map(tuple, exact_dedup.exact_dedup(docs).select(columns).collect()))


def test_ngram_join_against_all_pairs(make):
    texts = near_texts()
    want = components_of({i: shingle_set(t) for i, t in enumerate(texts)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(make(texts)).collect()}
    assert got == {i: (len(shingle_set(t)), want[i]) for i, t in enumerate(texts)}
    assert max(collections.Counter(want.values()).values()) > 10


def test_ngram_join_odd(odd, empty):
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_join(odd).collect())
    assert got[0, 0] == got[1, 1] == got[2, 2] == 1 and got[3, 3] == 2 and got[4, 3] == 1 and got[None, 3] == 1
    assert sum(got.values()) == 11 and ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_links_by_texts_without_id(make):
    words = [f"w{i}" for i in range(120)]
    docs = make([(0, " ".join(words[:100])), (None, " ".join(words[8:108])), (2, " ".join(words[16:116])), (None, "other " * 9 + "end"), (5, "quite another text of some words")])
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect())
    assert got == {(0, 0): 1, (None, 0): 1, (2, 0): 1, (None, None): 1, (5, 5): 1}


def test_ngram_join_links_a_large_group_of_near_copies(make):
    rng = random.Random(7)
    base, texts = [f"w{k}" for k in range(150)], []
    for i in range(1200):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):  # of 1 to 3 changed words most are linked to the base, of 6 none
            words[rng.randrange(150)] = f"v{i}x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(make(texts)).collect()}
    hub = sets[1200]
    near = [i for i, s in sets.items() if 100 * len(s & hub) >= 80 * len(s | hub)]
    assert len(near) > 600 and {got[i] for i in near} == {min(near)}
    far = [i for i in sets if i not in set(near)]
    assert len(far) > 200 and {i: got[i] for i in far[:40]} == {
        i: min([i, *(min(near) if got[j] == min(near) else j for j, s in sets.items() if 100 * len(s & sets[i]) >= 80 * len(s | sets[i]))]) for i in far[:40]
    }


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert components.components(chain.filter("a < 0")).count() == 0


def test_line_dedup_against_all_pairs(make):
    lines = near_texts(90, seed=5)
    texts = ["\n".join(lines[i::9] + ["", "same line here now"]) for i in range(9)]
    want, seen = {}, []
    for i, t in enumerate(texts):
        gone = []
        for k, line in enumerate(t.split("\n")):
            s = word_set(line)
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.append(k)
            seen += [s] if s else []
        want[i] = (len(t.split("\n")), gone)
    marks = line_dedup.line_dedup(make(texts))
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in marks.collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.remove(make(texts), marks).collect()}
    assert kept[0] == "\n".join(x for k, x in enumerate(texts[0].split("\n")) if k not in want[0][1])


def test_line_dedup_odd(odd, empty):
    got = {(r.doc_id, r.n_lines, tuple(r.removed)) for r in line_dedup.line_dedup(odd).collect()}
    assert (0, 1, ()) in got and (2, 2, ()) in got and (4, 1, (0,)) in got and (None, 1, ()) in got
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_of_rows_that_repeat_an_id(spark):
    """Rows (1, A), (1, B) and a near copy of each: all of a row's own lines are compared."""
    a, b = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    rows = [(1, f"{a}\nx y z"), (1, f"q\n{b}"), (3, f"{b} more\nnew"), (4, f"{a} more"), (None, "x y z"), (3, f"{b} more\nnew")]
    docs = spark.createDataFrame([(*r, "i", "r", "t") for r in rows], "doc_id bigint, text string, _id string, _removed string, removed string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_lines, r.removed) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(0, 1, []), (1, 2, []), (1, 2, [1]), (3, 2, [0]), (3, 2, [0]), (4, 1, [0])]
    kept = line_dedup.remove(docs, line_dedup.line_dedup(docs))
    assert kept.columns == docs.columns and {r._id for r in kept.collect()} == {"i"}
    assert {r.text for r in kept.collect() if r.doc_id == 3} == {"new"} and [r.text for r in kept.collect() if r.doc_id == 4] == [""]


def test_words_of_lines_are_counted_in_all_documents(spark, monkeypatch):
    from quarrymill.llm import line_dedup

    rows = [(i, f"common w{i} x{i} y{i} z{i}\nseldom{i // 2} a{i} b{i}") for i in range(60)] + [(60, "COMMON w3 x3 y3 z3")]
    docs, kept, keep, got = spark.createDataFrame(rows, "doc_id bigint, text string"), {}, line_dedup.materialise, []
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name="table": kept.setdefault(name, keep(df, name)) if name == "words" else keep(df, name))
    for most in (100_000, 3):
        monkeypatch.setattr(line_dedup, "MOST_FREQUENT", most)
        got.append(sorted((r.doc_id, r.removed) for r in line_dedup.line_dedup(docs).collect()))
    assert got[0] == got[1] and [r for r in got[0] if r[1]] == [(60, [0])]
    assert max(r.n for r in kept["words"].collect()) == 61


def test_near_copies_of_lines_meet_once(spark, monkeypatch):
    """Lines that differ from one text in a few words, most pairs just above or below the threshold."""
    import random

    rng = random.Random(11)
    base, lines = [f"common{k}" for k in range(60)], []
    for i in range(120):
        changed = {k: f"own{i}x{k}" for k in rng.sample(range(60), rng.choice([3, 4, 5, 6]))}
        lines.append(" ".join(changed.get(k, w) for k, w in enumerate(base)))
    sets, keep, rows = [set(x.split()) for x in lines], line_dedup.materialise, {}
    want = [i for i, s in enumerate(sets) if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i])]

    def watched(df, name="table"):
        found = keep(df, name)
        rows[name] = rows.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(line_dedup, "materialise", watched)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in line_dedup.line_dedup(docs).collect() if r.removed) == want and 10 < len(want) < 119
    assert 100 < rows["pairs"] <= rows["pair-parts"] < 1.5 * rows["pairs"]


def test_sets_of_far_sizes_do_not_meet(spark):
    """The smaller set of a pair comes to the larger one's step with enough of its words, and to few others."""
    import math

    from pyspark.sql import functions as F

    from quarrymill.llm import prefixes

    for percent in (80, 95):
        n, step = F.col("n"), F.col("step")
        sets = spark.range(1, 400).select(F.col("id").alias("n"), prefixes.size_step(F.col("id")).alias("own"))
        steps = F.explode(F.sequence("own", prefixes.size_step(F.floor(100 * n / percent)))).alias("step")
        cut = n - prefixes.needed(n, F.greatest(n, prefixes.least_of_step(step)), percent) + 1
        placed = {(r.n, r.step): r.cut for r in sets.select("n", steps).select("n", "step", cut.alias("cut")).collect()}
        own = {r.n: r.own for r in sets.collect()}
        for a in own:
            for b in range(math.ceil(percent * a / 100), a + 1):
                assert placed[b, own[a]] >= b - math.ceil(percent * (a + b) / (100 + percent)) + 1
        assert max(sum(k == n for k, _ in placed) for n in own) == 2 and own[40] < own[100]


def test_line_dedup_reads_each_text_twice_before_pairs(spark, monkeypatch):
    """Words are counted in buckets, and lines are numbered where they are cut: no third pass, no table of names."""
    kept, keep = {}, line_dedup.materialise

    def watched(df, name="table"):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(line_dedup, "materialise", watched)
    docs = spark.createDataFrame([(1, "a b c\n\nd e f"), (2, "d e f\n"), (2, "d e f\n"), (3, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, 3, []), (2, 2, [0]), (2, 2, [0]), (3, 1, [])]
    assert "line-names" not in kept and kept["words"].columns == ["bucket", "n"]
    assert sorted((r.n_lines, r.having) for r in kept["line-numbers"].collect()) == [(1, []), (2, [0]), (2, [0]), (3, [0, 2])]


def test_hashes_of_words_depend_on_their_bytes_alone():
    """Words of all lengths around eight bytes, at any place of a text, also across the pieces it is taken in."""
    from quarrymill.llm import line_words

    rows = ["ab", "abcdefgh", "abcdefghi", "abcdefgh\0", "é" * 8, "é" * 9, *("x" * k for k in (7, 16, 17, 63, 64, 65, 66, 70_000))]
    one = {w: int(line_words.hashes(w.encode())[0]) for w in rows}
    assert len(set(one.values())) == len(rows) and max(one.values()) < 1 << 63
    lines = [[rows[(i * 7 + k) % len(rows)] for k in range(i % 4)] for i in range(200)]
    line, found = line_words.words("\n".join("\t ".join(words).upper().replace("É", "é") for words in lines).encode())
    assert list(found) == [one[w] for words in lines for w in words]
    assert list(line) == [i for i, words in enumerate(lines) for _ in words]
    assert len(line_words.hashes(b" \n")) == 0 and [len(x) for x in line_words.words(b"")] == [0, 0]


def test_all_words_of_lines_are_ordered_by_rarity(spark, monkeypatch):
    """Not a hundred thousand buckets only; and the join of places gets narrow rows."""
    import numpy as np
    import pyarrow as pa

    counts = np.random.default_rng(3).permutation(200_000) + 2
    place = line_dedup._places(pa.table({"bucket": pa.array(np.arange(200_000), pa.int32()), "n": counts}))
    assert sorted(place) == list(range(len(place))) and (np.argsort(place[:200_000]) == np.argsort(counts)).all()
    assert place[:200_000].min() == len(place) - 200_000
    widths, keep = [], line_dedup.materialise

    def watched(df, name="table"):
        if name == "pair-parts":
            plan = df._jdf.queryExecution().optimizedPlan()
            while plan.nodeName() != "Join":
                plan = plan.children().apply(0)
            widths.extend(plan.children().apply(side).output().size() for side in (0, 1))
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "materialise", watched)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.removed) for r in line_dedup.line_dedup(docs).collect()) == [(1, []), (2, []), (3, [0])]
    assert widths == [6] * 4
