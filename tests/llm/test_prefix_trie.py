import collections
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import prefix_trie
from quarrymill.llm.parentheses import BalancedParentheses

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, name string, path string, key string, size int"


def brute(convs):
    """Nodes of {conv_id: [(role, text), ...]}, by the definition."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        turns = tuple(convs[c])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1], r[2] is not None, *r[2:]))


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, *r[2:]))


def frame(spark, convs):
    rows = [(c, t, role, text, "n", "p", "k", 1) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rebuilt(own):
    """The contract's rule, on {conv_id: turns}."""
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return found


def random_turns(rng):
    """Conversations that share a lot: copies, prefixes of others, long ones, a hot first turn."""
    first = [[("user", "hi é"), ("assistant", "yo")], [("user", "hi é")], [("system", ""), ("user", "x" * 300)]]
    convs = {}
    for c in rng.permutation(400)[:330].tolist():
        turns = list(first[int(rng.integers(3)) if rng.random() < 0.5 else 0])
        turns += [(["user", "assistant"][int(rng.integers(2))], "ab"[int(rng.integers(2))] * int(rng.integers(3))) for _ in range(int(rng.integers(0, 7)))]
        convs[c] = turns
    convs[1001] = convs[1002] = [("user", f"t{k}") for k in range(500)]
    convs[1003] = convs[1001][:300] + [("user", "other")]
    return convs


def test_equals_brute_force_in_any_number_of_shards(spark, monkeypatch):
    """Spines over many shards, also where a shard holds a single path."""
    own = random_turns(np.random.default_rng(7))
    for rows_in_shard in (prefix_trie.SHARD_TURNS, 250, 20):
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", rows_in_shard)
        turns = prefix_trie.turns_of(frame(spark, own))
        assert nodes(prefix_trie.prefix_trie(turns)) == order(brute(own))
    got = nodes(prefix_trie.prefix_trie(prefix_trie.rebuilt(turns)))
    assert got == order(brute(rebuilt(own)))


def test_odd_conversations(spark):
    rows = [(1, 2, "u", "b"), (1, None, None, "a"), (1, 1, "u", None), (2, None, "", "a"), (2, 1, "u", ""), (None, 0, "u", "lost"), (-7, 0, "u", "a"), (7, 5, "u", "b"), (7, 5, "u", "b"), (9, 0, "ab", "c"), (10, 0, "a", "bc")]
    df = spark.createDataFrame([(*r, "n", "p", "k", 1) for r in rows], SCHEMA)
    convs = {1: [("", "a"), ("u", ""), ("u", "b")], 2: [("", "a"), ("u", "")], -7: [("u", "a")], 7: [("u", "b"), ("u", "b")], 9: [("ab", "c")], 10: [("a", "bc")]}
    turns = prefix_trie.turns_of(df)
    assert nodes(prefix_trie.prefix_trie(turns)) == order(brute(convs))
    none = turns.select("conv_id", F.slice("turns", 1, 0).alias("turns"))
    assert nodes(prefix_trie.prefix_trie(none)) == order(brute(dict.fromkeys(convs, [])))
    assert prefix_trie.prefix_trie(prefix_trie.turns_of(df.limit(0))).count() == 0


def test_many_ends_of_one_node(spark):
    """Ids of copies are hashed in numerical order, groups and all."""
    ids = [*range(-300, 900, 3), 10**12, 10**12 + 1, -(10**12)]
    turns = prefix_trie.turns_of(frame(spark, {c: [("u", "same")] for c in ids}))
    root, leaf = sorted(prefix_trie.prefix_trie(turns).collect(), key=lambda r: r.depth)
    assert leaf.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() and root.ends_sha256 == prefix_trie.NO_IDS
    assert (leaf.n_convs, leaf.conv_id, leaf.saved_tokens) == (len(ids), -(10**12), 4 * (len(ids) - 1))


def test_find_close_against_a_stack():
    rng = np.random.default_rng(8)
    for n in (1, 3, 40, 700, 5000):
        for up in (0.5, 0.9):
            bits, height, left = [1], 1, n - 1
            while left or height > 1:
                if left and (height == 1 or rng.random() < up):
                    bits, height, left = [*bits, 1], height + 1, left - 1
                else:
                    bits, height = [*bits, 0], height - 1
            bits = np.array([*bits, 0], np.int8)
            stack, close = [], {}
            for at, bit in enumerate(bits):
                if bit:
                    stack.append(at)
                else:
                    close[stack.pop()] = at
            tree = BalancedParentheses(bits)
            found = tree.find_close(tree.opens())
            assert found.tolist() == [close[p] for p in tree.opens().tolist()]
            leaves = [int(sum(bits[p] == 1 and bits[p + 1] == 0 for p in range(a, b))) for a, b in zip(tree.opens()[:50], found[:50])]
            assert tree.leaves(tree.opens(), found)[:50].tolist() == leaves
