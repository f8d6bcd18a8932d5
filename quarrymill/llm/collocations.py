"""Phrase collocations: counts of all frequent phrases, exact scores, the best of each language.

Words are 64-bit hashes seeded by their language, so one trie serves all languages. Texts are cut
into words once and written as arrays of hashes, in which infrequent words are breaks. Candidates
are Apriori-safe: a phrase is one if its parts may be frequent and if the sum of its hash over all
texts reaches the threshold, neither of which a frequent phrase can fail. Of the parts of the
written texts that have it, only the first one hands its words on. Double-array
tries of a bounded number of candidates each are broadcast; in a task all places advance through
a trie level by level, accepting states are counted, and the tasks' counts are summed by phrase.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.batches import small
from quarrymill.llm.double_array import DoubleArray
from quarrymill.llm.memory import Recent
from quarrymill.llm.shingles import STEP, mixed
from quarrymill.llm.sizes import sized
from quarrymill.operators.numbering import numbered
from quarrymill.session import materialise, release, short_batches, table

#: What ends a piece, and what an unknown language is called.
ENDS, UNKNOWN = b".,;:!?\n\x0b\x0c\r", "und"
#: Most candidates of one trie, a bound of what is broadcast; all are counted, trie after trie.
MOST_IN_TRIE = 1 << 20
#: Filters of words and phrases that may be frequent have some 32 bits for each, as a power of two,
#: but between these (4 kB and 32 MB, at any input size; a full filter lets more candidates pass).
LEAST_BITS, MOST_BITS = 15, 28
#: Words a task remembers; distinct words and phrase places after which it hands on what it counted.
REMEMBERED, MOST_WORDS, MOST_PLACES = 100_000, 200_000, 1 << 20

#: Spreads the numbers of parts over a filter (a fixed odd number).
SPREAD = np.int64(1540483477)

_MARK = bytes.maketrans(ENDS, b"." * len(ENDS))


def pieces(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; ``b"."``, which is in no word, stands between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_MARK).replace(b".", b" . ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), summed as far as memory goes."""
    found: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            counts.pop(b".", None)
            columns = [pa.array([lang] * len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
        found.clear()

    for batch in small(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(lang, Counter()).update(pieces(text))
        if sum(map(len, found.values())) > MOST_WORDS:
            yield from flush()
    yield from flush()


def _kept(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter holds."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hashed(filter_of_words):
    """(lang, text) to the text's array of word hashes; 0 for runs of breaks and other words, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, of_lang = filter_of_words.value, {}
        for batch in small(batches):
            parts = []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in of_lang:
                    if len(of_lang) > 64:  # memories of few languages at once
                        of_lang.clear()
                    seed = _seed(lang)
                    of_lang[lang] = Recent(lambda w, seed=seed: 0 if w == b"." else xxhash.xxh64_intdigest(w, seed), REMEMBERED // 8).__getitem__
                words = pieces(text)
                parts += [np.fromiter(map(of_lang[lang], words), np.uint64, len(words)), np.zeros(1, np.uint64)]
            h = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
            h = np.where(_kept(bits, h), h, 0)
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)[1::2]
            left = (h != 0) | (np.append(0, h[:-1]) != 0)
            left = np.append(0, np.cumsum(left))[np.append(0, ends)], h[left]
            offsets = pa.py_buffer((8 * left[0]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(left[1].tobytes())])], ["words"])

    return run


def _pairs(words: np.ndarray) -> np.ndarray:
    """A number for each place by its word and the next one, of which a phrase's trie depends."""
    h = mixed(words.view(np.uint64))
    return (mixed(h[:-1] * STEP + h[1:]) >> np.uint64(40)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the written texts and the hashes of their texts, some texts at a time."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for start, stop in zip(first, np.append(first[1:], len(part)), strict=True):
            yield int(part[start]), _words(batch.column("words").slice(start, stop - start))


def _words(column: pa.Array) -> np.ndarray:
    """The hashes of all texts of a column; each text ends with 0 or is empty."""
    if not len(column):
        return np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.int64, (ends[-1] - ends[0]) // 8, ends[0])


def _windows(words: np.ndarray, size: int, filters: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows of ``size`` words that may be frequent, and their hashes: both parts of a
    window that are a word shorter have to pass ``filters`` (of windows of two words, three, ...)."""
    here = words != 0
    h = mixed(words.view(np.uint64))
    place = np.flatnonzero(here)
    code = h.copy()
    for k in range(2, size + 1):
        place = place[place + k - 1 < len(words)]
        place = place[here[place + k - 1]]
        if k > 2:  # both parts passed
            place = place[passed[place] & passed[place + 1]]
        code[place] = mixed(code[place] * STEP + h[place + k - 1])
        if k < size:
            place = place[_kept(filters[k - 2].value, code[place].view(np.int64))]
            passed = np.zeros(len(words), bool)
            passed[place] = True
    return place, code[place].view(np.int64)


def _sums(size: int, filters: list):
    """Arrays of words to (code, part, n): how often each window is in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, n = None, [], 0
        for part, words in _parts(batches):
            if part != here or n > MOST_PLACES:
                yield _summed(here, held)
                here, held, n = part, [], 0
            held.append(_windows(words, size, filters)[1])
            n += len(held[-1])
        yield _summed(here, held)
        pa.default_memory_pool().release_unused()

    return run


def _summed(part: int | None, held: list[np.ndarray]) -> pa.RecordBatch:
    found, times = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
    columns = [pa.array(found), pa.array(np.full(len(found), part or 0, np.int32)), pa.array(times.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["code", "part", "n"])


def _with_part(code, part):
    """A number of a phrase's hash and a part, for a filter of both."""
    return code ^ (np.int64(part) * SPREAD)


def _listed(phrases: np.ndarray) -> pa.Array:
    size = phrases.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, size * len(phrases) + 1, size, dtype=np.int32), pa.array(np.ascontiguousarray(phrases).ravel()))


def _candidates(size: int, filters: list, witnesses):
    """Arrays of words to the distinct windows of ``size`` words whose part is to hand them on."""

    def distinct(part: int | None, held: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        code, first = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_index=True)
        phrases = np.concatenate([np.empty((0, size), np.int64), *held])[first]
        pair = _pairs(np.append(phrases[:, :2].ravel(), 0))[::2]
        columns = [_listed(phrases), pa.array(pair), pa.array(code), pa.array(np.full(len(code), part or 0, np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["phrase", "pair", "code", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, codes, n = None, [], [], 0
        for part, words in _parts(batches):
            if part != here or n > MOST_PLACES // size:
                yield distinct(here, held, codes)
                here, held, codes, n = part, [], [], 0
            place, code = _windows(words, size, filters)
            wanted = _kept(witnesses.value, _with_part(code, part))
            held.append(words[place[wanted][:, None] + np.arange(size)])
            codes.append(code[wanted])
            n += len(codes[-1])
        yield distinct(here, held, codes)
        pa.default_memory_pool().release_unused()

    return run


def _counted(trie, k: int, tries: int):
    """Arrays of words to (state, n) of the accepting states that the task met. A place is looked up
    in the trie that its pair of words belongs to, and in no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: DoubleArray = trie.value
        total, held, n = np.zeros(len(tree.check), np.int64), [], 0

        def count() -> None:
            words = np.concatenate([np.empty(0, np.int64), *held])
            here = (words[:-1] != 0) & (words[1:] != 0)
            tree.count(words, total, np.flatnonzero(here & (_pairs(words) % tries == k) if tries > 1 else here))

        for batch in batches:
            held.append(_words(batch.column("words")))
            n += len(held[-1])
            if n > MOST_PLACES:
                count()
                held, n = [], 0
        count()
        states = np.concatenate(tree.accepting)
        states = states[total[states] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(states.astype(np.int32)), pa.array(total[states])], ["state", "n"])
        pa.default_memory_pool().release_unused()

    return run


def _spelled(trie):
    """(state, a) to (phrase, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: DoubleArray = trie.value
        place = np.zeros(len(tree.check), np.int32)
        for states in tree.accepting:
            place[states] = np.arange(len(states))
        size = np.zeros(len(tree.check), np.int8)
        for phrases, states in zip(tree.phrases, tree.accepting, strict=True):
            size[states] = phrases.shape[1]
        for batch in batches:
            state = batch.column("state").to_numpy()
            for phrases in tree.phrases:
                own = np.flatnonzero(size[state] == phrases.shape[1])
                yield pa.RecordBatch.from_arrays([_listed(phrases[place[state[own]]]), batch.column("a").take(pa.array(own))], ["phrase", "a"])

    return run


def _filter(hashes: DataFrame, column: Column):
    """A broadcast filter with the low bits of a column of a written table."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * hashes.count()).bit_length()))
    bit = column.bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        held[(r["k"] - 1) * len(own) : r["k"] * len(own)] = own
    return hashes.sparkSession.sparkContext.broadcast(held)


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``lang, word, hash, n`` of all words, and ``phrase, a`` of all phrases of
    2 to ``longest`` words (arrays of hashes) that stand at least ``least`` times within pieces.

    Null texts count as empty and null languages as ``und``; very long texts are read whole; rows
    that repeat count again; other columns are not read; empty tables give empty ones.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.mapInArrow(_word_counts, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words.select("lang", "word", F.xxhash64("lang", "word").alias("hash"), "n"), "words")
    frequent = _filter(words.filter(F.col("n") >= least), F.col("hash"))
    texts = rows.mapInArrow(_hashed(frequent), "words binary").withColumn("part", F.spark_partition_id())
    texts = materialise(texts, "hashed-texts")
    filters, safe, found = [frequent], [], []
    for size in range(2, longest + 1):
        shorter = filters[1:]
        sums = texts.mapInArrow(_sums(size, shorter), "code bigint, part int, n bigint").groupBy("code")
        sums = sums.agg(F.sum("n").alias("n"), F.min("part").alias("part"))
        safe.append(materialise(sums.filter(F.col("n") >= least).select("code", "part"), "sums"))
        filters.append(_filter(safe[-1], F.col("code")))
        witnesses = _filter(safe[-1], F.col("code").bitwiseXOR(F.col("part").cast("bigint") * int(SPREAD)))
        emitted = texts.mapInArrow(_candidates(size, shorter, witnesses), "phrase array<bigint>, pair bigint, code bigint, part int")
        own = emitted.join(safe[-1], ["code", "part"], "left_semi").select("phrase", "pair").distinct()
        found.append(materialise(own.withColumn("size", F.lit(size)), "candidates"))
        witnesses.unpersist()
    listed = found[0]
    for more in found[1:]:
        listed = listed.unionByName(more)
    tries = max(1, -(-listed.count() // MOST_IN_TRIE))
    counts = []
    for k in range(tries):
        trie = spark.sparkContext.broadcast(_trie(listed.filter(F.col("pair") % tries == k), longest))
        sums = texts.mapInArrow(_counted(trie, k, tries), "state int, n bigint").groupBy("state").agg(F.sum("n").alias("a"))
        counts.append(materialise(sums.filter(F.col("a") >= least).mapInArrow(_spelled(trie), "phrase array<bigint>, a bigint"), "phrases"))
        trie.unpersist()
    for used in filters:
        used.unpersist()
    release(texts, *found, *safe)
    counted = counts[0]
    for more in counts[1:]:
        counted = counted.unionByName(more)
    return words, counted


def _trie(candidates: DataFrame, longest: int) -> DoubleArray:
    """A trie of at most about ``MOST_IN_TRIE`` phrases, built on the driver."""
    rows = candidates.toArrow()
    sizes, phrases = rows["size"].to_numpy(), rows["phrase"].combine_chunks()
    values, starts = phrases.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)
    return DoubleArray([values[starts[sizes == n][:, None] + np.arange(n)] for n in range(2, longest + 1)])


def collocations(
    docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, scale: int = 1_000_000, best: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language.

    ``a, l, r`` are counts of the phrase, of the part before and of the part after its weakest cut,
    ``n`` is the number of the language's words, and ``score`` is ``scale * a * a / (l * r)``, rounded
    down. Phrases inside a longer one that has at least ``percent`` of their count are dropped. See
    `phrase_counts` for odd input; ties go to the phrase that is smaller in byte order.
    """
    words, counted = phrase_counts(docs, least, longest, text, lang)
    count = lambda name: F.col(name).cast("decimal(16,0)")
    single = words.filter(F.col("n") >= least).select(F.array("hash").alias("part"), F.col("n").alias("of"))
    known = materialise(single.unionByName(counted.select(F.col("phrase").alias("part"), F.col("a").alias("of"))), "parts")
    cuts = counted.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase")).alias("right"))
    cuts = cuts.join(known.select(F.col("part").alias("left"), F.col("of").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("part").alias("right"), F.col("of").alias("r")), "right")
    cuts = cuts.withColumns({"top": count("a") * count("a") * F.lit(scale).cast("decimal(7,0)"), "under": count("l") * count("r")})
    weakest = cuts.groupBy("phrase").agg(F.min(F.struct(F.expr("top div under").alias("score"), "k", "a", "l", "r")).alias("w")).select("phrase", "w.*")
    inner = counted.filter(F.size("phrase") > 2).select("a", F.explode(_inside(F.col("phrase"))).alias("phrase"))
    longer = inner.groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, "phrase", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    spelt = words.filter(F.col("n") >= least).select("hash", "lang", F.col("word").cast("string").alias("word"))
    for at in range(longest):
        of = spelt.select(F.col("hash").alias("_h"), F.col("word").alias(f"w{at}"), *(["lang"] if not at else []))
        kept = kept.withColumn("_h", F.get("phrase", F.lit(at))).join(of, "_h", "inner" if not at else "left").drop("_h")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"w{at}" for at in range(longest)]))
    ordered = kept.select("lang", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"), "phrase", "a", "l", "r", "score")
    ranked = numbered(ordered, ["lang", "_s", "_a", "phrase"], "place")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    firsts = ranked.groupBy("lang").agg(F.min("place").alias("first")).join(totals, "lang")
    ranked = ranked.join(sized(firsts, "languages"), "lang").withColumn("rank", F.col("place") - F.col("first") + 1)
    return ranked.filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inside(phrase: Column) -> Column:
    """The contiguous parts of two words and more that are shorter than the phrase."""
    sizes = F.sequence(F.lit(2), F.size(phrase) - 1)
    starts = lambda n: F.sequence(F.lit(1), F.size(phrase) - n + 1)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.slice(phrase, i, n)))))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return collocations(table(spark, sf_dir, "documents"))


_WORD = r"regexp_extract_all(piece, '[^\x20\x09]+')"
ORACLE = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, {_WORD} AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
    SELECT lang, 1 AS size, w[i] AS phrase FROM runs
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM runs WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 2 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
    SELECT c.lang, c.size, c.phrase, c.a, c.w, k, array_to_string(c.w[1:k], ' ') AS first_part, array_to_string(c.w[k + 1:], ' ') AS rest
    FROM c, (VALUES (1), (2)) cut(k) WHERE k < c.size),
scored AS (
    SELECT cuts.lang, cuts.size, cuts.phrase, cuts.a, cuts.w, k, x.a AS l, y.a AS r,
           (cuts.a::HUGEINT * cuts.a * 1000000 // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM weakest t LEFT JOIN longer USING (lang, phrase) JOIN totals ON totals.lang = t.lang
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000"""
