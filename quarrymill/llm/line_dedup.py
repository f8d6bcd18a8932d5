"""Line dedup by an exact set-similarity join.

A line is its set of words. Words are ordered by rarity, and a line's rarest words are its prefix:
so many that two lines that reach the threshold share one. Prefix, positional and length filters
leave candidate pairs, whose Jaccard similarity is verified; a line that matches an earlier one is
removed. Lines of equal sets are one class, of which the first line stands for all. Since one
earlier match is enough, each class is first held against a few leads: the earliest classes that have
one of its minima of mixed hashes, which two sets share as often as they are similar. Only classes
that are not settled by that are held against all earlier ones.

Prefixes meet by word and size: sizes are dealt to steps, and of a pair the larger set comes to its own
step, the smaller one to each step where its partners may be, there with the few words only that are left to
it by the least overlap with a set of that step. So sets of far sizes don't meet at frequent words.

Before a pair becomes a row of the join, it also passes a bitmap filter. Each word of a set flips one
of 128 bits; the bits in which two sets differ are at most the words that only one of them has. A pair
is wanted at the first word that its prefixes share, and is left out at one that follows a shared word
at once, so that near copies don't meet again at each word of their prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import prefixes
from quarrymill.llm.batches import small
from quarrymill.llm.line_words import BUCKETS, buckets, flips, hashes, least, listed, names, word_sets
from quarrymill.llm.sizes import sized
from quarrymill.session import MOST_BROADCAST, materialise, release, table

PERCENT = 80
#: Words are counted in buckets of their hashes, over all documents. The order by rarity has so many buckets by
#: their counts at its end (here all of them); others would come first, by their hashes. Any order gives the
#: same result.
MOST_FREQUENT = BUCKETS
#: Counts of so many buckets are one row of the shuffle.
SECTION = 1 << 10
#: Steps of sizes are dealt to so many fragments, which are joined one after another, so that only a
#: part of all places is in shuffle files at a time.
FRAGMENTS = 2
#: Minima of a class, and so leads that it has at most. They decide how many classes the join is left with,
#: not what it finds.
MINIMA = 3
LEAST = [f"least{k}" for k in range(MINIMA)]
#: Prefix tokens just before a place by which pairs that met already are known.
BEFORE = 2
#: Columns with the bits that a set's words flip.
BITS = ("low", "high")


#: The lower half of 64 bits.
LOW = (1 << 32) - 1


#: Words that a task holds before it counts them: some tens of megabytes.
MOST_HELD = 1 << 21


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body) to (section, counts), of the buckets of words in a task's texts."""
    counts, held, size = np.zeros(BUCKETS, np.int64), [], 0
    for batch in small(batches):
        held.append(buckets(hashes(b"\n".join(batch.column(0).to_pylist()))))
        size += len(held[-1])
        if size > MOST_HELD:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    found = counts.reshape(-1, SECTION)
    kept = np.flatnonzero(found.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([x.tobytes() for x in found[kept]], pa.binary())], ["section", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(section, counts), all rows of a section in one task, to (bucket, n) with counts of two and more."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for section, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[section] = sums.get(section, 0) + np.frombuffer(counts, np.int64)
    for section, counts in sums.items():
        at = np.flatnonzero(counts > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at + section * SECTION, pa.int32()), pa.array(counts[at])], ["bucket", "n"])


def _places(counts: pa.Table) -> np.ndarray:
    """The place of each bucket in the order by rarity."""
    n = np.ones(BUCKETS, np.int64)
    n[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    n[np.argsort(n, kind="stable")[: max(0, BUCKETS - MOST_FREQUENT)]] = 0
    place = np.empty(BUCKETS, np.uint32)
    place[np.argsort(n, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return place


#: What _lines returns of a line.
LINE = {"line": pa.int32(), "n": pa.int64(), "name": pa.binary(), "prefix": pa.list_(pa.int32()), **{c: pa.int64() for c in (*LEAST, *BITS)}}


def _lines(percent: int, order):
    """(doc_id, row, body) to (doc_id, row, line, n, name, prefix, least, bits), lines with words only. Prefixes
    of fewer than so many words that another set could be linked are empty. For each body there is also
    a row of line -1, with the number of all its lines for ``n`` and those that have words for ``prefix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = order.value
        for batch in small(batches):
            bodies = batch.column(2).to_pylist()
            sizes = np.array([body.count(b"\n") + 1 for body in bodies], np.int64)
            line, found = word_sets(b"\n".join(bodies), place)
            starts = np.flatnonzero(np.diff(line, prepend=-1))
            n = np.diff(starts, append=len(line))
            row, number = _rows(sizes, line[starts])
            having = listed(number.astype(np.int32), np.bincount(row, minlength=len(bodies)))
            whole = [pa.array(np.full(len(bodies), -1, np.int32)), pa.array(sizes), pa.nulls(len(bodies), pa.binary()), having]
            whole += [pa.nulls(len(bodies), pa.int64()) for _ in (*LEAST, *BITS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole], ["doc_id", "row", *LINE])
            kept = n + percent * n // -100 + 1
            kept[(kept == 1) & (100 * n < percent * (n + 1))] = 0  # only an equal set is linked
            cut = found[np.arange(len(found)) - np.repeat(starts, n) < np.repeat(kept, n)]
            # Half of a hash does for finding candidates: where halves clash there are more of them.
            short = listed((cut >> np.uint64(32)).astype(np.int32), kept)
            columns = [pa.array(number, pa.int32()), pa.array(n, pa.int64())]
            columns += [names(found, starts) if len(starts) else pa.array([], pa.binary()), short]
            columns += [*least(found, starts, MINIMA), *flips(found, starts)]
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], ["doc_id", "row", *LINE])

    return run


def _rows(sizes: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines of the joined bodies, which have so many lines, which body they are in and their number there."""
    after = np.cumsum(sizes)
    row = np.searchsorted(after, lines, side="right")
    return row, lines - np.concatenate([[0], after])[row]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, lines as (line, class)) to (class, tokens) of these lines."""
    for batch in small(batches):
        classes, texts = [], []
        for body, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = body.split(b"\n")
            for wanted in lines:
                classes.append(wanted["class"])
                # Rows that repeat the id may have other lines.
                texts.append(split[wanted["line"]] if wanted["line"] < len(split) else b"")
        line, found = word_sets(b"\n".join(texts))
        sizes = np.bincount(line, minlength=len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), listed(found, sizes)], ["class", "tokens"])


def line_dedup(docs: DataFrame, percent: int = PERCENT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_lines, removed`` for each row: the lines (from 0, ascending) that go.

    Lines end at a line feed; a line goes when an earlier one - a smaller id, or in the same text a
    smaller number - has words of Jaccard similarity ``percent`` or more, whether or not that line
    stays itself. Lines without words always stay. Words are compared by 63-bit hashes. A null or
    empty text is one empty line; very long texts are read whole. Rows that repeat an id come in the
    order of a hash of their texts; rows that repeat id and text get equal results, as one text. Null
    ids come first. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("text"))  # ids alone may repeat
    rows = docs.select(own.alias("doc_id"), body.alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    seen = rows.select("body").mapInArrow(_counts, "section int, counts binary").repartition("section")
    counts = materialise(seen.mapInArrow(_summed, "bucket int, n bigint"), "words")
    order = spark.sparkContext.broadcast(_places(counts.toArrow()))

    # The row tells rows apart that repeat id and text.
    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "body")
    schema = f"doc_id {kind}, row bigint, line int, n bigint, name binary, prefix array<int>, " + ", ".join(f"{c} bigint" for c in (*LEAST, *BITS))
    lines = materialise(numbered.mapInArrow(_lines(percent, order), schema), "lines")
    found = lines.filter("line >= 0").groupBy("name").agg(F.min(F.struct("doc_id", "line", "row")).alias("pos"))
    # Classes are numbered in the order of their first lines: earlier means smaller, and such
    # numbers compress in shuffles, which names do not.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = "pos.doc_id.id", "pos.doc_id.text", "pos.line", "pos.row"  # one by one: structs are slow to sort
    ordered = found.select("pos").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    classes = materialise(ordered.withColumn("class", F.monotonically_increasing_id()), "classes")
    firsts = classes.select("pos.row", "pos.line", "class")
    whole = materialise(lines.join(firsts, ["row", "line"]).select("class", "n", "prefix", *LEAST, *BITS), "classes-whole")
    texts = materialise(lines.filter("line < 0").select("doc_id", F.col("n").alias("n_lines"), F.col("prefix").alias("having")), "line-numbers")
    release(lines)

    n_a, n_b = F.col("a.n"), F.col("b.n")
    near = (F.col("b.class") < F.col("a.class")) & prefixes.sizes_fit(n_a, n_b, percent) & prefixes.bits_fit("a", "b", n_a, n_b, BITS, percent)

    minima = whole.filter(F.size("prefix") > 0).select("class", "n", *BITS, F.explode(F.array(*LEAST)).alias("least"))
    others = [F.min_by(c, "class").alias(c) for c in ("n", *BITS)]
    leads = minima.groupBy("least").agg(F.min("class").alias("class"), *others, F.count(F.lit(1)).alias("shared")).filter("shared > 1")
    led = minima.alias("a").join(leads.alias("b"), "least").filter(near)
    led = led.select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), n_a.alias("n_a"), n_b.alias("n_b"))
    settled = _verified(materialise(led.distinct(), "led"), rows, classes, percent)

    gone = settled.select(F.col("a").alias("class"), F.lit(True).alias("gone"))
    few = settled.count() <= MOST_BROADCAST
    sets = whole.drop(*LEAST).join(F.broadcast(gone) if few else gone, "class", "left")
    sets = sets.filter(F.size("prefix") > 0).withColumn("open", F.col("gone").isNull()).drop("gone")
    if not few:
        sets = materialise(sets, "classes-open")  # read four times

    n = F.col("n")
    larger = sets.withColumn("size", prefixes.size_step(n))
    steps = F.sequence(prefixes.size_step(n), prefixes.size_step(F.floor(100 * n / F.lit(percent))))
    smaller = sets.withColumn("size", F.explode(steps))
    cut = n - prefixes.needed(n, F.greatest(n, prefixes.least_of_step(F.col("size"))), percent) + 1
    smaller = smaller.withColumn("most", F.greatest(F.lit(0), cut).cast("int")).filter("most > 0")

    # Tens of millions of places are shuffled and sorted, so a row has six numbers of 64 bits, some of them two in one.
    two = lambda high, low: F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(F.lit(LOW)))
    high, low = (lambda x: F.shiftright(x, 32)), (lambda x: x.bitwiseAND(F.lit(LOW)))

    def fragment(of: DataFrame, number: int, tokens, none: int) -> DataFrame:
        """Places of sets: ``sizes`` of the set and of what is left of it from there, ``before`` the tokens before it
        (or a number that is no token)."""
        of = of.filter(F.pmod("size", F.lit(FRAGMENTS)) == number)
        at = of.select("class", "n", *BITS, "open", "size", "prefix", F.posexplode(tokens).alias("i", "token"))
        before = two(*(F.coalesce(F.get("prefix", F.col("i") - 1 - k), F.lit(none)) for k in range(BEFORE)))
        key = F.shiftleft(F.col("token").cast("bigint"), 8) + F.col("size")
        named = F.shiftleft("class", 1) + F.col("open").cast("int")
        return at.select(key.alias("key"), named.alias("class"), two(n, n - F.col("i")).alias("sizes"), *BITS, before.alias("before"))

    def part(number: int) -> DataFrame:
        """Pairs that meet in a fragment: a later class that is not settled, and an earlier one."""
        a = fragment(larger, number, F.col("prefix"), -1).alias("a")
        b = fragment(smaller, number, F.slice("prefix", F.lit(1), F.col("most")), -2).alias("b")
        n_a, n_b, left_a, left_b = (half(F.col(f"{side}.sizes")) for half in (high, low) for side in "ab")
        later = F.col("a.class") > F.col("b.class")
        sides = (n_b < n_a) | ((n_b == n_a) & later)
        unsettled = F.when(later, F.col("a.class")).otherwise(F.col("b.class")).bitwiseAND(F.lit(1)) == 1
        new = [x(F.col("a.before")) != y(F.col("b.before")) for x in (high, low) for y in (high, low)]
        enough = F.least(left_a, left_b) >= prefixes.needed(n_a, n_b, percent)
        fit = prefixes.sizes_fit(n_a, n_b, percent) & prefixes.bits_fit("a", "b", n_a, n_b, BITS, percent)
        met = a.join(b, reduce(and_, new, (F.col("a.key") == F.col("b.key")) & sides & fit & enough & unsettled))
        met = met.select(F.shiftright("a.class", 1).alias("a"), F.shiftright("b.class", 1).alias("b"), n_a.alias("n_a"), n_b.alias("n_b"), later.alias("later"))
        pick = lambda x, y, name: F.when(F.col("later"), F.col(x)).otherwise(F.col(y)).alias(name)
        pair = pick("a", "b", "a"), pick("b", "a", "b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b")
        return materialise(met.select(*pair), "pair-parts")

    parts = [part(k) for k in range(FRAGMENTS)]
    pairs = materialise(reduce(DataFrame.unionByName, parts).distinct(), "pairs")
    release(whole, *parts)
    more = _verified(pairs, rows, classes, percent)

    # Of the lines of a class only the first may stay.
    kinds = [classes.select("pos.doc_id", F.col("pos.line").alias("first"), F.lit(None).cast("int").alias("gone"))]
    kinds += [t.select("doc_id", F.lit(None).cast("int").alias("first"), F.col("line").alias("gone")) for t in (settled, more)]
    by_doc = reduce(DataFrame.unionByName, kinds).groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("first", "gone")))  # a text's own lines
    found = texts.alias("c").join(by_doc.alias("d"), F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")), "left")
    stay = F.array_except("first", "gone")
    removed = F.array_except("having", F.coalesce(stay, F.array().cast("array<int>")))
    return found.select(F.col("c.doc_id.id").alias("doc_id"), "n_lines", F.array_sort(removed).alias("removed"))


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (``a, n_a, b, n_b``), the classes ``a`` of those that are linked, with ``doc_id, line`` of their first lines."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    lines = classes.join(ends, "class").select("pos.doc_id", F.struct("pos.line", "class").alias("x"))
    wanted = sized(lines.groupBy("doc_id").agg(F.collect_list("x").alias("lines")), "wanted", F.size("lines"))  # a text's own lines
    bodies = rows.alias("r").join(wanted.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))).select("r.body", "w.lines")
    written = materialise(bodies.mapInArrow(_tokens, "class bigint, tokens array<bigint>"), "sets")
    sets = written.dropDuplicates(["class"])
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    linked = both.filter(100 * same >= percent * (F.col("n_a") + F.col("n_b") - same))
    places = wanted.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line", F.col("x.class").alias("a"))
    linked = materialise(linked.select("a").distinct().join(places, "a"), "linked")
    release(written)
    return linked


def remove(docs: DataFrame, marks: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that ``marks`` (``doc_id, removed``) names. Rows that repeat an id
    lose a line that goes from any of them; other columns, of any names, pass as they are."""
    lines = F.split(F.col(f"d.{text}"), "\n")
    gone = F.col("m.removed")
    kept = F.filter(lines, lambda line, number: ~F.array_contains(gone, number))
    marks = marks.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"))  # a text's own lines
    joined = docs.alias("d").join(marks.alias("m"), F.col(f"d.{id_col}").eqNullSafe(F.col("m.doc_id")), "left")
    body = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(f"d.{text}"))
    return joined.select(*[body.alias(text) if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = line_dedup(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))
