"""N-gram Jaccard join by vertical partitioning, down to connected components.

A text is its set of hashed word shingles; equal sets are one class, which the smallest row number
of its rows names. The shingles' global order is that of their hashes. Pivots cut it into a
quarter, a quarter and a half, and the fragments are gone through one by one, twice:

- *What a class shares at all.* In each fragment shingles that one class alone has are counted per
  class. They can't be common, so a class is dropped as soon as they are more than the threshold
  leaves; later fragments only hold what is left, and most texts are gone after the first one.
- *What a pair shares.* Of a candidate pair the overlap is counted in each fragment by itself and
  summed; the pair is dropped as soon as its sum and what the rest may add is too little.

Candidates come from what the first pass leaves. Its shingles are ordered by rarity (shingles of
one class first), and linked sets share one that is so early in both that enough can follow; the
first that they share is, so any common one that passes makes a pair. Pairs inside a large group
of near copies are not spelt out: each class is first held against one leader only, what is linked
to the same leader is connected, and only pairs across components are looked for afterwards.
All of these are, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm import prefixes
from quarrymill.llm.batches import small
from quarrymill.llm.components import components
from quarrymill.llm.shingles import Shingler, signature
from quarrymill.llm.sizes import sized
from quarrymill.session import materialise, release, table

WORDS, PERCENT = 5, 80
#: Pivots of the order of signed 64-bit hashes: a quarter, a quarter and a half.
PIVOTS = np.array([-(1 << 62), 0], np.int64)
FRAGMENTS = range(len(PIVOTS) + 1)


def _cut(shingles: np.ndarray) -> list[np.ndarray]:
    return np.split(shingles, np.searchsorted(shingles, PIVOTS))


def _sets(words: int):
    """(row, doc_id, body) to (row, doc_id, n, of, name, shingles): set sizes, in all and by
    fragment, the set's name, and its first fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in small(batches):
            sizes, parts, names, first = [], [], [], []
            for body in batch.column(2).to_pylist():
                s = shingles(body)
                cut = _cut(s)
                sizes.append(len(s))
                parts.append([len(x) for x in cut])
                names.append(signature(s))
                first.append(cut[0])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            columns += [pa.array(names, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "of", "name", "shingles"])

    return run


def _later(words: int):
    """Texts to (name, f1, f2): the set's name and its later fragments."""
    names = ["name", *(f"f{k}" for k in FRAGMENTS[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in small(batches):
            found = [(signature(s), *_cut(s)[1:]) for s in map(shingles, batch.column(0).to_pylist())]
            columns = list(zip(*found, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[1:])], names)

    return run


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: two texts are linked when
    ``100 * intersection >= percent * union`` of their sets of shingles of ``words`` words, and a
    component's id is the smallest id in it.

    Shingles are compared by 64-bit hashes, sets of them by 128-bit ones. A text of fewer words is
    one shingle; a null, empty or blank text has none and is a component of its own. Very long
    texts are read whole. Rows that repeat are linked like other equal texts. Rows without an id
    are linked too; null is a component's id only if all of it are null. An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body")
    sets = materialise(
        numbered.mapInArrow(_sets(words), f"row bigint, doc_id {kind}, n bigint, of array<bigint>, name binary, shingles array<bigint>"), "sets"
    )
    sizes = [F.max(F.col("of")[k]).alias(f"of{k}") for k in FRAGMENTS]
    classes = sets.filter("n > 0").groupBy("name").agg(F.min("row").alias("class"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"), *sizes)
    classes = materialise(classes, "classes")

    shared, alive = _shared(rows, sets, classes, words, percent)
    places = materialise(_places(shared, alive, percent), "places")
    stars = materialise(_stars(places, percent), "stars")
    linked = components(_verified(stars, shared, alive, percent))
    pairs = materialise(_across(places, linked, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    new = _verified(pairs, shared, alive, percent)
    roots = components(new.unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    release(*shared, alive, places, stars, pairs)

    members = materialise(classes.join(roots.withColumnRenamed("node", "class"), "class").select("name", "root", "first_id"), "members")
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = members.join(least, "root").select("name", "component_id")
    owners = classes.select("name", "first_id").join(joined, "name", "left").select("name", F.coalesce("component_id", "first_id").alias("component_id"))
    return (
        sets.select("doc_id", "n", "name")
        .join(owners, "name", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _shared(rows: DataFrame, sets: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """The first pass: for each fragment the shingles (``class, shingle``) that several classes
    have, and the classes that may be linked: ``class, n``, and ``met0, met1, ...``, how many of
    their shingles are shared, by fragment."""
    alive, shared, later = classes, [], None
    for k in FRAGMENTS:
        if k == 0:
            pieces = sets.select(F.col("row").alias("class"), "shingles")
        else:
            if later is None:
                later = materialise(_reread(rows, alive, words), "later")
            pieces = later.select("class", F.col(f"f{k}").alias("shingles"))
        pieces = pieces.join(sized(alive.select("class")), "class", "left_semi").select("class", F.explode("shingles").alias("shingle"))
        several = pieces.groupBy("shingle").count().filter("count > 1").select("shingle")
        shared.append(materialise(pieces.join(several, "shingle", "left_semi").select("class", "shingle"), "shared"))
        met = shared[-1].groupBy("class").agg(F.count(F.lit(1)).alias(f"met{k}"))
        now = alive.join(met, "class", "left").fillna(0, [f"met{k}"])
        alone = sum((F.col(f"of{i}") - F.col(f"met{i}") for i in range(k + 1)), F.lit(0))
        now = materialise(now.filter(F.col("n") - alone >= prefixes.share(F.col("n"), percent)), "alive")
        if alive is not classes:
            release(alive)
        alive = now
    release(later)
    return shared, alive


def _reread(rows: DataFrame, alive: DataFrame, words: int) -> DataFrame:
    """The later fragments of classes, one row per class, from one text of each."""
    one = sized(alive.select("first_id").distinct())
    bodies = rows.alias("r").join(one.alias("o"), F.col("r.doc_id").eqNullSafe(F.col("o.first_id")), "left_semi").select("body")
    lists = ", ".join(f"f{k} array<bigint>" for k in FRAGMENTS[1:])
    found = bodies.mapInArrow(_later(words), f"name binary, {lists}").join(alive.select("name", "class"), "name").drop("name")
    return found.dropDuplicates(["class"])  # ids may repeat


def _places(shared: list[DataFrame], alive: DataFrame, percent: int) -> DataFrame:
    """Where classes may meet first: ``token, class, n, i`` for the shared shingles of their
    prefixes; ``i`` is the place in the order by rarity."""
    left = shared[0]
    for more in shared[1:]:
        left = left.unionByName(more)
    left = left.join(alive.select("class", "n"), "class")
    counts = left.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("class")  # a text's own shingles
    placed = left.join(counts, "shingle").withColumn("i", F.row_number().over(own.orderBy("df", "shingle")) - 1)
    placed = placed.withColumn("i", F.col("i") + F.col("n") - F.count(F.lit(1)).over(own))
    return placed.filter(F.col("n") - F.col("i") >= prefixes.share(F.col("n"), percent)).select(F.col("shingle").alias("token"), "class", "n", "i")


def _may_start(n_a: Column, i_a: Column, n_b: Column, i_b: Column, percent: int) -> Column:
    """Length and positional filter: whether two sets whose first common shingle stands at these
    places can reach the threshold."""
    return prefixes.sizes_fit(n_a, n_b, percent) & (F.least(n_a - i_a, n_b - i_b) >= prefixes.needed(n_a, n_b, percent))


def _stars(places: DataFrame, percent: int) -> DataFrame:
    """One pair (``a < b``) for each class that may be linked to a leader: of the leaders of its
    shingles - the class that has the shingle earliest - the one it shares most shingles with."""
    leads = places.groupBy("token").agg(F.min(F.struct("i", "n", "class")).alias("l"))
    led = places.join(leads, "token").filter(F.col("class") != F.col("l.class"))
    led = led.withColumn("starts", _may_start(F.col("n"), F.col("i"), F.col("l.n"), F.col("l.i"), percent))
    found = led.groupBy(F.col("class"), F.col("l.class").alias("lead")).agg(F.count(F.lit(1)).alias("s"), F.max("starts").alias("starts"))
    best = found.filter("starts").groupBy("class").agg(F.max(F.struct("s", "lead")).alias("x"))
    return best.select(F.least("class", "x.lead").alias("a"), F.greatest("class", "x.lead").alias("b")).distinct()


def _across(places: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a < b``) of classes in different components that may be linked."""
    placed = places.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    placed = placed.join(mixed, "token", "left_semi")
    # The smaller set's first common shingle stands earlier still: enough for a set of its own size must follow.
    early = F.col("n") - F.col("i") >= prefixes.needed(F.col("n"), F.col("n"), percent)
    a, b = placed.filter(early).alias("a"), placed.alias("b")
    n_a, n_b = F.col("a.n"), F.col("b.n")
    found = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.root") != F.col("b.root"))
        & ((n_a < n_b) | ((n_a == n_b) & (F.col("a.class") < F.col("b.class"))))
        & _may_start(n_a, F.col("a.i"), n_b, F.col("b.i"), percent),
    )
    return found.select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b")).distinct()


def _verified(pairs: DataFrame, shared: list[DataFrame], alive: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b``) that reach the threshold: overlaps are counted fragment by fragment."""
    for side in "ab":
        known = alive.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(f"met{k}").alias(f"met{k}_{side}") for k in FRAGMENTS))
        pairs = pairs.join(known, side)
    pairs = materialise(pairs.withColumn("o", F.lit(0).cast("bigint")), "pairs")
    for k in FRAGMENTS:
        ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        lists = shared[k].join(ends, "class", "left_semi").groupBy("class").agg(F.collect_list("shingle").alias("shingles"))
        lists = materialise(lists, "lists")
        both = pairs.join(lists.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a", "left")
        both = both.join(lists.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b", "left")
        summed = both.withColumn("o", F.col("o") + F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0))).drop("x", "y")
        rest = [sum((F.col(f"met{j}_{side}") for j in FRAGMENTS[k + 1 :]), F.lit(0)) for side in "ab"]
        kept = summed.filter(F.col("o") + F.least(*rest) >= prefixes.needed(F.col("n_a"), F.col("n_b"), percent))
        now = materialise(kept, "pairs")
        release(pairs, lists)
        pairs = now
    return pairs.select("a", "b")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
