"""Language-model scores: marginal likelihood over a subword lattice.

A text is its lower-cased words and an end. A word is the marker of a word's beginning followed
by its characters; all ways to spell it in pieces of a public vocabulary count, each with the
product of its pieces' probabilities, summed in log space by the forward recursion. The pieces'
probabilities come from how often they occur in the training rows, so the whole is a proper
distribution over texts: an end, or a next piece, is drawn again and again.

Words are counted by Spark over the whole corpus, and each distinct word is scored once. The most
frequent words, at most ``HEAD`` however large the corpus is, are broadcast for the pass over the
texts; what is left of a text, its rare words, is joined with the table of words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import vocab
from quarrymill.llm.batches import small
from quarrymill.session import materialise, table

VOCABULARY = "piece_bpe_32k.model"
BEGIN = "▁"
HEAD = 250_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000


@dataclass(frozen=True)
class Model:
    """``words``: (word binary, c, everywhere, base, score) of all words of the corpus."""

    words: DataFrame
    train_tokens: int
    types: int
    ends: int
    end_score: float


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learn, body) to (word, c, everywhere): occurrences in training rows and in all rows."""
    learnt, other = Counter(), Counter()

    def flush():
        words = list(learnt.keys() | other.keys())
        c = np.fromiter((learnt[w] for w in words), np.int64, len(words))
        rest = np.fromiter((other[w] for w in words), np.int64, len(words))
        learnt.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(c + rest)], ["word", "c", "everywhere"])

    for batch in small(batches):
        for learn, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (learnt if learn else other).update(words_of(body))
            if len(learnt) + len(other) > COUNTED:
                yield flush()
    yield flush()


def _pieces(source):
    """(word, c) to (piece, n): the vocabulary's own segmentation of each word, c times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_proto=source.value)
        found = np.zeros(made.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            ids = made.encode(words, num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            flat = np.fromiter((i for x in ids for i in x), np.int64, len(times))
            np.add.at(found, flat, times)
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], ["piece", "n"])

    return run


class Lattice:
    """Natural-log likelihood of words. ``weights``: log probability by piece (a string);
    ``of_bytes``: by byte, for spelling a character out."""

    def __init__(self, weights: dict[str, float], of_bytes: list[float]):
        self.weights, self.of_bytes = weights, of_bytes
        self.longest = max(map(len, weights), default=1)
        self.characters: dict[str, float] = {}

    def character(self, c: str) -> float:
        """A single character: as a piece or byte by byte."""
        known = self.characters.get(c)
        if known is None:
            spelt = sum(self.of_bytes[b] for b in c.encode())
            piece = self.weights.get(c)
            known = spelt if piece is None else float(np.logaddexp(spelt, piece))
            self.characters[c] = known
        return known

    def word(self, word: str) -> float:
        """Forward recursion: ``ahead[i]`` is the log of the summed weight of all spellings of
        the first i characters."""
        text = BEGIN + word
        get, longest, exp, log = self.weights.get, self.longest, math.exp, math.log
        ahead = [0.0]
        for end in range(1, len(text) + 1):
            terms = [ahead[end - 1] + self.character(text[end - 1])]
            for start in range(max(0, end - longest), end - 1):
                weight = get(text[start:end])
                if weight is not None:
                    terms.append(ahead[start] + weight)
            top = max(terms)
            ahead.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return ahead[-1]


def lattice(source: bytes, counts: dict[int, int], ends: int) -> tuple[Lattice, float]:
    """The lattice of a vocabulary and the log probability of an end, from piece counts with
    one added to each. Pieces that no lower-cased word can hold take no probability."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=source)
    usable, as_bytes = {}, {}
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        if made.is_byte(i):
            as_bytes[int(piece[1:-1], 16)] = i
        elif not (made.is_control(i) or made.is_unknown(i) or made.is_unused(i)):
            if piece.encode() == piece.encode().lower() and BEGIN not in piece[1:]:
                usable[piece] = i
    total = sum(counts.get(i, 0) for i in (*usable.values(), *as_bytes.values())) + ends
    total += len(usable) + len(as_bytes) + 1
    of = lambda i: math.log((counts.get(i, 0) + 1) / total)
    return Lattice({p: of(i) for p, i in usable.items()}, [of(as_bytes[b]) for b in range(256)]), math.log((ends + 1) / total)


def train(docs: DataFrame, learn: Column, path: str | None = None, text: str = "text") -> Model:
    """A model of the rows of ``docs`` where ``learn`` is true (null counts as true).

    Null texts count as empty: just an end. All words of ``docs`` get a score, those that
    training rows lack too.
    """
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(True))
    rows = docs.select(learn.alias("learn"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    counted = materialise(
        rows.mapInArrow(_count, "word binary, c bigint, everywhere bigint")
        .groupBy("word")
        .agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere")),
        "words",
    )
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.agg(F.count_if("learn").alias("n")).first()["n"]
    tokens, types = sums["n"] + ends, sums["v"] + (ends > 0)
    source = vocab.ship(spark, path or vocab.tokenizer_path(VOCABULARY))
    pieces = counted.filter("c > 0").select("word", "c").mapInArrow(_pieces(source), "piece bigint, n bigint")
    counts = {r["piece"]: r["n"] for r in pieces.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # one per piece at most
    made, end = lattice(source.value, counts, ends)
    sent = spark.sparkContext.broadcast(made)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = sent.value.word
        for batch in batches:
            found = [of_word(w.decode()) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    scored = counted.withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(tokens + types + 1))))
    words = scored.mapInArrow(score, "word binary, c bigint, everywhere bigint, base double, score double")
    return Model(materialise(words, "scored"), tokens, types, ends, end / math.log(10))


def head_of(words: DataFrame, most: int = HEAD) -> DataFrame:
    """The words that occur most, at most ``most``: those from a power of two on."""
    power = F.floor(F.log2(F.col("everywhere"))).cast("int")
    left, least = most, 1
    for r in sorted(words.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["p"]):
        least = 1 << r["p"]
        if r["n"] > left:
            least *= 2
            break
        left -= r["n"]
    return words.filter(F.col("everywhere") >= least)


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for each row, by a model trained on a
    table that holds these rows.

    ``score`` is the log10 probability of the text, ``base_score`` that of a word unigram with
    one added. A null or empty text is just an end. Rows that repeat are scored each by itself.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    head = head_of(model.words).select("word", "c", "base", "score").toPandas()  # at most HEAD rows
    columns = [head[n].to_numpy(float) for n in ("c", "base", "score")]
    sent = spark.sparkContext.broadcast((list(map(bytes, head["word"])), *(np.append(x, 0.0) for x in columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, base, full = sent.value
        known = Head(zip(words, range(len(words)), strict=True))
        known.other = len(words)
        get = known.__getitem__
        for batch in small(batches):
            sums, rare, times = [], [], []
            for body in batch.column(2).to_pylist():
                found = words_of(body)
                at = np.fromiter(map(get, found), np.int64, len(found))
                left = Counter([found[i] for i in np.flatnonzero(at == known.other)])
                sums.append((len(found), int((c[at] > 0).sum()), float(base[at].sum()), float(full[at].sum())))
                rare.append(list(left.keys()))
                times.append(list(left.values()))
            n, k, b, f = zip(*sums, strict=True) if sums else ((), (), (), ())
            made = [pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(f, pa.float64())]
            made += [pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    names = ["row", "doc_id", "words", "n_known", "base", "full", "rare", "times"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = materialise(
        rows.mapInArrow(
            run,
            f"row bigint, doc_id {kind}, words bigint, n_known bigint, base double, full double, rare array<binary>, times array<bigint>",
        ),
        "heads",
    )
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    lookup = model.words.select(F.col("word").alias("rare"), "c", F.col("base").alias("b"), F.col("score").alias("s"))
    tail = (
        rare.join(lookup, "rare")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("times") * F.col("b")).alias("tail_base"),
            F.sum(F.col("times") * F.col("s")).alias("tail_full"),
        )
    )
    plus = lambda name: F.coalesce(F.col(name), F.lit(0))
    base_end = math.log10((model.ends + 1) / (model.train_tokens + model.types + 1))
    return first.join(tail, "row", "left").select(
        "doc_id",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("n_known") + plus("tail_known") + int(model.ends > 0)).alias("n_known"),
        (F.col("base") + plus("tail_base") + base_end).alias("base_score"),
        (F.col("full") + plus("tail_full") + model.end_score).alias("score"),
    )


class Head(dict):
    """Positions of the broadcast words; ``other`` for the rest."""

    other = 0

    def __missing__(self, key):
        return self.other


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs, ~held_out)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
