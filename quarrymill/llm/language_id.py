"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams are runs of one to three characters of lower-cased words, with their borders. Tasks count
them for each language in arrays of fixed size and the sums become a matrix of log probabilities,
which is broadcast; in a task numpy looks up the rows of all n-grams of many texts at once and adds
them up by text. How many buckets the n-grams are hashed to depends on the number of languages, so
that the matrix stays under a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.batches import small
from quarrymill.llm.shingles import STEP, mixed
from quarrymill.session import short_batches, table

#: Characters of the longest n-gram.
LONGEST = 3
#: Bits of an n-gram's bucket, at most and at least, and entries of the matrix at most (128 MB).
MOST_BITS, LEAST_BITS, MOST_ENTRIES = 17, 10, 1 << 24
#: Characters of texts that are read, and matrix entries that are looked up, at once.
STRIP, LOOKED_UP = 1 << 20, 1 << 22
#: Added to the counts of all n-grams in all languages.
ADDED = 0.5
#: Fixed value: the language of texts without a letter.
UNKNOWN = "und"
BORDER = 32

_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def ngrams(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of all n-grams of ``texts``, a strip of characters at a time.

    A strip ends only between words, except within one that is as long as a strip."""
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    length = 0
    for number, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(is_letter(codes), codes, BORDER)
        start = 0
        while start < len(codes):
            stop = start + STRIP
            if stop < len(codes):
                ends = np.flatnonzero(codes[start:stop] == BORDER)
                stop = start + (int(ends[-1]) + 1 if len(ends) else STRIP)
            part = codes[start:stop]
            held += [part, np.array([BORDER], part.dtype)]
            owner.append(np.full(len(part) + 1, number, np.int32))
            length += len(part)
            start = stop
            if length >= STRIP:
                yield _hashed(np.concatenate(held), np.concatenate(owner), bits)
                held, owner, length = [], [], 0
    if held:
        yield _hashed(np.concatenate(held), np.concatenate(owner), bits)


def _hashed(codes: np.ndarray, owner: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams have borders at their ends only; borders in a row are one."""
    codes, owner = np.append(np.uint32(BORDER), codes), np.append(owner[:1], owner)
    border = codes == BORDER
    keep = np.append(True, ~(border[1:] & border[:-1]))
    codes, owner, border = codes[keep], owner[keep], border[keep]
    single = mixed(codes.astype(np.uint64) + np.uint64(1))
    shift = np.uint64(64 - bits)
    letters = np.flatnonzero(~border)
    of, buckets = [owner[letters]], [single[letters] >> shift]
    at, code = np.arange(len(codes)), single
    for size in range(2, LONGEST + 1):
        at = at[at + size - 1 < len(codes)]
        if size > 2:
            at = at[~border[at + size - 2]]  # the character before the last one
        code = code.copy()
        code[at] = mixed(code[at] * STEP + single[at + size - 1])
        of.append(owner[np.where(border[at], at + 1, at)])
        buckets.append(code[at] >> shift)
    return np.concatenate(of), np.concatenate(buckets).astype(np.int64)


def _counts(place: dict[str, int], bits: int):
    """(lang, text) to (lang, bucket, n), summed over the task; bucket -1 counts texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(place), 1 << bits), np.int64)
        texts = np.zeros(len(place), np.int64)
        for batch in small(batches):
            of = np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int64)
            lettered = np.zeros(len(of), bool)
            for number, bucket in ngrams(batch.column(1).to_pylist(), bits):
                lettered[number] = True
                lang = of[number]
                for k in np.unique(lang):
                    counts[k] += np.bincount(bucket[lang == k], minlength=1 << bits)
            texts += np.bincount(of[lettered], minlength=len(place))
        for k in range(len(place)):
            there = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there) + 1, k)), pa.array(np.append(-1, there)), pa.array(np.append(texts[k], counts[k, there]))], ["lang", "bucket", "n"]
            )

    return run


@dataclass(frozen=True)
class Model:
    """Log probabilities: ``prior`` by language, ``matrix`` by bucket and language."""

    langs: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.matrix).bit_length() - 1


def train(texts: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the rows with a language and a letter.

    Rows without either teach nothing, very long texts are read whole, rows that repeat count
    again, other columns are not read, and an empty table gives a model of no languages. More
    languages than the matrix can hold with `LEAST_BITS` are an error.
    """
    rows = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    most = MOST_ENTRIES >> LEAST_BITS
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most + 1).collect())  # bounded
    if len(langs) > most:
        raise ValueError(f"more than {most} languages")
    bits = min(MOST_BITS, (MOST_ENTRIES // max(1, len(langs))).bit_length() - 1)
    counted = rows.mapInArrow(_counts({v: k for k, v in enumerate(langs)}, bits), "lang bigint, bucket bigint, n bigint")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # MOST_ENTRIES at most
    of, bucket, n = (sums[c].to_numpy() for c in ("lang", "bucket", "n"))
    seen = np.zeros(len(langs), np.int64)
    seen[of[bucket < 0]] = n[bucket < 0]
    matrix = np.full((1 << bits, len(langs)), ADDED)
    matrix[bucket[bucket >= 0], of[bucket >= 0]] += n[bucket >= 0]
    learned = np.flatnonzero(seen)
    matrix = matrix[:, learned]
    matrix = np.log(matrix) - np.log(matrix.sum(axis=0))
    return Model(tuple(langs[k] for k in learned), np.log(seen[learned] / max(1, seen.sum())), np.ascontiguousarray(matrix))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the most probable language of each text and its probability.

    Null texts, texts without a letter, and all texts where nothing was learned get ``und`` and 0;
    of equally probable languages the first by name wins. Very long texts are read whole, rows that
    repeat are judged each by itself, an empty table stays empty, and other columns pass as they
    are; the two names are to be new.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n = max(1, len(own.langs))
        for batch in small(batches):
            texts = batch.column(place).to_pylist()
            total, lettered = np.zeros((len(texts), n)), np.zeros(len(texts), bool)
            for number, bucket in ngrams(texts, own.bits) if own.langs else ():
                order = np.argsort(number, kind="stable")
                number, bucket = number[order], bucket[order]
                step = max(1, LOOKED_UP // n)
                for k in range(0, len(bucket), step):
                    some, at = number[k : k + step], bucket[k : k + step]
                    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                    total[some[first]] += np.add.reduceat(own.matrix[at], first, axis=0)
                lettered[number] = True
            if own.langs:
                total += own.prior
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
            found = [own.langs[b] if there else UNKNOWN for b, there in zip(best.tolist(), lettered.tolist(), strict=True)]
            columns = [pa.array(found, pa.string()), pa.array(np.where(lettered, sure, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, lang_pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row may not be learned from (a null id never is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
