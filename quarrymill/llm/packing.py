"""Best-fit packing by exact-complement hashing.

What is packed only depends on how many pieces there are of each length, so the plan is made on
that histogram (at most ``capacity`` numbers, however many documents there are). Lengths are
taken from the longest down; the gap that a piece leaves is looked up among the sums of one, two
and three available lengths, and a combination that fills it exactly is used as often as its
lengths last. What finds no complement is placed best-fit. Spark then numbers the pieces within
their length and looks each number up in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm import vocab
from quarrymill.llm.batches import small
from quarrymill.llm.memory import Recent
from quarrymill.llm.ranks import gapless
from quarrymill.session import materialise, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Entries of a worker's memories of words and of pieces; longer words are not kept.
REMEMBERED, LONGEST_KEPT = 120_000, 48
#: Rows that are numbered together, about.
ROWS_A_BUCKET, LEAST_BUCKETS = 500_000, 64

#: How the vocabulary splits lower-cased texts of ASCII and Latin-1 letters (fixed value); the
#: library itself splits and lower-cases all others.
LATIN = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
OUTSIDE_LATIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")


class WordIds:
    """Ids of texts by the `tokenizers` library, word by word: the vocabulary's split never
    crosses white space, so equal words have equal ids wherever they stand."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = self.tokenizer.model  # the library's merges without its splitting
        self.symbols = vocab.byte_symbols()
        self.words = Recent(self.word, REMEMBERED, LONGEST_KEPT)
        self.pieces = Recent(self.piece, REMEMBERED, LONGEST_KEPT)

    def word(self, word: bytes) -> bytes:
        """Ids of any word."""
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the split, lower-cased."""
        tokens = self.merges.tokenize("".join(map(self.symbols.__getitem__, piece.encode())))
        return array("I", [t.id for t in tokens]).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if OUTSIDE_LATIN.search(text) or "<|" in text:
            return b"".join(map(self.words.__getitem__, text.encode().split()))
        return b"".join(map(self.pieces.__getitem__, LATIN.findall(text.lower())))


_made: dict[int, WordIds] = {}


def _words(source) -> WordIds:
    data = source.value
    if hash(data) not in _made:
        _made.clear()
        _made[hash(data)] = WordIds(data)
    return _made[hash(data)]


def cut_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Token pieces of each document: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids are those of the `tokenizers` library, then ``END``. Only documents of
    more than ``capacity`` ids are cut, and only their last piece may be shorter.

    A null text counts as empty and has the one id ``END``.
    """
    source = vocab.ship(docs.sparkSession, path or vocab.tokenizer_path(VOCABULARY))
    end = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _words(source)
        for batch in small(batches):
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                ids = made.encode(body) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        made.words.drop_older()
        made.pieces.drop_older()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Complements:
    """Which sums of one, two or three available lengths there are."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.rebuild()

    def rebuild(self) -> None:
        """The lengths only get fewer, so an old index may name too many sums, never too few."""
        there = self.counts > 0
        spectrum = np.fft.rfft(there.astype(float), 2 * len(there))
        self.pairs = np.fft.irfft(spectrum * spectrum)[: len(there)] > 0.5

    def pair(self, total: int) -> tuple[int, ...] | None:
        if total < 2 or not self.pairs[total]:
            return None
        small = np.arange(1, total // 2 + 1)
        fits = (self.counts[small] > 0) & (self.counts[total - small] > 0)
        if total % 2 == 0 and self.counts[total // 2] < 2:
            fits[-1] = False
        at = np.flatnonzero(fits)
        return (total - int(small[at[-1]]), int(small[at[-1]])) if len(at) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths that sum up to the gap: one, else two, else three."""
        if self.counts[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        for again in (False, True):
            first = np.arange(gap - 2, 0, -1)
            first = first[(self.counts[first] > 0) & self.pairs[gap - first]] if gap > 2 else first[:0]
            for a in first[: None if again else 64]:
                self.counts[a] -= 1
                found = self.pair(gap - int(a))
                self.counts[a] += 1
                if found:
                    return (int(a), *found)
            if len(first) <= 64:
                return None
            self.rebuild()
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many such): every piece of the histogram is in one."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    found: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        found.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    index, rest = Complements(counts), np.zeros_like(counts)
    for length in range(capacity - 1, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1
            others = index.fill(capacity - length)
            counts[length] += 1
            if others is None:
                rest[length], counts[length] = counts[length], 0
                break
            lengths = (length, *others)
            times = min(int(counts[x]) // lengths.count(x) for x in lengths)
            for x in lengths:
                counts[x] -= times
            found.append((lengths, times))
    return found + best_fit(rest, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each piece goes to the open sequence with the least room that takes it."""
    by_room: dict[int, list[list]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        by_room.setdefault(room, []).append([lengths, times])
        open_[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(open_[length:])
            if not len(fits):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                break
            room = length + int(fits[0])
            lengths, times = by_room[room].pop()
            # The same sequence stays the best fit while the piece fits it again.
            again = max(1, min(room // length, left)) if times == 1 else 1
            used = 1 if again > 1 else min(times, left)
            if times > used:
                by_room[room].append([lengths, times - used])
            elif not by_room[room]:
                open_[room] = False
            put(room - again * length, lengths + (length,) * again, used)
            left -= used * again
    return [(lengths, times) for entries in by_room.values() for lengths, times in entries]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id, piece, start, length`` and more) with ``sequence_id, offset``.

    Lengths lie in 1..capacity. Rows that repeat are pieces of their own; pieces of equal
    length are interchangeable, ties fall by ``doc_id, piece, start``. An empty table gives an
    empty result. ``pieces`` is read twice, so give a written table.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, first = [], 0
    used = dict.fromkeys(histogram, 0)
    for lengths, times in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], first, offset))
            used[length] += times
            offset += length
        first += times
    made = np.array(sorted(slots), np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((made[:, 0] << 44 | made[:, 1], made))  # bounded by the capacity, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table_ = sent.value
        for batch in batches:
            length, number = (batch.column(n).to_numpy() for n in ("length", "_number"))
            slot = table_[np.searchsorted(keys, length << 44 | number, "right") - 1] if len(length) else table_[:0]
            kept = batch.drop_columns(["_number"])
            columns = [*kept.columns, pa.array(slot[:, 2] + number - slot[:, 1]), pa.array(slot[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "sequence_id", "offset"])

    buckets = max(LEAST_BUCKETS, -(-max(histogram.values(), default=0) // ROWS_A_BUCKET))
    rows = pieces.withColumn("length", F.col("length").cast("bigint"))
    numbered = gapless(rows, ["length"], ["doc_id", "piece"], ["doc_id", "piece", "start"], buckets, "_number")
    numbered = numbered.select(*rows.columns, "_number")
    return numbered.mapInArrow(place, T.StructType([*rows.schema, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset"))]))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Cut, then pack, with the production parameters."""
    return pack(materialise(cut_documents(docs), "pieces"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
