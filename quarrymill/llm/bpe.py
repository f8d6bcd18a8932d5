"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

The encoding of every prefix of a piece ends in exactly one token. For each end position an
automaton over the vocabulary reports all tokens that are suffixes of the prefix; the one that
the merges could have left next to the last token of the shorter prefix is stored. Following
the stored tokens back from the end gives the ids in time linear in the text, however long a
piece is. Two tokens can stand next to each other when replaying the merges on their shared
border never joins them; that is read off the two merge trees and remembered.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm import vocab
from quarrymill.llm.batches import small
from quarrymill.llm.memory import Recent
from quarrymill.session import table

VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's memories of pieces and of token pairs.
REMEMBERED = 250_000
#: Longer pieces are encoded without being remembered.
LONGEST_KEPT = 64
#: The split of byte-level BPE (fixed value, as the vocabulary was made with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60


class PrefixEncoder:
    """Encodes and decodes with one byte-level BPE vocabulary (the JSON of `tokenizers`)."""

    def __init__(self, source: bytes):
        import ahocorasick

        spec = json.loads(source)
        byte_of = {c: b for b, c in vocab.byte_symbols().items()}
        to_bytes = lambda token: bytes(byte_of[c] for c in token)
        ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {i: -1 for i in self.bytes_of}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[left + right]
            if whole in self.halves:
                raise ValueError(f"token {whole} comes from two merges")
            self.halves[whole] = pair = ids[left], ids[right]
            self.merge[pair] = self.born[whole] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.ids = ids
        self.whole: dict[int, bool] = {}
        self.meeting: dict[int, int] = {}
        self.borders: tuple[dict, dict] = {}, {}
        self.pieces = Recent(self.packed, REMEMBERED, LONGEST_KEPT)

    def border(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The nodes of the token's merge tree on one side from the byte up, and the rank of
        the merge that ends each of them."""
        known = self.borders[side].get(token)
        if known is None:
            nodes = [token]
            while nodes[-1] in self.halves:
                nodes.append(self.halves[nodes[-1]][side])
            nodes.reverse()
            known = self.borders[side][token] = nodes, [*(self.born[n] for n in nodes[1:]), NEVER]
        return known

    def meet(self, a: int, b: int) -> int:
        """What the merges do at the border of neighbours a and b: 0 nothing, 1 join the two
        as wholes, 2 join parts of them earlier."""
        (left, left_ends), (right, right_ends) = self.border(a, 1), self.border(b, 0)
        merge, i, j = self.merge.get, 0, 0
        while True:
            across, up_left, up_right = merge((left[i], right[j]), NEVER), left_ends[i], right_ends[j]
            # Of equal merges the leftmost goes first: a's own, then the border's, then b's.
            if across < up_left and across <= up_right:
                found = 1 if up_left == up_right == NEVER else 2
                break
            if up_left == up_right == NEVER:
                found = 0
                break
            if up_left <= up_right:
                i += 1
            else:
                j += 1
        if len(self.meeting) >= 2 * REMEMBERED:
            self.meeting.clear()
        self.meeting[a << 32 | b] = found
        return found

    def stands_alone(self, token: int) -> bool:
        """Whether the merges make this one token of its own bytes."""
        if token not in self.whole:
            halves = self.halves.get(token)
            self.whole[token] = halves is None or (
                all(map(self.stands_alone, halves)) and self.meet(*halves) == 1
            )
        return self.whole[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of the split."""
        token = self.ids.get(piece)
        if token is not None and self.stands_alone(token):
            return [token]
        size = len(piece)
        last, starts = [-1] * size, [0] * size
        met, done = self.meeting.get, -1
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue  # the prefix has its one token
            before = end - length
            if before >= 0:
                ahead = last[before]
                if ahead < 0:
                    continue
                across = met(ahead << 32 | token)
                if self.meet(ahead, token) if across is None else across:
                    continue
            if self.whole.get(token) or self.stands_alone(token):
                last[end], starts[end], done = token, before, end
        found, at = [], len(piece) - 1
        while at >= 0:
            found.append(last[at])
            at = starts[at]
        return found[::-1]

    def packed(self, piece: str) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        return array("I", self.encode_piece(piece.encode())).tobytes()

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        split = LATIN if not OUTSIDE_LATIN.search(text) else ANY
        return b"".join(map(self.pieces.__getitem__, split.findall(text)))

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        found, at = [], 0
        for m in self.special_at.finditer(text):
            found += [self.plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*found, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; special tokens are written out, broken UTF-8 is replaced."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


#: The split for any text, and a faster one for texts of ASCII and Latin-1 letters alone.
ANY = regex.compile(PATTERN)
OUTSIDE_LATIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
LATIN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)
_made: dict[int, PrefixEncoder] = {}


def encoder(source) -> PrefixEncoder:
    """The worker's encoder for a broadcast vocabulary."""
    data = source.value
    key = hash(data)
    if key not in _made:
        _made.clear()
        _made[key] = PrefixEncoder(data)
    return _made[key]


def encode(
    docs: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", decoded: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row: ``ids`` holds the token ids as little-endian
    unsigned 32-bit integers (`ids_array` unpacks them). With ``decoded`` the ids are decoded
    in the same pass.

    Equal to the `tokenizers` library without added special tokens; special tokens that a text
    spells out become their ids, as there. A null or empty text has no ids. Rows that repeat
    are encoded each by itself, texts may be of any length, an empty table gives an empty
    result and other columns are not read.
    """
    source = vocab.ship(docs.sparkSession, path or vocab.tokenizer_path(VOCABULARY))
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(source)
        for batch in small(batches):
            ids = [made.encode(t) for t in batch.column(1).to_pylist()]
            found = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                found.append(pa.array([made.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(found, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of ``ids`` (null ids: null)."""
    source = vocab.ship(encoded.sparkSession, path or vocab.tokenizer_path(VOCABULARY))
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(source)
        for batch in small(batches):
            texts = [None if x is None else made.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    rows = encoded.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("decoded", T.StringType())]))


def ids_array(ids):
    """Packed ids as a column of type array<bigint>."""
    hexed = F.hex(ids)
    starts = F.sequence(F.lit(1), F.length(hexed) - 7, F.lit(8))
    flip = lambda p: F.concat(*[F.substr(hexed, p + k, F.lit(2)) for k in (6, 4, 2, 0)])
    return F.when(F.length(hexed) >= 8, F.transform(starts, lambda p: F.conv(flip(p), 16, 10).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = encode(table(spark, sf_dir, "documents"), decoded=True)
    return texts.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
