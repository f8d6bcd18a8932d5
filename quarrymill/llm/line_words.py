"""Words of lines as hashes, whole arrays at a time, for use inside tasks.

A word's hash mixes its length with its bytes, eight at a time; 63 bits of it count. Words over
``LONGEST`` bytes are hashed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from quarrymill.llm.shingles import MIX_A, MIX_B, STEP, mixed

LONGEST = 64
#: Bytes taken at a time, cut at white space.
PIECE = 1 << 16
SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Bytes that stand in words.
SOLID = bytes(c not in b"\t\n\v\f\r " for c in range(256))
TOP = np.uint64(1 << 63)
#: Hashes are dealt to so many buckets by their first bits; the bits that are left.
BUCKETS, REST = 1 << 20, np.uint64(43)
#: What is left of eight bytes in a word of which so many are theirs.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a text, in order, its line (from 0; line feeds end lines) and its hash: A-Z
    lower-cased, split at ASCII white space."""
    starts, found = [], []
    for first, hashes in _pieces(text):
        starts.append(first)
        found.append(hashes)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    before = np.searchsorted(np.concatenate(starts), ends)  # words before each line feed
    found = np.concatenate(found)
    return np.repeat(np.arange(len(ends) + 1), np.diff(before, prepend=0, append=len(found))), found


def hashes(text: bytes) -> np.ndarray:
    """The hashes that `words` returns."""
    return np.concatenate([np.empty(0, np.uint64), *(found for _, found in _pieces(text))])


def _pieces(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where words of a piece of the text start in it, and their hashes."""
    text = text.lower()
    solids, padded = text.translate(SOLID), text + bytes(8)
    eights = np.ndarray(len(text), "<u8", padded, strides=(1,))  # from each byte on
    start = 0
    while start < len(text):
        stop = start + PIECE - 1
        if stop >= len(text):
            stop = len(text)
        elif at := SPACE.search(text, stop):
            stop = at.end()
        else:
            stop = len(text)
        solid = np.zeros(stop - start + 2, bool)
        solid[1:-1] = np.frombuffer(solids, bool, stop - start, start)
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        first, length = edges[::2] + start, edges[1::2] - edges[::2]
        found = mixed(length.view(np.uint64) * STEP + (eights[first] & MASKS[np.minimum(length, 8)]))
        more = np.flatnonzero((length > 8) & (length <= LONGEST))
        done = 8
        while len(more):
            rest = MASKS[np.minimum(length[more] - done, 8)]
            found[more] = mixed(found[more] * STEP + (eights[first[more] + done] & rest))
            done += 8
            more = more[length[more] > done]
        found &= TOP - np.uint64(1)
        for i in np.flatnonzero(length > LONGEST):
            found[i] = xxhash.xxh64_intdigest(text[first[i] : first[i] + length[i]]) >> 1
        yield first, found
        start = stop


def buckets(found: np.ndarray) -> np.ndarray:
    """The buckets of hashes."""
    return (found >> REST).astype(np.int64)


def word_sets(text: bytes, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`words`, distinct within a line and sorted by line, then by hash. With a ``place`` for each bucket
    it stands in the hashes in the bucket's stead, so that they are in the order of places."""
    line, found = words(text)
    if place is not None:
        found = place[buckets(found)].astype(np.uint64) << REST | found & np.uint64((1 << int(REST)) - 1)
    order = np.argsort(found)  # equal hashes of a line are one, so that no order among them counts
    line, found = line[order], found[order]
    # Sorting by 16 bits at a time is sorting by counting.
    order = np.argsort(line.astype(np.uint16), kind="stable")
    if len(line) and line.max() >= 1 << 16:
        order = order[np.argsort(line[order] >> 16, kind="stable")]
    line, found = line[order], found[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (found[1:] != found[:-1])
    return line[new], found[new]


def names(found: np.ndarray, starts: np.ndarray) -> pa.Array:
    """128 bits that name each set (of sets one after another): two sums of differently mixed hashes."""
    halves = [np.add.reduceat(mixed(found * STEP + np.uint64(k)), starts) for k in (1, 2)]
    packed = pa.py_buffer(np.stack(halves, axis=1).tobytes())
    return pa.Array.from_buffers(pa.binary(16), len(starts), [None, packed]).cast(pa.binary())


def least(found: np.ndarray, starts: np.ndarray, k: int) -> list[pa.Array]:
    """For each set the least of its hashes (mixed ones), times each of ``k`` odd numbers."""
    mixes = [found * odd for odd in (STEP, MIX_A, MIX_B)[:k]]
    lows = [np.minimum.reduceat(m, starts) if len(starts) else m[:0] for m in mixes]
    # The same number by another factor is another key.
    return [pa.array((low - low % np.uint64(k) + np.uint64(i)).view(np.int64)) for i, low in enumerate(lows)]


def flips(found: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """128 bits, in two halves, of which each word of a set flips one."""
    one = np.uint64(1) << (found & np.uint64(63))
    high = one * (found >> np.uint64(6) & np.uint64(1))
    halves = [np.bitwise_xor.reduceat(x, starts).view(np.int64) if len(starts) else [] for x in (one ^ high, high)]
    return [pa.array(half, pa.int64()) for half in halves]


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of these sizes of signed numbers, 64 or 32 bits wide."""
    values = values.view(np.int64) if values.itemsize == 8 else values
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
