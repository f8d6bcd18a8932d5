"""Tries of phrases as double arrays, advanced for all places of a text at once."""

from __future__ import annotations

import numpy as np

#: A word's symbol is followed digit by digit, each of so many bits, so that no node is wide.
DIGIT_BITS = 7
DIGITS = 1 << DIGIT_BITS
#: Nodes of more children get a stretch of `DIGITS` slots of their own.
FEW = 20


class DoubleArray:
    """Phrases over whole-number words (64-bit hashes) as ``base`` and ``check``.

    Words get symbols 1, 2, ... by frequency, each of a few digits; the child of state s by digit d is
    ``base[s] + d``, and exists if ``check`` has s there. The state of a first word is its symbol.
    Wide nodes get stretches of their own, whose gaps others fill: nodes of a few children, placed
    many at once by chance, and at last nodes of one.
    """

    def __init__(self, phrases: list[np.ndarray]):
        """``phrases``: arrays of rows, one array for each number of words; rows are distinct."""
        flat = [p.ravel() for p in phrases if p.size]
        words, times = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.empty(0, np.int64), np.empty(0, int))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(1, len(words) + 1)
        self.words, self.symbols = words, rank.astype(np.int32)
        size = len(words) + 1
        codes = [self.symbols[np.searchsorted(words, p)].astype(np.int64) for p in phrases]
        self.depth = max([c.shape[1] for c in codes if c.size], default=0)
        starts = np.unique(np.concatenate([c[:, 0] for c in codes if c.size])) if flat else np.empty(0, np.int64)
        #: How far a symbol is shifted for each of its digits, the highest first.
        self.shifts = range((max(1, (size - 1).bit_length() - 1) // DIGIT_BITS) * DIGIT_BITS, -1, -DIGIT_BITS)
        length = size + DIGITS
        self.base, self.check = np.zeros(length, np.int32), np.full(length, -1, np.int32)
        self._met = np.zeros(length, np.int64)
        self.check[starts], self.check[0] = 0, 0
        self._used = len(starts) + 1
        prefix = [c[:, 0].copy() if c.size else np.empty(0, np.int64) for c in codes]  # states so far
        for level in range(1, self.depth):
            here = [i for i, c in enumerate(codes) if c.size and c.shape[1] > level]
            state, code = (np.concatenate(x) for x in zip(*[(prefix[i], codes[i][:, level]) for i in here], strict=True))
            for digit in ((code >> k) & (DIGITS - 1) for k in self.shifts):
                edges, back = np.unique(state * np.int64(DIGITS) + digit, return_inverse=True)
                state = self._place(edges // DIGITS, edges % DIGITS)[back]
            for i, own in zip(here, np.split(state, np.cumsum([len(prefix[i]) for i in here])[:-1]), strict=True):
                prefix[i] = own
        del self._met
        #: For each number of words, the accepting states of its phrases, row by row.
        self.accepting, self.phrases = prefix, phrases

    def _grow(self, size: int) -> None:
        """At least ``size`` slots, and as many more as there are digits, for look-ups beyond the last."""
        more = size + DIGITS - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 8)
            self.base, self._met = np.append(self.base, np.zeros(more, np.int32)), np.append(self._met, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int32))

    def _place(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """States of new children; edges come sorted by parent, then digit."""
        states = np.empty(len(parent), np.int64)
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        free = int(np.flatnonzero(self.check >= 0)[-1]) + 1
        wide = np.flatnonzero(count > FEW)
        self._grow(free + len(wide) * DIGITS)
        base = np.repeat(free + np.arange(len(wide)) * DIGITS, count[wide])
        edges = np.repeat(first[wide] - np.cumsum(count[wide]) + count[wide], count[wide]) + np.arange(len(base))
        self._keep(states, edges, parent[edges], digit[edges], base + digit[edges])
        for n in range(FEW, 1, -1):
            self._by_chance(states, first[count == n][:, None] + np.arange(n), parent, digit)
        alone = first[count == 1]
        self._grow(self._used + len(alone) + 2 * DIGITS)
        slots = np.flatnonzero(self.check[DIGITS : -DIGITS] < 0)[: len(alone)] + DIGITS
        self._keep(states, alone, parent[alone], digit[alone], slots)
        return states

    def _keep(self, states: np.ndarray, edges, parent: np.ndarray, digit: np.ndarray, slots: np.ndarray) -> None:
        self.base[parent], self.check[slots], states[edges] = slots - digit, parent, slots
        self._used += slots.size

    def _by_chance(self, states: np.ndarray, edges: np.ndarray, parent: np.ndarray, digit: np.ndarray) -> None:
        """Nodes of a few children each, all at once: those whose slots are free and no other's stay,
        the rest are tried elsewhere."""
        chance = np.random.default_rng(len(edges))
        while len(edges):
            apart = digit[edges] - digit[edges[:, :1]]
            self._grow(2 * (self._used + edges.size) + 2 * DIGITS)
            last = len(self.check) - 2 * DIGITS
            slots = (DIGITS + chance.random(len(edges)) * (last - DIGITS)).astype(np.int64)[:, None] + apart
            self._met[slots] = np.arange(len(edges))[:, None]
            fits = ((self.check[slots] < 0) & (self._met[slots] == np.arange(len(edges))[:, None])).all(axis=1)
            own = edges[fits]
            self._keep(states, own, parent[own], digit[own], slots[fits])
            edges = edges[~fits]

    def symbol(self, words: np.ndarray) -> np.ndarray:
        """The symbols of words, 0 for words of no phrase and for 0."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where((self.words[at] == words) & (words != 0), self.symbols[at], 0)

    def count(self, text: np.ndarray, counts: np.ndarray, place: np.ndarray | None = None) -> None:
        """Add to ``counts`` how often each state is reached from the places of ``text`` (hashes; 0 is
        a break), from all of them or those in ``place``."""
        n = len(text)
        if not n or not self.depth:
            return
        place = np.arange(n) if place is None else place
        if 3 * len(place) > n:  # then all words are looked up once
            known = self.symbol(text)
            symbol = known.__getitem__
        else:
            symbol = lambda at: self.symbol(text[at])
        state = symbol(place)
        live = (state > 0) & (self.check[state] == 0)
        place, state = place[live], state[live]
        for level in range(1, self.depth):
            inside = place + level < n
            place, state = place[inside], state[inside]
            by = symbol(place + level)
            there = by > 0
            for k in self.shifts:
                to = self.base[state] + ((by >> k) & (DIGITS - 1))
                live = there & (self.check[to] == state)
                place, state, by, there = place[live], to[live], by[live], there[live]
            counts += np.bincount(state, minlength=len(counts))
