"""Ordered trees as balanced parentheses, with range min-max blocks of the excess."""

from __future__ import annotations

import numpy as np

#: Places of a block.
BLOCK = 64


class BalancedParentheses:
    """A tree in preorder: an opening parenthesis (1) where a node begins, a closing one (0) where
    its subtree ends. All answers are for many nodes at once."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        self.rows = np.append(self.excess, np.full(blocks * BLOCK - len(bits), np.iinfo(np.int64).max)).reshape(blocks, BLOCK)
        width = 1 << max(0, int(blocks - 1).bit_length())
        level = np.append(self.rows.min(axis=1), np.full(width - blocks, np.iinfo(np.int64).max))
        self.least = [level]  # minima of blocks, of pairs of blocks, ...
        while len(level) > 1:
            level = level.reshape(-1, 2).min(axis=1)
            self.least.append(level)
        leaf = (bits == 1) & (np.append(bits[1:], 1) == 0)
        self.pairs = np.append(0, np.cumsum(leaf))

    def opens(self) -> np.ndarray:
        """Places of the nodes, in preorder."""
        return np.flatnonzero(self.bits)

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """Where the subtrees of the nodes opened at ``places`` end."""
        found, step = np.empty(len(places), np.int64), 1 << 16
        for k in range(0, len(places), step):
            found[k : k + step] = self._find_close(places[k : k + step])
        return found

    def _find_close(self, places: np.ndarray) -> np.ndarray:
        goal = self.excess[places] - 1
        block, at = places // BLOCK, places % BLOCK
        fits = (self.rows[block] <= goal[:, None]) & (np.arange(BLOCK) > at[:, None])
        column = fits.argmax(axis=1)
        far = np.flatnonzero(~fits[np.arange(len(places)), column])
        if len(far):
            node, want = block[far], goal[far]
            level = np.zeros(len(far), np.int64)
            climbing = np.ones(len(far), bool)
            for up in range(len(self.least)):  # to the first block on the right with a small enough minimum
                own = np.flatnonzero(climbing)
                if not len(own):
                    break
                right = (node[own] % 2 == 0) & (node[own] + 1 < len(self.least[up]))
                hit = own[right]
                hit = hit[self.least[up][node[hit] + 1] <= want[hit]]
                node[hit], level[hit], climbing[hit] = node[hit] + 1, up, False
                node[climbing] //= 2
            for down in range(len(self.least) - 1, 0, -1):
                own = np.flatnonzero(level == down)
                left = 2 * node[own]
                node[own] = np.where(self.least[down - 1][left] <= want[own], left, left + 1)
                level[own] = down - 1
            block[far] = node
            column[far] = (self.rows[node] <= want[:, None]).argmax(axis=1)
        return block * BLOCK + column

    def leaves(self, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Leaf pairs between the parentheses of each node."""
        return self.pairs[closed] - self.pairs[opened]
