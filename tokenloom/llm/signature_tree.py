"""Signature trees over the sets of one group.

Sets are sorted by size; a leaf covers sixteen of them and an inner node eight nodes. A node holds
the union of its sets' token bitmaps and the range of their sizes. A token of both A and B sets its
bit in both, so two sets share at most as many tokens as their nodes share bits, plus the tokens of
one of them that fell on a bit already set. Pairs of nodes whose greatest possible overlap is too
small for the threshold, or that are one component already, are not entered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FANOUT = 16, 8
# Narrowest and widest bitmap of a set, in bits.
MIN_BITS, MAX_BITS = 64, 1 << 22
# Sets tried against all others before the tree is walked.
HUBS = 4


def similar(shared, first, second, percent):
    """Whether ``shared`` tokens of sets of two sizes reach the Jaccard threshold in percent."""
    return (100 + percent) * shared >= percent * (first + second)


def bits_for(size: int, per_token: int = 2) -> int:
    """Width of a bitmap: a power of two, ``per_token`` bits for each token or up to twice that."""
    bits = MIN_BITS
    while bits < per_token * size and bits < MAX_BITS:
        bits *= 2
    return bits


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a set: the upper bits of a token are its place."""
    place = (tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    marks = np.zeros(bits, np.uint8)
    marks[place] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def folded(words: np.ndarray) -> np.ndarray:
    """The bitmap of half the width: neighbouring bits become one."""
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")
    return np.packbits(bits[::2] | bits[1::2], bitorder="little").view(np.uint64)


class Tree:
    """A tree over bitmaps of one width, sets sorted by ``sizes``; ``root`` tells which sets are
    one component and may change while the tree is walked.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, root: np.ndarray, percent: int):
        self.sizes, self.maps, self.root, self.percent = sizes, maps, root, percent
        self.extra = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        size, level, extra = LEAF, maps, self.extra
        while True:
            cuts = np.arange(0, len(level), FANOUT if self.levels else LEAF)
            level = np.bitwise_or.reduceat(level, cuts, axis=0)
            extra = np.maximum.reduceat(extra, cuts)
            self.levels.append((size, level, extra))
            if len(level) == 1:
                break
            size *= FANOUT

    def one(self, low: int, high: int) -> bool:
        part = self.root[low:high]
        return bool((part == part[0]).all())

    def walk(self, leaves: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Give ``leaves`` the pairs (arrays of the first and second sets) that may be similar."""
        stack = [(len(self.levels) - 1, 0, 0)]
        count = len(self.sizes)
        while stack:
            depth, x, y = stack.pop()
            size, maps, extra = self.levels[depth]
            lows = (x * size, y * size)
            highs = (min(count, lows[0] + size), min(count, lows[1] + size))
            if self.root[lows[0]] == self.root[lows[1]]:
                if self.one(lows[0], highs[0]) and self.one(lows[1], highs[1]):
                    continue
            if x != y:
                # Sizes ascend: the largest of x against the smallest of y, then the overlap bound.
                if self.sizes[highs[0] - 1] * 100 < self.percent * self.sizes[lows[1]]:
                    continue
                most = int(np.bitwise_count(maps[x] & maps[y]).sum()) + min(extra[x], extra[y])
                if not similar(most, self.sizes[lows[0]], self.sizes[lows[1]], self.percent):
                    continue
            if depth == 0:
                self._leaves(np.arange(lows[0], highs[0]), np.arange(lows[1], highs[1]), leaves)
                continue
            below = len(self.levels[depth - 1][1])
            for i in range(x * FANOUT, min(below, (x + 1) * FANOUT)):
                for j in range(max(i, y * FANOUT), min(below, (y + 1) * FANOUT)):
                    stack.append((depth - 1, i, j))

    def _leaves(self, a: np.ndarray, b: np.ndarray, leaves) -> None:
        most = np.bitwise_count(self.maps[a][:, None] & self.maps[b][None]).sum(axis=2).astype(int)
        most += np.minimum(self.extra[a][:, None], self.extra[b][None])
        able = similar(most, self.sizes[a][:, None], self.sizes[b][None], self.percent)
        able &= self.sizes[a][:, None] * 100 >= self.percent * self.sizes[b][None]
        able &= (a[:, None] < b[None]) & (self.root[a][:, None] != self.root[b][None])
        i, j = np.nonzero(able)
        if len(i):
            leaves(a[i], b[j])


def with_partner(
    sizes: np.ndarray, maps: list[np.ndarray], known: np.ndarray, percent: int
) -> np.ndarray:
    """Which sets of a group may be similar to one that they are not connected to, by sizes and
    bitmaps alone. Similar sets have bitmaps of one width, or of two that follow each other.
    """
    alive = np.zeros(len(sizes), bool)
    width = np.array([len(m) for m in maps])
    for words in np.unique(width).tolist():
        own = np.flatnonzero(width == words)
        wider = np.flatnonzero(width == 2 * words)
        picked = np.concatenate([own, wider])
        if len(picked) < 2:
            continue
        picked = picked[np.argsort(sizes[picked], kind="stable")]
        level = np.array([maps[i] if width[i] == words else folded(maps[i]) for i in picked])
        narrow = width[picked] == words

        def mark(a: np.ndarray, b: np.ndarray) -> None:
            good = narrow[a] | narrow[b]
            alive[picked[a[good]]] = alive[picked[b[good]]] = True

        Tree(sizes[picked], level, known[picked], percent).walk(mark)
    return alive


class Group:
    """The sets of one group; ``known`` says which are connected already."""

    def __init__(self, sets: list[np.ndarray], known: np.ndarray, percent: int):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.order, self.percent = order, percent
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.root = np.unique(known[order], return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def join(self) -> list[tuple[int, int]]:
        """Pairs of similar sets that connect all that the threshold connects."""
        if len(self.sets) == 2:
            if self.root[0] != self.root[1]:
                self._test(0, 1)
        elif len(self.sets) > 2:
            self._hubs()
            if not self._done():
                bits = bits_for(int(self.sizes[-1]))
                maps = np.array([bitmap(s, bits) for s in self.sets])
                Tree(self.sizes, maps, self.root, self.percent).walk(self._pairs)
        return [(int(self.order[a]), int(self.order[b])) for a, b in self.links]

    def _done(self) -> bool:
        return bool((self.root == self.root[0]).all())

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            if self.root[i] != self.root[j]:
                self._test(i, j)

    def _link(self, a: int, b: int) -> None:
        if self.root[a] != self.root[b]:
            self.root[self.root == self.root[b]] = self.root[a]
            self.links.append((a, b))

    def _test(self, a: int, b: int) -> None:
        small, large = self.sets[a], self.sets[b]
        if len(small) > len(large):
            small, large = large, small
        if len(small) * 100 < self.percent * len(large):
            return
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        if similar(int((large[at] == small).sum()), len(small), len(large), self.percent):
            self._link(a, b)

    def _hubs(self) -> None:
        """Sets that share the most with the group connect most of a cluster in one pass each."""
        tokens = np.concatenate(self.sets)
        edges = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        _, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        common = np.add.reduceat(counts[place], edges) / self.sizes
        for hub in np.argsort(-common, kind="stable")[:HUBS].tolist():
            if self._done():
                return
            own = self.sets[hub]
            at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
            shared = np.add.reduceat((own[at] == tokens).astype(np.int64), edges)
            for other in np.flatnonzero(similar(shared, self.sizes, len(own), self.percent)):
                if other != hub:
                    self._link(hub, int(other))
