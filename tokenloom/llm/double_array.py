"""A trie of symbol sequences in a double array, stepped for many positions at once.

The child of state ``s`` by symbol ``c`` is state ``base[s] + c`` if ``check`` of it is ``s``. State
0 is the root, and the last state is dead: nothing leads out of it.
"""

from __future__ import annotations

import numpy as np

# Families of more children than this are placed one by one, largest first, the others together.
SMALL = 8
# Places tried at once for one family, and slots for every node.
TRIES, ROOM = 256, 4


class DoubleArray:
    """Trie of the rows of ``paths`` (symbols from 1 to ``alphabet`` - 1, 0 after a shorter row's
    end). ``ends[state]`` is the row that ends there, else -1.
    """

    def __init__(self, paths: np.ndarray, alphabet: int) -> None:
        self.alphabet = alphabet
        self._random = np.random.default_rng(1)
        size = ROOM * paths.size + 2 * alphabet
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        lengths = np.count_nonzero(paths, axis=1)
        state = np.zeros(len(paths), np.int64)
        for level in range(paths.shape[1]):
            rows = np.flatnonzero(lengths > level)
            if not len(rows):
                break
            key = (state[rows] << 32) | paths[rows, level]
            nodes, back = np.unique(key, return_inverse=True)
            state[rows] = self._place(nodes >> 32, nodes & 0xFFFFFFFF)[back]
        used = np.flatnonzero(self.check >= 0)
        top = int(max(used.max(initial=0), self.base.max())) + alphabet + 1
        self.base = np.concatenate([self.base, np.zeros(max(0, top - size), np.int32)])[:top]
        self.check = np.concatenate([self.check, np.full(max(0, top - size), -1, np.int32)])[:top]
        self.dead = top - 1
        self.ends = np.full(top, -1, np.int32)
        self.ends[state] = np.arange(len(paths))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_random"}

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after one more symbol; 0 is no symbol of any row."""
        found = self.base[states] + symbols
        return np.where(self.check[found] == states, found, self.dead)

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots for the children of a level, sorted by parent; sets the parents' bases."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(first, len(parents)))
        slots = np.empty(len(parents), np.int64)
        if parents[0] == 0:
            # The root's children are their symbols.
            slots[: sizes[0]] = symbols[: sizes[0]]
            self.check[symbols[: sizes[0]]] = 0
            first, sizes = first[1:], sizes[1:]
        for i in np.flatnonzero(sizes > SMALL)[np.argsort(-sizes[sizes > SMALL], kind="stable")]:
            own = slice(first[i], first[i] + sizes[i])
            slots[own] = self._settle(int(parents[first[i]]), symbols[own])
        waiting = np.flatnonzero(sizes <= SMALL)
        while len(waiting):
            waiting = self._round(parents, symbols, first, sizes, waiting, slots)
        return slots

    def _settle(self, parent: int, symbols: np.ndarray) -> np.ndarray:
        for _ in range(4):
            tried = self._random.integers(1, len(self.base) - self.alphabet, TRIES)
            free = (self.check[tried[:, None] + symbols] < 0).all(axis=1)
            if free.any():
                base = int(tried[free.argmax()])
                break
        else:
            base = len(self.base)
            self._grow(self.alphabet + len(self.base) // 4)
        self.base[parent] = base
        self.check[base + symbols] = parent
        return base + symbols

    def _grow(self, more: int) -> None:
        self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _round(self, parents, symbols, first, sizes, waiting, slots) -> np.ndarray:
        """Give every waiting family a random place; those that meet no other stay there."""
        size = sizes[waiting]
        edges = np.cumsum(size) - size
        child = np.arange(int(size.sum())) + np.repeat(first[waiting] - edges, size)
        base = self._random.integers(1, len(self.base) - self.alphabet, len(waiting))
        place = np.repeat(base, size) + symbols[child]
        owner = np.repeat(np.arange(len(waiting)), size)
        claim = np.full(len(self.base), -1, np.int32)
        claim[place] = owner
        good = (self.check[place] < 0) & (claim[place] == owner)
        stays = np.logical_and.reduceat(good, edges)
        kept = stays[owner]
        self.base[parents[first[waiting[stays]]]] = base[stays]
        self.check[place[kept]] = parents[child[kept]]
        slots[child[kept]] = place[kept]
        if stays.mean() < 0.02:
            self._grow(len(self.base) // 4)
        return waiting[~stays]


class NumberTable:
    """Dense numbers, from 1, of 64-bit keys, by open addressing; 0 for any other key."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = 64 - max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << (64 - self.shift)) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.numbers = np.zeros(self.mask + 1, np.int32)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], probe)
            free = self.numbers[slot] == 0
            self.numbers[slot[free]] = todo[free] + 1
            won = self.numbers[slot] == todo + 1
            self.keys[slot[won]] = keys[todo[won]]
            todo, probe = todo[~won], probe + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(self.shift)).astype(np.int64) + probe) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int32)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], probe)
            number = self.numbers[slot]
            same = (self.keys[slot] == keys[todo]) & (number > 0)
            out[todo[same]] = number[same]
            todo, probe = todo[~same & (number > 0)], probe + 1
        return out
