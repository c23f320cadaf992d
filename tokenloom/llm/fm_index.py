"""A compressed FM-index over strings of small numbers, searched for many patterns at once.

The Burrows-Wheeler transform is held in a wavelet tree in matrix form: one packed bit per symbol
and level, and one count per 64 bits. Suffixes are sorted to a bounded depth, which is enough for
patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Occurrences of a symbol before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in reversed(range(self.bits)):
            bit = ((current >> level) & 1).astype(np.bool_)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
            words = packed[: len(packed) // 8 * 8].view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            current = np.concatenate([current[~bit], current[bit]])
            self.zeros.append(len(bit) - int(bit.sum()))
        every = np.arange(alphabet)
        self.starts = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, (words, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros)):
            slot = places >> 6
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[slot] + np.bitwise_count(words[slot] & below)
            up = (symbols >> (self.bits - 1 - level)) & 1
            places = np.where(up == 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._descend(symbols, places) - self.starts[symbols]


class FMIndex:
    """Index of ``text``, symbols from 1 up to ``alphabet`` - 1 and 0 at the end of every string,
    for patterns of at most ``depth`` symbols that hold no 0.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int) -> None:
        self.text, self.depth = text, depth
        bits = max(1, int(alphabet - 1).bit_length())
        # Symbols that fit one number: the sorted heads of the suffixes give a pattern's first
        # interval, and their order is where the doubling starts.
        self.head = max(1, min(depth, 63 // bits))
        padded = np.concatenate([text, np.zeros(self.head, text.dtype)]).astype(np.uint64)
        self.bits = np.uint64(bits)
        heads = np.zeros(len(text), np.uint64)
        for k in range(self.head):
            heads = (heads << self.bits) | padded[k : k + len(text)]
        self.order = _sorted_suffixes(heads, self.head, depth)
        self.heads = heads
        self.sorted_heads = heads[self.order]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.tree = WaveletMatrix(text[self.order - 1], alphabet)

    def intervals(self, places: np.ndarray, least: int = 1) -> tuple[np.ndarray, ...]:
        """Backward search for the ``depth`` symbols from each place of the text on: the patterns
        whose interval of suffixes holds at least ``least``, and these intervals (low, high).
        A pattern is dropped as soon as its interval is smaller.
        """
        tail = self.heads[places + self.depth - self.head]
        low = np.searchsorted(self.sorted_heads, tail, "left")
        high = np.searchsorted(self.sorted_heads, tail, "right")
        which = np.arange(len(places))
        for k in reversed(range(self.depth - self.head)):
            kept = high - low >= least
            which, low, high = which[kept], low[kept], high[kept]
            if not len(which):
                break
            symbol = self.text[places[which] + k]
            both = self.tree.rank(
                np.concatenate([symbol, symbol]), np.concatenate([low, high])
            ) + np.tile(self.below[symbol], 2)
            low, high = both[: len(which)], both[len(which) :]
        kept = high - low >= least
        return which[kept], low[kept], high[kept]


def _sorted_suffixes(heads: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, ``heads`` being the first
    ``known``; known prefixes double in length until they are long enough.
    """
    size, key = len(heads), heads
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        ahead = key[order]
        rank = np.empty(size, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], ahead[1:] != ahead[:-1]]))
        later = np.zeros(size, np.uint64)
        later[: max(0, size - known)] = rank[known:]
        key = (rank << np.uint64(32)) | later
        known *= 2


def least_within(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high]`` for intervals that are equal or apart."""
    if not len(low):
        return values[:0]
    distinct, first, back = np.unique(low, return_index=True, return_inverse=True)
    edges = np.stack([distinct, high[first]], axis=1).ravel()
    padded = np.append(values, values[-1])
    return np.minimum.reduceat(padded, edges)[::2][back]
