"""Common substrings of a block of strings by breadth-first expansion on a Burrows-Wheeler
transform.

The intervals of all substrings of one length give, by backward extension with every byte, those of
the next length; the right end of each new interval is a place where two neighbouring suffixes have
exactly that many bytes in common. So common prefixes appear by increasing length, and after
``length`` steps the places not yet met separate suffixes that share at least ``length`` bytes.
"""

from __future__ import annotations

import numpy as np


def _order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first ``length`` symbols at least (below 2^9), by doubling."""
    size = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + size]
    depth = 7
    while True:
        order = np.argsort(key)
        if depth >= length:
            return order
        ahead = key[order]
        rank = np.empty(size, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], ahead[1:] != ahead[:-1]]))
        later = np.zeros(size, np.uint64)
        later[: max(0, size - depth)] = rank[depth:]
        key = (rank << np.uint64(32)) | later
        depth *= 2


def equal_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``symbols`` in order, and for each whether its first ``length`` symbols
    differ from those of the one before.

    ``symbols`` are small positive integers; 0 ends every string, so that a prefix of positive
    symbols lies within one string.
    """
    size = len(symbols)
    order = _order(symbols, length)
    first = symbols[order]
    bwt = symbols[order - 1]
    # Where backward extension leads: the stable order of the transform.
    target = np.empty(size, np.int64)
    target[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(size)
    target[bwt == 0] = -1
    met = np.zeros(size + 1, bool)
    met[0] = met[size] = True
    low, high = np.array([0]), np.array([size])
    for _ in range(length):
        # Where all places of the current intervals lead, as one number with their interval.
        counts = high - low
        owner = np.repeat(np.arange(len(low)), counts)
        place = target[np.arange(len(owner)) + np.repeat(low - np.cumsum(counts) + counts, counts)]
        led = np.sort(((place << 32) | owner)[place >= 0])
        if not len(led):
            break
        # Places of one interval and byte are next to each other there.
        place, owner = led >> 32, led & 0xFFFFFFFF
        byte = first[place]
        new = np.ones(len(led), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])
        begin = np.flatnonzero(new)
        low, high = place[begin], place[np.append(begin[1:], len(led)) - 1] + 1
        # An interval whose right end was met at a smaller length says nothing new.
        fresh = ~met[high]
        low, high = low[fresh], high[fresh]
        met[high] = True
        if not len(low):
            break
    return order, met[:size]
