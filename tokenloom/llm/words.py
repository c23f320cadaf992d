"""Words of a block of texts as places and 64-bit hashes, on byte arrays."""

from __future__ import annotations

import hashlib

import numpy as np

from tokenloom.llm.batches import mix

# Bytes between words: space, and tab to carriage return.
SPACES = (32, 9, 10, 11, 12, 13)
# Chunks of eight bytes that are hashed for all words at once; longer words are hashed one by one.
CHUNKS = 32
_SIZE_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_STEP = np.uint64(0xD6E8FEB86659FD93)
# The low bytes of a chunk that belong to a word with so many bytes left.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_table(codes: tuple[int, ...]) -> np.ndarray:
    """Which byte values are among ``codes``."""
    table = np.zeros(256, np.bool_)
    table[list(codes)] = True
    return table


def split_words(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every run of bytes that are no gaps, within the rows that ``offsets``
    cut, and the word offsets of the rows.
    """
    inside = ~gaps[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word's bytes and length, eight bytes of all words at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray((len(data) + 1,), np.uint64, buffer=padded.data, strides=(1,))
    size = ends - starts
    hashes = mix((size + 1).astype(np.uint64) * _SIZE_FACTOR)
    live = np.arange(len(starts))
    for k in range(CHUNKS):
        if not len(live):
            return hashes
        left = size[live] - 8 * k
        part = chunks[starts[live] + 8 * k] & _MASKS[np.minimum(left, 8)]
        hashes[live] = mix((hashes[live] ^ part) + _CHUNK_STEP)
        live = live[left > 8]
    for i in live.tolist():
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(whole, "little")
    return hashes


def runs_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[i], values[i] + 1, ...``, as many as ``sizes[i]``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(values - (ends - sizes), sizes)
