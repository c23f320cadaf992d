"""Word shingles of whole texts as sorted 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tokenloom.llm.batches import blocks, mix, text_bytes

WORDS = 5
# Bytes of text hashed at once: some hundred bytes are held for each of them.
HASHED_BYTES = 256 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
# Powers of the base and of its inverse, as many as the longest block needed so far.
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        out = []
        for base in (_BASE, _INVERSE):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            out.append(np.multiply.accumulate(values))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a block of texts, A-Z as a-z, and word offsets of the texts.

    Words are the runs of bytes other than space and tab to carriage return. A word's hash is a
    polynomial over its bytes modulo 2^64, read off a running sum, and its length.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data):
        before[1:], after[:-1] = gap[:-1], gap[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = True
        after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    up, down = _powers(max(1, len(data)))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=running[1:])
    hashes = (running[ends] - running[starts]) * down[starts] if len(starts) else running[:0]
    hashes = mix(hashes ^ mix((ends - starts).astype(np.uint64)))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its five-word shingles; of a shorter text the whole
    sequence of words is its one shingle; without words the set is empty.
    """
    offsets, data = text_bytes(texts)
    for low, high in blocks(offsets, HASHED_BYTES):
        part = offsets[low : high + 1]
        words, edges = word_hashes(data[part[0] : part[-1]], part - part[0])
        mixed = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            mixed = mixed * _STEP + words[k : k + len(mixed)]
        mixed = mix(mixed)
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if last - first >= WORDS:
                found = np.sort(mixed[first : last - WORDS + 1])
                if len(found) > 1:
                    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
                yield found
            elif last > first:
                value = np.uint64(0)
                with np.errstate(over="ignore"):
                    for word in words[first:last]:
                        value = value * _STEP + word
                    value = mix(np.array([value + np.uint64(last - first)]))
                yield value
            else:
                yield words[:0]


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set, equal for equal sets."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(tokens)) * _BASE
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
