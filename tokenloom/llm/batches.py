"""Arrow text batches as numpy bytes, and the small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once inside a task; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (rows + 1) and UTF-8 bytes of a batch of texts; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.cast(pa.large_string()).cast(pa.large_binary())
    rows = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + rows + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes each, or a single row."""
    rows, low = len(offsets) - 1, 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(rows, max(low + 1, high))
        yield low, high
        low = high


def text_parts(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text, or a single row, so that what is
    made of a text is held for a slice and not for a batch of 10,000 rows.
    """
    for batch in batches:
        for low, high in blocks(text_bytes(batch.column(column))[0], limit):
            yield batch.slice(low, high - low)
        release()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that nearby values spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_rows(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary cells of the given byte lengths, cut from ``data`` one after the other."""
    edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    data = np.ascontiguousarray(data).view(np.uint8)
    cells = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(data)]
    )
    return cells.cast(pa.binary())


class RecentTable:
    """Values by key, of which a worker keeps those used lately: when the young half is full it
    becomes the old one, and what is used again moves back. ``most`` bounds both halves, but for
    the keys of the block at hand.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Collection) -> list:
        """The keys of a block that are to be learned, each once; the others are at hand."""
        if len(self.young) + len(keys) > self.most // 2:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for key in set(keys).difference(young):
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out

    def learn(self, keys: Iterable, values: Iterable) -> None:
        self.young.update(zip(keys, values))

    def values(self, keys: Iterable) -> list:
        """Values of the keys last given to ``missing``, in the order of these."""
        return list(map(self.young.__getitem__, keys))


def release() -> None:
    """Give free memory back to the system. Workers are reused from stage to stage, and the
    allocators keep what a stage has freed; without this the stages' peaks add up.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
