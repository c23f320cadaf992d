"""Tokenizers as column functions.

A tokenizer offers ``count``, ``encode`` and ``decode`` as columns. ``Utf8ByteTokenizer`` needs no
vocabulary; ``ExternalTokenizer`` wraps any encoder object with ``encode(text) -> ids`` and
``decode(ids) -> text``, built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import repair_utf8

# Bytes of text (or ids) worked on at once in a worker; one longer row is a block of its own.
BLOCK_BYTES = 1 << 20


def _in_blocks(
    batches: Iterator[pa.Array], work: Callable[[pa.Array], pa.Array], id_bytes: int = 0
) -> Iterator[pa.Array]:
    """``work`` over Arrow batches block by block. Ids take several times the bytes of their text,
    so a whole batch of long texts would take them many times over. Rows are texts, or lists of ids
    of ``id_bytes`` each.
    """
    for batch in batches:
        if id_bytes:
            sizes = pc.multiply(pc.cast(pc.list_value_length(batch), pa.int64()), id_bytes)
        else:
            sizes = pc.cast(pc.binary_length(batch), pa.int64())
        through = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(batch):
            before = through[low - 1] if low else 0
            high = int(np.searchsorted(through, before + BLOCK_BYTES, "right"))
            high = max(low + 1, high)
            yield work(batch.slice(low, high - low))
            low = high
        # Workers are reused, and the pool keeps what a block has freed.
        pa.default_memory_pool().release_unused()


def _byte_ids(texts: pa.Array, separator: int | None) -> pa.Array:
    """Ids of a block of texts in one numpy pass: the data buffer already is the ids."""
    if texts.null_count:
        mask = np.asarray(texts.is_null())
        texts = texts.fill_null("")
    else:
        mask = None
    raw = texts.cast(pa.large_binary())
    rows = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + rows + 1]
    data = raw.buffers()[2]
    ids = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    ids = ids[offsets[0] : offsets[-1]].astype(np.int32)
    offsets = offsets - offsets[0]
    if separator is not None:
        ids = np.insert(ids, offsets[:-1], separator)
        offsets = offsets + np.arange(rows + 1)
    return pa.LargeListArray.from_arrays(
        pa.array(offsets), pa.array(ids), mask=None if mask is None else pa.array(mask)
    ).cast(pa.list_(pa.int32()))


def _id_bytes(lists: pa.Array, separator: int) -> pa.Array:
    """Bytes of a block of id lists; null lists give no bytes."""
    lists = lists.cast(pa.large_list(pa.int32()))
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    # Only a leading separator goes; any other id that is no byte is a fault of the ids.
    body = np.ones(len(ids), bool)
    firsts = (np.cumsum(counts) - counts)[counts > 0].astype(np.int64)
    body[firsts] = ids[firsts] != separator
    if len(ids) and (((ids < 0) | (ids > 255)) & body).any():
        raise ValueError("ids outside 0..255 after the leading separator")
    kept_before = np.concatenate([[0], np.cumsum(body)])
    edges = kept_before[np.concatenate([[0], np.cumsum(counts)])]
    data = ids[body].astype(np.uint8)
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(lists),
        [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)],
    ).cast(pa.binary())


@dataclass(frozen=True)
class Utf8ByteTokenizer:
    """One id per UTF-8 byte; id 256 separates documents."""

    add_separator: bool = True
    name: str = "utf8_byte"
    separator_id: int = 256
    vocab_size: int = 257

    def count(self, text: Column) -> Column:
        """Number of ids, without making them."""
        return (F.octet_length(text) + F.lit(int(self.add_separator))).cast("long")

    def encode(self, text: Column) -> Column:
        separator = self.separator_id if self.add_separator else None

        @F.arrow_udf("array<int>")
        def byte_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_blocks(batches, lambda texts: _byte_ids(texts, separator))

        return byte_ids(text)

    def decode(self, ids: Column) -> Column:
        """Text of ``ids`` without the separator; a cut character decodes to U+FFFD."""
        separator = self.separator_id

        @F.arrow_udf("binary")
        def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_blocks(batches, lambda lists: _id_bytes(lists, separator), 4)

        return F.coalesce(repair_utf8(bytes_of(ids)), F.lit(""))

    def cut(self, text: Column, keep: Column) -> Column:
        """Text of the first ``keep`` ids, straight from the bytes (no id array)."""
        body = keep.cast("int") - F.lit(int(self.add_separator))
        return repair_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), body))


# Encoders built by loaders, one per Python worker, name and loader.
_WORKER_ENCODERS: dict[tuple[str, bytes], Any] = {}


def _encoder(name: str, loader: Callable[[], Any]) -> Any:
    key = (name, cloudpickle.dumps(loader))
    if key not in _WORKER_ENCODERS:
        _WORKER_ENCODERS[key] = loader()
    return _WORKER_ENCODERS[key]


@dataclass(frozen=True)
class ExternalTokenizer:
    """An encoder made by ``loader()`` on the worker; a loader that fails fails the task.

    ``method`` names the encoder's function; by default it is ``encode_ordinary`` where there is
    one, which takes the literals of special tokens for text, else ``encode``. A document the
    encoder refuses gets null ids and a null count; the skip report counts it.
    """

    name: str
    loader: Callable[[], Any]
    vocab_size: int
    separator_id: int
    add_separator: bool = True
    method: str | None = None

    def _block(self, texts: pa.Array) -> Iterator[list[int] | None]:
        encoder = _encoder(self.name, self.loader)
        encode = getattr(encoder, self.method or "encode_ordinary", None) or encoder.encode
        return (self._ids(encode, text) for text in texts.to_pylist())

    def _ids(self, encode: Callable[[str], Any], text: str | None) -> list[int] | None:
        if text is None:
            return None
        try:
            ids = encode(text)
        except Exception:  # a text that the library refuses is counted, not hidden
            return None
        ids = list(getattr(ids, "ids", ids))
        return [self.separator_id, *ids] if self.add_separator else ids

    def count(self, text: Column) -> Column:
        def counts(texts: pa.Array) -> pa.Array:
            sizes = [None if ids is None else len(ids) for ids in self._block(texts)]
            return pa.array(sizes, pa.int64())

        @F.arrow_udf("long")
        def id_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_blocks(batches, counts)

        return id_count(text)

    def encode(self, text: Column) -> Column:
        def lists(texts: pa.Array) -> pa.Array:
            return pa.array(list(self._block(texts)), pa.list_(pa.int32()))

        @F.arrow_udf("array<int>")
        def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_blocks(batches, lists)

        return ids_of(text)

    def decode(self, ids: Column) -> Column:
        def texts(lists: pa.Array) -> pa.Array:
            encoder = _encoder(self.name, self.loader)
            return pa.array([self._text(encoder, one) for one in lists.to_pylist()], pa.string())

        @F.arrow_udf("string")
        def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return _in_blocks(batches, texts, 4)

        return text_of(ids)

    def _text(self, encoder: Any, ids: Any) -> str:
        ids = [] if ids is None else [int(i) for i in ids]
        if self.add_separator and ids and ids[0] == self.separator_id:
            ids = ids[1:]
        if not ids:
            return ""
        try:
            return encoder.decode(ids)
        except Exception:  # ids that the library refuses have no text
            return ""

    def cut(self, text: Column, keep: Column) -> Column:
        return self.decode(F.slice(self.encode(text), F.lit(1), keep.cast("int")))
