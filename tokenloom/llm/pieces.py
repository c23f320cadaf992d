"""SentencePiece encoding and decoding by a Viterbi search that distinct words share.

Texts are normalised by the model and cut into marked words, a run of space marks and what follows
up to the next mark; no piece reaches beyond one. The distinct words of a block are sorted, which
lays out their trie, and walked depth first: the forward states of a prefix are kept while words
that begin with it follow, so each branch of the trie is scored once.

The forward state of a prefix is the best segmentation that ends there. For a unigram model that is
the one of the greatest sum of scores. For a byte-pair model a segmentation counts only if every
two neighbours are what the model's own merges leave of the two laid end to end; exactly one
segmentation of every prefix does, the model's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.batches import RecentTable, blocks, release, text_bytes
from tokenloom.llm.words import runs_of
from tokenloom.session import ship_package

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Words and pairs of pieces whose results a worker keeps: the words used lately; a full table of
# pairs is emptied.
MAX_WORDS, MAX_PAIRS = 1_000_000, 1_000_000
BLOCK_BYTES = 2 << 20
# Fixed value: what an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0

# Models of this worker, by path.
_MODELS: dict[str, PieceModel] = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """Fields of a serialised message: numbers, and bytes of nested ones."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def is_byte_pair(serialized: bytes) -> bool:
    """Whether a model merges pairs (type 2 of its training settings) or is a unigram model."""
    kind = 1
    for field, value in _fields(serialized):
        if field == 2:
            kind = dict(_fields(value)).get(3, kind)
    return kind == 2


class _Numbers(dict):
    """Ids of pieces as bytes; a character that is no piece has the ids of its bytes."""

    def __init__(self, ids: dict[str, int], byte_ids: list[int]):
        super().__init__((piece, np.int32(i).tobytes()) for piece, i in ids.items())
        self.of_byte = [np.int32(i).tobytes() for i in byte_ids]

    def __missing__(self, part: str) -> bytes:
        return b"".join([self.of_byte[b] for b in part.encode()])


class PieceModel:
    """Vocabulary of a model file and the searches over it."""

    max_pairs = MAX_PAIRS

    def __init__(self, serialized: bytes):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.byte_pair = is_byte_pair(serialized)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        byte_ids = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif library.is_control(i):
                self.bytes_of.append(b"")
            elif library.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not library.is_unused(i):
                    self.ids[piece] = i
                    self.score[piece] = library.get_score(i)
        self.byte_ids = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.unknown = library.unk_id()
        # Every end of a piece, with the piece's score where it is one itself.
        self.ends: dict[str, float | None] = {
            piece[i:]: self.score.get(piece[i:]) for piece in self.ids for i in range(len(piece))
        }
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # For a byte-pair model: which pieces may stand before one.
        self.before: dict[str, dict[str, bool] | None] = {
            part: None if score is None else {} for part, score in self.ends.items()
        }
        self.known_pairs = 0
        self.numbers = _Numbers(self.ids, self.byte_ids) if self.byte_ids else None
        self.words = RecentTable(MAX_WORDS)
        # Bytes of all pieces end to end.
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # Texts get a leading space mark, which decoding takes away again.
        self.prefixed = library.normalize("a") == MARK + "a"

    @staticmethod
    def at(path: str) -> PieceModel:
        if path not in _MODELS:
            with open(path, "rb") as file:
                _MODELS[path] = PieceModel(file.read())
        return _MODELS[path]

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, the best piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _follows(self, known: dict[str, bool], left: str, right: str) -> bool:
        """Whether the merges of two pieces laid end to end leave them as they are, noted among
        what is known of the right one.
        """
        if self.known_pairs >= self.max_pairs:
            for pairs in self.before.values():
                if pairs:
                    pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        wanted = [left, right] if left else [right]
        known[left] = kept = self.merged(left + right) == wanted
        return kept

    def _extend_pairs(self, word: str, shared: int, last: list[str]) -> None:
        """The last piece of every prefix of ``word`` beyond ``shared`` characters, by the pieces
        that the model's merges leave side by side.
        """
        before, absent = self.before, self.before
        for end in range(shared + 1, len(word) + 1):
            piece = ""
            for start in range(end - 1, -1, -1):
                part = word[start:end]
                known = before.get(part, absent)
                if known is absent:
                    break  # no piece ends in this
                if known is None:
                    continue
                left = last[start]
                kept = known.get(left)
                if kept is None:
                    kept = self._follows(known, left, part)
                if kept:
                    piece = part
                    break
            last.append(piece or word[end - 1])

    def _extend_scores(self, word: str, shared: int, last: list[str], total: list[float]) -> None:
        """The same by the greatest sum of scores."""
        ids, ends = self.ids, self.ends
        for end in range(shared + 1, len(word) + 1):
            best, piece = None, ""
            single = word[end - 1]
            for start in range(end - 1, -1, -1):
                part = word[start:end]
                score = ends.get(part, ends)
                if score is ends:
                    break  # no piece ends in this
                if score is None:
                    continue
                score += total[start]
                if best is None or score >= best:
                    best, piece = score, part
            if single not in ids:
                score = total[end - 1] + self.least
                if best is None or score > best:
                    best, piece = score, single
            total.append(best)
            last.append(piece)

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Every word with its pieces, in sorted order."""
        total = [0.0]  # best score of each prefix of the word at hand
        last = [""]  # and the piece that ends it
        before = ""
        for word in sorted(words):
            shared = 0
            for one, other in zip(before, word):
                if one != other:
                    break
                shared += 1
            del last[shared + 1 :]
            if self.byte_pair:
                self._extend_pairs(word, shared, last)
            else:
                del total[shared + 1 :]
                self._extend_scores(word, shared, last, total)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            parts.reverse()
            yield word, parts

    def _coded(self, parts: list[str]) -> bytes:
        if self.numbers is not None:
            return b"".join(map(self.numbers.__getitem__, parts))
        out: list[int] = []
        for part in parts:
            known = self.ids.get(part, self.unknown)
            if known != self.unknown or not out or out[-1] != self.unknown:
                out.append(known)
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = []
        for text in texts:
            plain = self.library.normalize(text)
            if MARK + MARK in plain or not plain.startswith(MARK) or plain.endswith(MARK):
                cut.append(WORD.findall(plain))
            else:
                cut.append([MARK + w for w in plain[1:].split(MARK)])
        new = self.words.missing(set(chain.from_iterable(cut)))
        found = [(word, self._coded(parts)) for word, parts in self.segment(new)]
        self.words.learn([word for word, _ in found], [ids for _, ids in found])
        return [np.frombuffer(b"".join(self.words.values(one)), np.int32) for one in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a text from its ids."""
        data = self.all_bytes[runs_of(self.start_of[ids], self.size_of[ids])].tobytes()
        return data[1:] if self.prefixed and data[:1] == b" " else data


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    offsets = text_bytes(texts)[0]
    for low, high in blocks(offsets, BLOCK_BYTES):
        yield [t or "" for t in texts[low:high].to_pylist()]


def encode(text: Column, path: str) -> Column:
    """``array<int>``: ids of a whole text; a null text has none."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        release()
        model = PieceModel.at(path)
        rows = [ids for block in _blocks(texts) for ids in model.encode(block)]
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *rows])
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))

    return ids_of(text)


# Words and pairs kept where a worker shares its executor with other stages of a pipeline, and bytes
# of text that are encoded before their ids are sent on.
STAGE_WORDS, STAGE_PAIRS, SENT_BYTES = 150_000, 300_000, 4 << 20


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the ids of ``text`` as ``ids`` in its place, sent on every few megabytes of text,
    so that a task holds little. A null or empty text has none; an empty table gives an empty result;
    names must be distinct.
    """
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = PieceModel.at(path)
        model.words.most, model.max_pairs = STAGE_WORDS, STAGE_PAIRS
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for low, high in blocks(edges, SENT_BYTES):
                part = batch.slice(low, high - low)
                rows = [i for block in _blocks(part.column("text")) for i in model.encode(block)]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *rows])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                columns = [part.column(c) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, ids], [*others, "ids"])
        # The next task of this worker may belong to another query.
        model.words.most, model.max_pairs = MAX_WORDS, MAX_PAIRS
        release()

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.mapInArrow(emit, ", ".join([*fields, "ids array<int>"]))


def decode(ids: Column, path: str) -> Column:
    """The text of ids; bytes that are no character become U+FFFD, null ids an empty text."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        model = PieceModel.at(path)
        out = []
        for one in lists:
            values = one.values
            ids = np.empty(0, np.int32) if values is None else values.to_numpy(zero_copy_only=False)
            out.append(model.decode(ids).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return text_of(ids)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text, and what decoding them gives, as digests.

    Input: ``doc_id``, ``text``; other columns are ignored. Output, one row per input row:
    ``doc_id, n_bytes, n_tokens, ids_crc32`` (of the ids as little-endian 32-bit numbers),
    ``decoded_bytes, decoded_crc32`` and ``same`` (the decoded text is the text; a space mark in
    the text comes back as the space that the model takes it for).

    Defined cases: null and empty texts have no ids and decode to an empty text; long words and
    texts without spaces are searched whole; null or repeated ids and equal rows stay as they are;
    an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: long, ids_crc32: long, bytes: long, crc32: long>")
    def summary(texts: pa.Array) -> pa.Array:
        model = PieceModel.at(path)
        counts, sums, sizes, decoded = [], [], [], []
        for block in _blocks(texts):
            for ids in model.encode(block):
                text = model.decode(ids)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<i4").tobytes()))
                sizes.append(len(text))
                decoded.append(zlib.crc32(text))
        arrays = [pa.array(a, pa.int64()) for a in (counts, sums, sizes, decoded)]
        return pa.StructArray.from_arrays(arrays, ["n_tokens", "ids_crc32", "bytes", "crc32"])

    text = F.coalesce("text", F.lit(""))
    spaced = F.encode(F.replace(text, F.lit(MARK), F.lit(" ")), "UTF-8")
    rows = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.octet_length(spaced).cast("long").alias("spaced_bytes"),
        F.crc32(spaced).alias("spaced_crc32"),
        summary(F.col("text")).alias("s"),
    )
    same = (F.col("s.crc32") == F.col("spaced_crc32")) & (F.col("s.bytes") == F.col("spaced_bytes"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "s.n_tokens",
        "s.ids_crc32",
        F.col("s.bytes").alias("decoded_bytes"),
        F.col("s.crc32").alias("decoded_crc32"),
        same.alias("same"),
    )
