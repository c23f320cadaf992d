"""Token id files: concatenated ids with Elias-Fano document boundaries.

Documents are put in ascending ``doc_id`` order by one range shuffle of their texts and encoded in
that order. A file is Parquet; each of its rows is a segment: the ids of whole documents laid end
to end as 16-bit (or 32-bit) little-endian numbers, the documents' end offsets in Elias-Fano form
with select samples, the documents' ids, and how many ids the file holds before the segment. A
document's global offset is the ids of earlier files, plus those before its segment, plus one
select.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import RecentTable, blocks, text_bytes
from tokenloom.llm.elias_fano import EliasFano
from tokenloom.llm.token_counts import TokenizerFile
from tokenloom.llm.words import byte_table, runs_of
from tokenloom.session import ship_package

END_ID = 0
# Ids of a segment; the document that reaches the bound is its last.
SEGMENT_IDS = 1 << 20
BLOCK_BYTES = 4 << 20
# A space after a character that is none begins a new part of a byte-level text, whatever follows.
PARTS = re.compile(r"(?<=\S) ")
# White space other than the space that may stand before one; such texts are cut with care.
ODD_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
BEFORE_SPACE = [" " + " ", *[c + " " for c in ODD_SPACES]]
# The last bytes of such white space.
ODD_ENDS = byte_table(tuple({pair.encode()[-2] for pair in BEFORE_SPACE}))
# A sentence mark that ends a part after a letter is a part of its own to the library.
MARKS = ".,;:!?"
# Parts whose ids a worker keeps, and parts that the library gets as one text.
MAX_PARTS, JOINED_PARTS = 700_000, 256

FIELDS = (
    "file int, segment int, ids_before long, n_ids long, width int, doc_ids array<{kind}>, "
    "ids binary, count int, low_width int, lower binary, upper binary, samples binary"
)

# Ids of parts in this worker, by tokenizer file.
_KNOWN: dict[str, Parts] = {}


def odd_rows(texts: pa.Array) -> np.ndarray:
    """Which texts hold white space before a space. One look at the bytes finds the few that may."""
    offsets, data = text_bytes(texts)
    places = np.flatnonzero((data[1:] == 32) & ODD_ENDS[data[:-1]]) + 1
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(offsets, places, "right") - 1] = True
    maybe = np.flatnonzero(odd)
    some = texts.take(pa.array(maybe))
    found = np.zeros(len(some), bool)
    for pair in BEFORE_SPACE if len(some) else ():
        found |= pc.match_substring(some, pair).to_numpy(zero_copy_only=False)
    odd[maybe] = found
    return odd


def cut(texts: pa.Array) -> pa.ListArray:
    """Parts of texts without nulls; all but the first had a space before them."""
    odd = odd_rows(texts)
    if not odd.any():
        return pc.split_pattern(texts, " ")
    careful = pa.array([PARTS.split(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
    plain = pc.split_pattern(texts.filter(~odd), " ")
    place = np.empty(len(texts), np.int64)
    place[~odd] = np.arange(len(plain))
    place[odd] = len(plain) + np.arange(len(careful))
    return pa.concat_arrays([plain, careful]).take(pa.array(place))


class Parts:
    """Ids of parts as the tokenizers library gives them: of those that begin a text (``first``),
    and of those after a space: ``names``, with the ids of each end to end in ``flat``. The latter
    are looked up all at once; only those not met lately become Python objects.
    """

    def __init__(self, tokenizer: TokenizerFile):
        self.library = tokenizer.load()
        self.kind = id_type(tokenizer)
        self.first = RecentTable(MAX_PARTS)
        self.names = pa.array([], pa.string())
        self.flat, self.edges = np.empty(0, self.kind), np.zeros(1, np.int64)
        # The block that used a part last.
        self.used, self.block = np.empty(0, np.int64), 0
        # Ids that begin with a space, which byte-level pieces write as this letter.
        names = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    @staticmethod
    def of(tokenizer: TokenizerFile) -> Parts:
        if tokenizer.path not in _KNOWN:
            _KNOWN[tokenizer.path] = Parts(tokenizer)
        return _KNOWN[tokenizer.path]

    def _singly(self, parts: list[str], before: str) -> list[bytes]:
        given = [before + part for part in parts]
        found = self.library.encode_batch_fast(given, add_special_tokens=False)
        return [np.array(one.ids, self.kind).tobytes() for one in found]

    def begins(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that begin a text."""
        fresh = self.first.missing(parts)
        self.first.learn(fresh, self._singly(fresh, ""))
        return self.first.values(parts)

    def follow(self, parts: pa.StringArray) -> np.ndarray:
        """Places of distinct parts after a space among ``names``. Where a sentence mark ends a part
        after a letter, the library cuts it off, so the part before it is looked up as well.
        """
        self._forget(len(parts))
        places = self._places(parts)
        fresh = parts.filter(pa.array(places < 0)).to_pylist()
        cut_off = [p for p in fresh if len(p) > 1 and p[-1] in MARKS and p[-2].isalpha()]
        whole = set(fresh).difference(cut_off)
        bare = list({p[:-1] for p in cut_off}.difference(whole))
        known = dict(zip(bare, self._places(pa.array(bare, pa.string())).tolist()))
        whole.update(p for p in bare if known[p] < 0)
        new = self._encoded(list(whole))
        marks = dict(zip(MARKS, self.begins(list(MARKS))))
        for part in cut_off:
            ids = new.get(part[:-1])
            if ids is None:
                at = known[part[:-1]]
                ids = self.flat[self.edges[at] : self.edges[at + 1]].tobytes()
            new[part] = ids + marks[part[-1]]
        at = dict(zip(new, range(len(self.names), len(self.names) + len(new))))
        self._learn(new)
        places[places < 0] = [at[part] for part in fresh]
        return places

    def _places(self, parts: pa.StringArray) -> np.ndarray:
        """Where distinct parts are among ``names``, or -1. The few parts are made a table, not the
        many names.
        """
        at = pc.index_in(self.names, value_set=parts)
        found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        places = np.full(len(parts), -1)
        places[at.drop_null().to_numpy()] = found
        self.used[found] = self.block
        return places

    def _encoded(self, fresh: list[str]) -> dict[str, bytes]:
        """The space before a part begins a new piece, unless white space stands before it. So parts
        go to the library end to end, and come apart where an id begins with a space.
        """
        alone = [p for p in fresh if not p or " " in p or p[-1].isspace()]
        new = dict(zip(alone, self._singly(alone, " ")))
        joined = [p for p in fresh if p not in new]
        runs = [joined[i : i + JOINED_PARTS] for i in range(0, len(joined), JOINED_PARTS)]
        given = [" " + " ".join(run) for run in runs]
        for run, one in zip(
            runs, self.library.encode_batch_fast(given, add_special_tokens=False)
        ):
            ids = np.array(one.ids, self.kind)
            edges = np.flatnonzero(self.spaced[ids])
            if len(edges) != len(run) or edges[0]:
                new.update(zip(run, self._singly(run, " ")))
                continue
            data, edges = ids.tobytes(), np.append(edges, len(ids)) * ids.itemsize
            ends = edges.tolist()
            new.update(zip(run, [data[a:b] for a, b in zip(ends, ends[1:])]))
        return new

    def _forget(self, more: int) -> None:
        """Before a block of ``more`` parts: where these would pass ``MAX_PARTS``, half of them stay,
        those used last.
        """
        self.block += 1
        if len(self.names) + more <= MAX_PARTS:
            return
        kept = np.sort(np.argsort(-self.used, kind="stable")[: MAX_PARTS // 2])
        sizes = np.diff(self.edges)[kept]
        self.flat = self.flat[runs_of(self.edges[kept], sizes)]
        self.edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.names, self.used = self.names.take(pa.array(kept)), self.used[kept]

    def _learn(self, new: dict[str, bytes]) -> None:
        sizes = np.array([len(ids) for ids in new.values()], np.int64) // self.flat.itemsize
        self.names = pa.concat_arrays([self.names, pa.array(list(new), pa.string())])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(new.values()), self.kind)])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.full(len(new), self.block)])


def encode_texts(tokenizer: TokenizerFile, texts: pa.Array) -> list[bytes]:
    """Ids of whole texts as the tokenizers library gives them, as 16-bit numbers where the
    vocabulary allows; a null text is empty. The library splits byte-level text at such spaces
    before it merges, so each distinct part is encoded once.
    """
    known = Parts.of(tokenizer)
    rows = cut(texts.fill_null("") if texts.null_count else texts)
    offsets = rows.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    parts = rows.flatten()
    heads = known.begins(parts.take(pa.array(offsets[:-1])).to_pylist())
    after = np.ones(len(parts), bool)
    after[offsets[:-1]] = False
    tails = parts.filter(pa.array(after)).dictionary_encode()
    found = known.follow(tails.dictionary)
    # Ids of all tails end to end, gathered from those of the distinct ones.
    codes = found[tails.indices.to_numpy()]
    starts = known.edges[codes]
    sizes = known.edges[codes + 1] - starts
    ids = known.flat[runs_of(starts, sizes)]
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    edges = edges[offsets - np.arange(len(offsets))].tolist()
    return [head + ids[a:b].tobytes() for head, a, b in zip(heads, edges, edges[1:])]


def id_type(tokenizer: TokenizerFile) -> str:
    return "<u2" if tokenizer.load().get_vocab_size() <= 1 << 16 else "<u4"


def splits_at_spaces(tokenizer: TokenizerFile) -> bool:
    """Whether the library itself never joins a part to the space of the next one."""
    import json

    library = json.loads(tokenizer.load().to_str())
    before = library["pre_tokenizer"] or {}
    return (
        library["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", False)
        and not before.get("add_prefix_space", True)
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in library["added_tokens"])
    )


def write_token_files(docs: DataFrame, tokenizer: TokenizerFile, path: str) -> None:
    """Encode all documents and write the files; an existing folder is replaced as a whole.

    Each document is followed by one ``END_ID``. Null ids of documents come first, documents of
    one id follow each other by a hash of their texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    if not splits_at_spaces(tokenizer):
        raise ValueError("the tokenizer is no byte-level one that splits at spaces")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # The range bounds come from a sample of the two keys; texts are encoded after the shuffle.
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = rows.select("doc_id", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        dtype = id_type(tokenizer)
        width = int(dtype[-1])
        end = np.array([END_ID], dtype).tobytes()
        segment = before = held = 0
        ids: list[bytes] = []
        owners: list[pa.Array] = []

        def row() -> pa.RecordBatch:
            nonlocal segment, before, held, ids, owners
            ends = np.cumsum([len(i) // width for i in ids])
            code = EliasFano.of(ends)
            values = [file, segment, before, held, width, None, b"".join(ids)]
            values += [code.count, code.width, code.lower, code.upper, code.samples]
            names = [f.split(" ")[0] for f in FIELDS.split(", ")]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), None, pa.binary()]
            types += [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            docs_of = pa.concat_arrays(owners)
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(docs_of)], pa.int32()), docs_of)
                if t is None
                else pa.array([v], t)
                for v, t in zip(values, types)
            ]
            segment, before = segment + 1, before + held
            ids, owners, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for low, high in blocks(text_bytes(texts)[0], BLOCK_BYTES):
                found = encode_texts(tokenizer, texts[low:high])
                since = low
                for i, own in enumerate(found, low):
                    ids += [own + end]
                    held += len(own) // width + 1
                    if held >= SEGMENT_IDS:
                        owners.append(doc_ids[since : i + 1])
                        since = i + 1
                        yield row()
                if since < high:
                    owners.append(doc_ids[since:high])
        if ids:
            yield row()

    rows.mapInArrow(emit, FIELDS.format(kind=kind)).write.mode("overwrite").parquet(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens`` (with the end id) and ``ids_crc32`` of its ids as 32-bit numbers.
    """
    ship_package(spark)
    files = spark.read.parquet(path)
    # One row per file; the window orders files, never documents.
    sizes = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("file").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    joined = files.join(F.broadcast(offsets), F.col("file") == F.col("of"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                code = EliasFano(
                    *[cell[n].as_py() for n in ("count", "low_width", "lower", "upper", "samples")]
                )
                ends = code.all()
                starts = np.concatenate([[0], ends[:-1]])
                dtype = f"<u{cell['width'].as_py()}"
                ids = np.frombuffer(cell["ids"].as_buffer(), dtype).astype("<u4")
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                base = cell["base"].as_py() + cell["ids_before"].as_py()
                columns = [
                    cell["doc_ids"].values,
                    pa.array(base + starts, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(emit, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def find_offsets(wanted: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of the documents that ``wanted`` names by ``doc_id``, one row per
    document of the files: two selects each, without reading ids or the offsets of others.

    Defined cases: an id named twice is found once, a null or unknown one not at all; a repeated id
    of the files gives all its documents; other columns are ignored; empty tables give no rows.
    """
    spark = wanted.sparkSession
    ship_package(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    places = files.select("file", "segment", F.posexplode("doc_ids").alias("at", "doc_id"))
    places = places.join(wanted.select(F.col("doc_id").cast(kind)).distinct(), "doc_id")
    # A segment has at most SEGMENT_IDS documents, as each has an end id.
    asked = places.groupBy("file", "segment").agg(
        F.collect_list(F.struct("at", "doc_id")).alias("asked")
    )
    codes = ["count", "low_width", "lower", "upper", "samples"]
    rows = files.select("file", "segment", "ids_before", *codes).join(asked, ["file", "segment"])
    rows = rows.join(F.broadcast(offsets), "file")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                code = EliasFano(*[cell[n] for n in codes])
                before = cell["base"] + cell["ids_before"]
                at = [one["at"] for one in cell["asked"]]
                starts = [code.select(i - 1) if i else 0 for i in at]
                sizes = [code.select(i) - start for i, start in zip(at, starts)]
                columns = [
                    pa.array([one["doc_id"] for one in cell["asked"]], batch_kind(batch)),
                    pa.array([before + start for start in starts], pa.int64()),
                    pa.array(sizes, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens"])

    def batch_kind(batch: pa.RecordBatch) -> pa.DataType:
        return batch.schema.field("asked").type.value_type.field("doc_id").type

    return rows.mapInArrow(emit, f"doc_id {kind}, start long, n_tokens long")


def token_files(docs: DataFrame, tokenizer: TokenizerFile, path: str) -> DataFrame:
    """Write all documents' ids to files at ``path`` and read the offsets back from them.

    Input: ``doc_id``, ``text``; other columns are ignored. Output, one row per input row:
    ``doc_id, start, n_tokens, ids_crc32``.

    Defined cases: null and empty texts have the end id alone; null ids of documents come first;
    documents of one id keep a fixed order by their texts; special strings inside a text are what
    the library makes of them; an empty table gives no file rows and an empty result.
    """
    write_token_files(docs, tokenizer, path)
    return read_offsets(docs.sparkSession, path)
