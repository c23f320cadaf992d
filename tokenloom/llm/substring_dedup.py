"""Removal of long byte strings that occur in an earlier document.

Every 50-byte window holds a least-hash 16-byte gram, its anchor, at a place that its bytes alone
decide; equal windows have equal anchors. So windows are compared only where their anchor occurs in
two different texts. Each such anchor brings along the stretch of bytes that its windows cover;
stretches of one anchor meet in one task, equal stretches are settled at once, and the others are
laid end to end in blocks whose Burrows-Wheeler transform is expanded breadth first to the least
length: suffixes that no shorter prefix told apart are equal windows.

Copies never travel together: equal texts are one text, and a task sends an anchor, or a stretch,
of many texts on only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import blocks, mix, release, text_bytes, text_parts
from tokenloom.llm.common_keys import common_keys
from tokenloom.llm.shuffles import dropped_shuffles
from tokenloom.llm.suffix_intervals import equal_prefixes
from tokenloom.session import materialize, ship_package

# Least length of a repeated string, bytes of an anchor, and anchors to choose from in a window.
LENGTH, GRAM = 50, 16
CHOICES = LENGTH - GRAM + 1
# Bytes of stretches that one transform covers.
TRANSFORM_BYTES = 1 << 19
# Bytes of texts whose stretches a worker holds at once, and of stretches that meet at once; the
# stretches of one anchor always do.
PART_BYTES, MEETING_BYTES = 8 << 20, 4 << 20
# Windows that begin at least this far before their anchor hold as many bytes before it; the
# others hold as many after it.
SIDE = (CHOICES - 1) // 2
LAST = (1 << 63) - 1
HALF = np.uint64(0x9E3779B97F4A7C15)
UPPER = np.uint64(0xFFFFFFFF00000000)


def stretches(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in a block of texts: the anchor's hash and place, the first
    window's start, the number of windows, and the row.
    """
    windows = len(data) - LENGTH + 1
    empty = np.empty(0, np.int64)
    if windows <= 0:
        return empty.view(np.uint64), empty, empty, empty, empty
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), np.uint64, buffer=data.data, strides=(1,))
    grams = mix(mix(words[: len(data) - GRAM + 1] ^ HALF) + words[8 : len(data) - GRAM + 9])
    # The leftmost of the least hashes, by their upper halves; the lower half is the place. The
    # least of 2, 4, ... 32 neighbours, and of two such runs for a window's choices.
    least = (grams & UPPER) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= CHOICES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[CHOICES - span : CHOICES - span + windows])
    # Where a text's windows begin and end, and where the anchor changes.
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    low, high = offsets[long], offsets[long + 1] - LENGTH + 1
    edge = np.zeros(windows + 1, np.int8)
    edge[low], edge[high] = 1, -1
    inside = np.cumsum(edge, dtype=np.int8)[:windows].view(bool)
    new = edge != 0
    new[1:windows] |= least[1:] != least[:-1]
    first = np.flatnonzero(inside & new[:-1])
    counts = np.flatnonzero(inside & new[1:]) + 1 - first
    place = (least[first] & ~UPPER).astype(np.int64)
    return grams[place], place, first, counts, np.searchsorted(offsets, first, "right") - 1


def _block_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of each block of a batch."""
    offsets, data = text_bytes(texts)
    for low, high in blocks(offsets, 1 << 20):
        part = offsets[low : high + 1]
        yield low, part - part[0], data[part[0] : part[-1]]


def anchor_keys(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct anchors of every text."""
    for _, offsets, data in _block_rows(texts):
        hashes, _, _, _, row = stretches(data, offsets)
        edges = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(edges[:-1], edges[1:]):
            yield np.unique(hashes[a:b])


def shared_anchors(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """``(text_id, anchors)``: the anchors of a text that another text has too, without those of
    the common list. ``texts`` is ``(text_id, text)``; equal texts have equal ids.
    """
    skipped = np.sort(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("text_id").to_numpy()
            fresh = np.zeros(len(ids), bool)  # one of the equal texts of a batch
            fresh[np.unique(ids, return_index=True)[1]] = True
            for low, offsets, data in _block_rows(batch.column("text")):
                hashes, _, _, _, row = stretches(data, offsets)
                kept = fresh[low + row]
                if len(skipped):
                    at = np.minimum(np.searchsorted(skipped, hashes), len(skipped) - 1)
                    kept &= skipped[at] != hashes
                # 48 bits of the anchor's hash: a chance meeting only costs a comparison.
                hashes = (hashes[kept] >> np.uint64(16)).view(np.int64)
                owner = ids[low + row[kept]]
                by = np.lexsort((hashes, row[kept]))
                hashes, owner = hashes[by], owner[by]
                new = np.ones(len(by), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[new]), pa.array(owner[new])], ["anchor", "text_id"]
                )

    rows = texts.mapInArrow(emit, "anchor long, text_id long")
    over = Window.partitionBy("anchor")
    rows = rows.withColumn("l", F.min("text_id").over(over))
    rows = rows.withColumn("h", F.max("text_id").over(over)).filter("l < h")
    return rows.groupBy("text_id").agg(F.collect_set("anchor").alias("anchors"))


PIECE = (
    "key long, text_id long, rank long, starts array<long>, windows int, place int, stretch binary"
)


def text_stretches(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """Stretches of the texts' shared anchors, as ``PIECE``. ``texts`` is
    ``(text_id, rank, text, anchors)``, a text's rank being its smallest document.

    Stretches meet by their anchor. Those of a very common anchor are cut in two, the windows that
    hold ``SIDE`` bytes before the anchor and those that hold as many after it, and meet by these
    longer strings instead. Of equal stretches in a batch only those of the text of least rank are
    sent on, as one row; the others are repeats and leave as finished cuts, with no stretch.
    """
    skipped = np.sort(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, limit=PART_BYTES):
            ids = batch.column("text_id").to_numpy()
            ranks = batch.column("rank").to_numpy()
            lists = batch.column("anchors")
            found, cells = [], []
            for low, offsets, data in _block_rows(batch.column("text")):
                hashes, place, start, windows, row = stretches(data, offsets)
                # Row and anchor as one number each, for the stretches and for the lists.
                part = lists.slice(low, len(offsets) - 1)
                sizes = part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                wanted = mix(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                wanted ^= np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
                kept = np.isin(mix(hashes >> np.uint64(16)) ^ row.astype(np.uint64), wanted)
                usual = np.zeros(len(hashes), bool)
                if len(skipped):
                    at = np.minimum(np.searchsorted(skipped, hashes), len(skipped) - 1)
                    usual = skipped[at] == hashes
                # Those of common anchors in two parts.
                plain, two = np.flatnonzero(kept & ~usual), np.flatnonzero(usual)
                which, bound, first, count = _sides(place[two], start[two], windows[two])
                two = two[which]
                key = (hashes[plain] >> np.uint64(16)).view(np.int64)
                key = np.concatenate([key, _side_keys(data, bound)])
                first = np.concatenate([start[plain], first])
                count = np.concatenate([windows[plain], count])
                of = np.concatenate([plain, two])
                found.append((key, low + row[of], first - offsets[row[of]], count, place[of] - first))
                cells.append(_slices(data, first, first + count + LENGTH - 1))
            if not found:
                continue
            # The blocks' cells go before the distinct ones are made.
            cells = pa.concat_arrays(cells)
            code, cells = _codes(cells)
            found = list(map(np.concatenate, zip(*found)))
            yield _sent(ids, ranks, *found, code, cells)
            del found, code, cells
        release()

    return texts.mapInArrow(emit, PIECE)


def _sides(
    at: np.ndarray, start: np.ndarray, windows: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of anchors at ``at`` in two parts: those that hold the ``SIDE`` bytes before it,
    and those that hold as many after it. Gives the anchor's number, the place of these bytes and
    the anchor together, the first window and the number of windows of every part.
    """
    before = np.clip(at - SIDE - start + 1, 0, windows)
    a, b = np.flatnonzero(before), np.flatnonzero(before < windows)
    return (
        np.concatenate([a, b]),
        np.concatenate([at[a] - SIDE, at[b]]),
        np.concatenate([start[a], start[b] + before[b]]),
        np.concatenate([before[a], windows[b] - before[b]]),
    )


def _side_keys(data: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A hash of the ``SIDE + GRAM`` bytes at every place; a chance meeting only costs a comparison."""
    if not len(bound):
        return np.empty(0, np.int64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), np.uint64, buffer=data.data, strides=(1,))
    key = np.full(len(bound), HALF)
    for k in [*range(0, SIDE + GRAM - 7, 8), SIDE + GRAM - 8]:
        key = mix(key + words[bound + k])
    return key.view(np.int64)


def _slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())


def _cells(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of binary cells."""
    cells = cells.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset :][: len(cells) + 1]
    data = cells.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _codes(cells: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every cell, equal for equal bytes, and the distinct cells in their order."""
    cells = cells.dictionary_encode()
    return cells.indices.to_numpy().astype(np.int64), cells.dictionary


def _later(code: np.ndarray, rank: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """The least rank of every code, and which rows are of a higher one."""
    least = np.full(codes, LAST)
    np.minimum.at(least, code, rank)
    return least, rank > least[code]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _joined(
    text: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of bytes of texts, those of one text that overlap or touch as one; sorted."""
    by = np.lexsort((low, text))
    text, low, high = text[by], low[by], high[by]
    new = _new(text)
    number = np.cumsum(new) << 32
    reach = np.maximum.accumulate(number + high) - number
    new[1:] |= low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return text[first], low[first], reach[np.append(first[1:], len(text)) - 1] if len(text) else high


def _sent(ids, ranks, key, row, start, windows, place, code, distinct: pa.Array) -> pa.RecordBatch:
    """``PIECE`` of the stretches of a part of a batch: of equal ones those of the least rank, one
    row for each text, as texts of one document are not earlier than each other; the others as
    finished cuts, which go to any task.
    """
    text, rank = ids[row], ranks[row]
    _, later = _later(code, rank, len(distinct))
    gone = np.flatnonzero(later)
    cut_text, low, high = _joined(text[gone], start[gone], start[gone] + windows[gone] + LENGTH - 1)
    by_text = np.argsort(ids, kind="stable")
    cut_rank = ranks[by_text[np.searchsorted(ids[by_text], cut_text)]]
    kept = np.flatnonzero(~later)
    kept = kept[np.lexsort((start[kept], text[kept], code[kept]))]
    edges = np.flatnonzero(_new(code[kept], text[kept]))
    first = kept[edges]
    finished = np.arange(len(first) + len(low)) >= len(first)
    lists = np.concatenate([edges, len(kept) + np.arange(len(low) + 1)])
    columns = [
        np.concatenate([key[first], cut_text]),
        np.concatenate([text[first], cut_text]),
        np.concatenate([rank[first], cut_rank]),
        pa.ListArray.from_arrays(
            pa.array(lists, pa.int32()), pa.array(np.concatenate([start[kept], low]), pa.int64())
        ),
        np.concatenate([windows[first], high - low - LENGTH + 1]).astype(np.int32),
        np.concatenate([place[first], np.zeros(len(low), np.int64)]).astype(np.int32),
        distinct.take(pa.array(np.append(code[first], np.zeros(len(low), np.int64)), mask=finished)),
    ]
    names = ["key", "text_id", "rank", "starts", "windows", "place", "stretch"]
    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(columns, names)


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted task in tables of some ``MEETING_BYTES``, no key in two of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        last = batch.column("key")[-1]
        if size >= MEETING_BYTES and held[0].column("key")[0] != last:
            table = pa.Table.from_batches(held)
            at = int(np.searchsorted(table.column("key").to_numpy(), last.as_py()))
            yield table.slice(0, at)
            held = table.slice(at).to_batches()
            size = sum(b.nbytes for b in held)
            del table
    if held:
        yield pa.Table.from_batches(held)


def _ranges(low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``low, low + 1, ...``, as many as counted, one range after the other."""
    return np.arange(int(counts.sum())) + np.repeat(low - np.cumsum(counts) + counts, counts)


class Meeting:
    """Stretches of whole anchors; finds their windows of a smaller rank."""

    def __init__(self, table: pa.Table) -> None:
        key, self.text, self.rank, starts, windows, place, stretch = (
            table.column(i).combine_chunks() for i in range(7)
        )
        self.text, self.rank = self.text.to_numpy(), self.rank.to_numpy()
        self.first = starts.offsets.to_numpy().astype(np.int64)
        self.starts = starts.values.to_numpy()
        self.cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = windows.to_numpy().astype(np.int64) + LENGTH - 1
        finished = stretch.is_null().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(finished)
        self._cut(rows, 0, size[rows])
        rows = np.flatnonzero(~finished)
        self._meet(rows, key.to_numpy(), place.to_numpy(), size, stretch.take(pa.array(rows)))

    def _cut(self, rows: np.ndarray, first, size) -> None:
        """Cut ``size`` bytes from ``first`` on off the stretch of every row, wherever it starts."""
        counts = self.first[rows + 1] - self.first[rows]
        low = self.starts[_ranges(self.first[rows], counts)]
        low = low + np.repeat(np.broadcast_to(first, rows.shape), counts)
        high = low + np.repeat(size, counts)
        self.cuts.append((np.repeat(self.text[rows], counts), low, high))

    def _meet(self, rows, key, place, size, stretch: pa.Array) -> None:
        """Settle equal stretches, keep one of each of an anchor that has several, and of those
        again only parts that have the bytes on one side of the anchor in common.
        """
        code, distinct = _codes(stretch)
        _, later = _later(code, self.rank[rows], len(distinct))
        self._cut(rows[later], 0, size[rows[later]])
        _, model = np.unique(code, return_index=True)
        model = rows[model]
        _, anchor, members = np.unique(key[model], return_inverse=True, return_counts=True)
        several = members[anchor] > 1
        some = np.flatnonzero(several)
        offsets, data = _cells(distinct)
        which, bound, first, count = _sides(
            offsets[some] + place[model[some]], offsets[some], size[model[some]] - LENGTH + 1
        )
        which = some[which]
        side = _side_keys(data, bound)
        part, distinct = _codes(_slices(data, first, first + count + LENGTH - 1))
        # The owners of every part: those of its stretch.
        own = np.flatnonzero(~later & several[code])
        own = own[np.argsort(code[own], kind="stable")]
        low = np.searchsorted(code[own], which)
        counts = np.searchsorted(code[own], which, "right") - low
        rows = rows[own[_ranges(low, counts)]]
        shift = np.repeat(first - offsets[which], counts)
        length = np.repeat(count + LENGTH - 1, counts)
        part_of = np.repeat(part, counts)
        least, later = _later(part_of, self.rank[rows], len(distinct))
        self._cut(rows[later], shift[later], length[later])
        by = np.flatnonzero(~later)
        by = by[np.argsort(part_of[by], kind="stable")]
        self.owners = rows[by], shift[by], part_of[by]
        # Parts of one side next to each other, in blocks that end with a side.
        _, model = np.unique(part, return_index=True)
        _, side, members = np.unique(side[model], return_inverse=True, return_counts=True)
        parts = np.flatnonzero(members[side] > 1)
        parts = parts[np.argsort(side[parts], kind="stable")]
        offsets, data = _cells(distinct)
        ends = np.cumsum(offsets[parts + 1] - offsets[parts] + 1)
        edges = np.append(np.flatnonzero(_new(side[parts])), len(parts))
        low = 0
        while low < len(parts):
            full = (ends[low - 1] if low else 0) + TRANSFORM_BYTES
            high = edges[np.searchsorted(edges, min(len(parts), np.searchsorted(ends, full) + 1))]
            self._transform(parts[low:high], least, offsets, data)
            low = int(high)

    def _transform(self, parts, least, offsets, data: np.ndarray) -> None:
        size = offsets[parts + 1] - offsets[parts] + 1
        ends = np.cumsum(size)
        begin = ends - size
        symbols = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = data[_ranges(offsets[parts], size - 1)].astype(np.int64) + 1
        owner = np.repeat(np.arange(len(parts)), size)
        rank = least[parts][owner]
        room = ends[owner] - 1 - np.arange(len(symbols))  # bytes up to the end of the stretch
        order, new = equal_prefixes(symbols, LENGTH)
        whole = room[order] >= LENGTH
        group = np.cumsum(new)[whole]
        order = order[whole]
        if not len(order):
            return
        edges = np.flatnonzero(_new(group))
        low = np.minimum.reduceat(rank[order], edges)
        low = np.repeat(low, np.diff(np.append(edges, len(order))))
        repeated = np.sort(order[low < rank[order]])
        if not len(repeated):
            return
        # Runs of neighbouring places in one part, and the owners of this part.
        new = _new(owner[repeated])
        new[1:] |= np.diff(repeated) > 1
        first = repeated[new]
        last = repeated[np.append(np.flatnonzero(new)[1:], len(repeated)) - 1]
        rows, shift, part_of = self.owners
        part = parts[owner[first]]
        low = np.searchsorted(part_of, part)
        counts = np.searchsorted(part_of, part, "right") - low
        at = _ranges(low, counts)
        moved = shift[at] + np.repeat(first - begin[owner[first]], counts)
        self._cut(rows[at], moved, np.repeat(last - first + LENGTH, counts))

    def taken(self) -> pa.RecordBatch:
        columns = _joined(*map(np.concatenate, zip(*self.cuts)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["text_id", "low", "high"]
        )


def repeated_windows(pieces: DataFrame) -> DataFrame:
    """``(text_id, low, high)``: byte ranges of texts that an earlier text has too."""
    rows = pieces.repartition("key").sortWithinPartitions("key")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_anchors(batches):
            yield Meeting(table).taken()
            del table
        release()

    return rows.mapInArrow(emit, "text_id long, low long, high long")


def _merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(r) for r in out]


def first_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_ids(text: Column, clashes: list[list[int]]) -> list[Column]:
    """``text_id`` and ``check`` of a text, two hashes of it. ``clashes`` lists the ids that turned
    out to belong to different texts, round by round; these texts get an id made of both hashes.
    """
    check = F.xxhash64(F.lit("check"), text)
    text_id = first_hash(text)
    for number, ids in enumerate(clashes):
        apart = F.xxhash64(F.lit(number), text_id, check)
        text_id = F.when(text_id.isin(ids), apart).otherwise(text_id)
    return [text_id.alias("text_id"), check.alias("check")]


def removed_ranges(docs: DataFrame) -> tuple[DataFrame, list[list[int]]]:
    """``(text_id, check, rank, cuts)`` of every distinct text: its smallest document, and the
    ranges of bytes to remove from it there. In a document that is not the smallest the whole text
    repeats. Also the clashes with which ``text_ids`` tells all texts apart.

    Ids of 64 bits travel, as few tables have two texts of one id. Whether this one has is seen
    from the second hashes of each id; only then the texts' anchors are sought again, under ids
    that differ. The list grows with the square of the texts: some three ids of 10^10 texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    clashes: list[list[int]] = []
    with dropped_shuffles(spark):
        common = common_keys(
            docs.filter(F.octet_length("text") >= LENGTH).select("text"), anchor_keys
        )
        while True:
            rows = docs.select(
                F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"),
                *text_ids(F.col("text"), clashes),
                "text",
            ).filter(F.octet_length("text") >= LENGTH)
            shared = shared_anchors(rows.select("text_id", "text"), common)
            ranks = rows.groupBy("text_id").agg(
                F.min("rank").alias("rank"),
                F.min("check").alias("check"),
                F.max("check").alias("other"),
            )
            texts = materialize(ranks.join(shared, "text_id", "left"), "text-anchors")
            met = texts.filter("check != other").select("text_id").toArrow()
            if not met.num_rows:
                break
            clashes.append(met.column("text_id").to_pylist())
        # Ids and ranks together spread copies of one text over all tasks.
        found = rows.drop("check").join(texts, ["text_id", "rank"])
        found = found.select("text_id", "rank", "text", "anchors")
        cuts = repeated_windows(text_stretches(found, common))
        cuts = cuts.groupBy("text_id").agg(F.collect_set(F.struct("low", "high")).alias("cuts"))
        ranges = texts.select("text_id", "check", "rank").join(cuts, "text_id", "left")
        return materialize(ranges, "cuts"), clashes


def cut_texts(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay (null for a null text),
    of every document; the columns of ``docs`` other than ``text`` come as ``c0, c1, ...`` in
    their order, so that none of their names can clash. With ``characters``, ``kept`` is a text of
    the characters that stay whole; a second Python step for it would need as many workers again.
    """
    kind = pa.string() if characters else pa.binary()
    ranges, clashes = removed_ranges(docs)
    others = [n for n in docs.columns if n != "text"]
    carried = [f"c{i}" for i in range(len(others))]
    rows = docs.select(
        *[F.col(n).alias(c) for n, c in zip(others, carried)],
        "text",
        *text_ids(F.col("text"), clashes),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("own"),
    )
    rows = rows.join(ranges, ["text_id", "check"], "left")
    later = F.coalesce(F.col("own") > F.col("rank"), F.lit(False))
    rows = rows.select(*carried, "text", later.alias("later"), "cuts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            offsets, data = text_bytes(texts)
            valid = texts.is_valid().to_pylist()
            later = batch.column("later").to_pylist()
            cuts = batch.column("cuts")
            removed, spans, kept = [], [], []
            for i in range(len(later)):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                found = [(0, len(own))]
                if not later[i]:
                    found = _merged([(r["low"], r["high"]) for r in cuts[i].as_py() or ()])
                edges = [0, *[e for r in found for e in r], len(own)]
                stays = b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2]))
                if not valid[i]:
                    kept.append(None)
                else:
                    kept.append(stays.decode("utf-8", "ignore") if characters else stays)
                removed.append(len(own) - len(stays))
                spans.append(len(found))
            columns = [batch.column(n) for n in carried]
            columns += [pa.array(np.diff(offsets)), pa.array(removed, pa.int64())]
            columns += [pa.array(spans, pa.int64()), pa.array(kept, kind)]
            names = [*carried, "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried]
    fields += ["n_bytes long, n_removed long, n_spans long", f"kept {kind}"]
    return rows.mapInArrow(emit, ", ".join(fields))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Bytes of every whole text that are covered by a 50-byte string of an earlier document.

    Input: ``doc_id`` (whole numbers), ``text``; other columns are ignored. Output, one row per
    input row: ``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept_sha256``
    of the bytes that stay, laid end to end.

    Defined cases: null and short texts lose nothing, and a null text is empty; a null ``doc_id``
    is later than all others; rows of one ``doc_id`` are no earlier than each other, so they lose
    nothing to each other; an empty table gives an empty result. Texts are told apart by 128 bits
    of hashes, windows by their bytes.
    """
    rows = cut_texts(docs.select("doc_id", "text"))
    kept = F.coalesce(F.col("kept"), F.lit(b""))
    return rows.select(
        F.col("c0").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """Documents with repeated strings cut out of ``text``; a character that a cut leaves in part
    goes with it. ``n_chars``, where there is one, is counted anew; null texts stay null. A
    document of which nothing stays has an empty text.
    """

    others = [n for n in docs.columns if n != "text"]
    rows = cut_texts(docs, characters=True).select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(others)],
        F.col("kept").alias("text"),
    )
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.length("text").cast(kind))
    return rows.select(*docs.columns)
