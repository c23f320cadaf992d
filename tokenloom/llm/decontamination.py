"""Benchmark decontamination by q-gram counting in diagonal bands.

An item is searched in overlapping segments, one of up to 128 bytes whole as well. A text region within ``e`` edits of
a segment of ``m`` bytes shares at least ``m - q + 1 - q * e`` of its q-grams with it, and all of them lie on ``e + 1``
neighbouring diagonals (place in the text minus place in the item). So shared q-grams are counted
per segment and band of ``2 (e + 1)`` diagonals, bands overlapping by half; only bands that reach
the bound are aligned, and the banded alignment decides.

A q-gram is posted once per place in an item. Shared q-grams that follow each other on a diagonal
are met once, as a run: only places whose byte before differs from the text's begin one. A run that
covers a segment is a verbatim copy of it and needs no alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.batches import blocks, release, text_bytes
from tokenloom.llm.words import runs_of
from tokenloom.session import materialize, ship_package

Q = 8
# Longest item that is also searched whole, segment of a longer one, step between segments, and
# edits allowed per byte of a segment (or whole item).
WHOLE, SEGMENT, STEP, EDIT_RATE = 128, 64, 16, 0.1
# Every verbatim part of an item with so many normalised bytes holds a whole segment.
FRAGMENT = SEGMENT + STEP - 1
# Items with fewer normalised bytes are only found verbatim and between word boundaries.
SHORT_BYTES = 32
# Items with fewer normalised bytes are too common as text for a document to be dropped.
MIN_DROP_BYTES = 16
# Item bytes sent to the tasks at once; a larger benchmark is searched block by block.
ITEM_BLOCK_BYTES = 4 << 20
# Runs, and pairs of a run and a segment, that are worked on at once.
SLICE_RUNS, SLICE_PAIRS = 1 << 17, 1 << 18
# Text places past a slice that a region which begins in it may reach.
REGION = WHOLE + 4 * (int(EDIT_RATE * WHOLE) + 1) + Q
# Bytes of text searched at once; one longer text is searched on its own.
BLOCK = 1 << 19
HASH_BITS = 22
FAR = 30_000
# Marks of a place without a byte before it, in an item and in a text.
ITEM_START, TEXT_START, BYTES_BEFORE = 256, 257, 258
BAND_BITS = 34
LEAK_FIELDS = "item_id long, span_start long, span_end long, edits int"
_ALNUM = np.zeros(256, np.bool_)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII letters in lower case, white space runs as one space; and where each byte was."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    kept = ~space
    kept[1:] |= ~space[:-1]
    if len(data):
        kept[0] = True
    at = np.flatnonzero(kept)
    return np.where(space[at], np.uint8(32), data[at]), at


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), np.uint64, buffer=data.data, strides=(1,))


def segments_of(size: int) -> list[tuple[int, int]]:
    """(low, high) of the segments of an item of ``Q`` bytes or more. Each 128 bytes of a longer one
    that begin at a multiple of 64 or end it hold two segments side by side, of which one has at
    most half of any edits.
    """
    if size <= SEGMENT:
        return [(0, size)]
    lows = {*range(0, size - SEGMENT + 1, STEP), max(0, size - 2 * SEGMENT), size - SEGMENT}
    return [(low, low + SEGMENT) for low in sorted(lows)]


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), np.bool_), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[by], first) if len(first) else counts[:0]


@dataclass
class ItemIndex:
    """Benchmark items, their segments, and the places of their q-grams."""

    ids: np.ndarray  # id of each item
    data: np.ndarray  # normalised bytes of all items, end to end, and eight more
    edges: np.ndarray  # where each item begins in them, and the end
    codes: np.ndarray  # sorted distinct q-grams
    keys: np.ndarray  # of each posting its q-gram's number and the byte before it, sorted
    places: np.ndarray  # place of each posting in the bytes
    owners: np.ndarray  # its item
    items: np.ndarray  # item of each segment: first those of ``segments_of``, by item and place
    lows: np.ndarray  # first byte of each segment in its item
    lengths: np.ndarray  # bytes of each segment
    regular: int  # segments of ``segments_of``
    whole: np.ndarray  # the segment that is the whole of each longer item, or -1
    tiny: dict[int, tuple[np.ndarray, np.ndarray]]  # by length below ``Q``: contents, items

    @property
    def edits(self) -> np.ndarray:
        """Edit budget of each segment: a share of the length, and small enough for the bound to
        be positive.
        """
        budget = np.minimum((EDIT_RATE * self.lengths).astype(int), (self.lengths - Q) // Q)
        return np.where(self.lengths < SHORT_BYTES, 0, budget)

    @staticmethod
    def build(items: list[tuple[int, bytes]], least: int = 1) -> ItemIndex | None:
        """Index of the items with at least ``least`` normalised bytes."""
        ids, parts = [], []
        for item, text in items:
            data = normalise(np.frombuffer(text, np.uint8))[0]
            if len(data) and data[0] == 32:
                data = data[1:]
            if len(data) and data[-1] == 32:
                data = data[:-1]
            if len(data) >= least:
                ids.append(item)
                parts.append(data)
        if not parts:
            return None
        sizes = np.array([len(p) for p in parts])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = np.concatenate([*parts, np.zeros(Q, np.uint8)])
        own, low, high, whole = [], [], [], np.full(len(parts), -1)
        for i, size in enumerate(sizes.tolist()):
            for a, b in segments_of(size) if size >= Q else ():
                own.append(i), low.append(a), high.append(b)
        regular = len(own)
        for i, size in enumerate(sizes.tolist()):
            if SEGMENT < size <= WHOLE:
                whole[i] = len(own)
                own.append(i), low.append(0), high.append(size)
        # Postings of whole q-grams inside one item.
        places = runs_of(edges[:-1], np.maximum(sizes - Q + 1, 0))
        owners = np.repeat(np.arange(len(parts)), np.maximum(sizes - Q + 1, 0))
        codes, number = np.unique(grams(data)[places], return_inverse=True)
        before = np.where(
            places == edges[owners], ITEM_START, data[np.maximum(places - 1, 0)].astype(np.int64)
        )
        keys = number * BYTES_BEFORE + before
        by = np.argsort(keys, kind="stable")
        tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, Q):
            which = np.flatnonzero(sizes == size)
            if len(which):
                heads = grams(data)[edges[which]] & np.uint64((1 << (8 * size)) - 1)
                order = np.argsort(heads, kind="stable")
                tiny[size] = heads[order], which[order]
        return ItemIndex(
            np.array(ids, np.int64),
            data,
            edges,
            codes,
            keys[by],
            places[by],
            owners[by],
            np.array(own, np.int64),
            np.array(low, np.int64),
            np.array(high, np.int64) - np.array(low, np.int64),
            regular,
            whole,
            tiny,
        )

    def _present(self) -> np.ndarray:
        cached = getattr(self, "_table", None)
        if cached is None:
            cached = np.zeros(1 << HASH_BITS, np.bool_)
            cached[_slot(self.codes)] = True
            self._table = cached
        return cached

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def slices(
        self, text: np.ndarray, offsets: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of shared q-grams, (item, first place in the item, text place, q-grams), slice by
        slice of the text. A slice has a bounded number of runs, and goes on as far as a region
        that begins in it may; a run that a slice begins inside begins there again.
        """
        codes = grams(text)
        at = np.flatnonzero(self._present()[_slot(codes)])
        if not len(at) or not len(self.codes):
            return
        which = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[which] == codes[at]
        row = np.searchsorted(offsets, at, "right") - 1
        same &= at + Q <= offsets[row + 1]
        at, which, row = at[same], which[same], row[same]
        before = np.where(
            at == offsets[row], TEXT_START, text[np.maximum(at - 1, 0)].astype(np.int64)
        )
        first = np.searchsorted(self.keys, which * BYTES_BEFORE)
        last = np.searchsorted(self.keys, (which + 1) * BYTES_BEFORE)
        skip = np.searchsorted(self.keys, which * BYTES_BEFORE + before)
        resume = np.searchsorted(self.keys, which * BYTES_BEFORE + before + 1)
        room = offsets[row + 1] - at
        through = np.cumsum(last - first - (resume - skip))
        words = np.concatenate([text, np.zeros(Q, np.uint8)])
        low = 0
        while low < len(at):
            done = through[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(through, done + SLICE_RUNS, "right")))
            if high < len(at):
                end = int(np.searchsorted(at, at[high - 1] + 1 + REGION))
            else:
                end = high = len(at)
            own = slice(low, end)
            s, r = skip[own].copy(), resume[own].copy()
            s[0] = r[0] = first[low]  # at the slice's edge every posting begins a run
            posting = np.concatenate(
                [runs_of(first[own], s - first[own]), runs_of(r, last[own] - r)]
            )
            begin = np.concatenate(
                [np.repeat(at[own], s - first[own]), np.repeat(at[own], last[own] - r)]
            )
            space = np.concatenate(
                [np.repeat(room[own], s - first[own]), np.repeat(room[own], last[own] - r)]
            )
            item, place = self.owners[posting], self.places[posting]
            space = np.minimum(space, self.edges[item + 1] - place)
            size = _common(words, begin, self.data, place, space)
            yield item, place - self.edges[item], begin, size - Q + 1
            low = high

    def counts(self, runs: tuple) -> tuple[np.ndarray, ...]:
        """Bands of one slice that reach their bound without a verbatim copy, as (segment, first
        text place), and the verbatim copies, as (segment, text place).
        """
        item, place, begin, size = runs
        budget = self.edits
        order = self.items[: self.regular] * (1 << 32) + self.lows[: self.regular]
        reach = np.maximum(place - (SEGMENT - Q), 0)
        first = np.searchsorted(order, item * (1 << 32) + reach)
        last = np.searchsorted(order, item * (1 << 32) + place + size - 1, "right")
        pairs = np.cumsum(last - first)
        keys, sums, copies = [], [], []
        low = 0
        while low < len(item):
            done = pairs[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(pairs, done + SLICE_PAIRS, "right")))
            own = slice(low, high)
            times = (last - first)[own]
            with_whole = self.whole[item[own]] >= 0
            segment = np.concatenate(
                [runs_of(first[own], times), self.whole[item[own]][with_whole]]
            )
            run = low + np.concatenate(
                [np.repeat(np.arange(len(times)), times), np.flatnonzero(with_whole)]
            )
            grams_in = self.lengths[segment] - Q + 1
            inner = np.maximum(place[run], self.lows[segment])
            outer = np.minimum(place[run] + size[run], self.lows[segment] + grams_in)
            shared = outer - inner
            some = shared > 0
            segment, run, shared, full = segment[some], run[some], shared[some], grams_in[some]
            diagonal = begin[run] - place[run]
            band = diagonal // (budget[segment] + 1)
            key = (segment << BAND_BITS) + band + (1 << (BAND_BITS - 1))
            exact = shared == full
            copies.append((segment[exact], (diagonal + self.lows[segment])[exact], key[exact]))
            # Counts for the bands that begin here and one step earlier.
            part = _sums(np.concatenate([key, key - 1]), np.concatenate([shared, shared]))
            keys.append(part[0]), sums.append(part[1])
            low = high
        empty = np.empty(0, np.int64)
        key, shared = _sums(np.concatenate([empty, *keys]), np.concatenate([empty, *sums]))
        copied, at, copy_keys = (np.concatenate([empty, *c]) for c in zip(*copies, [empty] * 3))
        segment = key >> BAND_BITS
        band = (key & ((1 << BAND_BITS) - 1)) - (1 << (BAND_BITS - 1))
        kept = shared >= self.lengths[segment] - Q + 1 - Q * budget[segment]
        kept &= ~np.isin(key, np.concatenate([copy_keys, copy_keys - 1]))
        segment, band = segment[kept], band[kept]
        return segment, band * (budget[segment] + 1) + self.lows[segment], copied, at

    def patterns(self, segments: np.ndarray) -> np.ndarray:
        """Bytes of segments, one row each, padded."""
        index = (self.edges[self.items[segments]] + self.lows[segments])[:, None] + np.arange(WHOLE)
        inside = np.arange(WHOLE) < self.lengths[segments][:, None]
        return np.where(inside, self.data[np.minimum(index, len(self.data) - 1)], np.uint8(0))

    def leaks(self, texts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, item, start, end, edits) of every pair of a text and an item found in it, as the
        columns of an array: from the first region to the end of the last, and the fewest edits.
        """
        found = [np.empty((0, 5), np.int64), *self._tiny_copies(texts, offsets)]
        for runs in self.slices(texts, offsets):
            segment, low, copied, at = self.counts(runs)
            row = np.searchsorted(offsets, at, "right") - 1
            end = at + self.lengths[copied]
            good = (self.lengths[copied] >= SHORT_BYTES) | _apart(texts, offsets, row, at, end)
            part = [row, self.items[copied], at, end, np.zeros(len(at), np.int64)]
            found.append(_widest(np.stack(part, axis=1)[good]))
            found.append(_widest(self._aligned(texts, offsets, segment, low)))
        return _widest(np.concatenate(found))

    def _tiny_copies(self, texts: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        if not self.tiny or not len(texts):
            return
        words = grams(np.concatenate([texts, np.zeros(Q, np.uint8)]))
        for size, (heads, items) in self.tiny.items():
            cut = words & np.uint64((1 << (8 * size)) - 1)
            low, high = np.searchsorted(heads, cut, "left"), np.searchsorted(heads, cut, "right")
            at = np.flatnonzero(high > low)
            row = np.searchsorted(offsets, at, "right") - 1
            good = (at + size <= offsets[row + 1]) & _apart(texts, offsets, row, at, at + size)
            at, row = at[good], row[good]
            times = (high - low)[at]
            item = items[runs_of(low[at], times)]
            row, at = np.repeat(row, times), np.repeat(at, times)
            yield _widest(np.stack([row, item, at, at + size, np.zeros(len(at), np.int64)], axis=1))

    def _aligned(self, texts, offsets, segment, low) -> np.ndarray:
        """Regions within the edit budget among the given bands."""
        budget, length = self.edits[segment], self.lengths[segment]
        # The row in which the middle of the band's region lies; the region ends with the row.
        middle = np.clip(low + length // 2 + budget, 0, max(0, len(texts) - 1))
        row = np.searchsorted(offsets, middle, "right") - 1
        begin, end = offsets[row], offsets[row + 1]
        width = 2 * (int(budget.max(initial=0)) + 1)
        found = [np.empty((0, 5), np.int64)]
        for part in range(0, len(segment), 4096):
            cut = slice(part, part + 4096)
            m, e = length[cut], budget[cut]
            patterns = self.patterns(segment[cut])
            edits, last = align(patterns, m, texts, low[cut], begin[cut], end[cut], width)
            good = np.flatnonzero(edits <= e)
            if not len(good):
                continue
            r, b, stop = row[cut][good], begin[cut][good], last[good]
            first = start_of(patterns[good], m[good], texts, stop, b, int(budget.max()))
            first, stop = np.maximum(first, b), np.minimum(stop, end[cut][good])
            item = self.items[segment[cut][good]]
            rows = np.stack([r, item, first, stop, edits[good]], axis=1)
            found.append(rows[stop > first])
        return np.concatenate(found)


def _common(text: np.ndarray, at: np.ndarray, data: np.ndarray, place: np.ndarray, room):
    """How many bytes from ``at`` on equal those from ``place`` on, ``room`` at most, the first
    eight being known to.
    """
    one, other = grams(text), grams(data)
    size = np.full(len(at), Q)
    live = np.flatnonzero(size < room)
    while len(live):
        a = np.minimum(at[live] + size[live], len(one) - 1)
        b = np.minimum(place[live] + size[live], len(other) - 1)
        differ = one[a] ^ other[b]
        # The lowest set bit lies in the first byte that differs.
        lowest = differ & (np.uint64(0) - differ)
        equal = np.where(differ == 0, Q, np.bitwise_count(lowest - np.uint64(1)) >> 3)
        size[live] += equal
        live = live[(equal == Q) & (size[live] < room[live])]
    return np.minimum(size, room)


def _apart(texts, offsets, row, start, end) -> np.ndarray:
    """Whether regions stand between word boundaries of their texts."""
    last = len(texts) - 1
    left = (start == offsets[row]) | ~_ALNUM[texts[np.clip(start - 1, 0, max(0, last))]]
    right = (end >= offsets[row + 1]) | ~_ALNUM[texts[np.clip(end, 0, max(0, last))]]
    return left & right


def _widest(found: np.ndarray) -> np.ndarray:
    """One line per row and item: the first start, the last end and the fewest edits."""
    if len(found) < 2:
        return found
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    new = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
    at = np.flatnonzero(np.concatenate([[True], new]))
    columns = [found[at, 0], found[at, 1], np.minimum.reduceat(found[:, 2], at)]
    columns += [np.maximum.reduceat(found[:, 3], at), np.minimum.reduceat(found[:, 4], at)]
    return np.stack(columns, axis=1)


def _window(texts, low, begin, end, size):
    """Bytes from ``low`` on, with a byte that equals none outside of the row."""
    index = low[:, None] + np.arange(size)
    inside = (index >= begin[:, None]) & (index < end[:, None])
    return np.where(inside, texts[np.clip(index, 0, len(texts) - 1)], np.uint8(254))


def _rows(distance, patterns, lengths, window, width):
    """Banded alignment of all candidates at once, row by row of the pattern; returns the last row
    of each candidate.
    """
    steps = np.arange(width, dtype=np.int16)
    out = distance.copy()
    for i in range(int(lengths.max())):
        moved = distance + (patterns[:, i, None] != window[:, i : i + width])
        moved[:, :-1] = np.minimum(moved[:, :-1], distance[:, 1:] + 1)
        distance = (np.minimum.accumulate(moved - steps, axis=1) + steps).astype(np.int16)
        done = lengths == i + 1
        out[done] = distance[done]
    return out


def align(patterns, lengths, texts, low, begin, end, width):
    """Fewest edits of each pattern against any region of its band, and where that region ends."""
    size = int(lengths.max()) + width
    window = _window(texts, low, begin, end, size)
    start = np.zeros((len(patterns), width), np.int16)
    last = _rows(start, patterns, lengths, window, width)
    best = last.argmin(axis=1)
    return last[np.arange(len(last)), best].astype(int), low + lengths + best


def start_of(patterns, lengths, texts, stop, begin, budget):
    """Where the cheapest region that ends at ``stop`` begins: the same alignment backwards."""
    width = 2 * budget + 1
    size = int(lengths.max()) + width
    index = stop[:, None] - 1 - (np.arange(size) - budget)
    inside = (index >= begin[:, None]) & (index < stop[:, None])
    window = np.where(inside, texts[np.clip(index, 0, len(texts) - 1)], np.uint8(254))
    turned = np.zeros_like(patterns)
    for i, m in enumerate(lengths):
        turned[i, :m] = patterns[i, :m][::-1]
    ahead = np.arange(width) - budget
    first = np.where(ahead >= 0, ahead, FAR).astype(np.int16)
    last = _rows(np.tile(first, (len(patterns), 1)), turned, lengths, window, width)
    return stop - (lengths + last.argmin(axis=1) - budget)


def item_blocks(benchmark: DataFrame, least: int = 1) -> Iterator[ItemIndex]:
    """Indexes over the benchmark's items of at least ``least`` normalised bytes, each over about
    ``ITEM_BLOCK_BYTES`` of items.
    """
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // ITEM_BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        rows = items.filter(block == part).collect()
        rows = sorted((r["item_id"], r["text"].encode()) for r in rows if r["item_id"] is not None)
        index = ItemIndex.build(rows, least)
        if index is not None:
            yield index


def search(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) in bytes of the texts as they came, once per row and item."""
    offsets, data = text_bytes(texts)
    for low, high in blocks(offsets, BLOCK):
        raw = data[offsets[low] : offsets[high]]
        edges = offsets[low : high + 1] - offsets[low]
        plain, at = normalise(raw)
        inner = np.searchsorted(at, edges)
        at = np.append(at, len(raw))
        found = index.leaks(plain, inner)
        row = found[:, 0]
        start, end = at[found[:, 2]] - edges[row], at[found[:, 3] - 1] + 1 - edges[row]
        yield from zip(
            (low + row).tolist(),
            index.ids[found[:, 1]].tolist(),
            start.tolist(),
            end.tolist(),
            found[:, 4].tolist(),
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every (document, benchmark item) of which the document holds a passage.

    Input: ``doc_id, text`` and ``item_id, text``; other columns are ignored. A passage is a
    region within ``EDIT_RATE`` edits per byte of a whole item of up to ``WHOLE`` bytes or of a
    ``SEGMENT``-byte segment of a longer one, letters in lower case and white space runs as one
    space. Segments begin every ``STEP`` bytes, so every verbatim part of an item with at least
    ``FRAGMENT`` such bytes is found, wherever it begins. Items below ``SHORT_BYTES`` are found
    verbatim, between word boundaries. Output per pair: ``doc_id, item_id, span_start, span_end``
    (bytes of the text, from the first passage to the end of the last), ``edits`` (fewest of any
    passage).

    Defined cases: null and empty texts and items hold nothing; repeated items count once, repeated
    documents give their rows once each (rows of one ``doc_id`` are reported together, a null one
    as null); an empty benchmark or table gives an empty result.
    """
    ship_package(docs.sparkSession)
    found = None
    for index in item_blocks(benchmark):

        def leaks(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: dict[tuple[int, int], list] = {}
                for row, item, start, end, edits in search(index, batch.column("text")):
                    known = rows.setdefault((row, item), [start, end, edits])
                    known[0], known[1] = min(known[0], start), max(known[1], end)
                    known[2] = min(known[2], edits)
                doc = batch.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64()))
                columns = list(zip(*rows.values())) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        pa.array([i for _, i in rows], pa.int64()),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()),
                    ],
                    ["doc_id", "item_id", "span_start", "span_end", "edits"],
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = docs.select("doc_id", "text").mapInArrow(leaks, f"doc_id {kind}, {LEAK_FIELDS}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, {LEAK_FIELDS}")
    return found.groupBy("doc_id", "item_id").agg(
        F.min("span_start").alias("span_start"),
        F.max("span_end").alias("span_end"),
        F.min("edits").alias("edits"),
    )


def is_leaky(index: ItemIndex, text: Column) -> Column:
    """Whether a text holds a passage of an item of the index."""

    @F.arrow_udf("boolean")
    def leaky(texts: pa.Array) -> pa.Array:
        release()
        hit = np.zeros(len(texts), np.bool_)
        for row, *_ in search(index, texts):
            hit[row] = True
        return pa.array(hit)

    return leaky(text)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, min_bytes: int = MIN_DROP_BYTES
) -> DataFrame:
    """Documents without a passage of the benchmark, all columns kept. No shuffle.

    Items with fewer than ``min_bytes`` normalised bytes (single words, numbers) drop nothing. Null
    and empty texts, and all documents where the benchmark is empty, stay; repeated documents have
    one fate; an empty table gives an empty result. Only a benchmark of several blocks writes the
    documents between them, so that a task holds one block.
    """
    ship_package(docs.sparkSession)
    for number, index in enumerate(item_blocks(benchmark, min_bytes)):
        if number:
            docs = materialize(docs, "undropped")
        docs = docs.filter(~is_leaky(index, F.col("text")))
    return docs
