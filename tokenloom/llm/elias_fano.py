"""Elias-Fano coding of a rising list of numbers, with select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Every so many-th set bit of the upper part has its place stored.
SAMPLE = 256


@dataclass(frozen=True)
class EliasFano:
    """``count`` numbers below ``2^63``: the lowest ``width`` bits of each side by side, and the
    upper parts as one set bit each at ``upper + index``. Near two bits a number more than its
    lower bits. ``samples`` are the places of every ``SAMPLE``-th set bit, so that a number is
    found by a look at a few words.
    """

    count: int
    width: int
    lower: bytes
    upper: bytes
    samples: bytes

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        count = len(values)
        if not count:
            return EliasFano(0, 0, b"", b"", b"")
        width = max(0, int(np.log2(max(1, (int(values[-1]) + 1) // count))))
        bits = (values[:, None] >> np.arange(width)) & 1
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> width) + np.arange(count)
        marks = np.zeros(int(places[-1]) + 1, np.uint8)
        marks[places] = 1
        upper = np.packbits(marks, bitorder="little")
        return EliasFano(
            count, width, lower.tobytes(), upper.tobytes(), places[::SAMPLE].astype(np.uint32).tobytes()
        )

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.int64)
        data = np.frombuffer(self.lower, np.uint8)
        bit = index[:, None] * self.width + np.arange(self.width)
        found = (data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return (found.astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def select(self, index: int) -> int:
        """The number at ``index``: count set bits from the sample before it."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        place = int(np.frombuffer(self.samples, np.uint32)[index // SAMPLE])
        left = index % SAMPLE
        data = np.frombuffer(self.upper, np.uint8)
        at, skip = place >> 3, place & 7
        window = 64
        while True:
            bits = np.unpackbits(data[at : at + window], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                place = at * 8 + int(ones[left])
                break
            window *= 2
        high = place - index
        return (high << self.width) | int(self._low(np.array([index]))[0])

    def all(self) -> np.ndarray:
        """All numbers."""
        index = np.arange(self.count)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))
        return ((places[: self.count] - index) << self.width) | self._low(index)
