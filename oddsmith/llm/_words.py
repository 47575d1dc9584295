"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
SEGMENT_BYTES = 1 << 18
_TEXTS = 256


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    """The texts of a column, null as empty; a few hundred at a time become Python strings."""
    values = batch.column(column)
    for start in range(0, len(values), _TEXTS):
        for value in values.slice(start, _TEXTS).to_pylist():
            yield value or ""


@dataclass
class Words:
    """Words of the rows ``first`` to ``last`` of a batch, in order.

    ``row`` counts from ``first``; ``start`` and ``end`` are places in ``data``, the lower-cased
    bytes of these rows; ``offsets`` are the rows' places in ``data``.
    """

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit values (the splitmix finaliser)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordReader:
    """Reads words `[^\\x20\\x09-\\x0D]+` of text columns; A-Z is lower-cased unless ``lower`` is off.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over the whole
    text, then scrambled. A text is read in segments cut at white space, so the memory beyond the
    result is bounded by the segment or the longest word.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

    def __init__(self, lower: bool = True):
        self._space = np.zeros(256, bool)
        self._space[[0x20, *range(0x09, 0x0E)]] = True
        self._fold = np.arange(256, dtype=np.uint8)
        if lower:
            self._fold[0x41:0x5B] += 32
        self._powers(SEGMENT_BYTES)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            ones = np.full(n, self.BASE)
            ones[0] = 1
            self._power = np.multiply.accumulate(ones)
            ones = np.full(n, self.INVERSE)
            ones[0] = 1
            self._inverse = np.multiply.accumulate(ones)

    def read(self, batch: pa.RecordBatch, column: int) -> Iterator[Words]:
        """The batch's rows in pieces of about half a megabyte of text, at least one row each."""
        values = batch.column(column).fill_null("")
        if not len(values):
            return
        wide = pa.types.is_large_string(values.type)
        _, places, data = values.buffers()
        places = np.frombuffer(places, np.int64 if wide else np.int32)
        places = places[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(values):
            last = int(np.searchsorted(places, places[first] + PIECE_BYTES, "right")) - 1
            last = min(max(last, first + 1), len(values))
            offsets = places[first : last + 1] - places[first]
            yield self._piece(first, last, self._fold[data[places[first] : places[last]]], offsets)
            first = last

    def _piece(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> Words:
        solid = ~self._space[data]
        inside = offsets[(offsets > 0) & (offsets < len(data))]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[inside] |= solid[inside]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        ends[inside - 1] |= solid[inside - 1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        row = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
        return Words(first, last, data, offsets, row, start, end, self.hashes(data, start, end))

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans ``start`` to ``end``, which are in order and do not overlap."""
        found = np.empty(len(start), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(start):
                stop = int(np.searchsorted(end, start[at] + SEGMENT_BYTES, "right"))
                stop = max(stop, at + 1)
                low, high = int(start[at]), int(end[stop - 1])
                if high - low > len(self._power):
                    self._powers(high - low)
                values = data[low:high].astype(np.uint64)
                values += np.uint64(1)
                values *= self._power[: high - low]
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(values, out=sums[1:])
                s = start[at:stop] - low
                found[at:stop] = (sums[end[at:stop] - low] - sums[s]) * self._inverse[s]
                at = stop
        return mixed(found)
