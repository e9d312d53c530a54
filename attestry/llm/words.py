"""Words of whole texts, found and hashed for many texts at once.

Texts come as Arrow string columns. Words are byte ranges of the UTF-8 data,
so nothing is copied per word. A word's hash is a 64-bit polynomial of its
bytes, ended by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but blank and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[9:14] = False
NOT_SPACE[32] = False

#: Digits, lower-case letters, and every byte of a character outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True

STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
BYTE_CODE = np.random.RandomState(20240521).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text handled at once; a longer text is handled alone.
PIECE = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, with A-Z lower-cased if asked, and row offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[raw] if lower else raw, bounds - bounds[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def gathered(batches: Iterator[pa.RecordBatch], column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many bytes of a text column, however small they arrive."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def counted(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks are set in every row."""
    before = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


class Words:
    """The words of a run of rows: byte bounds, hashes, and word offsets per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = data
        inside = kind[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[first] = inside[first]
        ends[last] = inside[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))
        self.inside = inside

    def hashes(self, width: int = 0) -> np.ndarray:
        """One 64-bit hash per word, or of its first ``width`` bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        first = self.starts[0]
        reach = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(first, len(self.data)) - np.repeat(self.starts, reach)
        powers = np.cumprod(np.full(int(place.max()) + 1, STEP, dtype=np.uint64))
        value = BYTE_CODE[self.data[first:]] * powers[place]
        value *= self.inside[first:] & (place < width) if width else self.inside[first:]
        return mix(np.add.reduceat(value, self.starts - first))

    def encoded(self) -> pa.DictionaryArray:
        """Every word as its place in the list of distinct words."""
        bounds = np.zeros(len(self.starts) + 1, dtype=np.int32)
        np.cumsum(self.ends - self.starts, out=bounds[1:])
        letters = self.data[self.inside]
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()

    def word(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes()
