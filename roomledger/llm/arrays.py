"""Whole text columns as flat byte arrays.

An Arrow string column already is one byte buffer plus offsets.  The
operators that look at every byte or word of a text work on those two
arrays with numpy, without making a Python string per row: words, hashes
of words and of byte ranges, and lines come from a few vectorised passes.

A batch is cut into slices of about ``SLICE_BYTES`` (a longer text is a
slice of its own), so the arrays of eight bytes per byte stay small.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker (functions are
    shipped by value, so their module globals start empty in every task)."""
    name = "_roomledger_worker_state"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.values = {}
        sys.modules[name] = module
    return sys.modules[name].values


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code per byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    state = worker_state()
    if "powers" not in state or len(state["powers"][0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = pow(BASE, -1, 1 << 64)
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        pair = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 4 * SLICE_BYTES:
            return pair  # a very long text: not kept
        state["powers"] = pair
    up, down = state["powers"]
    return up, down


class RangeHash:
    """Hashes of any byte ranges of one slice, by prefix sums of
    code(byte) * BASE**position."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """The hash at every start of a range of one length."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n] + np.uint64(length))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def forget_words() -> None:
    """Let go of the words that a tokenizing stage has left in this worker
    (kept under tuples): a worker that works on bytes now needs the memory."""
    state = worker_state()
    for key in [k for k in state if isinstance(k, tuple)]:
        del state[key]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of whole rows: (rows, bytes, offsets)."""
    forget_words()
    data, offsets = text_buffers(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows, first + 50_000)
        yield batch.slice(first, last - first), data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: start, end, document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_SEPARATOR[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        opens[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        # words of document d are numbers first[d] to first[d + 1]
        self.first = np.searchsorted(self.start, offsets, "left")

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each window of ``size`` words inside a document;
    a shorter document has one window of all its words."""
    n = len(hashes)
    counts = words.counts()
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    place = np.arange(n) - words.first[words.doc]
    with np.errstate(over="ignore"):
        factor = 1
        for k in range(min(size, n)):
            part = hashes[k:] * np.uint64(factor)
            reaches = np.zeros(n, bool)
            reaches[: n - k] = words.doc[k:] == words.doc[: n - k]
            total[: n - k] += np.where(reaches[: n - k], part, np.uint64(0))
            factor = factor * BASE % (1 << 64)
        keep = (place + size <= counts[words.doc]) | (place == 0)
        return mix(total[keep] + np.minimum(counts[words.doc[keep]], size).astype(np.uint64)), words.doc[keep]


def char_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points per document."""
    return range_sums((data & 0xC0) != 0x80, offsets)


def range_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
