"""Words of a slice as exact numbers.

The bytes of all words are moved together into one Arrow array, which Arrow
encodes as a dictionary: equal words get one number by their bytes, not by a
hash of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case (bytes of longer characters are above 0x7F)."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def marks(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the bytes in [start, end), for ranges that do not overlap."""
    steps = np.zeros(n + 1, np.int8)
    steps[start] += 1
    steps[end] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as an Arrow array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words by number).  ``inside`` flags
    the bytes of the words."""
    coded = binary_array(data[inside], end - start).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal stretches of flagged bytes
    within documents."""
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(inside))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(offsets, start, "right") - 1
