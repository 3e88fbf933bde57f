"""Groups of rows from a stream of Arrow batches sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def by_group(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` (integer columns without nulls),
    one table per group; a group may reach over many batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        if held and any(held[-1].column(k)[-1].as_py() != v for k, v in zip(keys, values[:, 0])):
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        begin = 0
        for end in cuts:
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of values per row) of a binary column of packed
    numbers."""
    parts = [x.as_buffer() for x in column]
    size = np.dtype(dtype).itemsize
    counts = np.array([p.size // size for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), dtype) if parts else np.zeros(0, dtype), counts
