"""Packing (operator 9): cutting stock by column generation.

Each document's token ids (and an end id) are cut at the sequence length;
the lengths of the pieces form a histogram of at most ``length`` rows, which
is all that reaches the driver.  There a linear program over patterns (how
many pieces of each length class make a sequence) is solved: the duals of the
current patterns price a new pattern by an unbounded knapsack over the
classes, until no pattern is worth more than one sequence (within
``tolerance``).  The patterns are rounded down; the few pieces left over are
placed first-fit, longest first.  Back in Spark every piece gets its rank
within its class and reads its sequence from the pattern table, so documents
are assigned without any of them passing through the driver.

The ids come from the tokenizer's own encoding of each distinct word, kept
per Python worker: normalising and splitting are done here for the scripts
where they are known to agree, and by the library for all other texts.

Cases: null is the empty text, one piece that holds the end id; very long
texts become many pieces; equal lengths are ranked by a hash of id and start;
repeated rows are packed each; an empty table gives an empty result.  Only
the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .ranks import ranked
from .staging import staged

GRAIN = 16  # lengths of one class differ by less than this (about half of it is padding per piece)

# --- token ids ---------------------------------------------------------------

# Fixed value: the splitting pattern of the word-end vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Outside these blocks composing or lower-casing may depend on neighbours or
# on the Unicode version.
UNSURE = r"[^\u0000-˿‐-‧‰-⁞]"
KEPT_WORDS = 800_000


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(SPLIT)
        self.unsure = regex.compile(UNSURE)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def plain(self, text: str) -> bool:
        return not self.unsure.search(text) and not any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        if self.plain(text):
            return b"".join(map(self.__getitem__, self.words.findall(text.lower())))
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def ids_of(path: str) -> WordIds:
    state = arrays.worker_state()
    if ("ids", path) not in state:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        state["ids", path] = WordIds(path)
    return state["ids", path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens."""
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                        T.StructField("doc_tokens", T.LongType())])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = ids_of(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                for k, value in enumerate(part.column("text").fill_null("")):
                    ids = encoder.ids(value.as_py()) + end
                    total = len(ids) // 4
                    for at in range(0, total, length):
                        piece = ids[4 * at: 4 * (at + length)]
                        rows.append(k)
                        starts.append(at)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(total)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                    out.fieldNames())

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(cut, out)


# --- the linear program ------------------------------------------------------


def best_pattern(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of classes of most worth that fits."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if ends[room]:
            values = best[room - sizes[: ends[room]]] + worth[: ends[room]]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], pick[room] = values[k], k
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return best[capacity], counts


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 2e-4,
                      rounds: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: (patterns, one per column; how often each is used,
    fractional).  Stops when the dual bound shows the value to be within
    ``tolerance`` of the optimum."""
    product = lambda a, b: np.einsum("ij,j...->i...", a, b)  # noqa: E731  no threaded library in the driver
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    used = product(inverse, demand)
    for step in range(rounds):
        worth = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(worth, 0.0), sizes, capacity)
        if value <= 1 + tolerance:
            break
        direction = product(inverse, pattern)
        candidates = np.flatnonzero(direction > 1e-9)
        if not len(candidates):
            break
        ratios = used[candidates] / direction[candidates]
        leave = candidates[int(ratios.argmin())]
        theta = used[leave] / direction[leave]
        used = np.maximum(used - theta * direction, 0.0)
        used[leave] = theta
        columns[:, leave] = pattern
        row = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, row)
        inverse[leave] = row
        if step % 200 == 199:  # a Newton step takes back what rounding has added up
            inverse = 2 * inverse - product(inverse, product(columns, inverse))
        if step % 200 == 199:
            used = np.maximum(product(inverse, demand), 0.0)
    else:
        raise RuntimeError(f"column generation has not come within {tolerance} of the optimum in {rounds} rounds")
    return columns, used


def rounded_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern as {class number: pieces}, times)] that place the whole
    demand: the program's patterns rounded down, the rest first-fit with the
    longest first."""
    out: list[tuple[dict[int, int], int]] = []
    left = demand.astype(np.int64).copy()
    if len(sizes):
        columns, used = generate_patterns(sizes, demand.astype(float), capacity)
        for k in np.argsort(-used, kind="stable"):
            pattern = {int(c): int(columns[c, k]) for c in np.flatnonzero(columns[:, k] > 0.5)}
            times = int(used[k] + 1e-6)
            times = min([times, *(int(left[c]) // n for c, n in pattern.items())])
            if times > 0 and pattern:
                out.append((pattern, times))
                for c, n in pattern.items():
                    left[c] -= n * times
    bins: list[dict[int, int]] = []
    room = np.zeros(0, np.int64)
    for c in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[c])):
            fits = np.flatnonzero(room >= sizes[c])
            if len(fits):
                b = int(fits[int(room[fits].argmin())])
            else:
                b = len(bins)
                bins.append({})
                room = np.append(room, capacity)
            bins[b][c] = bins[b].get(c, 0) + 1
            room[b] -= sizes[c]
    merged: dict[tuple, int] = {}
    for b in bins:
        key = tuple(sorted(b.items()))
        merged[key] = merged.get(key, 0) + 1
    return out + [(dict(k), times) for k, times in merged.items()]


def slot_table(classes: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence):
    ranks of a class that one pattern takes.  Its size is bounded by the
    number of classes, not by the documents."""
    sizes = np.asarray(classes, np.int64)
    cursor, sequence, out = [0] * len(classes), 0, []
    for pattern, times in rounded_patterns(sizes, np.asarray(counts, np.int64), capacity):
        for c, per in pattern.items():
            out.append((int(sizes[c]), cursor[c], cursor[c] + per * times, per, sequence))
            cursor[c] += per * times
        sequence += times
    return out


def packed(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", grain: int = GRAIN) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, length, end_id, id_col, text_col)
                 .withColumn("_class", F.ceil(F.col("length") / F.lit(grain))), "pieces")
    counts = cut.groupBy("_class").agg(F.count(F.lit(1)).alias("n"))
    histogram = sorted((r["_class"], r["n"]) for r in counts.collect())  # at most length / grain rows
    slots = slot_table([c for c, _ in histogram], [n for _, n in histogram], length // grain)
    counts = spark.createDataFrame(histogram, "_class long, n long")
    slots = spark.createDataFrame(slots, "_class long, _from long, _to long, _per long, _first long")
    order = [F.col(c) for c in (id_col, "start", "ids_crc32")]
    placed = ranked(cut, ["_class"], order, F.broadcast(counts), "_rank") \
        .join(F.broadcast(slots), "_class").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))) \
        .withColumn("_at", F.col("_rank") - F.col("_from")) \
        .withColumn("sequence_id", F.col("_first") + F.expr("_at DIV _per")).withColumn("_slot", F.expr("_at % _per"))
    before = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
