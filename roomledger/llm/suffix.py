"""Suffix-array dedup (operator 7): distributed prefix doubling.

Two 50-byte strings are equal when their parts are, so positions are ranked
(named) by growing lengths: Spark sorts (name, name) pairs, a pass over the
sorted rows reranks them, a position drops out as soon as its name is unique,
and the last round reaches the threshold length.

Sorting one row per byte of a corpus would take many times the corpus, so
the first round ranks *runs* of positions.  Every 50-byte string has a least
20-byte name among the 31 that it contains, and consecutive strings that
share it form a run (about one run per 16 bytes).  Equal strings always lie in
runs with the same least name, so:

1. Length 20: ``(least name, name of the whole run)`` pairs are sorted.  A run
   whose least name is unique cannot match anywhere and drops out.  A run
   whose whole content stands in a smaller document is covered altogether.
2. Length 35: what remains are runs that share the least name but differ as a
   whole (borders of repeated passages, or common phrases).  A match that
   takes in the 20 bytes goes on for 15 bytes to their left or to their
   right: the two 35-byte names are ranked, and positions whose name stands in
   one document only drop out.
3. Length 50: the positions left take the pair (name of 25 bytes, name of the
   25 bytes after them); a position is covered if the same pair stands in a
   smaller document.

Before a sort each task settles what a slice already shows, so a passage that
a third of all documents share does not send a row per document to one
place; the sorted rows are read as a stream that holds no large group.  Runs
that share their least name are told apart by 64 bits of all their bytes: of
10**8 different runs around one common phrase 3e-4 false pairs are expected.
In the last round 128 bits decide.

Cases: null is the empty text; texts shorter than the threshold match
nothing; of rows with the same doc_id none is smaller, so copies under one
id stay; a null doc_id comes after all others; an empty table gives an empty
result; other columns are carried untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .staging import apart, staged

CORE = 20  # bytes of a least name
LAST_ID = (1 << 63) - 1
HELD_ROWS = 200_000  # a group longer than this is passed through in parts
MOST = (1 << 20) - 1  # positions of one row; a longer run is several rows

# What is known of a row: to be ranked; covered; to be looked at more closely.
OPEN, COVERED, LOOK = 0, 1, 2

# a, b: names; doc, tie: document; span: first position, number of positions
# and what is known, in one number
ROWS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("span", T.LongType()),
                     T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("span", T.LongType())])
KNOWN = "span & 3"


def spans(at: np.ndarray, n: np.ndarray, known) -> np.ndarray:
    return (at.astype(np.int64) << 22) | (n.astype(np.int64) << 2) | known


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        gap = width - have
        least = np.minimum(least[: len(least) - gap], least[gap:])
    return least


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(least name, name of the run, document, first position, positions) of
    every run of a slice; positions count within the document."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    least = sliding_least(arrays.RangeHash(data, 11).fixed(CORE), length - CORE + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length <= ends
    opens = inside.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(least)]
    opens[borders] = inside[borders]
    start = np.flatnonzero(opens)
    doc = np.searchsorted(offsets, start, "right") - 1
    # a run ends where the next opens or the document has no more positions
    end = np.minimum(np.append(start[1:], len(least)), offsets[doc + 1] - length + 1)
    if len(start) and (end - start).max() > MOST:
        parts = -(-(end - start) // MOST)
        which = np.repeat(np.arange(len(start)), parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end, doc = start[which] + part * MOST, np.minimum(start[which] + (part + 1) * MOST, end[which]), doc[which]
    whole = arrays.RangeHash(data, 23)(start, end + length - 1)
    return least[start], whole, doc, start - offsets[doc], end - start


def settled(a, b, group, doc_id, tie, at, n, looks: bool) -> pa.RecordBatch:
    """The rows of a slice with what the slice alone shows: rows whose pair
    stands in a smaller document of the slice are covered.  With ``looks``,
    of a ``group`` that has open rows in several documents all open rows but
    two witnesses are to be looked at whatever the other slices hold; the
    witnesses are sorted, for the rows of other slices."""
    order = np.lexsort((at, tie, doc_id, b, a))
    a, b, group, doc_id, tie, at, n = (x[order] for x in (a, b, group, doc_id, tie, at, n))
    known = np.full(len(a), OPEN, np.int64)
    if len(a):
        new_pair = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        first_pair = np.flatnonzero(new_pair)
        pair = np.cumsum(new_pair) - 1
        known[doc_id > doc_id[first_pair][pair]] = COVERED
        if looks:
            # Two open rows of different documents have different pairs (else
            # the larger were covered).  So the first open row at the least
            # and at the largest document that has one show by themselves that
            # the group must be looked at, and none of them is dropped.
            still = np.flatnonzero(known == OPEN)
            group, ids = group[still], doc_id[still]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(first, len(still)))
            least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            g = np.repeat(np.arange(len(first)), sizes)
            crowd = ((sizes > 4) & (least < most))[g]
            witness = np.zeros(len(still), bool)
            for extreme in (least, most):
                at_extreme = np.flatnonzero(ids == extreme[g])
                witness[at_extreme[np.unique(g[at_extreme], return_index=True)[1]]] = True
            known[still[crowd & ~witness]] = LOOK
    return pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(tie), pa.array(spans(at, n, known)),
                                       pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ROWS.fieldNames())


class Reranker:
    """One pass over rows sorted by (a, b, doc): which are covered by a
    smaller document, and which must be looked at more closely because their
    group (``a >> shift``) holds another pair in another document.  Holds one
    group, or of a very long one only where it stopped."""

    def __init__(self, shift: int, looks: bool):
        self.shift, self.looks = shift, looks
        self.held: list[np.ndarray] | None = None
        self.stopped: tuple[int, int, int] | None = None  # (a, b, smallest doc) where a long group was cut

    def feed(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        if self.held is not None:
            columns = [np.concatenate(x) for x in zip(self.held, columns)]
            self.held = None
        a = columns[0]
        cut = int(np.searchsorted(a, (a[-1] >> self.shift) << self.shift, "left"))
        if len(a) - cut <= HELD_ROWS:
            self.held = [x[cut:].copy() for x in columns]
            return self.rank([x[:cut] for x in columns], False)
        return self.rank(columns, True)

    def finish(self) -> pa.RecordBatch:
        columns, self.held = self.held, None
        return self.rank(columns, False) if columns else found_rows(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64)))

    def rank(self, columns: list[np.ndarray], goes_on: bool) -> pa.RecordBatch:
        a, b, doc, tie, span = columns
        if not len(a):
            return found_rows(doc, tie, span)
        group = a >> self.shift
        new_group = np.append(True, group[1:] != group[:-1])
        new_pair = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        pair = np.cumsum(new_pair) - 1
        smallest = doc[np.flatnonzero(new_pair)]
        if self.stopped is not None and self.stopped[:2] == (a[0], b[0]):
            smallest = smallest.copy()
            smallest[0] = min(smallest[0], self.stopped[2])
        covered = doc > smallest[pair]
        known = np.where(covered, COVERED, OPEN)
        if self.looks:
            first = np.flatnonzero(new_group)
            several = np.diff(np.append(pair[first], pair[-1] + 1)) > 1
            wide = several & (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
            if self.stopped is not None and self.stopped[0] >> self.shift == group[0]:
                wide[0] = True
            if goes_on:
                wide[-1] = True
            known[wide[np.cumsum(new_group) - 1] & ~covered] = LOOK
        self.stopped = (int(a[-1]), int(b[-1]), int(smallest[-1])) if goes_on else None
        keep = known != OPEN
        return found_rows(doc[keep], tie[keep], span[keep] | known[keep])


def found_rows(doc, tie, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(span)], FOUND.fieldNames())


def reranked(rows: DataFrame, shift: int, looks: bool) -> DataFrame:
    """Sort rank pairs and rerank.  Rows already settled need no sorting:
    they are dealt out evenly."""
    is_open = F.expr(KNOWN) == OPEN
    key = F.when(is_open, F.xxhash64(F.expr(f"a >> {shift}")) if looks else F.xxhash64("a", "b")).otherwise(F.xxhash64("doc", "span"))
    # the key decides the partition only; it does not travel with the row
    dealt = rows.repartition(key).sortWithinPartitions(is_open, "a", "b", "doc")

    def run(batches):
        ranker = Reranker(shift, looks)
        for batch in batches:
            doc, tie, span, a, b = (batch.column(c).to_numpy() for c in ROWS.fieldNames())
            done = (span & 3) != OPEN
            if done.any():
                yield found_rows(doc[done], tie[done], span[done])
            if not done.all():
                yield ranker.feed([x[~done] for x in (a, b, doc, tie, span)])
        yield ranker.finish()

    return dealt.mapInArrow(run, FOUND)


def per_document(keyed: DataFrame, found: DataFrame, name: str = "held") -> DataFrame:
    """The texts of documents that have rows in ``found``, with their spans."""
    listed = found.groupBy("doc", "tie").agg(F.collect_list("span").alias(name))
    return keyed.join(listed, ["doc", "tie"])


def _held(rows: pa.RecordBatch, offsets: np.ndarray, name: str = "held") -> tuple[np.ndarray, ...]:
    """(document of the slice, first position, positions) of listed spans."""
    held = rows.column(name)
    doc = np.repeat(np.arange(rows.num_rows), np.diff(held.offsets.to_numpy()))
    span = held.flatten().to_numpy()
    return doc, span >> 22, (span >> 2) & MOST


def probes(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Round 2: (name, document, first position, positions).  The positions
    of a run are split by the place of the least name that their string holds
    first, and by the side of it on which the string reaches far."""
    if not len(at):
        return np.zeros(0, np.uint64), doc, at, n
    width, side = length - CORE, (length - CORE) // 2
    names = arrays.RangeHash(data, 11).fixed(CORE)
    long_names = arrays.RangeHash(data, 41)
    low = offsets[doc] + at
    sizes = n + width  # names that the strings of the run hold
    first = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(at)), sizes)
    values = names[low[run] + np.arange(len(run)) - first[run]]
    found = np.flatnonzero(values == np.minimum.reduceat(values, first)[run])
    run = run[found]
    core = low[run] + found - first[run]
    before = np.append(-1, core[:-1])
    before[np.append(True, run[1:] != run[:-1])] = -1
    begin = np.maximum(np.maximum(low[run], core - width), before + 1)
    end = np.minimum((low + n - 1)[run], core)
    out = []
    for left in (True, False):
        lo = begin if left else np.maximum(begin, core - side + 1)
        hi = np.minimum(end, core - side) if left else end
        name_at = core - side if left else core
        some = lo <= hi
        some &= (name_at >= offsets[doc[run]]) & (name_at + CORE + side <= offsets[doc[run] + 1])
        place = name_at[some]
        owner = doc[run[some]]
        out.append((long_names(place, place + CORE + side), owner, lo[some] - offsets[owner], (hi - lo + 1)[some]))
    return tuple(np.concatenate(x) for x in zip(*out))


def shared_names(name: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Which names stand in several documents of the slice."""
    out = np.zeros(len(name), bool)
    if len(name):
        order = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        ids = doc_id[order]
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        out[order] = np.repeat(several, np.diff(np.append(first, len(name))))
    return out


def covered_spans(keyed: DataFrame, length: int = 50) -> DataFrame:
    """(doc, tie, held): per document the spans of positions whose ``length``
    bytes stand in a smaller document.  ``keyed`` has doc, tie and text."""
    half = length // 2

    def first(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                least, whole, doc, at, n = runs(data, offsets, length)
                # 48 bits of the least name, then the 64 of the run's: 16 and 48
                low = np.uint64(16)
                a = ((least >> low) << low) | (whole >> np.uint64(48))
                b = whole & np.uint64(0xFFFFFFFFFFFF)
                ids, ties = rows.column("doc").to_numpy(), rows.column("tie").to_numpy()
                yield settled(a, b, least >> low, ids[doc], ties[doc], at, n, True)

    one = staged(reranked(keyed.mapInArrow(first, ROWS), 16, True), "suffix-20", True)

    probe_rows = T.StructType([*FOUND.fields, T.StructField("name", T.LongType()), T.StructField("shared", T.BooleanType())])

    def second(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                name, doc, at, n = probes(data, offsets, *_held(rows, offsets), length)
                ids, ties = rows.column("doc").to_numpy(), rows.column("tie").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ties[doc]), pa.array(spans(at, n, LOOK)),
                                                  pa.array(name.view(np.int64)), pa.array(shared_names(name, ids[doc]))], probe_rows.fieldNames())

    probed = staged(per_document(keyed, one.where(F.expr(KNOWN) == LOOK)).mapInArrow(second, probe_rows), "suffix-35", True)
    shared = probed.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("name")
    # a name that a slice shows in several documents needs no look-up, so a
    # very common passage sends few rows to one place
    look = probed.where("shared").select("doc", "tie", "span") \
        .unionByName(probed.where("NOT shared").join(shared, "name").select("doc", "tie", "span"))
    look = staged(look, "suffix-look", True)

    def third(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                doc, at, n = _held(rows, offsets)
                index = np.repeat(np.arange(len(at)), n)
                doc, at = doc[index], at[index] + np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
                place = offsets[doc] + at
                hashed = arrays.RangeHash(data, 37)
                a, b = hashed(place, place + half), hashed(place + half, place + length)
                ids, ties = rows.column("doc").to_numpy(), rows.column("tie").to_numpy()
                yield settled(a, b, a, ids[doc], ties[doc], at, np.ones(len(at), np.int64), False)

    two = staged(reranked(per_document(keyed, look).mapInArrow(third, ROWS), 0, False), "suffix-50", True)
    found = one.where(F.expr(KNOWN) == COVERED).unionByName(two)
    return found.groupBy("doc", "tie").agg(F.collect_list("span").alias("held"))


def cut(text: bytes, at: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """(what remains, bytes removed, maximal removed runs)."""
    inside = at + n - 1 + length <= len(text)
    if not inside.all():  # another text under the same id and hash
        at, n = at[inside], n[inside]
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + n - 1 + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    if not gone.any():
        return text, 0, 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _keyed(docs: DataFrame, id_col: str, text_col: str):
    # Documents under one id are told apart by a hash of their text: 32 bits do where they share an id; of those without
    # one there may be very many, so they take 64 (10**8 different ones meet with a chance of 3e-4).
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), tie.alias("tie"), text.alias("text")]


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                       T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _spans_of(batch: pa.RecordBatch, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    held = batch.column(column)[k]
    span = held.values.to_numpy() if held.is_valid else np.zeros(0, np.int64)
    return span >> 22, (span >> 2) & MOST


def removal_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    keyed = docs.select(*_keyed(docs, id_col, text_col))
    joined = keyed.join(covered_spans(keyed, length), ["doc", "tie"], "left")

    def run(batches):
        for batch in batches:
            rows = []
            for k, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("text"))):
                raw = text.as_buffer().to_pybytes() if text.as_py() else b""
                kept, removed, spans = cut(raw, *_spans_of(batch, "held", k), length)
                rows.append((None if doc == LAST_ID else doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], DIGEST.fieldNames())

    return joined.select("doc", "text", "held").mapInArrow(run, DIGEST)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the covered bytes removed from the text (a character cut
    in part goes as a whole) and ``chars_col``, if there, counted anew."""
    doc, tie, held = apart(docs.columns, "doc", "tie", "held")
    as_doc, as_tie, as_text = _keyed(docs, id_col, text_col)
    found = covered_spans(docs.select(as_doc, as_tie, as_text), length) \
        .select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("held").alias(held))
    joined = docs.withColumns({doc: as_doc, tie: as_tie}).join(found, [doc, tie], "left").select(*docs.columns, held)

    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = []
            for k, text in enumerate(batch.column(text_col)):
                value = text.as_py()
                if value:
                    kept, removed, _ = cut(value.encode(), *_spans_of(batch, held, k), length)
                    value = kept.decode("utf-8", "ignore") if removed else value
                texts.append(value)
            columns = []
            for name in names:
                if name == text_col:
                    columns.append(pa.array(texts, batch.column(name).type))
                elif name == chars_col:
                    columns.append(pa.array([None if t is None else len(t) for t in texts], batch.column(name).type))
                else:
                    columns.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
