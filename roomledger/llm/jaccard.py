"""N-gram Jaccard join (operator 13): rare-first prefix filtering.

A document is the set of its five-word shingles (64-bit hashes of the
lower-cased words).  Two sets link when 100 * common >= PERCENT * union.

1. Equal sets are one node (a 128-bit sum of the set).  A task numbers the
   nodes of about ``FLUSH`` shingles; a shingle that occurs once there goes to
   its bucket with its owner's number, one that occurs more often goes as one
   counted entry, and its owners go straight to the place where the flush is
   put together again.  So a very frequent shingle is one entry a flush.
2. Buckets count in how many nodes each shingle occurs and send the shared
   ones back.  What a node shares with nobody can be in no intersection; a
   node that shares less than ``PERCENT`` of its set has no link and leaves.
3. Shared shingles are ordered rare first.  A linked pair has a shingle in
   common within the first ``n - ceil(PERCENT / 100 * n) + 1`` of both sets
   (unshared ones count as the first), so nodes meet in the lists of those.
4. Of each list all members are compared with its hub, the least of them, if
   the length and positional filters leave a chance.  Linked ones are joined
   into components, so of a large group of near copies hardly any pair is
   looked at.
5. Lists whose members still lie in different components are open.  Their
   members are dealt into blocks of bounded size, and each pair of blocks is
   one task group.  A pair of members of different components is looked at in
   the list of its first common prefix shingle alone, after the length,
   positional and suffix filters, and verified there on the whole sets.
   A group returns at most the links that join its components.

No link between components is lost, so components are exact; links inside a
component, which change nothing, are not enumerated.  Shingles are compared
by 56 bits of the hash and their frequency class: in 10**11 compared pairs of
500 shingles about 0.4 are expected to count one common shingle too many.

Cases: null and empty texts, and texts without a word, have an empty set,
link with nothing and are their own component (their id); a text of fewer
words than a shingle is one shingle; ties and repeated rows are equal sets
and fall into one component, rows without an id too (a component's id is the
least id in it, null only if it has none); very long texts are sets like any
others, and a block holds at least one member whatever its size; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, groups, wordids
from .minhash import components
from .staging import staged

SHINGLE = 5
PERCENT = 80
FLUSH = 1 << 19  # shingles numbered together
BUCKET = 1 << 19  # shingles of a bucket
BLOCK = 1 << 16  # shingles of the members of a block
MANY = (1 << 16) - 1  # the number that stands for several owners
PIVOTS = 16
CELLS = 1 << 22  # of a matrix held at once


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, BYTES = T.LongType(), T.IntegerType(), T.BinaryType()
NODES = _schema(id=LONG, hi=LONG, lo=LONG, n=LONG)
FORWARD = _schema(part=LONG, flush=LONG, kind=INT, a=BYTES, b=BYTES, c=BYTES)
BACK = _schema(flush=LONG, kind=INT, a=BYTES, b=BYTES, c=BYTES)
SETS = _schema(ref=LONG, hi=LONG, lo=LONG, n=LONG, shared=LONG, keys=BYTES)
LISTS = _schema(key=LONG, ref=LONG, n=LONG, pos=LONG, shared=LONG)
PAIRS = _schema(a=LONG, b=LONG)


# --- sets ---------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of a slice, distinct, by document and shingle."""
    data = wordids.lowered(data)
    words = arrays.Words(data, offsets)
    hashed, doc = arrays.shingles(words, arrays.RangeHash(data)(words.start, words.end), size)
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], hashed[new]


def set_sums(doc: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, size) of each document's set; equal sets have equal sums."""
    cuts = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(arrays.mix(arrays.mix(shingle ^ np.uint64(seed)) + np.uint64(seed)), out=sums[1:])
        out.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    return out[0], out[1], np.diff(cuts)


def node_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, hi, lo, n) of every row of ``docs`` (id, text)."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                hi, lo, n = set_sums(*shingle_sets(data, offsets, size), rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(hi), pa.array(lo), pa.array(n)], NODES.fieldNames())

    return docs.select("id", "text").mapInArrow(run, NODES)


# --- shared shingles ----------------------------------------------------------


class Flush:
    """The distinct sets of some slices, numbered from 0."""

    def __init__(self):
        self.known: set[tuple[int, int]] = set()
        self.sums, self.docs, self.shingles, self.size = [], [], [], 0

    def add(self, doc: np.ndarray, shingle: np.ndarray, n: int) -> None:
        hi, lo, size = set_sums(doc, shingle, n)
        number = np.full(n, -1, np.int64)
        for k in np.flatnonzero(size).tolist():
            name = int(hi[k]), int(lo[k])
            if name not in self.known:
                number[k] = len(self.known)
                self.known.add(name)
        new = np.flatnonzero(number >= 0)
        chosen = number[doc] >= 0
        self.sums.append(np.stack([hi[new], lo[new], size[new]]))
        self.docs.append(number[doc[chosen]])
        self.shingles.append(shingle[chosen])
        self.size += int(chosen.sum())

    def full(self, next_docs: int) -> bool:
        return self.size >= FLUSH or len(self.known) + next_docs >= MANY

    def rows(self, name: int, parts: int) -> Iterator[tuple]:
        doc, shingle = np.concatenate(self.docs), np.concatenate(self.shingles)
        order = np.argsort(shingle, kind="stable")
        doc, shingle = doc[order].astype(np.uint16), shingle[order]
        lead = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        count = np.diff(np.append(lead, len(shingle))).astype(np.uint32)
        several = np.repeat(count > 1, count)
        hi, lo, size = np.concatenate(self.sums, axis=1)
        home = name % parts
        yield home, name, 1, hi.tobytes(), lo.tobytes(), size.tobytes()
        if several.any():
            yield home, name, 2, shingle[several].tobytes(), doc[several].tobytes(), b""
        owner, shingle = np.where(count > 1, MANY, doc[lead]).astype(np.uint16), shingle[lead]
        part = (arrays.mix(shingle) % np.uint64(parts)).astype(np.int64)
        # within a bucket by owner: long equal stretches of the numbers compress well
        order = np.lexsort((owner, part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[p]: bounds[p + 1]]
            yield p, name, 0, shingle[own].tobytes(), owner[own].tobytes(), count[own].tobytes()


def _batches(rows: Iterator[tuple], schema: T.StructType, at_once: int = 64) -> Iterator[pa.RecordBatch]:
    types = {LONG: pa.int64(), INT: pa.int32(), BYTES: pa.binary()}
    kinds, held = [types[f.dataType] for f in schema.fields], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema.fieldNames())

    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield batch()
            held = []
    if held:
        yield batch()


def frequency_class(count: np.ndarray) -> np.ndarray:
    """A class of eighths of octaves: rising with the count, the same on any
    machine (exact arithmetic)."""
    part, power = np.frexp(count.astype(np.float64))
    return np.minimum(((power - 1) * 8 + np.floor((part * 2 - 1) * 8)).astype(np.int64), 255).astype(np.uint64)


def _count_bucket(rows: pa.Table) -> Iterator[tuple]:
    """Of one bucket: the shingles that two sets or more share, with their
    counts, for each flush; everything else is handed on."""
    kinds = rows.column("kind").to_numpy()
    for k in np.flatnonzero(kinds > 0).tolist():
        yield tuple(rows.column(c)[k].as_py() for c in BACK.fieldNames())
    own = rows.filter(pa.array(kinds == 0))
    if not own.num_rows:
        return
    shingle, sizes = groups.joined(own.column("a"), np.uint64)
    owner, count = groups.joined(own.column("b"), np.uint16)[0], groups.joined(own.column("c"), np.uint32)[0].astype(np.int64)
    order = np.argsort(shingle, kind="stable")
    sorted_ = shingle[order]
    lead = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    total = np.empty(len(shingle), np.int64)
    total[order] = np.repeat(np.add.reduceat(count[order], lead), np.diff(np.append(lead, len(order))))
    cuts = np.append(0, np.cumsum(sizes))
    for k, flush in enumerate(own.column("flush").to_pylist()):
        keep = cuts[k] + np.flatnonzero(total[cuts[k]: cuts[k + 1]] > 1)
        if len(keep):
            yield flush, 0, shingle[keep].tobytes(), owner[keep].tobytes(), total[keep].tobytes()


def _put_together(rows: pa.Table, percent: int) -> Iterator[tuple]:
    """The sets of one flush that share enough, rare shingles first."""
    kinds = rows.column("kind").to_numpy()

    def packed(kind: int, **columns) -> list[np.ndarray]:
        chosen = rows.filter(pa.array(kinds == kind))
        return [groups.joined(chosen.column(c), dtype)[0] for c, dtype in columns.items()]

    hi, lo, size = packed(1, a=np.int64, b=np.int64, c=np.int64)
    several, owners = packed(2, a=np.uint64, b=np.uint16)
    shingle, owner, total = packed(0, a=np.uint64, b=np.uint16, c=np.int64)
    many = owner == MANY
    order = np.argsort(shingle[many])
    place = order[np.searchsorted(shingle[many], several, sorter=order)] if len(several) else np.zeros(0, np.int64)
    doc = np.concatenate([owner[~many], owners]).astype(np.int64)
    count = np.concatenate([total[~many], total[many][place]])
    key = (frequency_class(count) << np.uint64(56)) | (np.concatenate([shingle[~many], several]) & np.uint64((1 << 56) - 1))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    cuts = np.searchsorted(doc, np.arange(len(size) + 1))
    flush = rows.column("flush")[0].as_py()
    shared = np.diff(cuts)
    for k in np.flatnonzero(100 * shared >= percent * size).tolist():
        yield flush << 16 | k, int(hi[k]), int(lo[k]), int(size[k]), int(shared[k]), key[cuts[k]: cuts[k + 1]].tobytes()


def shared_sets(docs: DataFrame, shingles: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(ref, hi, lo, n, shared, keys): sets that may have a link; ``keys`` are
    their shared shingles, rare first.  A set may come from several flushes.
    ``shingles``: how many there are, for the number of buckets."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET + 1)

    def forward(batches):
        def rows():
            flush, number, task = Flush(), 0, TaskContext.get().partitionId()
            for batch in batches:
                for rows, data, offsets in arrays.slices(batch):
                    if flush.size and flush.full(rows.num_rows):
                        yield from flush.rows(task << 20 | number, parts)
                        flush, number = Flush(), number + 1
                    flush.add(*shingle_sets(data, offsets, size), rows.num_rows)
            if flush.size:
                yield from flush.rows(task << 20 | number, parts)

        return _batches(rows(), FORWARD)

    def count(batches):
        return _batches((row for table in groups.by_group(batches, "part") for row in _count_bucket(table)), BACK)

    def put(batches):
        return _batches((row for table in groups.by_group(batches, "flush") for row in _put_together(table, percent)), SETS)

    counted = docs.select("id", "text").mapInArrow(forward, FORWARD).repartition(parts, "part").sortWithinPartitions("part") \
        .mapInArrow(count, BACK)
    return counted.repartition("flush").sortWithinPartitions("flush").mapInArrow(put, SETS)


# --- lists and filters --------------------------------------------------------


def prefix_lists(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, ref, n, pos, shared): one row per prefix shingle that is shared;
    ``pos`` counts the unshared ones too."""

    def run(batches):
        for batch in batches:
            ref, n, shared = (batch.column(c).to_numpy() for c in ("ref", "n", "shared"))
            prefix = np.maximum(n - (percent * n + 99) // 100 + 1 - (n - shared), 0)
            keys = [np.frombuffer(k.as_buffer(), np.uint64)[:p] for k, p in zip(batch.column("keys"), prefix.tolist())]
            rows = np.repeat(np.arange(len(ref)), prefix)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(prefix) - prefix, prefix) + (n - shared)[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)), pa.array(ref[rows]), pa.array(n[rows]),
                 pa.array(pos), pa.array(shared[rows])], LISTS.fieldNames())

    return sets.select("ref", "n", "shared", "keys").mapInArrow(run, LISTS)


def needed(total, percent: int = PERCENT):
    """The least number of common shingles of a linked pair whose sizes add
    up to ``total`` (numpy or plain integers)."""
    return -(-percent * total // (100 + percent))


def _may_link(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Length and positional filter of two members of a list, whatever they
    have in common before it."""
    total = n + other_n
    least = -F.floor(-(F.lit(percent) * total) / F.lit(100 + percent))
    most = F.least(pos, other_pos) + 1 + F.least(n - pos, other_n - other_pos) - 1
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (most >= least)


def _filtered(n: np.ndarray, pos: np.ndarray, other_n: np.ndarray, other_pos: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of two blocks that the length and positional filters leave, when
    the list is the first in which a pair meets."""
    n, pos = n[:, None], pos[:, None]
    rest = np.minimum(n - pos, other_n - other_pos)
    return (100 * np.minimum(n, other_n) >= percent * np.maximum(n, other_n)) & (rest >= needed(n + other_n, percent))


def suffix_bounds(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Suffix filter: the sorted sets are cut by common pivots; within a
    range two sets have no more in common than the smaller part."""
    everything = np.concatenate([*left, *right])
    if not len(everything):
        return np.zeros((len(left), len(right)), np.int64)
    pivots = np.unique(np.quantile(everything, np.linspace(0, 1, PIVOTS + 1)[1:-1], method="nearest"))

    def ranges(sets):
        return np.stack([np.diff(np.concatenate([[0], np.searchsorted(s, pivots), [len(s)]])) for s in sets])

    x, y = ranges(left), ranges(right)
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(x.shape[1]):
        out += np.minimum(x[:, k, None], y[None, :, k])
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each pair of sets: the product of
    their incidence matrices over the elements that both sides have."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    width = max(1, CELLS // max(len(left), len(right)))

    def incidence(sets, columns):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        hit = columns[at] == values
        matrix = np.zeros((len(sets), len(columns)), np.float32)
        matrix[owner[hit], at[hit]] = 1
        return matrix

    for begin in range(0, len(both), width):
        columns = both[begin: begin + width]
        out += np.rint(incidence(left, columns) @ incidence(right, columns).T).astype(np.int64)
    return out


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("keys")]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


# --- links --------------------------------------------------------------------


def hub_pairs(lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): members and hubs of lists that may link, each pair once."""
    hubs = lists.groupBy("key").agg(F.min(F.struct("ref", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = lists.join(hubs, "key").where(F.col("ref") != F.col("hub.ref"))
    return met.where(_may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent)) \
        .select(F.col("ref").alias("a"), F.col("hub.ref").alias("b"), "shared").distinct()


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The linked ones of (a, b).  A hub's members are dealt into salted
    groups of bounded size; the hub's set goes to each group once."""
    salts = pairs.groupBy("b").agg((F.floor(F.sum("shared") / BLOCK) + 1).cast("int").alias("salts"))
    body = sets.select("ref", "n", "keys")
    members = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")) \
        .join(body.withColumnRenamed("ref", "a"), "a").select("b", "salt", F.lit(1).alias("member"), F.col("a").alias("ref"), "n", "keys")
    hubs = salts.join(body.withColumnRenamed("ref", "b"), "b") \
        .select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.lit(0).alias("member"),
                F.col("b").alias("ref"), "n", "keys")

    def run(batches):
        for table in groups.by_group(batches, "b", "salt"):
            is_member = table.column("member")
            hub, own = table.filter(pc.equal(is_member, 0)), table.filter(pc.equal(is_member, 1))
            if not own.num_rows:
                continue
            left, right = _sets(own), _sets(hub)
            (ref, n), (b, hub_n) = _numbers(own, "ref", "n"), _numbers(hub, "ref", "n")
            least = needed(n + hub_n[0], percent)
            ask = np.flatnonzero(suffix_bounds(left, right)[:, 0] >= least)
            if len(ask):
                linked = ask[overlaps([left[k] for k in ask], right)[:, 0] >= least[ask]]
                yield pa.RecordBatch.from_arrays([pa.array(ref[linked]), pa.array(np.full(len(linked), b[0]))], PAIRS.fieldNames())

    return members.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt").mapInArrow(run, PAIRS)


BLOCKS = ["key", "i", "j"]


def open_blocks(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, i, j, side, ref, n, pos, label): members of the open lists, once
    for each pair of blocks that theirs is in."""
    marked = lists.join(labels.select(F.col("node").alias("ref"), "label"), "ref", "left") \
        .withColumn("label", F.coalesce("label", "ref"))
    opened = marked.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.sum("shared").alias("total")) \
        .where("least <> most").select("key", (F.floor(F.col("total") / BLOCK) + 1).cast("int").alias("blocks"))
    dealt = marked.join(opened, "key").withColumn("own", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "ref", "n", "pos", "label")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS)


def _two_sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The blocks of a pair and whether they are one block."""
    if table.column("i")[0].as_py() == table.column("j")[0].as_py():
        return table, table, True
    side = table.column("side")
    return table.filter(pc.equal(side, 0)), table.filter(pc.equal(side, 1)), False


def _possible(left: pa.Table, right: pa.Table, same: bool, percent: int) -> np.ndarray:
    """Pairs of members of different components that the length and the
    positional filter leave."""
    n, pos, label = _numbers(left, "n", "pos", "label")
    other_n, other_pos, other_label = _numbers(right, "n", "pos", "label")
    possible = _filtered(n, pos, other_n, other_pos, percent) & (label[:, None] != other_label)
    return np.triu(possible, 1) if same else possible


def in_question(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``blocks`` that have a possible partner in their group."""
    schema = blocks.schema

    def run(batches):
        for table in groups.by_group(batches, *BLOCKS):
            left, right, same = _two_sides(table)
            possible = _possible(left, right, same, percent)
            own, other = possible.any(axis=1), possible.any(axis=0)
            kept = [left.filter(pa.array(own | other))] if same else [left.filter(pa.array(own)), right.filter(pa.array(other))]
            for part in kept:
                yield from part.combine_chunks().to_batches()

    return _grouped(blocks).mapInArrow(run, schema)


def _first_meeting(left: list[np.ndarray], right: list[np.ndarray], key: np.uint64) -> np.ndarray:
    """Pairs that have nothing in common before ``key``.  What they have lies
    in both prefixes, as ``key`` itself does, so it is their first list."""
    left, right = [s[: np.searchsorted(s, key)] for s in left], [s[: np.searchsorted(s, key)] for s in right]
    return overlaps(left, right) == 0


def block_links(blocks: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join components, found in pairs of blocks."""
    held = blocks.join(sets.select("ref", "keys"), "ref")

    def run(batches):
        for table in groups.by_group(batches, *BLOCKS):
            left, right, same = _two_sides(table)
            possible = _possible(left, right, same, percent)
            x, y = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
            if not len(x):
                continue
            left, right, possible = left.take(pa.array(x)), right.take(pa.array(y)), possible[np.ix_(x, y)]
            (a, n, label), (b, other_n, other_label) = _numbers(left, "ref", "n", "label"), _numbers(right, "ref", "n", "label")
            left, right = _sets(left), _sets(right)
            least = needed(n[:, None] + other_n, percent)
            possible &= suffix_bounds(left, right) >= least
            if possible.any():
                possible &= _first_meeting(left, right, np.int64(table.column("key")[0].as_py()).view(np.uint64))
            if possible.any():
                found = np.argwhere(possible & (overlaps(left, right) >= least))
                chosen = spanning(label[found[:, 0]], other_label[found[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(a[found[chosen, 0]]), pa.array(b[found[chosen, 1]])], PAIRS.fieldNames())

    return _grouped(held).mapInArrow(run, PAIRS)


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of links between components those that join two that were apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


# --- the operator -------------------------------------------------------------


def linked_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the least id
    that links reach from it."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = staged(node_table(docs, size), "sets", True)
    nodes = table.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.max("n").alias("n"))
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sets = staged(shared_sets(docs, shingles, size, percent), "shared", True)
    # of a set that several flushes have, one is compared
    refs = staged(sets.groupBy("hi", "lo").agg(F.min("ref").alias("ref")), "refs")
    lists = staged(prefix_lists(sets, percent).join(refs.select("ref"), "ref", "left_semi"), "lists", True)
    links = staged(hub_links(hub_pairs(lists, percent), sets, percent), "links", True)
    labels = staged(components(links), "labels")
    asked = staged(in_question(open_blocks(lists, labels), percent), "asked", True)
    more = staged(block_links(asked, sets, percent), "more", True)
    if not more.isEmpty():
        labels = staged(components(links.unionByName(more)), "labels")
    labelled = nodes.select("hi", "lo", "least").join(refs, ["hi", "lo"], "left") \
        .join(labels.withColumnRenamed("node", "ref"), "ref", "left") \
        .withColumn("label", F.coalesce("label", "ref"))
    by_label = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(by_label, "label", "left").select("hi", "lo", F.coalesce("component_id", "least").alias("component_id"))
    texts = table.where("n > 0").join(by_node, ["hi", "lo"]).select("id", "n", "component_id")
    empty = table.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return texts.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
