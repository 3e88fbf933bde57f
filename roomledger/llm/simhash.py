"""Document fingerprints (operator 4): SimHash.

Every term (a window of ``size`` words) has a 64-bit hash per fingerprint
word; each occurrence votes with +1 or -1 on every bit, so a term weighs as
often as it stands in the text, and the sign of the sum is the bit.

``within_radius`` finds all pairs of fingerprints that differ in at most
``radius`` bits without comparing all of them: the bits are cut into
``blocks`` > radius blocks; two such fingerprints agree on at least
``blocks - radius`` whole blocks, so for every choice of that many blocks a
table is keyed by their bits (the blocks permuted to the front) and only
fingerprints with an equal key meet.  Equal fingerprints are one entry with
a count.  A table bucket is worked off in hashed square blocks, so no task
holds a whole bucket.

A pair of fingerprints meets in several tables; it counts in the first of
them only.  ``near_counts`` returns how many others each fingerprint has
within the radius, so a large group of near fingerprints gives a row for each
and pair of blocks, not one for each pair.

Cases: null is the empty text; a text without a word has the fingerprint 0;
fewer words than a window make one term; ties of a vote give bit 0; repeated
rows have equal fingerprints; very long texts are fingerprinted whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, groups
from .staging import staged

BITS = 128
SIZE = 2  # words per term


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, bits: int = BITS) -> np.ndarray:
    """(documents, bits / 8) bytes: the fingerprint of each text of a slice."""
    n = len(offsets) - 1
    words = arrays.Words(data, offsets)
    terms, doc = arrays.shingles(words, arrays.RangeHash(data)(words.start, words.end), size)
    out = np.zeros((n, bits // 8), np.uint8)
    if not len(terms):
        return out
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    totals = np.diff(np.append(first, len(doc)))
    for lane in range(bits // 64):
        hashed = arrays.mix(terms + np.uint64(0xD1B54A32D192ED03 * (lane + 1) % (1 << 64)))
        ones = np.zeros((len(first), 64), np.int64)
        step = 1 << 15  # bounds the unpacked bits in memory
        raw = hashed.view(np.uint8).reshape(-1, 8)
        for a in range(0, len(raw), step):
            b = min(a + step, len(raw))
            inner = np.searchsorted(first, a, "right") - 1
            cuts = np.unique(np.append(a, first[(first > a) & (first < b)])) - a
            sums = np.add.reduceat(np.unpackbits(raw[a:b], axis=1), cuts, axis=0, dtype=np.int32)
            ones[inner: inner + len(cuts)] += sums
        signs = 2 * ones > totals[:, None]
        out[doc[first], 8 * lane: 8 * lane + 8] = np.packbits(signs, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of differing bits."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / (8.0 * a.shape[1])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                      bits: int = BITS) -> DataFrame:
    """One row per document: id, fingerprint (binary).  No shuffle."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                prints = fingerprints(data, offsets, size, bits)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array([p.tobytes() for p in prints], pa.binary())], [id_col, "fingerprint"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


# --- a document and its edited form ------------------------------------------


def _prefix_bytes(text: bytes, n_chars: int) -> int:
    """Bytes of the first ``n_chars`` code points."""
    if n_chars <= 0:
        return 0
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return len(text) if n_chars >= len(starts) else int(starts[n_chars])


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text with its last floor(n / 2) code points replaced
    by the first as many, or all, of the following text)."""
    n = int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    return n, text[: _prefix_bytes(text, n - n // 2)] + following[: _prefix_bytes(following, n // 2)]


def _batch_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def compared(ids: list, texts: list[bytes], following: list[bytes], size: int, bits: int) -> pa.RecordBatch:
    """The result rows of documents, each with its following text."""
    pairs = [edited(a, b) for a, b in zip(texts, following)]
    own = fingerprints(*_batch_of(texts), size, bits)
    changed = fingerprints(*_batch_of([e for _, e in pairs]), size, bits)
    shifted = texts[1:] + following[-1:]
    if all(a is b or a == b for a, b in zip(shifted, following)):  # a run of the order: each next one is here
        after = np.vstack([own[1:], fingerprints(*_batch_of(following[-1:]), size, bits)])
    else:
        after = fingerprints(*_batch_of(following), size, bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([n for n, _ in pairs], pa.int64()),
         pa.array([hashlib.sha256(e).hexdigest() for _, e in pairs], pa.string()),
         pa.array([p.tobytes().hex() for p in own], pa.string()), pa.array([p.tobytes().hex() for p in changed], pa.string()),
         pa.array(likeness(own, changed)), pa.array(likeness(own, after))], EDITED.fieldNames())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                        bits: int = BITS) -> DataFrame:
    """Per document the fingerprint of its text and of its edited text, whose
    second half is taken from the next document in ascending id (null first;
    equal ids by a hash of the text; after the last comes the first).

    The rows are sorted by a range partitioning, once; each task compares
    neighbours as they pass.  The last row of a partition needs the first of
    the next one: only those border rows (two per partition) are joined.
    """
    fields = [*EDITED.fields, T.StructField("part", T.IntegerType()), T.StructField("border", T.StringType()),
              T.StructField("text", T.BinaryType())]
    schema = T.StructType(fields)

    def border(part: int, kind: str, doc_id, text: bytes) -> pa.RecordBatch:
        row = {f.name: None for f in fields} | {"doc_id": doc_id, "part": part, "border": kind, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=arrow_schema)

    arrow_schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                              ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                              ("near_next", pa.float64()), ("part", pa.int32()), ("border", pa.string()), ("text", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                raw = data.tobytes()
                ids = rows.column("id").to_pylist()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                if held is None:
                    yield border(part, "first", ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                if len(ids) > 1:
                    done = compared(ids[:-1], texts[:-1], texts[1:], size, bits)
                    empty = [pa.nulls(done.num_rows, f.type) for f in list(arrow_schema)[-3:]]
                    yield pa.RecordBatch.from_arrays([*done.columns, *empty], schema=arrow_schema)
                held = ids[-1], texts[-1]
        if held is not None:
            yield border(part, "last", *held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the hash of the text spreads the rows of a repeated id over partitions
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie") \
        .sortWithinPartitions("id", "tie").select("id", "text")
    found = staged(ordered.mapInArrow(run, schema), "fingerprints", True)
    done = found.where(F.col("border").isNull()).select(*EDITED.fieldNames())

    # Border rows: two per partition.  A window over one of them per
    # partition finds the next partition that has rows.
    heads = found.where(F.col("border") == "first").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    parts = heads.select("part")
    following = parts.select("part", F.lead("part").over(order).alias("next"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("first"))
    following = following.select("part", F.coalesce("next", "first").alias("next"))
    lasts = found.where(F.col("border") == "last").select("doc_id", "part", "text").join(following, "part") \
        .join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield compared([batch.column(0)[k].as_py()], [batch.column(1)[k].as_py()], [batch.column(2)[k].as_py()], size, bits)

    return done.unionByName(lasts.mapInArrow(finish, EDITED))


# --- all fingerprints within a Hamming radius ---------------------------------

BLOCK = 1000  # fingerprints of a block of a bucket
NEAR = ["slot", "key", "i", "j"]


def fingerprint_classes(docs: DataFrame, radius: int = 3, blocks: int = 6, **options) -> DataFrame:
    """``edited_fingerprints`` with the class of each document (the least id
    of its fingerprint, null if none has an id), the size of the class and the
    number of other fingerprints in the corpus within ``radius`` bits."""
    rows = staged(edited_fingerprints(docs, **options), "documents")
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    prints = staged(prints.withColumn("print", F.unhex("fingerprint")), "prints")
    near = near_counts(prints, radius, blocks, options.get("bits", BITS))
    found = prints.join(near, "print", "left").select("fingerprint", "class_id", "class_size", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"))
    return rows.join(found, "fingerprint").select(*rows.columns, "class_id", "class_size", "n_near")


def near_counts(prints: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS) -> DataFrame:
    """(print, near): of distinct fingerprints (``print``, binary) those that
    others differ from in at most ``radius`` bits, and how many others."""
    if not radius < blocks <= bits:
        raise ValueError("blocks must exceed the radius")
    edges = [bits * k // blocks for k in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))
    whole = np.zeros((blocks, bits), bool)
    for k in range(blocks):
        whole[k, edges[k]: edges[k + 1]] = True
    keyed = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("print", T.BinaryType())])

    def keys(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, bits // 8)
            unpacked = np.unpackbits(raw, axis=1)
            for t, chosen in enumerate(tables):
                front = np.packbits(np.concatenate([unpacked[:, edges[c]: edges[c + 1]] for c in chosen], axis=1), axis=1)
                width = front.shape[1]
                names = arrays.RangeHash(front.reshape(-1), t + 1)(np.arange(len(raw)) * width, (np.arange(len(raw)) + 1) * width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array(names.view(np.int64)), batch.column("print")],
                                                 keyed.fieldNames())

    table = prints.select("print").mapInArrow(keys, keyed)
    sizes = table.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = table.join(sizes, ["slot", "key"]).withColumn("deal", F.expr(f"CAST(n DIV {BLOCK} + 1 AS INT)")) \
        .withColumn("own", F.expr("CAST(pmod(xxhash64(print), deal) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))) \
        .select("slot", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "print")
    counted = T.StructType([T.StructField("print", T.BinaryType()), T.StructField("near", T.LongType())])

    def compare(batches):
        for group in groups.by_group(batches, *NEAR):
            slot = group.column("slot")[0].as_py()
            raw = np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint8).reshape(-1, bits // 8)
            side = group.column("side").to_numpy()
            same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            left, right = (raw, raw) if same else (raw[side == 0], raw[side == 1])
            mine, its = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for k in range(len(left)):
                change = right ^ left[k]
                distance = np.bitwise_count(change).sum(axis=1)
                found = np.flatnonzero((distance <= radius) & (distance > 0))
                if len(found):
                    # the first table whose blocks are all equal
                    equal = ~(np.unpackbits(change[found], axis=1).astype(bool)[:, None, :] & whole).any(axis=2)
                    first = np.argmax([equal[:, list(t)].all(axis=1) for t in tables], axis=0)
                    found = found[first == slot]
                    mine[k] += len(found)
                    if not same:
                        its[found] += 1
            prints, near = (left, mine) if same else (np.concatenate([left, right]), np.concatenate([mine, its]))
            some = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array([prints[k].tobytes() for k in some], pa.binary()), pa.array(near[some])], counted.fieldNames())

    return dealt.repartition(*NEAR).sortWithinPartitions(*NEAR).mapInArrow(compare, counted).groupBy("print").agg(F.sum("near").alias("near"))


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6, bits: int = BITS, id_col: str = "doc_id",
                  print_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(classes, links): one row per id with the id of its class (the least id
    that has the same fingerprint; null prints have none), and the pairs of
    classes whose fingerprints differ in at most ``radius`` bits, with the
    distance.  No pair is lost: see the module text."""
    if not radius < blocks <= bits:
        raise ValueError("blocks must exceed the radius")
    edges = [bits * k // blocks for k in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))
    assert len(tables) == comb(blocks, radius)
    given = prints.where(F.col(print_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(print_col).alias("print"))
    distinct = staged(given.groupBy("print").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")), "prints")
    classes = given.join(distinct, "print").select(F.col("id").alias(id_col), "class_id", "members")

    keyed = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("key", T.BinaryType()),
                          T.StructField("class_id", distinct.schema["class_id"].dataType), T.StructField("print", T.BinaryType())])

    def keys(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, bits // 8)
            unpacked = np.unpackbits(raw, axis=1)
            for t, chosen in enumerate(tables):
                front = np.packbits(np.concatenate([unpacked[:, edges[c]: edges[c + 1]] for c in chosen], axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), t, np.int32)), pa.array([f.tobytes() for f in front], pa.binary()),
                     batch.column("class_id"), batch.column("print")], keyed.fieldNames())

    table = distinct.select("class_id", "print").mapInArrow(keys, keyed)
    sizes = table.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # hashed blocks of about 1,000 fingerprints: a bucket is compared block by block
    dealt = table.join(sizes, ["table", "key"]).withColumn("deal", F.expr("CAST(n DIV 1000 + 1 AS INT)")) \
        .withColumn("row", F.expr("CAST(pmod(xxhash64(class_id), deal) AS INT)"))
    packed = dealt.groupBy("table", "key", "deal", "row").agg(F.collect_list(F.struct("class_id", "print")).alias("held"))
    left, right = packed.alias("l"), packed.alias("r")
    squares = left.join(right, (F.col("l.table") == F.col("r.table")) & (F.col("l.key") == F.col("r.key"))
                        & (F.col("l.row") <= F.col("r.row"))).select(F.col("l.held").alias("a"), F.col("r.held").alias("b"))
    linked = T.StructType([T.StructField("class_a", distinct.schema["class_id"].dataType),
                           T.StructField("class_b", distinct.schema["class_id"].dataType), T.StructField("distance", T.IntegerType())])

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for side in (0, 1):
                    held = batch.column(side)[k].as_py()
                    sides.append(([h["class_id"] for h in held],
                                  np.frombuffer(b"".join(h["print"] for h in held), np.uint8).reshape(-1, bits // 8)))
                (ids_a, a), (ids_b, b) = sides
                out_a, out_b, out_d = [], [], []
                for i, own in enumerate(ids_a):
                    distance = np.bitwise_count(b ^ a[i]).sum(axis=1)
                    for j in np.flatnonzero(distance <= radius).tolist():
                        if own < ids_b[j]:
                            out_a.append(own), out_b.append(ids_b[j]), out_d.append(int(distance[j]))
                        elif own > ids_b[j]:
                            out_a.append(ids_b[j]), out_b.append(own), out_d.append(int(distance[j]))
                yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.column(0).type.value_type.field(0).type),
                                                  pa.array(out_b, batch.column(0).type.value_type.field(0).type),
                                                  pa.array(out_d, pa.int32())], linked.fieldNames())

    return classes, squares.mapInArrow(compare, linked).distinct()
