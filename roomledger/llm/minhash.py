"""MinHash near-dedup (operator 3): ProbMinHash.

A document is the weighted set of its five-word shingles (weight 1 + ln of
the number of occurrences).  Each shingle sends arrivals of a Poisson process
whose rate is its weight to the ``SIZE`` registers of the sketch; a register
keeps the shingle whose arrival was first.  A shingle stops as soon as its
next arrival is later than everything kept so far, so a sketch takes a few
arrivals per shingle.  Two registers agree with the probability Jaccard
similarity of the documents.

Banding: ``BANDS`` bands of ``ROWS`` registers; documents that agree in a
whole band meet in a bucket.  With 32 bands of 4 a pair at 0.8 is missed with
a chance of 5e-8.  A bucket never yields all its pairs:

1. every member is compared with the bucket's hub (its least node), exactly,
   on the shingles of the whole texts; linked ones are joined into components;
2. a member whose component differs from its hub's is compared with all
   members of other components, in blocks of the bucket: by sketch first, and
   exactly unless so few registers agree that a pair at the threshold does
   it no more often than it misses all bands.  A pair is looked at only in the first band in which it agrees.
   A task returns links alone, and of a block no more than join its
   components, so nothing grows with the square of a group.  A link between
   components is lost with a chance of 1e-7 at most (5e-8 by the bands, 5e-8
   by the estimate), at a similarity of just 0.8; links inside a component, which change nothing, are
   not enumerated.

Equal texts are one node (told by a 64-bit hash of the text).

Cases: null and empty texts, and texts without a word, are classes of their
own rows: equal ones form one class only if their text is the same non-empty
string; fewer than five words make one shingle; ties, repeated rows and
repeated ids fall into the class of their text, texts without an id too; a
class id is the least doc_id of the class (null only if all its ids are null);
very long texts are sketched and compared whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .staging import apart, staged

SHINGLE = 5
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
THRESHOLD = 0.8
BLOCK = 500  # members per block of a bucket


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(document, shingle, weight) of a slice: each shingle of a document
    once, sorted by document and shingle."""
    words = arrays.Words(data, offsets)
    hashed, doc = arrays.shingles(words, arrays.RangeHash(data)(words.start, words.end), size)
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    return doc[first], hashed[first], 1.0 + np.log(times)


def sketches(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) 32-bit registers of a slice's documents."""
    first = np.full(n * size, np.inf)
    kept = np.zeros(n * size, np.uint32)
    latest = np.full(n, np.inf)
    at = np.zeros(len(doc))
    active = np.arange(len(doc))
    name = (shingle >> np.uint64(32)).astype(np.uint32)
    step = 0
    while len(active):
        draw = arrays.mix(shingle[active] + np.uint64((step * 2 + 1) * arrays.BASE % (1 << 64)))
        register = doc[active] * size + (draw & np.uint64(size - 1)).astype(np.int64)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        at[active] += -np.log(uniform) / weight[active]
        time = at[active]
        better = time < first[register]
        place, time_b, who = register[better], time[better], active[better]
        # of several arrivals at one register the earliest is written last
        order = np.argsort(-time_b, kind="stable")
        first[place[order]] = time_b[order]
        kept[place[order]] = name[who[order]]
        if step % 8 == 7 or len(active) < 4096:
            touched = np.unique(doc[active])
            latest[touched] = first.reshape(n, size)[touched].max(axis=1)
        active = active[at[active] < latest[doc[active]]]
        step += 1
    return kept.reshape(n, size)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets (sorted elements, weights): the sum over common
    elements i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)
    wx, wy = np.zeros(len(union)), np.zeros(len(union))
    wx[np.searchsorted(union, a)] = x
    wy[np.searchsorted(union, b)] = y
    both = (wx > 0) & (wy > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = wx / wy
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    above = np.append(np.cumsum(wx[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(wy[order]))
    cut = np.searchsorted(sorted_ratio, ratio[both], "left")
    totals = above[cut] + ratio[both] * below[cut]
    return float((wx[both] / totals).sum())


# --- components ---------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the least node of the
    component.  Alternating large and small stars, each round a staged table."""
    def checksum(df):
        r = df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        return tuple(r)

    stars = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "stars")
    seen = checksum(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(linked.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        stars = staged(small, "stars")
        now = checksum(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# --- candidates and links -----------------------------------------------------

NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sketch", T.BinaryType())])


def sketch_table(docs: DataFrame) -> DataFrame:
    """(id, node, sketch) per row of ``docs`` (id, node, text); sketch is null
    for a text without a word."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                doc, shingle, weight = weighted_shingles(data, offsets)
                registers = sketches(doc, shingle, weight, rows.num_rows)
                words = np.bincount(doc, minlength=rows.num_rows) > 0
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("node"),
                     pa.array([r.tobytes() if w else None for r, w in zip(registers, words)], pa.binary())], NODES.fieldNames())

    return docs.mapInArrow(run, NODES)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, band, node, hub, n): members of the buckets that hold two or more."""
    width = 4 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(
        F.xxhash64(b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))).alias("key"), b.alias("band"))))
    rows = nodes.select(band.alias("bucket"), "node").select("bucket.key", "bucket.band", "node")
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(hubs, "key")


def candidate_texts(members: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the members of buckets.  A text is found by its node's
    least id, so copies of a text are not gathered; the other texts are moved
    this once.  Of texts without any id each task gives one copy."""
    wanted = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    named = docs.join(wanted.where("id IS NOT NULL"), ["id", "node"]).select("node", "text")
    nameless = docs.where("id IS NULL").select("node", "text").dropDuplicates(["node"]) \
        .join(wanted.where("id IS NULL").select("node"), "node", "left_semi").select("node", "text")
    return staged(named.dropDuplicates(["node"]).unionByName(nameless), "texts", True)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, linked) of the distinct pairs (a, b), from the whole
    texts."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b") \
        .repartition("b", F.pmod("a", F.lit(64))).sortWithinPartitions("b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("linked", T.BooleanType())])

    def sets(data, offsets):
        doc, shingle, weight = weighted_shingles(data, offsets)
        cuts = np.searchsorted(doc, np.arange(len(offsets)))
        return [(shingle[i:j], weight[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch, "text_a"):
                own = sets(data, offsets)
                hub_ids = rows.column("b").to_numpy()
                changes = np.flatnonzero(np.append(True, hub_ids[1:] != hub_ids[:-1])) if len(hub_ids) else np.zeros(0, np.int64)
                hubs = sets(*arrays.text_buffers(rows.column("text_b").take(pa.array(changes))))
                which = np.searchsorted(changes, np.arange(len(hub_ids)), "right") - 1
                values = np.array([probability_jaccard(*own[k], *hubs[which[k]]) for k in range(len(hub_ids))], float)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(values), pa.array(values >= threshold)],
                                                 schema.fieldNames())

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _squares(members: DataFrame, columns: list[str]) -> DataFrame:
    """(key, band, left, right): the blocks of a bucket that hold open members,
    each beside every block of the bucket."""
    dealt = members.withColumn("row", F.pmod(F.xxhash64("node"), F.expr(f"n DIV {BLOCK} + 1")))
    held = dealt.groupBy("key", "band", "row").agg(F.collect_list(F.struct(*columns)).alias("held"), F.max("open").alias("any_open"))
    return held.where("any_open").select("key", "band", F.col("held").alias("left")) \
        .join(held.select("key", F.col("held").alias("right")), "key")


def _able(own: np.ndarray, own_label, near: np.ndarray, labels: np.ndarray, band: int, cut: float) -> np.ndarray:
    """Members of other components that may be near one sketch, where this
    band is the first in which the two agree."""
    same = near == own
    agrees = same.reshape(len(near), BANDS, ROWS).all(axis=2)
    return np.flatnonzero((agrees.argmax(axis=1) == band) & (same.mean(axis=1) >= cut) & (labels != own_label))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _cut(threshold: float) -> float:
    """The share of agreeing registers below which a pair is not compared
    exactly: a pair at the threshold falls below it no more often (binomial
    tail) than it misses all bands."""
    missed, below = (1 - threshold ** ROWS) ** BANDS, 0.0
    for agreeing in range(SIZE + 1):
        below += comb(SIZE, agreeing) * threshold ** agreeing * (1 - threshold) ** (SIZE - agreeing)
        if below > missed:
            return agreeing / SIZE
    return 1.0


def in_question(members: DataFrame, threshold: float) -> DataFrame:
    """(key, node): members of a bucket that by their sketches may have a link
    to another component there; only their texts are moved."""
    cut = _cut(threshold)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                band = batch.column("band")[k].as_py()
                left, right = batch.column("left")[k].values, batch.column("right")[k].values
                own, near = _registers(left.field("sketch")), _registers(right.field("sketch"))
                label, labels = left.field("label").to_numpy(), right.field("label").to_numpy()
                mine, its = np.zeros(len(own), bool), np.zeros(len(near), bool)
                for i in np.flatnonzero(left.field("open").to_numpy(zero_copy_only=False)):
                    found = _able(own[i], label[i], near, labels, band, cut)
                    mine[i] = len(found) > 0
                    its[found] = True
                nodes = np.concatenate([left.field("node").to_numpy()[mine], right.field("node").to_numpy()[its]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), batch.column("key")[k].as_py(), np.int64)), pa.array(nodes)],
                                                 schema.fieldNames())

    squares = _squares(members, ["node", "label", "open", "sketch"])
    return squares.select("key", "band", "left", "right").mapInArrow(run, schema).distinct()


def links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, linked): links between components within buckets.
    ``members`` has key, band, node, label, open, sketch, text, n; open ones
    are compared with all members of other components."""
    squares = _squares(members, ["node", "label", "open", "sketch", "text"])
    cut = _cut(threshold)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("linked", T.BooleanType())])

    def unpack(scalar):
        held = scalar.values
        return (held.field("node").to_numpy(), held.field("label").to_numpy(), held.field("open").to_numpy(zero_copy_only=False),
                _registers(held.field("sketch")), held.field("text"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                band = batch.column("band")[k].as_py()
                node, label, is_open, own, texts = unpack(batch.column("left")[k])
                others, other_label, _, near, other_texts = unpack(batch.column("right")[k])
                sets: dict[tuple[int, int], tuple] = {}

                def shingles_of(side: int, i: int) -> tuple:
                    if (side, i) not in sets:
                        _, shingle, weight = weighted_shingles(*arrays.text_buffers((texts, other_texts)[side].slice(i, 1)))
                        sets[side, i] = shingle, weight
                    return sets[side, i]

                parent: dict[int, int] = {}

                def root(x: int) -> int:
                    while parent.get(x, x) != x:
                        x = parent[x]
                    return x

                a, b, similarity = [], [], []
                for i in np.flatnonzero(is_open):
                    for j in _able(own[i], label[i], near, other_label, band, cut).tolist():
                        mine, its = root(int(label[i])), root(int(other_label[j]))
                        if mine == its:
                            continue
                        value = probability_jaccard(*shingles_of(0, int(i)), *shingles_of(1, j))
                        if value >= threshold:
                            parent[mine] = its
                            a.append(int(node[i])), b.append(int(others[j])), similarity.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64()),
                                                  pa.array([True] * len(a), pa.bool_())], schema.fieldNames())

    return squares.select("band", "left", "right").mapInArrow(run, schema)


def links_and_labels(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, labels): ``rows`` (id, node) of every document; ``links``
    (a, b, similarity) verified; ``labels`` (node, label) of linked nodes.
    ``docs`` has id, node, text."""
    table = staged(sketch_table(docs), "sketches", True)
    # rows of one text have one sketch; the id is null only if all of them lack one
    nodes = staged(table.where(F.col("sketch").isNotNull()).groupBy("node")
                   .agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "nodes", True)
    members = staged(buckets(nodes), "buckets", True)
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    texts = candidate_texts(members, docs, nodes)
    tested = staged(verified(pairs, texts, threshold), "tested", True)
    labels = staged(components(tested.where("linked")), "labels")
    own = labels.withColumnsRenamed({"label": "own"})
    of_hub = labels.withColumnsRenamed({"node": "hub", "label": "hubs"})
    marked = members.join(own, "node", "left").join(of_hub, "hub", "left") \
        .select("key", "band", "node", "n", F.coalesce("own", "node").alias("label"), F.coalesce("hubs", "hub").alias("hub_label")) \
        .withColumn("open", F.col("label") != F.col("hub_label"))
    unsettled = marked.where("open").select("key").distinct()
    opened = staged(marked.join(unsettled, "key").join(nodes.select("node", "sketch"), "node"), "opened", True)
    asked = staged(in_question(opened, threshold), "asked", True)
    more = staged(links_in_blocks(opened.join(asked, ["key", "node"]).join(texts, "node"), threshold), "more", True)
    if not more.isEmpty():
        tested = staged(tested.where("linked").unionByName(more), "tested")
        labels = staged(components(tested.where("linked")), "labels")
    return table.select("id", "node"), tested.where("linked").select("a", "b", "similarity"), labels


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and class_id (the least id of its class)."""
    rows, _, labels = links_and_labels(_rows(docs, id_col, text_col), threshold)
    return _classes(rows, labels).select(F.col("id").alias(id_col), "class_id")


def _texts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, least, label) per text: its least id and its component."""
    return rows.groupBy("node").agg(F.min("id").alias("least")).join(labels, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))


def _classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, node, class_id).  The least id is taken per text first, so neither
    a large group of copies nor a large class is gathered."""
    blank = F.xxhash64(F.lit(""))
    texts = _texts(rows, labels)
    classes = texts.groupBy("label").agg(F.min("least").alias("class_id"))
    by_text = texts.join(classes, "label").select("node", "class_id")
    return rows.join(by_text, "node") \
        .withColumn("class_id", F.when(F.col("node") == blank, F.col("id")).otherwise(F.col("class_id")))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their class: the text with
    the least id (null last; of equal ids the least text hash).  Of repeated
    rows, which share id and text, one stays; empty texts without an id are
    not known to be repeated and all stay."""
    name_id, name_node = apart(docs.columns, "first_id", "first_node")
    rows, _, labels = links_and_labels(_rows(docs, id_col, text_col), threshold)
    blank = F.xxhash64(F.lit(""))
    first = _texts(rows, labels).where(F.col("node") != blank).groupBy("label") \
        .agg(F.min(F.struct(F.col("least").isNull().alias("lacks"), "least", "node")).alias("row")).select("row.least", "row.node") \
        .unionByName(rows.where(F.col("node") == blank).select(F.col("id").alias("least"), "node")) \
        .select(F.col("least").alias(name_id), F.col("node").alias(name_node))
    marked = docs.withColumns({name_id: F.col(id_col).cast("long"), name_node: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    lacks = F.col(name_id).isNull()
    named = marked.where(~lacks).join(first, [name_id, name_node], "left_semi").dropDuplicates([name_id, name_node])
    # copies without an id are brought to one a task before they meet
    nameless = marked.where(lacks & (F.col(name_node) != blank)).dropDuplicates([name_node]) \
        .join(first.where(lacks).select(name_node), name_node, "left_semi")
    empty = marked.where(lacks & (F.col(name_node) == blank))
    return named.unionByName(nameless.select(named.columns)).unionByName(empty).drop(name_id, name_node)
