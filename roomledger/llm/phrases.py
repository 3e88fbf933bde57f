"""Phrase collocation mining (operator 11): HAT-trie counting.

Each task counts the phrases of one to three words of its texts in a trie of
word numbers, one trie per language.  The trie is shallow and its leaves are
hash containers: a container that holds ``BURST`` phrases bursts, and the
words that own much of it become trie nodes with containers of their own.
When a trie holds ``HELD`` phrases its largest subtrees are spilled whole, as
sorted runs that carry their own dictionary of words.  A run is cut by prefix
partition, a hash of the first two words, so a frequent first word is dealt
over all partitions; the runs of one partition are merged in one task.
Counts are exact: words are told apart by their bytes.

What is frequent enough (``least`` occurrences) leaves the merge as rows; the
parts of a candidate are at least as frequent as itself, so scores, the test
against longer candidates and the ranks are joins and aggregates over those
rows alone.

The number of prefix partitions follows ``spark.sql.shuffle.partitions``;
raise that with the data so that a partition's phrases fit in a task.

Cases: a null or empty text has no words; a null language is ``und``; ties
are settled by the order score, count, phrase (UTF-8 bytes), so ranks never
depend on the run; repeated rows count as often as they occur; texts of any
length are counted whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, groups, wordids
from .staging import staged

LONGEST = 3  # words of a phrase; three numbers of BITS bits make one key
BITS = 21
VOCABULARY = 400_000  # words that one task tells apart before it spills all; twice as many must fit in BITS
BURST = 1 << 16
HELD = 1_000_000
SALTS = 16

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True

RUNS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("tongue", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("words", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("ids", T.BinaryType()),
    T.StructField("counts", T.BinaryType())])
GRAMS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("size", T.IntegerType()),
    *[T.StructField(w, T.StringType()) for w in ("w1", "w2", "w3")], T.StructField("f", T.LongType())])


# --- counting -----------------------------------------------------------------


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    """The word numbers at one level of packed phrases."""
    return (keys >> np.uint64(BITS * (LONGEST - 1 - level))) & np.uint64((1 << BITS) - 1)


class HatTrie:
    """Phrases (packed word numbers) and their counts: a node has one hash
    container, and children for the words that outgrew it."""

    def __init__(self, level: int = 0):
        self.level = level
        self.container: dict[int, int] = {}
        self.children: dict[int, HatTrie] = {}
        self.own = np.zeros(0, np.uint64)
        self.burst_at = BURST

    def __len__(self) -> int:
        return len(self.container) + sum(map(len, self.children.values()))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted, distinct keys."""
        if len(self.own):
            word = _level(keys, self.level)
            theirs = np.isin(word, self.own)
            cuts = np.flatnonzero(np.diff(word[theirs])) + 1
            for part, times in zip(np.split(keys[theirs], cuts), np.split(counts[theirs], cuts)):
                if len(part):
                    self.children[int(_level(part[:1], self.level)[0])].add(part, times)
            keys, counts = keys[~theirs], counts[~theirs]
        held, names = self.container, keys.tolist()
        before = np.fromiter(map(held.get, names, repeat(0)), np.int64, len(names))
        held.update(zip(names, (before + counts).tolist()))
        if len(held) > self.burst_at and self.level < LONGEST - 1:
            self._burst()

    def _burst(self) -> None:
        keys, counts = self._sorted()
        word = _level(keys, self.level)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        heavy = (size >= BURST // 32) & (word[first] > 0)
        for k in np.flatnonzero(heavy):
            child = self.children[int(word[first[k]])] = HatTrie(self.level + 1)
            child.add(keys[first[k]: first[k] + size[k]], counts[first[k]: first[k] + size[k]])
        stay = ~np.repeat(heavy, size)
        self.container = dict(zip(keys[stay].tolist(), counts[stay].tolist()))
        self.own = np.array(sorted(self.children), np.uint64)
        self.burst_at = max(BURST, 2 * len(self.container))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.container.keys(), np.uint64, len(self.container))
        counts = np.fromiter(self.container.values(), np.int64, len(self.container))
        order = np.argsort(keys)
        return keys[order], counts[order]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Everything in this subtree, sorted."""
        parts = [self._sorted(), *[child.entries() for child in self.children.values()]]
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order]

    def spill(self, stay: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until at most ``stay``
        phrases are left: one sorted run."""
        left, runs = len(self), []
        for word in sorted(self.children, key=lambda w: -len(self.children[w])):
            if left <= stay:
                break
            left -= len(self.children[word])
            runs.append(self.children.pop(word).entries())
        if left > stay:
            runs.append(self._sorted())
            self.container, self.burst_at = {}, BURST
        self.own = np.array(sorted(self.children), np.uint64)
        keys, counts = (np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order]


def slice_phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(word numbers, their texts, words that follow in the piece, distinct
    words): ``reach`` of a word is 1 plus how many words, two at most, follow
    it in its piece."""
    data = wordids.lowered(data)
    breaks = _BREAK[data]
    inside = ~(breaks | _GAP[data])
    start, end, doc = wordids.bounds(inside, offsets)
    number, vocabulary = wordids.numbered(data, inside, start, end)
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(breaks, out=before[1:])
    follows = np.zeros(len(start) + 2, bool)
    if len(start):
        follows[: len(start) - 1] = (doc[1:] == doc[:-1]) & (before[start[1:]] == before[end[:-1]])
    reach = 1 + follows[: len(start)] + (follows[: len(start)] & follows[1: len(start) + 1])
    return number, doc, reach, vocabulary


def packed_phrases(ids: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All phrases that begin at the words, packed, distinct and sorted, with
    counts.  ``ids`` are numbers above 0."""
    key, total = np.zeros(len(ids), np.uint64), []
    padded = np.append(ids, np.zeros(LONGEST, ids.dtype)).astype(np.uint64)
    for k in range(LONGEST):
        key = key | (padded[k: len(ids) + k] << np.uint64(BITS * (LONGEST - 1 - k)))
        total.append(key[reach > k])
    return np.unique(np.concatenate(total), return_counts=True)


class Counter:
    """The tries of one task and the runs that they spill."""

    def __init__(self, parts: int, held: int = HELD):
        self.parts, self.held = parts, held
        self.reset()

    def reset(self) -> None:
        self.table: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.tries: dict[str, HatTrie] = {}

    def _ids(self, vocabulary: pa.Array) -> np.ndarray:
        """Numbers of a slice's words in this task, from 1."""
        table, words = self.table, vocabulary.to_pylist()
        ids = np.fromiter((table.setdefault(w, len(table) + 1) for w in words), np.uint64, len(words))
        fresh = ids > len(self.words)
        if fresh.any():
            self.words.extend(w for w, new in zip(words, fresh.tolist()) if new)
            data, offsets = arrays.text_buffers(vocabulary.filter(pa.array(fresh)).cast(pa.large_string()))
            self.hashes = np.append(self.hashes, arrays.RangeHash(data)(offsets[:-1], offsets[1:]))
        return ids

    def add(self, langs: list[str], data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        number, doc, reach, vocabulary = slice_phrases(data, offsets)
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs])[doc] if len(names) > 1 else np.zeros(len(doc), int)
        for first in range(0, len(number), VOCABULARY):
            # as many words as may all differ, and those that reach out of them
            last = min(first + VOCABULARY, len(number))
            part = slice(first, min(last + LONGEST - 1, len(number)))
            if last - first < len(number):
                used, local = np.unique(number[part], return_inverse=True)
                own = vocabulary.take(pa.array(used))
            else:
                local, own = number, vocabulary
            if len(self.table) + len(own) > VOCABULARY and self.table:
                yield from self.flush()
            ids = self._ids(own)[local]
            begins = reach[part].copy()
            begins[last - first:] = 0
            for k, lang in enumerate(names):
                mine = which[part] == k
                if mine.any():
                    # the words of a text stay together, and reach never leaves it
                    self.tries.setdefault(lang, HatTrie()).add(*packed_phrases(ids[mine], begins[mine]))
            yield from self._spilled()

    def _spilled(self) -> Iterator[pa.RecordBatch]:
        while sum(map(len, self.tries.values())) > self.held:
            lang = max(self.tries, key=lambda x: len(self.tries[x]))
            yield from self._run(lang, *self.tries[lang].spill(len(self.tries[lang]) // 4))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, trie in self.tries.items():
            yield from self._run(lang, *trie.entries())
        self.reset()

    def _run(self, lang: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per prefix partition: a sorted run with its own words."""
        if not len(keys):
            return
        ids = [_level(keys, k).astype(np.int64) for k in range(LONGEST)]
        hashes = np.append(np.uint64(0), self.hashes)
        tongue = _lang_number(lang)
        with np.errstate(over="ignore"):
            prefix = arrays.mix(hashes[ids[0]] * np.uint64(3) + hashes[ids[1]] * np.uint64(5) + np.uint64(tongue & 0xFFFFFFFF))
        part = (prefix % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        rows: dict[str, list] = {f: [] for f in RUNS.fieldNames()}
        for p in np.flatnonzero(np.diff(bounds)):
            chosen = order[bounds[p]: bounds[p + 1]]
            used, local = np.unique(np.concatenate([i[chosen] for i in ids]), return_inverse=True)
            if used[0]:
                local, used = local + 1, np.append(0, used)
            words = [self.words[i - 1] for i in used[1:].tolist()]
            values = (int(p), tongue, lang, b"".join(words), np.fromiter(map(len, words), np.uint32, len(words)).tobytes(),
                      local.astype(np.uint32).tobytes() if len(used) > 0xFFFF else local.astype(np.uint16).tobytes(),
                      counts[chosen].astype(np.uint32).tobytes() if counts[chosen].max() < 1 << 32 else counts[chosen].astype(np.uint64).tobytes())
            for column, value in zip(rows.values(), values):
                column.append(value)
        types = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], RUNS.fieldNames())


def _lang_number(lang: str) -> int:
    """A number that sorts equal languages together (the name tells them apart)."""
    data, offsets = arrays.text_buffers(pa.array([lang]))
    return int(arrays.RangeHash(data)(offsets[:-1], offsets[1:])[0] >> np.uint64(1))


def merged(rows: pa.Table, least: int) -> pa.RecordBatch:
    """The phrases of one prefix partition and language that occur ``least``
    times or more over all runs, and a row of size 0 with the number of words."""
    lengths, vocabulary = groups.joined(rows.column("lengths"), np.uint32)
    data = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("words")), np.uint8)
    coded = wordids.binary_array(data, lengths.astype(np.int64)).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    first = np.cumsum(vocabulary) - vocabulary
    size = len(coded.dictionary) + 1
    pairs, lasts, counts = [], [], []
    for k, (ids, times) in enumerate(zip(rows.column("ids"), rows.column("counts"))):
        ids = np.frombuffer(ids.as_buffer(), np.uint32 if vocabulary[k] >= 0xFFFF else np.uint16).astype(np.int64).reshape(LONGEST, -1)
        table = np.append(0, number[first[k]: first[k] + vocabulary[k]])
        w1, w2, w3 = table[ids]
        pairs.append(w1 * size + w2), lasts.append(w3)
        times = times.as_buffer()
        counts.append(np.frombuffer(times, np.uint64 if times.size == 8 * len(w1) else np.uint32).astype(np.int64))
    pair, last, count = (np.concatenate(x) for x in (pairs, lasts, counts))
    distinct, pair = np.unique(pair, return_inverse=True)
    key = pair * size + last
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.add.reduceat(count, lead)
    pair, last = distinct[key[lead] // size], key[lead] % size
    word = [pair // size, pair % size, last]
    occurrences = int(total[(word[1] == 0)].sum())
    kept = total >= least
    word = [w[kept] for w in word]
    columns = [coded.dictionary.take(pa.array(np.maximum(w - 1, 0), mask=w == 0)).cast(pa.large_string()).cast(pa.string()) for w in word]
    sizes = sum((w > 0).astype(np.int32) for w in word)
    n = int(kept.sum())
    none = pa.nulls(1, pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([rows.column("lang")[0].as_py()] * (n + 1), pa.string()), pa.array(np.append(sizes, np.int32(0)), pa.int32()),
         *[pa.concat_arrays([c, none]) for c in columns], pa.array(np.append(total[kept], occurrences), pa.int64())], GRAMS.fieldNames())


def frequent_phrases(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text", parts: int | None = None,
                     held: int = HELD) -> DataFrame:
    """(lang, size, w1, w2, w3, f): phrases of one to three words with at
    least ``least`` occurrences in a language; rows of size 0 add up to its
    number of words."""
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        counter = Counter(parts, held)
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                yield from counter.add(rows.column("lang").to_pylist(), data, offsets)
        yield from counter.flush()

    def merge(batches):
        for rows in groups.by_group(batches, "part", "tongue"):
            names = rows.column("lang").unique().to_pylist()
            for lang in names:  # more than one only if two languages share a number
                yield merged(rows.filter(pc.equal(rows.column("lang"), lang)) if len(names) > 1 else rows, least)

    runs = texts.mapInArrow(count, RUNS).repartition(parts, "part").sortWithinPartitions("part", "tongue")
    return runs.mapInArrow(merge, GRAMS)


# --- scores -------------------------------------------------------------------


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _cuts() -> Column:
    """(k, first, rest) of every way to cut a candidate in two."""
    def cut(k: int, first: list[str], rest: list[str]) -> Column:
        return F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *first).alias("first"), F.concat_ws(" ", *rest).alias("rest"))

    return F.when(F.col("size") == 2, F.array(cut(1, ["w1"], ["w2"]))) \
        .otherwise(F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"])))


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, scale: int = 1_000_000, most: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two or three words
    that occur ``least`` times, by the score of their weakest cut,
    floor(scale * a * a / (l * r)).  A phrase is dropped if a longer candidate
    around it has ``inside_percent`` of its occurrences.  ``most`` is the
    length of each language's report; the last window of a language holds
    that of ``SALTS`` parts, however many candidates there are."""
    grams = staged(frequent_phrases(docs, least, lang_col, text_col, parts), "phrases", True)
    totals = grams.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    named = grams.where("size > 0").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    around = named.where("size = 3").select("lang", "f", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = named.where("size > 1").join(around, ["lang", "phrase"], "left") \
        .where(F.coalesce(_exact(F.lit(100)) * F.col("longer") < _exact(F.lit(inside_percent)) * F.col("f"), F.lit(True)))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(_cuts()).alias("cut")).select("lang", "phrase", "a", "cut.*")
    firsts = named.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = named.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(CAST({scale} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)))"
                   " DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    weakest = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]) \
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    ranked = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
        ranked = ranked.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
