"""Periodic run detection (operator 12): online sparse diagonal DP.

Words ``q`` apart that are equal lie on the diagonal of lag ``q``.  For a word
its earlier occurrences name the diagonals it lies on; a diagonal that was
active one word before grows by one, any other one starts.  A diagonal that
ends after ``m`` equal words is a stretch of ``m + q`` words with period
``q``; it is emitted when that is at least ``max(SHORTEST, POWER * q)``.

The DP is run for the lags of one octave [2**k, 2**(k+1)) after the other,
over all texts of a slice at once.  Three things keep it sparse, and none of
them loses a run:

- a diagonal that is long enough has ``need(q)`` equal words in a row, so it
  passes a word whose number is a multiple of ``step`` (a power of two up to
  that).  Only there earlier occurrences open diagonals: at most ``n / 2``
  pairs an octave, even when a text is one word over and over;
- a diagonal is advanced from one such word to the next, and stretches that
  meet are joined, so no word is compared twice for one lag;
- a lag that is a multiple of the period of a run found in an earlier octave
  and lies inside that run ends where the run ends: it is not advanced.

A stretch whose smallest period is shorter than ``q`` divides ``q`` (length
``4 q`` allows no other) and was found with the same ends at that period, so
of stretches with equal ends the one with the least lag is the run.

Words are compared by exact numbers, not by hashes (``wordids``).

Cases: a null or empty text, or one without words, has no run and an empty
collapsed text; ties (equal exponents) go to the smallest start, then period;
repeated rows give equal results; texts of any length are worked on whole,
one by one when longer than a slice, in memory in proportion to the text; an
empty table gives an empty result; all columns pass through, and clashing
helper names are avoided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, wordids
from .staging import apart

SHORTEST, POWER = 6, 4
PAIRS = 1 << 21  # opened diagonals looked at together
FEW = 5  # words after which most diagonals have ended

WORD = r"[^\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def need(lag, shortest: int = SHORTEST, power: int = POWER):
    """Equal words in a row that a diagonal of this lag needs."""
    return np.maximum(shortest - lag, (power - 1) * lag)


def _matches(word: np.ndarray, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many of the next (or previous) ``most`` words of each diagonal are
    equal in a row; the diagonals that are still active advance together, by
    stretches that double."""
    grown = np.zeros(len(at), np.int64)
    active, width = np.flatnonzero(most > 0), 4
    while len(active):
        width = min(width, max(4, (1 << 22) // len(active)))
        ahead = grown[active, None] + np.arange(width)
        place = at[active, None] + (-1 - ahead if back else ahead)
        inside = ahead < most[active, None]
        place = np.where(inside, place, at[active, None])
        equal = inside & (word[place] == word[place - lag[active, None]])
        run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        grown[active] += run
        active, width = active[run == width], width * 2
    return grown


def _openings(word: np.ndarray, doc: np.ndarray, first: np.ndarray, order: np.ndarray, rank: np.ndarray, key: np.ndarray,
              low: int, high: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, lag) of the diagonals that earlier occurrences open, lags in
    [low, high), at words whose number in the text is a multiple of ``step``.
    ``order`` sorts by text, word and place; ``key`` is that order's key."""
    place = np.arange(len(word)) - first[doc]
    at = np.flatnonzero((place % step == 0) & (place >= low))
    base = key[rank[at]] - place[at]  # the key of the group's place 0
    since = np.searchsorted(key, base + np.maximum(place[at] - high + 1, 0))
    until = np.searchsorted(key, base + place[at] - low, "right")
    count = np.maximum(until - since, 0)
    at, since, count = at[count > 0], since[count > 0], count[count > 0]
    cut = np.cumsum(count)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:end]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here = np.repeat(at[begin:end], n)
        yield here, here - order[np.repeat(since[begin:end], n) + offset]
        begin = end


def find_runs(word: np.ndarray, doc: np.ndarray, first: np.ndarray, shortest: int = SHORTEST, power: int = POWER,
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a slice, sorted by start, then
    period.  ``word`` numbers the words of all texts one after the other;
    those of text d are ``first[d]`` to ``first[d + 1]``."""
    n, counts = len(word), np.diff(first)
    starts, ends, periods = (np.zeros(0, np.int64) for _ in range(3))
    if not n:
        return starts, ends, periods
    place = np.arange(n) - first[doc]
    span = int(counts.max()) + 1
    group = doc * (int(word.max()) + 1) + word
    order = np.argsort(group, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    group = group[order]
    key = np.cumsum(np.append(False, group[1:] != group[:-1])) * span + place[order]
    run_of = np.full(n, -1, np.int64)
    low = 1
    while power * low <= span:
        high = 2 * low
        least = int(need(np.arange(low, high), shortest, power).min())
        step = 1 << max(0, least.bit_length() - 1)
        found = []
        for at, lag in _openings(word, doc, first, order, rank, key, low, high, step):
            begin, stop = first[doc[at]], first[doc[at] + 1]
            fits = power * lag <= stop - begin
            if len(starts):
                known = run_of[at]
                fits &= (known < 0) | (at - lag < starts[known]) | (lag % periods[known] != 0) \
                    | (ends[known] - starts[known] < periods[known] + lag)
            chosen = np.flatnonzero(fits)
            at, lag, begin, stop = at[chosen], lag[chosen], begin[chosen], stop[chosen]
            wanted = need(lag, shortest, power)
            # most diagonals end within a few words
            back = _matches(word, at, lag, np.minimum(FEW - 1, at - lag - begin), True)
            ahead = _matches(word, at, lag, np.minimum(FEW, stop - at), False)
            chosen = np.flatnonzero(back + ahead >= np.minimum(wanted, FEW))
            at, lag, begin, stop, back, ahead = (x[chosen] for x in (at, lag, begin, stop, back, ahead))
            more = np.flatnonzero(back == FEW - 1)
            back[more] = _matches(word, at[more], lag[more], np.minimum(step, at[more] - lag[more] - begin[more]), True)
            more = np.flatnonzero(ahead == FEW)
            ahead[more] = _matches(word, at[more], lag[more], np.minimum(step, stop[more] - at[more]), False)
            found.append((lag, at - back, at + ahead))
        if found:
            lag, a, b = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((a, lag))
            lag, a, b = lag[by], a[by], b[by]
            if len(a):
                # stretches of one lag that touch or overlap are one diagonal
                new = np.append(True, (lag[1:] != lag[:-1]) | (a[1:] > b[:-1]) | (doc[a[1:]] != doc[a[:-1]]))
                lead = np.flatnonzero(new)
                lag, a, b = lag[lead], a[lead], np.maximum.reduceat(b, lead)
            long = b - a >= need(lag, shortest, power)
            at = len(starts)
            starts, ends, periods = (np.concatenate(x) for x in ((starts, a[long] - lag[long]), (ends, b[long]), (periods, lag[long])))
            for k in range(at, len(starts)):
                run_of[starts[k]: ends[k]] = k
        low = high
    by = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[by], ends[by], periods[by]
    least = np.append(True, (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])) if len(starts) else np.zeros(0, bool)
    starts, ends, periods = starts[least], ends[least], periods[least]
    by = np.lexsort((periods, starts))
    return starts[by], ends[by], periods[by]


def collapsed_texts(data: np.ndarray, offsets: np.ndarray, words: arrays.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    start, end, doc = words.start[kept], words.end[kept], words.doc[kept]
    follows = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    # a word that another one follows in its text has a separator behind it
    flags = wordids.marks(len(data), start, end)
    gaps = end[follows]
    flags[gaps] = True
    out = data.copy()
    out[gaps] = 0x20
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    cuts = sums[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(out[flags]))])


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
              shortest: int = SHORTEST, power: int = POWER, keep_text: bool = False) -> DataFrame:
    """Every row with its runs (array of start, length, period in words, by
    start, then period) and its text without repetitions: a word that lies in
    a run behind the run's first period is left out, the others are joined by
    one space.  ``text`` itself is passed on only if asked for."""
    keep = [c for c in docs.columns if keep_text or c != text]
    (name,) = apart([*keep, runs, collapsed], "runs_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(name))
    fields = [source.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField(runs, T.ArrayType(RUN, False)), T.StructField(collapsed, T.StringType())])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch, name):
                words = arrays.Words(data, offsets)
                inside = wordids.marks(len(data), words.start, words.end)
                number, _ = wordids.numbered(data, inside, words.start, words.end)
                start, end, period = find_runs(number, words.doc, words.first, shortest, power)
                drop = np.zeros(len(number) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, end, -1)
                doc = words.doc[start]
                held = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(end - start), pa.array(period)],
                                                  [f.name for f in RUN.fields])
                cuts = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
                texts = collapsed_texts(data, offsets, words, np.cumsum(drop[:-1]) == 0)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(cuts), held), texts.cast(pa.string())], schema.fieldNames())

    return source.mapInArrow(run, schema)


# --- the query ----------------------------------------------------------------


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts whose id has a crc32 divisible by ten repeat a stretch of their
    words to the end: with h = crc32(id), g = h DIV 10 and n words, from word
    a = g % n on in periods of 1 + (n - a) DIV (3 + g % 8).  Rows without an
    id, and all others, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0)
    name_w, name_a, name_p, name_n = apart(docs.columns, "w", "a", "p", "n")
    marked = docs.withColumn(name_w, F.when(h % 10 == 0, words)).withColumn(name_n, F.size(name_w))
    a = (g % F.col(name_n)).cast("int")
    marked = marked.withColumn(name_a, F.when(F.col(name_n) > 0, a))
    rest = F.col(name_n) - F.col(name_a)
    marked = marked.withColumn(name_p, (1 + F.floor(rest / (3 + g % 8))).cast("int"))
    period = F.slice(F.col(name_w), F.col(name_a) + 1, F.col(name_p))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col(name_p)).cast("int"))), F.lit(1), rest)
    folded = F.array_join(F.concat(F.slice(F.col(name_w), F.lit(1), F.col(name_a)), tail), " ")
    return marked.withColumn(text_col, F.when(F.col(name_n) > 0, folded).otherwise(F.col(text_col))) \
        .drop(name_w, name_a, name_p, name_n)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first."""
    first = F.try_element_at(runs, F.lit(1))
    return F.aggregate(runs, first, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its strongest run and digests of all its runs
    and of its collapsed text."""
    found = with_runs(docs.select(id_col, text_col), text_col)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", strongest(F.col("runs"))).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.expr("(1000 * top.length) DIV top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
