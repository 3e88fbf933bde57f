"""Whole-text statistics of documents, one pass, a few vectorised sweeps
over the bytes of many documents at once (see ``arrays``)."""

from __future__ import annotations

import numpy as np

from . import arrays

# The symbol class of the rules.
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
          "n_digits", "n_distinct_words", "n_long_words", "n_repeat_next", "n_commas", "n_stops", "n_bars"]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _class(SYMBOLS)
_UPPER = _class(bytes(range(65, 91)))
_MARK = _class(b"!?")
_DIGIT = _class(bytes(range(48, 58)))


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (doc, value) in text order: whether the value was there
    earlier in the document, and whether it is there twice or more."""
    n = len(doc)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((value, doc))  # stable: text order within equal values
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    earlier, twice = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return earlier, twice


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in ``COUNTS`` per document of a slice."""
    n = len(offsets) - 1
    words = arrays.Words(data, offsets)
    hashed = arrays.RangeHash(data)
    word_hash = hashed(words.start, words.end)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    word_len = chars[words.end] - chars[words.start]
    per_doc = lambda flags: np.bincount(words.doc, weights=flags, minlength=n).astype(np.int64)
    out = {"n_words": words.counts(), "word_chars": per_doc(word_len), "n_symbols": arrays.range_sums(_SYMBOL[data], offsets)}

    # lines: cut at \n; those that hold a word
    cuts = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.append(line_start[1:], len(data)), len(data))
    ends_with_cut = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_end = line_end - ends_with_cut
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    has_word = np.searchsorted(words.start, line_end, "left") > np.searchsorted(words.start, line_start, "left")
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    earlier, _ = repeated(line_doc, hashed(line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(line_doc, minlength=n).astype(np.int64)

    # words in windows of three that are there twice or more
    counts = words.counts()
    place = np.arange(len(words.doc)) - words.first[words.doc]
    begins = np.flatnonzero(place + 3 <= counts[words.doc]) if len(words.doc) else np.zeros(0, np.int64)
    window, _ = arrays.shingles(words, word_hash, 3)
    window_at = np.flatnonzero((place + 3 <= counts[words.doc]) | (place == 0)) if len(words.doc) else begins
    window = window[np.searchsorted(window_at, begins)]
    _, twice = repeated(words.doc[begins], window)
    covered = np.zeros(len(words.doc), bool)
    for k in range(3):
        covered[begins[twice] + k] = True
    out["n_repeat_words"] = per_doc(covered)

    first_seen, _ = repeated(words.doc, word_hash)
    out["n_distinct_words"] = per_doc(~first_seen)
    out["n_long_words"] = per_doc(word_len > 12)
    same_next = np.zeros(len(words.doc), bool)
    same_next[1:] = (word_hash[1:] == word_hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_repeat_next"] = per_doc(same_next)

    # capitals of ASCII and of Latin-1
    upper = _UPPER[data]
    if len(data) > 1:
        upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out["n_upper"] = arrays.range_sums(upper, offsets)
    out["n_marks"] = arrays.range_sums(_MARK[data], offsets)
    out["n_digits"] = arrays.range_sums(_DIGIT[data], offsets)
    out["n_commas"] = arrays.range_sums(data == 44, offsets)
    out["n_stops"] = arrays.range_sums(data == 46, offsets)
    out["n_bars"] = arrays.range_sums(data == 124, offsets)
    return out


def count_table(docs, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of ``docs``: ``id`` (as given) and the ``COUNTS``; no
    shuffle.  Null text is the empty text."""
    from pyspark.sql import types as T

    import pyarrow as pa

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def count(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                counted = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("id"), *(pa.array(counted[c]) for c in COUNTS)], ["id", *COUNTS])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(count, schema)


def agreed_labels(labels, id_col: str, label_col: str):
    """(id, label): one row per id; repeated labels count once, null labels
    and ids labelled both ways not at all."""
    from pyspark.sql import functions as F

    grouped = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    return grouped.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("_most")) \
        .where(F.col("label") == F.col("_most")).select("id", "label")


def with_counts(docs, name: str, text_col: str = "text"):
    """``docs`` with all its columns and a struct column ``name`` of the
    counts; no shuffle."""
    from pyspark.sql import types as T

    import pyarrow as pa

    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, counts)])

    def count(batches):
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch, text_col):
                counted = text_counts(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(counted[c]) for c in COUNTS], COUNTS)
                yield pa.RecordBatch.from_arrays([*rows.columns, struct], [*rows.schema.names, name])

    return docs.mapInArrow(count, schema)
