"""Token counts by prefix dynamic programming (operator 8).

For a byte-pair vocabulary, ``PrefixCounts`` finds the exact token count of
*every* prefix of a piece of text in one left-to-right pass.  The last token
of prefix ``i`` is the one vocabulary token that ends at ``i`` and may stand
after the last token of the prefix before it; the count is that prefix's
count plus one.  Two tokens may stand side by side when encoding their joined
bytes gives back the same two tokens, and a sequence is an encoding exactly
when each of its adjacent pairs is.  So a table entry looks only at the
vocabulary tokens that end there, and no prefix is ever encoded again.

The splitting pattern of the vocabulary cuts a text into pieces; no merge
crosses a piece.  Tables of pieces are kept per Python worker, so a repeated
word costs one dictionary look-up.

Cases: null is the empty text; an empty text has 0 tokens; very long texts are
counted whole; rows without an id are counted like others; repeated rows give
repeated results; an empty table gives an empty table; input columns other
than the two named ones are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import arrays

# The splitting pattern of byte-level BPE and its printable
# stand-ins for bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

# Outside these blocks Unicode versions may class a character differently.
UNSURE = r"[^\u0000-\u0557\u2000-\u206f\u3040-\u30ff\u4e00-\u9fef\uac00-\ud7a3]"

# Kept per worker; beyond, the keeping starts anew.
KEPT_PIECES = 600_000
KEPT_PREFIXES = 900_000
KEPT_PAIRS = 400_000
LONG_PIECE = 48


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a vocabulary file stands for."""
    table = {chr(b): b for b in PRINTABLE}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))})
    return table


class PrefixCounts(dict):
    """piece of text -> its token count (int); the tables behind it on call."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_of_symbol()
        raw = lambda s: bytes(as_byte[c] for c in s)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.vocabulary = {raw(t) for t in spec["model"]["vocab"] if all(c in as_byte for c in t)}
        self.longest = max(map(len, self.vocabulary), default=1)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(SPLIT)
        self.unsure = regex.compile(UNSURE)
        # prefix of a piece -> its token count * 64 + the length of its last
        # token (a last token longer than LONG_PIECE has no entry here)
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        # token -> its two spines, or None where its own bytes do not encode
        # to it (such a token is never an output)
        self.spines: dict[bytes, tuple | None] = {}
        self.library = None
        self.path = path

    def _last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge forms ``token``, by plain merging of its
        bytes; None if they end as more than one part."""
        parts = [token[i: i + 1] for i in range(len(token))]
        pair = None
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            if ranks[i] == len(self.rank):
                return None
            pair = parts[i], parts[i + 1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return pair

    def _spines(self, token: bytes) -> tuple | None:
        """For a token: its right edge and its left edge, each as a list of
        (part at that edge, rank that forms it, rank that takes it up), from
        the whole token down to one byte."""
        if token in self.spines:
            return self.spines[token]
        edges = []
        for side in (1, 0):
            edge, part, taken = [], token, float("inf")
            while True:
                pair = self._last_merge(part) if len(part) > 1 else None
                if len(part) > 1 and pair is None:
                    self.spines[token] = None
                    return None
                formed = self.rank[pair] if pair else -1
                edge.append((part, formed, taken))
                if pair is None:
                    break
                part, taken = pair[side], formed
            edges.append(edge)
        self.spines[token] = tuple(edges)
        return self.spines[token]

    def _side_by_side(self, left: bytes, right: bytes) -> bool:
        """Whether no merge ever crosses the border of the two tokens.

        Merging forms the parts at the border step by step.  Of each two
        parts that touch there at some time, their own merge must come later
        than the step that takes one of them up (of equal ranks the leftmost
        pair goes first)."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        xs, ys = self._spines(left)[0], self._spines(right)[1]
        i = j = 0
        apart = True
        while True:
            x, x_formed, x_taken = xs[i]
            y, y_formed, y_taken = ys[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_taken and rank <= y_taken:
                apart = False
                break
            if x_formed < 0 and y_formed < 0:
                break
            if y_formed >= x_formed:
                j += 1
            else:
                i += 1
        self.pairs[left, right] = apart
        return apart

    def _extend(self, piece: bytes, i: int, before: int) -> int:
        """The entry of prefix ``i`` from the entries of shorter prefixes."""
        prefixes, vocabulary = self.prefixes, self.vocabulary
        first = i - 1 - before  # the last token of the prefix before, longer by a byte: the likeliest
        for j in (first, *range(max(0, i - self.longest), i)):
            token = piece[j:i]
            if token not in vocabulary or self._spines(token) is None:
                continue
            if j == 0:
                return 64 + i
            entry = prefixes[piece[:j]]
            if self._side_by_side(piece[j - entry % 64: j], token):
                return (entry // 64 + 1) * 64 + i - j
        raise ValueError("the vocabulary does not hold every byte")

    def _entry(self, piece: bytes) -> int:
        """The entry of a piece; fills those of its prefixes that are not
        known."""
        prefixes = self.prefixes
        known = len(piece)
        while known and piece[:known] not in prefixes:
            known -= 1
        before = prefixes[piece[:known]] % 64 if known else 0
        for i in range(known + 1, len(piece) + 1):
            entry = prefixes[piece[:i]] = self._extend(piece, i, before)
            before = entry % 64
        return prefixes[piece] if piece else 0

    def table(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... piece[:len]."""
        if len(piece) > LONG_PIECE:
            return self._by_position(piece)
        self._make_room()
        self._entry(piece)
        return [0, *(self.prefixes[piece[:i]] // 64 for i in range(1, len(piece) + 1))]

    def _make_room(self) -> None:
        if len(self.prefixes) >= KEPT_PREFIXES:
            self.prefixes.clear()
        if len(self) >= KEPT_PIECES:
            self.clear()

    def __missing__(self, piece: str) -> int:
        self._make_room()
        raw = piece.encode("utf-8")
        if len(raw) > LONG_PIECE:
            return self._by_position(raw)[-1]
        count = self[piece] = self._entry(raw) // 64
        return count

    def _by_position(self, piece: bytes) -> list[int]:
        """The same table for a long piece: by position, not by prefix bytes
        (which would take the square of its length)."""
        sizes, counts = [0], [0]
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - self.longest), i):
                token = piece[j:i]
                if token in self.vocabulary and self._spines(token) is not None \
                        and (j == 0 or self._side_by_side(piece[j - sizes[j]: j], token)):
                    sizes.append(i - j)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary does not hold every byte")
        return counts

    def split(self, text: str) -> list[str]:
        """The pieces of a text.  Characters outside well-known blocks may be
        classed differently by another Unicode version: then the library's
        own splitter is asked."""
        if not self.unsure.search(text):
            return self.pieces.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    # -- questions answered from the stored prefix counts ---------------------

    def prefix_table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)


class PrefixTable:
    """The exact token count of every prefix (in code points) of one text.

    Stored are the cumulated counts at the piece ends.  A prefix that ends
    inside a piece adds the piece's own table.  Where a cut changes how the
    text is split (a cut run of white space or a cut contraction), the cut
    piece alone is split again; everything before it stands.
    """

    def __init__(self, counts: PrefixCounts, text: str):
        self.counts, self.text = counts, text
        ends, sizes, at = [0], [0], 0
        regions = [(m.start(), m.end()) for m in counts.special.finditer(text)] if counts.special else []
        for start, end in [*regions, (len(text), len(text))]:
            for piece in counts.split(text[at:start]):
                ends.append(ends[-1] + len(piece))
                sizes.append(counts[piece])
            if end > start:
                ends.append(end)
                sizes.append(1)
            at = end
        self.ends, self.totals = ends, list(accumulate(sizes))
        self.special_ends = {end for _, end in regions}

    def at(self, prefix: int) -> int:
        """Tokens of text[:prefix]."""
        k = bisect_right(self.ends, prefix) - 1
        # white space before the cut may join what follows: go back to where
        # its run begins
        while k > 0 and self.ends[k] not in self.special_ends and self.text[self.ends[k] - 1: self.ends[k]].isspace() \
                and self.text[self.ends[k - 1]: self.ends[k]].isspace():
            k -= 1
        rest = self.text[self.ends[k]: prefix]
        return self.totals[k] + self.counts.count(rest)

    def longest_within(self, budget: int) -> int:
        """The longest prefix (code points) that takes at most ``budget``
        tokens and is followed by no shorter count: the cut of a truncation."""
        if self.totals[-1] <= budget:
            return len(self.text)
        k = max(0, bisect_right(self.totals, budget) - 1)
        best = self.ends[k]
        for prefix in range(best + 1, self.ends[min(k + 1, len(self.ends) - 1)] + 1):
            if self.at(prefix) <= budget:
                best = prefix
        return best

    def first_over(self, budget: int) -> int | None:
        """The first piece end whose count exceeds ``budget`` (None: none)."""
        k = bisect_left(self.totals, budget + 1)
        return self.ends[k] if k < len(self.ends) else None


def counter_of(path: str) -> PrefixCounts:
    state = arrays.worker_state()
    if ("prefix", path) not in state:
        state["prefix", path] = PrefixCounts(path)
    return state["prefix", path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, and
    ``fit_chars`` (code points of the longest prefix within ``limit`` tokens,
    read from the prefix counts).

    ``vocabulary`` is the path of a byte-level BPE ``.json`` file, present on
    every machine.  One pass over the rows, no shuffle.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())])

    def count(batches):
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            n_bytes, n_tokens, fits = [], [], []
            for value in texts:
                text = value.as_py()
                n_bytes.append(value.as_buffer().size if text else 0)
                tokens = counter.count(text)
                n_tokens.append(tokens)
                fits.append(len(text) if tokens <= limit else counter.prefix_table(text).longest_within(limit))
            tokens = np.asarray(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(tokens), pa.array(tokens > limit),
                 pa.array(fits, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(count, schema)
