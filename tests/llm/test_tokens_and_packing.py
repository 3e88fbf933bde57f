"""Token counts, packing and its linear program."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from roomledger.llm import packing, token_counts  # noqa: E402

TEXTS = ["", "Hello  world\n\n  it's we'll '  <|endoftext|> x", "日本語のテキスト ", "a" * 300, " " * 70, "ΣΑΣ İ é ﬁ ½ 123 \x1c\x85", "“q” —x… ñandú", "x'll\tY<|startoftext|>z"]


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounts(path), tokenizers.Tokenizer.from_file(path)
    assert [counter.count(t) for t in TEXTS] == [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]


def test_every_prefix_equals_encoding_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.PrefixCounts(path), tokenizers.Tokenizer.from_file(path)
    for text in [t for t in TEXTS if "<|" not in t] + ["we'll  go they're   on\n\n x"]:
        table = counter.prefix_table(text)
        counts = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert [table.at(p) for p in range(len(text) + 1)] == counts
        cut = table.longest_within(5)
        assert counts[cut] <= 5


def test_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.WordIds(path), tokenizers.Tokenizer.from_file(path)
    for t in TEXTS:
        assert words.ids(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_the_whole_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 65, 20))
    demand = rng.integers(1, 500, len(sizes))
    placed = np.zeros(len(sizes), int)
    bins = 0
    for pattern, times in packing.rounded_patterns(sizes, demand, 64):
        assert sum(sizes[c] * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            placed[c] += n * times
        bins += times
    assert (placed == demand).all()
    columns, used = packing.generate_patterns(sizes, demand.astype(float), 64)
    assert np.allclose(columns @ used, demand) and (sizes @ columns <= 64).all()
    # the fractional optimum, and at most one more sequence per length
    assert (sizes * demand).sum() / 64 <= used.sum() + 1e-6 and bins <= used.sum() + len(sizes)
    # optimal: no pattern is worth more than a sequence at the program's prices
    worth = np.linalg.solve(columns.T, np.ones(len(sizes)))
    assert packing.best_pattern(np.maximum(worth, 0), sizes, 64)[0] <= 1 + 3e-4
    assert packing.slot_table([], [], 64) == []


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = {k: "alpha beta gamma delta " * (k % 37) + ("word%d " % k) * (k * k) for k in range(60)} | {100: None, 101: ""}
    rows = [(k, t, "extra") for k, t in texts.items()] + [(5, texts[5], "again")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, length string"), path, length=512).toPandas()
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == seq["length"].cumsum().shift(fill_value=0).tolist() and seq["length"].sum() <= 512
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].nunique()))
    for k, t in texts.items():
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == k].drop_duplicates("start").sort_values("start")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s: s + n].tobytes()) for s, n in zip(own["start"], own["length"])]
    assert (out[out.doc_id == 5].groupby("start").size() == 2).all()
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
