"""Words, hashes, statistics and learned models against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from roomledger.llm import arrays, quality, rules, stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t ", "a", "a b c a b c\na b c a b c\n\n x", "é#ñ  **|\r\nÉ!!\x0bß 日本 日本\u00a0語", "w " * 5000, "line\nline\nother\nline", "a a a a"]


def buffers(texts):
    return arrays.text_buffers(pa.array(texts, pa.string()))


def test_words_and_hashes_match_plain_python():
    data, offsets = buffers(TEXTS)
    words = arrays.Words(data, offsets)
    raw = data.tobytes()
    got = [[] for _ in TEXTS]
    for s, e, d in zip(words.start, words.end, words.doc):
        got[d].append(raw[s:e].decode())
    assert got == [WORD.findall(t or "") for t in TEXTS]
    hashes = arrays.RangeHash(data)(words.start, words.end)
    by_word = {}
    for s, e, h in zip(words.start, words.end, hashes.tolist()):
        assert by_word.setdefault(raw[s:e], h) == h
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("slice_bytes", [1, 7, 1 << 20])
def test_counts_match_plain_python(monkeypatch, slice_bytes):
    monkeypatch.setattr(arrays, "SLICE_BYTES", slice_bytes)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    rows = []
    for part, data, offsets in arrays.slices(batch):
        counted = stats.text_counts(data, offsets)
        rows += [{c: int(counted[c][k]) for c in stats.COUNTS} for k in range(part.num_rows)]
    assert len(rows) == len(TEXTS)
    for text, row in zip(TEXTS, rows):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k: k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (row["n_words"], row["word_chars"]) == (len(words), sum(map(len, words)))
        assert row["n_symbols"] == sum(text.count(s) for s in "#*$%&|<>")
        assert (row["n_lines"], row["n_dup_lines"]) == (len(lines), len(lines) - len(set(lines)))
        assert row["n_repeat_words"] == len(covered) and row["n_distinct_words"] == len(set(words))


def test_discriminant_matches_the_density_formula(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(1.5, 2, (300, 3))])
    y = [0] * 200 + [1] * 300
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in zip(y, x)], "label int, a double, b double, c double")
    model = quality.fit(df, ["a", "b", "c"], shrinkage=0.2, ridge=0.1)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    pooled, odds = np.cov(z.T, bias=True), []
    for k in (0, 1):
        own = z[np.array(y) == k]
        cov = 0.8 * np.cov(own.T, bias=True) + 0.2 * pooled + 0.1 * np.eye(3)
        d = z - own.mean(axis=0)
        odds.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own) / 500))
    assert np.allclose(model.log_odds(x), odds[1] - odds[0], atol=1e-6)
    assert quality.fit(df.where("label = 1"), ["a", "b", "c"]) is None


def test_decision_list_learns_and_prunes_thresholds():
    rng = np.random.default_rng(2)
    a, b = rng.random(900), rng.random(900)
    bad = (a > 0.7) | ((b < 0.2) & (a > 0.3))
    learned = rules.learn({"a": a, "b": b, "noise": rng.random(900)}, bad, np.arange(900) % 3 == 0)
    hit = np.zeros(900, bool)
    for rule in learned:
        hit |= rules.covers(rule, {"a": a, "b": b, "noise": rng.random(900)}, 900)
    assert (hit == bad).mean() > 0.97 and len(learned) <= 6
    assert rules.learn({"a": a}, np.zeros(900, bool), np.arange(900) % 3 == 0) == []


def test_quality_queries_on_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, "w " * 60, "y"), (3, "w " * 60, "y")],
                                "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (9, 1)], "doc_id long, quality int")
    scores = quality.quality_scores(odd, labels).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    judged = rules.quality_rules(odd, labels).collect()
    assert {(r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in judged} == {
        (1, 0, True, False), (2, 0, True, False), (None, 2, True, False), (3, 60, True, False)}
    empty = odd.where("false")
    assert quality.quality_scores(empty, labels).count() == 0 and rules.keep_documents(empty, labels).columns == odd.columns
