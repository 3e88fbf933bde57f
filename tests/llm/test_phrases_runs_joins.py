"""Phrases, periodic runs and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roomledger.llm import arrays, jaccard, phrases, repeats, wordids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# --- phrases ------------------------------------------------------------------


def plain_collocations(rows, least=10, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "a", "Ünder", "x|y", "und", "zz", " ", "Q"] + [f"w{k}" for k in range(20)]
    rows = []
    for k in range(150):
        words = rng.choices(vocabulary, weights=[9, 8, 7, 3, 3, 3, 2, 2, 2] + [1] * 20, k=rng.randint(0, 80))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((k, text, rng.choice(["en", "en", "fr", None])))
    rows += [(200, None, "en"), (201, "", None), (202, " .,;\n", "xx"), (203, "in the dark " * 30, "fr"), (203, "in the dark " * 30, "fr")]
    return rows


@pytest.mark.parametrize("held, vocabulary", [(phrases.HELD, phrases.VOCABULARY), (50, 7)])
def test_collocations(spark, monkeypatch, held, vocabulary):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "VOCABULARY", vocabulary)
    monkeypatch.setattr(phrases, "BURST", 64)
    df = table(spark, rows).repartition(3)
    counted = phrases.frequent_phrases(df, 1, held=held, parts=5).where("size > 0").collect()
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            f.update((lang or "und", *words[i: i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert Counter({(r.lang, *[w for w in (r.w1, r.w2, r.w3) if w is not None]): r.f for r in counted}) == f
    for most in (2000, 3):
        got = phrases.collocations(df, most=most, parts=3).collect()
        assert {tuple(r) for r in got} == plain_collocations(rows, most=most) and len(got) > 3


def test_large_counts_stay_exact(spark):
    rows = [("en", 2, "a", "b", None, 3_000_000_000_019), ("en", 1, "a", None, None, 9_000_000_000_021), ("en", 1, "b", None, None, 8_000_000_000_033)]
    df = spark.createDataFrame(rows, phrases.GRAMS).selectExpr("f AS a").where("a = 3000000000019")
    score = df.select(F.expr("(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)))"
                             " DIV (CAST(9000000000021 AS DECIMAL(38,0)) * CAST(8000000000033 AS DECIMAL(38,0)))")).first()[0]
    assert score == 1_000_000 * 3_000_000_000_019 ** 2 // (9_000_000_000_021 * 8_000_000_000_033)


def test_a_trie_bursts_and_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 32)
    rng = np.random.default_rng(1)
    trie, plain = phrases.HatTrie(), Counter()
    for _ in range(30):
        ids = np.minimum(rng.zipf(1.5, 400), 200).astype(np.uint64)
        keys, counts = phrases.packed_phrases(ids, np.minimum(3, 400 - np.arange(400)))
        trie.add(keys, counts)
        plain.update(dict(zip(keys.tolist(), counts.tolist())))
    assert trie.children and any(child.children for child in trie.children.values())
    before = len(trie)
    keys, counts = trie.spill(before // 4)
    assert (np.diff(keys.astype(np.int64)) > 0).all() and len(trie) <= before // 4
    rest = trie.entries()
    assert Counter(dict(zip(keys.tolist(), counts.tolist()))) + Counter(dict(zip(rest[0].tolist(), rest[1].tolist()))) == plain


# --- periodic runs ------------------------------------------------------------


def plain_runs(words, shortest=6, power=4):
    found = {}
    for q in range(1, len(words) // power + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(shortest, power * q):
                found.setdefault((i - q, j), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def periodic_texts(seed, texts=60):
    rng = random.Random(seed)
    for _ in range(texts):
        words, n = [], rng.choice([0, 1, 5, 6, 7, 20, 90, 400])
        if rng.random() < 0.4:
            words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(n)]
        while len(words) < n:
            period = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
            words += (period * 10)[: int(len(period) * rng.uniform(1, 9))] + [rng.choice("abxyz") for _ in range(rng.randint(0, 12))]
        yield rng.choice([" ", "\n", "\t "]).join(words)


def runs_of(texts, **options):
    data, offsets = arrays.text_buffers(pa.array(texts, pa.string()))
    words = arrays.Words(data, offsets)
    number, _ = wordids.numbered(data, wordids.marks(len(data), words.start, words.end), words.start, words.end)
    out = [[] for _ in texts]
    for a, b, q in zip(*(x.tolist() for x in repeats.find_runs(number, words.doc, words.first, **options))):
        d = words.doc[a]
        out[d].append((a - int(words.first[d]), b - a, q))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    texts = list(periodic_texts(seed))
    assert runs_of(texts) == [plain_runs(t.split()) for t in texts]
    assert runs_of(texts, shortest=3, power=3) == [plain_runs(t.split(), 3, 3) for t in texts]


def test_long_periodic_texts_take_no_quadratic_work():
    n = 400_000
    found = runs_of(["a " * n, " ".join(str(i % 3000) for i in range(n))])
    assert found == [[(0, n, 1)], [(0, n, 3000)]]


def test_run_digests(spark):
    texts = [*periodic_texts(9, 120), "a b " * 30, None, "", " \n ", "q" * 2_000_000]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], "en"), (None, "x y " * 8, None)]
    got = repeats.run_digests(repeats.with_planted_periods(table(spark, rows))).collect()
    want = []
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        drop = {k for a, length, q in runs for k in range(a + q, a + length)}
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in drop).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_runs_pass_other_columns_on(spark):
    df = spark.createDataFrame([(1, "a " * 9, "x", 2.5)], "doc_id long, text string, runs_text string, w double")
    row = repeats.with_runs(repeats.with_planted_periods(df)).first()
    assert row.asDict() == {"doc_id": 1, "runs_text": "x", "w": 2.5, "runs": [(0, 9, 1)], "collapsed": "a"}
    assert repeats.with_runs(df.limit(0)).collect() == []


# --- Jaccard join -------------------------------------------------------------


def plain_components(rows):
    sets = []
    for _, text, _ in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), key if not sets[i] else min(ids, default=None)))
    return sorted(out, key=repr)


def copies(seed, groups=12, size=14):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(300)]
    texts = []
    for _ in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        for _ in range(size):
            # chains of copies of copies, so ends of a chain do not link
            base = list(words) if rng.random() < 0.5 or not texts else texts[-1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(base))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    rng.shuffle(texts)
    return [*texts, "a b", "A  B", "a", None, "", " \t", "one two three four five", "one two three four five", "t " * 3000]


@pytest.mark.parametrize("seed,block,flush", [(1, jaccard.BLOCK, jaccard.FLUSH), (2, 300, 2000), (3, 1000, 500), (4, 40, 10_000)])
def test_components(spark, monkeypatch, seed, block, flush):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    monkeypatch.setattr(jaccard, "BUCKET", 3000)
    monkeypatch.setattr(arrays, "SLICE_BYTES", 4000)
    rows = [(k, t, "en") for k, t in enumerate(copies(seed))]
    rows += [(5, rows[5][1], "en"), (7, rows[9][1], None), (None, rows[11][1], None), (None, "nobody else has this text at all", None)]
    got = jaccard.linked_components(table(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_components_of_an_empty_table(spark):
    assert jaccard.linked_components(table(spark, [])).collect() == []


def test_filters_never_exceed_the_truth():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64) << np.uint64(50)) for _ in range(40)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jaccard.overlaps(sets, sets) == exact).all()
    assert (jaccard.suffix_bounds(sets, sets) >= exact).all()
    total = np.arange(1, 500)
    least = jaccard.needed(total)
    assert (100 * least >= 80 * (total - least)).all() and (100 * (least - 1) < 80 * (total - least + 1)).all()
