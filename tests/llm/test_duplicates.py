"""Near duplicates, fingerprints and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from roomledger.llm import arrays, minhash, simhash, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weighted(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    return {g: 1 + np.log(n) for g, n in grams.items()}


def plain_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def sets_of(texts):
    data, offsets = arrays.text_buffers(pa.array(texts, pa.string()))
    doc, shingle, weight = minhash.weighted_shingles(data, offsets)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(shingle[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], (doc, shingle, weight)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 200))] for _ in range(25)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for edits in (0, 1, 2, 6, 20):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts += [" ".join([line] * 40), " ".join([line] * 41), "a", "a", "", "", None, " \n "]
    return texts


def test_probability_jaccard_and_its_estimate():
    texts = [t or "" for t in corpus()][:60]
    sets, (doc, shingle, weight) = sets_of(texts)
    own = [weighted(t) for t in texts]
    registers = minhash.sketches(doc, shingle, weight, len(texts), 1024)
    gaps = []
    for i in range(0, 60, 6):
        for j in range(i + 1, i + 6):
            exact = minhash.probability_jaccard(*sets[i], *sets[j])
            assert exact == pytest.approx(plain_similarity(own[i], own[j]), abs=1e-9)
            gaps.append((registers[i] == registers[j]).mean() - exact)
    assert np.abs(gaps).max() < 0.08 and abs(np.mean(gaps)) < 0.015


@pytest.mark.parametrize("texts", [["a"], ["the end"], ["the end\n", ""], ["a b c"], ["a", "b c"], ["a b c d"], ["a b", "c d"]])
def test_slices_of_few_words(texts):
    sets, _ = sets_of(texts)
    # a shorter text has one shingle, the same as in any other slice
    padded, _ = sets_of([*texts, "u v w x y z"])
    for text, (shingle, weight), (again, _) in zip(texts, sets, padded):
        assert len(shingle) == len(weighted(text)) and shingle.tolist() == again.tolist() and (weight == 1).all()


def test_the_estimate_loses_no_more_than_the_bands():
    n, t = minhash.SIZE, minhash.THRESHOLD
    needed = round(minhash._cut(t) * n)
    below = sum(comb(n, k) * t ** k * (1 - t) ** (n - k) for k in range(needed))
    assert below <= (1 - t ** minhash.ROWS) ** minhash.BANDS < below + comb(n, needed) * t ** needed * (1 - t) ** (n - needed)


def expected_classes(texts):
    own = [weighted(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] and texts[i] == texts[j]) or (own[i] and own[j] and plain_similarity(own[i], own[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(texts))]


def test_near_duplicate_classes_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == expected_classes(texts)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected_classes(texts)))
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(11)
    some = lambda: [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, d, e, f, g = (some() for _ in range(7))
    one = lambda words: " ".join(words)
    rows = [(None, one(a)), (None, near(a)), (None, near(a)),  # a class without any id
            (None, one(b)), (9, near(b)),  # the copy with an id stays
            (1, one(c)), (1, one(d)), (1, one(d)),  # unrelated texts under one id, one of them repeated
            (1, near(e)), (1, one(e)),  # near copies under one id
            (None, one(f)), (None, one(g)), (4, ""), (5, None), (5, ""), (None, "")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    classes = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    expected = [(None, 9 if t == one(b) else None) if k is None else (k, k) for k, t in rows]
    assert classes == sorted(expected, key=repr)
    kept = sorted(((r["doc_id"], r["text"] or "") for r in minhash.keep_first(df).collect()), key=repr)
    first_of = lambda words: next(t for t in (one(words), near(words)) if (None, t) in kept or (1, t) in kept)
    assert kept == sorted([(None, first_of(a)), (9, near(b)), (1, one(c)), (1, one(d)), (1, first_of(e)), (None, one(f)), (None, one(g)),
                           (4, ""), (5, ""), (None, "")], key=repr)


def test_chain_of_copies_is_one_class(spark):
    # Each text is near the next but far from the first: the hub sees few of them.
    rng = random.Random(5)
    words, texts = [f"v{k}" for k in range(300)], []
    for _ in range(12):
        texts.append(" ".join(words))
        words = list(words)
        for _ in range(3):
            words[rng.randrange(300)] = f"n{rng.random()}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["class_id"] for r in minhash.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == expected_classes(texts)


def plain_fingerprint(text, size, bits):
    data, offsets = arrays.text_buffers(pa.array([text], pa.string()))
    words = arrays.Words(data, offsets)
    terms, _ = arrays.shingles(words, arrays.RangeHash(data)(words.start, words.end), size)
    votes = [0] * bits
    for lane in range(bits // 64):
        hashed = arrays.mix(terms + np.uint64(0xD1B54A32D192ED03 * (lane + 1) % (1 << 64)))
        for h in hashed:
            for byte_no, byte in enumerate(int(h).to_bytes(8, "little")):
                for k in range(8):
                    votes[64 * lane + 8 * byte_no + k] += 1 if byte >> (7 - k) & 1 else -1
    return bytes(int("".join("1" if v > 0 else "0" for v in votes[8 * k: 8 * k + 8]), 2) for k in range(bits // 8))


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aé", "bß", "日本", "d\n", "e"]) for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, "x", ""]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(df).collect()}
    order = sorted(zip(ids, (t or "" for t in texts)))
    assert sorted(got) == sorted(ids)
    for (k, own), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(own)
        changed = own[: n - n // 2] + after[: n // 2]
        a, e, b = (plain_fingerprint(t, simhash.SIZE, simhash.BITS) for t in (own, changed, after))
        row = got[k]
        assert (row["n_chars"], row["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (a.hex(), e.hex())
        like = lambda x, y: 1 - sum(bin(p ^ q).count("1") for p, q in zip(x, y)) / simhash.BITS
        assert (row["near_edited"], row["near_next"]) == pytest.approx((like(a, e), like(a, b)))
    assert simhash.edited_fingerprints(df.where("false")).count() == 0


def test_one_document_follows_itself(spark):
    row = simhash.edited_fingerprints(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_radius_search_finds_every_pair(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for flips in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
    prints += prints[:3]
    df = spark.createDataFrame([(k, bytearray(p.to_bytes(8, "big"))) for k, p in enumerate(prints)], "doc_id long, fingerprint binary")
    classes, links = simhash.within_radius(df, 3, 5, 64)
    first = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    assert {r["doc_id"]: r["class_id"] for r in classes.collect()} == {k: first[p] for k, p in enumerate(prints)}
    unique = sorted(first.items(), key=lambda x: x[1])
    expected = {(a, b, bin(p ^ q).count("1")) for i, (p, a) in enumerate(unique) for q, b in unique[i + 1:] if bin(p ^ q).count("1") <= 3}
    assert {tuple(r) for r in links.collect()} == expected


def brute_removal(rows, length=50):
    first = {}
    for k, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p: p + length], k)
    out = []
    for k, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p: p + length]] != k:
                gone[p: p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((k, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    words = ["é", "of", "the", "lorem", "ipsum", "ñandú", "a"]
    shared = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)]
    rows = []
    for k in range(40):
        parts = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts.insert(rng.randint(0, 3), s[cut: len(s) - rng.randint(0, 20)])
        rows.append((k * 3 % 41, "".join(parts)))
    rows += [(50, "a" * 400), (51, "b" + "a" * 300 + "b"), (52, "xy" * 100), (53, "y" + "xy" * 60), (54, "z" * 49), (55, "z" * 50), (56, "z" * 51),
             (57, None), (58, ""), (60, rows[3][1]), (61, rows[3][1]), (61, rows[3][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_match_brute_force(spark, seed):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((tuple(r) for r in suffix.removal_digests(df).collect()), key=repr)
    assert got == brute_removal(rows)


def test_small_slices_and_cut_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HELD_ROWS", 3)
    monkeypatch.setattr(arrays, "SLICE_BYTES", 64)
    rows = passages(3)
    got = sorted((tuple(r) for r in suffix.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_removal(rows)


def phrase_families(seed):
    """Documents that hold a phrase several times, between other words, and
    near copies of them that share some of these places as a whole."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for k in range(60):
        phrase = some(60)
        places = [some(40) + phrase + some(40) for _ in range(3)]
        rows.append((3 * k, "".join(places)))
        for copy in (1, 2):
            parts = [rng.choice(places), some(40) + phrase + some(40), some(40) + phrase + some(40)]
            rows.append((3 * k + copy, "".join(parts)))
    return rows


def test_repeats_of_a_phrase_in_near_copies_of_one_slice(spark):
    rows = phrase_families(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted((tuple(r) for r in suffix.removal_digests(df.repartition(parts)).collect()), key=repr)
        assert got == brute_removal(rows)


def test_documents_without_repeats_keep_their_columns(spark):
    rows = [(1, "x" * 60, 5, "s"), (2, "y" + "x" * 60 + "é", 62, "s"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, held string")
    out = {r["doc_id"]: r for r in suffix.without_repeats(df).collect()}
    assert (out[1]["text"], out[2]["text"], out[2]["n_chars"], out[3]["text"], out[1]["held"]) == ("x" * 60, "yé", 2, None, "s")
    assert suffix.without_repeats(df.where("false")).count() == 0


def test_fingerprint_classes_and_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (30, 16), dtype=np.uint8)
    prints = [bytes(16), *(b.tobytes() for b in base)]
    for b in base:
        for flips in (1, 2, 3, 4, 5):
            bits = np.unpackbits(b)
            bits[rng.choice(128, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits).tobytes())
    for _ in range(60):  # one large group
        bits = np.unpackbits(base[0])
        bits[rng.choice(128, 2, replace=False)] ^= 1
        prints.append(np.packbits(bits).tobytes())
    prints = sorted(set(prints))
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, 16)
    for radius, blocks in ((3, 6), (1, 2), (0, 1), (2, 5)):
        want = {p: int((np.bitwise_count(raw ^ raw[k]).sum(axis=1) <= radius).sum()) - 1 for k, p in enumerate(prints)}
        df = spark.createDataFrame([(bytearray(p),) for p in prints], "print binary")
        got = {bytes(r["print"]): r["near"] for r in simhash.near_counts(df, radius, blocks).collect()}
        assert got == {p: n for p, n in want.items() if n}


def test_fingerprint_classes_of_documents(spark):
    texts = ["one two three four five six", "one two three four five six", "", None, "one two three four five six", "something else is here"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "of no id"), (None, "of no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.fingerprint_classes(df).collect()
    plain = {r["doc_id"]: r for r in simhash.edited_fingerprints(df).collect()}
    assert len(got) == 8 and all(r["fingerprint"] == plain[r["doc_id"]]["fingerprint"] for r in got)
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got if r["doc_id"] is not None) == [
        (0, 0, 3), (1, 0, 3), (2, 2, 2), (3, 2, 2), (4, 0, 3), (5, 5, 1)]
    assert [(r["class_id"], r["class_size"]) for r in got if r["doc_id"] is None] == [(None, 2)] * 2
    assert simhash.fingerprint_classes(df.where("false")).collect() == []
