"""Mixing, chat formatting, WARC derivatives."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from roomledger.llm import chat, mixing, warc


def plain_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return target


def mix_rows(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in (("a", 400), ("b", 30), ("é", 90), ("z", 3), (None, 60)):
        for _ in range(n):
            rows.append((k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 20, 80, 300]))), source))
            k += 1
    return rows + [(k, None, "a"), (k + 1, "w w", "a"), (k + 1, "w w", "a")]


def test_mix_meets_targets(spark):
    rows = mix_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected = plain_targets(sizes)
    source_of = {k: s for k, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(0.02 * expected[s], 25)
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_are_the_balanced_solution(spark):
    df = spark.createDataFrame(mix_rows(2), "doc_id long, text string, source string")
    rows = mixing.mixed(df).toPandas()
    for (target, _), own in rows[rows["size"] > 0].groupby(["target", "source_size"]):
        assert (own["rate"] * own["size"]).sum() == pytest.approx(target, rel=1e-4)
        free = own[(own["rate"] < 3)]
        # the tilt is exponential in the size: log rate / size is one number
        tilt = (free["rate"].apply(lambda r: __import__("math").log(r)) / free["size"]).round(9)
        assert tilt.max() - tilt.min() < 1e-6 if len(tilt) else True


def test_mixed_documents_and_odd_tables(spark):
    rows = mix_rows(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    copies = {(r["doc_id"]): 0 for r in df.collect()}
    for r in mixing.mixed(df).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in copies.items() if n}
    assert mixing.mixed(df.where("false")).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mixed(blank).collect()] == [(0, 0.0), (0, 0.0)]


NASTY = ["", "plain", "<|turn:user|>\n", "<\\|x|\\>", "\\\\<|end|>\n\\", "|>|\\>", "<|", "\\<|", "a\\", "\\### Assistant: </turn> ok", "\n\nü日本"]


def test_escaping_is_reversible(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice("\\<|>a\n") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"] and "|>" not in r["e"]


def test_conversations_read_back(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "<|end|>"]), rng.choice([*NASTY, None]) if rng.random() < 0.5 else "".join(rng.choice("\\<|> x") for _ in range(9))))
    rows += [(31, 0, "user", "same"), (31, 0, "user", "same"), (None, 1, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(df.where("false")).count() == 0


def test_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None), None,
             ("audio", None, "s3://a", None, None, 1.5, None), ("document", None, "s3://d", None, None, None, 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)]), (2, 0, "user", None)], schema)
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert got[1]["formatted"] == "<|turn:user|>\nsee <|image:0.1|><|audio:0.2|><|document:0.3|><|end|>\n<|turn:assistant|>\nok<|end|>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in got[1]["attachments"]] == [("image", "s3://i", 3), ("audio", "s3://a", 38), ("document", "s3://d", 512)]
    start, length = got[1]["loss_spans"][0]
    assert got[1]["formatted"][start: start + length] == "ok" and got[1]["attachment_tokens"] == 553
    assert got[2]["formatted"] == "<|turn:user|>\n<|end|>\n" and got[2]["loss_spans"] == []


def test_derivatives_link_and_round_trip(spark):
    pages = spark.createDataFrame([
        (1, "http://a/", "<html lang=fr><title>T &amp; t</title><script>x<b></script><p>Un&eacute;<p>deux<a href='/l'>l</a>"),
        (2, None, None), (3, "http://c/", "<p>" * 5000 + "x"), (1, "http://a/", "again")], "page_id long, url string, html string")
    responses = warc.responses_of_pages(pages)
    records = warc.derivatives(responses)
    rows = records.collect()
    assert len(rows) == 8 and len({r["record_id"] for r in rows}) == 8
    by_response = {r["record_id"]: r for r in responses.collect()}
    for r in rows:
        source = by_response[r["refers_to"]]
        assert (r["target_uri"], r["source_payload_digest"]) == (source["target_uri"], source["payload_digest"])
        assert r["source_block_digest"] == "sha256:" + hashlib.sha256(bytes(source["block"])).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
    one = {r["record_type"]: r for r in rows if r["key"] == "1" and "again" not in r["block"] and "T & t" in r["block"]}
    assert one["conversion"]["block"] == "T & t\nUné\ndeuxl"
    fields = one["metadata"]["block"].split("\r\n")
    assert {"title: T & t", "languages-html: fr", "outlink: /l", f"conversion-id: {one['conversion']['record_id']}", "source-status: HTTP/1.1 200 OK"} <= set(fields)
    data = b"".join(gzip.decompress(bytes(r["record"])) for r in warc.warc_blocks(records).collect())
    parsed = warc.read_records(data)
    assert sorted(h["WARC-Record-ID"] for h, _ in parsed) == sorted(r["record_id"] for r in rows)
    assert {h["WARC-Record-ID"]: b.decode() for h, b in parsed} == {r["record_id"]: r["block"] for r in rows}
    assert warc.derivatives(responses.where("false")).count() == 0


@pytest.mark.parametrize("page, text", [
    ("a<template-card>b</template-card>c<style-guide x=1>d", "abcd"),
    ("a<svg-icon></svg-icon>b<title>T</title><svg><path/>hidden</svg>c", "ab\nT\nc"),
    ("a<svg width='1' title=\"x > y\"/>b<svg/>c<svg >hidden</svg >d", "a b c d"),
    ("a<script>hidden</script>b<STYLE\n>hidden</style>c<noscript/>hidden", "a b c"), ("a<script", "a")])
def test_only_whole_tag_names_are_dropped(page, text):
    assert warc.plain_text(page) == text


def test_titles_and_links_after_custom_elements():
    page = "<svg-icon></svg-icon><title>T</title><a href='/l'>l</a><svg/><a href='/m'>m</a><svg></svg>"
    assert warc.page_facts(page) == [("title", "T"), ("outlink", "/l"), ("outlink", "/m")]


def test_http_blocks_of_other_servers():
    raw = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: b: c\r\n\r\n<p>caf\xe9</p>"
    metadata, conversion = warc.derived("k", "<urn:uuid:1>", "http://x/", "d", raw, "sha1:ABC", None)
    assert conversion[-1] == "café" and metadata[9] == "sha1:ABC" and "source-header-x-a: b: c" in metadata[-1]
    assert warc.derived("k", None, None, None, b"", None, None)[1][-1] == ""
    assert warc.derived("k", None, None, None, b"no head", None, None)[1][-1] == "no head"
