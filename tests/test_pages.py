"""Pages that are long, deep, nested or broken."""

import random
import time

import pytest
from pyspark.sql import functions as F

from roomledger.functions import html as H
from roomledger.operators import html_facts as X

OPENED = ["<!--", "<!-->", "<script ", "<script>", "<style>", "<", "<a ", '<a href="', "<main>", "<h1>", "</a>", '<a x="', "&am", "<p/ "]


def page_frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")


def test_unclosed_markup_of_a_megabyte(spark):
    df = page_frame(spark, *["head" + mark * (1_000_000 // len(mark)) for mark in OPENED])
    began = time.time()
    rows = df.select("page_id", H.text_raw("html").alias("t"), H.text_stripped("html"), H.main_scope("html"), H.heading_title("html"),
                     H.anchor_hrefs("html"), H.anchors("html"), H.strip_tags("html")).collect()
    assert len(rows) == len(OPENED) and all(r["t"].startswith("head") for r in rows)
    assert time.time() - began < 120


@pytest.mark.parametrize("page", [
    "".join(f'<div><p>x</p><a href="/huurwoning/c-{i}">C{i}</a></div>' for i in range(5000)),
    '<a href="/huurwoning/c-7">C7</a>' * 5000, "<div>" * 60_000, "<ul><li>" * 30_000, "<p>a" * 60_000, "<b>" * 30_000 + "</i>" * 30_000])
def test_long_and_deep_pages(spark, page):
    began = time.time()
    cards = X.html_facts(page_frame(spark, page)).first()["cards"]
    assert time.time() - began < 60
    if "/c-4999" in page:
        assert [c["text"] for c in cards] == [f"x C{i}" for i in range(5000)]
    if "/c-7" in page and "<div>" not in page:
        assert [c["href"] for c in cards] == ["/huurwoning/c-7"]


def test_a_nested_scope_keeps_its_tail(spark):
    nested = "<p>a</p><article>b<article>c</article>d</article>e"
    titled = "<h2>x</h2><h1>one<h1>two</h1>three</h1>"
    main = "<Main id=m>1<main>2</main>3</MAIN >4<main>5</main>"
    unclosed = "<div>0<main>1<p>2</div>"
    other = "<mainly>x</mainly><articles>y</articles>"
    df = page_frame(spark, nested, titled, main, unclosed, other, "</main>a<main>b", None)
    got = [(r["s"], r["t"], r["h"]) for r in df.select(
        H.scope_name("html").alias("s"), H.text_stripped(H.main_scope("html"), cleaned=True).alias("t"), H.heading_title("html").alias("h")).collect()]
    assert got == [("article", "b c d", None), ("page", "x one two three", "one two three"), ("main", "1 2 3", None), ("main", "1 2", None),
                   ("page", "x y", None), ("main", "b", None), ("page", None, None)]


def test_blocks_and_tags_that_end_with_the_page(spark):
    cases = {"a<!-- b": "a", "a<!-->b": "a b", "a<script>b": "a", "a<script x": "a", "a<style-guide>b</style-guide>": "a b", "1 < 2 <b>3": "1 < 2 3",
             "x<3 y": "x<3 y", "a<b c": "a", "a<SCRIPT>x</script >b": "a b", "a<template><p>x</p></template>b": "a b", "<<p>>a": "< >a"}
    df = spark.createDataFrame([(c,) for c in cases], "html string")
    assert {r["html"]: r["t"] for r in df.select("html", H.text_stripped("html").alias("t")).collect()} == cases


def test_links_in_broken_markup(spark):
    page = "<a>0</a><a href=/1>1<b>x</b></a><a href='/2'>2<a href='/3'>3</a>z</a><a title=\"href\" href=\"/4\">4</A >y<a href=/5>5"
    row = page_frame(spark, page).select(H.anchor_hrefs("html").alias("all"), H.anchors("html").alias("closed")).first()
    assert row["all"] == ["/1", "/2", "/3", "/4", "/5"]
    assert [(a["href"], a["text"]) for a in row["closed"]] == [("/1", "1 x"), ("/2", "2 3"), ("/4", "4")]


def plain_elements(tags):
    """(end, until, parent) per opening tag, by a stack of the open ones."""
    out, stack, n = [], [], 0

    def close(keep, at):
        for k in stack[keep:]:
            out[k] = (at, n, out[k][2])
        del stack[keep:]

    names = []
    for at, tag in enumerate(tags):
        name = tag.strip("</>")
        found = [k for k, e in enumerate(stack) if names[e] == name]
        if tag.startswith("</"):
            if found:
                close(found[-1], at)
            continue
        victims = [v for v, (ended_by, _) in X.ENDS.items() if name in ended_by]
        containers = {c for v in victims for c in X.ENDS[v][1]}
        barrier = max([k for k, e in enumerate(stack) if names[e] in containers], default=-1)
        last = {names[e]: k for k, e in enumerate(stack) if k > barrier and names[e] in victims}
        if last:
            close(min(last.values()), at)
        names.append(name)
        out.append((at + 1, n + 1, stack[-1] if stack else -1))
        n += 1
        if name not in X.VOID_TAGS:
            stack.append(n - 1)
    close(0, len(tags))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_elements_by_a_stack(spark, seed):
    rng = random.Random(seed)
    names = ["div", "p", "ul", "li", "table", "tr", "td", "b", "br", "a", "option", "dl", "dt", "dd"]
    pages = [[f"<{'/' * (rng.random() < 0.4)}{rng.choice(names)}>" for _ in range(rng.choice([0, 1, 5, 40, 300, 700]))] for _ in range(25)]
    df = page_frame(spark, *["".join(p) for p in pages]).select("page_id", X.tokens("html").alias("t"))
    got = {r["page_id"]: [(e["end"], e["until"], e["parent"]) for e in r["e"]]
           for r in df.select("page_id", X.elements(F.col("t")).alias("e")).collect()}
    assert got == {k: plain_elements(p) for k, p in enumerate(pages)}


def test_the_last_label_wins(spark):
    df = spark.createDataFrame([([("b", "1"), ("a", "2"), ("b", None), ("a", "3")],), ([],), (None,)], "p array<struct<k string, v string>>")
    assert [r[0] for r in df.select(X.last_wins_map(F.col("p"))).collect()] == [{"a": "3", "b": None}, {}, None]
