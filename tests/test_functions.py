"""Golden rows for the scalar functions (FIXTURES.md section 3 and the
reference's written acceptance rules)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from roomledger.functions import compose, flags, html as H, numbers, payload as P, text
from roomledger.operators import filters, joins


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("1.250", "1250.00"), ("650,50", "650.50"), ("599", "599.00"), ("€ 1.250,50", "1250.50"),
    ("599.50", "599.00"), ("1 250", "1.00"), ("abc", None), ("1.2500", "1250.00"), ("-50", "50.00"),
    ("650,125", "650.12"), ("0", "0.00"), ("€ 1.250.000,5", "1250000.50"), ("1 250", "1.00"), (None, None),
])
def test_parse_euro_amount(spark, raw, expected):
    got = one(spark, numbers.parse_euro_amount("x"), raw)
    assert got == (Decimal(expected) if expected else None)


@pytest.mark.parametrize("phrase,expected", [
    ("verhuurd", True), ("verhuurder", False), ("in optie", True), ("cookie-opties", False), ("LOUÉ", True),
    ("al VERHUURD!", True), ("pas in optie", True), ("à louer", False), ("je loue", True),
    ("niet meer beschikbaar", True), ("niet  beschikbaar", False), ("bezet.", True), (None, False),
])
def test_phrase_unavailable(spark, phrase, expected):
    assert one(spark, text.matches_any_phrase("x"), phrase) is expected


def test_yes_if_mentioned_never_false(spark):
    df = spark.createDataFrame([("mooie kamer met wasmachine",), ("geen vermelding",)], "x string")
    got = [r["r"] for r in df.select(text.yes_if_mentioned("x", ["wasmachine"]).alias("r")).collect()]
    assert got == [True, None]


def test_detail_href(spark):
    from roomledger import constants as K
    df = spark.createDataFrame([("/huurwoning/abc-1",), ("/verhuurder/huurwoning/abonnementen",),
                                ("https://huurwoningen.be/HUURWONING/x-2/",)], "x string")
    got = [r["r"] for r in df.select(filters.detail_href("x", K.RENTALS_DETAIL_HREF, True).alias("r")).collect()]
    assert got == [True, False, True]


def test_not_both_exceed(spark):
    df = spark.createDataFrame([(120.0, 1300.0), (120.0, 1500.0), (None, 1500.0)], "s double, p double")
    got = [r["r"] for r in df.select(filters.not_both_exceed("s", "p").alias("r")).collect()]
    assert got == [True, False, True]


def test_first_truthy_bath(spark):
    df = spark.createDataFrame([(0, None), (0, 0), (2, None), (None, 1)], "b int, s int")
    got = [r["r"] for r in df.select(flags.bath_flag("b", "s").alias("r")).collect()]
    assert got == [None, False, True, True]


def test_price_per_m2(spark):
    df = spark.createDataFrame([(305.0, 20.0), (305.0, 0.0), (30.5, 2.0), (None, 3.0)], "p double, s double")
    got = [r["r"] for r in df.select(numbers.price_per_m2("p", "s").alias("r")).collect()]
    assert got == [Decimal("15.2"), None, Decimal("15.2"), None]


def test_all_costs_covered(spark):
    df = spark.createDataFrame([(1, None, 3), (1, 4, 2), (None, None, None)], "a int, b int, c int")
    got = [r["r"] for r in df.select(flags.all_costs_covered("a", "b", "c").alias("r")).collect()]
    assert got == [True, False, None]


def test_internet_and_cost_flags(spark):
    df = spark.createDataFrame([(None, [10]), (5, [10]), (None, [1]), (2, None)], "c int, o array<int>")
    got = [r["r"] for r in df.select(flags.internet_flag("c", "o").alias("r")).collect()]
    assert got == [True, False, None, True]


def test_address_and_title(spark):
    df = spark.createDataFrame([("Naamsestraat", "10", "Leuven", "Kamer", "2B"), (None, None, "Leuven", None, None),
                                ("", "", "", None, None)], "s string, n string, c string, t string, u string")
    rows = df.select(compose.compose_address("s", "n", "c").alias("a")).collect()
    assert [r["a"] for r in rows] == ["Naamsestraat 10, Leuven", "Leuven", None]
    t = df.select(compose.unit_title("t", compose.compose_address("s", "n", "c"), "u").alias("t")).collect()
    assert [r["t"] for r in t] == ["Kamer Naamsestraat 10, Leuven (unit 2B)", "Leuven", None]


def test_enum_and_type_label(spark):
    df = spark.createDataFrame([(2, "GROUND_FLOOR", None), (9, None, "APARTMENT")], "c int, sub string, t string")
    rows = df.select(joins.enum_lookup("c").alias("e"), compose.type_label("sub", "t").alias("l")).collect()
    assert [(r["e"], r["l"]) for r in rows] == [("Studio", "Ground floor"), (None, "Apartment")]


def test_html_text_and_links(spark):
    html = ('<html><head><title>T &amp; x</title><script>var a="<a href=\'/no\'>";</script></head><body>'
            '<!-- <a href="/c"> --><main><h1> Hello <b>W</b> </h1><p>a&nbsp;b</p>'
            '<a href="/x?y=1&amp;z">L1</a><a href=\'/y\'>L2</a></main></body></html>')
    r = spark.createDataFrame([(html,)], "h string").select(
        H.text_stripped("h").alias("st"), H.heading_title("h").alias("t"), H.anchor_hrefs("h").alias("a"),
        H.scope_name("h").alias("s")).first()
    assert r["st"] == "T & x Hello W a b L1 L2"
    assert r["t"] == "Hello W"
    assert r["a"] == ["/x?y=1&z", "/y"]
    assert r["s"] == "main"


@pytest.mark.parametrize("href,expected", [
    ("http://a/b", "http://a/b"), ("//cdn/x", "https://cdn/x"), ("/root", "https://ex.com/root"),
    ("", "https://ex.com/a/b?q#f"), ("?q=1", "https://ex.com/a/b?q=1"), ("#z", "https://ex.com/a/b?q#z"),
    ("rel/x", "https://ex.com/a/rel/x"),
])
def test_resolve_url(spark, href, expected):
    assert one(spark, H.resolve_url("x", F.lit("https://ex.com/a/b?q#f")), href) == expected


def test_jsonld_predicates(spark):
    html = ('<script type="application/ld+json">{bad</script>'
            '<script type="application/ld+json">[{"@type":"Room","k":7},{"offers":{"price":"5"},"k":8}]</script>'
            '<script type="application/ld+json">{"offers":null,"k":9}</script>')
    r = spark.createDataFrame([(html,)], "h string").select(
        F.try_variant_get(P.ld_offer_block("h"), "$.k", "int").alias("a"),
        F.try_variant_get(P.ld_typed_block("h"), "$.k", "int").alias("b"),
        F.try_variant_get(P.ld_offer_or_address_block("h"), "$.k", "int").alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (9, 7, 8)


def test_search_payload_fallbacks(spark):
    rows = [('<pre>{"results":[{"k":1}],"totalItems":5}</pre>',),
            ('<pre>bad</pre><script id="__NEXT_DATA__">{"props":{"pageProps":{"classifiedList":{"x":1},'
             '"results":[{"k":3}]}}}</script>',),
            ("<p>nothing</p>",),
            ('<pre>{"results":[],"classifiedList":[{"k":4}]}</pre>',),
            ('<pre>{"results":[{"k":5}],"totalItems":null}</pre>',)]
    got = spark.createDataFrame(rows, "h string").select(P.search_payload("h").alias("s")).select(
        "s.found", "s.total_items", F.size("s.ads").alias("n")).collect()
    # A missing totalItems is 0 (a 2-page cap), not unknown.
    assert [tuple(r) for r in got] == [(True, 5, 1), (True, 0, 1), (False, 0, 0), (True, 0, 1), (True, None, 1)]


def test_numeric_character_references(spark):
    got = one(spark, H.unescape("x"), "LOU&#201; caf&#xe9; a&amp;#233;b &#128512; plain & more &Eacute;t&eacute; &bogus;")
    assert got == "LOUÉ café a&#233;b \U0001F600 plain & more Été &bogus;"


def test_unescape_odd_references(spark):
    cases = {"&#x110000;": "\ufffd", "&#9999999999;": "\ufffd", "&#xD800;": "\ufffd", "&#0;": "\ufffd", "&#00000233;": "é", "&#xe9": "é",
             "&eacute x": "é x", "&notit;": "¬it;", "&hellip;": "…", "&#150;": "–", "&": "&", "&&amp;": "&&", "&unknown": "&unknown"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r["c"]: r["t"] for r in df.select("c", H.unescape("c").alias("t")).collect()} == cases


def test_text_of_very_many_adjacent_tags(spark):
    page = "a" + "<i>" * 100_000 + " \n" * 1000 + "b" + "<br>" * 100_000
    got = spark.createDataFrame([(page,)], "h string").select(H.text_raw("h").alias("r"), H.text_stripped("h").alias("s")).first()
    assert got["r"].split() == ["a", "b"] and got["s"] == "a b"


def test_text_agrees_with_the_standard_parser(spark):
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.nodes, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.hidden:
                self.nodes.append(data)

    pages = ["<p>a<b> b</b>\n<i></i>c &amp; d</p>", "<ul><li> x <li>y</ul>", "<script>var t='<p>';</script>z<style>p{}</style>", "&lt;p&gt;<br/>q"]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    for r in df.select("h", H.text_raw("h").alias("raw"), H.text_stripped("h").alias("stripped")).collect():
        parser = Texts()
        parser.feed(r["h"])
        parser.close()
        assert r["raw"] == " ".join(n for n in parser.nodes if n)
        assert r["stripped"] == " ".join(n.strip() for n in parser.nodes if n.strip())


def test_amounts_out_of_range_cost_the_value_only(spark):
    from roomledger.functions import numbers

    df = spark.createDataFrame([(1e15, 20.0), (305.0, 20.0)], "p double, s double")
    got = [r["x"] for r in df.select(numbers.price_per_m2("p", "s").alias("x")).collect()]
    assert got[0] is None and str(got[1]) == "15.2"
