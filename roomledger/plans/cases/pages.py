"""Page-level cases on ``pages`` (page_id, url, html): links, URL handling,
scopes, titles, visible text, first card per URL and the link -> page join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import html as H
from ...functions.text import WS_CLASS
from ...operators import aggregates, filters, html_facts, joins, ordering, windows
from ...sources import payloads
from . import case, read
from .sqlbits import phrase_re2, q

# Parameters fitted to the driver's pages (their links are one-word paths).
DETAIL_CI = r"^(?:https?://[^/]+)?/[a-z0-9-]+/?$"
DETAIL_CS = r"/[A-Z][a-z]+/?$"
SUPPLY_MARKER = ".example."
SUPPLY_SET = ["de", "the", "in", "los", "was"]
CARD_PHRASES = [r"\bthe\b", r"\bde\b"]


# --- DuckDB spellings of the html functions --------------------------------
# Written for the driver's pages and on their own: they share no pattern and
# no table with the library.  The pages' references are &amp; &quot; &copy;
# &middot; (some cut short), their non-text blocks comments, scripts and styles.

SQL_BLOCKS = r"(?is)<!--.*?-->|<script[ >].*?</script>|<style[ >].*?</style>"
SQL_HREF = r"""(?i)<a [^>]*?href=("[^"]*"|'[^']*'|[^ "'>]+)"""
SQL_ANCHOR = r"""(?is)<a [^>]*?href=("[^"]*"|'[^']*'|[^ "'>]+)[^>]*>(.*?)</a>"""


def unescape_sql(e: str) -> str:
    for name, text in (("quot", '"'), ("copy", "\u00a9"), ("middot", "\u00b7"), ("amp", "&")):
        e = f"regexp_replace({e}, '&{name};?', {q(text)}, 'g')"
    return e


def visible_sql(e: str) -> str:
    return f"regexp_replace({e}, {q(SQL_BLOCKS)}, '<x>', 'g')"


def nodes_sql(e: str) -> str:
    """The text nodes: what stands between tags."""
    return f"string_split_regex({visible_sql(e)}, '<[^>]*>')"


def text_raw_sql(e: str) -> str:
    return unescape_sql(f"array_to_string(list_filter({nodes_sql(e)}, lambda n: n <> ''), ' ')")


def text_stripped_sql(e: str) -> str:
    stripped = f"list_transform({nodes_sql(e)}, lambda n: trim({unescape_sql('n')}, ' ' || chr(9) || chr(10) || chr(13)))"
    return f"array_to_string(list_filter({stripped}, lambda n: n <> ''), ' ')"


def unquote_sql(e: str) -> str:
    return f"CASE WHEN starts_with({e}, '\"') OR starts_with({e}, '''') THEN substr({e}, 2, length({e}) - 2) ELSE {e} END"


def hrefs_sql(e: str) -> str:
    raw = f"regexp_extract_all({visible_sql(e)}, {q(SQL_HREF)}, 1)"
    return f"list_transform({raw}, lambda h: {unescape_sql(unquote_sql('h'))})"


def element_sql(v: str, tag: str) -> tuple[str, str]:
    has = f"regexp_matches({v}, {q(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')})"
    inner = f"regexp_extract({v}, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>')}, 1)"
    return has, inner


def fold_sql(segs: str) -> str:
    folded = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    folded = f"CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({folded}, '') ELSE {folded} END"
    joined = f"array_to_string({folded}, '/')"
    return f"CASE WHEN starts_with({joined}, '/') THEN {joined} ELSE '/' || {joined} END"


def resolve_sql(orig: str, b: str) -> str:
    empty_auth = f"regexp_matches({orig}, '^//([/?#]|$)')"
    h = f"(CASE WHEN {empty_auth} THEN substr({orig}, 3) ELSE {orig} END)"
    scheme_re = r"^[A-Za-z][A-Za-z0-9+.\-]*"
    origin = f"regexp_extract({b}, {q('(' + scheme_re + '://[^/?#]*)')}, 1)"
    scheme = f"regexp_extract({b}, {q('(' + scheme_re + '):')}, 1)"
    no_query = f"regexp_extract({b}, '^([^?#]*)', 1)"
    no_frag = f"regexp_extract({b}, '^([^#]*)', 1)"
    h_path = f"regexp_extract({h}, '^([^?#]*)', 1)"
    h_rest = f"regexp_extract({h}, '^[^?#]*(.*)$', 1)"
    b_parts = f"string_split(regexp_extract({b}, {q(scheme_re + '://[^/?#]*([^?#]*)')}, 1), '/')"
    b_dir = f"(CASE WHEN {b_parts}[-1] <> '' THEN {b_parts}[1:len({b_parts}) - 1] ELSE {b_parts} END)"
    segs = f"list_concat({b_dir}, string_split({h_path}, '/'))"
    segs = f"list_filter({segs}, lambda s, i: i = 1 OR i = len({segs}) OR s <> '')"
    return (f"CASE WHEN {orig} = '' THEN {b} "
            f"WHEN {h} = '' THEN {no_frag} "
            f"WHEN regexp_matches({h}, {q(scheme_re + ':')}) THEN {h} "
            f"WHEN starts_with({h}, '//') AND NOT {empty_auth} THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '?') THEN {no_query} || {h} "
            f"WHEN starts_with({h}, '#') THEN {no_frag} || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {fold_sql(f'string_split({h_path}, chr(47))')} || {h_rest} "
            f"ELSE {origin} || {fold_sql(segs)} || {h_rest} END")


LINKS_SQL = f"""
page_hrefs AS (SELECT page_id, url, {hrefs_sql('html')} AS hrefs FROM pages),
links AS (SELECT page_id, url, CAST(i AS INTEGER) AS pos, hrefs[i + 1] AS href
          FROM (SELECT page_id, url, hrefs, unnest(range(len(hrefs))) AS i FROM page_hrefs))"""


def links_df(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    return pages.select("page_id", "url", F.posexplode(H.anchor_hrefs("html")).alias("pos", "href"))


# --- cases -------------------------------------------------------------------

@case("html_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href FROM links")
def html_links(spark, d):
    return links_df(spark, d).select("page_id", "pos", "href")


@case("distinct_links", f"WITH {LINKS_SQL} SELECT page_id, href, min(pos) AS pos FROM links GROUP BY page_id, href")
def distinct_links(spark, d):
    return aggregates.distinct_links(links_df(spark, d), ["page_id"], "href", ["pos"])


@case("resolve_url", f"WITH {LINKS_SQL} SELECT page_id, pos, href, {resolve_sql('href', 'url')} AS detail_url FROM links")
def resolve_url(spark, d):
    return links_df(spark, d).select("page_id", "pos", "href", H.resolve_url("href", "url").alias("detail_url"))


@case("strip_query", f"""WITH {LINKS_SQL}
SELECT page_id, pos, href, split_part(href, '?', 1) AS href_path, split_part(url, '?', 1) AS page_path FROM links""")
def strip_query(spark, d):
    return links_df(spark, d).select(
        "page_id", "pos", "href", H.strip_query("href").alias("href_path"), H.strip_query("url").alias("page_path")
    )


@case("detail_href", f"""WITH {LINKS_SQL}
SELECT page_id, pos, href, COALESCE(regexp_matches(href, {q('(?i)' + DETAIL_CI)}), false) AS is_detail_ci,
       COALESCE(regexp_matches(href, {q(DETAIL_CS)}), false) AS is_detail_cs FROM links""")
def detail_href(spark, d):
    return links_df(spark, d).select(
        "page_id", "pos", "href",
        filters.detail_href("href", DETAIL_CI, True).alias("is_detail_ci"),
        filters.detail_href("href", DETAIL_CS, False).alias("is_detail_cs"),
    )


@case("supply_category", f"""WITH {LINKS_SQL}, r AS (SELECT page_id, pos, {resolve_sql('href', 'url')} AS detail_url FROM links)
SELECT page_id, pos, detail_url, contains(detail_url, {q(SUPPLY_MARKER)})
       AND (COALESCE(string_split(detail_url, '/')[4], '') IN ({', '.join(q(s) for s in SUPPLY_SET)})
            OR COALESCE(string_split(detail_url, '/')[4], '') = '') AS is_supply FROM r""")
def supply_category(spark, d):
    r = links_df(spark, d).select("page_id", "pos", H.resolve_url("href", "url").alias("detail_url"))
    return r.select("page_id", "pos", "detail_url",
                    filters.supply_category("detail_url", SUPPLY_MARKER, SUPPLY_SET).alias("is_supply"))


@case("html_strip_tags", "SELECT page_id, regexp_replace(COALESCE(html, ''), '<[^>]+>', ' ', 'g') AS text FROM pages")
def html_strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", H.strip_tags("html").alias("text"))


@case("html_text", f"SELECT page_id, {text_raw_sql('html')} AS text_raw, {text_stripped_sql('html')} AS text_stripped FROM pages")
def html_text(spark, d):
    return read(spark, d, "pages").select(
        "page_id", H.text_raw("html").alias("text_raw"), H.text_stripped("html").alias("text_stripped")
    )


def _scope_sql() -> str:
    v = visible_sql("html")
    m_has, m_in = element_sql("v", "main")
    a_has, a_in = element_sql("v", "article")
    return f"""WITH s AS (SELECT page_id, {v} AS v FROM pages)
SELECT page_id, CASE WHEN {m_has} THEN 'main' WHEN {a_has} THEN 'article' ELSE 'page' END AS scope,
       {text_raw_sql(f'CASE WHEN {m_has} THEN {m_in} WHEN {a_has} THEN {a_in} ELSE v END')} AS scope_text FROM s"""


@case("html_main_scope", _scope_sql())
def html_main_scope(spark, d):
    return read(spark, d, "pages").select(
        "page_id", H.scope_name("html").alias("scope"), H.text_raw(H.main_scope("html")).alias("scope_text")
    )


def _title_sql() -> str:
    h1_has, h1_in = element_sql("v", "h1")
    h2_has, h2_in = element_sql("v", "h2")
    return f"""WITH s AS (SELECT page_id, {visible_sql('html')} AS v FROM pages)
SELECT page_id, CASE WHEN {h1_has} THEN {text_stripped_sql(h1_in)} WHEN {h2_has} THEN {text_stripped_sql(h2_in)} END
       AS title FROM s"""


@case("html_title", _title_sql())
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", H.heading_title("html").alias("title"))


# The driver's pages have no status: every 7th failed, every 5th is unknown.
STATUS_SQL = "CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 5 = 0 THEN NULL ELSE 200 END"


def pages_with_status(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    status = F.when(n % 7 == 0, 404).when(n % 5 == 0, F.lit(None)).otherwise(200)
    return read(spark, d, "pages").withColumn("status", status.cast("int"))


@case("read_pages", f"""SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1) AS host,
CAST(length(html) AS INTEGER) AS n_chars FROM (SELECT *, {STATUS_SQL} AS status FROM pages)
WHERE status IS NULL OR status < 400""")
def read_pages(spark, d):
    pages = payloads.read_pages(pages_with_status(spark, d))
    return pages.select("page_id", "url", payloads.url_host("url").alias("host"), F.length("html").alias("n_chars"))


@case("source_order", f"""WITH {LINKS_SQL}
SELECT page_id, pos, CAST(CAST(page_id AS HUGEINT) * 1000000000000 + pos AS VARCHAR) AS src_pos FROM links""")
def source_order(spark, d):
    return links_df(spark, d).select("page_id", "pos", ordering.source_position("page_id", "pos").cast("string").alias("src_pos"))


CARDS_SQL = f"""
page_anchors AS (
  SELECT page_id, url, regexp_extract_all(v, {q(SQL_ANCHOR)}, 1) AS hs, regexp_extract_all(v, {q(SQL_ANCHOR)}, 2) AS ts
  FROM (SELECT page_id, url, {visible_sql('html')} AS v FROM pages)),
cards AS (
  SELECT page_id, CAST(i AS INTEGER) AS pos, {resolve_sql(unescape_sql(unquote_sql('hs[i + 1]')), 'url')} AS detail_url,
         {text_raw_sql('ts[i + 1]')} AS card_text
  FROM (SELECT page_id, url, hs, ts, unnest(range(len(hs))) AS i FROM page_anchors)),
first_cards AS (
  SELECT detail_url, page_id, pos, card_text FROM cards
  QUALIFY row_number() OVER (PARTITION BY detail_url ORDER BY page_id, pos) = 1)"""


def cards_df(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    a = pages.select("page_id", "url", F.posexplode(H.anchors("html")).alias("pos", "a"))
    return a.select(
        "page_id", "pos", H.resolve_url(F.col("a.href"), F.col("url")).alias("detail_url"),
        F.col("a.text").alias("card_text"),
    )


@case("first_card_per_url", f"WITH {CARDS_SQL} SELECT detail_url, page_id, pos FROM first_cards")
def first_card_per_url(spark, d):
    return windows.first_per_key(cards_df(spark, d).select("detail_url", "page_id", "pos"), ["detail_url"], ["page_id", "pos"])


@case("card_reject_anti", f"""WITH {CARDS_SQL}
SELECT detail_url, page_id, pos FROM first_cards WHERE NOT COALESCE(regexp_matches(card_text, {q(phrase_re2(CARD_PHRASES))}), false)""")
def card_reject_anti(spark, d):
    visited = joins.card_reject_anti(cards_df(spark, d), "detail_url", ("page_id", "pos"), "card_text", CARD_PHRASES)
    return visited.select("detail_url", "page_id", "pos")


@case("link_page_join", f"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, {STATUS_SQL} AS status FROM pages),
links AS (SELECT page_id AS referrer_id, 0 AS visit, url AS detail_url FROM p
  UNION ALL SELECT page_id, 1, url FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 2, url || '/missing' FROM p WHERE page_id % 5 = 0),
targets AS (SELECT url, min(page_id) AS page_id FROM p WHERE status IS NULL OR status < 400 GROUP BY url)
SELECT l.referrer_id, l.visit, l.detail_url, t.page_id, CASE WHEN t.page_id IS NULL THEN 'no_page' END AS reject_reason
FROM links l LEFT JOIN targets t ON l.detail_url = t.url""")
def link_page_join(spark, d):
    """Links that miss, repeat and hit failed pages; pages landed twice."""
    pages = pages_with_status(spark, d).select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "status")
    own = pages.select(F.col("page_id").alias("referrer_id"), F.lit(0).alias("visit"), F.col("url").alias("detail_url"))
    again = own.where(F.col("referrer_id") % 3 == 0).withColumn("visit", F.lit(1))
    missing = own.where(F.col("referrer_id") % 5 == 0).select(
        "referrer_id", F.lit(2).alias("visit"), F.concat("detail_url", F.lit("/missing")).alias("detail_url"))
    links = own.unionByName(again).unionByName(missing)
    landed = payloads.read_pages(pages).select("page_id", "url")
    landed = landed.unionByName(landed.where(F.col("page_id") % 4 == 0))
    j = joins.link_page_join(links, landed, order=("page_id",), how="left")
    return j.select("referrer_id", "visit", "detail_url", "page_id",
                    F.when(F.col("page_id").isNull(), F.lit("no_page")).alias("reject_reason"))


# --- DOM facts ---------------------------------------------------------------
# The oracle can use regexes because the driver's pages are flat: cards are the <li> nav items, each holding one
# link, and the one classed element is a <div class="ad"> holding text.

LI_INNER = r"(?is)<li\b[^>]*>(.*?)</li\s*>"
A_INNER = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
AD_INNER = r'(?is)<div\b[^>]*\bclass\s*=\s*"ad"[^>]*>(.*?)</div\s*>'

LI_SQL = f"""
lis AS (SELECT page_id, regexp_extract_all({visible_sql('html')}, {q(LI_INNER)}, 1) AS items FROM pages),
li AS (SELECT page_id, CAST(i AS INTEGER) AS pos, items[i + 1] AS li_html
       FROM (SELECT page_id, items, unnest(range(len(items))) AS i FROM lis))"""


def _facts(spark, d, **wanted):
    options = {"card_selectors": None, "attr_selectors": None, "class_patterns": {}} | wanted
    return html_facts.html_facts(read(spark, d, "pages"), detail_href=DETAIL_CI, scope_tags=("main",), **options)


@case("html_cards", f"""WITH {LI_SQL}
SELECT page_id, pos,
  list_filter(list_transform(regexp_extract_all(li_html, {q(SQL_HREF)}, 1), lambda h: {unescape_sql(unquote_sql('h'))}),
              lambda h: regexp_matches(h, {q('(?i)' + DETAIL_CI)}))[1] AS href,
  {text_raw_sql('li_html')} AS card_text FROM li""")
def html_cards(spark, d):
    facts = _facts(spark, d, card_selectors=[("article", r"listing|card"), ("li", None)])
    # posexplode would add a filter that computes the cards again
    cards = facts.select("page_id", F.posexplode_outer("cards").alias("pos", "card")).where("pos IS NOT NULL")
    return cards.select("page_id", "pos", F.col("card.href").alias("href"), F.col("card.text").alias("card_text"))


@case("html_first_by_class", f"""SELECT page_id,
  CASE WHEN regexp_matches(html, {q(AD_INNER)}) THEN {text_stripped_sql(f"regexp_extract(html, {q(AD_INNER)}, 1)")} END
  AS ad_text FROM pages""")
def html_first_by_class(spark, d):
    return _facts(spark, d, class_patterns={"ad_text": r"^ad$"}).select("page_id", "ad_text")


@case("html_attributes_map", f"""WITH {LI_SQL},
pairs AS (SELECT page_id, pos, {text_stripped_sql(f"regexp_extract(li_html, {q(A_INNER)}, 1)")} AS t
          FROM li WHERE regexp_matches(li_html, {q(A_INNER)})),
last AS (SELECT page_id, lower(t) AS label, t AS value FROM pairs
         QUALIFY row_number() OVER (PARTITION BY page_id, lower(t) ORDER BY pos DESC) = 1)
SELECT p.page_id, l.label, l.value FROM pages p LEFT JOIN last l ON p.page_id = l.page_id""")
def html_attributes_map(spark, d):
    # Each nav item is an attribute: its link text as label and value.
    facts = _facts(spark, d, attr_selectors=(("li", None), ("a", None), ("a", None)))
    return facts.select("page_id", F.explode_outer("attributes").alias("label", "value"))
