"""HTML extraction as native regex expressions.

Pages are scanned by Spark's own regex engine, per row, with no Python
and no shuffle.  What a DOM library does implicitly is spelled out:
comments and script/style/template bodies are not text, entities are
decoded once, and a scope ends at the end tag that belongs to it.  Every pattern
takes a page in one pass, whatever is left open in it.
"""

from __future__ import annotations

import json
from html import entities as html_entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS, col, py_strip

# Non-text blocks; each is replaced by an empty tag so that the text on
# either side stays two separate text nodes.  Each alternative takes all it
# has looked at, up to the end of the page if need be (as browsers do with a
# block that is never closed), so a page is passed over once.
NON_TEXT_BLOCKS = (
    r"(?is)<!--(?:-?>|.*?(?:-->|\z))"
    r"|<(script|style|template)(?=[\s/>])[^>]*+(?:\z|>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z))"
)
# In visible markup every "<" begins a tag; one that is cut off at the end of the page goes on to it.
TAG = r"<[^>]*+(?:>|\z)"
STRAY = r"<(?![A-Za-z/!?])"
ANCHOR = r"(?i)<a(?=[\s/>])[^>]*+(?:>|\z)"
ANCHOR_END = r"(?i)</a(?=[\s/>])[^>]*+(?:>|\z)"
HREF = r"""(?is)[\s"']href\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)"""

# Named character references: the HTML 5 table of the standard library.  The
# old names in it stand without a semicolon too.
NAMED_REFS = {f"&{name}": text for name, text in sorted(html_entities.html5.items())}
# Asked first: a map is searched entry by entry.
COMMON_NAMES = "amp lt gt quot nbsp copy reg middot euro eacute egrave euml iuml agrave ouml uuml szlig sup2".split()
COMMON_REFS = {f"&{name}{end}": html_entities.html5[name + ";"] for name in COMMON_NAMES for end in (";", "") if name + end in html_entities.html5}
OPEN_REFS = {name: text for name, text in NAMED_REFS.items() if not name.endswith(";")}
OPEN_LENGTHS = sorted({len(name) for name in OPEN_REFS}, reverse=True)
# By first letter, for the same reason.
REFS_BY_LETTER = {letter: {n: t for n, t in NAMED_REFS.items() if n[1] == letter} for letter in sorted({n[1] for n in NAMED_REFS})}
# Numeric references to the control block 0x80-0x9F mean Windows-1252.
CONTROL_REFS = {f"{b:02X}": bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}

# A text split into character references and everything else.
CHAR_REF_PARTS = r"&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
REPLACEMENT = "\ufffd"


def _map_literal(table: dict, kind: str = "map<string,string>") -> Column:
    """A table as one map literal: a single JSON string parsed by
    ``from_json``, which Catalyst folds into a constant (one expression,
    not thousands of literals)."""
    return F.from_json(F.lit(json.dumps(table)), kind)


def _numeric_ref(p: Column) -> Column:
    """The character of ``&#...`` / ``&#x...``; NULL for anything else.  Zero,
    surrogates and everything above 10FFFF become U+FFFD: the range is checked
    before the bytes are decoded, so no reference can fail a task."""
    hex_digits = F.regexp_extract(p, r"^&#[xX]0*([0-9A-Fa-f]+);?$", 1)
    digits = F.regexp_extract(p, r"^&#0*([0-9]+);?$", 1)
    code = F.when(p.rlike(r"^&#[xX]"), F.when(F.length(hex_digits) <= 6, F.upper(hex_digits))) \
        .when(p.startswith("&#"), F.when(F.length(digits) <= 7, F.conv(digits, 10, 16)))
    number = F.conv(code, 16, 10).try_cast("int")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    char = F.decode(F.try_to_binary(F.lpad(F.when(valid, code), 8, "0"), F.lit("hex")), "UTF-32")
    char = F.coalesce(F.try_element_at(_map_literal(CONTROL_REFS), code), char, F.lit(REPLACEMENT))
    return F.when(p.startswith("&#"), char)


def unescape(c: Column | str, skip_nbsp: bool = False) -> Column:
    """Decode character references once, in one left-to-right pass.

    Numeric references become the code point, named ones come from
    ``NAMED_REFS`` (an old name also where it begins a longer word), unknown
    names stay as written.  Texts without ``&`` are returned as they are,
    without splitting.  ``skip_nbsp`` keeps ``&nbsp;`` (for callers that
    decoded it already).
    """
    t = col(c)
    common, opened = _map_literal(COMMON_REFS), _map_literal(OPEN_REFS)
    names = _map_literal(REFS_BY_LETTER, "map<string,map<string,string>>")

    def one(p: Column) -> Column:
        exact = F.coalesce(F.try_element_at(common, p), F.try_element_at(F.try_element_at(names, F.substring(p, 2, 1)), p))
        if skip_nbsp:
            exact = F.when(p != "&nbsp;", exact)
        begun = [F.when(F.length(p) > n, F.concat(F.try_element_at(opened, F.substring(p, 1, n)), F.substring(p, n + 1, 1 << 30)))
                 for n in OPEN_LENGTHS]
        if skip_nbsp:
            begun = [F.when(p != "&nbsp;", b) for b in begun]
        # Plain-text parts (the long runs between references) skip all look-ups.
        return F.when(~p.startswith("&") | (F.length(p) < 3), p).otherwise(
            F.when(p.startswith("&#"), _numeric_ref(p)).otherwise(F.coalesce(exact, *begun, p)))

    parts = F.regexp_extract_all(t, F.lit(CHAR_REF_PARTS), 0)
    return F.when(t.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(t)


def visible_markup(html: Column | str) -> Column:
    """The page without comments and script/style/template bodies.  A "<"
    that begins no tag is text and is written as a reference."""
    return F.regexp_replace(F.regexp_replace(col(html), NON_TEXT_BLOCKS, "<x>"), STRAY, "&lt;")


def _visible(html: Column | str, cleaned: bool) -> Column:
    """``cleaned=True``: the input already went through ``visible_markup``
    (compute it once per page and pass it to every extractor)."""
    return col(html) if cleaned else visible_markup(html)


def strip_tags(html: Column | str) -> Column:
    """Every tag becomes one space (plain regex, no entity decoding).
    What follows the last ">" holds no tag and is not searched for one."""
    page = F.coalesce(col(html), F.lit(""))
    tail = F.when(page.contains(">"), F.substring_index(page, ">", -1)).otherwise(page)
    head = F.substring(page, F.lit(1), F.length(page) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"<[^>]+>", " "), tail)


# Stands for a tag between two steps; no text holds it (it is removed first).
MARK = "\u0000"


def _marked(html: Column | str, cleaned: bool) -> Column:
    """Visible markup with every tag replaced by one mark.  Runs of marks are
    then collapsed by a character class: a repeated group would take a stack
    frame per tag."""
    v = F.replace(_visible(html, cleaned), F.lit(MARK), F.lit(""))
    return F.regexp_replace(v, TAG, MARK)


def text_raw(html: Column | str, cleaned: bool = False) -> Column:
    """P3, ``get_text(" ")``: text nodes joined by one space, whitespace kept."""
    v = F.btrim(_marked(html, cleaned), F.lit(MARK))
    return unescape(F.regexp_replace(v, r"\x{00}++", " "))


def text_stripped(html: Column | str, cleaned: bool = False) -> Column:
    """P3, ``get_text(" ", strip=True)``: each text node stripped, empty ones
    dropped, the rest joined by one space."""
    v = F.replace(_marked(html, cleaned), F.lit("&nbsp;"), F.lit("\u00a0"))
    blank = WS_CLASS[1:-1]
    # marks and the white space after them, then the white space before them
    v = F.regexp_replace(v, rf"\x{{00}}[{blank}\x{{00}}]*+", MARK)
    v = F.regexp_replace(v, rf"(?<!{WS_CLASS}){WS_CLASS}++\x{{00}}", MARK)
    return unescape(py_strip(F.replace(v, F.lit(MARK), F.lit(" "))), skip_nbsp=True)


def _element(html: Column, tag: str) -> Column:
    """(inner) of the first element of this name, up to the end tag that
    belongs to it, or to the end of the page; NULL when there is none.  The
    markup is cut at the tags of this name, and one fold over those counts
    how deep they are nested."""
    pattern = rf"(?i)</?{tag}(?=[\s/>])[^>]*+(?:>|\z)"
    marks, parts = F.regexp_extract_all(html, F.lit(pattern), 0), F.split(html, pattern)

    def with_cuts(x: Column) -> Column:
        def step(state: Column, mark: Column) -> Column:
            opens = ~mark.startswith("</")
            depth = F.when(opens, state["depth"] + 1).otherwise(F.greatest(state["depth"] - 1, F.lit(0)))
            begun = F.coalesce(state["begin"], F.when(opens, state["i"]))
            ended = F.coalesce(state["end"], F.when(state["begin"].isNotNull() & (depth == 0), state["i"]))
            return F.struct((state["i"] + 1).alias("i"), depth.alias("depth"), begun.alias("begin"), ended.alias("end"))

        none = F.lit(None).cast("int")
        begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), none.alias("begin"), none.alias("end"))
        found = F.aggregate(x["marks"], begin, step)

        def inner(span: Column) -> Column:
            # the parts behind the opening tag, each with the mark before it but the first
            last = F.coalesce(span["end"], F.size(x["marks"]))
            between = F.concat(F.array(F.lit("")), F.slice(x["marks"], span["begin"] + 2, F.greatest(last - span["begin"] - 1, F.lit(0))))
            within = F.slice(x["parts"], span["begin"] + 2, last - span["begin"])
            return F.array_join(F.zip_with(between, within, lambda mark, part: F.concat(mark, part)), "")

        return F.transform(F.array(found), lambda span: F.when(span["begin"].isNotNull(), inner(span)))

    held = F.array(F.struct(marks.alias("marks"), parts.alias("parts")))
    return F.when(has_element(html, tag), F.element_at(F.element_at(F.transform(held, with_cuts), 1), 1))


def element_inner(html: Column | str, tag: str) -> Column:
    """Inner markup of the first ``<tag>`` element, nested ones counted; NULL
    when the page has none."""
    return _element(col(html), tag)


def has_element(html: Column | str, tag: str) -> Column:
    return col(html).rlike(rf"(?i)<{tag}(?=[\s/>])")


def main_scope(html: Column | str, tags: tuple[str, ...] = ("main", "article"), cleaned: bool = False) -> Column:
    """Markup of the first scope element that exists, else the page
    (visible markup: feed it to the extractors with ``cleaned=True``)."""
    v = _visible(html, cleaned)
    return F.coalesce(*[element_inner(v, t) for t in tags], v)


def scope_name(html: Column | str, tags: tuple[str, ...] = ("main", "article"), cleaned: bool = False) -> Column:
    v = _visible(html, cleaned)
    return F.coalesce(*[F.when(has_element(v, t), F.lit(t)) for t in tags], F.lit("page"))


def heading_title(html: Column | str, tags: tuple[str, ...] = ("h1", "h2"), cleaned: bool = False) -> Column:
    """P5: stripped text of the first ``<h1>``, else the first ``<h2>``; NULL if none."""
    return text_stripped(F.coalesce(*[element_inner(_visible(html, cleaned), t) for t in tags]), cleaned=True)


def unquote(c: Column) -> Column:
    quoted = c.startswith('"') | c.startswith("'")
    return F.when(quoted, F.substring(c, 2, F.length(c) - 2)).otherwise(c)


def anchor_hrefs(html: Column | str, cleaned: bool = False) -> Column:
    """``href`` of every ``<a>`` in page order (array of strings)."""
    tags = F.regexp_extract_all(_visible(html, cleaned), F.lit(ANCHOR), 0)
    raw = F.filter(F.transform(tags, lambda a: F.regexp_extract(a, HREF, 1)), lambda h: h != "")
    return F.transform(raw, lambda h: unescape(unquote(h)))


def anchors(html: Column | str, cleaned: bool = False) -> Column:
    """Every closed ``<a href>`` as ``struct(href, text)`` in page order: the
    page is cut at the end tags, and in each piece the first ``<a href>``
    begins the link."""
    pieces = F.split(_visible(html, cleaned), ANCHOR_END)
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def link(piece: Column) -> Column:
        tags = F.filter(F.regexp_extract_all(piece, F.lit(ANCHOR), 0), lambda a: F.regexp_extract(a, HREF, 1) != "")
        return F.transform(F.slice(tags, 1, 1), lambda a: F.struct(
            unescape(unquote(F.regexp_extract(a, HREF, 1))).alias("href"),
            text_raw(F.substring(piece, F.instr(piece, a) + F.length(a), F.length(piece)), cleaned=True).alias("text")))

    return F.flatten(F.transform(closed, link))


def _fold_dot_segments(segs: Column) -> Column:
    """``remove_dot_segments`` over path segments: ``.`` is dropped, ``..``
    pops the previous segment (never past the start), a final ``.``/``..``
    leaves a trailing slash; the path is rooted (``/`` when empty)."""
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.try_element_at(segs, F.lit(-1))
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    # Under a host the path always starts with '/'.
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """``urljoin(base, href)``: absolute and ``//`` hrefs as they are,
    ``?``/``#``/empty against the base, ``/`` and relative paths with their
    dot segments folded."""
    orig, b = col(href), col(base)
    # '//' with an empty authority: the rest is a path on the base's host.
    empty_authority = orig.rlike(r"^//([/?#]|$)")
    h = F.when(empty_authority, F.substring(orig, 3, 1 << 30)).otherwise(orig)
    scheme_re = r"^[A-Za-z][A-Za-z0-9+.\-]*"
    origin = F.regexp_extract(b, rf"({scheme_re}://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, rf"({scheme_re}):", 1)
    no_frag = F.regexp_extract(b, r"^([^#]*)", 1)
    no_query = F.regexp_extract(b, r"^([^?#]*)", 1)
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    # Relative: the base's directory segments, then the href's; empty middle segments dropped.
    b_parts = F.split(F.regexp_extract(b, rf"{scheme_re}://[^/?#]*([^?#]*)", 1), "/")
    b_dir = F.when(F.try_element_at(b_parts, F.lit(-1)) != "", F.slice(b_parts, 1, F.size(b_parts) - 1)).otherwise(b_parts)
    segs = F.concat(b_dir, F.split(h_path, "/"))
    segs = F.filter(segs, lambda s, i: (i == 0) | (i == F.size(segs) - 1) | (s != ""))
    return (
        F.when(orig == "", b)
        .when(h == "", no_frag)
        .when(h.rlike(scheme_re + ":"), h)
        .when(h.startswith("//") & ~empty_authority, F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(no_frag, h))
        .when(h.startswith("/"), F.concat(origin, _fold_dot_segments(F.split(h_path, "/")), h_rest))
        .otherwise(F.concat(origin, _fold_dot_segments(segs), h_rest))
    )


def strip_query(href: Column | str) -> Column:
    """P10: the part before the first '?'."""
    return F.substring_index(col(href), "?", 1)
