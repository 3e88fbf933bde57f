"""DOM facts (P6-P8): result cards, the first element whose class matches a
pattern, and label/value attribute lists, as native expressions.

A page is cut into tokens (tags and text) once.  One fold over the tags then
keeps the open elements as a stack and yields, for every opening tag, its
end, its parent and how many tags it holds (``elements``); everything else is
a slice or a look-up by number.  An end tag closes the nearest open element of
its name and all that is open inside it, and is ignored when there is none.
Elements whose end tag may be left out (list items, table cells, paragraphs,
...) also end where HTML implies it.  An element that is never closed goes on
to the end of what it lies in.  Everything happens inside the row: no
shuffle, no Python, no recursion, and work in proportion to the page.

The stack is a string of which a step sees the last ``WINDOW`` characters or
more, so it costs the same however deep the page is.  An end tag, stated or
implied, thus reaches over some hundreds of open elements, which is the depth
at which browsers stop nesting too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import html as H
from ..functions.text import WS_CLASS, col, py_strip

VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()

# tag -> (opening tags that end it, containers within which they do not)
_BLOCKS = (
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul"
).split()
ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "tr": (["tr"], ["table"]),
    "td": (["td", "th", "tr"], ["table"]),
    "th": (["td", "th", "tr"], ["table"]),
    "option": (["option"], ["select"]),
    "p": (_BLOCKS, []),
}

OPEN, TEXT, CLOSE, OTHER = 1, 0, -1, 2

Selector = tuple[str | None, str | None]  # (tag or None for any, class pattern or None for any)

# Marks between the parts of the fold's strings; tag names lose them.
ENTRY, PART, AT, EVENT = "\u0001", "\u0002", "\u0003", "\u0004"
WINDOW = 8_000  # characters of the stack that a block of tags can reach, at least
BLOCK = 256


def tokens(html: Column | str) -> Column:
    """Visible markup as an array of (at, kind, name, raw)."""
    raw = F.regexp_extract_all(H.visible_markup(html), F.lit(rf"{H.TAG}|[^<]++"), 0)

    def token(t: Column, i: Column) -> Column:
        name = F.translate(F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1)), ENTRY + PART + AT + EVENT, "")
        kind = F.when(~t.startswith("<"), F.lit(TEXT)).when(~t.rlike("^</?[A-Za-z]"), F.lit(OTHER)) \
            .when(t.startswith("</"), F.lit(CLOSE)).otherwise(F.lit(OPEN))
        name = F.when(t.startswith("<"), name).otherwise(F.lit(""))
        return F.struct(i.alias("at"), kind.alias("kind"), name.alias("name"), t.alias("raw"))

    return F.transform(raw, token)


def _attribute(raw: Column, name: str) -> Column:
    """The value of an attribute of a tag as written; NULL when it has none."""
    value = F.regexp_extract(raw, rf"""(?is)\s{name}\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)""", 1)
    return F.when(value != "", H.unquote(value))


def _matches(element: Column, tag: str | None, class_pattern: str | None, ignore_case: bool) -> Column:
    """An element of the kind asked for: the pattern is found in one of the
    classes or in the whole class value."""
    out = F.lit(True) if tag is None else element["name"] == tag
    if class_pattern is not None:
        value = _attribute(element["raw"], "class")
        pattern = ("(?i)" if ignore_case else "") + class_pattern
        parts = F.split(value, f"{WS_CLASS}+")
        out = out & F.coalesce(value.rlike(pattern) | F.exists(parts, lambda p: p.rlike(pattern)), F.lit(False))
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside it is a variable,
    not another copy of its expression.  A fold over nothing hands the value
    on as it is, where a one-element ``transform`` would copy it deeply."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


# --- the element index --------------------------------------------------------


def _last(stack: Column, names: Column | Sequence[str]) -> Column:
    """Where the last entry of one of the names begins; -1 when there is none."""
    def one(name: Column | str) -> Column:
        mark = F.concat(F.lit(ENTRY), name if isinstance(name, Column) else F.lit(name), F.lit(PART))
        return F.when(F.instr(stack, mark) > 0, F.length(stack) - F.length(F.call_function("substring_index", stack, mark, F.lit(-1))) - F.length(mark)).otherwise(F.lit(-1))

    found = [one(names)] if isinstance(names, Column) else [one(n) for n in names]
    return found[0] if len(found) == 1 else F.greatest(*found)


def _first(stack: Column, names: Sequence[str], after: Column) -> Column:
    """Of the last entries of each name those above ``after``: the outermost."""
    found = [F.when(_last(stack, [n]) > after, _last(stack, [n])) for n in names]
    return F.coalesce(found[0] if len(found) == 1 else F.least(*found), F.lit(-1))


def _implied_end(stack: Column, name: Column) -> Column:
    """Where the element begins that an opening tag of this name ends."""
    out = F.lit(-1)
    by_rule: dict[tuple, list[str]] = {}
    for opening in sorted({x for ended_by, _ in ENDS.values() for x in ended_by}):
        victims = tuple(tag for tag, (ended_by, _) in ENDS.items() if opening in ended_by)
        containers = tuple(sorted({c for tag in victims for c in ENDS[tag][1]}))
        by_rule.setdefault((victims, containers), []).append(opening)
    for (victims, containers), openings in by_rule.items():
        barrier = _last(stack, containers) if containers else F.lit(-1)
        out = F.when(name.isin(openings), _first(stack, victims, barrier)).otherwise(out)
    return out


def _step(state: Column, tag: Column) -> Column:
    """One tag: what it ends goes from the stack to the events, what it opens
    goes on the stack."""
    opens, at, name, n = tag["kind"] == OPEN, tag["at"], tag["name"], state["n"]
    stack = state["top"]

    def with_cut(keep: Column) -> Column:
        kept = F.when(keep >= 0, F.substring(stack, F.lit(1), keep)).otherwise(stack)
        ended = F.when(keep >= 0, F.concat(F.substring(stack, keep + 1, F.length(stack)), F.lit(AT), at.cast("string"), F.lit(AT), n.cast("string"),
                                           F.lit(EVENT))).otherwise(F.lit(""))
        around = F.substring_index(kept, ENTRY, -1)
        parent = F.when(around == "", F.lit("-1")).otherwise(F.substring_index(F.substring_index(around, PART, 2), PART, -1))
        entry = F.concat(F.lit(ENTRY), name, F.lit(PART), n.cast("string"), F.lit(PART), parent)
        alone = F.concat(entry, F.lit(AT), (at + 1).cast("string"), F.lit(AT), (n + 1).cast("string"), F.lit(EVENT))
        empty = name.isin(VOID_TAGS) | tag["raw"].endswith("/>")
        return F.struct(
            F.when(opens & ~empty, F.concat(kept, entry)).otherwise(kept).alias("top"),
            F.concat(state["events"], ended, F.when(opens & empty, alone).otherwise(F.lit(""))).alias("events"),
            (n + opens.cast("int")).alias("n"))

    return _let(F.when(opens, _implied_end(stack, name)).otherwise(_last(stack, name)), with_cut)


def _block_step(state: Column, block: Column) -> Column:
    """One block of tags.  Spark copies the state of a fold at every step, so
    the steps of a block see a bounded part of the stack and their own events."""
    rest = state["rest"]

    def with_block(x: Column) -> Column:
        top, size = x["top"], F.length(x["top"])
        long, short = size > 2 * WINDOW, (size < WINDOW) & (F.size(rest) > 0)
        cut = F.call_function("locate", F.lit(ENTRY), top, size - WINDOW + 1)
        return F.struct(
            F.when(long, F.substring(top, cut, size)).when(short, F.concat(F.try_element_at(rest, F.lit(-1)), top)).otherwise(top).alias("top"),
            F.when(long, F.concat(rest, F.array(F.substring(top, F.lit(1), cut - 1))))
            .when(short, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest).alias("rest"),
            F.concat(state["done"], F.array(x["events"])).alias("done"), x["n"].alias("n"))

    begin = F.struct(state["top"].alias("top"), F.lit("").alias("events"), state["n"].alias("n"))
    return _let(F.aggregate(block, begin, _step), with_block)


def elements(all_tokens: Column) -> Column:
    """One entry per opening tag, in page order: (at, name, raw, n, end,
    until, parent).  ``n`` is its number; the element ends before token
    ``end`` and holds the elements after it up to number ``until``;
    ``parent`` is the number of the element around it, -1 for the page."""
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit("").alias("top"), none.alias("rest"), none.alias("done"), F.lit(0).alias("n"))
    tags = F.filter(all_tokens, lambda t: t["kind"].isin(OPEN, CLOSE))

    def blocks(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda first: F.slice(held, first, F.lit(BLOCK)))

    def finish(state: Column) -> Column:
        left = F.concat(F.array_join(state["rest"], ""), state["top"])
        last = F.when(left != "", F.concat(left, F.lit(AT), F.size(all_tokens).cast("string"), F.lit(AT), state["n"].cast("string")))
        return F.concat(F.array_join(state["done"], ""), F.coalesce(last, F.lit("")))

    def ended(event: Column) -> Column:
        parts = F.split(event, AT)

        def with_parts(x: Column) -> Column:
            def one(e: Column) -> Column:
                entry = F.split(e, PART)
                return F.struct(entry[1].cast("int").alias("n"), x[1].cast("int").alias("end"), x[2].cast("int").alias("until"),
                                entry[2].cast("int").alias("parent"))

            return F.transform(F.split(F.substring(x[0], 2, 1 << 30), ENTRY), one)

        return _let(parts, with_parts)

    events = F.filter(F.split(F.aggregate(_let(tags, blocks), begin, _block_step, finish), EVENT), lambda e: e != "")
    ends = F.sort_array(F.flatten(F.transform(events, ended)))
    opening = F.filter(all_tokens, lambda t: t["kind"] == OPEN)

    def element(t: Column, e: Column) -> Column:
        return F.struct(t["at"].alias("at"), t["name"].alias("name"), t["raw"].alias("raw"), e["n"].alias("n"), e["end"].alias("end"),
                        e["until"].alias("until"), e["parent"].alias("parent"))

    return F.zip_with(opening, ends, element)


def _range(items: Column, first: Column, count: Column) -> Column:
    """``count`` items from number ``first`` (1-based) on, each fetched by its
    number: a slice would convert the whole array."""
    numbers = F.filter(F.sequence(first, F.greatest(first, first + count - 1)), lambda i: i < first + count)
    return F.transform(numbers, lambda i: F.element_at(items, i))


def _inner(all_tokens: Column, element: Column) -> Column:
    """The tokens inside the element."""
    return _range(all_tokens, element["at"] + 2, element["end"] - element["at"] - 1)


def _inside(all_elements: Column, element: Column) -> Column:
    """The elements inside the element."""
    return _range(all_elements, element["n"] + 2, element["until"] - element["n"] - 1)


# --- facts --------------------------------------------------------------------


def _strings(inner: Column) -> Column:
    return F.transform(F.filter(inner, lambda t: t["kind"] == TEXT), lambda t: t["raw"])


def inner_text(inner: Column) -> Column:
    """Text nodes joined by one space."""
    return H.unescape(F.array_join(_strings(inner), " "))


def inner_text_stripped(inner: Column) -> Column:
    """Each text node stripped, empty ones dropped, the rest joined by one space."""
    stripped = F.transform(_strings(inner), lambda s: py_strip(F.replace(s, F.lit("&nbsp;"), F.lit("\u00a0"))))
    return H.unescape(F.array_join(F.filter(stripped, lambda s: s != ""), " "))


def _chosen(found: Column, tag: str | None, class_pattern: str | None, ignore_case: bool = True) -> Column:
    return F.filter(found, lambda e: _matches(e, tag, class_pattern, ignore_case))


def _detail_links(found: Column, pattern: str) -> Column:
    return F.filter(found, lambda e: (e["name"] == "a") & F.coalesce(_attribute(e["raw"], "href").rlike(pattern), F.lit(False)))


def cards(all_tokens: Column, all_elements: Column, selectors: Sequence[Selector], detail_href: str, case_insensitive: bool) -> Column:
    """(href, text) of the elements of the first selector that finds any,
    else of the elements around the detail links (one around several links is
    one card: its first link names it)."""
    pattern = ("(?i)" if case_insensitive else "") + detail_href
    page = F.struct(F.lit(-1).alias("at"), F.lit("").alias("name"), F.lit("").alias("raw"), F.lit(-1).alias("n"), F.size(all_tokens).alias("end"),
                    F.size(all_elements).alias("until"), F.lit(-1).alias("parent"))
    around = F.array_distinct(F.transform(_detail_links(all_elements, pattern), lambda a: a["parent"]))
    found = F.transform(around, lambda n: F.when(n < 0, page).otherwise(F.element_at(all_elements, F.greatest(n, F.lit(0)) + 1)))
    for tag, class_pattern in reversed(list(selectors)):
        chosen = _chosen(all_elements, tag, class_pattern)
        found = F.coalesce(F.nullif(chosen, F.slice(all_elements, 1, 0)), found)

    def card(e: Column) -> Column:
        links = _detail_links(_inside(all_elements, e), pattern)
        href = F.try_element_at(F.transform(F.slice(links, 1, 1), lambda a: H.unescape(_attribute(a["raw"], "href"))), F.lit(1))
        return F.struct(href.alias("href"), inner_text(_inner(all_tokens, e)).alias("text"))

    return F.transform(found, card)


def first_by_class(all_tokens: Column, all_elements: Column, pattern: str, scope_tags: Sequence[str]) -> Column:
    """Stripped text of the first element of the scope whose class matches."""
    scope = all_elements
    for tag in reversed(list(scope_tags)):
        inside = F.transform(F.slice(_chosen(all_elements, tag, None), 1, 1), lambda e: _inside(all_elements, e))
        scope = F.coalesce(F.try_element_at(inside, F.lit(1)), scope)
    first = F.slice(_chosen(scope, None, pattern), 1, 1)
    return F.try_element_at(F.transform(first, lambda e: inner_text_stripped(_inner(all_tokens, e))), F.lit(1))


def attribute_pairs(all_tokens: Column, all_elements: Column, selectors: tuple[Selector, Selector, Selector]) -> Column:
    """(label, value) of every item that holds both, label lower-cased.
    Classes match case-sensitively here; cards and classed elements ignore case."""
    item, label, value = selectors

    def pair(inside: Column) -> Column:
        text = []
        for tag, pattern in (label, value):
            first = F.slice(_chosen(inside, tag, pattern, False), 1, 1)
            text.append(F.try_element_at(F.transform(first, lambda e: inner_text_stripped(_inner(all_tokens, e))), F.lit(1)))
        return F.struct(F.lower(text[0]).alias("k"), text[1].alias("v"))

    items = F.transform(_chosen(all_elements, item[0], item[1], False), lambda e: _inside(all_elements, e))
    return F.filter(F.transform(items, pair), lambda p: p["k"].isNotNull() & p["v"].isNotNull())


def with_html_facts(df: DataFrame, html: str = "html", wanted: str | None = None,
                    card_selectors: Sequence[Selector] | None = K.CARD_SELECTORS,
                    detail_href: str = K.RENTALS_DETAIL_HREF, detail_case_insensitive: bool = True,
                    class_patterns: Mapping[str, str] | None = None,
                    scope_tags: Sequence[str] = ("main", "article"),
                    attr_selectors: tuple[Selector, Selector, Selector] | None = (
                        (None, K.ATTR_ITEM_CLASS), (None, K.ATTR_LABEL_CLASS), (None, K.ATTR_VALUE_CLASS)),
                    ) -> DataFrame:
    """P6-P8 next to the rows' other columns.

    Every column but ``html`` passes through; a page is tokenised only when
    the boolean column ``wanted`` is true (all rows when None).  Adds
    ``cards`` (array of (href, text)), one column per class pattern, and
    ``attributes`` (map, last label wins); ``card_selectors`` and
    ``attr_selectors`` of None leave theirs out.

    All facts of a page are one expression with its tokens and elements as
    variables: were they columns, a filter on a fact that Catalyst pushes down
    would put their whole computation in the place of every reference.
    """
    if class_patterns is None:
        class_patterns = {"price_text": K.PRICE_CLASS_PATTERN, "address_text": K.ADDRESS_CLASS_PATTERN}
    keep = [c for c in df.columns if c != html]
    page = F.coalesce(col(html), F.lit(""))
    if wanted is not None:
        page = F.when(F.coalesce(F.col(wanted), F.lit(False)), page)

    def facts(all_tokens: Column, all_elements: Column) -> Column:
        out = [first_by_class(all_tokens, all_elements, pattern, scope_tags).alias(name) for name, pattern in class_patterns.items()]
        if card_selectors is not None:
            out.append(cards(all_tokens, all_elements, card_selectors, detail_href, detail_case_insensitive).alias("cards"))
        if attr_selectors is not None:
            out.append(last_wins_map(attribute_pairs(all_tokens, all_elements, attr_selectors)).alias("attributes"))
        return F.struct(*out)

    found = _let(tokens(page), lambda t: _let(elements(t), lambda e: facts(t, e)))
    if wanted is not None:
        found = F.when(page.isNotNull(), found)
    names = [*(["cards"] if card_selectors is not None else []), *class_patterns, *(["attributes"] if attr_selectors is not None else [])]
    return df.select(*keep, found.alias("_facts")).select(*keep, *[F.col(f"_facts.{n}").alias(n) for n in names])


def html_facts(pages: DataFrame, key: str = "page_id", html: str = "html", **options) -> DataFrame:
    """P6-P8 for every page of ``(key, html)``; see ``with_html_facts``."""
    return with_html_facts(pages.select(key, html), html=html, **options)


def last_wins_map(pairs: Column) -> Column:
    """Pairs (k, v) -> map where a repeated key keeps its last value,
    independent of the session's ``mapKeyDedupPolicy``."""
    placed = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("key"), (-i).alias("before"), p["v"].alias("value"))))

    def last(found: Column) -> Column:
        return F.filter(found, lambda p, i: (i == 0) | (p["key"] != F.element_at(found, F.greatest(i, F.lit(1)))["key"]))

    return F.map_from_entries(F.transform(_let(placed, last), lambda p: F.struct(p["key"], p["value"])))
