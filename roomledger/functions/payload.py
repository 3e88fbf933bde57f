"""JSON found inside pages: ``<pre>`` bodies, the ``__NEXT_DATA__`` script,
JSON-LD blocks and values in inline scripts (S4-S7).

Everything stays in the row: a page is cut at the end tags once, which gives
the pieces that can hold a block, whatever is left open in them; blocks are
parsed with ``try_parse_json`` into VARIANT, and the first block meeting a
predicate is picked with ``filter`` + ``try_element_at``.  Malformed JSON
gives NULL, never an error, and no page is exploded or shuffled to find its
block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col

# How the blocks begin and end in a page.
PRE_OPEN, PRE_CLOSE = r"(?i)<pre[^>]*+(?:>|\z)", "(?i)</pre>"
SCRIPT_CLOSE = "</script>"
LD_OPEN = '<script type="application/ld+json"'
NEXT_DATA_OPEN = '<script id="__NEXT_DATA__"'
TO_THE_END = (1 << 31) - 1  # a length; that of the text would have to be counted
# The names that the predicates on JSON-LD blocks (S6) look for.
LD_KEYS = ("offers", "@type", "address")


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` as the variable of a lambda.  The bodies of
    lambdas are evaluated as they stand: an expression that occurs in one
    four times is computed four times."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def closed_pieces(html: Column | str, end: str) -> Column:
    """The pieces of a page before each end tag: the first opening tag in a
    piece begins the block that ends there.  One pass, as each end tag is
    looked for once."""
    return computed_once(F.split(col(html), end),
                         lambda pieces: F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))))


def _blocks(pieces: Column, kind: str, opening: str) -> Column:
    """(kind, attrs, text) of the blocks that begin with ``opening`` (literal
    text up to the attributes that may follow)."""
    def rest(piece: Column) -> Column:
        return F.substring(piece, F.instr(piece, F.lit(opening)) + len(opening), F.lit(TO_THE_END))

    def block(rest: Column) -> Column:
        attrs = F.substring_index(rest, ">", 1)
        text = F.substring(rest, F.length(attrs) + 2, F.lit(TO_THE_END))
        return F.struct(F.lit(kind).alias("kind"), attrs.alias("attrs"), text.alias("text"))

    return F.transform(F.transform(F.filter(pieces, lambda p: p.contains(opening)), rest), block)


def script_blocks(html: Column | str) -> Column:
    """The block table of a page: array of (kind, attrs, text) of its JSON-LD
    and ``__NEXT_DATA__`` scripts, which S5 and S6 read.  Compute it once per
    page and pass it on as ``blocks``."""
    return computed_once(closed_pieces(html, SCRIPT_CLOSE),
                         lambda pieces: F.concat(_blocks(pieces, "ld", LD_OPEN), _blocks(pieces, "next", NEXT_DATA_OPEN)))


def parse_json(text: Column | str) -> Column:
    return F.try_parse_json(col(text))


def json_in_pre(html: Column | str) -> Column:
    """JSON of the first ``<pre>``; NULL when absent or malformed."""
    pieces = F.filter(closed_pieces(html, PRE_CLOSE), lambda p: p.rlike(PRE_OPEN))
    return parse_json(F.try_element_at(F.split(F.try_element_at(pieces, F.lit(1)), PRE_OPEN, 2), F.lit(2)))


def vget(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def variant_list(v: Column, path: str = "$") -> Column:
    """The value at ``path`` as ``array<variant>`` when it is a list, else NULL."""
    return vget(v, path, "array<variant>")


def next_data_list(html: Column | str, blocks: Column | None = None) -> Column:
    """The first of ``props.pageProps.classifiedList`` / ``.results`` that is a list."""
    found = F.filter(script_blocks(html) if blocks is None else blocks, lambda b: b["kind"] == "next")
    nxt = parse_json(F.try_element_at(found, F.lit(1))["text"])
    return F.coalesce(
        variant_list(nxt, "$.props.pageProps.classifiedList"),
        variant_list(nxt, "$.props.pageProps.results"),
    )


def search_payload(html: Column | str) -> Column:
    """S4 then S5: ``struct(found, total_items, ads)`` of a search-result page.

    ``found`` is False when neither JSON exists (the page "did not work");
    ``ads`` is ``results`` or ``classifiedList`` when non-empty, else ``[]``.
    """
    pre = json_in_pre(html)
    fallback = next_data_list(html)
    empty = F.array().cast("array<variant>")

    def nonempty_list(lst: Column) -> Column:
        return F.when(F.size(lst) > 0, lst)

    pre_ads = F.coalesce(
        nonempty_list(variant_list(pre, "$.results")),
        nonempty_list(variant_list(pre, "$.classifiedList")),
        empty,
    )
    ads = F.when(pre.isNotNull(), pre_ads).otherwise(F.coalesce(nonempty_list(fallback), empty))
    # A missing ``totalItems`` counts as 0 (the fallback payload never has one);
    # JSON null or a non-number is unknown (NULL), which pages use a default for.
    tv = vget(pre, "$.totalItems", "variant")
    total = (F.when(tv.isNull(), F.lit(0).cast("bigint"))
             .when(F.is_variant_null(tv), F.lit(None).cast("bigint"))
             .otherwise(vget(tv, "$", "bigint")))
    return F.struct(
        (pre.isNotNull() | fallback.isNotNull()).alias("found"),
        total.alias("total_items"),
        ads.alias("ads"),
    )


def _mentions(text: Column, keys: Sequence[str]) -> Column:
    """The text may hold one of the keys: as a quoted name, or escaped
    (``"\\u006fffers"`` is the same key after parsing), which takes a backslash."""
    out = text.contains("\\")
    for k in keys:
        out = out | text.contains(f'"{k}"')
    return out


def parsed_blocks(blocks: Column, keys: Sequence[str] = LD_KEYS) -> Column:
    """The JSON-LD blocks of a block table, parsed: array of (attrs, json) of
    those that mention one of ``keys``.  Where several predicates look at a
    page, compute it once and pass it on as ``parsed``: a block is then
    parsed once and not for each of them."""
    found = F.filter(blocks, lambda b: (b["kind"] == "ld") & _mentions(b["text"], keys))
    return F.transform(found, lambda b: F.struct(b["attrs"].alias("attrs"), F.try_parse_json(b["text"]).alias("json")))


def jsonld_blocks(html: Column | str, allow_attrs: bool = False, keys: Sequence[str] = (), blocks: Column | None = None,
                  parsed: Column | None = None) -> Column:
    """JSON-LD blocks in page order, parsed (malformed -> NULL element).

    With ``keys``, only blocks whose text mentions one of them as a quoted
    name are parsed: a block without it cannot match a predicate on that
    key.  A block with any backslash is always parsed, since an escaped name
    is the same key after parsing.  ``parsed`` blocks are not tested again.
    """
    def of_attrs(b: Column) -> Column:
        return F.lit(True) if allow_attrs else b["attrs"] == ""

    if parsed is not None:
        return F.transform(F.filter(parsed, of_attrs), lambda b: b["json"])

    def wanted(b: Column) -> Column:
        return (b["kind"] == "ld") & (_mentions(b["text"], keys) if keys else F.lit(True)) & of_attrs(b)

    found = F.filter(script_blocks(html) if blocks is None else blocks, wanted)
    return F.transform(found, lambda b: F.try_parse_json(b["text"]))


def flatten_lists(blocks: Column) -> Column:
    """A block that is a list contributes its elements, any other block itself."""
    return F.flatten(F.transform(blocks, lambda v: F.coalesce(variant_list(v), F.array(v))))


def is_object(v: Column) -> Column:
    """The value is a JSON object.  Casting to an empty struct succeeds only
    for objects and does not walk the value (``schema_of_variant`` would)."""
    return F.coalesce(vget(v, "$", "struct<>").isNotNull(), F.lit(False))


def members(v: Column, **types: str) -> Column:
    """Struct of the named members of an object, NULL where one is missing;
    NULL for what is no object.  One pass over its names; a path that is
    missing costs far more, as Spark leaves the search by an exception."""
    return vget(v, "$", "struct<" + ",".join(f"`{name}`:{typ}" for name, typ in types.items()) + ">")


def has_key(v: Column, key: str) -> Column:
    return members(v, **{key: "variant"})[key].isNotNull()


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value (missing -> False).  Containers are
    tested by their size; only scalars reach ``schema_of_variant``, where it
    is constant-time."""
    lst = variant_list(v)
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(is_object(v), F.size(vget(v, "$", "map<string,variant>")) > 0)
        .when(lst.isNotNull(), F.size(lst) > 0)
        .when(kind == "BOOLEAN", vget(v, "$", "boolean"))
        .when(kind == "STRING", vget(v, "$", "string") != "")
        .otherwise(vget(v, "$", "double") != 0),
        F.lit(False),
    )


def first_wrong_shape(v: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    """Value or error: the first of the (path, "object" | "list" | "number")
    whose value is given but is no such thing; NULL when all can be read.  A
    value that is false (missing, null, empty, zero) counts as not given."""
    def wrong(path: str, kind: str) -> Column:
        value = vget(v, path, "variant")
        fits = {"object": is_object(value), "list": variant_list(value).isNotNull(), "number": vget(value, "$", "double").isNotNull()}[kind]
        return F.when(value.isNotNull() & ~fits & truthy(value), F.lit(path))

    return F.coalesce(*[wrong(path, kind) for path, kind in shapes])


def first_match(elements: Column, predicate: Callable[[Column], Column]) -> Column:
    """The first element meeting the predicate, NULL if none."""
    return F.try_element_at(F.filter(elements, lambda v: F.coalesce(predicate(v), F.lit(False))), F.lit(1))


def ld_offer_block(html: Column | str, blocks: Column | None = None, parsed: Column | None = None) -> Column:
    """S6, classifieds: first top-level object that has an ``offers`` key (lists rejected)."""
    return first_match(jsonld_blocks(html, keys=("offers",), blocks=blocks, parsed=parsed), lambda v: has_key(v, "offers"))


def ld_typed_block(html: Column | str, types: Sequence[str] = K.JSONLD_TYPES, blocks: Column | None = None,
                   parsed: Column | None = None) -> Column:
    """S6, rental pages: first object (lists flattened) whose ``@type`` is in ``types``."""
    return first_match(
        flatten_lists(jsonld_blocks(html, keys=("@type",), blocks=blocks, parsed=parsed)),
        lambda v: members(v, **{"@type": "string"})["@type"].isin(*types),
    )


def ld_offer_or_address_block(html: Column | str, blocks: Column | None = None, parsed: Column | None = None) -> Column:
    """S6, JS pages: first object (lists flattened) with a truthy ``offers`` or ``address``."""
    objects = F.transform(
        flatten_lists(jsonld_blocks(html, allow_attrs=True, keys=("offers", "address"), blocks=blocks, parsed=parsed)),
        lambda v: F.struct(v.alias("value"), members(v, offers="variant", address="variant").alias("has")),
    )
    return first_match(objects, lambda o: truthy(o["has"]["offers"]) | truthy(o["has"]["address"]))["value"]


def embedded_string(html: Column | str, key: str) -> Column:
    """``"key":"value"`` in an inline script; NULL if absent."""
    return F.nullif(F.regexp_extract(col(html), K.EMBEDDED_STRING.replace("{key}", key), 1), F.lit(""))


def embedded_integer(html: Column | str, key: str) -> Column:
    """``"key": 123`` in an inline script; NULL if absent."""
    return F.nullif(F.regexp_extract(col(html), K.EMBEDDED_INTEGER.replace("{key}", key), 1), F.lit("")).try_cast("bigint")


def value_text(v: Column) -> Column:
    """``str(x or "")`` of a JSON scalar: numbers and strings as text, else NULL."""
    return F.when(truthy(v), vget(v, "$", "string"))
