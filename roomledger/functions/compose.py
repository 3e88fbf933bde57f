"""Field composition and fallbacks."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .html import strip_tags
from .numbers import trunc_int
from .text import capitalize, col, nonempty, py_strip


def _text(c: Column | str) -> Column:
    """``str(x or '')``: NULL -> ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def join_nonempty(sep: str, *parts: Column | str) -> Column:
    """``sep.join(p for p in parts if p)``; NULL when nothing is left."""
    return nonempty(F.concat_ws(sep, *[nonempty(col(p)) for p in parts]))


def street_line(street: Column | str, number: Column | str) -> Column:
    """``f"{street} {number}".strip()`` with '' for missing parts."""
    return py_strip(F.concat(_text(street), F.lit(" "), _text(number)))


def compose_address(street: Column | str, number: Column | str, city: Column | str,
                    postcode: Column | str | None = None) -> Column:
    """``street number, [zip ]city`` with empty parts left out."""
    place = _text(city) if postcode is None else py_strip(F.concat(_text(postcode), F.lit(" "), _text(city)))
    return join_nonempty(", ", street_line(street, number), place)


def last_address_part(address: Column | str) -> Column:
    """Last comma part (a newline counts as a comma) when there are two or more."""
    parts = F.split(F.replace(col(address), F.lit("\n"), F.lit(",")), ",")
    return F.when(F.size(parts) >= 2, nonempty(py_strip(F.element_at(parts, -1))))


def unit_title(listing_type: Column | str, address: Column | str, unit_number: Column | str) -> Column:
    """P14, unit API: ``type address`` plus `` (unit n)`` when a unit number exists."""
    base = F.coalesce(join_nonempty(" ", listing_type, address), F.lit(""))
    unit = nonempty(col(unit_number).cast("string"))
    return nonempty(F.when(unit.isNotNull(), F.concat(base, F.lit(" (unit "), unit, F.lit(")"))).otherwise(base))


def ad_title(property_title: Column | str, ad_title_: Column | str, listing_type: Column | str,
             address: Column | str) -> Column:
    """P14, search JSON: property title, else ad title, else ``type — address``."""
    return F.coalesce(nonempty(property_title), nonempty(ad_title_), join_nonempty(" — ", listing_type, address))


def type_label(subtype: Column | str, type_: Column | str) -> Column:
    """Subtype else type, '_' -> ' ', capitalised."""
    s = F.coalesce(nonempty(subtype), nonempty(type_))
    return capitalize(F.replace(s, F.lit("_"), F.lit(" ")))


def search_listing_url(url: Column | str, permalink: Column | str, type_: Column | str,
                       locality: Column | str, postcode: Column | str, ad_id: Column | str,
                       template: str = K.SEARCH_URL_TEMPLATE,
                       defaults: dict = K.SEARCH_URL_DEFAULTS) -> Column:
    """P11, search JSON: url, else permalink, else the URL pattern with defaults."""
    t = F.replace(F.lower(F.coalesce(nonempty(type_), F.lit(defaults["type"]))), F.lit("_"), F.lit("-"))
    loc = F.replace(F.lower(F.coalesce(nonempty(locality), F.lit(defaults["locality"]))), F.lit(" "), F.lit("-"))
    pc = F.coalesce(nonempty(col(postcode).cast("string")), F.lit(defaults["postcode"]))
    built = F.format_string(
        template.replace("{type}", "%1$s").replace("{locality}", "%2$s")
        .replace("{postcode}", "%3$s").replace("{id}", "%4$s"),
        t, loc, pc, _text(ad_id),
    )
    return F.coalesce(nonempty(url), nonempty(permalink), built)


def unit_listing_url(guid: Column | str, site: str = K.UNIT_SITE, path: str = K.UNIT_LISTING_PATH) -> Column:
    """P11, unit API: ``site/link/listing/<guid>``, else the site root."""
    g = nonempty(guid)
    return F.when(g.isNotNull(), F.concat(F.lit(site + path), g)).otherwise(F.lit(site))


def date_prefix(*candidates: Column | str) -> Column:
    """P17, structured sources: first truthy candidate, first 10 characters."""
    v = F.coalesce(*[nonempty(col(c).cast("string")) for c in candidates])
    return nonempty(F.substring(v, 1, 10))


def available_from_text(text: Column | str, pattern: str) -> Column:
    """P17, text sources: group 1 of a case-insensitive pattern, stripped."""
    java = "(?iU)" + pattern
    return nonempty(py_strip(F.regexp_extract(col(text), java, 1)))


def size_from_text(text: Column | str, pattern: str = K.SIZE_TEXT_PATTERN) -> Column:
    """Group 1 of the size pattern (case-insensitive) as a number.
    ``(?U)`` makes ``\\s`` match a no-break space, as Python's ``re`` does."""
    return nonempty(F.regexp_extract(col(text), "(?iU)" + pattern, 1)).try_cast("decimal(18,4)")


def size_from_attribute(attr: Column | str, pattern: str = K.SIZE_ATTR_PATTERN) -> Column:
    return nonempty(F.regexp_extract(col(attr), "(?U)" + pattern, 1)).try_cast("decimal(18,4)")


def euro_text_amount(text: Column | str) -> Column:
    """P15 text fallback: the amount after the first euro sign."""
    return F.regexp_extract(col(text), "(?U)" + K.EURO_TEXT_PATTERN, 1)


def price_from_cents(cents: Column | str) -> Column:
    return (col(cents).cast("decimal(38,0)") / F.lit(100)).try_cast("decimal(18,4)")


def description_text(blocks: Column | str, first: str = "property", second: str = "unit") -> Column:
    """``first + " " + second`` of every block, no separator between
    blocks, tags replaced by spaces, lower-cased."""
    joined = F.array_join(
        F.transform(
            F.coalesce(col(blocks), F.array()),
            lambda b: F.concat(_text(b[first]), F.lit(" "), _text(b[second])),
        ),
        "",
    )
    return F.lower(strip_tags(joined))


def run_timestamp(now: _dt.datetime | None = None) -> Column:
    """One literal per run, minute precision."""
    now = (now or _dt.datetime.now()).replace(second=0, microsecond=0)
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def search_ad_size(net: Column | str, living: Column | str, total: Column | str) -> Column:
    """P16 + C11 + C12: first truthy surface, truncated; none truthy -> unknown."""
    return trunc_int(F.coalesce(*[F.nullif(col(c), F.lit(0)) for c in (net, living, total)]))


def search_ad_price(rent: Column | str, txn_price: Column | str, ad_price: Column | str) -> Column:
    """P15 + C11 + C12: first truthy price, truncated; none truthy -> unknown."""
    return trunc_int(F.coalesce(*[F.nullif(col(c), F.lit(0)) for c in (rent, txn_price, ad_price)]))


def neighborhood_first(*candidates: Column | str) -> Column:
    """First non-empty candidate."""
    return F.coalesce(*[nonempty(c) for c in candidates])
