"""Filters and predicates.

Predicates are ``Column`` expressions so Catalyst can push the cheap ones
below joins and into the scan; the DataFrame-level helpers add the
reject reason instead of dropping rows when an audit is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.payload import is_object, truthy
from ..functions.text import col, left_chars, matches_any_phrase


def unavailable_in_scope(title: Column | str | None, scope_text: Column | str | None,
                         scope_chars: int | None = None,
                         patterns: Sequence[str] = K.UNAVAILABLE_PATTERNS) -> Column:
    """the title, or the first ``scope_chars`` characters of the scope text,
    says the listing is taken.  The window is the reference's rule (the
    part of the page a visitor reads first), not a cost cut."""
    tests = []
    if title is not None:
        tests.append(matches_any_phrase(title, patterns))
    if scope_text is not None:
        tests.append(matches_any_phrase(left_chars(scope_text, scope_chars), patterns))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def out_of_stock(availability: Column | str) -> Column:
    """the offer's availability text mentions ``OutOfStock``."""
    return F.coalesce(col(availability).contains("OutOfStock"), F.lit(False))


def offer_usable(offers: Column) -> Column:
    """F3 companion: ``offers`` (VARIANT) is an object or falsy.  Any other
    truthy value (a list, a string) made the reference drop the page."""
    return is_object(offers) | ~truthy(offers)


def not_sold(is_sold_or_rented: Column | str, is_rented: Column | str) -> Column:
    """keep unless either flag is truthy."""
    return ~F.coalesce(col(is_sold_or_rented).cast("boolean"), F.lit(False)) & ~F.coalesce(
        col(is_rented).cast("boolean"), F.lit(False)
    )


def area_code_match(postcode: Column | str, locality: Column | str,
                    postcodes: Sequence[str] = K.AREA_POSTCODES,
                    localities: Sequence[str] = K.AREA_LOCALITIES) -> Column:
    """postcode in the set, or the lower-cased locality in the set.

    The sets are literal-sized, so ``isin`` (an in-row hash set) is used; a
    set that grows with the data belongs in a ``left_semi`` join instead.
    """
    pc = F.coalesce(col(postcode).cast("string"), F.lit(""))
    loc = F.lower(F.coalesce(col(locality).cast("string"), F.lit("")))
    return pc.isin(*postcodes) | loc.isin(*localities)


def not_both_exceed(size: Column | str, price: Column | str,
                    max_size: float = K.MAX_SIZE_M2, max_price: float = K.MAX_PRICE) -> Column:
    """keep unless size > max_size AND price > max_price; unknown passes."""
    too_big = F.coalesce(col(size).cast("double") > max_size, F.lit(False))
    too_dear = F.coalesce(col(price).cast("double") > max_price, F.lit(False))
    return ~(too_big & too_dear)


def supply_category(href: Column | str, marker: str = K.CLASSIFIEDS_AD_MARKER,
                    categories: Sequence[str] = K.SUPPLY_CATEGORIES) -> Column:
    """F8: an ad link whose 4th '/' part is a supply category or empty."""
    h = col(href)
    category = F.coalesce(F.get(F.split(h, "/"), 3), F.lit(""))
    return h.contains(marker) & (category.isin(*categories) | (category == ""))


def detail_href(href: Column | str, pattern: str, case_insensitive: bool) -> Column:
    """the href is a detail link."""
    flags = "(?i)" if case_insensitive else ""
    return F.coalesce(col(href).rlike(flags + pattern), F.lit(False))


def drop_missing_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """items without an id are skipped."""
    return df.where(F.col(id_col).isNotNull())


def academic_year_filter(items: DataFrame, picked: DataFrame, request_col: str = "availability_id") -> DataFrame:
    """keep rows requested for the picked option; no option -> no filter.

    ``picked`` is the one-row result of ``aggregates.latest_year_option``.
    It is used as a scalar subquery, so the filter is a literal comparison
    per row (no join, no broadcast of a growing side).
    """
    chosen = picked.select("id").scalar()
    return items.where(chosen.isNull() | (F.col(request_col) == chosen))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """K4: the first failing check's reason, NULL when the row is kept."""
    expr = None
    for failed, reason in checks:
        expr = F.when(failed, F.lit(reason)) if expr is None else expr.when(failed, F.lit(reason))
    return expr
