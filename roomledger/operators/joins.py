"""Joins (J1-J5).

Equi-joins are left to Catalyst and AQE: both sides can grow with the
data, so no side is hinted to broadcast.  AQE converts a join to a
broadcast at runtime only when the measured side is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``, and splits skewed
partitions otherwise.  Enum maps and keyword lists are literal-sized and
stay inside expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import col, keyword_flags, matches_any_phrase
from .windows import first_per_key, first_with_flag


def first_landed(docs: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One landed document per key: the first by ``order`` (NULL last), then
    by content.  A crawl that meets a link twice lands its document twice."""
    missing = {f"_no_{c}": F.col(c).isNull() for c in order}
    places = [x for c in order for x in (f"_no_{c}", c)]
    return first_per_key(docs.withColumns(missing) if missing else docs, keys, places).drop(*missing)


def item_detail_join(items: DataFrame, details: DataFrame, key: str = "id", order: Sequence[str] = (),
                     how: str = "inner") -> DataFrame:
    """Search item x detail on id, one detail per id; items without a
    detail are dropped (``how="left"`` keeps them for the audit)."""
    return items.join(first_landed(details, [key], order), on=key, how=how)


def link_page_join(links: DataFrame, pages: DataFrame, link_url: str = "detail_url", page_url: str = "url",
                   order: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Resolved link x landed page on URL, one page per URL; missing or
    failed pages drop the link (``how="left"`` keeps it for the audit); a URL
    linked twice gives two rows."""
    first = first_landed(pages, [page_url], order)
    return links.join(first, links[link_url] == first[page_url], how)


def card_reject_anti(cards: DataFrame, url: str = "detail_url", order: Sequence[str] = ("page", "pos"),
                     text: str = "card_text", patterns: Sequence[str] = K.UNAVAILABLE_PATTERNS) -> DataFrame:
    """(url, position) of the URLs whose first-seen card does not say taken.

    Seen is marked before the check, so a later clean card of the same URL
    does not bring it back.  The text is tested in its row; positions alone
    are aggregated.
    """
    tested = cards.select(url, *order, matches_any_phrase(F.col(text), patterns).alias("_taken"))
    return first_with_flag(tested, [url], list(order), "_taken").where(~F.col("_taken")).drop("_taken")


def enum_lookup(code: Column | str, mapping: Mapping[int, str] = K.UNIT_TYPES) -> Column:
    """Int code -> label, unknown -> NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col(code).cast("int"))


def keyword_dim_join(df: DataFrame, text_lower: str, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """One nullable flag per feature of a (feature -> keywords) dictionary,
    as OR-chains of ``contains`` in the row: no join multiplies rows."""
    return df.select("*", *keyword_flags(F.col(text_lower), dictionary))
