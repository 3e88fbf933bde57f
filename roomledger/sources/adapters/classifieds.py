"""The classifieds site (source rank 2): static search pages with ad links,
detail pages with a JSON-LD offer, inline-script values and an attribute
list."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, html as H, numbers, payload as P, text
from ...operators import aggregates, filters, html_facts, joins, ordering, windows
from .. import payloads
from .common import LANDED, finish, first_landings, pages, staged

SOURCE = K.SOURCES[1]


def search_links(spark: SparkSession, root: str) -> DataFrame:
    """Ad links of the search pages that are read (W6), first position per page
    (A6); ``link_reason`` is set for ads of other categories."""
    # The pages are parsed once; the page log and the links read the stage.
    search = pages(spark, root, SOURCE, "search").select("page", "status", LANDED, H.anchor_hrefs("html").alias("hrefs"))
    search = first_landings(staged(search, "classifieds-links"), ["page"])
    ok = F.col("status").isNull() | (F.col("status") < 400)
    hrefs = F.col("hrefs")
    supply = F.filter(hrefs, lambda h: filters.supply_category(h))
    next_path = F.concat(F.lit(K.CLASSIFIEDS_NEXT_PAGE.split("{page}")[0]), (F.col("page") + 1).cast("string"),
                         F.lit(K.CLASSIFIEDS_NEXT_PAGE.split("{page}")[1]))
    has_next = F.exists(hrefs, lambda h: h.contains(next_path))
    log = search.select(
        F.lit(SOURCE).alias("src"), "page",
        (~ok | (F.size(supply) == 0)).alias("stop_before"),
        (ok & ~F.coalesce(has_next, F.lit(False))).alias("stop_after"),
    )
    last_page = windows.page_prefix(log, ["src"]).select("last_page").scalar()
    links = search.where(ok & (F.col("page") <= last_page)).select("page", F.posexplode(hrefs).alias("pos", "href"))
    links = links.where(F.col("href").contains(K.CLASSIFIEDS_AD_MARKER))
    links = aggregates.distinct_links(links.select("page", "href", "pos"), ["page"], "href", ["pos"])
    return links.select(
        ordering.source_position("page", "pos").alias("src_pos"), "page",
        F.when(~filters.supply_category("href"), F.lit("wrong_category")).alias("link_reason"),
        H.resolve_url("href", F.lit(K.CLASSIFIEDS_BASE)).alias("detail_url"),
    )


def detail_fields(spark: SparkSession, root: str) -> DataFrame:
    detail = payloads.read_pages(pages(spark, root, SOURCE, "detail")).select("url", "html", LANDED)
    ld = P.ld_offer_block("html")
    offers = P.vget(ld, "$.offers", "variant")
    d = detail.select(
        "url", "html", LANDED,
        F.coalesce(text.nonempty(P.vget(ld, "$.name", "string")), H.heading_title("html", ("h1",))).alias("title"),
        F.coalesce(P.vget(ld, "$.description", "string"), F.lit("")).alias("description"),
        offers.alias("offers"),
        P.value_text(P.vget(offers, "$.availability", "variant")).alias("availability"),
        P.value_text(P.vget(offers, "$.price", "variant")).alias("offer_price"),
        P.value_text(P.vget(ld, "$.floorSize", "variant")).alias("floor_size"),
        P.embedded_string("html", "cityName").alias("city"),
        P.embedded_integer("html", "priceCents").alias("price_cents"),
    )
    searchable = F.concat_ws(" ", F.coalesce("title", F.lit("")), "description", F.coalesce("city", F.lit("")))
    amount = numbers.parse_euro_amount(F.coalesce("offer_price", F.lit("")))
    reason = filters.first_reason(
        (~filters.offer_usable(F.col("offers")), "parse_error"),
        (amount.isNotNull() & amount.try_cast(numbers.PRICE_TYPE).isNull(), "parse_error"),
        (filters.out_of_stock("availability") | text.matches_any_phrase("title"), "unavailable"),
        (~text.area_text_match(searchable), "out_of_area"),
    )
    error = F.when(filters.offer_usable(F.col("offers")), F.lit("$.offers.price")).otherwise(F.lit("$.offers"))
    return d.withColumn("reject_reason", reason).withColumn("parse_error", error)


def build(spark: SparkSession, root: str, run_ts: dt.datetime) -> DataFrame:
    links = search_links(spark, root)
    details = detail_fields(spark, root).drop("offers").withColumn("_wanted", F.col("reject_reason").isNull())
    # The attribute list needs the page's tokens: only accepted pages are cut into them.
    d = html_facts.with_html_facts(details, "html", "_wanted", card_selectors=None, class_patterns={}).withColumn(
        "attr_size", F.try_element_at("attributes", F.lit(K.ATTR_SIZE_LABEL)))
    low = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("description")))
    floor_text = F.coalesce(text.nonempty("attr_size"), text.nonempty("floor_size"), F.lit(""))
    fields = d.select(
        "url", LANDED, "reject_reason", "parse_error", "title",
        F.to_json(F.struct("offer_price", "floor_size", "attr_size", "city", "availability")).alias("raw"),
        text.nonempty("city").alias("address"),
        text.nonempty("city").alias("neighborhood"),
        F.coalesce(numbers.parse_euro_amount(F.coalesce("offer_price", F.lit(""))).try_cast(numbers.PRICE_TYPE),
                   compose.price_from_cents("price_cents")).alias("price_eur_month"),
        F.coalesce(compose.size_from_attribute(floor_text), compose.size_from_text("description")).alias("size_m2"),
        text.classify_by_keywords(low, K.TYPE_RULES_CLASSIFIEDS).alias("listing_type"),
        *text.keyword_flags(low, K.KEYWORDS_CLASSIFIEDS),
        compose.available_from_text("description", K.AVAILABLE_CLASSIFIEDS_PATTERN).alias("available_from"),
    )
    # Each read link joins its landed detail page; a missing page leaves an audit row.
    j = joins.link_page_join(links, fields, "detail_url", "url", order=(LANDED,), how="left")
    reason = F.coalesce("link_reason", F.when(F.col("url").isNull(), F.lit("no_page")), "reject_reason")
    j = j.withColumn("reject_reason", reason).withColumn("url", F.coalesce("url", "detail_url"))
    return finish(j.drop("detail_url", "link_reason"), SOURCE, run_ts)
