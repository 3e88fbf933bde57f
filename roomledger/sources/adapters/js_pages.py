"""The JS-rendered site (source rank 5): candidate search pages with detail
links, detail pages with JSON-LD and free text.  The first candidate that
yields at least one listing wins (W3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, html as H, numbers, payload as P, text
from ...operators import aggregates, filters, joins, ordering, windows
from .common import LANDED, finish, first_landings, pages, staged

SOURCE = K.SOURCES[4]


def candidate_links(spark: SparkSession, root: str) -> DataFrame:
    search = pages(spark, root, SOURCE, "search").select("candidate", "page", LANDED, H.anchor_hrefs("html").alias("hrefs"))
    search = first_landings(staged(search, "js-links"), ["candidate", "page"])
    links = search.select("candidate", "page", F.posexplode("hrefs").alias("pos", "href"))
    links = links.withColumn("href", H.strip_query("href")).where(filters.detail_href("href", K.JSPAGES_DETAIL_HREF, False))
    first = aggregates.distinct_links(links, ["candidate"], "href", ["page", "pos"])
    # Candidates are read one after another: their pages come first in discovery order.
    return first.select("candidate", "page", ordering.source_position("candidate", "page", "pos").alias("src_pos"),
                        H.resolve_url("href", F.lit(K.JSPAGES_BASE)).alias("detail_url"))


def build(spark: SparkSession, root: str, run_ts: dt.datetime) -> DataFrame:
    links = candidate_links(spark, root)
    detail = pages(spark, root, SOURCE, "detail").select("url", "html", LANDED, H.visible_markup("html").alias("vis"))
    main_text = H.text_raw(H.main_scope("vis", ("main",), cleaned=True), cleaned=True)
    ld = P.ld_offer_or_address_block("html")
    ld_addr = P.vget(ld, "$.address", "variant")
    offers = P.vget(ld, "$.offers", "variant")
    price_v = P.vget(offers, "$.price", "variant")
    d = detail.select(
        "url", LANDED, main_text.alias("main_text"), H.heading_title("vis", cleaned=True).alias("title"),
        F.when(P.is_object(ld_addr), compose.join_nonempty(", ", P.vget(ld_addr, "$.streetAddress", "string"),
                                                           P.vget(ld_addr, "$.addressLocality", "string"))).alias("address"),
        F.when(P.is_object(ld_addr), text.nonempty(P.vget(ld_addr, "$.addressLocality", "string"))).alias("neighborhood"),
        F.when(P.is_object(offers) & P.truthy(price_v),
               numbers.parse_euro_amount(F.coalesce(P.value_text(price_v), F.lit("")))).alias("ld_price"),
    )
    reason = filters.first_reason(
        (filters.unavailable_in_scope("title", "main_text", K.JSPAGES_SCOPE_CHARS), "unavailable"),
    )
    low = F.lower("main_text")
    fields = d.select(
        "url", LANDED, reason.alias("reject_reason"), text.nonempty("title").alias("title"), "address", "neighborhood",
        F.to_json(F.struct("title", "address", "ld_price")).alias("raw"),
        F.coalesce("ld_price", numbers.parse_euro_amount(compose.euro_text_amount("main_text")))
        .alias("price_eur_month"),
        compose.size_from_text("main_text").alias("size_m2"),
        text.classify_by_keywords(low, K.TYPE_RULES_JSPAGES).alias("listing_type"),
        *text.keyword_flags(low, K.KEYWORDS_JSPAGES),
        compose.available_from_text("main_text", K.AVAILABLE_JSPAGES_PATTERN).alias("available_from"),
    )
    # The parsed rows (no HTML) are staged: the winner count and the kept rows
    # both read them.  A link whose page was not landed stays for the audit.
    j = joins.link_page_join(links, fields, "detail_url", "url", order=(LANDED,), how="left")
    j = staged(j.withColumn("reject_reason", F.when(F.col("url").isNull(), F.lit("no_page")).otherwise(F.col("reject_reason")))
               .withColumn("url", F.coalesce("url", "detail_url")).drop("detail_url"), "js-rows")
    # The first candidate with an accepted listing; the others were never read.
    counts = j.groupBy(F.lit(SOURCE).alias("src"), "candidate").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("n_listings"))
    winner = windows.first_nonempty_candidate(counts, ["src"], "candidate", "n_listings").select("winning_rank")
    read_upto = F.coalesce(winner.scalar(), F.lit(1 << 30))
    return finish(j.where(F.col("candidate") <= read_upto), SOURCE, run_ts)
