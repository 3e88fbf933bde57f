"""The rental-pages site (source rank 3): candidate search URLs with result
cards, detail pages with JSON-LD, classed elements and free text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, html as H, numbers, payload as P, text
from ...operators import filters, html_facts, joins, ordering, windows
from .. import payloads
from .common import LANDED, finish, first_landings, pages, staged

SOURCE = K.SOURCES[2]
NEXT_LINK = r"""(?is)\srel\s*+=\s*+["']?next\b"""


def visited_cards(spark: SparkSession, root: str) -> DataFrame:
    """Cards of the first working candidate (W3), first card per URL (W4),
    minus URLs whose first card says taken (J3).  Returns ``card_reason``
    for the audit."""
    search = pages(spark, root, SOURCE, "search").select("candidate", "page", "html", "status", LANDED)
    links = H.anchors("html")
    named = F.exists(F.regexp_extract_all("html", F.lit(H.ANCHOR), 0), lambda a: a.rlike(NEXT_LINK))
    has_next = F.exists(links, lambda a: a["text"].rlike("(?i)" + K.NEXT_PAGE_TEXT_PATTERN)) | named
    search = search.withColumn("has_next", F.coalesce(has_next, F.lit(False)))
    facts = html_facts.with_html_facts(search, "html", class_patterns={}, attr_selectors=None,
                                       detail_href=K.RENTALS_DETAIL_HREF, detail_case_insensitive=True)
    # The search pages are parsed once: the winner, the pages read and the cards read the stage.
    parsed = staged(facts.select("candidate", "page", "status", LANDED, "has_next", "cards"), "rental-cards")
    parsed = first_landings(parsed, ["candidate", "page"])
    cards = parsed.select("candidate", "page", "status", F.posexplode_outer("cards").alias("pos", "card"))
    ok_first = (F.col("page") == 1) & (F.col("status").isNull() | (F.col("status") < 400))
    counts = cards.where(ok_first).groupBy(F.lit(SOURCE).alias("src"), "candidate").agg(
        F.count("card").alias("n_cards"))
    winner = windows.first_nonempty_candidate(counts, ["src"], "candidate", "n_cards").select("winning_rank").scalar()
    # Reading goes on as long as a page links to a next one that was landed.
    failed = F.coalesce(F.col("status") >= 400, F.lit(False))
    log = parsed.where(F.col("candidate") == winner).groupBy(F.lit(SOURCE).alias("src"), "page").agg(
        F.min(failed).alias("stop_before"), (~F.max("has_next")).alias("stop_after"))
    last_page = windows.page_prefix(log, ["src"]).select("last_page").scalar()
    linked = cards.where((F.col("candidate") == winner) & (F.col("page") <= last_page) & F.col("card.href").isNotNull()).select(
        "page", "pos", H.resolve_url(F.col("card.href"), F.lit(K.RENTALS_BASE)).alias("detail_url"),
        text.matches_any_phrase(F.col("card.text")).alias("taken"))
    first = windows.first_with_flag(linked, ["detail_url"], ["page", "pos"], "taken")
    return first.select(
        "detail_url", "page", ordering.source_position("page", "pos").alias("src_pos"),
        F.when(F.col("taken"), F.lit("card_unavailable")).alias("card_reason"))


def build(spark: SparkSession, root: str, run_ts: dt.datetime) -> DataFrame:
    cards = visited_cards(spark, root)
    detail = payloads.read_pages(pages(spark, root, SOURCE, "detail")).select(
        "url", "html", LANDED, H.visible_markup("html").alias("vis"))
    main_text = H.text_raw(H.main_scope("vis", cleaned=True), cleaned=True)
    ld = P.ld_typed_block("html")
    ld_addr = P.vget(ld, "$.address", "variant")
    offers = P.vget(ld, "$.offers", "variant")
    d = detail.select(
        "url", "html", LANDED,
        main_text.alias("main_text"),
        H.heading_title("vis", cleaned=True).alias("title"),
        H.text_raw("vis", cleaned=True).alias("full_text"),
        P.is_object(ld_addr).alias("ld_has_address"),
        compose.join_nonempty(", ", P.vget(ld_addr, "$.streetAddress", "string"),
                              P.vget(ld_addr, "$.addressLocality", "string")).alias("ld_address"),
        text.nonempty(P.vget(ld_addr, "$.addressLocality", "string")).alias("ld_locality"),
        F.when(P.is_object(offers), numbers.parse_euro_amount(
            F.coalesce(P.value_text(P.vget(offers, "$.price", "variant")), F.lit("")))).alias("ld_price"),
    )
    reason = filters.first_reason(
        (filters.unavailable_in_scope("title", "main_text", K.RENTALS_SCOPE_CHARS), "unavailable"),
        (~text.area_text_match("full_text"), "out_of_area"),
    )
    d = d.withColumn("reject_reason", reason).withColumn("_wanted", F.col("reject_reason").isNull())
    # Classed elements need the page's tokens: only accepted pages are cut into them.
    d = html_facts.with_html_facts(d, "html", "_wanted", card_selectors=None, attr_selectors=None,
                                   class_patterns={"price_text": K.PRICE_CLASS_PATTERN,
                                                   "address_text": K.ADDRESS_CLASS_PATTERN})
    address = F.coalesce(text.nonempty("ld_address"), text.nonempty("address_text"))
    from_tag = text.nonempty("ld_address").isNull() & text.nonempty("address_text").isNotNull()
    neighborhood = F.when(from_tag, F.coalesce(compose.last_address_part("address_text"),
                                               F.when(F.col("ld_has_address"), F.col("ld_locality"))))
    neighborhood = neighborhood.otherwise(F.when(F.col("ld_has_address"), F.col("ld_locality")))
    fallback_price = F.when(F.col("price_text").isNotNull(), numbers.parse_euro_amount("price_text")).otherwise(
        numbers.parse_euro_amount(compose.euro_text_amount("main_text")))
    low = F.lower("main_text")
    fields = d.select(
        "url", LANDED, "reject_reason", text.nonempty("title").alias("title"),
        F.to_json(F.struct("title", "ld_address", "address_text", "ld_price", "price_text")).alias("raw"),
        address.alias("address"), neighborhood.alias("neighborhood"),
        F.coalesce(F.col("ld_price"), fallback_price).alias("price_eur_month"),
        compose.size_from_text("main_text").alias("size_m2"),
        text.classify_by_keywords(low, K.TYPE_RULES_RENTALS).alias("listing_type"),
        *text.keyword_flags(low, K.KEYWORDS_RENTALS),
        compose.available_from_text("main_text", K.AVAILABLE_RENTALS_PATTERN).alias("available_from"),
    )
    # A card that says taken is never visited, so its page need not be landed.
    j = joins.link_page_join(cards, fields, "detail_url", "url", order=(LANDED,), how="left")
    reason = F.coalesce("card_reason", F.when(F.col("url").isNull(), F.lit("no_page")), "reject_reason")
    j = j.withColumn("reject_reason", reason).withColumn("url", F.coalesce("url", "detail_url")).drop("detail_url", "card_reason")
    return finish(j, SOURCE, run_ts)
