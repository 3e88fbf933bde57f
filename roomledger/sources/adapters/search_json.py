"""The search-JSON site (source rank 4): search result pages that carry the
API's JSON in a ``<pre>`` (or the ``__NEXT_DATA__`` script), paged until
three empty pages in a row (W5); the first candidate search whose first
page has results wins (W3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, flags, numbers, payload as P, text
from ...operators import filters, windows
from ...operators.ordering import source_position
from .common import LANDED, finish, first_landings, pages, staged

SOURCE = K.SOURCES[3]
# What must have the right shape for an ad to be read.
AD_SHAPES = [("$", "object"), ("$.property", "object"), ("$.property.location", "object"), ("$.transaction", "object"),
             ("$.transaction.rental", "object"), ("$.flags", "object"), ("$.property.netHabitableSurface", "number"),
             ("$.property.livingSurface", "number"), ("$.property.totalSurface", "number"),
             ("$.transaction.rental.monthlyRentalPrice", "number"), ("$.transaction.price", "number")]


def build(spark: SparkSession, root: str, run_ts: dt.datetime) -> DataFrame:
    search = pages(spark, root, SOURCE, "search").select("candidate", "page", LANDED, "html")
    # Each page is parsed once; the page log, the cut-off and the ads read the stage.
    sp = staged(search.select("candidate", "page", LANDED, P.search_payload("html").alias("sp")), "search-pages")
    sp = first_landings(sp, ["candidate", "page"])
    ads = sp.select("candidate", "page", F.posexplode_outer("sp.ads").alias("pos", "ad"))

    def g(path: str, typ: str = "string"):
        return P.vget(F.col("ad"), path, typ)

    loc = "$.property.location"
    size_any = numbers.first_truthy(g("$.property.netHabitableSurface", "double"), g("$.property.livingSurface", "double"),
                                    g("$.property.totalSurface", "double"))
    price_any = numbers.first_truthy(g("$.transaction.rental.monthlyRentalPrice", "double"), g("$.transaction.price", "double"))
    error = P.first_wrong_shape(F.col("ad"), AD_SHAPES)
    reason = filters.first_reason(
        (error.isNotNull(), "parse_error"),
        (~filters.area_code_match(g(f"{loc}.postalCode"), g(f"{loc}.locality")), "out_of_area"),
        (~filters.not_both_exceed(size_any, price_any), "too_large"),
        (~filters.not_sold(g("$.flags.isSoldOrRented", "boolean"), g("$.flags.isRented", "boolean")), "sold"),
    )
    ads = ads.where(F.col("ad").isNotNull()).withColumn("reject_reason", reason).withColumn("parse_error", error)

    # W5 per candidate, then W3 over candidates whose first page worked with results.
    per_page = ads.groupBy("candidate", "page").agg(F.count_if(F.col("reject_reason").isNull()).alias("n_results"))
    log = sp.select("candidate", "page", (~F.col("sp.found")).alias("failed"),
                    F.col("sp.total_items").alias("total_items")).join(per_page, ["candidate", "page"], "left")
    log = log.withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    cut = windows.empty_run_cutoff(log, ["candidate"])
    ok = cut.where("page1_ok").groupBy(F.lit(SOURCE).alias("src")).agg(F.min("candidate").alias("winning_rank"))
    winner = ok.select("winning_rank").scalar()
    rows = ads.where(F.col("candidate") == winner).join(cut.select("candidate", "cutoff_page"), "candidate")
    rows = rows.where(F.col("page") < F.col("cutoff_page"))

    prop_type, locality, postcode = g("$.property.type"), g(f"{loc}.locality"), g(f"{loc}.postalCode")
    address = compose.compose_address(g(f"{loc}.street"), g(f"{loc}.number"), locality,
                                      F.coalesce(text.nonempty(postcode), F.lit("")))
    ltype = compose.type_label(g("$.property.subtype"), prop_type)
    kitchen = g("$.property.kitchen", "variant")
    kitchen_type = F.when(P.is_object(kitchen), P.vget(kitchen, "$.type", "string")).otherwise(P.value_text(kitchen))
    fields = rows.select(
        source_position("page", "pos").alias("src_pos"), "page", "reject_reason", "parse_error",
        F.to_json(F.struct(size_any.alias("size"), price_any.alias("price"), postcode.alias("postcode"), locality.alias("locality"))).alias("raw"),
        compose.search_listing_url(g("$.url"), g("$.permalink"), prop_type, locality, postcode, g("$.id")).alias("url"),
        compose.ad_title(g("$.property.title"), g("$.title"), ltype, address).alias("title"),
        address.alias("address"),
        compose.neighborhood_first(g(f"{loc}.district"), locality).alias("neighborhood"),
        compose.search_ad_price(g("$.transaction.rental.monthlyRentalPrice", "double"), g("$.transaction.price", "double"),
                                g("$.price", "double")).alias("price_eur_month"),
        compose.search_ad_size(g("$.property.netHabitableSurface", "double"), g("$.property.livingSurface", "double"),
                               g("$.property.totalSurface", "double")).alias("size_m2"),
        ltype.alias("listing_type"),
        flags.furnished_coalesce(g("$.property.furnished", "boolean"), g("$.property.isFurnished", "boolean")).alias("furnished"),
        flags.bath_flag(g("$.property.bathroomCount", "bigint"), g("$.property.showerRoomCount", "bigint"))
        .alias("private_bathroom"),
        flags.kitchen_flag(kitchen_type).alias("private_kitchen"),
        compose.date_prefix(g("$.transaction.availabilityDate"), g("$.transaction.availableFrom")).alias("available_from"),
    )
    return finish(fields, SOURCE, run_ts)
