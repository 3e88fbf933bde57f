"""The unit database JSON API (source rank 1): filter options, paged search
results and one detail document per item."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import constants as K
from ...functions import compose, flags, numbers, text
from ...operators import aggregates, filters, joins, ordering, windows
from .. import payloads
from .common import LANDED, api, finish, first_landings, staged

SOURCE = K.SOURCES[0]


def build(spark: SparkSession, root: str, run_ts: dt.datetime) -> DataFrame:
    # A3 + F10: the latest academic year's option id, as a scalar filter.
    options = payloads.read_filter_options(api(spark, root, "filter_options"))
    picked = aggregates.latest_year_option(options)
    search = filters.academic_year_filter(api(spark, root, "search"), picked, "availability_id")

    # Bodies are parsed once: the page log and the items both read the stage.
    parsed = staged(payloads.parse_search_bodies(search, "body", ("page", "availability_id", LANDED)), "unit-search")
    parsed = first_landings(parsed, ["page", "availability_id"])

    # Read pages until the first empty page; a short page is the last.
    n_items = F.coalesce(F.size("items"), F.lit(0))
    log = parsed.select(F.lit(SOURCE).alias("src"), "page", n_items.alias("n_items")).groupBy("src", "page").agg(
        F.max("n_items").alias("n_items"))
    log = log.select("*", (F.col("n_items") == 0).alias("stop_before"),
                     (F.col("n_items") < K.UNIT_PAGE_SIZE).alias("stop_after"))
    last_page = windows.page_prefix(log, ["src"]).select("last_page").scalar()

    items = payloads.explode_search_items(parsed.where(F.col("page") <= last_page), ("page",))
    items = items.withColumn("src_pos", ordering.source_position("page", "pos"))
    details = payloads.read_checked_details(api(spark, root, "detail"), "body", ("item_id", LANDED)).withColumnRenamed("item_id", "id")

    j = joins.item_detail_join(items, details, "id", order=(LANDED,), how="left")
    d = F.col("detail")
    options_col = d["facilities"]["options"]
    unit_type = joins.enum_lookup(d["unitType"])
    address = compose.compose_address(d["location"]["street"], d["location"]["number"], d["location"]["city"])
    surface = d["surfaceAreaFrom"]
    desc = compose.description_text(d["descriptions"]["items"])
    raw = F.to_json(F.struct("id", d["pricing"].alias("pricing"), surface.alias("surface"), d["unitType"].alias("unit_type")))
    fields = j.select(
        "src_pos", "page", raw.alias("raw"),
        F.when(F.col("id").isNull(), F.lit("missing_id")).when(F.col("parse_error").isNotNull(), F.lit("parse_error"))
        .when(d.isNull(), F.lit("no_detail")).alias("reject_reason"), "parse_error",
        compose.unit_listing_url(d["guid"]).alias("url"),
        compose.unit_title(unit_type, address, d["unitNumber"]).alias("title"),
        address.alias("address"),
        text.nonempty(d["location"]["city"]).alias("neighborhood"),
        F.coalesce(numbers.range_from(d["pricing"]["totalMonthlyRent"]),
                   numbers.range_from(d["pricing"]["monthlyRent"])).alias("price_eur_month"),
        F.when(F.coalesce(surface, F.lit(0.0)) != 0, surface).alias("size_m2"),
        unit_type.alias("listing_type"),
        flags.facility_flag(options_col, K.OPT_FURNISHED).alias("furnished"),
        flags.facility_flag(options_col, K.OPT_PRIVATE_BATHROOM, "hasPrivateBathroom").alias("private_bathroom"),
        flags.count_positive(d["facilities"]["commonBathrooms"]).alias("shared_bathroom"),
        flags.facility_flag(options_col, K.OPT_PRIVATE_KITCHEN, "hasPrivateKitchen").alias("private_kitchen"),
        flags.count_positive(d["facilities"]["commonKitchens"]).alias("shared_kitchen"),
        flags.internet_flag(d["pricing"]["internet"], options_col).alias("internet_included"),
        flags.all_costs_covered(d["pricing"]["water"], d["pricing"]["electricity"], d["pricing"]["heating"])
        .alias("utilities_included"),
        *text.keyword_flags(desc, K.KEYWORDS_UNIT_API),
        compose.date_prefix(d["availability"]["from"], "availableFrom").alias("available_from"),
    )
    return finish(fields, SOURCE, run_ts)
