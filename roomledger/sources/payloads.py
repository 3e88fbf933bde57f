"""Readers for landed payloads.

Landed data is one row per fetched document: JSON bodies of API calls and
HTML pages, with the request's parameters as columns.  JSON is parsed
with an explicit schema (``from_json``, PERMISSIVE), so a malformed body
is a NULL struct, never a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import first_wrong_shape, parse_json, vget
from ..functions.text import col

SEARCH_ITEM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("hasPrivateBathroom", T.BooleanType()),
        T.StructField("hasPrivateKitchen", T.BooleanType()),
        T.StructField("availableFrom", T.StringType()),
    ]
)
SEARCH_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [T.StructField("items", T.ArrayType(SEARCH_ITEM)), T.StructField("totalCount", T.LongType())]
            ),
        )
    ]
)
RANGE = T.StructType([T.StructField("from", T.DoubleType()), T.StructField("to", T.DoubleType())])
DETAIL_DATA = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("unitType", T.IntegerType()),
        T.StructField("unitNumber", T.StringType()),
        T.StructField("surfaceAreaFrom", T.DoubleType()),
        T.StructField(
            "location",
            T.StructType([T.StructField(n, T.StringType()) for n in ("street", "number", "city")]),
        ),
        T.StructField(
            "pricing",
            T.StructType(
                [
                    T.StructField("totalMonthlyRent", RANGE),
                    T.StructField("monthlyRent", RANGE),
                    *[T.StructField(n, T.IntegerType()) for n in ("internet", "water", "electricity", "heating")],
                ]
            ),
        ),
        T.StructField(
            "facilities",
            T.StructType(
                [
                    T.StructField("options", T.ArrayType(T.IntegerType())),
                    T.StructField("commonBathrooms", T.IntegerType()),
                    T.StructField("commonKitchens", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("availability", T.StructType([T.StructField("from", T.StringType())])),
        T.StructField(
            "descriptions",
            T.StructType(
                [
                    T.StructField(
                        "items",
                        T.ArrayType(
                            T.StructType([T.StructField("property", T.StringType()), T.StructField("unit", T.StringType())])
                        ),
                    )
                ]
            ),
        ),
    ]
)
DETAIL_BODY = T.StructType([T.StructField("data", DETAIL_DATA)])
FILTER_OPTIONS_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "availabilityOptions",
                        T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("label", T.StringType())])),
                    )
                ]
            ),
        )
    ]
)


# What must have the right shape for a detail document to be read; a value that is missing, null or empty counts as
# not given.  Checked only where a body does not fit ``DETAIL_BODY``.
DETAIL_SHAPES = [
    ("$", "object"), ("$.location", "object"), ("$.pricing", "object"), ("$.pricing.totalMonthlyRent", "object"),
    ("$.pricing.totalMonthlyRent.from", "number"), ("$.surfaceAreaFrom", "number"), ("$.facilities", "object"),
    ("$.facilities.options", "list"), ("$.facilities.commonBathrooms", "number"), ("$.facilities.commonKitchens", "number"),
    ("$.availability", "object"), ("$.descriptions", "object"), ("$.descriptions.items", "list")]
CORRUPT = "_corrupt"


def parse_body(body: Column | str, schema: T.StructType) -> Column:
    return F.from_json(col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def parse_search_bodies(search_pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """S1, first half: one row per body with ``total_count`` and ``items``
    (NULL when the body has no ``data`` or null items)."""
    parsed = search_pages.select(*keep, parse_body(body, SEARCH_BODY).alias("_b"))
    return parsed.select(*keep, F.col("_b.data.totalCount").alias("total_count"),
                         F.col("_b.data.items").alias("items"))


def explode_search_items(parsed: DataFrame, keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """S1, second half: one row per non-null item with its position."""
    items = parsed.select(*keep, "total_count", F.posexplode_outer("items").alias("pos", "item"))
    return items.where(F.col("item").isNotNull()).select(*keep, "pos", "total_count", "item.*")


def read_search_items(search_pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ("page",)) -> DataFrame:
    """One row per search item with its position in the page and the
    page's total count.  A body without ``data`` or with null ``items``
    gives no rows; null items are dropped."""
    return explode_search_items(parse_search_bodies(search_pages, body, keep), keep)


def read_detail_docs(detail_pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The ``data`` object of each detail body; absent, null or empty
    (``{}``, every field unset) data is skipped."""
    return read_checked_details(detail_pages, body, keep).where("parse_error IS NULL").drop("parse_error")


def read_checked_details(detail_pages: DataFrame, body: str = "body", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """S2 with a quarantine column: (keep, detail, parse_error).  A document
    with a value of the wrong shape stays as a row that names it, so one bad
    document costs one row."""
    schema = T.StructType([*DETAIL_BODY.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = detail_pages.select(*keep, F.col(body).alias("_body"), parse_body(body, schema).alias("_parsed"))
    error = F.when(F.col(f"_parsed.{CORRUPT}").isNotNull(), first_wrong_shape(vget(parse_json("_body"), "$.data", "variant"), DETAIL_SHAPES))
    parsed = parsed.select(*keep, F.col("_parsed.data").alias("detail"), error.alias("parse_error"))
    fields = [F.col(f"detail.{f.name}").isNotNull() for f in DETAIL_DATA.fields]
    any_set = fields[0]
    for f in fields[1:]:
        any_set = any_set | f
    return parsed.where((F.col("detail").isNotNull() & any_set) | F.col("parse_error").isNotNull())


def read_filter_options(body_df: DataFrame, body: str = "body") -> DataFrame:
    """The availability options list as rows ``(pos, id, label)``."""
    parsed = body_df.select(parse_body(body, FILTER_OPTIONS_BODY).alias("_b"))
    return parsed.select(F.posexplode("_b.data.availabilityOptions").alias("pos", "o")).select(
        "pos", "o.id", "o.label"
    )


def read_pages(pages: DataFrame, status: str = "status") -> DataFrame:
    """S3: landed pages; a page fetched with an HTTP error status is dropped.
    The filter is on a plain column, so it reaches the Parquet scan."""
    if status in pages.columns:
        return pages.where(F.col(status).isNull() | (F.col(status) < 400))
    return pages


def url_host(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)
