"""The canonical listing schema every source adapter emits.

Unknown is NULL.  Amounts are exact decimals, flags nullable booleans
(True = yes, False = no, NULL = not stated).  ``site_rank`` and
``src_pos`` carry the order the reference kept implicitly in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAG_COLUMNS = [
    "furnished",
    "private_bathroom",
    "shared_bathroom",
    "private_kitchen",
    "shared_kitchen",
    "internet_included",
    "utilities_included",
    "washing_machine",
    "elevator",
    "pets_allowed",
]

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("site_rank", T.IntegerType(), False),
        T.StructField("src_pos", T.DecimalType(38, 0), False),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("neighborhood", T.StringType()),
        T.StructField("price_eur_month", T.DecimalType(18, 4)),
        T.StructField("size_m2", T.DecimalType(18, 4)),
        T.StructField("price_per_m2", T.DecimalType(18, 1)),
        T.StructField("listing_type", T.StringType()),
        *[T.StructField(f, T.BooleanType()) for f in FLAG_COLUMNS],
        T.StructField("available_from", T.StringType()),
        T.StructField("scraped_on", T.TimestampType()),
    ]
)

LISTING_COLUMNS = [f.name for f in LISTING_SCHEMA.fields]


def canonical_columns(df: DataFrame) -> list[Column]:
    """The canonical columns in order, cast to the canonical types; a column
    the source does not produce is NULL."""
    present = set(df.columns)
    cols: list[Column] = []
    for f in LISTING_SCHEMA.fields:
        c = F.col(f.name) if f.name in present else F.lit(None)
        # a value out of range costs that value, not the task
        cols.append(c.try_cast(f.dataType).alias(f.name))
    return cols
