"""Landed layout and the shared tail of every adapter.

Landed data (one folder per run):

- ``api/``   endpoint STRING, page INT, availability_id INT, item_id BIGINT, body STRING, landed_seq BIGINT
- ``pages/`` source STRING, kind STRING ('search' | 'detail'), candidate INT,
  page INT, url STRING, html STRING, status INT (nullable), landed_seq BIGINT

``landed_seq`` grows with every document that the crawl lands.  A document
that was landed twice counts as landed first; where the column is missing or
NULL the order is unknown and such documents come last.  Both are Parquet; ``pages`` is partitioned by ``source`` and ``kind`` so an
adapter's filter on them prunes partitions at the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ... import constants as K
from ...functions import numbers
from ...schema import LISTING_SCHEMA, canonical_columns
from ...session import scratch_dir

API_SCHEMA = T.StructType(
    [
        T.StructField("endpoint", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("availability_id", T.IntegerType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("landed_seq", T.LongType()),
    ]
)
PAGES_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("landed_seq", T.LongType()),
    ]
)
# The canonical columns, the search page of the candidate, its values before
# parsing (JSON), why it was dropped (NULL: kept) and, for ``parse_error``, the
# value that could not be read.
AUDIT_COLUMNS = [f.name for f in LISTING_SCHEMA.fields] + ["page", "raw", "reject_reason", "parse_error"]
LANDED = "landed_seq"


def api(spark: SparkSession, root: str, endpoint: str) -> DataFrame:
    return spark.read.schema(API_SCHEMA).parquet(f"{root.rstrip('/')}/api").where(F.col("endpoint") == endpoint)


def pages(spark: SparkSession, root: str, source: str, kind: str) -> DataFrame:
    df = spark.read.schema(PAGES_SCHEMA).parquet(f"{root.rstrip('/')}/pages")
    return df.where((F.col("source") == source) & (F.col("kind") == kind))


def finish(df: DataFrame, source: str, run_ts: dt.datetime, reason: Column | str = "reject_reason") -> DataFrame:
    """Add source, rank, run time and price per m²; select the audit columns
    with canonical types (``page`` and ``raw`` are NULL where not given)."""
    out = df.withColumn("source", F.lit(source)).withColumn("site_rank", F.lit(K.site_rank(source)))
    out = out.withColumn("scraped_on", F.lit(run_ts.replace(second=0, microsecond=0)).cast("timestamp"))
    out = out.withColumn("price_per_m2", numbers.price_per_m2("price_eur_month", "size_m2"))
    r = F.col(reason) if isinstance(reason, str) else reason
    page = F.col("page") if "page" in out.columns else F.lit(None)
    raw = F.col("raw") if "raw" in out.columns else F.lit(None)
    error = F.when(r == "parse_error", F.col("parse_error")) if "parse_error" in out.columns else F.lit(None)
    return out.select(*canonical_columns(out), page.cast("int").alias("page"), raw.cast("string").alias("raw"),
                      r.cast("string").alias("reject_reason"), error.cast("string").alias("parse_error"))


def first_landings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The first landing of every document: of the rows that share ``keys``
    those with the least landing number.  ``docs`` is read twice, so it should
    be staged; the numbers alone are aggregated, and whatever else a row holds
    (arrays and VARIANT too) is fetched by a semi-join.  Without numbers all stay."""
    number = F.coalesce(F.col(LANDED), F.lit((1 << 63) - 1))
    first = docs.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(number).alias("_first"))
    same = number == F.col("_first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return docs.join(first, same, "left_semi").drop(LANDED)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write parsed rows (never HTML) as Parquet under the shared scratch
    folder and read them back: a decision and the rows both read the columns
    they need, and the pages are parsed once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
