"""Aggregations (A1-A6).  All are hash aggregates with a partial step per
map task; none gathers a group's rows in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import first_per_key


def count_per_source(df: DataFrame, source: str = "source", rank: str = "site_rank") -> DataFrame:
    """A1: listings per source, in first-appearance (priority) order."""
    return (
        df.groupBy(source)
        .agg(F.count(F.lit(1)).alias("n_listings"), F.min(rank).alias("site_rank"))
        .orderBy("site_rank", source)
    )


def counts_with_total(df: DataFrame, source: str = "source", rank: str | None = None) -> DataFrame:
    """A1 + A2 in one pass: (source, is_total, n_listings[, rank]).  The total
    row is told by ``is_total``, not by a null source, and is there (as 0) for
    an empty input: a row that counts nothing is rolled up with the others."""
    ranks = [F.col(rank).alias("_rank")] if rank else []
    nothing = df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema[source].dataType).alias(source), F.lit(0).cast("bigint").alias("_n"),
        *([F.lit(None).cast(df.schema[rank].dataType).alias("_rank")] if rank else []))
    counted = df.select(F.col(source).alias(source), F.lit(1).cast("bigint").alias("_n"), *ranks).unionByName(nothing)
    rolled = counted.rollup(source).agg(F.sum("_n").alias("n_listings"), (F.grouping_id() > 0).alias("is_total"),
                                        *([F.min("_rank").alias(rank)] if rank else []))
    return rolled.where(F.col("is_total") | (F.col("n_listings") > 0)).select(
        source, "is_total", "n_listings", *([rank] if rank else []))


def year_of_label(label: str = "label"):
    """First 4-digit number in a label, as INT; NULL when there is none."""
    return F.nullif(F.regexp_extract(F.col(label), r"\d{4}", 0), F.lit("")).try_cast("int")


def latest_year_option(options: DataFrame, id_col: str = "id", label: str = "label", pos: str = "pos") -> DataFrame:
    """A3: the option whose label has the latest year; ties -> first by position.

    One row ``(id, label, year)``; no row when no label has a year.
    """
    yeared = options.withColumn("_year", year_of_label(label)).where(F.col("_year").isNotNull())
    best = F.max_by(F.struct(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col("_year").alias("year")),
                    F.struct(F.col("_year"), -F.col(pos)))
    return yeared.agg(best.alias("_best")).where(F.col("_best").isNotNull()).select("_best.*")


def dedup_removed_count(marked: DataFrame, flag: str = "is_duplicate") -> DataFrame:
    """A4: rows in, rows kept, rows removed by dedup (one row)."""
    return marked.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~F.col(flag)).alias("rows_kept"),
        F.count_if(F.col(flag)).alias("rows_removed"),
    )


def funnel_counts(audit: DataFrame, keys: Sequence[str] = ("source", "page"), reason: str = "reject_reason") -> DataFrame:
    """A5: rows per (source, page, outcome); ``kept`` when the reason is NULL."""
    outcome = F.coalesce(F.col(reason), F.lit("kept")).alias("outcome")
    return audit.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_links(links: DataFrame, scope: Sequence[str], href: str = "href", pos: Sequence[str] = ("pos",)) -> DataFrame:
    """One row per (scope, href), at its first position."""
    return first_per_key(links.select(*scope, href, *pos), [*scope, href], list(pos))
