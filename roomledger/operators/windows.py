"""First-per-key, dedup, limits and page cut-offs.

"First" always means the smallest explicit position, never input order.
Where a key can be hot (one address, one URL, one source holding a large
share of the rows) the operator is an aggregation -- partial per map
task, so a hot key collapses before the shuffle -- followed by a join
back, which AQE's skew handling can split.  Windows are used only where
the partition is bounded (page logs capped at a page limit) or Spark
applies a group limit before the shuffle (``row_number() <= n``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import DIGIT_CLASS, address_key


HOT_KEYS = 1000  # at most so many keys are broadcast
POSITION_BASE = "10000000000000000000"  # above any BIGINT position


def _packed(order: Sequence[str]) -> Column:
    """One or two integral columns as one ordered number."""
    base = F.lit(POSITION_BASE).cast("decimal(20,0)")
    wide = [F.col(c).cast("decimal(19,0)") for c in order]
    return (wide[0] if len(wide) == 1 else wide[0] * base + wide[1]).cast("decimal(38,0)")


def _unpacked(packed: Column, n: int) -> list[Column]:
    if n == 1:
        return [packed]
    base = F.lit(POSITION_BASE).cast("decimal(20,0)")
    second = F.pmod(packed, base)
    return [((packed - second) / base).cast("decimal(38,0)"), second]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` tuple per key.

    ``min(struct(order..., rest...))`` is a partial aggregate, so one URL seen
    a million times costs one row per map task in the shuffle.  Without other
    columns only the position is aggregated, as one number (a hash aggregate).
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and not order:
        return df.select(*keys).distinct()
    if not rest and len(order) <= 2 and all(isinstance(df.schema[c].dataType, T.IntegralType) for c in order):
        position = _packed(order)
        return df.groupBy(*keys).agg(F.min(position).alias("_first")).select(
            *keys, *[v.cast(df.schema[c].dataType).alias(c) for c, v in zip(order, _unpacked(F.col("_first"), len(order)))])
    packed = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])


def first_with_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """W4 with a boolean payload: (keys, order, flag) of the first row per
    key; where rows share the first place, the flag is set if one has it.

    The least position among flagged rows and among all rows tells both, so
    one hash aggregate of numbers does, whatever the flag was computed from.
    ``order`` is one or two integral columns."""
    position = _packed(order)
    found = df.groupBy(*keys).agg(F.min(position).alias("_first"), F.min(F.when(F.col(flag), position)).alias("_flagged"))
    places = [v.cast(df.schema[c].dataType).alias(c) for c, v in zip(order, _unpacked(F.col("_first"), len(order)))]
    return found.select(*keys, *places, F.coalesce(F.col("_flagged") == F.col("_first"), F.lit(False)).alias(flag))


def dedup_eligible(address: Column | str, price: Column | str) -> Column:
    """The key counts when the address has a digit and the price is known.
    Lower-casing and removing whitespace cannot add or drop a digit, so the
    test runs on the raw address, without building the key."""
    a = F.col(address) if isinstance(address, str) else address
    p = F.col(price) if isinstance(price, str) else price
    return F.coalesce(a.rlike(DIGIT_CLASS) & p.isNotNull(), F.lit(False))


def dedup_key(address: Column | str, price: Column | str) -> Column:
    """C17 + eligibility: the key when it counts, else NULL."""
    return F.when(dedup_eligible(address, price), address_key(address))


def mark_cross_source_duplicates(df: DataFrame, address: str = "address", price: str = "price_eur_month",
                                 rank: str = "site_rank", among: Column | None = None) -> DataFrame:
    """Add ``is_duplicate``.  A row is a duplicate iff its (address key,
    price) was first seen on an earlier source.  Same-source repeats stay.
    Rows that are not ``among`` those compared are never duplicates and make
    none; they come out as they are, without a read of their own.

    Rows arrive site by site in rank order, so "first seen" is the minimum
    rank of the key.  The per-key minimum and count are partial aggregates.
    Keys that hold more than one in ``HOT_KEYS`` of the rows are fewer than
    that, so theirs are broadcast and their rows stay in the tasks that have
    read them, with the rows that are not compared (no digit, unknown price or
    rank): those never meet a shuffle, so NULL keys cannot pile into one
    partition.  All others are joined with their key's minimum, one row per
    key on the right.  So no partition grows with one key, whether or not AQE
    splits it.  The key is a digest of fixed width, whatever the length of
    the address.

    ``df`` is read three times: for the keys, for the rows that stay in place
    and for the rows that are joined.  Pass a staged (written) table, where
    its plan is expensive.  All that is asked of the keys comes
    from one table of them, counted by rank: grouped by it, that table is the
    same to the optimizer whichever of its columns are used, and so is its
    shuffle.  The digest is never NULL, or a join would test that by computing
    it once more.
    """
    on = ["_dedup_key", price]
    digest = F.coalesce(F.unhex(F.sha2(address_key(address), 256)), F.lit(b""))
    eligible = dedup_eligible(address, price)
    keyed = df.withColumn("_eligible", eligible if among is None else F.coalesce(among, F.lit(False)) & eligible)
    is_compared = F.col("_eligible") & F.col(price).isNotNull() & F.col(rank).isNotNull()
    compared = keyed.where(is_compared).withColumn("_dedup_key", digest)
    by_rank = compared.groupBy(*on, rank).agg(F.count(F.lit(1)).alias("_n"))
    firsts = by_rank.groupBy(*on).agg(F.min(rank).alias("_first_rank"), F.sum("_n").alias("_n"))
    is_hot = F.col("_n") * HOT_KEYS > by_rank.agg(F.sum("_n").alias("rows")).scalar()
    hot = F.broadcast(firsts.where(is_hot).select(*on, F.col("_first_rank").alias("_hot_rank")))

    in_place = keyed.withColumn("_dedup_key", F.when(is_compared, digest)).join(hot, on, "left").where(
        ~is_compared | F.col("_hot_rank").isNotNull()).withColumn(
        "is_duplicate", F.when(F.col("_eligible"), F.col(rank) > F.col("_hot_rank")).otherwise(F.lit(False)))
    common = compared.join(hot, on, "left").where(F.col("_hot_rank").isNull()).join(
        firsts.where(~is_hot).select(*on, "_first_rank"), on).withColumn("is_duplicate", F.col(rank) > F.col("_first_rank"))
    cols = [*df.columns, "is_duplicate"]
    return in_place.select(*cols).unionByName(common.select(*cols))


def cross_source_dedup(df: DataFrame, address: str = "address", price: str = "price_eur_month",
                       rank: str = "site_rank") -> DataFrame:
    """Drop cross-source duplicates."""
    return mark_cross_source_duplicates(df, address, price, rank).where(~F.col("is_duplicate")).drop("is_duplicate")


def top_n_per_group(df: DataFrame, group: str = "source", order: str = "src_pos", n: int = K.TEST_MODE_LIMIT) -> DataFrame:
    """At most ``n`` rows per group by position.  Spark plans this as a
    ``WindowGroupLimit`` below the shuffle, so a hot group sends only
    ``n`` rows per map task."""
    w = Window.partitionBy(group).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_nonempty_candidate(results: DataFrame, group: Sequence[str], candidate_rank: str,
                             n_results: str) -> DataFrame:
    """Per group, the smallest candidate rank that has results.

    Returns one row per group: ``(*group, winning_rank)``.  Rows of other
    candidates are then dropped by joining on (group, rank).
    """
    return (
        results.where(F.col(n_results) > 0)
        .groupBy(*group)
        .agg(F.min(candidate_rank).alias("winning_rank"))
    )


def empty_run_cutoff(page_log: DataFrame, search: Sequence[str], page: str = "page", n_results: str = "n_results",
                     failed: str = "failed", total_items: str = "total_items",
                     per_page: int = K.SEARCH_PAGE_SIZE, streak: int = K.SEARCH_EMPTY_STREAK,
                     page_limit: int | None = None, default_pages: int = K.SEARCH_DEFAULT_PAGES) -> DataFrame:
    """Per search, the first page that is NOT read.

    ``page_log`` has one row per fetched page (pages never fetched count as
    empty).  Page 1 must have worked and have results, else nothing is read.
    From page 2 on, reading stops at the first failed page and at the last
    page of ``streak`` consecutive empty pages; after the last page with
    results a streak always follows.  ``page_limit`` bounds a live crawl: with
    it at most ``min(total_items // per_page + 2, page_limit)`` pages are read
    (``default_pages`` when the total is unknown); landed data has none.
    The window runs over the pages of one search.
    """
    keys = [F.col(c) for c in search]
    limit = F.lit(None).cast("int")
    if page_limit is not None:
        limit = F.least(F.coalesce(F.floor(F.max(F.col(total_items)) / per_page).cast("int") + 2, F.lit(default_pages)), F.lit(page_limit))
    p1 = (
        page_log.where(F.col(page) == 1)
        .groupBy(*search)
        .agg(
            ((F.max(F.col(n_results)) > 0) & (F.max(F.col(failed).cast("int")) == 0)).alias("page1_ok"),
            (limit if page_limit is not None else F.max(limit)).alias("max_pages"),
        )
    )
    events = page_log.where((F.col(page) >= 2) & ((F.col(n_results) > 0) | F.col(failed)))
    w = Window.partitionBy(*search).orderBy(F.col(page))
    prev = F.lag(F.col(page), 1, 1).over(w)
    stops = events.select(
        *keys, F.col(page).alias("_page"),
        F.when(F.col(failed), F.col(page)).alias("_fail_at"),
        F.when(F.col(page) - prev - 1 >= streak, prev + streak).alias("_streak_at"),
    )
    first_stop = stops.groupBy(*search).agg(
        F.min(F.least("_fail_at", "_streak_at")).alias("_stop"), F.max("_page").alias("_last")
    )
    out = p1.join(first_stop, on=list(search), how="left")
    stop = F.least(F.col("_stop"), F.coalesce("_last", F.lit(1)) + streak, F.col("max_pages") + 1)
    cutoff = F.when(F.col("page1_ok"), stop).otherwise(F.lit(1))
    return out.select(*keys, "page1_ok", "max_pages", cutoff.cast("int").alias("cutoff_page"))


def page_prefix(page_log: DataFrame, source: Sequence[str], page: str = "page", stop_before: str = "stop_before",
                stop_after: str = "stop_after") -> DataFrame:
    """Per source, the last page read.

    Reading starts at page 1 and stops before the first page that is
    missing or has ``stop_before`` set, and after the first page with
    ``stop_after`` set.  Returns ``(*source, last_page)``; 0 means none.

    No window over a source: a missing page is found by an anti-join of
    ``page + 1`` against the log on (source, page), which spreads a source
    with very many pages over all tasks; the rest are minimum aggregates.
    """
    keys = list(source)
    present = page_log.select(*keys, F.col(page).alias("_p"))
    after_present = present.select(*keys, (F.col("_p") + 1).alias("_p"))
    missing = after_present.join(present, on=[*keys, "_p"], how="left_anti")
    flagged = page_log.where(F.col(stop_before)).select(*keys, F.col(page).alias("_p"))
    before = missing.unionByName(flagged).groupBy(*keys).agg(F.min("_p").alias("_before"))
    stats = page_log.groupBy(*keys).agg(
        F.min(page).alias("_first"), F.min(F.when(F.col(stop_after), F.col(page))).alias("_after")
    )
    out = stats.join(before, on=keys, how="left")
    before_page = F.when(F.col("_first") > 1, F.lit(1)).otherwise(F.col("_before"))
    last = F.least(before_page - 1, F.coalesce(F.col("_after"), before_page - 1))
    return out.select(*keys, last.alias("last_page"))
