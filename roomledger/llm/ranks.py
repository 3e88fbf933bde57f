"""Ranks within groups of any size.

A plain ``row_number`` over a group sorts the whole group in one task.
Here a group is dealt into hashed blocks of about ``BLOCK_ROWS`` rows; the
rows of one block are numbered in one task, and a prefix sum over the block
counts (one row per block) gives each block its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000


def ranked(rows: DataFrame, keys: list[str], order: list[Column], counts: DataFrame, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: numbers from 0 without gaps within each group
    of ``keys``, by a hash of ``order``.  ``counts`` holds keys and ``n`` (rows of the
    group).  Rows equal in all of ``order`` take neighbouring numbers in any
    order."""
    blocks = F.floor(F.col("n") / F.lit(BLOCK_ROWS)) + F.lit(1)
    dealt = rows.join(counts.select(*keys, blocks.alias("_blocks")), keys) \
        .withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_blocks"))).drop("_blocks") \
        .repartition(*keys, "_block")  # else the join's partitioning by the keys alone would serve the window
    per_block = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.xxhash64(*order, F.lit("rank")), *order)
    return dealt.withColumn("_inside", F.row_number().over(inside) - 1) \
        .join(starts, [*keys, "_block"]) \
        .withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_block")
