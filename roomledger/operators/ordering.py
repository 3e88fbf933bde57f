"""Union, source positions and output order."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Room for each part of a position: above any INT, so no two positions meet.
PART = "1000000000000"
POSITION_TYPE = "decimal(38,0)"


def source_position(*parts: Column | str) -> Column:
    """O2: discovery order within a source, from the outermost part (candidate,
    page) to the innermost (position in the page), as one sortable number.
    At most three parts, each an INT."""
    if not 1 <= len(parts) <= 3:
        raise ValueError("one to three parts")
    out = None
    for part in parts:
        c = (F.col(part) if isinstance(part, str) else part).cast("decimal(11,0)")
        out = c if out is None else (out * F.lit(PART).cast("decimal(13,0)") + c)
    return out.cast(POSITION_TYPE)


def union_sources(frames: Iterable[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Concatenate the sources' listings by column name (duplicates kept)."""
    frames = list(frames)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*columns) if columns else out


def output_order(df: DataFrame, rank: str = "site_rank", pos: str = "src_pos") -> DataFrame:
    """O1: site priority, then discovery order -- a range-partitioned sort,
    applied only at the sink."""
    return df.orderBy(F.col(rank).asc(), F.col(pos).asc())
