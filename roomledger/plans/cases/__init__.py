"""Operator checks on the driver's tables.

Each case maps driver tables onto an operator's inputs (an *adapter*),
runs the operator on Spark over the whole tables, and carries the same
computation written as DuckDB SQL for the oracle.  Adapters only rename
and derive columns; the operator code is the library's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

CASES: dict[str, tuple[Query, str | None]] = {}


def case(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its oracle SQL."""

    def deco(fn: Query) -> Query:
        if key in CASES:
            raise ValueError(f"duplicate case {key}")
        CASES[key] = (fn, sql)
        return fn

    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, read whole and plainly: filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def load_all() -> dict[str, tuple[Query, str | None]]:
    from . import listings, pages, payloads, records  # noqa: F401

    return CASES
