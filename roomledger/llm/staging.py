"""Staged tables: lineage cut by a written Parquet table in the folder that
``spark.checkpoint.dir`` names (shared by driver and executors)."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects what refers to them.  After
    a staged table is written its shuffles serve nobody, and later steps need
    the disk.  Listeners of the write may hold its plan a moment longer."""
    for pause in (0.2, 0.5):
        gc.collect()
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` and read it back: computed once, read by every later
    branch, and still there when an executor is lost.  ``large``: its shuffles
    are worth giving back at once."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    if large:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def apart(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
