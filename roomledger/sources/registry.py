"""Pluggable source adapters in priority order.

Each adapter is ``fn(spark, landed_root) -> DataFrame`` in the canonical
listing schema.  A source that fails does not stop the others: plan-time
failures (missing folder, schema mismatch) are caught while building,
and ``stage_each`` writes every source separately so an execution-time
failure of one source loses only that source's rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

Adapter = Callable[[SparkSession, str], DataFrame]


@dataclass
class SourceRegistry:
    adapters: dict[str, Adapter] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, adapter: Adapter) -> None:
        """Register in priority order: earlier sources win deduplication."""
        self.adapters[name] = adapter

    def names(self) -> list[str]:
        return list(self.adapters)

    def build_all(self, spark: SparkSession, root: str) -> dict[str, DataFrame]:
        """Plan every source; a source that fails to plan is logged and skipped."""
        frames: dict[str, DataFrame] = {}
        for name, adapter in self.adapters.items():
            try:
                df = adapter(spark, root)
                df.schema  # force analysis now, inside the guard
                frames[name] = df
            except Exception as e:  # noqa: BLE001 - isolation is the point
                self.failures[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
                log.error("source %s failed to plan: %s", name, self.failures[name])
        return frames

    def stage_each(self, spark: SparkSession, root: str, stage_dir: str) -> dict[str, str]:
        """Write each source's rows to ``stage_dir/source=<name>``; a source
        that fails while running is logged and left out."""
        written: dict[str, str] = {}
        for name, df in self.build_all(spark, root).items():
            path = f"{stage_dir.rstrip('/')}/source_stage={name}"
            try:
                df.write.mode("overwrite").parquet(path)
                written[name] = path
            except Exception as e:  # noqa: BLE001
                self.failures[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
                log.error("source %s failed to run: %s", name, self.failures[name])
        return written
