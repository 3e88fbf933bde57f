"""One run over a landed folder: every source -> staged audit table ->
cross-source dedup -> listings, sheet, summary and audit outputs.

Execution plan and why:

1. Each source adapter is planned and **written on its own** to a stage
   folder under ``spark.checkpoint.dir`` (``SourceRegistry.stage_each``).
   A source that fails is logged and left out, and the heavy page parsing
   runs exactly once.  The stage is on the cluster's shared checkpoint
   storage, so a lost executor only recomputes its own tasks and later
   steps read files, not a long lineage.
2. The staged sources are read back (narrow columns, no HTML) and unioned.
3. Accepted rows go through W1 (aggregate + join, skew-safe); duplicates
   become ``reject_reason = 'duplicate'``.
4. Outputs are written under ``run_ts=<stamp>`` partitions.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import windows
from ..sources import sinks
from ..sources.adapters import classifieds, js_pages, rental_pages, search_json, unit_api
from ..sources.adapters.common import AUDIT_COLUMNS
from ..session import scratch_dir, scratch_under
from ..sources.registry import SourceRegistry

log = logging.getLogger(__name__)


def default_registry(run_ts: dt.datetime) -> SourceRegistry:
    reg = SourceRegistry()
    for module in (unit_api, classifieds, rental_pages, search_json, js_pages):
        reg.register(module.SOURCE, lambda spark, root, m=module: m.build(spark, root, run_ts))
    return reg


def classify(staged: DataFrame, limit_per_source: int | None = None) -> DataFrame:
    """Dedup the accepted rows; every input row comes out once with its reason."""
    accepted = staged.where(F.col("reject_reason").isNull())
    rejected = staged.where(F.col("reject_reason").isNotNull())
    if limit_per_source is not None:
        # Test mode: the first n listings per source, before dedup.
        accepted = windows.top_n_per_group(accepted, "source", "src_pos", limit_per_source)
    marked = windows.mark_cross_source_duplicates(accepted)
    marked = marked.withColumn("reject_reason", F.when(F.col("is_duplicate"), F.lit("duplicate"))).drop("is_duplicate")
    return rejected.unionByName(marked.select(*AUDIT_COLUMNS))


def run(spark: SparkSession, landed_root: str, out_dir: str, run_ts: dt.datetime | None = None,
        limit_per_source: int | None = None, registry: SourceRegistry | None = None) -> dict:
    run_ts = (run_ts or dt.datetime.now()).replace(microsecond=0)
    reg = registry or default_registry(run_ts)
    stage_dir = scratch_dir(spark, f"stage-{sinks.run_stamp(run_ts)}")
    with scratch_under(stage_dir):
        return _run(spark, landed_root, out_dir, run_ts, limit_per_source, reg, stage_dir)


def _run(spark, landed_root, out_dir, run_ts, limit_per_source, reg, stage_dir) -> dict:
    written = reg.stage_each(spark, landed_root, stage_dir)
    result = {"run_ts": run_ts, "sources": list(written), "failures": dict(reg.failures)}
    if not written:
        log.warning("no source produced rows")
        return result
    staged = spark.read.parquet(*written.values())
    classified_dir = f"{stage_dir}/classified"
    classify(staged, limit_per_source).write.mode("overwrite").parquet(classified_dir)
    result["outputs"] = sinks.write_outputs(spark.read.parquet(classified_dir), out_dir, run_ts)
    # What was staged has served; after a failure it stays for a look.
    sinks.delete_folder(spark, stage_dir)
    return result


def main(argv: list[str] | None = None) -> None:
    import argparse

    from ..session import local_session

    p = argparse.ArgumentParser(description="Build the listings table from a landed folder.")
    p.add_argument("landed_root")
    p.add_argument("out_dir")
    p.add_argument("--test", action="store_true", help=f"at most {K.TEST_MODE_LIMIT} listings per source")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    print(run(spark, a.landed_root, a.out_dir, limit_per_source=K.TEST_MODE_LIMIT if a.test else None))


if __name__ == "__main__":
    main()
