"""Pick up landed crawl runs with Structured Streaming.

The reference has no stream: each crawl is one batch with its own output.
Here a landing process appends one JSON line per finished run to a
manifest folder (``{"run_id", "landed_root", "run_ts"}``).  A streaming
query over that folder, with a checkpoint, hands each new run to the
batch job exactly once; ``trigger(availableNow=True)`` processes what has
landed and stops, so it can be scheduled like a batch.

The micro-batch holds manifest rows (one per run), not listing data; the
runs are started one after another because each is a full Spark job.
Run outputs overwrite only their own ``run_ts=`` folders, so a replayed
micro-batch after a failure rewrites the same folders instead of
duplicating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import batch_run

MANIFEST_SCHEMA = "run_id STRING, landed_root STRING, run_ts TIMESTAMP"


def watch_landed_runs(spark: SparkSession, manifest_dir: str, out_dir: str, checkpoint_dir: str,
                      limit_per_source: int | None = None, available_now: bool = True):
    """Start the query; returns the ``StreamingQuery``.  ``checkpoint_dir`` must
    be the same at every start: it is what makes a run picked up once."""
    manifest = spark.readStream.schema(MANIFEST_SCHEMA).json(manifest_dir)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        runs = batch.where(F.col("landed_root").isNotNull()).dropDuplicates(["run_id"]).orderBy("run_ts", "run_id")
        for r in runs.toLocalIterator():
            batch_run.run(batch.sparkSession, r["landed_root"], out_dir, r["run_ts"], limit_per_source)

    writer = manifest.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
