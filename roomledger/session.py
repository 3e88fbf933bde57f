"""Session helpers: one place that builds a session for tests and scripts,
and resolves the shared folder used for staged tables.

On a cluster the session already exists and carries its own settings;
``scratch_dir`` then reads ``spark.checkpoint.dir`` from it, tries whether
a ``file:`` folder there is shared, and never falls back to a machine-local
folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings the library relies on.  AQE re-plans joins from measured
# shuffle sizes (runtime broadcast only below the threshold) and splits
# skewed partitions; that is how joins whose sides grow with the data are
# kept safe without a size guess at plan time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Remove checkpoints that nothing refers to any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "roomledger") -> SparkSession:
    """A local session for tests, benches and the driver-table checks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ROOMLEDGER_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Folders that were found to be shared; Spark names a new one for each context.
_SHARED: set[str] = set()


def rows_come_back(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds all rows that tasks write under ``folder``.

    The path alone does not tell a mount that all machines share from a disk
    that each machine has for itself.  Of the latter the driver commits and
    lists its own only: a staged table would lose rows without an error.
    """
    from .sources.sinks import delete_folder

    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    path = f"{folder.rstrip('/')}/shared-{uuid.uuid4().hex[:12]}"
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    found = spark.read.schema("id long").parquet(path).count()
    delete_folder(spark, path)
    return found == tasks


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set one only where it is unset.

    A cluster names a shared folder in that setting, which may be a mount
    (``file:``) that all its machines have.  Only a local session (tests, the
    driver's local checks) lacks it, and only there a folder under the system
    temp directory is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    local = (sc.master or "").startswith("local")
    if current:
        if not local and current.startswith("file:") and current not in _SHARED:
            if not rows_come_back(spark, current):
                raise RuntimeError("spark.checkpoint.dir is a machine-local folder; on a cluster it must be shared")
            _SHARED.add(current)
        return current
    if not local:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    current = tempfile.mkdtemp(prefix="roomledger-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_UNDER: ContextVar[str | None] = ContextVar("roomledger_scratch", default=None)


@contextmanager
def scratch_under(folder: str):
    """Within the block ``scratch_dir`` makes its folders in ``folder``, so a
    run can remove all it has staged."""
    token = _UNDER.set(folder)
    try:
        yield folder
    finally:
        _UNDER.reset(token)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a staged table."""
    root = (_UNDER.get() or ensure_checkpoint_dir(spark)).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
