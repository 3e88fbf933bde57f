"""Sinks: presentation table, summary, run-stamped output, reject audit (K1-K4)."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.flags import yes_no_text
from ..operators.aggregates import counts_with_total, dedup_removed_count, funnel_counts
from ..schema import FLAG_COLUMNS, LISTING_COLUMNS

__all__ = ["FLAG_COLUMNS", "present_listings", "summary_rows", "write_run_stamped", "write_outputs"]

NUMERIC_COLUMNS = ("price_eur_month", "size_m2", "price_per_m2")


def present_listings(listings: DataFrame) -> DataFrame:
    """K1: the 21 presentation columns with their labels, in sheet order.

    Flags read Yes/No/empty, numbers are numbers, the run time has minute
    precision.  Sorting for display is the caller's (``output_order``).
    """
    out = []
    for label, name in K.PRESENT_COLUMNS:
        c = F.col(name)
        if name in FLAG_COLUMNS:
            c = yes_no_text(c)
        elif name in NUMERIC_COLUMNS:
            c = c.cast("double")
        elif name == "scraped_on":
            c = F.date_format(c, "yyyy-MM-dd HH:mm")
        out.append(c.alias(label))
    return listings.select(*out)


def summary_rows(listings: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """K2: (place, section, label, value): run time, total, and count per
    source.  ``place`` is the order in which they are shown: the sources come
    in first-appearance order, by their rank.  One aggregation pass."""
    stamp = run_ts.strftime("%Y-%m-%d %H:%M")
    counts = counts_with_total(listings, "source", "site_rank")
    value = F.col("n_listings").cast("string")

    def line(place, section: str, label, shown):
        return F.struct(place.cast("int").alias("place"), F.lit(section).alias("section"), label.alias("label"), shown.alias("value"))

    heads = F.array(line(F.lit(-2), "run", F.lit(K.SUMMARY_LABELS["run"]), F.lit(stamp)),
                    line(F.lit(-1), "total", F.lit(K.SUMMARY_LABELS["total"]), value))
    own = F.array(line(F.col("site_rank"), "per_source", F.col("source"), value))
    return counts.select(F.inline(F.when(F.col("is_total"), heads).otherwise(own)))


def run_stamp(run_ts: dt.datetime) -> str:
    return run_ts.strftime("%Y%m%d_%H%M%S")


def _write_nonempty(df: DataFrame, path: str, fmt: str, options: dict) -> bool:
    """Write, and tell whether there were rows; nothing stays of an empty frame.

    The written files tell it.  An Observation would save that look, but its
    figure comes by a listener event: where Spark's event queue is full and
    drops it, the wait for the figure never ends."""
    spark = df.sparkSession
    df.write.format(fmt).options(**options).save(path)
    if spark.read.format(fmt).schema(df.schema).options(**options).load(path).isEmpty():
        delete_folder(spark, path)
        return False
    return True


def write_run_stamped(df: DataFrame, root: str, run_ts: dt.datetime, fmt: str = "parquet", **options) -> str | None:
    """K3: write under ``root/run_ts=<stamp>/``; nothing is written for 0 rows.

    Returns the written folder, or None when the frame is empty.  The rows go
    to a fresh folder first, which tells whether there are any; only a result
    with rows takes the place of an earlier one of the same run (``commit``),
    so a retry that finds nothing leaves what is there.  Reading ``root``
    gives ``run_ts`` back as a partition column.
    """
    root = root.rstrip("/")
    recover(df.sparkSession, root)
    path = f"{root}/run_ts={run_stamp(run_ts)}"
    fresh = f"{root}/_fresh-{uuid.uuid4().hex[:12]}"
    if not _write_nonempty(df, fresh, fmt, options):
        return None
    commit(df.sparkSession, root, {fresh: path})
    return path


# --- commit -------------------------------------------------------------------
# Folders cannot be swapped together.  What decides is one small file, the commit pointer: it names every fresh folder
# and the place it belongs to, and appears by one rename.  Before it appears the earlier outputs are untouched; once it
# is there, all of the new set counts, wherever the moves have got to: a reader looks a folder up with ``current_path``,
# and the next writer finishes the moves (``recover``).

POINTER = "_commit-"


def commit(spark, root: str, moves: dict[str, str]) -> None:
    """Put fresh folders in their places, all or none."""
    name = uuid.uuid4().hex[:12]
    pointer = f"{root.rstrip('/')}/{POINTER}{name}"
    fs, draft, final = _folder(spark, f"{root.rstrip('/')}/_draft-{name}", pointer)
    out = fs.create(draft, False)
    out.write(json.dumps(moves).encode())
    out.close()
    _move(fs, draft, final)
    _finish(spark, pointer, moves)


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def _finish(spark, pointer: str, moves: dict[str, str]) -> None:
    """The moves that a pointer names, as far as they are not done yet."""
    for fresh, path in moves.items():
        fs, new, place, old = _folder(spark, fresh, path, f"{fresh}-old")
        if fs.exists(new):
            if fs.exists(place):
                _move(fs, place, old)
            fs.mkdirs(place.getParent())
            _move(fs, new, place)
    for fresh in moves:
        delete_folder(spark, f"{fresh}-old")
    delete_folder(spark, pointer)


def _pointers(spark, root: str) -> dict[str, dict[str, str]]:
    fs, pattern = _folder(spark, f"{root.rstrip('/')}/{POINTER}*")
    found = {}
    for status in fs.globStatus(pattern) or []:
        source = fs.open(status.getPath())
        text = bytes(source.readAllBytes()).decode()
        source.close()
        found[status.getPath().toString()] = json.loads(text)
    return found


def recover(spark, root: str) -> None:
    """Finish what a killed writer had committed."""
    for pointer, moves in _pointers(spark, root).items():
        _finish(spark, pointer, moves)


def current_path(spark, root: str, path: str) -> str:
    """Where the current rows of ``path`` are: in the fresh folder while a
    committed move is not done, else in place."""
    for moves in _pointers(spark, root).values():
        for fresh, place in moves.items():
            fs, folder = _folder(spark, fresh)
            if place == path and fs.exists(folder):
                return fresh
    return path


def _folder(spark, *paths: str):
    jvm = spark.sparkContext._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return (found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *found)


def delete_folder(spark, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def write_outputs(staged: DataFrame, out_dir: str, run_ts: dt.datetime) -> dict[str, str | None]:
    """Write listings, presentation CSV, summary, audit, funnel counts (A5)
    and the dedup counts (A4) from one staged table, and commit them as one
    set.  A retry without listings leaves an earlier set that has some.

    ``staged`` holds every candidate with ``reject_reason`` (NULL = kept);
    it is read back from storage, so each output is a cheap scan.
    """
    spark, out_dir, stamp = staged.sparkSession, out_dir.rstrip("/"), run_stamp(run_ts)
    recover(spark, out_dir)
    kept = staged.where(F.col("reject_reason").isNull()).select(*LISTING_COLUMNS)
    offered = staged.where(F.col("reject_reason").isNull() | (F.col("reject_reason") == "duplicate")) \
        .select((F.coalesce(F.col("reject_reason"), F.lit("")) == "duplicate").alias("is_duplicate"))
    places = {name: f"{out_dir}/{name}/run_ts={stamp}" for name in ("listings", "audit", "funnel", "dedup", "sheet", "summary")}
    fresh = f"{out_dir}/_fresh-{uuid.uuid4().hex[:12]}"
    written: dict[str, str | None] = {}

    def write(name: str, df: DataFrame, fmt: str = "parquet", **options) -> None:
        if _write_nonempty(df, f"{fresh}/{name}", fmt, options):
            written[name] = f"{fresh}/{name}"

    write("listings", kept)
    fs, earlier = _folder(spark, places["listings"])
    if "listings" not in written and fs.exists(earlier):
        return dict.fromkeys(places)
    write("audit", staged.where(F.col("reject_reason").isNotNull()))
    write("funnel", funnel_counts(staged))
    write("dedup", dedup_removed_count(offered))
    if "listings" in written:
        write("sheet", present_listings(kept.orderBy("site_rank", "src_pos")), "csv", header=True)
        write("summary", summary_rows(kept, run_ts))
    commit(spark, out_dir, {path: places[name] for name, path in written.items()})
    delete_folder(spark, fresh)
    return {name: path if name in written else None for name, path in places.items()}
