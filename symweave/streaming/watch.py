"""Continuous refresh: change events, debounced, applied to the store in micro-batches."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symweave.functions.paths import language_of
from symweave.operators.freshness import compared

EVENTS = "file_path string, event string, at timestamp"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events (``file_path, event, at``) from JSON files that land in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def relevant(events: DataFrame) -> DataFrame:
    """The events of files in a known language."""
    return events.where(language_of(F.col("file_path")).isNotNull())


def bursts(events: DataFrame, gap: str = "500 milliseconds", *keys: str) -> DataFrame:
    """``keys, started, ended, events``: runs of events with no pause as long as the gap.

    For a stream, give it a watermark before and at least one key.
    """
    window = F.session_window("at", gap).alias("burst")
    return events.groupBy(*keys, window).agg(F.count("*").alias("events")).select(
        *keys, F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "events"
    )


def last_events(batch: DataFrame) -> DataFrame:
    """The last event of each file; of several at one time, a deletion counts last."""
    last = F.max(F.struct("at", (F.col("event") == "deleted").alias("gone"), "event")).alias("last")
    return batch.groupBy("file_path").agg(last).select("file_path", F.col("last.event").alias("event"))


def snapshot_events(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """``file_path, event, at``: what has changed between the stored files and a listing of the tree."""
    names = F.create_map(*[F.lit(x) for x in ("new", "created", "stale", "modified", "gone", "deleted")])
    found = compared(stored, listing, by_checksum=False).where("status <> 'current'")
    return found.select("file_path", names[F.col("status")].alias("event"), F.current_timestamp().alias("at"))


def isolated(files: DataFrame, apply: Callable[[DataFrame], None], failed: Callable[[str, Exception], None], bit: int = 0) -> None:
    """Apply to all files at once; where that fails, to halves of them, until single files are left, which are told of.

    Halves by the bits of the paths' hashes, one after the other.
    """
    try:
        apply(files)
        return
    except Exception as e:  # noqa: BLE001  whatever one file brings about
        two = [r[0] for r in files.select("file_path").limit(2).collect()]
        if len(two) < 2 or bit == 64:
            for path in two:
                failed(path, e)
            return
    side = F.shiftright(F.xxhash64("file_path"), bit).bitwiseAND(F.lit(1).cast("bigint"))
    for half in (files.where(side == 0), files.where(side == 1)):
        if not half.isEmpty():
            isolated(half, apply, failed, bit + 1)


def _log(path: str, error: Exception) -> None:
    logging.getLogger(__name__).error("%s can't be indexed: %s", path, error)


def watch(
    events: DataFrame,
    reindex: Callable[[DataFrame], None],
    delete: Callable[[DataFrame], None],
    checkpoint: str,
    *,
    every: str = "500 milliseconds",
    once: bool = False,
    failed: Callable[[str, Exception], None] = _log,
) -> StreamingQuery:
    """Apply a stream of events: changed files to ``reindex``, deleted ones to ``delete``.

    Both get a DataFrame of ``file_path``. Each micro-batch keeps the last event of a file only.
    A file that fails is told of and left out, so that it doesn't hold up the others. A batch that
    is cut short is tried again from the checkpoint; both callbacks replace by file, so that doing one twice
    changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = last_events(batch).persist()
        try:
            changed, gone = (last.where(c).select("file_path") for c in ("event <> 'deleted'", "event = 'deleted'"))
            if not gone.isEmpty():
                isolated(gone, delete, failed)
            if not changed.isEmpty():
                isolated(changed, reindex, failed)
        finally:
            last.unpersist()

    writer = relevant(events).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
