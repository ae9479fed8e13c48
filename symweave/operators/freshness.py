"""Which files of a tree are new, changed, current or gone, and counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.schemas import LARGE_FILE


def compared(stored: DataFrame, current: DataFrame, *, by_checksum: bool = True) -> DataFrame:
    """``file_path, status`` of all stored and current files (``file_path, file_size, mtime_ns, checksum``).

    A file whose size and time are as stored is ``current``. Else, if its checksum is, it is
    ``touched`` (only with ``by_checksum``), else ``stale``. A file that isn't stored is ``new``,
    one that isn't there any more ``gone``. Nulls equal nulls, except for checksums.
    """
    old = stored.select("file_path", *[F.col(c).alias("_" + c) for c in ("file_size", "mtime_ns", "checksum")], F.lit(True).alias("_old"))
    new = current.select("file_path", "file_size", "mtime_ns", "checksum", F.lit(True).alias("_new"))
    same = F.col("file_size").eqNullSafe(F.col("_file_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime_ns"))
    status = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when(same, "current")
    if by_checksum:
        status = status.when(F.col("checksum") == F.col("_checksum"), "touched")
    return old.join(new, "file_path", "full").select("file_path", status.otherwise("stale").alias("status"), "file_size")


def run_counts(status: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """One row of counts over the rows of :func:`compared`: what a build would do."""
    is_ = lambda *names: F.col("status").isin(*names)
    big = F.coalesce(F.col("file_size") >= large, F.lit(False))
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    return status.agg(
        n(~is_("gone"), "files"),
        n(is_("new", "stale") & ~big, "indexed"),
        n(is_("new", "stale") & big, "large_skipped"),
        n(is_("current", "touched"), "unchanged"),
        n(is_("gone"), "pruned"),
    )
