"""The index as Parquet tables in buckets of files, and keyed replacement of what changes.

A change writes new files for the buckets that it touches, then a list of the files that are
current; the others stay as they are. The lists are numbered and never changed, so that a reader
always sees a whole state and keeps the one it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.schemas import CALLS, FILES, LENGTHS, POSTINGS, SYMBOLS, VECTORS

SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "calls": CALLS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}
BUCKETS = 32  # of files, by the hash of the path


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``old`` without the rows of ``keys``, with ``new``: all rows of a key are replaced together."""
    return old.join(keys.select(*on).distinct(), list(on), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upserted(old: DataFrame, new: DataFrame, *on: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or in the place of those with their key."""
    return replaced(old, new, new, *on)


def without_files(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("file_path").distinct(), "file_path", "left_anti").select(*rows.columns)


def touched(files: DataFrame, current: DataFrame) -> DataFrame:
    """Size and time of the files that ``current`` (``file_path, file_size, mtime_ns``) names; the rest as before."""
    now = current.select("file_path", F.col("file_size").alias("_size"), F.col("mtime_ns").alias("_time"), F.lit(True).alias("_there"))
    both = files.join(now, "file_path", "left")
    there = F.coalesce("_there", F.lit(False))
    return both.select(
        *[c for c in files.columns if c not in ("file_size", "mtime_ns")],
        F.when(there, F.col("_size")).otherwise(F.col("file_size")).alias("file_size"),
        F.when(there, F.col("_time")).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
    )


def bucket_of() -> F.Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)).cast("int")


class Store:
    """The tables of an index below a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str, start: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(n for f in self._fs.listStatus(self._path(folder)) if (n := f.getPath().getName()).startswith(start))

    def manifest(self, name: str | None = None) -> dict[str, dict[str, str]]:
        """The version of each bucket of each table, by the latest list or the given one; empty before the first write."""
        lists = self._names("lists", "list-")
        if not lists:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/lists/{name or lists[-1]}").head()[0])

    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows of a table, or of some of its buckets; no rows if there are none yet."""
        found = self.manifest().get(name, {})
        paths = [f"{self.folder}/{name}/{v}/bucket={b}" for b, v in sorted(found.items()) if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def write(self, buckets: Sequence[int] | None = None, **tables: DataFrame) -> None:
        """Put the rows of tables in the place of all they have in these buckets, or of everything; all at once."""
        version, lists = uuid.uuid4().hex, self._names("lists", "list-")
        now = self.manifest()
        for name, rows in tables.items():
            columns = [c.strip().split()[0] for c in SCHEMAS[name].split(", ")]
            rows = rows.select(*columns, bucket_of().alias("bucket")).repartition("bucket")
            if name == "postings":
                rows = rows.sortWithinPartitions("bucket", "term")  # row groups of other terms are skipped
            rows.write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{version}")
            kept = {b: v for b, v in now.get(name, {}).items() if buckets is not None and int(b) not in buckets}
            now[name] = kept | {f.split("=")[1]: version for f in self._names(f"{name}/{version}", "bucket=")}
        number = int(lists[-1].split("-")[1]) + 1 if lists else 0
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.text(f"{self.folder}/list-{version}")
        self._fs.mkdirs(self._path("lists"))
        if not self._fs.rename(self._path(f"list-{version}"), self._path(f"lists/list-{number:012d}")):
            raise RuntimeError("another writer has changed the index meanwhile")

    def _buckets(self, files: DataFrame) -> list[int]:
        return [r[0] for r in files.select(bucket_of().alias("b")).distinct().collect()]  # BUCKETS at most

    def replace_files(self, files: DataFrame, **tables: DataFrame) -> None:
        """Replace everything of the given files, in the tables given and in those that aren't."""
        there = self._buckets(files)
        new = {"files": files, **tables}
        self.write(
            there,
            **{
                name: replaced(self.table(name, there), new.get(name, self.spark.createDataFrame([], schema)), files, "file_path")
                for name, schema in SCHEMAS.items()
            },
        )

    def touch_files(self, seen: DataFrame) -> None:
        """Note size and time of files (``file_path, file_size, mtime_ns``) whose content is as it was."""
        there = self._buckets(seen)
        self.write(there, files=touched(self.table("files", there), seen))

    def delete_files(self, gone: DataFrame) -> None:
        """Delete files with their symbols, calls, vectors and postings."""
        there = self._buckets(gone)
        self.write(there, **{name: without_files(self.table(name, there), gone) for name in SCHEMAS})

    def prune(self, current: DataFrame) -> int:
        """Delete the files that aren't among the current ones; returns how many."""
        gone = self.table("files").join(current.select("file_path"), "file_path", "left_anti").select("file_path")
        n = gone.count()
        if n:
            self.delete_files(gone)
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Remove the versions that none of the last ``keep`` states names; readers of older ones must have ended. Returns how many."""
        lists = self._names("lists", "list-")
        used = {(t, v) for n in lists[-keep:] for t, found in self.manifest(n).items() for v in found.values()}
        old = [f"lists/{n}" for n in lists[:-keep]]
        old += [f"{t}/{v}" for t in SCHEMAS for v in self._names(t, "") if (t, v) not in used]
        for name in old:
            self._fs.delete(self._path(name), True)
        return len(old)
