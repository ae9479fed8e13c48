"""Session helpers: tables, checkpoints and defaults that follow the data's size."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "symweave", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SYMWEAVE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a session, in case they can't import it.

    Batches for Python are bounded in bytes, unless the session says how: 10,000 long texts are gigabytes.
    """
    context = spark.sparkContext
    if getattr(context, "_symweave_shipped", False):
        return
    if not context.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(64 * 1024 * 1024))
    package = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="symweave-package-"))
    context.addPyFile(shutil.make_archive(str(to / "symweave"), "zip", package.parent, package.name))
    context._symweave_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and all executors are on this machine, as in tests, a temporary
    folder of this machine is used; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="symweave-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Cut lineage: write the rows to a table in the shared folder and read it from there.

    Unlike a checkpoint, the table carries no constraints of the plan that made it (which double
    with every round of a loop) and has its true size. With ``by`` it has a folder for each value
    of these columns. It goes with the :func:`scratch` around it, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symweave-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._symweave_cut = path
    if (open_ := _scratch.get()) is not None:
        open_.append(table)
    return table


def is_cut(df: DataFrame) -> bool:
    """Whether the rows are just those of a table that :func:`cut` has written."""
    return "_symweave_cut" in vars(df)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that :func:`cut` writes within, at its end, but for those given to the function it yields."""
    outer, mine = _scratch.get(), []
    token = _scratch.set(mine)
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        if outer is not None:
            outer.append(table)
        return table

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for table in mine:
            if not any(table is k for k in kept):
                fs, at = _hadoop(table.sparkSession, table._symweave_cut)
                fs.delete(at, True)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many parts of about ``per_part`` rows hold ``rows`` rows."""
    return max(least, math.ceil(rows / per_part))
