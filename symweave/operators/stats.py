"""Counts over the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.paths import dirname


def status(**tables: DataFrame) -> DataFrame:
    """``table, rows`` of each table."""
    counted = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in sorted(tables.items())]
    return reduce(DataFrame.union, counted)


def languages(files: DataFrame, limit: int = 8) -> DataFrame:
    """The languages with the most files, with a bar of up to 20 in proportion to the first."""
    top = files.where("language is not null").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(limit)
    most = F.max("files").over(Window.partitionBy(F.lit(0)))  # over the few rows of the limit
    return top.select("language", "files", F.floor(20 * F.col("files") / most).cast("int").alias("bar"))


def folders(files: DataFrame) -> DataFrame:
    """Files and symbols of each folder."""
    return files.groupBy(dirname(F.col("file_path")).alias("folder")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("symbols")
    )


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_path, symbols`` of every file, those without any included."""
    counts = symbols.groupBy("file_path").agg(F.count("*").alias("n"))
    return files.select("file_path").distinct().join(counts, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("symbols"))


def ordinals(names: DataFrame, group: str, *order: str) -> DataFrame:
    """The place from 1 of each row in its group. Hot groups are the caller's to avoid."""
    return names.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
