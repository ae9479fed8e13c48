"""Fusing ranked lists by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(lists: list[DataFrame], limit: int = 5, constant: int = 60) -> DataFrame:
    """``id, score`` of the best ids of several ranked lists (``id, rank``, ranks from 0).

    An id scores 1 / (constant + rank) in each list that has it. Equal scores keep the order in
    which the ids appear first, list after list.
    """
    tagged = [r.select("id", F.lit(k).alias("list"), "rank") for k, r in enumerate(lists)]
    both = reduce(DataFrame.union, tagged)
    scored = both.groupBy("id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return scored.select("id", F.round("score", 9).alias("score"), "seen").orderBy(F.desc("score"), "seen", "id").limit(limit).select("id", "score")


def ranked(best: DataFrame, *order) -> DataFrame:
    """``id, rank`` from 0 of a short list, such as the result of a top-k."""
    window = Window.partitionBy(F.lit(0)).orderBy(*order)
    return best.select("id", (F.row_number().over(window) - 1).alias("rank"))
