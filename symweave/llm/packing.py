"""Filling containers of fixed capacity with texts, by the sum-of-squares rule.

Each text, measured in tokens, is placed into the open container whose choice leaves the least
sum, over all levels, of the squared number of containers filled to that level. The numbers are
kept in an array by level. Texts are dealt to shards, each of which is packed by itself; what the
shards leave partly filled is dealt to new shards and packed again, as often as that helps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import cut, parts_for

try:
    import public_tokenizers

    BYTE_BPE: str | None = public_tokenizers.path("byte_bpe_50k.tiktoken")
    PATTERN = public_tokenizers.PATTERN
except ImportError:  # the path is a parameter
    BYTE_BPE = None
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens`` of the documents that have any tokens.

    ``ranks_path`` is a file of byte-pair ranks that every executor can read. Null and empty texts
    have no tokens and need no container.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in b["text"]]})

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, "doc_id bigint, n_tokens bigint").where("n_tokens > 0")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, in the given order, and the fill of each container.

    Sizes must lie between 1 and the capacity. Filling a container from level h to h + s changes
    the sum of squares by 2 (n[h + s] - n[h] + 1), a new container by 2 n[s] + 1; full ones don't
    count. Of equal choices the fullest is taken.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    placed = np.empty(len(sizes), np.int64)
    none = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        rest = capacity - s  # the highest level that has room
        best, level = (2 * n[s] + 1 if s < capacity else 0), 0
        if rest:
            here = n[1 : rest + 1]
            change = np.where(here > 0, n[1 + s : capacity + 1] - here, none)
            change[-1] = -here[-1] if here[-1] else none  # it becomes full
            k = rest - 1 - int(change[::-1].argmin())
            if change[k] != none:
                by = 2 * int(change[k]) + (2 if k < rest - 1 else 1)
                if by <= best:
                    best, level = by, k + 1
        if level:
            c = open_at[level].pop()
            n[level] -= 1
        else:
            c = len(fill)
            fill.append(0)
        fill[c] += s
        placed[i] = c
        if fill[c] < capacity:
            n[fill[c]] += 1
            open_at[fill[c]].append(c)
    return placed, np.array(fill, np.int64)


def joined(fill: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Containers put together where they fit: of each its new container, and the fill of each new one.

    The fuller come first, each into the fullest that has room. What the rule of squares keeps open
    for items to come isn't needed once all have come.
    """
    order = np.argsort(-fill, kind="stable")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = np.zeros(capacity + 1, bool)
    to, out = np.empty(len(fill), np.int64), []
    for c, f in zip(order.tolist(), fill[order].tolist()):
        room = held[1 : capacity - f + 1]
        back = int(room[::-1].argmax()) if len(room) and room.any() else -1
        level = len(room) - back if back >= 0 else 0
        if level:
            k = open_at[level].pop()
            held[level] = bool(open_at[level])
        else:
            k = len(out)
            out.append(0)
        out[k] += f
        to[c] = k
        if out[k] < capacity:
            open_at[out[k]].append(k)
            held[out[k]] = True
    return to, np.array(out, np.int64)


def _packed(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    """Items (``item, size``) of one shard with their containers, larger items first."""
    items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    capacity = int(items["capacity"].iloc[0])
    placed, fill = sum_of_squares(items["size"].to_numpy(), capacity)
    to, fill = joined(fill, capacity)
    placed = to[placed]
    return pd.DataFrame(
        {
            "budget_id": items["budget_id"],
            "capacity": capacity,
            "item": items["item"],
            "container": (np.int64(items["shard"].iloc[0]) << 31) + placed,
            "fill": fill[placed],
        }
    )


_OUT = "budget_id int, capacity int, item bigint, container bigint, fill bigint"


def _pack(items: DataFrame, counts: dict[int, int], shard_items: int, first: int) -> tuple[DataFrame, int]:
    """The items packed in shards of about ``shard_items``, numbered from ``first``; and the next free number.

    ``counts`` has the number of items of each budget. Of each item the container's number is
    unlike all others of its budget, below 2^32 shards in all.
    """
    shards = {budget: parts_for(n, shard_items) for budget, n in counts.items()}
    of_budget = F.lit(1)
    for budget, n in shards.items():  # a few settings
        of_budget = F.when(F.col("budget_id") == budget, n).otherwise(of_budget)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), of_budget) + F.lit(first))
    return dealt.groupBy("budget_id", "shard").applyInPandas(_packed, _OUT), first + max(shards.values(), default=1)


def pack_documents(documents: DataFrame, budgets: DataFrame, ranks_path: str, *, shard_items: int = 50_000) -> DataFrame:
    """``budget_id, container_id, doc_id, part, n_tokens``: where the documents' tokens lie.

    A text is split only if it alone exceeds the capacity: into full containers and a rest, which
    is placed like any other text. Copies are placed each. Null and empty texts need no place.
    Rows of ``budgets`` (``budget_id, capacity``) whose capacity is null or below 1 are left out,
    of several capacities of one budget the least counts; with no documents or no budgets there are no rows.
    """
    counts = cut(token_counts(documents, ranks_path))
    wanted = budgets.where("capacity >= 1 and budget_id is not null").groupBy("budget_id").agg(F.min("capacity").alias("capacity")).collect()  # a few settings
    each = F.array(*[F.struct(F.lit(b["budget_id"]).cast("int").alias("budget_id"), F.lit(b["capacity"]).cast("int").alias("capacity")) for b in wanted])
    sized = counts.select("doc_id", "n_tokens", F.inline(each)) if wanted else counts.selectExpr("doc_id", "n_tokens", "1 as budget_id", "1 as capacity").limit(0)
    # Parts 0, 1, ... of a text: all but the last are whole containers.
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("bigint")
    rest = (F.col("n_tokens") - last * F.col("capacity")).alias("size")
    items = sized.select("budget_id", "capacity", F.col("doc_id").alias("item"), last.alias("last"), rest)
    whole = items.where("last > 0").select("budget_id", "capacity", "item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - 1)).alias("part"))
    whole_rows = whole.select(
        "budget_id",
        F.concat_ws("-", F.lit("w"), "item", "part").alias("container_id"),
        F.col("item").alias("doc_id"),
        "part",
        F.col("capacity").cast("bigint").alias("n_tokens"),
    )
    per_budget = dict.fromkeys((b["budget_id"] for b in wanted), counts.count())
    packed, shard = _pack(items.select("budget_id", "capacity", "item", "size"), per_budget, shard_items, 0)
    names = cut(packed)
    # What is left partly filled is packed again, a container being an item of its fill: the containers
    # of each budget until one shard was enough for them, or another round lessens them by less than a twentieth.
    open_ = [b for b, n in per_budget.items() if n > shard_items]
    while open_:
        partly = names.where(F.col("budget_id").isin(open_) & (F.col("fill") < 0.98 * F.col("capacity")))
        partly = partly.select("budget_id", "capacity", F.col("container").alias("item"), F.col("fill").alias("size")).distinct()
        before = {r["budget_id"]: r["count"] for r in partly.groupBy("budget_id").count().collect()}  # a row for each budget
        if not before:
            break
        packed, shard = _pack(partly, before, shard_items, shard)
        again = cut(packed.select("budget_id", F.col("item").alias("container"), F.col("container").alias("to"), F.col("fill").alias("filled")))
        after = {r["budget_id"]: r["n"] for r in again.groupBy("budget_id").agg(F.countDistinct("to").alias("n")).collect()}
        names = cut(
            names.join(again, ["budget_id", "container"], "left").select(
                "budget_id", "capacity", "item", F.coalesce("to", "container").alias("container"), F.coalesce("filled", "fill").alias("fill")
            )
        )
        open_ = [budget for budget, n in before.items() if n > shard_items and after[budget] <= 0.95 * n]
    rows = names.join(items.select("budget_id", "item", "last", "size"), ["budget_id", "item"]).select(
        "budget_id", F.concat_ws("-", F.lit("c"), "container").alias("container_id"), F.col("item").alias("doc_id"), F.col("last").alias("part"), F.col("size").alias("n_tokens")
    )
    return whole_rows.union(rows)


def containers(placements: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget_id, capacity, containers, least, filled``: how many containers are used.

    ``least`` is the number that the tokens would fill without any gap, ``filled`` the share of the
    used containers' room that is filled.
    """
    used = placements.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("fill"))
    sums = used.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
    return sums.join(budgets.select("budget_id", "capacity").distinct(), "budget_id").select(
        "budget_id",
        "capacity",
        "containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"),
    )
