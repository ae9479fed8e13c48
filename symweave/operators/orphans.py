"""References to records that do not exist, with regard to time.

A reference is an orphan if no parent with its key was known when the reference was recorded.
Keys are 64-bit numbers: identifiers as they are, names as hashes that the probe confirms by
comparing the names themselves. The parents' keys are cut into ranges at their quantiles; each
range holds its parents as arrays sorted by key, and batches of references are looked up in
them by binary search. A range with very many references, say of one hot key, is cut into
several chunks that each get the range's parents, so that no task holds more than a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.session import cut, parts_for

NEVER = np.iinfo(np.int64).max


def reference(field: str, ref: Column, key: Column, at: Column, *, named: bool) -> list[Column]:
    """The columns of one kind of reference (or, with ``ref`` null, of parent)."""
    return [
        F.lit(field).alias("field"),
        ref.cast("bigint").alias("ref_id"),
        (F.xxhash64(key) if named else key.cast("bigint")).alias("k"),
        (key if named else F.lit(None).cast("string")).alias("name"),
        at.cast("timestamp_ntz").alias("at"),
    ]


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    """Microseconds; a null counts as never."""
    return column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(NEVER).to_numpy()


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    parents = parents.sort_by("k")
    known, since = parents["k"].to_numpy(), _micros(parents["since"])
    wanted, at = refs["k"].to_numpy(), _micros(refs["at"])
    found = np.zeros(len(wanted), bool)
    if len(known):
        pos = np.searchsorted(known, wanted)
        open_ = np.arange(len(wanted))
        while len(open_):  # more than one round only where hashes of names collide
            here = pos[open_]
            inside = here < len(known)
            open_, here = open_[inside], here[inside]
            same = known[here] == wanted[open_]
            open_, here = open_[same], here[same]
            equal = pc.equal(refs["name"].take(pa.array(open_)), parents["name"].take(pa.array(here)))
            equal = equal.fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
            hit, place = open_[equal], here[equal]
            found[hit] = (since[place] <= at[hit]) & (at[hit] != NEVER)
            open_ = open_[~equal]
            pos[open_] += 1
    return refs.filter(pa.array(~found)).select(["field", "ref_id", "name", "k", "at"])


def orphans(refs: DataFrame, parents: DataFrame, *, range_rows: int = 100_000, chunk_rows: int = 200_000) -> DataFrame:
    """The references (columns of :func:`reference`) without a parent known at their time.

    ``parents`` has ``field, k, name, at``; the earliest ``at`` of a key counts, a null ``at``
    never does. A reference whose own time is null is an orphan, as nothing was known then.
    References with a null key are none and must be left out by the caller. Repeated
    references come out as often as they are given. Empty inputs give empty results or, without
    parents, every reference.
    """
    parents = cut(parents.where("k is not null").groupBy("field", "k", "name").agg(F.min("at").alias("since")))
    counts = parents.groupBy("field").count().collect()  # one row per kind of reference
    bounds: dict[str, np.ndarray] = {}
    for row in counts:
        n = parts_for(row["count"], range_rows)
        cuts = np.linspace(0, 1, n + 1)[1:-1].tolist()
        held = parents.where(F.col("field") == row["field"])
        got = held.agg(F.percentile_approx("k", cuts, max(10_000, 10 * n))).head()[0] if cuts else []
        bounds[row["field"]] = np.unique(np.array(got, dtype=np.int64))
    none = np.array([], dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(field: pd.Series, k: pd.Series) -> pd.Series:
        out = np.zeros(len(k), np.int32)
        for f in field.unique():
            mine = (field == f).to_numpy()
            out[mine] = np.searchsorted(bounds.get(f, none), k[mine].to_numpy(), side="left")
        return pd.Series(out)

    # Written once: the counts and the probe read them, and places in files are the same on every attempt.
    refs = cut(refs.withColumn("rng", range_of("field", "k")))
    parents = parents.withColumn("rng", range_of("field", "k"))
    held = refs.groupBy("field", "rng").count().where(F.col("count") > chunk_rows)
    # A row for every chunk_rows references at most; as a table its size is known, and Spark broadcasts it only if that is small.
    chunks = cut(held.select("field", "rng", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")))
    refs = refs.join(chunks, ["field", "rng"], "left").withColumn(
        "chunk", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("chunks")), F.lit(0)).cast("int")
    )
    parents = parents.join(chunks, ["field", "rng"], "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    )
    keys = ["field", "rng", "chunk"]
    return (
        refs.select("field", "ref_id", "k", "name", "at", "rng", "chunk")
        .groupBy(*keys)
        .cogroup(parents.select("field", "k", "name", "since", "rng", "chunk").groupBy(*keys))
        .applyInArrow(_probe, "field string, ref_id bigint, name string, k bigint, at timestamp_ntz")
    )


def orphan_calls(calls: DataFrame, symbols: DataFrame, externals: DataFrame) -> DataFrame:
    """Calls whose caller or callee was unknown when they were recorded: ``call_id, field, month``.

    ``caller_id`` must be the id of a symbols row, ``callee_name`` (without outer spaces and
    tabs) the name of one or a known external name, each no later than the call. Null callers
    and null or blank callees refer to nothing and are left out. A repeated call counts once per
    month in which it is recorded.
    """
    callee = F.regexp_replace("callee_name", r"^[ \t]+|[ \t]+$", "")
    calls = calls.select("id", "caller_id", callee.alias("callee"), "indexed_at")
    refs = (
        calls.where("caller_id is not null")
        .select(reference("caller_id", F.col("id"), F.col("caller_id"), F.col("indexed_at"), named=False))
        .union(
            calls.where("callee <> ''").select(
                reference("callee_name", F.col("id"), F.col("callee"), F.col("indexed_at"), named=True)
            )
        )
    )
    nobody = F.lit(None).cast("bigint")
    always = F.lit("0001-01-01").cast("timestamp_ntz")
    parents = (
        symbols.select(reference("caller_id", nobody, F.col("id"), F.col("indexed_at"), named=False))
        .union(symbols.select(reference("callee_name", nobody, F.col("name"), F.col("indexed_at"), named=True)))
        .union(externals.where("name is not null").select(reference("callee_name", nobody, F.col("name"), always, named=True)))
    )
    return (
        orphans(refs, parents)
        .select(F.col("ref_id").alias("call_id"), "field", F.date_trunc("month", "at").cast("timestamp_ntz").alias("month"))
        .distinct()
    )
