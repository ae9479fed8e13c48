"""The most similar vectors for every vector of a collection.

Vectors are compressed by additive quantisation (see :mod:`symweave.llm.additive`). Each vector
is sent to the regions of its nearest cells, once to each region; there it is a candidate for the
vectors whose own cell is one of those. Candidates are scored by table lookup on their codes, and
the best are ranked again by exact distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.additive import Codebooks, search, train
from symweave.session import cut

_CODEC = "zstd"


def pack(x: np.ndarray) -> bytes:
    """A matrix of floats, compressed without loss: first all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(x.astype(np.float32).view(np.uint8).reshape(-1, 4).T)
    return pa.Codec(_CODEC, compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows:
        return np.zeros((0, width), np.float32)
    raw = pa.Codec(_CODEC).decompress(data, decompressed_size=rows * width * 4, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.float32).reshape(rows, width)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column, and whether each row is usable.

    Usable is a vector that isn't null, has ``width`` finite elements and isn't all zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = lengths == width
    if not good.any():
        return np.zeros((0, width), np.float32), good
    values = column.filter(pa.array(good)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = values.astype(np.float32, copy=False).reshape(-1, width)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    good[np.flatnonzero(good)[~fine]] = False
    return x[fine], good


def fit(vectors: DataFrame, width: int, *, sample_rows: int, cell_rows: int, region_rows: int, levels: int, entries: int) -> Codebooks | None:
    """Codebooks from about ``sample_rows`` usable vectors, at most twice as many, chosen by the hash of their id.

    Repeats of an id count once in each task. At most a twelfth of the sample are coarse cells; where the rows need more cells of about
    ``cell_rows``, cells are told apart by the first places of the code too.
    """
    rows = vectors.count()
    share = min(1.0, sample_rows / max(1, rows))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeats of an id are one row, so that the bound holds however often it is repeated
        for b in batches:
            x, good = matrix(b.column(1), width)
            ids = b.column(0).to_numpy(zero_copy_only=False)[good].tolist()
            new = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]
            yield pa.record_batch([pa.array([pack(x[new])], pa.binary()), pa.array([len(new)], pa.int32())], ["x", "n"])

    while True:
        chosen = vectors.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else vectors
        parts = [unpack(bytes(r["x"]), r["n"], width) for r in chosen.select("id", "embedding").mapInArrow(only, "x binary, n int").collect()]
        sample = np.unique(np.concatenate([np.zeros((0, width), np.float32), *parts]), axis=0)
        if share == 1.0 or len(sample) >= sample_rows // 4:
            break
        share = min(1.0, 8 * share)  # few of the rows are usable or different
    if not len(sample):
        return None
    cells = max(1, min(len(sample) // 12, math.ceil(rows / cell_rows)))
    depth = 0
    while cells * entries**depth * 4 * cell_rows < rows and depth < levels:
        depth += 1
    return train(sample, cells, levels=levels, entries=min(entries, len(sample)), depth=depth, rows=rows, region_rows=region_rows)


_BLOCK = "region int, part int, n int, ids binary, h binary, several binary, home binary, cells binary, codes binary, norms binary, x binary"
#: So many vectors are held, at least, before they are dealt to their regions; twice as many at most.
_LOT = 16_384


def _blocks(books: Codebooks, width: int, spill: int, beam: int, reach: float):
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    types = [pa.int32()] * 3 + [pa.binary()] * 8

    def encoded(b: pa.RecordBatch) -> list[np.ndarray]:
        """Of each usable vector, equal ones once: id, hash, whether it has several ids, regions, cells, codes, norm, the vector."""
        x, good = matrix(b.column("embedding"), width)
        ids = b.column("id").to_numpy(zero_copy_only=False)[good]
        h = b.column("h").to_numpy(zero_copy_only=False)[good]
        order = np.lexsort((ids, h))
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]][: len(h)])
        last = np.r_[first[1:], len(h)] - 1
        several = (ids[order][first] != ids[order][last]) if len(h) else np.zeros(0, bool)
        kept = order[first] if len(h) else order
        x, ids, h = x[kept], ids[kept], h[kept]
        parts = []
        for a in range(0, len(x), 512):  # what is computed of so many stays in the cache
            codes, norms, prefix, far = books.encode(x[a : a + 512], beam, spill)
            near, regions = books.names(prefix)
            off = far > reach * far[:, :1]  # never the nearest one
            near[off], regions[off] = -1, -1
            parts.append((regions.astype(np.int32), near, codes.astype(np.uint16), norms))
        return [ids, h, several, *(np.concatenate(z) for z in zip(*parts)), x] if parts else []

    def dealt(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, h, several, regions, near, codes, norms, x = (np.concatenate(z) for z in zip(*held))
        held.clear()
        # Each vector once in each of its regions.
        ordered = np.sort(regions, axis=1)
        new = (ordered >= 0) & np.c_[np.ones(len(ordered), bool), ordered[:, 1:] != ordered[:, :-1]]
        row, region = np.nonzero(new)[0], ordered[new]
        order = np.argsort(region, kind="stable")
        row, region = row[order], region[order]
        starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        rows = []
        for start, end in zip(starts, np.r_[starts[1:], len(region)]):
            for a in range(start, end, 4096):
                m = row[a : min(end, a + 4096)]
                block = (
                    len(m), ids[m].tobytes(), h[m].tobytes(), several[m].tobytes(),
                    regions[m, 0].tobytes(), near[m].tobytes(), codes[m].tobytes(), norms[m].tobytes(), pack(x[m]),
                )
                rows += [(int(region[a]), part, *block) for part in range(books.tasks[region[a]])]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are dealt in large lots, as with many regions a small one would give rows of one vector each.
        held: list[list[np.ndarray]] = []
        for b in batches:
            for a in range(0, b.num_rows, _LOT):
                if got := encoded(b.slice(a, _LOT)):
                    held.append(got)
                if sum(len(z[0]) for z in held) >= _LOT:
                    yield dealt(held)
        if held:
            yield dealt(held)

    return run


def _read(table: pa.Table, books: Codebooks, width: int) -> dict[str, np.ndarray]:
    rows = table.to_pylist()
    levels = len(books.books)
    n = [r["n"] for r in rows]

    def joined(name: str, kind: type, wide: int = 1) -> np.ndarray:
        got = np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        return got.reshape(sum(n), wide) if wide > 1 else got

    spill = len(rows[0]["cells"]) // 8 // n[0]
    out = {
        "ids": joined("ids", np.int64), "h": joined("h", np.int64), "home": joined("home", np.int32), "several": joined("several", np.bool_),
        "cells": joined("cells", np.int64, spill).reshape(-1, spill), "codes": joined("codes", np.uint16, levels + 1), "norms": joined("norms", np.float32),
    }
    order = np.lexsort((out["ids"], out["h"]))
    h = out["h"][order]
    new = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(new) - 1
    several = np.zeros(int(group[-1]) + 1, bool)
    np.logical_or.at(several, group, out["several"][order])
    ids = out["ids"][order]
    several |= ids[np.flatnonzero(new)] != ids[np.r_[np.flatnonzero(new)[1:], len(h)] - 1]
    kept = order[new]
    to = np.full(len(h), -1)
    to[kept] = np.arange(len(kept))
    x = np.empty((len(kept), width), np.float32)
    at = 0
    for r in rows:  # each at its place at once, as a second matrix might take much memory
        place = to[at : at + r["n"]]
        x[place[place >= 0]] = unpack(r.pop("x"), r["n"], width)[place >= 0]
        at += r["n"]
    return {k: v[kept] for k, v in out.items() if k != "several"} | {"several": several, "x": x}


def _nearest_of(x: np.ndarray, norms: np.ndarray, q: np.ndarray, near: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared distances and places of the ``k`` nearest of each query's shortlist, by distance and id; itself is infinitely far."""
    own, d2 = x[q], norms[near]
    place = np.zeros(len(x), np.intp)
    for a in range(0, len(q), 32):
        listed = near[a : a + 32]
        place[listed] = 1
        some = np.flatnonzero(place)  # the rows of these shortlists, multiplied at once
        place[some] = np.arange(len(some))
        d2[a : a + 32] -= 2 * np.take_along_axis(own[a : a + 32] @ x[some].T, place[listed], 1)
        place[some] = 0
    d2[near == q[:, None]] = np.inf
    few = min(2 * k, d2.shape[1])
    near = np.take_along_axis(near, np.argpartition(d2, few - 1, axis=1)[:, :few], 1)
    exact = np.empty(near.shape)
    for a in range(0, len(q), 4):
        apart = x[near[a : a + 4]].astype(np.float64)
        apart -= own[a : a + 4, None]
        np.einsum("qnd,qnd->qn", apart, apart, out=exact[a : a + 4])
    exact[near == q[:, None]] = np.inf
    rank = np.lexsort((ids[near], exact), axis=1)[:, :k]
    return np.take_along_axis(exact, rank, 1), np.take_along_axis(near, rank, 1)


def _region(books: Codebooks, width: int, k: int, shortlist: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        v = _read(table, books, width)
        region, part = key[0].as_py(), key[1].as_py()
        home, mine = v["cells"][:, 0], (v["home"] == region) & (v["h"] % books.tasks[region] == part)
        exact_norms = (v["x"] ** 2).sum(1)
        posting_cell = v["cells"].ravel()
        order = np.argsort(posting_cell, kind="stable")
        posting_row = order // v["cells"].shape[1]
        sorted_cells = posting_cell[order]
        out: list[list] = [[], [], [], [], [], []]
        jobs, alone = [], []
        for cell in np.unique(home[mine]):
            queries = np.flatnonzero((home == cell) & mine)
            a, b = np.searchsorted(sorted_cells, [cell, cell + 1])
            if b - a < min(len(home), 8 * k):
                alone.append(queries)
            else:
                jobs.append((queries, posting_row[a:b]))
        if alone:  # all of them at once, as they search the whole region
            jobs.append((np.concatenate(alone), np.arange(len(home))))
        for queries, candidates in jobs:
            codes, norms = v["codes"][candidates], v["norms"][candidates]
            for start in range(0, len(queries), 128):
                q = queries[start : start + 128]
                near = candidates[search(books, v["x"][q], codes, norms, min(len(candidates), shortlist + 1))]
                exact, near = _nearest_of(v["x"], exact_norms, q, near, v["ids"], k)
                there = np.isfinite(exact)
                out[0].append(v["h"][q])
                out[1].append(v["ids"][q])
                out[2].append(v["several"][q] | (v["several"][near] & there).any(1))
                out[3].append(v["ids"][near][there])
                out[4].append(exact[there])
                out[5].append(there.sum(1))
        h, ids, expand, near, d2, n = (np.concatenate(z) for z in out) if jobs else (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, float, int))
        ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(z)) for z in (near, d2)]
        return pa.table([pa.array(h), pa.array(ids), pa.array(expand), *lists], ["h", "id", "expand", "near", "d2"])

    return run


def nearest(
    vectors: DataFrame,
    *,
    width: int,
    k: int = 10,
    spill: int = 3,
    reach: float = 1.4,
    shortlist: int = 400,
    beam: int = 2,
    levels: int = 16,
    entries: int = 32,
    sample_rows: int = 30_000,
    cell_rows: int = 100,
    region_rows: int = 12_000,
) -> DataFrame:
    """``id, neighbour``: of each id of ``id, embedding`` the ``k`` nearest others, nearly always.

    By Euclidean distance, the smaller id first among equal distances. Only usable vectors count
    (:func:`matrix`); an id that is given repeatedly, with the same vector, counts once. The
    codebooks are fitted on a sample of about ``sample_rows`` rows; every row is indexed and is a
    query. A vector is a candidate in its nearest cell and in those of the ``spill`` nearest whose
    squared distance is at most ``reach`` times as great. Equal vectors are searched for once, and
    their ids put in afterwards. No rows give no rows.
    """
    vectors = vectors.where("id is not null and embedding is not null")
    books = fit(vectors, width, sample_rows=sample_rows, cell_rows=cell_rows, region_rows=region_rows, levels=levels, entries=entries)
    if books is None:
        return vectors.select("id", F.col("id").alias("neighbour")).limit(0)
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # bounded by the sample, whatever the data
    hashed = vectors.select("id", F.xxhash64("embedding").alias("h"), "embedding")
    blocks = hashed.mapInArrow(lambda b: _blocks(shared.value, width, spill, beam, reach)(b), _BLOCK)
    found = cut(
        blocks.repartition(4 * int(books.tasks.sum()), "region", "part")
        .groupBy("region", "part")
        .applyInArrow(
            lambda key, t: _region(shared.value, width, k, shortlist)(key, t),
            "h bigint, id bigint, expand boolean, near array<bigint>, d2 array<double>",
        )
    )
    plain = found.where("not expand").select("id", F.explode("near").alias("neighbour"))
    return plain.union(_expanded(found.where("expand"), hashed.select("id", "h"), k))


def _expanded(found: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The neighbours where the vector or some near one has several ids."""
    # Vectors with several ids, each id once, with the smallest id as the vector's name.
    copies = cut(ids.distinct().join(ids.groupBy("h").agg(F.min("id").alias("name"), F.max("id").alias("most")).where("name < most"), "h"))
    ranked = copies.select("name", "id", F.expr("row_number() over (partition by name order by id)").alias("at")).where(F.col("at") <= k + 1)
    first = ranked.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    near = found.select("id", F.explode(F.arrays_zip("near", "d2")).alias("n")).select("id", F.col("n.near").alias("name"), F.col("n.d2").alias("d2"))
    own = found.select("id", F.col("id").alias("name"), F.lit(0.0).alias("d2"))
    near = near.union(own).join(first, "name", "left").select("id", "d2", F.explode(F.coalesce("ids", F.array("name"))).alias("other"))
    # At most (k + 1)^2 of each vector, of which the k + 1 best may include the asking id.
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "other"))), 1, k + 1).alias("best"))
    asking = best.join(copies.select(F.col("name").alias("id"), F.col("id").alias("copy")), "id", "left")
    asking = asking.select(F.coalesce("copy", "id").alias("id"), F.col("best.other").alias("best"))
    return asking.select("id", F.explode(F.slice(F.array_except("best", F.array("id")), 1, k)).alias("neighbour"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """``symbol_id_a, symbol_id_b``, a < b: the pairs of which one at least is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("symbol_id_a"), F.greatest("id", "neighbour").alias("symbol_id_b")).distinct()
