"""Exact nearest vectors of one query, encoders and the upkeep of the vector table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions.text import embedding_text, folded_tokens

Encoder = Callable[[list[str]], list[list[float]]]


def hashed_encoder(width: int = 384) -> Encoder:
    """A stand-in encoder: words and their parts hashed into unit vectors. It knows no meanings."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for word in folded_tokens(text):
                for part in [word, *(word[i : i + 3] for i in range(max(0, len(word) - 2)))]:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                    v[h % width] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def encoded(symbols: DataFrame, encoder: Encoder, batch: int = 64) -> DataFrame:
    """``symbol_id, embedding`` of each symbol's text, encoded in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                yield pd.DataFrame({"symbol_id": part["symbol_id"], "embedding": encoder(part["text"].tolist())})

    texts = symbols.select(F.col("id").alias("symbol_id"), embedding_text().alias("text"))
    return texts.mapInPandas(run, "symbol_id bigint, embedding array<float>")


def missing(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """The symbols that have no vector."""
    return symbols.join(vectors.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def backfilled(symbols: DataFrame, vectors: DataFrame, encoder: Encoder) -> DataFrame:
    """``symbol_id, embedding`` of all vectors there are and of the symbols that had none."""
    return vectors.select("symbol_id", "embedding").union(encoded(missing(symbols, vectors), encoder))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    """``symbol_id, distance`` of the vectors nearest to one query, by Euclidean distance.

    The smaller id comes first among equal distances. Vectors that are null, of another width than
    the query, or hold a null aren't looked at; an id given twice counts once.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(F.col("embedding"), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    near = vectors.where(F.size("embedding") == len(query)).select("symbol_id", distance.alias("distance"))
    near = near.where("distance is not null and not isnan(distance)")
    best = near.groupBy("symbol_id").agg(F.min("distance").alias("distance")).orderBy("distance", "symbol_id").limit(limit)
    return best.select("symbol_id", F.round("distance", 6).alias("distance"))
