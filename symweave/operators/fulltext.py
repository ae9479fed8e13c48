"""Full-text search with BM25 over several columns, from postings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.text import folded_tokens, porter, stems_udf, tokens_udf
from symweave.session import cut

# The constants of the ranking formula, and the least weight of a term.
K1, B, LEAST = 1.2, 0.75, 1e-6


def tokenized(rows: DataFrame, key: str, columns: Sequence[str], *keys: str, stem: bool = True) -> DataFrame:
    """``id, keys, field, terms``: the terms of each column of each row; null columns have none."""
    terms = stems_udf if stem else tokens_udf
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])).alias("f")
    return rows.select(F.col(key).alias("id"), *keys, fields).select("id", *keys, F.col("f.field").alias("field"), terms("f.text").alias("terms"))


def query_phrases(query: str, *, stem: bool = True) -> list[list[str]]:
    """The words of a plain query, each a phrase of its terms: ``get_user`` are two terms that stand together."""
    found = [[porter(w) if stem else w for w in folded_tokens(part)] for part in query.split()]
    return [p for p in found if p]


def postings(tokens: DataFrame, *keys: str) -> DataFrame:
    """``term, id, keys, field, places``: where each row of :func:`tokenized` holds each term.

    Written sorted by term, the rows of a few terms are found without reading the rest.
    """
    placed = tokens.select("id", *keys, "field", F.posexplode("terms").alias("place", "term"))
    return placed.groupBy("term", "id", *keys, "field").agg(F.sort_array(F.collect_list("place")).alias("places"))


def row_lengths(tokens: DataFrame, *keys: str) -> DataFrame:
    """``id, keys, length``: the number of terms of each row."""
    return tokens.groupBy("id", *keys).agg(F.sum(F.size("terms")).cast("bigint").alias("length"))


def _is(words: Sequence[str], k: int, prefix: bool) -> Column:
    return F.col("term").startswith(words[k]) if prefix and k == len(words) - 1 else F.col("term") == words[k]


def _back(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def match_postings(
    posted: DataFrame, lengths: DataFrame, phrases: Sequence[Sequence[str]], *, limit: int = 10, any_of: bool = False, prefix: bool = False, field: str | None = None
) -> DataFrame:
    """``id, score`` of the best rows, from :func:`postings` and :func:`row_lengths`; the smaller id first among equal scores.

    Each phrase is a list of terms that stand together in one column. All phrases must occur, or
    with ``any_of`` one of them; with ``prefix``, the last term of each may go on; with ``field``
    only that column is looked at. No phrases find nothing. The score is BM25: a phrase's
    frequency over the columns looked at, the length of the row over all columns.
    """
    phrases = [list(p) for p in phrases if p]
    if not phrases:
        return posted.select("id", F.lit(0.0).alias("score")).limit(0)
    wanted = reduce(lambda a, b: a | b, [_is(p, k, prefix) for p in phrases for k in range(len(p))])
    held = posted.where(wanted if field is None else wanted & (F.col("field") == field))
    # The places at which each phrase would begin, by each of its terms.
    starts = [
        F.flatten(F.collect_list(F.when(_is(p, k, prefix), _back("places", k)))).alias(f"s{i}_{k}") for i, p in enumerate(phrases) for k in range(len(p))
    ]
    found = [F.size(reduce(F.array_intersect, [F.col(f"s{i}_{k}") for k in range(len(p))])) for i, p in enumerate(phrases)]
    names = [f"f{i}" for i in range(len(phrases))]
    counts = held.groupBy("id", "field").agg(*starts).select("id", *[c.alias(f) for c, f in zip(found, names)])
    per_row = counts.groupBy("id").agg(*[F.sum(f).alias(f) for f in names]).where(reduce(lambda a, b: a | b, [F.col(f) > 0 for f in names]))
    per_row = cut(per_row.join(lengths.select("id", "length"), "id"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).head()
    df = per_row.agg(*[F.count(F.when(F.col(f) > 0, 1)).alias(f) for f in names]).head()
    score = F.lit(0.0)
    for f in names:
        idf = max(LEAST, math.log((stats["n"] - df[f] + 0.5) / (df[f] + 0.5)))
        score = score + idf * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"] or 1.0)))
    kept = per_row.where(reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), [F.col(f) > 0 for f in names]))
    return kept.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(tokens: DataFrame, phrases: Sequence[Sequence[str]], *, prefix: bool = False, **options) -> DataFrame:
    """As :func:`match_postings`, from rows of :func:`tokenized` that have no stored postings.

    The rows are tokenised once: of each, only its length and the places of the terms asked for are kept.
    """
    terms = sorted({t for p in phrases for t in p})
    asked = (lambda t: reduce(lambda a, b: a | b, [t.startswith(w) for w in terms])) if prefix else (lambda t: t.isin(terms))
    if not terms:
        return tokens.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = F.filter(F.transform("terms", lambda t, i: F.when(asked(t), F.struct(t.alias("term"), i.alias("place")))), lambda x: x.isNotNull())
    kept = cut(tokens.select("id", "field", F.size("terms").alias("n"), hits.alias("hits")))
    lengths = kept.groupBy("id").agg(F.sum("n").alias("length"))
    placed = kept.select("id", "field", F.explode("hits").alias("h")).select("id", "field", F.col("h.term").alias("term"), F.col("h.place").alias("place"))
    posted = placed.groupBy("term", "id", "field").agg(F.collect_list("place").alias("places"))
    return match_postings(posted, lengths, phrases, prefix=prefix, **options)


def match(tokens: DataFrame, query: str, *, stem: bool = True, **options) -> DataFrame:
    """Rows that hold all words of a plain query; a query without words finds nothing."""
    return search(tokens, query_phrases(query, stem=stem), **options)
