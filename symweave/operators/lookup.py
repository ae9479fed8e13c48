"""Lookups over symbols: outlines, bodies, keyword search, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions.text import like_ascii, summary_line
from symweave.schemas import HEADER_KINDS
from symweave.sources.files import line_range

# The columns of each kind of answer, in order.
OUTLINE = ["name", "kind", "start_line", "end_line", "signature", "parent_name"]
SYMBOL = ["name", "kind", "file_path", "start_line", "end_line", "signature", "docstring", "parent_name", "language"]
SEARCH = ["id", *SYMBOL]
EXPORT = ["name", "kind", "file_path", "start_line", "end_line", "signature", "docstring", "parent_name", "language", "checksum"]


def outline(symbols: DataFrame, file_path: str) -> DataFrame:
    """The symbols of a file by line."""
    return symbols.where(F.col("file_path") == file_path).orderBy("start_line", "id").select(*OUTLINE)


def outline_sections(symbols: DataFrame, file_path: str) -> DataFrame:
    """As :func:`outline`, imports and variables first, with the ``section`` (0 for these, else 1)."""
    rank = F.when(F.col("kind").isin(HEADER_KINDS), 0).otherwise(1).alias("section")
    return symbols.where(F.col("file_path") == file_path).select("id", *OUTLINE, rank).orderBy("section", "start_line", "id").select(*OUTLINE, "section")


def outline_summary(symbols: DataFrame) -> DataFrame:
    """``file_path, summary``: one line for each symbol of a file, in the order of the lines."""
    ordered = F.sort_array(F.collect_list(F.struct("start_line", "id", summary_line().alias("shown"))))
    return symbols.groupBy("file_path").agg(F.array_join(F.transform(ordered, lambda s: s["shown"]), "\n").alias("summary"))


def file_header(symbols: DataFrame) -> DataFrame:
    """``file_path, header_end``: the last line of the imports and variables that begin before line 50; else 20."""
    in_header = F.col("kind").isin(HEADER_KINDS) & (F.col("start_line") < 50)
    return symbols.groupBy("file_path").agg(F.coalesce(F.max(F.when(in_header, F.col("end_line"))), F.lit(20)).alias("header_end"))


def by_name(symbols: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """The first symbol of a name by path and line, in a file or anywhere; no row if there is none."""
    found = symbols.where(F.col("name") == name)
    if file_path is not None:
        found = found.where(F.col("file_path") == file_path)
    return found.orderBy("file_path", "start_line", "id").limit(1).select(*SYMBOL)


def bodies(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """Each symbol with the lines of its file that it spans (``texts``: ``file_path, text``)."""
    body = line_range(F.col("text"), F.col("start_line"), F.col("end_line")).alias("body")
    return symbols.join(texts.select("file_path", "text"), "file_path").select(*SYMBOL, body)


def keyword_search(
    symbols: DataFrame,
    query: str,
    *,
    limit: int = 20,
    kind: str | None = None,
    language: str | None = None,
    file: str | None = None,
    filter_first: bool = False,
) -> DataFrame:
    """Symbols with the query in their name or path, by name.

    ``kind``, ``language`` and ``file`` (a part of the path) select among the first ``limit`` of
    them, as a filter on what is shown; with ``filter_first``, among all.
    """

    def chosen(rows: DataFrame) -> DataFrame:
        if kind:
            rows = rows.where(F.col("kind") == kind)
        if language:
            rows = rows.where(F.col("language") == language)
        return rows.where(F.col("file_path").contains(file)) if file else rows

    found = symbols.where(like_ascii(F.col("name"), query) | like_ascii(F.col("file_path"), query))
    first = lambda rows: rows.orderBy("name", "file_path", "start_line", "id").limit(limit)
    rows = first(chosen(found)) if filter_first else chosen(first(found))
    return rows.select(*[c for c in SEARCH if c in symbols.columns])


def export_rows(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file_path", "start_line", "id").select(*EXPORT)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def as_json_array(symbols: DataFrame) -> DataFrame:
    """The lines of one JSON array of all :func:`export_rows`, in order: part after part they are one document."""
    order = ["file_path", "start_line", "id"]
    first = symbols.agg(F.min(F.struct(*order)).alias("first")).head()["first"]
    spark = symbols.sparkSession
    if first is None:
        return spark.createDataFrame([("[]",)], "value string")
    begins = F.col("id") == first["id"]  # ids are unique
    object_ = F.to_json(F.struct(*EXPORT), {"ignoreNullFields": "false"})
    lines = symbols.orderBy(*order).select(F.concat(F.when(begins, "[").otherwise(","), object_).alias("value"))
    return lines.union(spark.createDataFrame([("]",)], "value string"))


def export(symbols: DataFrame, path: str, kind: str = "json") -> None:
    """Write :func:`export_rows` as JSON lines, as one JSON array over the parts, or as CSV with a header."""
    if kind == "array":
        as_json_array(symbols).write.mode("errorifexists").text(path)
        return
    writer = export_rows(symbols).write.mode("errorifexists")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path, ignoreNullFields=False)
