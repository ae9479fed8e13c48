"""The call graph: who calls whom, and which function a line lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 64  # lines; spans are cut into bins so that one long file doesn't pair all its lines and functions


def callers(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Call sites of a name with the symbols that they lie in."""
    sites = calls.where(F.col("callee_name") == name).select(F.col("caller_id").alias("id"), "callee_name", "call_line")
    return sites.join(symbols, "id").orderBy("file_path", "call_line", "id").select(
        "id", "name", "kind", "file_path", "start_line", "end_line", "signature", "callee_name", "call_line"
    )


def callees(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """What the symbols of a name call."""
    inside = symbols.where(F.col("name") == name).select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), "file_path")
    return inside.join(calls.select("caller_id", "callee_name", "call_line"), "caller_id").orderBy("call_line", "callee_name", "caller_id").select(
        "caller_id", "caller_name", "file_path", "callee_name", "call_line"
    )


def enclosing(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Each of ``sites`` (``file_path, line`` and more) with the innermost function around it.

    ``functions`` has ``id, file_path, start_line, end_line``. Of functions that span as few lines
    the first by line and id counts; sites outside of any function are dropped, as are those with
    a null path or line. Joined by file and bin of lines.
    """
    kept = [c for c in sites.columns]
    spans = functions.where("start_line <= end_line").select(
        F.col("id").alias("caller_id"),
        F.col("file_path").alias("_file"),
        F.col("start_line").alias("_from"),
        F.col("end_line").alias("_to"),
    )
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / BIN), F.floor(F.col("_to") / BIN))))
    marked = sites.withColumn("_site", F.monotonically_increasing_id()).withColumn("_at", F.floor(F.col("line") / BIN))
    near = marked.join(spans, (F.col("file_path") == F.col("_file")) & (F.col("_at") == F.col("_bin")) & F.col("line").between(F.col("_from"), F.col("_to")))
    best = F.min(F.struct((F.col("_to") - F.col("_from")).alias("span"), F.col("_from"), "caller_id")).alias("best")
    return near.groupBy("_site", *kept).agg(best).select(*kept, F.col("best.caller_id").alias("caller_id"))


def first_homonym(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with the caller replaced by the first symbol of its name in its file."""
    named = symbols.select(F.col("id").alias("caller_id"), "name", "file_path", "start_line")
    first = named.groupBy("name", "file_path").agg(F.min(F.struct("start_line", "caller_id")).caller_id.alias("first_id"))
    return calls.join(named, "caller_id").join(first, ["name", "file_path"]).select(
        "file_path", F.col("first_id").alias("caller_id"), "callee_name", "call_line"
    )
