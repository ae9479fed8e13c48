"""Source files that nobody of the project wrote by hand.

The head of each file is lexed and written again in canonical layout (:mod:`symweave.llm.layout`).
Extreme expansion, in the head and, by its canonical width, over the whole file, marks minified
files; perfect uniformity marks what a loop has printed; dominance of literals marks bulk data.
Layout can't tell a copy from its original nor see a generator's neat output, so where the file
lies, what it is called, its comments and its checksum are further evidence.
"""

from __future__ import annotations

from typing import get_type_hints

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.llm.layout import Layout, measured

EXTREME = 6.0  # canonical lines for each line as it is, from which code was squeezed
DOMINANT = 0.8  # share of literals among words and literals, from which a file is data

# Names that package managers and generators give to folders and files.
PACKAGE_FOLDERS = "bower_components|Pods|external|externals|node_modules|site-packages|third[-_]?party|vendor|vendored|Carthage|deps"
GENERATED_FOLDERS = "__generated__|generated|generated[-_]sources|autogen|auto[-_]generated|gen|gensrc|openapi[-_]client|swagger[-_]client"
GENERATED_NAMES = (
    r"_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h|swift)$|_pb\.(js|ts|d\.ts)$|\.(g|gen|generated|autogen|designer)\.[a-z]+$|"
    r"[-_.](auto)?generated\.[a-z]+$|_gen\.go$|\.freezed\.dart$"
)
LOCK_FILES = (
    r"/(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|Cargo\.lock|Gemfile\.lock|poetry\.lock|"
    r"Pipfile\.lock|go\.sum|packages\.lock\.json|uv\.lock|Podfile\.lock|pubspec\.lock)$"
)
BUNDLE_NAMES = r"[-.](min|bundle|pack|prod)\.(js|mjs|css|html)$|\.[0-9a-f]{8,}\.(chunk\.)?(js|css)$|\.chunk\.(js|css)$"

# What generators and copies write at the top of a file. A named tool or source is
# asked for, as hand-written comments speak of generators and vendors too.
TOOL_COMMENTS = (
    r"(?i)@generated\b|\bauto(matically)?[- ]?generated (by|from|file|code)\b|\bcode generated by\b|"
    r"\b(this file|code) (is|was|has been) (auto(matically)?[- ]?)?(generated|written|created|produced|made) (by|from)\b|"
    r"\b(generated|produced|created|written|emitted) by \S+.{0,60}(do not (edit|modify|change)|changes will be|overwritten)|"
    r"\bcode produced by\b|\bmachine[- ](made|generated|written) (by|from)\b|\boutput of `|\bdo not (edit|modify)( by hand)?\s*[:;,.!-]+\s*(re)?generate|"
    r"\bedit the \w+ instead of this file\b|\brebuilt on every\b|\bchanges will be (lost|overwritten)\b|"
    r"\bdiese datei wurde (von|mit|durch) .{0,60}(erzeugt|erstellt|generiert)|\b(automatisch|maschinell) (erzeugt|erstellt|generiert)\b|"
    r"\b(archivo|fichero|código) (creado|generado|producido) (por|con|automáticamente)\b|\bno (editar|modificar)\s*[.!]|"
    r"\b(fichier|code) (généré|créé|produit) (par|automatiquement)\b"
)
COPY_COMMENTS = (
    r"(?i)\bbundled copy of\b|\btaken from upstream\b|\bsynced from upstream\b|\bimported from (the )?\S+ (project|repository|package)\b|"
    r"\bpart of (\S+)\. see the licen[cs]e that came with\b|\bcopyright the \S+ contributors\b|\bvendored (from|copy)\b|"
    r"\b(copied|adapted|forked) (verbatim )?from https?://|\bpatches go (there|upstream)\b"
)


def normal_path(path: Column) -> Column:
    """A path with forward slashes only, without drive, repeated slashes and ``.`` steps."""
    path = F.regexp_replace(path, r"\\", "/")
    path = F.regexp_replace(path, "^[A-Za-z]:", "")
    return F.regexp_replace(path, r"/(?:\.?/)+", "/")


_KINDS = {str: T.StringType(), int: T.IntegerType(), float: T.DoubleType()}
_LAYOUT = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in get_type_hints(Layout).items()])


@F.pandas_udf(_LAYOUT)
def _measured(head: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(h, s) for h, s in zip(head, suffix)], columns=Layout._fields)


def layout(heads: DataFrame) -> DataFrame:
    """``file_path, line_count, longest_line`` and the measures of :class:`Layout` of each head; a null one counts as empty."""
    suffix = F.lower(F.regexp_extract("file_path", r"\.([^./\\]+)$", 1))
    found = _measured(F.coalesce("head", F.lit("")), suffix).alias("m")
    return heads.select("file_path", "line_count", "longest_line", found).select("file_path", "line_count", "longest_line", "m.*")


def classified(files: DataFrame, heads: DataFrame, published: DataFrame) -> DataFrame:
    """``file_path, origin`` and the evidence, one row for each path as stored.

    ``origin`` is vendored, generated, minified, data or handwritten; the first that fits. Of
    several states of a file the latest counts. What is null (size, checksum, head, ...) is no
    evidence; null paths are left out, and without any rows there are none. Heads of other paths
    and checksums of ``published`` that are null don't matter.
    """
    columns = ["checksum", "symbol_count", "file_size"]
    latest = (
        files.where("file_path is not null")
        .groupBy("file_path")
        .agg(F.max(F.struct("indexed_at", *columns)).alias("row"))
        .select("file_path", *[F.col(f"row.{c}").alias(c) for c in columns])
    )
    sums = published.where("checksum is not null").select(F.lower(F.trim("checksum")).alias("sum")).distinct()
    packages = published.where("package_name is not null").select(F.lower(F.trim("package_name")).alias("package")).distinct()
    path = normal_path(F.col("file_path"))
    after = F.regexp_extract("path", rf"/(?:{PACKAGE_FOLDERS})/([^/]+)/", 1)
    rows = (
        latest.join(layout(heads.where("file_path is not null").dropDuplicates(["file_path"])), "file_path", "left")
        .withColumn("path", path)
        .withColumn("sum", F.lower(F.trim("checksum")))
        .withColumn("package", F.lower(after))
        .join(sums.withColumn("copied", F.lit(True)), "sum", "left")
        .join(packages.withColumn("listed", F.lit(True)), "package", "left")
    )
    says = lambda pattern, where: F.coalesce(F.col(where).rlike(pattern), F.lit(False))
    yes = lambda column: F.coalesce(column, F.lit(False))
    # The mean line without the longest one, which alone proves nothing.
    rest = F.when(F.col("line_count") > 1, (F.col("file_size") - F.col("longest_line")) / (F.col("line_count") - 1)).otherwise(F.col("file_size"))
    expansion = F.col("canonical") / F.greatest(F.col("lines"), F.lit(1))
    whole = rest / F.greatest(F.col("width"), F.lit(16.0))  # a head of a few signs says little of the width
    even = F.col("file_size") / (F.greatest(F.col("line_count"), F.lit(1)) * (F.col("longest_line") + 1))
    minified = yes((expansion >= EXTREME) & (F.col("canonical") >= 6) & F.coalesce(whole >= EXTREME, F.lit(True)))
    numbers = yes((F.col("literals") >= 12) & (F.col("literals") >= DOMINANT * (F.col("literals") + F.col("words"))))
    # Lines of one shape, and in the whole file of one width, or without breaks.
    uniform = yes((F.col("uniform") >= 0.9) & (F.col("canonical") >= 3) & ((even >= 0.9) & (F.col("line_count") >= 100) | (whole >= EXTREME)))
    literal_share = F.col("literals") / F.greatest(F.col("literals") + F.col("words"), F.lit(1))
    vendored = yes(F.col("copied")) | yes(F.col("listed")) | (F.col("package") != "") | says(COPY_COMMENTS, "comments")
    generated = (
        says(rf"/({GENERATED_FOLDERS})/", "path") | says(f"(?i){GENERATED_NAMES}", "path") | says(LOCK_FILES, "path") | says(TOOL_COMMENTS, "comments")
    )
    origin = (
        F.when(vendored, "vendored")
        .when(numbers | (uniform & (literal_share >= 0.3)), "data")
        .when(generated | uniform, "generated")
        .when(minified | says(f"(?i){BUNDLE_NAMES}", "path"), "minified")
        .otherwise("handwritten")
    )
    return rows.select("file_path", origin.alias("origin"), expansion.alias("expansion"), whole.alias("whole_expansion"), literal_share.alias("literal_share"), "uniform", "symbol_count")
