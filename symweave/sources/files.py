"""File trees as DataFrames: listing, filtering, hashing, lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.functions.paths import in_skipped_folder, is_secret, language_of, matches_any, relative_to
from symweave.schemas import LARGE_FILE, SKIPPED_FOLDERS


BATCH = 16 * 1024 * 1024  # bytes of contents that are handed on together, but for a file that is longer
_LISTED = "file_path string, file_size bigint, mtime_ns bigint"


def _entries(folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """The files and the folders to go on with of a folder, of any file system that Arrow can read. What can't be read is empty."""
    source, path = fs.FileSystem.from_uri(folder)
    files, folders = [], []
    for e in source.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if e.type == fs.FileType.File:
            files.append((e.path, e.size, e.mtime_ns))
        elif e.type == fs.FileType.Directory and not e.base_name.startswith(".") and e.base_name not in SKIPPED_FOLDERS:
            folders.append(e.path)
    return files, folders


def scan(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    """``file_path, file_size, mtime_ns`` of all files below a root, empty ones and hidden names too.

    Hidden folders and those that are never entered aren't listed at all. The driver goes down
    until there are folders for all tasks, which list the rest.
    """
    files, folders = [], [root]
    while folders and len(folders) < tasks:
        found, below = _entries(folders.pop(0))
        files += found
        folders += below

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _LISTED.split(", ")]
        for b in batches:
            open_ = b["folder"].tolist()
            while open_:
                found, below = _entries(open_.pop())
                open_ += below
                yield pd.DataFrame(found, columns=names)

    seen = spark.createDataFrame(files, _LISTED)  # of the few folders at the top
    if not folders:
        return seen
    rest = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(tasks, len(folders)))
    return seen.union(rest.mapInPandas(walk, _LISTED))


def contents(paths: DataFrame) -> DataFrame:
    """``file_path, content, error`` of the files of ``paths`` (``file_path``); no others are opened.

    Of a file that can't be read the content is null and the error says why.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for file_path in b["file_path"]:
                content, error = None, None
                try:
                    source, path = fs.FileSystem.from_uri(file_path)
                    with source.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                held.append((file_path, content, error))
                size += len(content or b"")
                if size >= BATCH:
                    yield pd.DataFrame(held, columns=["file_path", "content", "error"])
                    held, size = [], 0
        yield pd.DataFrame(held, columns=["file_path", "content", "error"])

    return paths.select("file_path").distinct().mapInPandas(read, "file_path string, content binary, error string")


@F.pandas_udf(T.StringType())
def blake2b_udf(content: pd.Series) -> pd.Series:
    """The 128-bit BLAKE2b checksum of bytes, in hexadecimal."""
    return content.map(lambda b: hashlib.blake2b(b, digest_size=16).hexdigest() if b is not None else None)


def small_text(path: str) -> str | None:
    """The text of one settings file, or None if it isn't there."""
    source, path = fs.FileSystem.from_uri(path)
    try:
        with source.open_input_stream(path) as stream:
            return stream.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


#: A line of an ignore file: what it matches, and whether it ignores that (or takes it back).
Rule = tuple[str, bool]


def ignore_rules(lines: Sequence[str]) -> list[Rule]:
    """The rules of an ignore file, in order, as expressions for relative paths; those of folders end with a slash.

    Comments and blank lines don't count, ``*`` stays within a folder, ``**`` doesn't, ``[...]``
    is a class, a backslash takes the next sign as it is, a slash inside anchors the pattern at
    the root, a slash at the end means folders, ``!`` takes back what lines before have ignored.
    """
    rules = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        pattern = line.strip("/")
        parts = re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?\]?[^\]]*\]|\\.|.", pattern)
        fixed = {"**/": "(?:.*/)?", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(fixed.get(p) or ("[" + p[1:].replace("!", "^", 1) if p[1] == "!" else p) if p.startswith("[") and len(p) > 1 else fixed.get(p) or re.escape(p[-1]) for p in parts)
        rules.append((("^" if "/" in line.rstrip("/") else "^(?:.*/)?") + body + ("/$" if line.endswith("/") else "/?$"), not back))
    return rules


def is_ignored(relative: Column, rules: Sequence[Rule]) -> Column:
    """Whether the last rule that matches a path ignores it, or ignores a folder that it lies in."""
    parts = F.split(relative, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))

    def last(path: Column) -> Column:
        out = F.lit(False)
        for pattern, ignores in rules:
            out = F.when(path.rlike(pattern), ignores).otherwise(out)
        return out

    return F.exists(above, last)


def skip_reason(path: Column, relative: Column, *, ignored: Sequence[Rule] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Why a file isn't indexed, or null if it is. The first reason that holds counts."""
    reason = F.when(in_skipped_folder(relative), "folder").when(is_secret(path), "secret file").when(language_of(path).isNull(), "unknown language")
    if ignored:
        reason = reason.when(is_ignored(relative, ignored), "gitignored")
    if include:
        reason = reason.when(~matches_any(relative, include), "not in include")
    if exclude:
        reason = reason.when(matches_any(relative, exclude), "exclude match")
    return reason


def indexable(files: DataFrame, root: str, **options) -> DataFrame:
    """The files that are indexed, with ``language`` and ``is_large``; options of :func:`skip_reason`."""
    path = F.col("file_path")
    kept = files.where(skip_reason(path, relative_to(path, root), **options).isNull())
    return kept.withColumn("language", language_of(path)).withColumn("is_large", F.col("file_size") >= LARGE_FILE)


def decoded(files: DataFrame) -> DataFrame:
    """The files' text, wrong UTF-8 replaced, and their checksum."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("checksum", blake2b_udf("content")).drop("content")


def lines(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, line_no, line``: the lines of ``text`` from 1. A line end is ``\\n``, with or without ``\\r``."""
    exploded = texts.where("text is not null").select(*keys, F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return exploded.select(*keys, (F.col("at") + 1).alias("line_no"), "line")


def line_range(text: Column, start: Column | int, end: Column | int) -> Column:
    """The lines from start to end, both from 1 and included, start at least 1; reversed ranges are empty."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(end - first + 1, F.lit(0))), "\n")

