"""From files to the tables of symbols and calls."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.extract.python_source import parsed
from symweave.extract.rules import CALL, KEYWORDS, NOT_CODE, QUOTED, QUOTED_SIGN, RULES
from symweave.operators.graph import enclosing
from symweave.schemas import CALL_LANGUAGES
from symweave.session import cut
from symweave.sources.files import lines

_CLOSING = re.compile(r"^\s*(?:[\]})]+[;,]?|end;?|fi|done|esac|</[\w:.-]+>)\s*$", re.ASCII)
_SEEN = re.compile(r"\S", re.ASCII)
_COLUMNS = ["file_path", "language", "name", "kind", "start_line", "end_line", "signature", "docstring", "parent_name"]


def _declared(line_rows: DataFrame) -> DataFrame:
    """The lines that declare something, with kind and name."""
    schema = T.StructType([*line_rows.schema.fields, T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {language: [(kind, re.compile(p)) for kind, p in of_it] for language, of_it in RULES.items()}
        for b in batches:
            found = []
            for language, line in zip(b["language"], b["line"]):
                hits = ((kind, m) for kind, p in rules.get(language, ()) if (m := p.search(line)))
                kind, hit = next(hits, (None, None))
                found.append((kind, hit.group(1).strip() if hit else None))
            b["kind"], b["name"] = [k for k, _ in found], [n for _, n in found]
            yield b[b["kind"].notna()]

    return line_rows.mapInPandas(run, schema)


def _placed_schema(files: DataFrame) -> T.StructType:
    added = {"line_no": T.IntegerType(), "line": T.StringType(), "last_line": T.IntegerType(), "next_line": T.IntegerType(), "closes": T.BooleanType()}
    return T.StructType([files.schema["file_path"], files.schema["language"], *[T.StructField(n, kind) for n, kind in added.items()]])


#: Languages of sections without indentation: a section lasts until the next of its level.
_SECTION = {"markdown": re.compile(r" {0,3}(#{1,6})\s"), "toml": re.compile(r"\s*(\[)"), "ini": re.compile(r"\s*(\[)")}
_FENCE = re.compile(r" {0,3}(```|~~~)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
_PLAIN = re.compile(r" {0,3}[^\s#>|*+=-]")


def _headings(split: list[str]) -> list[str]:
    """Lines of Markdown with underlined headings written as marked ones, and without what stands in fences."""
    out, fence = [], ""
    for line, below in zip(split, [*split[1:], ""]):
        mark = _FENCE.match(line)
        if fence or mark:
            out.append("")
            if mark and (not fence or mark.group(1) == fence):
                fence = "" if fence else mark.group(1)
        elif _UNDERLINE.match(below) and _PLAIN.match(line):
            out.append(("# " if "=" in below else "## ") + line.strip())
        else:
            out.append(line)
    return out


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of each text with its last line, the next one indented as little, and whether that only closes a block."""
    done: list[tuple] = []
    for b in batches:
        for path, language, text in zip(b["file_path"], b["language"], b["text"]):
            done += _placed_lines(path, language, text)
            if len(done) >= 20_000:
                yield _frame(done)
                done = []
    yield _frame(done)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file_path", "language", "line_no", "line", "last_line", "next_line", "closes"]).astype({"next_line": "Int32"})


def _placed_lines(path: str, language: str, text: str) -> list[tuple]:
    split = re.split("\r?\n", text)
    if language == "markdown":
        split = _headings(split)
    if len(split) > 1 and not split[-1]:
        split.pop()  # what follows the last line end is no line
    out: list[tuple] = []
    open_: list[tuple[int, int]] = []
    section = _SECTION.get(language)
    for no in range(len(split), 0, -1):
        line = split[no - 1]
        next_ = None
        mark = section.match(line) if section else None
        if mark or not section and _SEEN.search(line):
            spaced = line.replace("\t", "    ")
            indent = len(mark.group(1)) if mark else len(spaced) - len(spaced.lstrip(" "))
            while open_ and open_[-1][0] > indent:
                open_.pop()
            next_ = open_[-1][1] if open_ else None
            open_.append((indent, no))
        out.append((path, language, no, line, len(split), next_, next_ is not None and bool(_CLOSING.search(split[next_ - 1]))))
    return out[::-1]


def by_rules(files: DataFrame) -> DataFrame:
    """Symbols of ``file_path, language, text`` by the line rules of each language.

    A symbol ends before the next line that is indented as little as its own, which it includes
    if that line only closes a bracket or block.
    """
    placed = files.where("text is not null").select("file_path", "language", "text").mapInPandas(_placed, _placed_schema(files))
    found = _declared(placed).where("name <> ''")
    block = F.col("kind").isin("function", "method", "class", "section") & ~F.col("line").rlike(r"^[^{(]*(\([^()]*\)[^{(]*)*;\s*$")
    end = F.when(F.col("next_line").isNull(), F.col("last_line")).when(F.col("closes"), F.col("next_line")).otherwise(F.col("next_line") - 1)
    return found.select(
        "file_path",
        "language",
        F.substring("name", 1, 120).alias("name"),
        "kind",
        F.col("line_no").cast("int").alias("start_line"),
        F.when(block, F.greatest(end, F.col("line_no"))).otherwise(F.col("line_no")).cast("int").alias("end_line"),
        F.trim("line").alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
    )


@F.pandas_udf(T.StringType())
def code_only(text: pd.Series, language: pd.Series) -> pd.Series:
    """The text with blanks in the place of comments and strings; lines stay where they are."""
    patterns: dict[str, re.Pattern[str]] = {}
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    out = []
    for t, x in zip(text, language):
        if x not in patterns:
            patterns[x] = re.compile(NOT_CODE + QUOTED.get(x, QUOTED_SIGN), re.S)
        out.append(patterns[x].sub(blank, t) if t else t)
    return pd.Series(out, dtype=object)


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All symbols of ``file_path, language, text``, and the rows of :func:`parsed` of the Python files."""
    texts = files.where("text is not null and text <> ''").select("file_path", "language", "text")
    python = cut(parsed(texts.where("language = 'python'")))
    line_of = texts.where("language = 'python'").select("file_path", F.split("text", "\n").alias("_lines"))
    signed = python.where("not is_call and kind <> 'error'").join(line_of, "file_path")
    of_python = signed.select(
        "file_path", F.lit("python").alias("language"), "name", "kind", "start_line", "end_line",
        F.trim(F.get("_lines", F.col("start_line") - 1)).alias("signature"), "docstring", "parent_name",
    )
    broken = texts.join(python.where("kind = 'error'").select("file_path"), "file_path", "left_semi")
    ruled = cut(by_rules(texts.where("language <> 'python'").union(broken)))
    classes = ruled.where("kind in ('class', 'section')").select(F.xxhash64("file_path", "start_line", "name").alias("id"), "file_path", "start_line", "end_line", "name")
    within = enclosing(ruled.withColumn("line", F.col("start_line") - 1).where("line > 0"), classes).where(F.col("end_line") > 0)
    parents = within.join(classes.select(F.col("id").alias("caller_id"), F.col("name").alias("parent_name"), F.col("end_line").alias("_end")), "caller_id")
    parents = parents.where("_end >= end_line").select("file_path", "start_line", "name", "parent_name")
    of_rules = ruled.join(parents, ["file_path", "start_line", "name"], "left")
    return of_python.select(*_COLUMNS).unionByName(of_rules.select(*_COLUMNS)), python


def symbols_and_calls(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The symbols and calls tables (without versions) of ``file_path, language, checksum, text``, and ``file_path, error`` of what couldn't be parsed.

    Ids are hashes of path, line, name and, of equal names on one line, their order, so that they
    are the same on every run. A Python file that can't be parsed gets the symbols that the line
    rules find.
    """
    found, python = extracted(files)
    found = cut(found)
    place = Window.partitionBy("file_path", "start_line", "name").orderBy("kind", "end_line", "signature")
    again = F.row_number().over(place)
    symbols = found.withColumn("again", again).join(files.select("file_path", "checksum"), "file_path")
    own = F.xxhash64("file_path", "start_line", "name")
    symbols = symbols.select(
        F.when(F.col("again") == 1, own).otherwise(F.xxhash64("file_path", "start_line", "name", "again")).alias("id"), "name", "kind", "file_path",
        "start_line", "end_line", "signature", "docstring", "parent_name", F.lit(None).cast("bigint").alias("parent_id"), "language", "checksum",
        F.current_timestamp().alias("indexed_at"),
    )
    texts = files.where(F.col("language").isin([x for x in CALL_LANGUAGES if x != "python"]) & (F.col("text") != ""))
    called = lines(texts.select("file_path", code_only("text", "language").alias("text")), "file_path")
    called = called.select("file_path", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(CALL), 1)).alias("callee_name"))
    functions = found.where("kind in ('function', 'method')").select(own.alias("id"), "file_path", "start_line", "end_line", "name")
    sites = enclosing(called.where(~F.col("callee_name").isin(KEYWORDS)), functions)
    # The declaration itself looks like a call of its own name.
    sites = sites.join(functions.select(F.col("id").alias("caller_id"), "start_line", "name"), "caller_id").where("not (line = start_line and callee_name = name)")
    callers = functions.select("file_path", F.col("start_line").alias("caller_line"), F.col("id").alias("caller_id")).distinct()
    python_sites = python.where("is_call").select("file_path", "callee_name", F.col("start_line").alias("line"), "caller_line").join(callers, ["file_path", "caller_line"])
    parts = [x.select("caller_id", "callee_name", F.col("line").alias("call_line"), "file_path") for x in (sites, python_sites)]
    calls = reduce(DataFrame.union, parts)
    key = F.xxhash64("caller_id", "call_line", "callee_name").alias("id")
    calls = calls.select(key, "caller_id", "callee_name", F.col("call_line").cast("int").alias("call_line"), "file_path").dropDuplicates(["id"])
    return symbols, calls, python.where("kind = 'error'").select("file_path", F.col("name").alias("error"))
