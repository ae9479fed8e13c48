"""The catalog of SQLite files as symbols."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: the catalog's tables and views.
_CATALOG = "select type, name, sql from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by type, name"
_OUT = "file_path string, ordinal int, name string, kind string, start_line int, end_line int, signature string"


def _catalog(content: bytes) -> list[tuple]:
    """Tables and views by type and name. What can't be read as a database has none."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        return db.execute(_CATALOG).fetchall()
    except sqlite3.Error:
        return []
    finally:
        db.close()


def sqlite_symbols(files: DataFrame) -> DataFrame:
    """The tables and views of the SQLite files among ``file_path, content``.

    Each counts as a symbol whose line is its place in the order of type and name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (path, k, name, kind, k, k, " ".join((sql or name).split())[:120])
                for path, content in zip(b["file_path"], b["content"])
                for k, (kind, name, sql) in enumerate(_catalog(bytes(content)), 1)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return files.select("file_path", "content").mapInPandas(run, _OUT)
