"""Symbols and calls of Python files, by Python's own parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OUT = (
    "file_path string, name string, kind string, start_line int, end_line int, docstring string, parent_name string, "
    "is_call boolean, callee_name string, caller_line int"
)


def _walk(node: ast.AST, parent: str | None, in_class: bool, caller: int | None, top: bool) -> Iterator[tuple]:
    for child in ast.iter_child_nodes(node):
        inner, inner_class, inner_caller = parent, in_class, caller
        span = (getattr(child, "lineno", 0), getattr(child, "end_lineno", 0))
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            yield (child.name, "method" if in_class else "function", *span, ast.get_docstring(child), parent, False, None, None)
            inner, inner_caller = child.name, span[0]
        elif isinstance(child, ast.ClassDef):
            yield (child.name, "class", *span, ast.get_docstring(child), parent, False, None, None)
            inner, inner_class = child.name, True
        elif isinstance(child, ast.Import | ast.ImportFrom):
            yield (ast.unparse(child)[:80], "import", *span, None, parent, False, None, None)
        elif top and isinstance(child, ast.Assign | ast.AnnAssign):
            target = child.targets[0] if isinstance(child, ast.Assign) else child.target
            yield (ast.unparse(target), "variable", *span, None, parent, False, None, None)
        elif isinstance(child, ast.Call) and caller is not None:
            called = child.func
            name = called.id if isinstance(called, ast.Name) else called.attr if isinstance(called, ast.Attribute) else None
            if name:
                yield (None, None, span[0], span[1], None, None, True, name, caller)
        yield from _walk(child, inner, inner_class, inner_caller, False)


def parsed(files: DataFrame) -> DataFrame:
    """Symbols and call sites of ``file_path, text``; of a file that Python can't parse, one row of kind ``error`` with the reason.

    A call lies in the innermost function around it; calls outside of functions are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append((path, f"{type(e).__name__}: {e}", "error", 0, 0, None, None, False, None, None))
                    continue
                rows += [(path, *r) for r in _walk(tree, None, False, None, True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"caller_line": "Int32"})

    return files.select("file_path", "text").mapInPandas(run, _OUT)
