"""Path predicates as column expressions."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from symweave.schemas import FILE_NAMES, SECRET_FILES, SKIPPED_FOLDERS, SUFFIXES


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder of a path; empty if it has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or empty. Leading dots begin a name, not a suffix."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1)


def language_of(path: Column) -> Column:
    """The language by whole name, else by suffix, case counting; null if neither is known."""
    names = F.create_map([F.lit(x) for x in chain(*FILE_NAMES.items())])
    suffixes = F.create_map([F.lit(x) for x in chain(*SUFFIXES.items())])
    return F.coalesce(F.try_element_at(names, basename(path)), F.try_element_at(suffixes, suffix(path)))


def is_secret(path: Column) -> Column:
    return basename(path).isin(SECRET_FILES)


def in_skipped_folder(relative: Column) -> Column:
    """Whether a folder of the path below the root is hidden or never entered."""
    folders = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(SKIPPED_FOLDERS))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1_000_000)).otherwise(path)


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether a shell pattern matches the whole path. A star also matches slashes."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join("^" + fnmatch.translate(g).replace(r"\Z", r"\z") for g in globs))


def project_path(path: str | None = None) -> str:
    """The root of a project as an absolute path: as given, else as SYMWEAVE_PROJECT names it, else the working folder."""
    return os.path.abspath(os.path.expanduser(path or os.environ.get("SYMWEAVE_PROJECT") or "."))
