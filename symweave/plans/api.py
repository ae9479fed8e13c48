"""The query tools over one index: each returns a DataFrame, and none changes the index but the first three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.extract.symbols import symbols_and_calls
from symweave.functions.paths import project_path
from symweave.operators import freshness, fulltext, fusion, graph, lookup, vectors
from symweave.operators.store import Store
from symweave.session import cut, scratch
from symweave.sources.catalogs import sqlite_symbols
from symweave.sources.files import Rule, blake2b_udf, contents, decoded, ignore_rules, indexable, line_range, scan, small_text

SEARCHED = ["name", "kind", "file_path", "signature", "docstring"]


class Index:
    """An index of the tree at ``root``, kept in ``folder``."""

    def __init__(self, spark: SparkSession, root: str, folder: str, encoder: vectors.Encoder | None = None) -> None:
        self.spark, self.root, self.encoder = spark, project_path(root), encoder
        self.store = Store(spark, folder)

    # Building

    def ignored(self, names: Sequence[str] = (".gitignore",)) -> list[Rule]:
        """The rules of the ignore files at the root that are there."""
        return [rule for name in names for rule in ignore_rules((small_text(f"{self.root}/{name}") or "").splitlines())]

    def _listing(self, ignored: Sequence[Rule] | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        files = scan(self.spark, self.root)
        kept = indexable(files, self.root, ignored=self.ignored() if ignored is None else ignored, include=include, exclude=exclude)
        return kept.select("file_path", "language", "file_size", "mtime_ns", F.lit(None).cast("string").alias("checksum"))

    def _index(self, paths: DataFrame) -> list[dict[str, str]]:
        """Index files and return those that couldn't be read or parsed; only these files are read, and only their buckets written."""
        read = cut(contents(paths))
        unread = read.where("content is null").select("file_path", "error")
        paths = paths.join(unread, "file_path", "left_anti")  # to be tried again
        content = read.drop("error").join(paths, "file_path")
        catalogs = content.where("language = 'sqlite'")
        texts = cut(decoded(content.where("language <> 'sqlite'").select("file_path", "language", "file_size", "mtime_ns", "content")))
        symbols, calls, errors = symbols_and_calls(texts)
        tables = sqlite_symbols(catalogs).select(
            F.xxhash64("file_path", "start_line", "name").alias("id"), "name", "kind", "file_path", "start_line", "end_line", "signature",
            F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("parent_name"), F.lit(None).cast("bigint").alias("parent_id"),
            F.lit("sqlite").alias("language"), F.lit("").alias("checksum"), F.current_timestamp().alias("indexed_at"),
        )
        symbols, calls = cut(symbols.unionByName(tables)), cut(calls)
        counts = symbols.groupBy("file_path").agg(F.count("*").cast("int").alias("symbol_count"))
        sums = texts.select("file_path", "checksum")
        files = paths.drop("checksum").join(sums, "file_path", "left").join(counts, "file_path", "left")
        rows = files.select(
            "file_path", F.coalesce("checksum", F.lit("")).alias("checksum"), F.lit(None).cast("string").alias("git_head"),
            F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), "language", "file_size", "mtime_ns", F.current_timestamp().alias("indexed_at"),
        )
        tokens = fulltext.tokenized(symbols.withColumn("path", F.col("file_path")), "id", [c if c != "file_path" else "path" for c in SEARCHED], "file_path")
        tokens = cut(tokens.replace("path", "file_path", "field"))
        more = {"postings": fulltext.postings(tokens, "file_path"), "lengths": fulltext.row_lengths(tokens, "file_path")}
        if self.encoder:
            more["vectors"] = vectors.encoded(symbols, self.encoder).join(symbols.select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id")
        self.store.replace_files(cut(rows), symbols=symbols, calls=calls, **more)
        return [r.asDict() for r in errors.union(unread).orderBy("file_path").collect()]  # one row for each file that has changed and is broken

    def _done(self, status: DataFrame, errors: list[dict[str, str]], **options) -> DataFrame:
        """The counts of a run with the number of errors and the first ten."""
        details = F.array(*[F.struct(F.lit(e["file_path"]).alias("file"), F.lit(e["error"]).alias("error")) for e in errors[:10]])
        return freshness.run_counts(status, **options).select(
            "*", F.lit(len(errors)).alias("errors"), details.cast("array<struct<file string, error string>>").alias("error_details")
        )

    def build(self, *, force: bool = False, ignored: Sequence[Rule] | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        """Index new and changed files and drop those that are gone; returns the counts.

        A file whose size and time are as stored is skipped unless forced; large files are. The
        ignore file at the root counts unless rules are given.
        """
        with scratch() as keep:
            listing = cut(self._listing(ignored, include, exclude))
            status = keep(cut(freshness.compared(self.store.table("files"), listing, by_checksum=False)))
            wanted = status.where("status in ('new', 'stale')" if not force else "status <> 'gone'").where(F.col("file_size") < freshness.LARGE_FILE)
            paths = cut(listing.join(wanted.select("file_path"), "file_path"))
            self.store.prune(scan(self.spark, self.root).select("file_path"))
            errors = [] if paths.isEmpty() else self._index(paths)
            self.store.vacuum()
            return self._done(status, errors)

    def update(self, *, ignored: Sequence[Rule] | None = None) -> DataFrame:
        """As :meth:`build`, with large files.

        A file of another size or time whose content is as stored is only noted as seen. Contents
        are read only of files whose size or time has changed.
        """
        with scratch() as keep:
            listing = cut(self._listing(ignored))
            stored = self.store.table("files")
            differing = freshness.compared(stored, listing, by_checksum=False).where("status in ('new', 'stale')").select("file_path")
            sums = contents(differing).select("file_path", blake2b_udf("content").alias("sum"))
            hashed = cut(listing.join(sums, "file_path", "left").withColumn("checksum", F.col("sum")).drop("sum"))
            status = keep(cut(freshness.compared(stored, hashed)))
            seen = cut(hashed.join(status.where("status = 'touched'").select("file_path"), "file_path"))
            if not seen.isEmpty():
                self.store.touch_files(seen)
            self.prune()
            paths = cut(hashed.join(status.where("status in ('new', 'stale')").select("file_path"), "file_path"))
            errors = [] if paths.isEmpty() else self._index(paths)
            self.store.vacuum()
            return self._done(status, errors, large=2**62)

    def refresh(self, paths: DataFrame) -> None:
        """Index the given files (``file_path``) again, as they are now."""
        with scratch():
            self._index(cut(self._listing().join(paths.select("file_path").distinct(), "file_path")))

    def freshen(self, file_path: str) -> bool:
        """Index a file again if its size or time isn't as stored, before it is read; whether it was."""
        with scratch():
            here = cut(self._listing().where(F.col("file_path") == file_path))
            stored = self.store.table("files").where(F.col("file_path") == file_path)
            status = [r.status for r in freshness.compared(stored, here, by_checksum=False).collect()]  # one file
            if status in (["new"], ["stale"]):
                self._index(here)
            elif status == ["gone"]:
                self.store.delete_files(stored.select("file_path"))
            return status not in ([], ["current"])

    def prune(self) -> int:
        """Drop the files that are gone; returns how many."""
        return self.store.prune(scan(self.spark, self.root).select("file_path"))

    def refresh_vectors(self, *, full: bool = False) -> None:
        """Give every symbol without a vector one; with ``full``, as after a change of the encoder, every symbol."""
        if self.encoder:
            with scratch():
                symbols = self.store.table("symbols")
                found = vectors.encoded(symbols, self.encoder) if full else vectors.backfilled(symbols, self.store.table("vectors"), self.encoder)
                self.store.write(vectors=cut(found.join(symbols.select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id")))

    # Queries

    def list_outline(self, file_path: str) -> DataFrame:
        return lookup.outline(self.store.table("symbols"), file_path)

    def outline_summary(self, file_path: str) -> DataFrame:
        return lookup.outline_summary(self.store.table("symbols").where(F.col("file_path") == file_path))

    def get_symbol(self, name: str, file_path: str | None = None) -> DataFrame:
        return lookup.by_name(self.store.table("symbols"), name, file_path)

    def _text(self, file_path: str) -> DataFrame:
        return decoded(contents(self.spark.createDataFrame([(file_path,)], "file_path string"))).select("file_path", "text")

    def read_symbol_body(self, name: str, file_path: str) -> DataFrame:
        return lookup.bodies(lookup.by_name(self.store.table("symbols"), name, file_path), self._text(file_path))

    def get_line_range(self, file_path: str, start: int, end: int) -> DataFrame:
        return self._text(file_path).select(line_range(F.col("text"), start, end).alias("text"))

    def get_file_header(self, file_path: str) -> DataFrame:
        ends = lookup.file_header(self.store.table("symbols").where(F.col("file_path") == file_path))
        text = self._text(file_path).join(ends, "file_path", "left")
        return text.select(line_range(F.col("text"), F.lit(1), F.coalesce("header_end", F.lit(20))).alias("text"))

    def find_by_keyword(self, query: str, **options) -> DataFrame:
        return lookup.keyword_search(self.store.table("symbols"), query, **options)

    def full_text(self, query: str, limit: int = 10, **options) -> DataFrame:
        """The best symbols by BM25 from the stored postings; options of :func:`fulltext.match_postings`. A query without words finds nothing."""
        best = fulltext.match_postings(self.store.table("postings"), self.store.table("lengths"), fulltext.query_phrases(query), limit=limit, **options)
        return best.join(self.store.table("symbols"), "id").orderBy(F.desc("score"), "id").select(*lookup.SEARCH, "score")

    def resolve_edit_target(self, description: str, limit: int = 5) -> DataFrame:
        """The symbols that fit a description best, by words and, with an encoder, by vectors."""
        lists = [fusion.ranked(self.full_text(description, 2 * limit), F.desc("score"), "id")]
        if self.encoder:
            near = vectors.nearest(self.store.table("vectors"), self.encoder([description])[0], 2 * limit)
            lists.append(fusion.ranked(near.withColumnRenamed("symbol_id", "id"), "distance", "id"))
        best = fusion.fused(lists, limit)
        return best.join(self.store.table("symbols"), "id").orderBy(F.desc("score"), "id").select(*lookup.SEARCH, "score")

    def find_callers(self, name: str) -> DataFrame:
        return graph.callers(self.store.table("calls"), self.store.table("symbols"), name)

    def find_callees(self, name: str) -> DataFrame:
        return graph.callees(self.store.table("calls"), self.store.table("symbols"), name)
