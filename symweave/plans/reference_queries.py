"""Driver queries of the engine's own operators, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.extract.symbols import extracted
from symweave.functions.paths import in_skipped_folder, is_secret, language_of, matches_any, suffix
from symweave.functions.text import embedding_text, first_line
from symweave.operators import freshness, fulltext, fusion, graph, lookup, stats, store, vectors
from symweave.operators.hierarchy import current_rows
from symweave.schemas import LARGE_FILE, SUFFIXES
from symweave.session import cut, table
from symweave.sources.files import line_range, lines
from symweave.streaming.watch import bursts

KEYWORD = "oRder%t"


def _symbols(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current row of each symbol, with the given columns, or all."""
    rows = table(s, d, "symbols")
    return current_rows(rows.select("id", *columns, "indexed_at") if columns else rows)


def _files(s: SparkSession, d: str) -> DataFrame:
    """The latest state of each file."""
    files = table(s, d, "indexed_files")
    rest = [c for c in files.columns if c not in ("file_path", "indexed_at")]
    return files.groupBy("file_path").agg(F.max(F.struct("indexed_at", *rest)).alias("r")).select("file_path", "r.*")


def _calls(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "symbol_calls").where("caller_id is not null and callee_name is not null").dropDuplicates(["id"])


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), "embedding")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file_path"), "doc_id", "source", "lang", "text")


def scan_filtered_files(s, d):
    """Paths of moderate size below no skipped folder, not secret, Python or Go, without tests."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), "^([A-Za-z]:)?/srv/checkouts/", "")
    rows = table(s, d, "indexed_files").select("file_path", "file_size", path.alias("p")).distinct()
    kept = (F.col("file_size") < LARGE_FILE) & ~in_skipped_folder(F.col("p")) & ~is_secret(F.col("p"))
    return rows.where(kept & matches_any(F.col("p"), ["*.py", "*.go"]) & ~matches_any(F.col("p"), ["*/tests/*"])).select("file_path", "file_size")


def language_detect(s, d):
    path = F.regexp_replace("file_path", r"\\", "/")
    return table(s, d, "indexed_files").select("file_path", suffix(path).alias("suffix"), language_of(path).alias("language")).distinct()


def file_checksum(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"))


def lines_exploded(s, d):
    return lines(table(s, d, "documents"), "doc_id").select("doc_id", "line_no", F.sha2("line", 256).alias("line"))


def line_range_read(s, d):
    return table(s, d, "file_heads").where("head is not null").select("file_path", line_range(F.col("head"), 2, 3).alias("text"))


def _some_file(s, d):
    """The file with the most symbols, the first by path among equals."""
    return _symbols(s, d, "file_path").groupBy("file_path").count().orderBy(F.desc("count"), "file_path").limit(1).select("file_path")


def file_outline(s, d):
    return _symbols(s, d, "file_path", *lookup.OUTLINE).join(F.broadcast(_some_file(s, d)), "file_path").select("id", *lookup.OUTLINE)  # one row


def outline_sections(s, d):
    path = _some_file(s, d).head()["file_path"]
    return lookup.outline_sections(_symbols(s, d, "file_path", *lookup.OUTLINE), path)


def outline_summary(s, d):
    return lookup.outline_summary(_symbols(s, d, "name", "kind", "file_path", "start_line", "end_line", "signature"))


def file_header(s, d):
    return lookup.file_header(_symbols(s, d, "kind", "file_path", "start_line", "end_line"))


def symbol_by_name(s, d):
    return lookup.by_name(_symbols(s, d), "init")


def symbol_body(s, d):
    heads = table(s, d, "file_heads").select("file_path", F.col("head").alias("text")).where("text is not null")
    return lookup.bodies(_symbols(s, d), heads).select("file_path", "start_line", "name", "body")


def keyword_search(s, d):
    return lookup.keyword_search(_symbols(s, d, "name", "file_path", "start_line"), KEYWORD).select("id", "name", "file_path")


def keyword_post_limit_filter(s, d):
    return lookup.keyword_search(_symbols(s, d, "name", "kind", "file_path", "start_line"), "a", limit=200, kind="function").select("id", "name", "file_path")


def status_counts(s, d):
    return stats.status(files=_files(s, d), symbols=table(s, d, "symbols").select("id").distinct(), vectors=table(s, d, "vec_symbols"))


def language_top8(s, d):
    return stats.languages(_files(s, d).withColumn("language", F.lower(F.trim("language"))))


def dir_rollup(s, d):
    return stats.folders(_files(s, d))


def symbol_count_per_file(s, d):
    return stats.symbols_per_file(_files(s, d), _symbols(s, d, "file_path"))


def callers(s, d):
    return graph.callers(_calls(s, d), _symbols(s, d, *lookup.SYMBOL[:6]), "format")


def callees(s, d):
    return graph.callees(_calls(s, d), _symbols(s, d, "name", "file_path"), "init")


def call_degrees(s, d):
    """Calls made and received of every symbol name."""
    made = _calls(s, d).join(_symbols(s, d, "name").select(F.col("id").alias("caller_id"), "name"), "caller_id").groupBy("name").agg(F.count("*").alias("made"))
    got = _calls(s, d).groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("received"))
    return made.join(got, "name", "full").select("name", F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("received", F.lit(0)).alias("received"))


def homonym_callers(s, d):
    return graph.first_homonym(_calls(s, d), _symbols(s, d, "name", "file_path", "start_line"))


def missing_vectors(s, d):
    wanted = _symbols(s, d, "name", "kind").where("kind in ('function', 'method', 'class')")
    return vectors.missing(wanted, table(s, d, "vec_symbols")).select("id", "name")


def semi_delete_survivors(s, d):
    gone = table(s, d, "removed_symbols").select(F.col("symbol_id").alias("caller_id"))
    return _calls(s, d).join(gone.distinct(), "caller_id", "left_anti").select("id", "caller_id", "callee_name")


def deleted_file_survivors(s, d):
    return store.without_files(_symbols(s, d, "file_path"), table(s, d, "removed_symbols").where("file_path is not null")).select("id", "file_path")


def stale_files(s, d):
    """Indexed files without a symbol of theirs: what a pruning by the files that have any would drop."""
    return _files(s, d).join(table(s, d, "symbols").select("file_path").distinct(), "file_path", "left_anti").select("file_path")


def enclosing_symbol(s, d):
    functions = _symbols(s, d, "kind", "file_path", "start_line", "end_line").where("kind in ('function', 'method')")
    files = _symbols(s, d, "file_path").select(F.col("id").alias("caller_id"), "file_path")
    sites = _calls(s, d).join(files, "caller_id").select("id", "file_path", F.col("call_line").alias("line"))
    return graph.enclosing(sites, functions).select("id", "caller_id")


def symbol_ordinals(s, d):
    return stats.ordinals(_symbols(s, d, "file_path", "start_line").select("id", "file_path", "start_line"), "file_path", "start_line", "id").select("id", "ordinal")


def _two_states(s, d):
    """Stored files and what a later listing would find: some gone, some changed, some new."""
    n = F.pmod(F.length("file_path") + F.coalesce(F.col("symbol_count"), F.lit(0)), F.lit(7))
    files = _files(s, d).withColumn("n", n)
    later = files.where("n <> 0").select(
        "file_path",
        F.when(F.col("n") == 1, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"),
        F.when(F.col("n") <= 2, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        F.when(F.col("n") == 1, F.lit("changed")).otherwise(F.col("checksum")).alias("checksum"),
    )
    return files.where("n <> 3"), later


def freshness_status(s, d):
    return freshness.compared(*_two_states(s, d)).select("file_path", "status")


def build_freshness(s, d):
    return freshness.compared(*_two_states(s, d), by_checksum=False).select("file_path", "status")


def build_stats(s, d):
    return freshness.run_counts(freshness.compared(*_two_states(s, d), by_checksum=False), large=100_000)


def upsert_files(s, d):
    stored, later = _two_states(s, d)
    columns = ["file_path", "file_size", "mtime_ns", "checksum"]
    return store.upserted(stored.select(columns), later.select(columns), "file_path")


def touch_metadata(s, d):
    stored, later = _two_states(s, d)
    return store.touched(stored.select("file_path", "checksum", "file_size", "mtime_ns"), later)


def replace_symbols(s, d):
    """The older rows of symbols replaced, file by file, by the current ones of the files that have any."""
    old = table(s, d, "symbols").select("id", "file_path", "name")
    new = _symbols(s, d, "kind", "file_path", "name").where("kind <> 'import'").select("id", "file_path", "name")
    return store.replaced(old, new, new, "file_path")


def _documents_tokens(s, d, stem=False):
    return fulltext.tokenized(table(s, d, "documents"), "doc_id", ["text", "source"], stem=stem)


def bm25_topk(s, d):
    return fulltext.match(_documents_tokens(s, d), "broken writers", stem=False)


def bm25_postings(s, d):
    """As the plain search, from a written table of postings."""
    tokens = _documents_tokens(s, d)
    posted, lengths = cut(fulltext.postings(tokens).sortWithinPartitions("term")), cut(fulltext.row_lengths(tokens))
    return fulltext.match_postings(posted, lengths, fulltext.query_phrases("broken writers", stem=False))


def bm25_stemmed(s, d):
    """As the plain search, on stems: SQL has none, the tests compare it with an independent index."""
    return fulltext.match(_documents_tokens(s, d, stem=True), "restoring the broken writer")


def fts_or(s, d):
    return fulltext.search(_documents_tokens(s, d), [["merged"], ["sorted"]], any_of=True)


def fts_phrase(s, d):
    return fulltext.search(_documents_tokens(s, d), [["keeps", "a", "copy"]])


def fts_prefix(s, d):
    return fulltext.search(_documents_tokens(s, d), [["seriali"]], prefix=True)


def fts_column(s, d):
    return fulltext.search(_documents_tokens(s, d), [["wiki"]], field="source")


def _query_vector(s, d):
    return [float(x) for x in _vectors(s, d).orderBy("symbol_id").limit(1).head()["embedding"]]


def knn_l2(s, d):
    return vectors.nearest(_vectors(s, d), _query_vector(s, d))


def rrf_fusion(s, d):
    words = fusion.ranked(fulltext.match(_documents_tokens(s, d), "broken", stem=False), F.desc("score"), "id")
    near = fusion.ranked(knn_l2(s, d).withColumnRenamed("symbol_id", "id"), "distance", "id")
    return fusion.fused([words, near])


def embed_text(s, d):
    return _symbols(s, d, "name", "signature", "docstring").select("id", embedding_text().alias("text"))


def encoded_symbols(s, d):
    """Vectors of all symbols by the stand-in encoder; the tests check it."""
    return vectors.encoded(_symbols(s, d, "name", "signature", "docstring"), vectors.hashed_encoder(64))


def export_rows(s, d):
    return lookup.export_rows(_symbols(s, d))


def json_rows(s, d):
    return lookup.as_json(_symbols(s, d, "name", "start_line", "parent_name").select("id", "name", "start_line", "parent_name"))


def import_names(s, d):
    return _symbols(s, d, "kind", "signature").where("kind = 'import'").select("id", first_line(F.col("signature"), 20).alias("name"))


def debounce_sessions(s, d):
    return bursts(table(s, d, "events").withColumnRenamed("ts", "at"), "600 seconds", "user_id").select(
        "user_id", F.col("started").cast("timestamp_ntz").alias("started"), "events"
    )


def extracted_symbols(s, d):
    """Declarations in all heads, Python by its parser, the rest by the line rules; the tests have golden files."""
    heads = table(s, d, "file_heads").withColumn("language", language_of(F.regexp_replace("file_path", r"\\", "/")))
    return extracted(heads.select("file_path", "language", F.col("head").alias("text")).where("language is not null"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        scan_filtered_files, language_detect, file_checksum, lines_exploded, line_range_read, file_outline, outline_sections, outline_summary, file_header,
        symbol_by_name, symbol_body, keyword_search, keyword_post_limit_filter, status_counts, language_top8, dir_rollup, symbol_count_per_file,
        callers, callees, call_degrees, homonym_callers, missing_vectors, semi_delete_survivors, deleted_file_survivors, stale_files,
        enclosing_symbol, symbol_ordinals, freshness_status, build_freshness, build_stats, upsert_files, touch_metadata, replace_symbols,
        bm25_topk, bm25_postings, bm25_stemmed, fts_or, fts_phrase, fts_prefix, fts_column, knn_l2, rrf_fusion, embed_text, encoded_symbols, export_rows,
        json_rows, import_names, debounce_sessions, extracted_symbols,
    )
}

_S = "s as (select * exclude (rn) from (select *, row_number() over (partition by id order by indexed_at desc) as rn from symbols) where rn = 1)"
# Of several states at one time, the greatest by the other columns counts, null being the smallest.
_F = """f as (select * exclude (rn) from (select *, row_number() over (partition by file_path order by indexed_at desc,
  checksum desc nulls last, git_head desc nulls last, symbol_count desc nulls last, language desc nulls last, file_size desc nulls last,
  mtime_ns desc nulls last) as rn from indexed_files) where rn = 1)"""
_C = "c as (select distinct * from symbol_calls where caller_id is not null and callee_name is not null)"
_STATES = (
    "with "
    + _F
    + """, m as (select *, (length(file_path) + coalesce(symbol_count, 0)) % 7 as n from f),
stored as (select * from m where n <> 3),
later as (select file_path, case when n = 1 then file_size + 1 else file_size end as file_size,
  case when n <= 2 then mtime_ns + 1 else mtime_ns end as mtime_ns, case when n = 1 then 'changed' else checksum end as checksum from m where n <> 0)
"""
)


def _status(by_checksum: bool) -> str:
    touched = "when l.checksum = o.checksum then 'touched'" if by_checksum else ""
    return f"""select coalesce(o.file_path, l.file_path) as file_path, case when l.file_path is null then 'gone' when o.file_path is null then 'new'
when l.file_size is not distinct from o.file_size and l.mtime_ns is not distinct from o.mtime_ns then 'current' {touched} else 'stale' end as status
from stored o full join later l on o.file_path = l.file_path"""


def _bm25(f: str, where: str) -> str:
    """``f``: columns f0, f1, ... by row of the table t(doc_id, text tokens x, source tokens y)."""
    n = f.count(" as f")
    score = " + ".join(
        f"greatest(ln(((select count(*) from t) - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / (select avg(len) from t)))"
        for k in range(n)
    )
    counts = ", ".join(f"(select count(*) from p where f{k} > 0) as n{k}" for k in range(n))
    return rf"""with t as (select doc_id, x, y, len(x) + len(y) as len from (select doc_id,
  regexp_extract_all(lower(strip_accents(nfc_normalize(coalesce(text, '')))), '[\p{{L}}\p{{N}}]+') as x, regexp_extract_all(lower(coalesce(source, '')), '[\p{{L}}\p{{N}}]+') as y from documents)),
p as (select doc_id, len, {f} from t)
select doc_id as id, round({score}, 9) as score from (select *, {counts} from p) where {where} order by score desc, id limit 10"""


def _count(test: str) -> str:
    return f"len(list_filter(x, lambda w: {test})) + len(list_filter(y, lambda w: {test}))"


_NEAR = """q as (select embedding as v from embeddings order by vec_id limit 1),
near as (select vec_id as symbol_id, round(sqrt(list_sum([power(cast(embedding[i] as double) - cast(q.v[i] as double), 2) for i in range(1, len(q.v) + 1)])), 6) as distance
  from embeddings, q where len(embedding) = len(q.v)),
top as (select symbol_id, distance from near order by distance, symbol_id limit 10)"""

_LANGUAGES = " ".join(f"when suffix = '{suffix_}' then '{language}'" for suffix_, language in SUFFIXES.items())
_LIKE = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%{1}%'"
_SHOWN = "start_line || '-' || end_line || ' [' || kind || '] ' || case when signature <> '' then signature else name end"

ORACLES = {
    "scan_filtered_files": f"""with r as (select distinct file_path, file_size, regexp_replace(replace(file_path, '\\', '/'), '^([A-Za-z]:)?/srv/checkouts/', '') as p from indexed_files)
select file_path, file_size from r where file_size < {LARGE_FILE} and not regexp_matches('/' || p, '/(\\.[^/]*|node_modules|__pycache__|dist|build|venv)/')
and regexp_extract(p, '[^/]*$') not in ('.env', '.env.local', '.env.production', '.env.development') and regexp_matches(p, '\\.(py|go)$') and p not like '%/tests/%'""",
    "language_detect": rf"""with r as (select distinct file_path, regexp_extract(regexp_extract(replace(file_path, '\', '/'), '[^/]*$'), '[^.].*?(\.[^.]+)$', 1) as suffix from indexed_files)
select file_path, suffix, case {_LANGUAGES} end as language from r""",
    "file_checksum": "select doc_id, sha256(text) as checksum from documents where text is not null",
    "lines_exploded": r"""with l as (select doc_id, regexp_split_to_array(text, '\r?\n') as a from documents where text is not null)
select doc_id, cast(k as int) as line_no, sha256(a[k]) as line from (select doc_id, a, unnest(range(1, len(a) + 1)) as k from l)""",
    "line_range_read": """select file_path, array_to_string(list_slice(string_split(head, chr(10)), 2, 3), chr(10)) as text from file_heads where head is not null""",
    "file_outline": f"""with {_S} select id, name, kind, start_line, end_line, signature, parent_name from s
where file_path = (select file_path from s group by 1 order by count(*) desc, file_path limit 1)""",
    "outline_sections": f"""with {_S} select name, kind, start_line, end_line, signature, parent_name, case when kind in ('import', 'variable') then 0 else 1 end as section from s
where file_path = (select file_path from s group by 1 order by count(*) desc, file_path limit 1)""",
    "outline_summary": f"""with {_S} select file_path, string_agg({_SHOWN}, chr(10) order by start_line, id) as summary from s group by 1""",
    "file_header": f"""with {_S} select file_path, coalesce(max(case when kind in ('import', 'variable') and start_line < 50 then end_line end), 20) as header_end from s group by 1""",
    "symbol_by_name": f"""with {_S} select name, kind, file_path, start_line, end_line, signature, docstring, parent_name, language from s where name = 'init' order by file_path, start_line, id limit 1""",
    "symbol_body": f"""with {_S} select s.file_path, s.start_line, s.name, array_to_string(list_slice(string_split(h.head, chr(10)), greatest(start_line, 1), end_line), chr(10)) as body
from s join file_heads h on h.file_path = s.file_path where h.head is not null""",
    "keyword_search": f"""with {_S} select id, name, file_path from s where {_LIKE.format("name", "order%t")} or {_LIKE.format("file_path", "order%t")}
order by name, file_path, start_line, id limit 20""",
    "keyword_post_limit_filter": f"""with {_S} select id, name, file_path from (select * from s where {_LIKE.format("name", "a")} or {_LIKE.format("file_path", "a")}
order by name, file_path, start_line, id limit 200) where kind = 'function'""",
    "status_counts": """select 'files' as "table", count(distinct file_path) as "rows" from indexed_files union all
select 'symbols', count(distinct id) from symbols union all select 'vectors', count(*) from vec_symbols""",
    "language_top8": f"""with {_F}, t as (select lower(trim(language)) as language, count(*) as files from f where language is not null group by 1 order by 2 desc, 1 limit 8)
select language, files, cast(floor(20 * files / max(files) over ()) as int) as bar from t""",
    "dir_rollup": f"""with {_F} select case when file_path like '%/%' then regexp_replace(file_path, '/[^/]*$', '') else '' end as folder, count(*) as files, cast(coalesce(sum(symbol_count), 0) as bigint) as symbols from f group by 1""",
    "symbol_count_per_file": f"""with {_S}, n as (select file_path, count(*) as n from s group by 1)
select p.file_path, coalesce(n.n, 0) as symbols from (select distinct file_path from indexed_files) p left join n on n.file_path = p.file_path""",
    "callers": f"""with {_S}, {_C} select s.id, s.name, s.kind, s.file_path, s.start_line, s.end_line, s.signature, c.callee_name, c.call_line from c join s on s.id = c.caller_id where c.callee_name = 'format'""",
    "callees": f"""with {_S}, {_C} select s.id as caller_id, s.name as caller_name, s.file_path, c.callee_name, c.call_line from c join s on s.id = c.caller_id where s.name = 'init'""",
    "call_degrees": f"""with {_S}, {_C}, m as (select s.name, count(*) as made from c join s on s.id = c.caller_id group by 1), g as (select callee_name as name, count(*) as received from c group by 1)
select coalesce(m.name, g.name) as name, coalesce(made, 0) as made, coalesce(received, 0) as received from m full join g on m.name = g.name""",
    "homonym_callers": f"""with {_S}, {_C}, h as (select *, first_value(id) over (partition by name, file_path order by start_line, id) as first_id from s)
select h.file_path, h.first_id as caller_id, c.callee_name, c.call_line from c join h on h.id = c.caller_id""",
    "missing_vectors": f"""with {_S} select id, name from s where kind in ('function', 'method', 'class') and not exists (select 1 from vec_symbols v where v.symbol_id = s.id)""",
    "semi_delete_survivors": f"""with {_C} select id, caller_id, callee_name from c where caller_id not in (select symbol_id from removed_symbols where symbol_id is not null)""",
    "deleted_file_survivors": f"""with {_S} select id, file_path from s where file_path not in (select file_path from removed_symbols where file_path is not null)""",
    "stale_files": """select distinct file_path from indexed_files where file_path not in (select file_path from symbols where file_path is not null)""",
    "enclosing_symbol": f"""with {_S}, {_C}, site as (select c.id, s.file_path, c.call_line as line from c join s on s.id = c.caller_id),
r as (select site.id, s.id as caller_id, row_number() over (partition by site.id, site.line, site.file_path order by s.end_line - s.start_line, s.start_line, s.id) as rn
from site join s on s.file_path = site.file_path and site.line between s.start_line and s.end_line where s.kind in ('function', 'method'))
select id, caller_id from r where rn = 1""",
    "symbol_ordinals": f"""with {_S} select id, cast(row_number() over (partition by file_path order by start_line, id) as int) as ordinal from s""",
    "freshness_status": _STATES + _status(True),
    "build_freshness": _STATES + _status(False),
    "build_stats": _STATES
    + f""", st as ({_status(False)}), z as (select st.*, coalesce(l.file_size >= 100000, false) as big from st left join later l on l.file_path = st.file_path)
select count(*) filter (status <> 'gone') as files, count(*) filter (status in ('new', 'stale') and not big) as indexed,
count(*) filter (status in ('new', 'stale') and big) as large_skipped, count(*) filter (status = 'current') as unchanged, count(*) filter (status = 'gone') as pruned from z""",
    "upsert_files": _STATES
    + """select file_path, file_size, mtime_ns, checksum from later union all
select file_path, file_size, mtime_ns, checksum from stored where file_path not in (select file_path from later)""",
    "touch_metadata": _STATES
    + """select o.file_path, o.checksum, case when l.file_path is null then o.file_size else l.file_size end as file_size,
case when l.file_path is null then o.mtime_ns else l.mtime_ns end as mtime_ns from stored o left join later l on l.file_path = o.file_path""",
    "replace_symbols": f"""with {_S}, n as (select id, file_path, name from s where kind <> 'import')
select id, file_path, name from n union all select id, file_path, name from symbols where file_path not in (select file_path from n)""",
    "bm25_topk": _bm25(_count("w = 'broken'") + " as f0, " + _count("w = 'writers'") + " as f1", "f0 > 0 and f1 > 0"),
    "fts_or": _bm25(_count("w = 'merged'") + " as f0, " + _count("w = 'sorted'") + " as f1", "f0 > 0 or f1 > 0"),
    "fts_phrase": _bm25(
        "len([i for i in range(1, len(x) - 1) if x[i] = 'keeps' and x[i + 1] = 'a' and x[i + 2] = 'copy']) as f0", "f0 > 0"
    ),
    "fts_prefix": _bm25(_count("w like 'seriali%'") + " as f0", "f0 > 0"),
    "fts_column": _bm25("len(list_filter(y, lambda w: w = 'wiki')) as f0", "f0 > 0"),
    "knn_l2": f"with {_NEAR} select symbol_id, distance from top",
    "rrf_fusion": "with words as ("
    + _bm25(_count("w = 'broken'") + " as f0", "f0 > 0")
    + f"""), {_NEAR}, lists as (select id, 0 as l, row_number() over (order by score desc, id) - 1 as r from words union all
select symbol_id, 1, row_number() over (order by distance, symbol_id) - 1 from top)
select id, round(sum(1.0::double / (60 + r)), 9) as score from lists group by id order by score desc, min(struct_pack(l := l, r := r)), id limit 5""",
    "embed_text": f"""with {_S} select id, trim(name || ' ' || coalesce(signature, '') || ' ' || coalesce(docstring, ''), ' ') as text from s""",
    "export_rows": f"""with {_S} select name, kind, file_path, start_line, end_line, signature, docstring, parent_name, language, checksum from s""",
    "json_rows": f"""with {_S} select cast(to_json(struct_pack(id := id, name := name, start_line := start_line, parent_name := parent_name)) as varchar) as json from s""",
    "import_names": f"""with {_S} select id, substring(trim(string_split(signature, chr(10))[1], ' '), 1, 20) as name from s where kind = 'import'""",
    "debounce_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over w < interval 600 second then 0 else 1 end as fresh from events where ts is not null window w as (partition by user_id order by ts)),
g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from e)
select user_id, min(ts) as started, count(*) as events from g group by user_id, burst""",
}
ORACLES["bm25_postings"] = ORACLES["bm25_topk"]
