"""Driver queries of the general training-data operators: orphan references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import hierarchy as h
from symweave.operators.orphans import orphan_calls
from symweave.session import cut, table


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return orphan_calls(table(spark, d, "symbol_calls"), table(spark, d, "symbols"), table(spark, d, "known_externals"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose caller or callee was unknown when they were recorded."""
    return p2_rows(spark, d).select("call_id", "field").distinct()


def p2_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan calls per field and month."""
    found = p2_rows(spark, d).groupBy("field", "month").agg(F.count("*").alias("orphan_calls"))
    return found.select("field", F.date_format("month", "yyyy-MM").alias("month"), "orphan_calls")


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    columns = ["id", "name", "file_path", "start_line", "end_line", "parent_id", "parent_name", "indexed_at"]
    rows = cut(h.current_rows(table(spark, d, "symbols").select(columns)))
    return h.hierarchy(h.parent_links(rows), paths=paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every symbol."""
    return _tree(spark, d, paths=False)


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root and number of descendants of every symbol that isn't on or below a loop."""
    path = F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("path")
    return _tree(spark, d).where("depth >= 0").select("id", path, "descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol and symbol above it."""
    return h.descendants(_tree(spark, d))


QUERIES = {
    "p2_found": p2_found,
    "p2_orphans_by_month": p2_orphans_by_month,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
}

_ORPHANS = """
with c as (select id, caller_id, trim(callee_name, chr(32) || chr(9)) as callee, indexed_at from symbol_calls),
i as (select id, min(indexed_at) as since from symbols group by 1),
n as (select name, min(indexed_at) as since from symbols group by 1),
orphan as (
  select c.id as call_id, 'caller_id' as field, c.indexed_at from c left join i on i.id = c.caller_id
  where c.caller_id is not null and not coalesce(i.since <= c.indexed_at, false)
  union all
  select c.id, 'callee_name', c.indexed_at from c left join n on n.name = c.callee
  where c.callee <> '' and not coalesce(n.since <= c.indexed_at, false)
    and c.callee not in (select name from known_externals where name is not null))
"""

_TREE = """
with recursive s as (
  select * from (select *, row_number() over (partition by id order by indexed_at desc) as rn from symbols) where rn = 1),
e as (
  select a.id, b.id as parent, row_number() over (partition by a.id order by b.end_line - b.start_line, b.id) as rn
  from s a join s b on a.file_path = b.file_path and a.parent_name = b.name
    and b.start_line <= a.start_line and b.end_line >= a.end_line and a.id <> b.id),
p as (
  select a.id, coalesce(b.id, e.parent) as parent
  from s a left join s b on a.parent_id = b.id left join e on e.id = a.id and e.rn = 1),
up as (
  select id, [id] as path, parent as top, coalesce(parent = id, false) as looped from p
  union all
  select up.id, list_prepend(up.top, up.path), p.parent, coalesce(list_contains(up.path, p.parent) or p.parent = up.top, false)
  from up join p on p.id = up.top where not up.looped),
loops as (
  select id, list_min(list_slice(path, 1, list_position(path, top))) as root_id from up where looped),
tree as (
  select id, path[1] as root_id, len(path) - 1 as depth, path from up where top is null and not looped
  union all
  select id, root_id, -1, null from loops)
"""

ORACLES = {
    "p2_found": _ORPHANS + "select distinct call_id, field from orphan",
    "p2_orphans_by_month": _ORPHANS
    + """select field, strftime(indexed_at, '%Y-%m') as month, count(distinct call_id) as orphan_calls from orphan group by 1, 2""",
    "p5_found": _TREE + "select id, root_id, cast(depth as int) as depth from tree",
    "p5_paths": _TREE
    + """, below as (select a as id, count(*) - 1 as n from (select unnest(path) as a from tree where depth >= 0) group by 1)
select tree.id, array_to_string(tree.path, '/') as path, below.n as descendants
from tree join below on below.id = tree.id where depth >= 0""",
    "p5_descendants": _TREE
    + """select path[k] as ancestor_id, id as descendant_id, cast(len(path) - k as int) as distance
from (select id, path, unnest(generate_series(1, len(path) - 1)) as k from tree where depth > 0)""",
}
