"""Parent-child links to full hierarchies: roots, depths, paths, descendants and loops.

Leaves are peeled off from the bottom, layer by layer, and send the sizes of their subtrees to
their parents; the layers in reverse order get roots, depths and paths from the parents. What
no peeling removes are loops. Trees of very great height would need as many layers, so the
spines that are left after ``layers`` rounds are finished by pointer doubling, in a number of
rounds that grows with the logarithm of the height.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.session import cut, is_cut, scratch

CLASSES = 31  # line spans are ints


def current_rows(symbols: DataFrame) -> DataFrame:
    """The row of each id with the latest ``indexed_at``; a null time comes before all others.

    Rows that tie are taken as equal; of different ones the greatest by its columns is kept.
    """
    columns = [c for c in symbols.columns if c not in ("id", "indexed_at")]
    latest = F.max(F.struct("indexed_at", *columns)).alias("row")
    return symbols.where("id is not null").groupBy("id").agg(latest).select("id", "row.*")


def line_bin(line: str) -> Column:
    return F.expr(f"shiftrightunsigned({line}, class)")


def parent_links(symbols: DataFrame) -> DataFrame:
    """``id, parent``: of each current symbol its parent's id, or null for a root.

    The parent is the row that ``parent_id`` names. Where there is none, it is the other row of
    the same file named ``parent_name`` whose lines enclose the row's, with the fewest lines,
    then the smallest id.

    Enclosing rows are found by a join on file, name, size class and a bin of lines as wide as
    the class, so that a file that holds very many rows of one name doesn't pair them all; rows
    over the same lines are first reduced to the two smallest ids (two, as a row isn't its own
    parent).
    """
    with scratch() as keep:
        return keep(cut(_parent_links(symbols)))


def _parent_links(symbols: DataFrame) -> DataFrame:
    rows = symbols.select("id", "name", "file_path", "start_line", "end_line", "parent_id", "parent_name")
    by_id = rows.join(rows.select(F.col("id").alias("parent_id"), F.lit(True).alias("there")), "parent_id", "left")
    direct = cut(by_id.select("id", F.when(F.col("there"), F.col("parent_id")).alias("direct"), *rows.columns[2:5], F.col("parent_name").alias("name")))
    lines = "start_line <= end_line and start_line >= 0 and name is not null"
    seeking = cut(direct.where(f"direct is null and {lines}").drop("direct"))
    # Only rows of a file and name that are sought can enclose.
    rows = cut(rows.where(lines).join(seeking.select("file_path", "name").distinct(), ["file_path", "name"]).select("id", "name", "file_path", "start_line", "end_line"))
    span = F.col("e") - F.col("s")
    size_class = F.floor(F.log2(F.greatest(span, F.lit(1)).cast("double"))).cast("int")
    spans = (
        rows.groupBy("file_path", "name", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .withColumn("class", size_class)
    )
    # A pair of smallest ids: of two rows over the same lines the second is the last.
    few = spans.where("n <= 2").select("*", F.when(F.col("n") == 2, F.col("last")).alias("second"))
    many = spans.where("n > 2").select("file_path", "name", "s", "e", "first")
    second = (
        rows.join(
            many.select("file_path", "name", F.col("s").alias("start_line"), F.col("e").alias("end_line"), "first"),
            ["file_path", "name", "start_line", "end_line"],
        )
        .where("id > first")
        .groupBy("file_path", "name", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
        .agg(F.min("id").alias("second"))
    )
    more = spans.where("n > 2").join(second, ["file_path", "name", "s", "e"])
    keep = ["file_path", "name", "s", "e", "class", "first", "second"]
    binned = (
        few.select(keep)
        .union(more.select(keep))
        .withColumn("bin", F.explode(F.sequence(line_bin("s"), line_bin("e"))))
    )
    classes = spans.groupBy("file_path", "name").agg(F.collect_set("class").alias("classes"))  # at most CLASSES values
    seekers = (
        seeking.select("id", "file_path", "name", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
        .join(classes, ["file_path", "name"])
        .withColumn("class", F.explode("classes"))
        .withColumn("bin", line_bin("cs"))
    )
    other = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    enclosing = (
        seekers.join(binned, ["file_path", "name", "class", "bin"])
        .where("s <= cs and e >= ce")
        .select("id", span.alias("span"), other.alias("parent"))
        .where("parent is not null")
        .groupBy("id")
        .agg(F.min(F.struct("span", "parent")).parent.alias("enclosing"))
    )
    return direct.join(enclosing, "id", "left").select("id", F.coalesce("direct", "enclosing").alias("parent"))


def hierarchy(links: DataFrame, *, layers: int = 5, paths: bool = True) -> DataFrame:
    """``id, root_id, depth, path, descendants`` of each node of ``id, parent``.

    ``id`` must be unique and every parent an id. A root has depth 0 and itself as root; its path
    holds the ids from the root to the node. A node on or below a loop has depth -1, no path and
    the smallest id on the loop as root. ``descendants`` counts the nodes below; on a loop it is
    null. Without ``paths``, path and descendants are left out and nothing is longer than a row.
    ``layers`` sets how many layers are peeled before doubling takes over the rest; it changes the
    work, not the result.
    """
    with scratch() as keep:
        return _hierarchy(links, layers, paths, keep)


def _hierarchy(links: DataFrame, layers: int, paths: bool, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    links = links if is_cut(links) else cut(links.select("id", "parent"))
    children = links.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("open"))
    one = F.lit(1).cast("bigint")
    # open: how many children haven't been peeled; what has none is the next layer.
    rest = [cut(links.join(children, "id", "left").select("id", "parent", F.coalesce("open", F.lit(0)).alias("open"), one.alias("size")))]
    while len(rest) <= layers and not rest[-1].where("open = 0").isEmpty():  # else nothing or loops only are left
        now = rest[-1]
        sent = now.where("open = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.sum("size").alias("sent"))
        left = now.where("open > 0").join(sent, "id", "left")
        none = F.lit(0)
        rest.append(cut(left.select("id", "parent", (F.col("open") - F.coalesce("n", none)).alias("open"), (F.col("size") + F.coalesce("sent", none)).alias("size"))))
    top = len(rest) - 1
    peeled = reduce(DataFrame.union, [r.where("open = 0").select("id", "parent", "size", F.lit(k).alias("layer")) for k, r in enumerate(rest[:-1])]) if top else None
    finished = keep(cut(_finish(rest[-1].select("id", "parent", "size"), paths)))
    if peeled is None:
        return finished.select(_columns(paths))
    # Each node with the layer of its parent, in a folder for each: a layer reads the children of
    # the one above only, and every node is read and written once.
    peeled = keep(cut(peeled, "layer"))
    layer_of = peeled.select(F.col("id").alias("parent"), F.col("layer").alias("above"))
    below = cut(peeled.where("parent is not null").join(layer_of, "parent", "left").withColumn("above", F.coalesce("above", F.lit(top))), "above")
    path = [F.array("id").alias("path"), "size"] if paths else []
    roots = peeled.where("parent is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), *path, "layer")
    done: list[DataFrame] = []
    for layer in range(top, 0, -1):
        here = roots.where(F.col("layer") == layer).drop("layer") if layer < top else finished
        here = reduce(DataFrame.union, [here, *[d.where(F.col("layer") == layer).drop("layer") for d in done]])
        parents = here.withColumnRenamed("id", "parent")
        if paths:
            parents = parents.drop("size")
        done.append(keep(cut(_below(below.where(F.col("above") == layer), parents, paths), "layer")))
    return reduce(DataFrame.union, [finished, roots.drop("layer"), *[d.drop("layer") for d in done]]).select(_columns(paths))


def _columns(paths: bool) -> list:
    return ["id", "root_id", "depth", *(["path", (F.col("size") - 1).alias("descendants")] if paths else [])]


def _below(children: DataFrame, parents: DataFrame, paths: bool) -> DataFrame:
    """Root, depth and path of nodes from those of their parents."""
    free = F.col("depth") >= 0
    path = [F.when(free, F.concat("path", F.array("id"))).alias("path"), "size"] if paths else []
    return children.join(parents, "parent").select("id", "root_id", F.when(free, F.col("depth") + 1).otherwise(-1).alias("depth"), *path, "layer")


def _finish(rest: DataFrame, paths: bool) -> DataFrame:
    """Root, depth, path and size of the nodes that peeling has left, by pointer doubling.

    First with ids only, which tells loops from trees; paths are then put together in trees only.
    """
    schema = "id bigint, root_id bigint, depth int" + (", path array<bigint>, size bigint" if paths else "")
    if rest.isEmpty():
        return rest.sparkSession.createDataFrame([], schema)
    state = cut(
        rest.select("id", F.coalesce("parent", "id").alias("at"), F.expr("if(parent is null, 0L, 1L)").alias("hops"), F.col("parent").isNull().alias("ended"))
    )
    before, open_ = -1, state.where("not ended").count()
    while open_ and open_ != before:
        # Along a chain each round ends some node; a round that ends none leaves only loops.
        state = cut(_doubled(state))
        before, open_ = open_, state.where("not ended").count()
    loops = [_loop_rows(rest, state.where("not ended"), paths)] if open_ else []
    ended = state.where("ended")
    if not paths:
        trees = ended.select("id", F.col("at").alias("root_id"), F.col("hops").cast("int").alias("depth"))
    else:
        trees = _tree_rows(rest.join(ended.select("id"), "id", "left_semi"))
    return reduce(DataFrame.union, loops, trees)


def _doubled(state: DataFrame) -> DataFrame:
    """Each node that hasn't ended goes on to where the one it has reached has got."""
    hop = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("ended").alias("ends"))
    moved = state.where("not ended").join(hop, "at").select("id", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ends").alias("ended"))
    return state.where("ended").union(moved)


def _tree_rows(rest: DataFrame) -> DataFrame:
    # up: the ids above the node, from the furthest that is known to the parent.
    state = cut(rest.select("id", F.col("parent").alias("to"), F.expr("if(parent is null, array(), array(parent))").alias("up"), F.col("size").alias("own")))
    while not state.where("to is not null").isEmpty():
        hop = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("up").alias("over"))
        moved = state.where("to is not null").join(hop, "to").select("id", F.col("next").alias("to"), F.concat("over", "up").alias("up"), "own")
        state = cut(state.where("to is null").union(moved))
    below = state.select(F.explode("up").alias("id"), "own").groupBy("id").agg(F.sum("own").alias("below"))
    path = F.concat("up", F.array("id"))
    return state.join(below, "id", "left").select(
        "id",
        F.element_at(path, 1).alias("root_id"),
        F.size("up").alias("depth"),
        path.alias("path"),
        (F.col("own") + F.coalesce("below", F.lit(0))).alias("size"),
    )


def _loop_rows(rest: DataFrame, state: DataFrame, paths: bool) -> DataFrame:
    """Nodes of which all lead to a loop, with the smallest id on that loop."""
    # Where all have got to lies on a loop once going on reaches as many nodes.
    state = cut(state.select("id", "at"))
    reached = state.select("at").distinct().count()
    while True:
        hop = state.select(F.col("id").alias("at"), F.col("at").alias("next"))
        state = cut(state.join(hop, "at").select("id", F.col("next").alias("at")))
        before, reached = reached, state.select("at").distinct().count()
        if reached == before:
            break
    on = state.select(F.col("at").alias("id")).distinct()
    label = cut(rest.join(on, "id").select("id", F.col("parent").alias("at"), F.col("id").alias("least")))
    while True:
        hop = label.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        label = cut(label.join(hop, "at").select("id", F.col("next").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("new")))
        if label.where("new").isEmpty():
            break
        label = label.drop("new")
    none = [F.lit(None).cast("array<bigint>").alias("path"), F.lit(None).cast("bigint").alias("size")] if paths else []
    roots = label.select(F.col("id").alias("at"), F.col("least").alias("root_id"))
    return state.join(roots, "at").select("id", "root_id", F.lit(-1).alias("depth"), *none)


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance``: one row per node and node above it.

    Given the rows of :func:`hierarchy`. Rows, not lists, as a root may have any number of
    descendants. Nodes on or below loops have none.
    """
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where("at < depth")
        .select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )
