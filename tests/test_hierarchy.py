import random
from datetime import datetime

import pytest

from symweave.operators.hierarchy import current_rows, descendants, hierarchy, parent_links

ROW = "id bigint, name string, file_path string, start_line int, end_line int, parent_id bigint, parent_name string, indexed_at timestamp_ntz, parent string"
NOW = datetime(2024, 1, 1)


def brute(parent):
    out = {}
    for node in parent:
        path = [node]
        while parent[path[-1]] is not None and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if parent[path[-1]] is None:
            out[node] = (path[-1], len(path) - 1)
        else:
            out[node] = (min(path[path.index(parent[path[-1]]) :]), -1)
    return out


def tree(spark, parent, **options):
    links = spark.createDataFrame(list(parent.items()), "id bigint, parent bigint")
    return hierarchy(links, **options)


@pytest.mark.parametrize(("seed", "layers"), [(1, 12), (2, 1)])
def test_like_brute_force(spark, seed, layers):
    r = random.Random(seed)
    parent = {i: r.choice([None, *range(max(0, i - 4), i)]) for i in range(80)}
    for i in range(100, 120):
        parent[i] = r.randint(100, 119)
    parent[200] = 200
    rows = tree(spark, parent, layers=layers).cache()
    assert {x.id: (x.root_id, x.depth) for x in tree(spark, parent, layers=layers, paths=False).collect()} == brute(parent)
    assert {x.id: (x.root_id, x.depth) for x in rows.collect()} == brute(parent)
    below = {}
    for node, (_, depth) in brute(parent).items():
        above = parent[node]
        while depth >= 0 and above is not None:
            below[above] = below.get(above, 0) + 1
            above = parent[above]
    assert {x.id: x.descendants for x in rows.where("depth >= 0 and descendants > 0").collect()} == below
    assert descendants(rows).count() == sum(below.values())


def test_long_chain_and_hub(spark):
    parent = {0: None} | {i: i - 1 for i in range(1, 300)} | {i: 0 for i in range(1000, 3000)}
    rows = {x.id: x for x in tree(spark, parent, layers=3).collect()}
    assert rows[299].depth == 299 and rows[299].path == list(range(300))
    assert rows[0].descendants == 299 + 2000


@pytest.mark.parametrize("paths", [True, False])
def test_loop_beside_a_tall_chain(spark, paths):
    """The arrays of the chain don't make those of the loop, or of what hangs on it, grow."""
    parent = {0: None} | {i: i - 1 for i in range(1, 600)} | {1000 + i: 1000 + (i + 1) % 20 for i in range(20)} | {2000: 1003} | {i: i - 1 for i in range(2001, 2010)}
    rows = tree(spark, parent, layers=1, paths=paths).collect()
    assert {x.id: (x.root_id, x.depth) for x in rows} == brute(parent)
    if paths:
        assert all(x.path is None for x in rows if x.id >= 1000) and max(len(x.path) for x in rows if x.id < 1000) == 600


def test_links(spark):
    data = [
        (1, "A", "f", 1, 50, None, None, NOW, ""),
        (2, "A", "f", 5, 20, None, None, NOW, ""),
        (3, "m", "f", 6, 7, 99, "A", NOW, ""),  # stale id, the innermost A
        (4, "m", "f", 30, 31, None, "A", NOW, ""),
        (5, "m", "g", 6, 7, None, "A", NOW, ""),  # other file
        (6, "m", "f", 6, 7, 1, "nothing", NOW, ""),
        (7, "A", "f", 5, 20, None, "A", NOW, ""),  # over the same lines as 2: not its own parent
        (8, "z", None, None, None, None, "A", NOW, ""),
        (9, None, "f", 1, 2, None, "m", NOW, ""),
        (10, "A", "f", 5, 20, None, None, NOW, ""),
    ]
    got = {x.id: x.parent for x in parent_links(spark.createDataFrame(data, ROW)).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: 1, 5: None, 6: 1, 7: 2, 8: None, 9: None, 10: None}


def test_current_rows_and_empty(spark):
    data = [(1, "old", "f", 1, 2, None, None, NOW, ""), (1, "new", "f", 1, 2, None, None, NOW.replace(year=2025), ""), (1, "none", "f", 1, 2, None, None, None, "")]
    assert [x.name for x in current_rows(spark.createDataFrame(data * 2, ROW)).collect()] == ["new"]
    empty = spark.createDataFrame([], ROW)
    assert hierarchy(parent_links(current_rows(empty))).count() == 0
