import numpy as np
import pytest

from symweave.llm import packing

DOCS = "doc_id bigint, text string, capacity string"
BUDGETS = "budget_id int, capacity int, doc_id string"
pytestmark = pytest.mark.skipif(packing.BYTE_BPE is None, reason="no tokenizer files")


def slow(sizes, capacity):
    """The rule as it is stated: every choice is tried and all squares are summed."""
    fills, placed = [], []
    squares = lambda f: sum(f.count(h) ** 2 for h in set(f) if h < capacity)
    for s in sizes:
        best = min(squares(fills[:c] + [f + s] + fills[c + 1 :]) if c < len(fills) else squares([*fills, s]) for c, f in enumerate([*fills, 0]) if f + s <= capacity)
        choices = [c for c, f in enumerate([*fills, 0]) if f + s <= capacity and (squares(fills[:c] + [f + s] + fills[c + 1 :]) if c < len(fills) else squares([*fills, s])) == best]
        level = max(fills[c] if c < len(fills) else 0 for c in choices)
        c = [c for c in choices if (fills[c] if c < len(fills) else 0) == level][-1]
        if c == len(fills):
            fills.append(0)
        fills[c] += s
        placed.append(fills[c])
    return sorted(fills)


@pytest.mark.parametrize("seed", range(6))
def test_rule(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 30))
    sizes = r.integers(1, capacity + 1, 60)
    _, fill = packing.sum_of_squares(sizes, capacity)
    assert sorted(fill.tolist()) == slow(sizes.tolist(), capacity)


@pytest.mark.parametrize("seed", range(4))
def test_joined(seed):
    r = np.random.default_rng(seed)
    fill = r.integers(1, 21, 200)
    to, out = packing.joined(fill, 20)
    assert (np.bincount(to, weights=fill) == out).all() and out.max() <= 20 and len(out) <= len(fill)
    assert len(out) <= 1.25 * -(-fill.sum() // 20) and sorted(out)[0] + sorted(out)[1] > 20  # no two could still be joined


@pytest.mark.parametrize("shard_items", [50_000, 7])
def test_placements(spark, shard_items):
    texts = ["word " * n for n in (1, 3, 5, 40, 64, 65, 130, 9, 9, 9, 2000)] + [None, "", "\n", "naïve ❤ text <|endoftext|>"]
    docs = [(i, t, "clash") for i, t in enumerate(texts)]
    budgets = [(1, 64, None), (2, 16, None), (1, 64, None), (3, None, None), (4, 0, None), (None, 8, None)]
    df = packing.pack_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(budgets, BUDGETS), packing.BYTE_BPE, shard_items=shard_items)
    rows = df.collect()
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(spark.createDataFrame(docs, DOCS), packing.BYTE_BPE).collect()}
    for budget, capacity in ((1, 64), (2, 16)):
        mine = [r for r in rows if r.budget_id == budget]
        fill, held = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            held.setdefault(r.doc_id, []).append(r)
        assert max(fill.values()) <= capacity
        assert {d: sum(r.n_tokens for r in rs) for d, rs in held.items()} == counts
        for d, rs in held.items():
            assert len(rs) == -(-counts[d] // capacity)
            assert sorted(r.part for r in rs) == list(range(len(rs)))
    assert {r.budget_id for r in rows} == {1, 2}
    summary = {r.budget_id: r for r in packing.containers(df, spark.createDataFrame(budgets, BUDGETS)).collect()}
    assert summary[1].containers >= summary[1].least


def test_empty(spark):
    docs, budgets = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 8, "")], BUDGETS)
    assert packing.pack_documents(docs, budgets, packing.BYTE_BPE).count() == 0
    some = spark.createDataFrame([(1, "text", "")], DOCS)
    assert packing.pack_documents(some, budgets.limit(0), packing.BYTE_BPE).count() == 0


def test_containers_that_cannot_be_joined(spark):
    """No task gets them all, though each is far from full."""
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('word ', 40) as text", "'' as capacity")
    budgets = spark.createDataFrame([(1, 64, None), (2, 90, None)], BUDGETS)
    rows = packing.pack_documents(docs, budgets, packing.BYTE_BPE, shard_items=60).collect()
    for budget, most, least in ((1, 1, 1000), (2, 2, 500)):
        fills, shards = {}, {}
        for r in rows:
            if r.budget_id == budget:
                fills[r.container_id] = fills.get(r.container_id, 0) + 1
                shard = int(r.container_id[2:]) >> 31
                shards[shard] = shards.get(shard, 0) + 1
        assert sum(fills.values()) == 1000 and max(fills.values()) == most and least <= len(fills) <= 1.03 * least
        assert len(shards) >= 8 and max(shards.values()) <= 150
