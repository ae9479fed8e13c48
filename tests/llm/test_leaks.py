from itertools import combinations

import numpy as np
import pytest

from symweave.llm.leaks import SHIFT, WIDTH, Batch, is_leak, leaked, words_of

ITEM = "Count how often the jozijal commit visits a gobibet before the vajajex becomes silent. Keep a fatakax stack and push the bopofox once for each serigeb."
STOCK = "Answer with one function and no explanation, and mind the edge cases before you start, please."
ITEMS = "item_id bigint, prompt string, answer string, text string"
DOCS = "doc_id bigint, text string, item_id string"


@pytest.fixture(scope="module")
def items(spark):
    other = "Return the smallest {0} whose {1} contains a shared {2}, or the {3} itself, and count how often it was {4} by the first reader. "
    nouns = [f"no{c}un{i}" for i in range(30) for c in "abcde"]
    rows = [(1, ITEM + " " + STOCK, None, "clash"), (2, None, "too short to count", None), (3, None, None, None), (4, "", "", "")]
    rows += [(10 + i, other.format(*nouns[5 * i : 5 * i + 5]) + STOCK, None, None) for i in range(30)]
    return spark.createDataFrame(rows, ITEMS)


def test_cases(spark, items):
    w = ITEM.split()
    changed = list(w)
    changed[4], changed[15] = "ranefab", "open"
    missing = w[:8] + w[9:]
    docs = [
        (1, "Before. " + ITEM + " After.", "clash"),
        (2, "x " + ITEM.upper().replace(" ", "\n// ") + " y", None),
        (3, " ".join(w[2:15]), None),  # thirteen words
        (4, " ".join(w[2:11]), None),  # nine
        (5, " ".join(changed), None),
        (6, " ".join(missing), None),
        (7, " ".join(sorted(w)), None),  # other order
        (8, STOCK, None),  # stock phrase of all items
        (9, None, None),
        (10, "", None),
        (11, ITEM.replace(" ", "\\n"), None),
        (12, "<b>" + ITEM.replace("jozijal", "<i>jozijal</i>").replace(" a ", " &nbsp;a ") + "</b>", None),
        (13, "Count how often the foo bar visits a baz before the qux becomes idle. Keep a pop stack and push the tip once for each top.", None),
        (14, "word " * 50_000 + ITEM + " word" * 1000, None),
        (15, ITEM, None),
        (15, ITEM, None),
    ]
    got = sorted(tuple(r) for r in leaked(spark.createDataFrame(docs, DOCS), items).collect())
    assert got == [(d, 1) for d in (1, 2, 3, 5, 6, 11, 12, 14, 15)]


def cut_out(n, changed=(), without=()):
    """Whether the item's words from 40 on, ``n`` of them, are a leak with some changed and some left out."""
    item = np.arange(1, 101)
    words = np.array([0 if i in changed else item[40 + i] for i in range(n) if i not in without])
    return is_leak(item, np.concatenate([np.zeros(20, int), words, np.zeros(20, int)]), [-20], np.ones(100))


@pytest.mark.parametrize("n", range(12, 17))
def test_changed_words_anywhere(n):
    for places in [*combinations(range(1, n - 1), 1), *combinations(range(1, n - 1), 2)]:
        assert cut_out(n, places), places


def test_changed_and_missing_words():
    assert cut_out(14, (1,), (7,)) and cut_out(12, (1, 4, 10))
    assert not cut_out(9) and not cut_out(11) and not cut_out(12, (1, 3, 5, 7)) and not cut_out(12, (0, 11))


def test_early_change(spark, items):
    w = ITEM.split()[:12]
    docs = [(i, "Before. " + " ".join("ranefab" if j == i else x for j, x in enumerate(w)) + " After.", None) for i in (1, 2, 9, 10)]
    assert sorted(leaked(spark.createDataFrame(docs, DOCS), items).collect()) == [(i, 1) for i in (1, 2, 9, 10)]


def test_copies_of_an_item_count_once(spark, items):
    copies = spark.createDataFrame([(100 + i, ITEM, None, None) for i in range(15)], ITEMS)
    docs = spark.createDataFrame([(1, ITEM, None), (2, STOCK, None)], DOCS)
    for block_words in (500_000, 300):
        got = leaked(docs, items.where("item_id <> 1").union(copies), block_words=block_words)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 100 + i) for i in range(15)]


def test_common_words_in_an_order_of_their_own(spark):
    common = "the of and to in is that for it as was with be by on not he his but at are this have from or".split()
    rows = [(i, " ".join(np.random.default_rng(i).permutation(common)), None, None) for i in range(60)]
    docs = spark.createDataFrame([(7, "Before. " + " ".join(rows[3][1].split()[5:18]) + " after", None), (8, " ".join(common), None)], DOCS)
    assert [tuple(r) for r in leaked(docs, spark.createDataFrame(rows, ITEMS)).collect()] == [(7, 3)]


def test_blocks_give_the_same(spark, items):
    docs = spark.createDataFrame([(1, ITEM, None)], DOCS)
    assert [tuple(r) for r in leaked(docs, items, block_words=200).collect()] == [(1, 1)]


def test_empty(spark, items):
    none = spark.createDataFrame([], DOCS)
    assert leaked(none, items).count() == 0
    assert leaked(spark.createDataFrame([(1, ITEM, None)], DOCS), items.limit(0)).count() == 0


def test_words():
    assert words_of("Don't <b>split</b> snake_case;\u00ad It’s com-\n// pound &amp; caf\u00e9") == ["don", "t", "split", "snake", "case", "it", "s", "compound", "café"]
    assert words_of(None) == words_of("") == []


def plain_stretch(equal, weight):
    """The best aligned stretch, cell by cell."""
    zero = (0.0, 0, 0, 0.0, 0.0, (0, 0))
    state, best, last = [zero] * WIDTH, zero, (0, 0)
    for j in range(equal.shape[1]):
        old, state = state, []
        for k in range(WIDTH):
            s = old[k]
            for m in range(WIDTH):
                if old[m][0] - 2 * abs(m - k) > s[0]:
                    s = (old[m][0] - 2 * abs(m - k), *old[m][1:])
            if equal[k, j]:
                s = (s[0] + 1, s[1] + 1, s[2] + 1, s[3] + weight[j], s[4] + weight[j], s[5] if s[1] else (k, j))
                if s[0] > best[0]:
                    best, last = s, (k, j)
            else:
                s = (s[0] - 2, s[1] + 1, s[2], s[3], s[4] + weight[j], s[5]) if s[0] > 2 else zero
            state.append(s)
    return (*best[:5], *best[5]), last


def test_alignment_like_cell_by_cell():
    random = np.random.default_rng(0)
    items = [random.integers(1, 30, n) for n in random.integers(12, 60, 40)]
    texts = []
    for item in items:
        kept = item[random.random(len(item)) > 0.1]
        kept = np.where(random.random(len(kept)) < 0.15, 99, kept)
        texts.append(np.concatenate([random.integers(1, 30, 20), kept, random.integers(1, 30, 20)]))
    weights = [(random.random(len(x)) < 0.5).astype(float) for x in items]
    batch = Batch(items, texts, np.full(40, 20), weights, [np.zeros(0, int)] * 40)
    best, last = batch.stretches()
    for k, (item, text) in enumerate(zip(items, texts)):
        at = np.arange(len(item)) + 20 + np.arange(-SHIFT, SHIFT + 1)[:, None]
        inside = (at >= 0) & (at < len(text))
        equal = (text[np.where(inside, at, 0)] == item) & inside
        assert (batch.equal[k, :, : len(item)] == equal).all() and not batch.equal[k, :, len(item) :].any()
        want, end = plain_stretch(equal, weights[k])
        assert tuple(best[k]) == pytest.approx(want) and tuple(last[k]) == end


def test_repetitive_document(spark):
    """A long document that repeats an item, or one of its words, over and over stays in bounded pieces."""
    looped = "tick tock tick tock tick tock tick tock tick tock tick tock tick tock bell bopofox " * 2
    rows = [(1, ITEM, None, None), (2, looped, None, None)]
    docs = [(1, (ITEM + " ") * 2000, None), (2, "tick tock " * 30_000, None), (3, looped, None)]
    got = sorted(tuple(r) for r in leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, ITEMS)).collect())
    assert got == [(1, 1), (2, 2), (3, 2)]
