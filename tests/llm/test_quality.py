import numpy as np
import pytest

from symweave.llm.quality import FUNCTIONS, learn, qualities, segments, votes

DOCS = "doc_id bigint, text string, words string"
COMMON = "the of and to in is that it was for on are as with be by this at from or an a have not but which if there you we can each when its has so".split()
PROSE = [
    "When the reader is closed, the lock that it held has to be given back, and the next reader in the line can have it.",
    "If there is no room for the new table, we move the old one to the disk before it is read again, which takes a while.",
    "Each of the workers has a list of the files that it was given, and it is not allowed to open any of the others.",
    "You can stop the watch at any time, but the events that came in before are still written to the log by the server.",
]
LISTS = ["\n".join(f"{i}. {w} table {i}.4" for i, w in enumerate("open closed old new small large red".split(), 1)), "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |"]
CODE = ["def f(x):\n    y[x] += 4\n    return g(y, 33)\n" * 3, '{"a": "b c", "d": "e"}\n{"a": "f", "d": "g h"}\n{"a": "i", "d": "j"}', "for (;a < b; a++) { c(a); };\n  d = e(f, 7);\n"]


def corpus():
    docs = []
    for k in range(30):
        docs += [(" ".join(PROSE[(k + i) % 4] for i in range(3))), LISTS[k % 2], CODE[k % 3]]
    return docs


def test_kinds(spark):
    docs = corpus()
    n = len(docs)
    wrapped = "> " + PROSE[0][:58].rsplit(" ", 1)[0] + "\n> " + PROSE[0][len(PROSE[0][:58].rsplit(" ", 1)[0]) + 1 :]
    extra = [None, "", " \n\t\r\n", PROSE[1].upper(), wrapped, PROSE[2].lower().replace(",", "").replace(".", ""), PROSE[0] + "\n\n" + CODE[0] * 4, "x" * 200_000, "a " * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(docs + extra)]
    words = spark.createDataFrame([("en", w) for w in [*COMMON, None]], "lang string, word string")
    got = {r.doc_id: r for r in qualities(spark.createDataFrame(rows, DOCS), words).collect()}
    assert len(got) == len(rows)
    assert [got[i].kind for i in range(n)] == ["prose", "other", "other"] * 30
    assert [got[n + i].kind for i in range(9)] == ["other", "other", "other", "prose", "prose", "prose", "other", "other", "other"]
    assert got[n].words == 0 and got[n].mean_word_length is None and got[n].prose == 0
    assert abs(got[0].mean_word_length - np.mean([len(w.strip(".,")) for w in docs[0].split()])) < 0.01


def test_empty(spark):
    words = spark.createDataFrame([], "lang string, word string")
    assert qualities(spark.createDataFrame([], DOCS), words).count() == 0
    assert qualities(spark.createDataFrame([(1, None, "")], DOCS), words).head().kind == "other"


def test_accuracies_are_learnt():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.6
    right = [0.95, 0.9, 0.85, 0.8, 0.55]
    said = np.stack([np.where(r.random(4000) < p, truth, ~truth) for p in right], 1)
    patterns = ["".join("+" if x else "-" for x in row) for row in said]
    held = sorted(set(patterns))
    post, accuracy = learn(held, np.array([patterns.count(p) for p in held], float))
    assert np.abs(accuracy - right).max() < 0.06
    which = dict(zip(held, post >= 0.5))
    assert np.mean([which[p] == t for p, t in zip(patterns, truth)]) > 0.95


def test_a_wrong_start_is_corrected():
    """Where the majority is wrong, as most functions are weak and three are strong, the agreements still tell."""
    r = np.random.default_rng(1)
    truth = r.random(6000) < 0.5
    right = [0.97, 0.97, 0.97] + [0.55] * 6
    said = np.stack([np.where(r.random(6000) < p, truth, ~truth) for p in right], 1)
    patterns = ["".join("+" if x else "-" for x in row) for row in said]
    held = sorted(set(patterns))
    weights = np.array([patterns.count(p) for p in held], float)
    score = lambda post: np.mean([dict(zip(held, post >= 0.5))[p] == t for p, t in zip(patterns, truth)])
    majority = np.array([p.count("+") > p.count("-") for p in held], float)
    post, _ = learn(held, weights)
    assert score(post) > 0.98 > 0.93 > score(majority)
    # A start that takes a third of all patterns for the other type ends in the same place.
    start = np.clip(np.where(r.random(len(held)) < 0.33, 1 - majority, majority), 0.2, 0.8)
    other, _ = learn(held, weights, start=start)
    assert ((post >= 0.5) == (other >= 0.5))[weights > 2].all()


def test_long_lists_of_words_are_refused(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    with pytest.raises(ValueError, match="common words"):
        qualities(spark.createDataFrame([(1, "a", "")], DOCS), words, most_words=3)


def test_segments_and_votes():
    assert [len(s) for s in segments("a line of text\r\nanother one here\r\n\r\n- item\n- item\n{x}={y};[z]")] == [2, 2, 1]
    said, stats = votes(["The lock of the reader is closed."], frozenset(COMMON))
    assert len(said) == len(FUNCTIONS) and stats["words"] == 7
