"""Evaluation passages inside training texts, found by spaced-seed hashing.

A seed is a fixed mask over consecutive words that looks at some positions and ignores the
others, so that a passage with changed words still shares seeds with its source. The hashes of
all seeds of the test items are joined with those of the documents; around the hits, the words
are aligned and the overlap is verified, tolerant of changed, missing and additional words.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import cut, parts_for

#: Positions that count, of at most nine consecutive words.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 8), (0, 3, 4, 6, 7))
SPAN = 1 + max(max(m) for m in MASKS)
LEAST_WORDS = 12
MARGIN = 16  # words kept on each side of what the items of a hit can cover
GRAM = 6  # consecutive words by which a passage is judged as shared by many texts
PIECE = 2048  # words over which the hits of one region are spread at most
SHARE = 0.05  # of the texts; what more of them hold (and more than two) is common
SHIFT = 3  # words that may be missing or additional around a diagonal
PRIMES = np.array([1_000_003, 7_368_787, 39_916_801, 479_001_599, 87_178_291_199], np.int64)

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>\n]{0,200}>")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|[nrtbf\"'\\/])")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[^\w\n]*(?=[^\W\d_])")
_UNSEEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, escapes and comment signs."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "-\r" in text or "- " in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return _WORD.findall(text.lower())


def own_windows(n: int, common: np.ndarray) -> np.ndarray:
    """Where windows of twelve words start that aren't shared by many texts, in a text of ``n`` words.

    ``common`` has the places of its common runs of ``GRAM`` words; most runs of a window must be others.
    """
    own = np.ones(max(0, n - GRAM + 1), int)
    own[common] = 0
    runs = LEAST_WORDS - GRAM + 1
    return np.flatnonzero(np.convolve(own, np.ones(runs, int), "valid") > runs // 2) if len(own) >= runs else np.zeros(0, int)


def seeds(words: np.ndarray, telling: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all seeds of a text given as numbers of words.

    The words that a seed counts are words of items; one at least tells items apart, or all are
    ``plain`` words, of passages that only their order tells apart. Number 0 is a word of no item.
    """
    out_h, out_p = [], []
    for k, mask in enumerate(MASKS):
        n = len(words) - max(mask)
        if n <= 0:
            continue
        picked = np.stack([words[o : o + n] for o in mask])
        good = (picked > 0).all(0) & (telling[picked].any(0) | plain[picked].all(0))
        at = np.flatnonzero(good)
        with np.errstate(over="ignore"):
            h = (picked[:, at].astype(np.int64) * PRIMES[:, None]).sum(0) * np.int64(1_099_511_628_211) + k
        out_h.append(h)
        out_p.append(at)
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_p)


def enough(n, same, same_told, told):
    """Whether so many covered, equal, equal telling and telling words make a leak; numbers or arrays."""
    return (n >= LEAST_WORDS) & (same >= 0.75 * n) & (same_told >= np.maximum(2, 0.6 * told))


def enough_apart(n, same, same_told, told):
    """The same where changed words may be anywhere: a sentence pattern filled with other telling words is none."""
    return enough(n, same, same_told, told) & ((same >= 0.8 * n) | (same_told >= 0.75 * told))


WIDTH = 2 * SHIFT + 1
_PENALTY = 2.0 * np.abs(np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :])
_STAY = _PENALTY - 0.5 * np.eye(WIDTH)  # of equal scores, the one on the same diagonal


class Batch:
    """Alignments of item texts with document texts, side by side: one for each item, text and diagonal."""

    def __init__(self, items: list[np.ndarray], texts: list[np.ndarray], diagonals: np.ndarray, weights: list[np.ndarray], own: list[np.ndarray]) -> None:
        n = max(map(len, items))
        size = len(items)
        self.lengths = np.array([len(x) for x in items])
        item, weight, self.own = np.zeros((size, n), np.int64), np.zeros((size, n)), np.zeros((size, n), bool)
        self.equal = np.zeros((size, WIDTH, n), bool)
        at = np.arange(n)[None, :] + np.arange(-SHIFT, SHIFT + 1)[:, None]
        for k, (x, text, w, o) in enumerate(zip(items, texts, weights, own)):
            item[k, : len(x)], weight[k, : len(x)] = x, w
            self.own[k, o] = True
            place = at[:, : len(x)] + diagonals[k]
            inside = (place >= 0) & (place < len(text))
            self.equal[k, :, : len(x)] = (text[np.where(inside, place, 0)] == x) & inside
        self.weight = weight

    def take(self, keep: np.ndarray) -> Batch:
        out = object.__new__(Batch)
        for name, value in self.__dict__.items():
            setattr(out, name, value[keep])
        return out

    def hopeful(self) -> np.ndarray:
        """Where some twelve words of the item have eight or more that the text has around there; no leak has fewer."""
        run = np.cumsum(np.pad(self.equal.any(1), ((0, 0), (1, 0))), 1)
        n = run.shape[1] - 1
        return (run[:, LEAST_WORDS:] - run[:, : n - LEAST_WORDS + 1] >= 8).any(1) if n >= LEAST_WORDS else np.zeros(len(run), bool)

    def same_window(self) -> np.ndarray:
        """Whether a window on one diagonal that begins and ends with an equal word is a leak, wherever its changed words are, or twelve equal words begin at ``own``.

        Of a longer window with enough equal words, one half has enough, so twice the least length will do.
        """
        equal, n = self.equal, self.equal.shape[2]
        same = np.cumsum(np.pad(equal, ((0, 0), (0, 0), (1, 0))), 2)
        same_told = np.cumsum(np.pad(equal * self.weight[:, None], ((0, 0), (0, 0), (1, 0))), 2)
        told = np.cumsum(np.pad(self.weight, ((0, 0), (1, 0))), 1)[:, None]
        found = np.zeros(len(equal), bool)
        for size in range(LEAST_WORDS, min(n, 2 * LEAST_WORDS) + 1):
            at = slice(None, n - size + 1)
            words = same[..., size:] - same[..., at]
            good = enough_apart(size, words, same_told[..., size:] - same_told[..., at], told[..., size:] - told[..., at])
            found |= (good & equal[..., at] & equal[..., size - 1 :]).any((1, 2))
            if size == LEAST_WORDS:
                found |= ((words == size) & self.own[:, None, at]).any((1, 2))
        return found

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the best aligned stretch of each: score, item words covered, equal ones, the weight of the equal and of all, diagonal and place of its first word; and those of its last.

        A match counts 1, a changed word -2, and so does each move to a neighbouring diagonal.
        """
        size, _, n = self.equal.shape
        rows = np.arange(size)
        state = np.zeros((size, WIDTH, 7))
        best, last = np.zeros((size, 7)), np.zeros((size, 2), np.int64)
        for j in range(n):
            from_ = (state[:, None, :, 0] - _STAY).argmax(2)
            state = np.take_along_axis(state, from_[:, :, None], 1)
            state[:, :, 0] -= _PENALTY[np.arange(WIDTH), from_]
            equal, w = self.equal[:, :, j], self.weight[:, j, None]
            fresh = equal & (state[:, :, 1] == 0)
            kept = equal | (state[:, :, 0] > 2)
            state[:, :, 0] += np.where(equal, 1, -2)
            state[:, :, 1] += 1
            state[:, :, 2] += equal
            state[:, :, 3] += equal * w
            state[:, :, 4] += w
            state[~kept] = 0
            state[fresh, 5] = np.nonzero(fresh)[1]
            state[fresh, 6] = j
            top = np.where(equal, state[:, :, 0], -1).argmax(1)
            better = equal[rows, top] & (state[rows, top, 0] > best[:, 0])
            best[better] = state[rows, top][better]
            last[better, 0], last[better, 1] = top[better], j
        return best, last

    def extended(self, k: int, stretch: np.ndarray, last: np.ndarray) -> bool:
        """Whether an aligned stretch is a leak with equal words before and after it, past the changed words between."""
        equal, weight = self.equal[k, :, : self.lengths[k]], self.weight[k, : self.lengths[k]]
        n, same, same_told, told, d, j = stretch[1:]
        sides = []
        for (row, at), step in (((int(d), int(j)), -1), ((int(last[0]), int(last[1])), 1)):
            e = equal[row, at + step :: step][:LEAST_WORDS] if at + step >= 0 else equal[row, :0]
            w = weight[at + step :: step][:LEAST_WORDS] if at + step >= 0 else weight[:0]
            ends = np.concatenate([[0], np.flatnonzero(e) + 1])
            sides.append([ends, *(np.concatenate([[0], np.cumsum(x)])[ends] for x in (e, e * w, w))])
        (n1, same1, told1, all1), (n2, same2, told2, all2) = ([x[:, None] for x in sides[0]], sides[1])
        return bool(enough_apart(n + n1 + n2, same + same1 + same2, same_told + told1 + told2, told + all1 + all2).any())

    def leaks(self) -> np.ndarray:
        """Whether each is a leak (:func:`are_leaks`)."""
        found = np.zeros(len(self.lengths), bool)
        open_ = np.flatnonzero(self.hopeful())
        if len(open_):
            found[open_] = self.take(open_).same_window()
            open_ = open_[~found[open_]]
        if len(open_):
            rest = self.take(open_)
            best, last = rest.stretches()
            found[open_] = enough(*best[:, 1:5].T)
            for k in np.flatnonzero(~found[open_] & (best[:, 1] > 0)):
                found[open_[k]] = rest.extended(k, best[k], last[k])
        return found


def are_leaks(candidates: list[tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]], size: int = 512) -> np.ndarray:
    """Whether each item (words, text words, diagonals, weights, places of own windows) has a stretch of at least twelve words in the text.

    Most words must be equal, and of the words that tell items apart most as well and two at
    least, so that another instance of a common sentence pattern, or a stock phrase, is none.
    Of the windows that start at the own places, twelve equal words are enough.
    """
    tasks = []
    for k, c in enumerate(candidates):
        done = None
        for d in sorted(int(x) for x in c[2]):
            if done is None or d - done > 1:
                tasks.append((len(c[0]), k, d))
                done = d
    tasks.sort()  # of like length together
    found = np.zeros(len(candidates), bool)
    for a in range(0, len(tasks), size):
        part = [(k, d) for _, k, d in tasks[a : a + size] if not found[k]]
        if part:
            chosen = [candidates[k] for k, _ in part]
            batch = Batch([c[0] for c in chosen], [c[1] for c in chosen], np.array([d for _, d in part]), [c[3] for c in chosen], [c[4] for c in chosen])
            found[[k for (k, _), good in zip(part, batch.leaks()) if good]] = True
    return found


def is_leak(item: np.ndarray, text: np.ndarray, diagonals: list[int], telling: np.ndarray, own: np.ndarray | None = None) -> bool:
    """:func:`are_leaks` for one."""
    return bool(are_leaks([(item, text, diagonals, telling, np.zeros(0, int) if own is None else own)])[0])


def item_fields(items: DataFrame) -> DataFrame:
    """``item_id, field, words`` of the items' prompts and answers that have twelve words or more."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    both = items.select("item_id", F.lit("prompt").alias("field"), F.col("prompt").alias("text")).union(
        items.select("item_id", F.lit("answer"), F.col("answer"))
    )
    return both.where("text is not null").select("item_id", "field", split("text").alias("words")).where(F.size("words") >= LEAST_WORDS)


def commonness(fields: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``word, df``; ``text, common``, by the text's hash the places of runs of ``GRAM`` words that many texts share; how many texts are many.

    Copies of a text under several items or fields count once.
    """
    texts = fields.select("words", F.xxhash64("words").alias("text")).distinct()
    # An item has two texts: the share is of the field with more of them.
    most = fields.groupBy("field").agg(F.countDistinct("words").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    many = max(2.0, SHARE * most)
    held = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - GRAM + 1), lambda i: F.xxhash64(F.slice("words", i, GRAM)))
    shared = texts.select(F.explode(F.array_distinct(runs)).alias("run")).groupBy("run").count().where(F.col("count") > many).select("run")
    places = texts.select("text", F.posexplode(runs).alias("at", "run")).join(shared, "run")
    return cut(held), cut(places.groupBy("text").agg(F.collect_list("at").alias("common"))), many


def leaked(documents: DataFrame, items: DataFrame, *, block_words: int = 500_000) -> DataFrame:
    """``doc_id, item_id`` of documents whose ``text`` repeats passages of the items.

    ``items`` has ``item_id, prompt, answer``. Their words and seed hashes are given to every
    task; of larger sets than ``block_words`` words, block after block, each with a pass over the
    documents. Null and empty texts hold nothing, and copies of a document count each.
    """
    fields = cut(item_fields(items))
    total = fields.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).head()[0]
    n = parts_for(total, block_words)
    held, common, many = commonness(fields)
    fields = fields.withColumn("text", F.xxhash64("words")).join(common, "text", "left").select(*fields.columns, F.coalesce("common", F.array().cast("array<int>")).alias("common"))
    found = None
    for b in range(n):
        block = fields.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else fields
        here = _leaked_block(documents, block, held, many)
        found = here if found is None else found.union(here)
    return found


def _leaked_block(documents: DataFrame, fields: DataFrame, held: DataFrame, many: float) -> DataFrame:
    # Bounded by block_words: the words of the block with the number of texts of all items that hold them.
    rows = held.join(fields.select(F.explode("words").alias("word")).distinct(), "word").orderBy("word").collect()
    number = {r["word"]: k + 1 for k, r in enumerate(rows)}
    telling = np.array([False] + [r["df"] <= many for r in rows])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["words"] = [np.array([number[w] for w in ws], np.int32) for ws in b["words"]]
            b["own"] = [own_windows(len(ws), np.asarray(c, int)) for ws, c in zip(b["words"], b["common"])]
            told = [np.concatenate([[0], np.cumsum(telling[ws])]) for ws in b["words"]]
            bare = [o[t[o + LEAST_WORDS] - t[o] < 2] for o, t in zip(b["own"], told)]
            b["bare"] = bare
            b["plain"] = [np.unique(ws[(o[:, None] + np.arange(LEAST_WORDS)).ravel()]) for ws, o in zip(b["words"], bare)]
            yield b[["item_id", "field", "words", "own", "bare", "plain"]]

    block = cut(fields.mapInPandas(placed, "item_id bigint, field string, words array<int>, own array<int>, bare array<int>, plain array<int>"))
    plain = np.zeros(len(telling), bool)
    plain[[r[0] for r in block.select(F.explode("plain")).distinct().collect()]] = True

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, ps = [], []
            for ws, bare in zip(b["words"], b["bare"]):
                ws = np.asarray(ws)
                (h, p), (more_h, more_p) = seeds(ws, telling, np.zeros_like(plain)), seeds(ws, np.zeros_like(telling), plain)
                first = np.isin(more_p, bare)  # one place is enough for twelve equal words
                hs.append(np.concatenate([h, more_h[first]]))
                ps.append(np.concatenate([p, more_p[first]]))
            b["h"], b["p"] = hs, ps
            yield b.drop(columns=["bare", "plain"])

    block = cut(block.mapInPandas(numbered, "item_id bigint, field string, words array<int>, own array<int>, h array<bigint>, p array<bigint>"))
    longest = block.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).head()[0]
    test_seeds = block.select("item_id", "field", F.explode(F.arrays_zip("h", "p")).alias("s")).select(
        "item_id", "field", F.col("s.h").alias("h"), F.col("s.p").alias("item_at")
    )
    known = np.array([r[0] for r in test_seeds.select("h").distinct().orderBy("h").collect()], np.int64)
    reach = longest + SPAN + MARGIN

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = number.get
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b["doc_id"], b["text"]):
                words = np.array([get(w, 0) for w in words_of(text)], np.int32)
                if not len(known) or len(words) < LEAST_WORDS or np.count_nonzero(words) < 5:
                    continue
                h, p = seeds(words, telling, plain)
                near = known[np.minimum(np.searchsorted(known, h), len(known) - 1)]
                h, p = h[near == h], p[near == h]
                if not len(h):
                    continue
                order = np.argsort(p, kind="stable")
                h, p = h[order], p[order]
                # A region's hits lie within PIECE words, so that a document of repeats doesn't make one huge row.
                gaps = np.flatnonzero((np.diff(p) > 2 * reach) | (np.diff(p // PIECE) > 0)) + 1
                for part in np.split(np.arange(len(p)), gaps):
                    a = max(0, p[part[0]] - reach)
                    out.append((doc, a, words[a : p[part[-1]] + reach], h[part], p[part] - a))
            yield pd.DataFrame(out, columns=["doc_id", "region", "words", "h", "p"])

    near = cut(
        documents.select("doc_id", "text")
        .where("text is not null")
        .mapInPandas(regions, "doc_id bigint, region bigint, words array<int>, h array<bigint>, p array<bigint>")
    )
    hits = cut(
        near.select("doc_id", "region", F.explode(F.arrays_zip("h", "p")).alias("s"))
        .select("doc_id", "region", F.col("s.h").alias("h"), F.col("s.p").alias("at"))
        .join(test_seeds, "h")
        .groupBy("doc_id", "region", "item_id", "field")
        .agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))  # within PIECE and the longest item
    )
    # Bounded by block_words, as the vocabulary is.
    texts = {(r["item_id"], r["field"]): (np.array(r["words"], np.int64), np.array(r["own"], int)) for r in block.select("item_id", "field", "words", "own").collect()}
    held = documents.sparkSession.sparkContext.broadcast(texts)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(np.asarray(t, np.int64), *held.value[i, f], d) for i, f, t, d in zip(b["item_id"], b["field"], b["text_words"], b["diagonals"])]
            yield b.loc[are_leaks([(w, t, d, telling[w], o) for t, w, o, d in found]), ["doc_id", "item_id"]]

    # Shuffled to a number of tasks that follows the hits: the alignment is the work, not the bytes.
    pairs = hits.join(near.select("doc_id", "region", F.col("words").alias("text_words")), ["doc_id", "region"]).repartition(parts_for(hits.count(), 1000, least=8))
    return pairs.mapInPandas(verify, "doc_id bigint, item_id bigint").distinct()
