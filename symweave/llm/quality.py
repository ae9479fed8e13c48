"""Statistics of each document's text, and which documents are running prose.

A text is cut into segments, runs of lines of one shape. Thresholds on the segments' statistics
are noisy labelling functions: each says prose, not prose, or nothing. How often each is right is
learnt by expectation-maximisation from their agreements over all segments; the posterior of
each segment then tells its type. Each function votes by a statistic of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.session import cut

# Articles, and connecting words of terse notes, of the three languages.
ARTICLES = frozenset("a an the der die das dem den des ein eine einen el la los las un una".split())
CONNECTING = frozenset(
    """then now no longer thanks needs after before twice alone left its to in than until while once per
    dann jetzt nicht mehr danach vorher zweimal dank wegen
    entonces ahora ya después antes dos veces gracias""".split()
)

_BREAK = re.compile(r"\r\n|\r|\x0b|\x0c|\x85| | ")
_SPACE = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000]")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[a-z]+")  # the same in a text of ASCII, and quicker
_BULLET = re.compile(r"\s*(?:[-+*•·‣–]\s+|\[[ xX]?\]\s*|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+)")
_LEAD = re.compile(r"^\s*(?:>+|//+!?|/\*+|\*+/?|#+|--|<!--|;+|%+|\"{3}|'{3})?\s*")
_MARKS = re.compile(r"[0-9{}\[\]()<>=|;:\\/+*#@$%^&~_\t\"]")
_ENDING = re.compile(r"[.!?…][)\]\"'”’»*_`>/-]*\s*$")
_STOPS = re.compile(r"[.!?…]+(?=[\s\"')\]”’»]|$)")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*>|[*_`]+(?=\w)|(?<=\w)[*_`]+|&[a-z]+;|\\[nrt\"']")
_LIGHT = " .,;:'!?()-"
_LIGHT_WIDE = "’“”„»«¿¡…"
_INFLECTED = ("ed", "ing")
_VOWELS = frozenset("aeiouyäöüáéíóúàèâêîôû")
_LONE = frozenset("bcdfghjklmnpqrstvwxz")

FUNCTIONS = (
    "bulleted", "order", "symbols", "digits", "common", "repeated", "salad", "items", "sentences",
    "wrapped", "odd_words", "parallel", "delimited", "connected",
)


def _shape(line: str) -> str:
    """A letter for the shape of a line: bullet, list, marks or text."""
    if _BULLET.match(line):
        return "b"
    body = _LEAD.sub("", line, count=1)
    commas = body.count(",")
    if commas >= 4 and 2 * commas >= body.count(" ") or commas >= 3 and commas - body.count(", ") >= 3:
        return "l"
    marks = len(_MARKS.findall(body))
    return "m" if marks > 3 and marks > 0.2 * len(body) else "t"


def segments(text: str) -> Iterator[list[str]]:
    """Runs of lines of one shape. Blank lines end a run."""
    run: list[str] = []
    last = ""
    if not text.isascii():
        text = _UNSEEN.sub("", _SPACE.sub(" ", text))
    for line in _BREAK.sub("\n", text).split("\n"):
        if not line.strip():
            if run:
                yield run
            run, last = [], ""
            continue
        shape = _shape(line)
        if run and shape != last:
            yield run
            run = []
        run.append(line)
        last = shape
    if run:
        yield run


def votes(lines: list[str], common: frozenset[str]) -> tuple[list[int], dict[str, float]]:
    """What each labelling function says of a segment (1 prose, -1 not, 0 nothing), and its statistics."""
    n_lines = len(lines)
    bulleted = sum(1 for x in lines if _BULLET.match(x)) / n_lines
    lines = [_LEAD.sub("", x, count=1).rstrip() for x in lines]
    text = "\n".join(lines)
    if "<" in text or "*" in text or "`" in text or "_" in text or "&" in text or "\\" in text:
        text = _MARKUP.sub(" ", text)
    low = text.lower()
    words = (_LATIN if low.isascii() else _WORD).findall(low)
    n = len(words)
    size = max(1, len(text) - text.count("\n"))
    lengths = list(map(len, words))
    letters = sum(lengths)
    digits = sum(map(text.count, "0123456789"))
    light = sum(map(text.count, _LIGHT if text.isascii() else _LIGHT + _LIGHT_WIDE))
    marks = max(0, size - letters - digits - light) / size
    known = list(map(common.__contains__, words))
    share = sum(known) / n if n else 0.0
    starts = range(0, max(1, n - 20), 40) if n >= 12 else ()
    variety = sum(len(set(words[a : a + 40])) / min(40, n - a) for a in starts) / len(starts) if starts else 1.0
    follows = known[1:] + [True]
    articles = [x for x, w in zip(follows, words) if w in ARTICLES]
    misplaced = sum(articles) / len(articles) if articles else 0.0
    per_line = n / n_lines
    ended = sum(1 for x in lines if _ENDING.search(x)) / n_lines
    parts = [x.count(" ") + x.count("\n") for x in _STOPS.split(text)]
    sentences = sum(x for x in parts[:-1] if x >= 3) / max(1, sum(parts))
    sizes = sorted(map(len, lines))
    width = max(x for x in sizes if x <= 1.6 * sizes[n_lines // 2])  # without the lines that are far longer than most
    if n_lines >= 2 and width >= 36:  # a narrower column isn't wrapped text
        heads = [x.split(None, 1)[0] if x.split() else "" for x in lines[1:]]
        forced = sum(1 for x, h in zip(lines, heads) if len(x) + 1 + len(h) > width) / (n_lines - 1)
    else:
        forced = 0.0
    vowels = sum(map(_VOWELS.isdisjoint, words)) / n if n else 1.0
    odd = sum(map(_LONE.__contains__, words)) / n if n else 1.0
    if n and max(lengths) > 20:
        odd += sum(x > 20 for x in lengths) / n
    firsts: dict[str, int] = {}
    if n_lines >= 4:
        for x in lines:
            for w in _WORD.findall(x.lower()):
                if w in common and w not in ARTICLES:
                    firsts[w] = firsts.get(w, 0) + 1
                    break
    parallel = max(firsts.values()) / n_lines if firsts and forced < 0.5 and (ended < 0.6 or n_lines >= 6) else 0.0
    # Known words in a row: few where words stand in an order, as many as there are where they don't.
    runs = sum(a and b for a, b in zip(known, known[1:])) / max(1, sum(known[:-1]))
    pipes = sum(x.count("|") + x.count("\t") for x in lines) / n_lines
    commas = text.count(",") / max(1, n)
    columns = sum(1 for x in lines if "   " in x.strip()) / n_lines
    connected = (sum(map(CONNECTING.__contains__, words)) + sum(map(str.endswith, words, repeat(_INFLECTED)))) / n if n else 0.0

    # One item to a line: a line could have taken words of the next, and doesn't end a sentence.
    listed = bulleted >= 0.6 or n_lines >= 3 and per_line <= 14 and (forced < 0.5 and (ended < 0.5 or per_line <= 4) or parallel >= 0.65)
    # Words out of order: hardly any articles among many common words, or articles before such words.
    salad = n >= 15 and share >= 0.28 and (len(articles) < 0.035 * n or misplaced >= 0.3)

    say = lambda yes, no: 1 if yes else (-1 if no else 0)
    out = [
        say(False, bulleted >= 0.6),
        say(n >= 15 and share >= 0.2 and runs <= 0.36, n >= 15 and share >= 0.28 and runs >= 0.42),
        say(False, marks >= 0.05),
        say(False, digits / size >= 0.12),
        say(False, share < 0.03 and connected < 0.12),
        say(False, n >= 12 and variety < 0.4),
        say(len(articles) >= 2 and misplaced <= 0.1, salad),
        say(False, n_lines >= 2 and forced < 0.5 and (per_line <= 6 and ended < 0.5 or per_line <= 3.2)),
        say(sentences >= 0.6, sentences < 0.1 and connected < 0.12),
        say(n_lines >= 3 and forced >= 0.8 and per_line >= 5, listed),
        say(False, vowels + odd >= 0.25),
        say(False, n_lines >= 4 and parallel >= 0.65),
        say(False, pipes >= 1.5 or columns >= 0.5 or (commas >= 0.4 and n >= 6)),
        say(connected >= 0.15, n >= 12 and connected < 0.02),
    ]
    stats = {
        "words": n, "letters": letters, "marks": marks * size, "size": size, "lines": n_lines,
        "ended": ended * n_lines, "common": share * n,
    }
    return out, stats


_STATS = ["words", "letters", "marks", "size", "lines", "ended", "common"]
SEGMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("votes", T.StringType()), T.StructField("chars", T.LongType())]
    + [T.StructField("weight", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in _STATS]
)


def segment_votes(documents: DataFrame, common_words: list[str]) -> DataFrame:
    """The votes, visible characters and statistics of every segment of every document.

    A null or blank text has no segments. Segments of a document with the same votes are added up.
    """
    common = frozenset(w.lower() for w in common_words if w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                held: dict[str, list[float]] = {}
                for lines in segments(text):
                    said, stats = votes(lines, common)
                    key = "".join("-0+"[v + 1] for v in said)
                    row = held.setdefault(key, [0.0] * (2 + len(_STATS)))
                    chars = sum(len(x) - x.count(" ") for x in lines)
                    row[0] += chars
                    row[1] += chars**0.5
                    for k, c in enumerate(_STATS):
                        row[k + 2] += stats[c]
                rows += [(doc, key, int(row[0]), *row[1:]) for key, row in held.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "votes", "chars", "weight", *_STATS])

    return documents.select("doc_id", "text").where(F.col("text").rlike(r"\S")).mapInPandas(run, SEGMENTS)


ANCHOR = 0.05
MEANT = np.array([0.02, 0.6, 0.38])  # not prose, nothing, prose: what a function says of prose


def learn(patterns: list[str], weights: np.ndarray, *, rounds: int = 60, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of prose of each pattern of votes, and each function's learnt accuracy.

    The functions are taken as independent given the type. A function that may say either, or
    nothing, has a probability of each in prose and elsewhere. Begins with the majority's verdict, or the given one;
    a small share ``ANCHOR`` of the evidence is what the functions are meant to say, so that the
    two types keep their meaning where one of them is rare.
    """
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns]).reshape(len(patterns), -1)
    total = weights.sum()
    post = np.clip(0.5 + 0.3 * np.sign(np.where(v > 0, 1.0, np.where(v < 0, -1.5, 0)).sum(1)), 0.05, 0.95)
    post = post if start is None else np.asarray(start, float)
    said = np.stack([v == -1, v == 0, v == 1], axis=2).astype(float)
    for _ in range(rounds):
        prior = np.clip((post * weights).sum() / total, 0.02, 0.98)
        loglik = []
        for p in (post, 1 - post):  # prose, then the rest
            meant = ANCHOR * total * (MEANT if p is post else MEANT[::-1])
            mass = (said * (p * weights)[:, None, None]).sum(0) + meant
            loglik.append((said * np.log(mass / mass.sum(1, keepdims=True))).sum((1, 2)))
        gap = np.clip(loglik[1] - loglik[0] + np.log((1 - prior) / prior), -60, 60)
        post = 1 / (1 + np.exp(gap))
    right = ((v > 0) * post[:, None] + (v < 0) * (1 - post)[:, None]) * weights[:, None]
    accuracy = right.sum(0) / np.maximum(1e-9, ((v != 0) * weights[:, None]).sum(0))
    return post, accuracy


def qualities(documents: DataFrame, common_words: DataFrame, *, most_words: int = 1_000_000) -> DataFrame:
    """One row for each document: its statistics, the share of its characters in prose and its type.

    ``words, mean_word_length, symbol_ratio, ended_lines, common_share`` are null for texts without
    words or characters; ``prose`` is the share of visible characters that lie in prose, 0 for null
    and blank texts, and ``kind`` prose or other. Copies count each. ``common_words`` (``word``) is
    a short list and is given to every task; a list of more than ``most_words`` isn't taken.
    """
    known = common_words.where("word is not null").select("word").distinct()
    if (n := known.count()) > most_words:
        raise ValueError(f"{n} common words are more than {most_words}")
    words = [r["word"] for r in known.collect()]
    found = cut(segment_votes(documents, words))
    # Bounded: at most three to the power of the number of functions, whatever the data.
    # A segment weighs the root of its length, so that a few long ones don't outweigh the rest.
    counted = found.groupBy("votes").agg(F.sum("weight").alias("weight")).orderBy("votes").collect()
    patterns = [r["votes"] for r in counted]
    post, _ = learn(patterns, np.array([r["weight"] for r in counted], float)) if patterns else (np.zeros(0), None)
    spark = documents.sparkSession
    learnt = spark.createDataFrame([(p, float(x)) for p, x in zip(patterns, post)], "votes string, posterior double")
    sums = {c: F.sum(c).alias(c) for c in _STATS}
    per_doc = (
        found.join(F.broadcast(learnt), "votes")
        .groupBy("doc_id")
        .agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("posterior") >= 0.5, F.col("chars")).otherwise(0)).alias("in_prose"), *sums.values())
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    prose = F.coalesce(F.col("in_prose") / F.col("chars"), F.lit(0.0))
    return documents.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.col("words"), F.lit(0)).cast("bigint").alias("words"),
        over("letters", "words").alias("mean_word_length"),
        over("marks", "size").alias("symbol_ratio"),
        over("ended", "lines").alias("ended_lines"),
        over("common", "words").alias("common_share"),
        F.round(prose, 6).alias("prose"),
        F.when(prose >= 0.5, "prose").otherwise("other").alias("kind"),
    )
