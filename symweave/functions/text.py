"""Text functions: matching, tokens, stems, formatting."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like_ascii(text: Column, query: str) -> Column:
    """``LIKE '%query%'``, in which only ASCII letters match regardless of case.

    ``%`` and ``_`` in the query are wildcards and nothing escapes them.
    """
    return ascii_lower(text).like("%" + query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%")


def first_line(text: Column, limit: int = 80) -> Column:
    return F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, limit)


def summary_line() -> Column:
    """``start-end [kind] signature``, or the name where the signature is null or empty."""
    shown = F.when(F.length("signature") > 0, F.col("signature")).otherwise(F.col("name"))
    return F.format_string("%s-%s [%s] %s", "start_line", "end_line", "kind", shown)


def embedding_text() -> Column:
    """Name, signature and docstring with a blank between each, outer white space removed."""
    empty = F.lit("")
    return F.trim(F.concat_ws(" ", F.coalesce("name", empty), F.coalesce("signature", empty), F.coalesce("docstring", empty)))


_TOKEN = re.compile(r"[^\W_]+")


def folded_tokens(text: str | None) -> list[str]:
    """Lower-case words without diacritics; everything but letters and digits separates."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _TOKEN.findall(text.lower())




def _measure(stem: str) -> int:
    shape = re.sub(r"v+", "v", re.sub(r"c+", "c", "".join("v" if _is_vowel(stem, i) else "c" for i in range(len(stem)))))
    return shape.count("vc")


def _is_vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _is_vowel(word, i - 1)


def _has_vowel(stem: str) -> bool:
    return any(_is_vowel(stem, i) for i in range(len(stem)))


def _cvc(word: str) -> bool:
    n = len(word)
    return n >= 3 and not _is_vowel(word, n - 1) and _is_vowel(word, n - 2) and not _is_vowel(word, n - 3) and word[-1] not in "wxy"


# The suffix pairs of Porter's published algorithm (Program 14(3), 1980), steps 2 to 4.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of an English word by Porter's algorithm; words of other scripts stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    again = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and not _is_vowel(word, len(word) - 1) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda p: -len(p[0])):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_udf(texts: pd.Series) -> pd.Series:
    return texts.map(folded_tokens)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_udf(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    out = []
    for text in texts:
        words = folded_tokens(text)
        for w in words:
            if w not in known:
                known[w] = porter(w)
        out.append([known[w] for w in words])
    return pd.Series(out)
