"""The layout of source code: lexing, canonical re-emission and how far a text is from it.

A head is cut into comments, strings, numbers, words and signs, and written again in one fixed
style: a statement, or an opening or closing brace, to a line, broken at commas where a line would
be too long. Comparing that with the lines as they are tells code that a person has laid out from
code that was squeezed, printed by a loop, or is no code at all but bulk data.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

WIDTH = 88  # a canonical line is broken at the first comma beyond

# Suffixes of languages whose line comments begin with #, with -- or with ;, and of prose.
HASH = frozenset("py pyi rb sh bash zsh fish yaml yml toml ini cfg conf pl pm r R ex exs mk make cmake tf hcl nix ps1 graphql gql".split())
DASHES = frozenset("sql lua hs elm adb ads vhd".split())
SEMICOLON = frozenset("clj cljs cljc lisp el scm asm s".split())
PROSE = frozenset("md markdown rst txt adoc tex".split())

_REST = r"""
(?P<string>"(?:\\.|[^"\\\n])*(?:"|$|(?=\n))|'(?:\\.|[^'\\\n])*(?:'|$|(?=\n))|`(?:\\.|[^`\\])*(?:`|$))
|(?P<number>(?<![\w$])(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z%]{0,3}(?![\w$]))
|(?P<word>[^\W\d][\w$]*(?:-[^\W\d][\w$]*)*|[\w$]+)
|(?P<newline>\n)
|(?P<sign>[^\w\s])
"""
_BLOCK = r"""/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)"""


def _lexer(line_comment: str) -> re.Pattern[str]:
    return re.compile(rf"(?P<comment>{_BLOCK}|{line_comment})|{_REST}", re.S | re.X)


_C = _lexer(r"//[^\n]*|(?:(?<=\n)|(?<![\s\S]))[ \t]*\#![^\n]*")
_LEXERS = {s: _lexer(r"\#[^\n]*") for s in HASH} | {s: _lexer(r"--[^\n]*") for s in DASHES} | {s: _lexer(r";[^\n]*") for s in SEMICOLON}
_CONTINUES = frozenset(",+-*/%=&|<>([.:?\\")


class Layout(NamedTuple):
    comments: str  # the text of all comments
    lines: int  # lines that hold code
    canonical: int  # canonical lines
    width: float  # mean length of a canonical line
    literals: int  # strings and numbers that aren't keys
    words: int
    uniform: float  # share of the canonical lines that are equal but for their literals


def tokens(text: str, suffix: str) -> list[tuple[str, str]]:
    """``kind, text`` of each token: comment, string, number, word, newline or sign."""
    found = _LEXERS.get(suffix, _C).finditer(text.replace("\r\n", "\n").replace("\r", "\n"))
    return [(m.lastgroup or "sign", m.group()) for m in found]


def canonical(found: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The tokens of each canonical line, comments left out."""
    out: list[list[tuple[str, str]]] = []
    line: list[tuple[str, str]] = []
    size = inside = 0

    def end() -> None:
        nonlocal line, size
        if line:
            out.append(line)
        line, size = [], 0

    for kind, text in found:
        if kind == "comment":
            continue
        if kind == "newline":
            if line and not inside and line[-1][1][-1] not in _CONTINUES:
                end()
            continue
        if text == "}":
            end()
        elif text in (";", ",", ")") and not line and out and out[-1][-1][1] == "}":
            out[-1].append((kind, text))  # it stays behind the brace
            continue
        line.append((kind, text))
        size += len(text) + 1
        if kind == "sign":
            if text in "([":
                inside += 1
            elif text in ")]":
                inside = max(0, inside - 1)
            elif text in "{}" or text == ";" and not inside or text == "," and size > WIDTH:
                end()
    end()
    return out


def _shape(line: list[tuple[str, str]]) -> tuple:
    return tuple(kind if kind in ("string", "number") else text for kind, text in line)


def measured(head: str, suffix: str) -> Layout:
    """How a head is laid out. Prose has no layout: all its counts are 0."""
    if suffix in PROSE:
        found = [(k, t) for k, t in tokens(head, suffix) if k == "comment"]
    else:
        found = tokens(head, suffix)
    comments = "\n".join(t for k, t in found if k == "comment")
    lines, held = 0, False
    literals = words = 0
    code = [(k, t) for k, t in found if k not in ("comment", "newline")]
    for (kind, _), after in zip(code, [*code[1:], ("", "")]):
        key = kind in ("string", "number") and after[1] == ":"  # the name of what follows
        literals += kind in ("string", "number") and not key
        words += kind == "word" or key
    for kind, _ in [*found, ("newline", "")]:
        if kind == "newline":
            lines, held = lines + held, False
        elif kind != "comment":
            held = True
    laid = canonical(found)
    shapes = Counter(map(_shape, laid)).most_common(1)
    width = sum(sum(len(t) for _, t in x) + sum(k in ("word", "number", "string") for k, _ in x) for x in laid) / max(1, len(laid))
    return Layout(comments, lines, len(laid), width, literals, words, shapes[0][1] / len(laid) if laid else 0.0)
