"""Functions and methods paired with their documentation.

A table of symbols with qualified names and normalised signatures is built over all files.
Declarations are joined with definitions of the same symbol, overloads being told apart by their
signatures, and then what has only empty or trivial documentation is dropped.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.session import cut

# Words that speak of the documentation rather than of the function, in English,
# German and Spanish, and words that carry no content by themselves.
ABOUT_DOCS = set(
    """
    doc docs docstring docstrings documentation document documented documenting undocumented describe described
    describes describing description descriptions comment comments commented summary placeholder todo fixme tbd xxx
    hack wip stub method methods function functions func class base member public private protected internal
    interface api part parts team ask ticket issue see above below elsewhere inherited inherit inheritdoc meta auto
    autogenerated generated default replace real insert goes here add proper please explain write writing written
    sentence sentences line lines remove afterwards later yet sorry missing empty blank none null nil na purpose
    purposely intentionally left filled fill release next soon someone somebody time deprecated obsolete noqa therefore
    what takes gives give back text title name overview boilerplate template content section details info
    information reader readers readable license licence licensed licenses copyright project rights reserved plain
    reuse terms file root left author authors nobody legal notice file used internally nothing say obvious self explanatory selbsterklärend
    beschreibung beschrieben beschreiben dokumentieren dokumentation dokumentiert kommentar folgt später noch sobald
    jemand zeit hat fehlt keine kein siehe oben offen intern geerbt
    pendiente describir documentar documentación descripción comentario falta heredado interno ver arriba después luego
    """.split()
)
PLAIN = set(
    """
    a an the this that these those it its is are was be been being will would should can could may must do does did done
    has have had of for from to in on at by with without and or not no but as if so than then using use uses given
    into per via about under before after between within one two some any all each
    der die das den dem des ein eine einen und oder nicht wird werden ist sind war mit von zu für auf im in es
    el la los las un una unos unas y o no es son de del al que en con por para se lo su sin esta este
    """.split()
)

# What a tag says of the whole function or its result is kept; what it says of a parameter or type is none of the function's.
_TAG_TEXT = re.compile(r"@(?:brief|summary|details|description|note|remarks?|returns?)\b[ \t]*|@(?!deprecated\b|inheritdoc\b)[A-Za-z]\w*[^@\n]*|[@{]*@(?:deprecated|inheritdoc)\b\}?", re.I)
_FIELD_TEXT = re.compile(r"(?m)(?:^|(?<=\s)):returns?:|(?:^|(?<=\s)):(?:param|parameter|arg|argument|rtype|type|raises|yields|meta|var|ivar|cvar|key|keyword)\b[^:\n]*:(?:(?!\s:\w)[^\n])*", re.I)
_HEADED = re.compile(
    r"(?mi)^[ \t]*(?:parameters|returns|raises|args|arguments|yields|attributes|other parameters)[ \t]*:?[ \t]*"
    r"(?:\n\s*(?:[-=~]{3,}\s*)?|[-=~]{3,}\s*)((?:[ \t]*[\w*]+(?:[ \t]*:[^\n]*)?[ \t]*(?:\n|\Z))*(?:[ \t]*(?:[\w*]+[ \t]+)+[\w*]+[ \t]*\Z)?)"
)
_SIGNS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+|/{2,}!?|#+!?|--(?=\s)|;+|%+|<!--|\"{3}|'{3})[ \t]?|[ \t]*(?:\*+/|-->|\"{3}|'{3})[ \t]*$")
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]*>|`{1,3}|\*{1,3}(?=\w)|(?<=\w)\*{1,3}")
_NOQA = re.compile(r"\b(?:noqa|pylint|type|eslint[\w-]*|nolint)\s*:\s*[\w, -]+", re.I)
_CODE = re.compile(r"\b[\w.\[\]]+\s*[-+*/]?=\s*[\w.]+\([^()\n]*\);?(?:\s*return\s+[\w.]+;?)?|\breturn\s+[\w.]+;?\s*$|^\s*[\w.]+\([^()\n]*\);?\s*$", re.M)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=\s*[A-ZÄÖÜÁÉÍÓÚÑ¿¡-])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PART = re.compile(r"[A-ZÄÖÜ]+(?![a-zäöü])|[A-ZÄÖÜ]?[a-zäöüß]+|[^\W\d_a-zA-Z]+")


def plain_text(docstring: str) -> str:
    """A docstring without comment signs, tags, markup and code."""
    text = html.unescape(docstring.replace("\r\n", "\n").replace("\r", "\n"))
    text = _SIGNS.sub("", _SIGNS.sub("", text))
    text = _MARKUP.sub("", text)
    text = _NOQA.sub("", text)
    text = _FIELD_TEXT.sub("", _TAG_TEXT.sub("", text))
    text = _HEADED.sub("\n", text)
    return _CODE.sub("", text).strip()


def parts_of(name: str) -> set[str]:
    """The words of an identifier, in lower case."""
    return {p.lower() for p in _PART.findall(name.replace("_", " "))}


def _stem(word: str) -> str:
    for end in ("ing", "ies", "ied", "es", "ed", "s"):
        if word.endswith(end) and len(word) >= len(end) + 3:
            word = word[: -len(end)]
            break
    if len(word) > 3 and word[-1] in "eyi":
        word = word[:-1]
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word


def _without_signature(text: str, name: str) -> str:
    """Without the lines that only repeat the declaration."""
    if not name or name + "(" not in text:
        return text
    line = re.compile(r"(?m)^[ \t]*(?:[\w*&:<>\[\],]+[ \t]+)*(?:\([^()\n]*\)[ \t]*)?[*&]*" + re.escape(name) + r"\([^()\n]*(?:\)[^.\n]{0,40})?$")
    return line.sub("", text)


def tells(docstring: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a docstring says in words what the function does or how it behaves.

    What its name and its parameters say already doesn't count, nor do remarks that would fit any
    function.
    """
    if not docstring:
        return False
    text = _without_signature(plain_text(docstring), name or "")
    own = parts_of(name or "") | {(name or "").lower()}
    inside = re.search(r"\(([^)]*)", signature or "")
    for identifier in re.findall(r"[^\W\d]\w*", inside.group(1) if inside else ""):
        own |= parts_of(identifier) | {identifier.lower()}
    stems = {_stem(w) for w in own}
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence.lower())
        content = [w for w in words if w not in PLAIN and len(w) > 1]
        if not content or all(w in ABOUT_DOCS for w in content):
            continue
        rest = [w for w in content if _stem(w) not in stems and w not in own]
        # "Renders the order", "This function renders the order for the given scope"
        if not rest or all(w in GENERIC for w in rest):
            continue
        if len(rest) == 1 and len(content) == 1 and len(words) == 1:
            continue  # a lone word is no statement
        return True
    return False


#: Parameter-like words and fillers that add nothing to a restated name.
GENERIC = {"function", "method", "this", "helper", "given", "value", "values", "parameter", "parameters", "argument", "arguments", "result"} | {
    "funktion", "methode", "función", "método", "simply", "just",
}


_JUDGED = T.StructType([T.StructField("by", T.IntegerType()), T.StructField("description", T.StringType())])


@F.pandas_udf(_JUDGED)
def _judged(docstring: pd.Series, other: pd.Series, name: pd.Series, signature: pd.Series) -> pd.DataFrame:
    """Whose docstring tells something, 1 for the symbol's own, else 2 for the other's, 0 for neither, and its text."""
    by, texts = [], []
    for own, more, n, s in zip(docstring, other, name, signature):
        found = next((k for k, d in ((1, own), (2, more)) if d and tells(d, n, s)), 0)
        by.append(found)
        texts.append(plain_text(own if found == 1 else more) if found else None)
    return pd.DataFrame({"by": by, "description": texts})


# Languages that write the type of a parameter before its name, or alone; and after it, without a colon.
TYPE_FIRST = frozenset("c cpp c_sharp java dart groovy php".split())
NAME_FIRST = frozenset(["go"])
_RECEIVERS = re.compile(r"[&*]*(?:mut )?(?:self|this|cls)\b|void$|[*/]$")
_OPEN, _SHUT = "([{<", ")]}>"


def _parameters(signature: str, name: str) -> list[str] | None:
    """The parameters of a signature, split at the commas outside of brackets and strings; None without a list."""
    named = re.search(rf"(?<!\w){re.escape(name)}\s*(?=[(<])", signature) if name else None
    at = signature.find("(", named.end() if named else 0)
    if at < 0:
        return None
    out, depth, quote, start = [], 0, "", at + 1
    for i in range(at + 1, len(signature)):
        c = signature[i]
        if quote:
            quote = "" if c == quote and signature[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _SHUT and not (c == ">" and signature[i - 1] in "-="):
            if not depth:
                out.append(signature[start:i])
                break
            depth -= 1
        elif c == "," and not depth:
            out.append(signature[start:i])
            start = i + 1
    else:
        out.append(signature[start:])  # a cut signature
    return [p.strip() for p in out if p.strip()]


def _outside(text: str, signs: str) -> int:
    """Where a sign stands outside of brackets first, not doubled or part of an arrow; -1 if nowhere."""
    depth = 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _SHUT and not (c == ">" and i and text[i - 1] in "-="):
            depth -= 1
        elif c in signs and not depth and c not in (text[i - 1 : i], text[i + 1 : i + 2]) and text[i : i + 2] != "=>":
            return i
    return -1


def parameter_types(signature: str | None, name: str | None = None, language: str | None = None) -> str:
    """The types of a signature's parameters, without names, defaults and white space.

    ``name: type``, ``type name`` and (in Go) ``name type`` come out alike; an untyped parameter
    counts as ``?``, and a receiver (self, this) not at all. Commas within brackets separate nothing.
    """
    kinds = []
    for p in _parameters(signature or "", name or "") or []:
        if _RECEIVERS.match(p):
            continue
        if (at := _outside(p, "=")) >= 0:
            p = p[:at].strip()
        p = re.sub(r"^(?:@\w+(?:\([^()]*\))?\s+|final\s+|readonly\s+|(?:public|private|protected)\s+)+", "", p)
        colon = _outside(p, ":")
        if colon >= 0:
            kind = p[colon + 1 :]
        elif language in NAME_FIRST:
            kind = p.split(None, 1)[-1]
        elif language in TYPE_FIRST or re.search(r"\w[\s*&]+\w+$", p):
            named = re.match(r"(.*[\s*&>\]])\w+((?:\[\w*\])*)$", p)
            kind = named.group(1) + named.group(2) if named and named.group(1).strip() not in ("const", "struct") else p
        else:
            kind = "?"
        kinds.append(re.sub(r"\s+(?=\W)|(?<=\W)\s+", "", kind.strip()))
    return ",".join(kinds)


@F.pandas_udf(T.StringType())
def _types(signature: pd.Series, name: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([parameter_types(s, n, x) for s, n, x in zip(signature, name, language)], dtype=object)


def symbol_table(symbols: DataFrame) -> DataFrame:
    """The current functions and methods with a signature, and their qualified names.

    The row with the latest ``indexed_at`` of an id is current (rows that tie are taken as equal).
    Kinds count without case and outer blanks. Null ids are left out. A qualified name is the path
    without suffix and without folders of headers and sources, then the parents and the name, however these are
    joined (``a::b``, ``a.b``) and without type parameters.
    """
    columns = ["name", "kind", "file_path", "signature", "docstring", "parent_name", "language"]
    rows = (
        symbols.where("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("indexed_at", *columns)).alias("row"))
        .select("id", *[F.col(f"row.{c}").alias(c) for c in columns])
    )
    kind = F.lower(F.trim(F.regexp_replace("kind", r"\s+", " ")))
    path = F.regexp_replace(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"\\", "/"), r"^[A-Za-z]:", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"(?i)(?:^|/)(?:include|src|source|headers?|inc)(?=/)", "")
    stem = F.regexp_replace(path, r"(?<=[^/])\.(?:d\.)?[^./]*$", "")
    inner = F.concat_ws("/", F.when(F.trim("parent_name") != "", F.trim("parent_name")), F.trim("name"))
    inner = F.regexp_replace(F.regexp_replace(inner, r"<[^<>]*>|\s+", ""), r"::|\.|#", "/")
    return rows.where(kind.isin("function", "method") & F.col("signature").rlike(r"\S")).select(
        "id", "name", "signature", "docstring", F.lower(F.trim("language")).alias("language"), F.concat_ws("/", stem, inner).alias("qualified")
    )


def counterparts(table: DataFrame) -> DataFrame:
    """``id, other_id, other``: the docstring of another symbol with the same qualified name and the same parameter types.

    Of several the longest, then that of the smallest id. ``table`` has the columns of :func:`symbol_table`.
    """
    table = table.where("name is not null")
    shared = table.groupBy("qualified").agg(F.count("*").alias("n")).where("n > 1").select("qualified")
    members = table.join(shared, "qualified").select("id", "qualified", _types("signature", "name", "language").alias("types"), "docstring")
    keys = ["qualified", "types"]
    members = cut(members)  # few: overloads, and what is declared apart from its definition
    best = F.max(F.struct(F.length("docstring").alias("length"), (-F.col("id")).alias("least"), "docstring"))
    spoken = members.where(F.col("docstring").rlike(r"(?U)\w"))
    first = spoken.groupBy(*keys).agg(best.alias("first"))
    second = spoken.join(first, keys).where(F.col("id") != -F.col("first.least")).groupBy(*keys).agg(best.alias("second"))
    both = members.join(first, keys).join(second, keys, "left")
    other = F.when(F.col("id") != -F.col("first.least"), F.col("first")).otherwise(F.col("second"))
    return both.select("id", other.alias("o")).where("o is not null").select("id", (-F.col("o.least")).alias("other_id"), F.col("o.docstring").alias("other"))


def pairs(symbols: DataFrame) -> DataFrame:
    """``id, documented_id, signature, description``: code paired with its documentation.

    Each function is joined with the declaration or definition of the same symbol elsewhere (a
    header and its source, a stub and its module), overloads being told apart by the types of
    their parameters. Then what tells nothing is dropped: the description is its own docstring if
    that tells something, else the other's.
    """
    table = cut(symbol_table(symbols))
    joined = table.join(counterparts(table), "id", "left").where(F.col("docstring").rlike(r"(?U)\w") | F.col("other_id").isNotNull())
    judged = joined.select("id", "other_id", "signature", _judged("docstring", "other", "name", "signature").alias("j")).where("j.by > 0")
    return judged.select("id", F.when(F.col("j.by") == 1, F.col("id")).otherwise(F.col("other_id")).alias("documented_id"), "signature", "j.description")
