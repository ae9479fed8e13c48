"""Line rules: what a line declares, by language.

Each rule is a kind and a regular expression whose first group is the name. Of the rules of a
language the first that matches a line counts. They look at one line at a time and so can't see
what a parser sees; languages with a parser at hand don't use them (see ``python_source``).
"""

from __future__ import annotations

_ID = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|virtual|inline|extern|const|unsafe|open|sealed|synchronized|native|declare|readonly)\s+)*"
_TYPE = r"[\w:<>\[\],.*&?]+(?:\s+|\s*[*&]+\s*)"
_NOT_CALL = r"(?!return\b|else\b|if\b|for\b|while\b|switch\b|case\b|new\b|throw\b|delete\b|goto\b|typedef\b|using\b)"

_JS = [
    ("import", r"^(import\b.{0,73})"),
    ("class", rf"^\s*{_MODS}class\s+{_ID}"),
    ("function", rf"^\s*{_MODS}function\s*\*?\s*{_ID}"),
    ("function", rf"^\s*{_MODS}(?:const|let|var)\s+{_ID}\s*(?::[^=]*)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|[\w$]+\s*=>)"),
    ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}"),
    ("method", rf"^\s+{_MODS}(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b){_ID}\s*\([^;]*\)\s*(?::[^{{;]*)?\{{\s*$"),
]
_C = [
    ("import", r"^(\s*#\s*include\b.{0,60})"),
    ("variable", rf"^\s*#\s*define\s+{_ID}"),
    ("class", rf"^\s*typedef\b.*?\b{_ID}\s*;"),
    ("function", rf"^{_NOT_CALL}(?:{_TYPE})+((?:\w+::)*~?\w+)\s*\([^;]*$"),
]
_CSS = [("section", r"^\s*(@(?:media|supports|keyframes)\b[^{]{0,80})"), ("section", r"^\s*([.#\w:*&\[>][^{};@]{0,80}?)\s*\{")]
_TAGS = [("section", r"^<([A-Za-z][\w:.-]*)")]

RULES: dict[str, list[tuple[str, str]]] = {
    # For files that Python's parser refuses.
    "python": [("import", r"^\s*((?:import|from)\b.{0,73})"), ("class", r"^\s*class\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)"), ("variable", r"^([A-Za-z_]\w*)\s*(?::[^=]*)?=(?!=)")],
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": [
        ("method", rf"^func\s+\([^)]*\)\s*{_ID}"),
        ("function", rf"^func\s+{_ID}"),
        ("class", rf"^type\s+{_ID}"),
    ],
    "rust": [
        ("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+{_ID}"),
        ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_ID}"),
        ("class", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"),
    ],
    "java": [
        ("class", rf"^\s*{_MODS}(?:class|interface|enum|record)\s+{_ID}"),
        ("method", rf"^\s+{_NOT_CALL}{_MODS}(?:{_TYPE})?{_ID}\s*\([^;]*\)\s*(?:throws\s+[\w., ]+)?\{{?\s*$"),
    ],
    "c": _C,
    "cpp": [_C[0], _C[1], ("class", rf"^\s*(?:class|struct|namespace)\s+{_ID}(?!.*;)"), *_C[2:]],
    "json": [("variable", r"^\s*\"((?:[^\"\\]|\\.)*)\"\s*:")],
    "yaml": [("variable", r"^\s*(?:-\s+)?([^\s#:\-][^:#]*?)\s*:(?:\s|$)")],
    "toml": [("section", r"^\s*\[{1,2}\s*([^\]]+?)\s*\]{1,2}"), ("variable", r"^\s*([\w.\-\"']+)\s*=")],
    "ini": [("section", r"^\s*\[([^\]]+)\]"), ("variable", r"^\s*([^\s;#=:\[][^=:]*?)\s*[=:]")],
    "markdown": [("section", r"^ {0,3}#{1,6}\s+(.+?)\s*#*\s*$")],
    "css": _CSS,
    "scss": [("function", rf"^\s*@mixin\s+([\w-]+)"), *_CSS],
    "less": [("function", r"^\s*\.([\w-]+)\s*\([^)]*\)\s*\{"), *_CSS],
    "html": _TAGS,
    "xml": _TAGS,
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)")],
    "bash": [("function", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+([\w-]+)")],
    "powershell": [("function", r"(?i)^\s*function\s+([\w-]+)")],
    "fish": [("function", r"^\s*function\s+([\w-]+)")],
    "batch": [("function", r"^:([A-Za-z_]\w*)")],
    "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b")],
    "scala": [("function", rf"^\s*{_MODS}(?:implicit\s+)?def\s+{_ID}"), ("class", rf"^\s*{_MODS}(?:case\s+)?(?:class|object|trait)\s+{_ID}")],
    "elixir": [("class", r"^\s*(?:defmodule|defprotocol|defimpl)\s+([\w.]+)"), ("function", r"^\s*(?:defp?|defmacrop?)\s+([\w?!]+)")],
    "erlang": [("function", r"^([a-z]\w*)\s*\(.*->")],
    "haskell": [("function", r"^([a-z_][\w']*)\s*(?:::|[^=]*=)")],
    "ocaml": [("function", r"^\s*let\s+(?:rec\s+)?([a-z_][\w']*)"), ("class", r"^\s*module\s+([A-Z]\w*)")],
    "dart": [("class", rf"^\s*{_MODS}(?:class|mixin|enum|extension)\s+{_ID}"), ("method", rf"^\s+{_NOT_CALL}(?:{_TYPE})?{_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{"), ("function", rf"^{_NOT_CALL}(?:{_TYPE})?{_ID}\s*\([^;]*\)\s*(?:async\s*)?\{{")],
    "hcl": [("section", r"^([a-z_]\w*(?:\s+\"[^\"]+\")*)\s*\{")],
    "proto": [("class", rf"^\s*(?:message|service)\s+{_ID}"), ("function", rf"^\s*rpc\s+{_ID}")],
    "graphql": [("class", rf"^\s*(?:type|input|enum|interface|union|scalar)\s+{_ID}")],
    "sql": [
        ("class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),
        ("variable", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),
        ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+([\w.\"]+)"),
    ],
    "svelte": [("section", r"^<(script|style|template)\b")],
    "vue": [("section", r"^<(script|style|template)\b")],
    "dockerfile": [("import", r"(?i)^\s*from\s+(\S+)")],
    "make": [("variable", r"^([\w.-]+)\s*[:?+!]?="), ("function", r"^([^.\s:#=][^\s:#=]*)[^:=]*:(?!=)")],
    "perl": [("function", r"^\s*sub\s+(\w+)"), ("class", r"^\s*package\s+([\w:]+)")],
    "zig": [("function", r"^\s*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+(\w+)"), ("variable", r"^(?:pub\s+)?(?:const|var)\s+(\w+)")],
    "clojure": [("function", r"^\s*\(defn-?\s+(\S+)"), ("class", r"^\s*\((?:defprotocol|defrecord|deftype)\s+(\S+)"), ("variable", r"^\s*\(def\s+(\S+)")],
}

#: Words that stand before a bracket without being called.
KEYWORDS = (
    "if for while switch catch return sizeof typeof new function func fn def class match with elif except assert print await in and or not "
    "loop unless until when where case do else"
).split()
CALL = r"([A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\("

#: What isn't code, in the languages whose calls are collected by rules: comments and strings.
NOT_CODE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?"
QUOTED = {language: r"|'(?:\\.|[^'\\\n])*'?" for language in ("javascript", "typescript", "tsx")}
QUOTED_SIGN = r"|'(?:\\[^'\n]+|[^'\\\n])'"
