"""Golden rows: what is declared in a small file of each language."""

import pytest

from symweave.extract.symbols import symbols_and_calls
from symweave.schemas import SUFFIXES

# text, then "name kind start-end" of each symbol
GOLDEN = {
    "python": ("import os\n\nLIMIT = 3\n\nclass A(B):\n    def m(self):\n        return 1\n\nasync def f():\n    pass\n", "import os|import|1-1, LIMIT|variable|3-3, A|class|5-7, m|method|6-7, f|function|9-10"),
    "javascript": ('import a from "a";\nconst b = 3;\nexport function f(x) {\n  return x;\n}\nclass C {\n  m(x) {\n    return 1;\n  }\n}\nconst g = (x) => x;\n', 'import a from "a";|import|1-1, b|variable|2-2, f|function|3-5, C|class|6-10, m|method|7-9, g|function|11-11'),
    "typescript": ("export class C {\n  m(x: number): string {\n    return '';\n  }\n}\nexport const f = async (x: number): Promise<void> => {\n};\n", "C|class|1-5, m|method|2-4, f|function|6-7"),
    "tsx": ("export default function App() {\n  return <a/>;\n}\n", "App|function|1-3"),
    "go": ("package a\n\ntype T struct {\n\tn int\n}\n\nfunc (t *T) M() {\n}\n\nfunc F() {\n}\n", "T|class|3-5, M|method|7-8, F|function|10-11"),
    "rust": ("pub struct S {\n    a: u8,\n}\nimpl S {\n    pub fn m(&self) {\n    }\n}\nfn f() {\n}\n", "S|class|1-3, S|class|4-7, m|function|5-6, f|function|8-9"),
    "java": ("package a;\npublic class C {\n    public int m(int x) {\n        return x;\n    }\n}\n", "C|class|2-6, m|method|3-5"),
    "c": ("#include <a.h>\n#define N 3\nint f(int x) {\n    return x;\n}\n", "#include <a.h>|import|1-1, N|variable|2-2, f|function|3-5"),
    "cpp": ("#include <a>\nclass C {\n};\nint C::m(int x) {\n  return x;\n}\n", "#include <a>|import|1-1, C|class|2-3, C::m|function|4-6"),
    "json": ('{\n  "a": 1\n}\n', "a|variable|2-2"),
    "yaml": ("a:\n  b: 1\n", "a|variable|1-1, b|variable|2-2"),
    "toml": ("[a]\nb = 1\n", "a|section|1-2, b|variable|2-2"),
    "ini": ("[a]\nb = 1\n", "a|section|1-2, b|variable|2-2"),
    "markdown": ("# A\ntext\n\nB\n---\n", "A|section|1-5, B|section|4-5"),
    "css": (".a {\n  b: c;\n}\n", ".a|section|1-3"),
    "scss": ("@mixin m {\n  b: c;\n}\n", "m|function|1-3"),
    "less": (".m() {\n  b: c;\n}\n", "m|function|1-3"),
    "html": ("<body>\n  <p>x</p>\n</body>\n", "body|section|1-3"),
    "xml": ("<a>\n  <b/>\n</a>\n", "a|section|1-3"),
    "lua": ("local function f(x)\n  return x\nend\n", "f|function|1-3"),
    "bash": ("f() {\n  echo\n}\n", "f|function|1-3"),
    "powershell": ("function Get-It {\n  1\n}\n", "Get-It|function|1-3"),
    "fish": ("function f\n  echo\nend\n", "f|function|1-3"),
    "batch": (":part\n  echo\n", "part|function|1-2"),
    "r": ("f <- function(x) {\n  x\n}\n", "f|function|1-3"),
    "scala": ("object A {\n  def m(x: Int) = {\n    x\n  }\n}\n", "A|class|1-5, m|function|2-4"),
    "elixir": ("defmodule A do\n  def m(x) do\n    x\n  end\nend\n", "A|class|1-5, m|function|2-4"),
    "erlang": ("f(X) -> X.\n", "f|function|1-1"),
    "haskell": ("f :: Int -> Int\n", "f|function|1-1"),
    "ocaml": ("let rec f x =\n  x\nmodule M = struct\nend\n", "f|function|1-2, M|class|3-4"),
    "dart": ("class A {\n  int m(int x) {\n    return x;\n  }\n}\n", "A|class|1-5, m|method|2-4"),
    "hcl": ('resource "a" "b" {\n  c = 1\n}\n', 'resource "a" "b"|section|1-3'),
    "proto": ("message M {\n  int32 a = 1;\n}\nservice S {\n  rpc Get(M) returns (M);\n}\n", "M|class|1-3, S|class|4-6, Get|function|5-5"),
    "graphql": ("type T {\n  a: Int\n}\n", "T|class|1-3"),
    "sql": ("CREATE TABLE t (\n  a int\n);\ncreate index i on t (a);\n", "t|class|1-3, i|variable|4-4"),
    "svelte": ("<script>\n  let a;\n</script>\n", "script|section|1-3"),
    "vue": ("<template>\n  <p/>\n</template>\n", "template|section|1-3"),
    "dockerfile": ("FROM a:1\nRUN b\n", "a:1|import|1-1"),
    "make": ("A = 1\nall: b\n\techo\n", "A|variable|1-1, all|function|2-3"),
    "perl": ("package A;\nsub f {\n  1;\n}\n", "A|class|1-1, f|function|2-4"),
    "zig": ("pub fn f() void {\n    a();\n}\nconst b = 1;\n", "f|function|1-3, b|variable|4-4"),
    "clojure": ("(defn f [x]\n  x)\n(def a 1)\n", "f|function|1-2, a|variable|3-3"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"a.{x}", x, text, "c") for x, (text, _) in GOLDEN.items()]
    symbols, _, errors = symbols_and_calls(spark.createDataFrame(rows, "file_path string, language string, text string, checksum string"))
    assert errors.count() == 0
    out: dict[str, set] = {}
    for r in symbols.collect():
        out.setdefault(r.language, set()).add(f"{r.name}|{r.kind}|{r.start_line}-{r.end_line}")
    return out


@pytest.mark.parametrize("language", GOLDEN)
def test_golden(found, language):
    assert found.get(language, set()) == set(GOLDEN[language][1].split(", "))


def test_languages():
    assert set(GOLDEN) <= set(SUFFIXES.values()) | {"make"}
