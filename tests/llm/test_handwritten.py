from datetime import datetime

from symweave.llm.handwritten import classified
from symweave.llm.layout import canonical, measured, tokens

FILES = "file_path string, checksum string, symbol_count int, file_size bigint, indexed_at timestamp_ntz, origin string"
HEADS = "file_path string, line_count int, longest_line int, head string, checksum string"
SUMS = "checksum string, package_name string, release string"
NOW = datetime(2024, 1, 1)


def test_origins(spark):
    minified = "function a(b){var c=b.d(5);return c?d[2]:!0};function e(f){return f.g(3)?h[1]:!1};function i(j){k(l);m(n);return o}"
    cases = {
        "/p/src/a.py": ("handwritten", "# Helpers that generate the report.\nimport os", 3000, 90, 80),
        "/p/src/big.go": ("handwritten", "// Copyright the team.\npackage x", 900_000, 30_000, 120),
        "/p/src/one_long_line.ts": ("handwritten", 'import x from "y";', 8000, 40, 6000),
        "/p/src/by_hand.py": ("handwritten", "# Written by hand because the generator can't do this yet.", 300, 10, 60),
        "/p/src/docs.md": ("handwritten", "<!-- The docs are generated from this file -->", 300, 10, 60),
        "/p/vendors/shop.py": ("handwritten", "import x", 300, 10, 60),
        "/p/src/conf.json": ("handwritten", '{\n  "a": "b",\n  "c": 17,\n', 300, 10, 60),
        "/p/vendor/libx/a.c": ("vendored", '#include "x.h"', 300, 10, 60),
        "C:\\p\\.\\node_modules\\libx\\a.js": ("vendored", None, 300, 10, 60),
        "/p/src/copy.c": ("vendored", None, 300, 10, 60),
        "/p/src/lic.c": ("vendored", "/*\n * Part of libx. See the licence that came with libx for terms.\n */", 300, 10, 60),
        "/p/src/a_pb2.py": ("generated", None, None, None, None),
        "/p/package-lock.json": ("generated", "{", 300, 10, 60),
        "/p/src/gen/a.go": ("generated", "package a", 300, 10, 60),
        "/p/src/g.ts": ("generated", "// DO NOT EDIT: regenerate with make libx", 300, 10, 60),
        "/p/src/de.py": ("generated", "# Diese Datei wurde von libx erzeugt und wird überschrieben.", 300, 10, 60),
        "/p/src/m.js": ("minified", minified, 90_000, 2, 89_000),
        "/p/src/m.min.css": ("minified", None, None, None, None),
        "/p/src/nums.py": ("data", "X = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17", 900_000, 9000, 99),
        "/p/src/__init__.py": ("handwritten", "", 0, 0, 0),
    }
    files = [(p, "ABC " if p.endswith("copy.c") else None, None, c[2], NOW, "clash") for p, c in cases.items()]
    files += [files[0], ("/p/src/a.py", "abc", 5, 9, NOW.replace(year=2020), ""), (None, "abc", 1, 1, NOW, "")]
    heads = [(p, c[3], c[4], c[1], "clash") for p, c in cases.items()] + [("/elsewhere", 1, 1, "x", ""), (None, 1, 1, "x", "")]
    sums = [("abc", "libx", "1"), ("abc", "libx", "1"), (None, None, None)]
    df = classified(spark.createDataFrame(files, FILES), spark.createDataFrame(heads, HEADS), spark.createDataFrame(sums, SUMS))
    rows = df.collect()
    assert {r.file_path: r.origin for r in rows} == {p: c[0] for p, c in cases.items()}
    assert len(rows) == len(cases)


def test_empty(spark):
    assert classified(spark.createDataFrame([], FILES), spark.createDataFrame([], HEADS), spark.createDataFrame([], SUMS)).count() == 0


def untold(spark, strip=False):
    """Origins of files that neither path nor comment gives away, with whole heads or only their comments."""
    squeezed = "/*! x */function a(b){var c=b.d(5);return c?d[2]:!0};function e(f){return f.g(3)?h[1]:!1};function i(j){k(l);m(n);return o}"
    printed = "\n".join(f'    case {k}: return "name_{k:04d}";' for k in range(1000, 1006))
    cases = {
        "/p/src/wrapped.js": ("minified", squeezed, 90_000, 190, 500),
        "/p/src/whole.css": ("minified", ".a{margin:1px;color:#fff}.b{margin:2px;color:#eee}.c{margin:3px;color:#ddd}", 50_000, 1, 50_000),
        "/p/src/unknown.js": ("minified", squeezed, None, None, None),
        "/p/src/names.c": ("generated", printed, 33_000, 1000, 33),
        "/p/src/rows.sql": ("data", "insert into t values (17, 'ab');\n" * 4, 330_000, 10_000, 33),
        "/p/src/bytes.go": ("data", "var b = []byte{\n" + "0x10, 0x22, 0x9f, 0x00,\n" * 5, 330_000, 13_000, 25),
        "/p/src/one_line.json": ("data", "[[" + "39, 231, 19, 238, " * 9, 900_000, 1, 900_000),
        "/p/src/short.js": ("handwritten", "const a = { b: 1, c: 2 }; const d = e(a); f(d); g(d); h(d);\n", 3000, 90, 80),
        "/p/src/list.go": ("handwritten", 'import "a/b"\nimport "a/c"\nimport "a/d"\nimport "a/e"\n', 3000, 100, 90),
        "/p/src/conf.yaml": ("handwritten", "a:\n  b: 1\n  c: 2\n  d: 3\n", 3000, 100, 60),
        "/p/src/text.md": ("handwritten", "# A;b;c;d;e;f;g;h;i;j;k;l\n" * 3, 90_000, 100, 900),
    }
    heads = [(p, c[3], c[4], "\n".join(t for k, t in tokens(c[1], "js") if k == "comment") if strip else c[1], "") for p, c in cases.items()]
    files = [(p, None, None, c[2], NOW, "") for p, c in cases.items()]
    rows = classified(spark.createDataFrame(files, FILES), spark.createDataFrame(heads, HEADS), spark.createDataFrame([], SUMS)).collect()
    return {r.file_path: r.origin for r in rows}, {p: c[0] for p, c in cases.items()}


def test_layout_alone_decides(spark):
    got, want = untold(spark)
    assert got == want


def test_nothing_is_found_without_code(spark):
    got, _ = untold(spark, strip=True)
    assert set(got.values()) == {"handwritten"}


def test_canonical_layout():
    written = lambda head, suffix: [" ".join(t for _, t in line) for line in canonical(tokens(head, suffix))]
    assert written("for(i=0;i<3;i++){a(b);};c()", "js") == ["for ( i = 0 ; i < 3 ; i + + ) {", "a ( b ) ;", "} ;", "c ( )"]
    assert written("# c\nx = [1,\n  2]\ny = 'a#b'  # d", "py") == ["x = [ 1 , 2 ]", "y = 'a#b'"]
    assert written("-- c\nselect a -- d\nfrom b;", "sql") == ["select a", "from b ;"]
    assert measured("", "js")[1:] == (0, 0, 0.0, 0, 0, 0.0) and measured('"open', "js").literals == 1
    long = measured("/* " + "x" * 100_000 + " */" + "a;" * 50_000, "js")
    assert (long.lines, long.canonical) == (1, 50_000)
