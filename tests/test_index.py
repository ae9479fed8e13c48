import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from symweave.functions.paths import dirname, in_skipped_folder, language_of, matches_any, suffix
from symweave.operators import fusion, graph, vectors
from symweave.plans.api import Index
from symweave.sources.files import ignore_rules, is_ignored, line_range, skip_reason

PYTHON = '''import os

LIMIT = 3


class Store:
    """Keeps things."""

    def put(self, x):
        """Put one."""
        return check(self.wrap(x))


def check(x):
    """Check it."""
    return os.path.join(x)
'''
GO = """package b

type Box struct {
	n int
}

func (b *Box) Fill(x int) error {
	fmt.Println(x)
	return helper(x)
}

func helper(x int) error {
	return nil
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src/a.py").write_text(PYTHON)
    (root / "src/b.go").write_text(GO)
    (root / "src/bad.py").write_text("def broken(:\n")
    (root / "src/empty.py").write_text("")
    (root / "src/conf.toml").write_bytes(b"[tool]\r\nname = \"\xff\"\r\n")
    (root / "README.md").write_text("# Title\n\ntext\n\n## Part\nmore\n")
    (root / "node_modules/x.js").write_text("function x() {}\n")
    (root / ".env").write_text("KEY=1")
    (root / "skip.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("# c\nskip*\n!skip.md\n")
    db = sqlite3.connect(root / "app.db")
    db.execute("create table users (id integer primary key, name text)")
    db.commit()
    db.close()
    return root


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    built = Index(spark, str(tree), str(tmp_path_factory.mktemp("index")), vectors.hashed_encoder(32))
    row = built.build().head()
    assert row.errors == 1 and row.error_details[0].file.endswith("bad.py") and "SyntaxError" in row.error_details[0].error
    return built


def test_symbols(index, tree):
    rows = {(Path(r.file_path).name, r.name): r for r in index.store.table("symbols").collect()}
    kinds = {k: r.kind for k, r in rows.items()}
    assert kinds == {
        ("a.py", "import os"): "import", ("a.py", "LIMIT"): "variable", ("a.py", "Store"): "class", ("a.py", "put"): "method",
        ("a.py", "check"): "function", ("b.go", "Box"): "class", ("b.go", "Fill"): "method", ("b.go", "helper"): "function",
        ("bad.py", "broken"): "function", ("conf.toml", "tool"): "section", ("conf.toml", "name"): "variable", ("README.md", "Title"): "section", ("README.md", "Part"): "section",
        ("app.db", "users"): "table",
    }
    put = rows["a.py", "put"]
    assert (put.parent_name, put.docstring, put.start_line, put.end_line, put.signature) == ("Store", "Put one.", 9, 11, "def put(self, x):")
    assert (rows["b.go", "Fill"].start_line, rows["b.go", "Fill"].end_line) == (7, 10)


def test_calls_and_lookups(index, tree):
    names = {r.callee_name for r in index.find_callees("put").collect()}
    assert names == {"check", "wrap"}
    assert [r.name for r in index.find_callers("helper").collect()] == ["Fill"]
    assert index.read_symbol_body("helper", str(tree / "src/b.go")).head().body.startswith("func helper")
    assert index.get_line_range(str(tree / "src/a.py"), 0, 1).head().text == "import os"
    assert index.get_file_header(str(tree / "src/a.py")).head().text == "import os\n\nLIMIT = 3"
    assert index.get_symbol("absent").count() == 0
    assert "[method]" in index.outline_summary(str(tree / "src/a.py")).head().summary
    assert [r.name for r in index.list_outline(str(tree / "src/a.py")).collect()] == ["import os", "LIMIT", "Store", "put", "check"]
    assert index.find_by_keyword("CHECK").head().name == "check"
    assert index.resolve_edit_target("check it").head().name == "check"
    assert index.store.table("vectors").count() == index.store.table("symbols").count()


def test_incremental(index, tree):
    counts = index.build().head()
    assert (counts.indexed, counts.pruned, counts.unchanged) == (0, 0, 7)  # an empty file is tracked, without symbols
    (tree / "src/b.go").write_text(GO.replace("helper", "other"))
    (tree / "README.md").unlink()
    counts = index.update().head()
    assert (counts.indexed, counts.pruned) == (1, 1)
    names = {r.name for r in index.store.table("symbols").collect()}
    assert "other" in names and "helper" not in names and "Title" not in names
    assert index.find_callers("helper").count() == 0


def test_paths(spark):
    paths = ["a/b.tar.gz", ".hidden", "x.", "Makefile", "q.R", "q.PY", "d/.git/x.py", "dist/x.py", "a.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    col = F.col("p")
    got = {r[0]: r[1:] for r in rows.select("p", suffix(col), language_of(col), in_skipped_folder(col), dirname(col), matches_any(col, ["a/*", "*.R"])).collect()}
    assert got["a/b.tar.gz"] == (".gz", None, False, "a", True)
    assert got[".hidden"][:2] == ("", None) and got["x."][0] == "" and got["Makefile"][1] == "make"
    assert got["q.R"][1] == "r" and got["q.PY"][1] is None and got["q.R"][4]
    assert got["d/.git/x.py"][2] and got["dist/x.py"][2] and not got["a.py"][2]
    reasons = dict(rows.select("p", skip_reason(col, col, exclude=["a.py"])).collect())
    assert reasons["a.py"] == "exclude match" and reasons["q.R"] is None


def test_line_ranges(spark):
    text = "\n".join(str(i) for i in range(1, 11))
    got = lambda a, b: spark.createDataFrame([(text,)], "t string").select(line_range(F.col("t"), a, b)).head()[0]
    assert got(3, 5) == "3\n4\n5" and got(-2, 1) == "1" and got(5, 3) == "" and got(9, 99) == "9\n10"


def test_enclosing(spark):
    functions = spark.createDataFrame([(1, "f", 1, 500), (2, "f", 10, 20), (3, "f", 10, 20), (4, "g", 1, 2), (5, "f", 30, 29)], "id bigint, file_path string, start_line int, end_line int")
    sites = spark.createDataFrame([(1, "f", 15), (2, "f", 400), (3, "f", 501), (4, None, 1), (5, "g", None), (1, "f", 15)], "id bigint, file_path string, line int")
    assert sorted((r.id, r.caller_id) for r in graph.enclosing(sites, functions).collect()) == [(1, 2), (1, 2), (2, 1)]


def test_fusion_and_nearest(spark):
    lists = [spark.createDataFrame(x, "id bigint, rank int") for x in ([(1, 0), (2, 1)], [(3, 0), (2, 1)])]
    assert [r.id for r in fusion.fused(lists).collect()] == [2, 1, 3]
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [3.0, 1.0]), (1, [0.0, 1.0])], "symbol_id bigint, embedding array<float>")
    assert [(r.symbol_id, r.distance) for r in vectors.nearest(v, [0.0, 1.0]).collect()] == [(1, 0.0), (2, 0.0), (5, 3.0)]


def test_watch(spark, index, tree, tmp_path):
    from symweave.streaming import watch as w

    events = tmp_path / "events"
    events.mkdir()
    (tree / "src/b.go").write_text(GO.replace("helper", "third"))
    rows = [("src/b.go", "modified", "2024-01-01T00:00:00"), ("src/a.py", "modified", "2024-01-01T00:00:00"), ("src/a.py", "deleted", "2024-01-01T00:00:00"), ("x.bin", "created", "2024-01-01T00:00:00")]
    (events / "1.json").write_text("\n".join(json.dumps({"file_path": str(tree / p), "event": e, "at": t}) for p, e, t in rows))
    stream = w.watch(w.read_events(spark, str(events)), index.refresh, index.store.delete_files, str(tmp_path / "cp"), once=True)
    stream.awaitTermination(120)
    names = {r.name for r in index.store.table("symbols").collect()}
    assert "third" in names and "put" not in names


def test_encoder(spark):
    rows = [(1, "load", "def load():", None), (2, "load", "def load():", None), (3, "save_all", None, "Saves it."), (4, "", None, None)]
    df = vectors.encoded(spark.createDataFrame(rows, "id bigint, name string, signature string, docstring string"), vectors.hashed_encoder(64))
    got = {r.symbol_id: r.embedding for r in df.collect()}
    assert got[1] == got[2] != got[3] and all(len(v) == 64 for v in got.values())
    assert sum(x * x for x in got[3]) == pytest.approx(1, abs=1e-5) and not any(got[4])


def test_deep_nesting(spark):
    """Blocks end where they do, however deep they lie."""
    from symweave.extract.symbols import by_rules

    depths = range(12)
    text = "\n".join([f"{'    ' * d}function f{d}() {{" for d in depths] + ["    " * 12 + "g();"] + [f"{'    ' * d}}}" for d in reversed(depths)])
    files = spark.createDataFrame([("a.js", "javascript", text), ("b.js", "javascript", text.replace("    ", "\t"))], "file_path string, language string, text string")
    got = {(r.file_path, r.name): (r.start_line, r.end_line) for r in by_rules(files).collect()}
    assert got == {(p, f"f{d}"): (d + 1, 25 - d) for p in ("a.js", "b.js") for d in depths}


def test_ignore_rules(spark):
    rules = ignore_rules(["# c", "", "*.log", "!keep.log", "/top.txt", "out/", "a/**/b", "x[0-9].py", "y[!a].py", "doc/*.md", "\\!odd", "!out/saved.py", "sp\\ "])
    paths = {
        "q.log": True, "d/q.log": True, "keep.log": False, "d/keep.log": False, "top.txt": True, "d/top.txt": False, "out/q.py": True, "d/out/q.py": True,
        "out/saved.py": True, "out": False, "a/b": True, "a/x/y/b": True, "a/b/c.py": True, "x1.py": True, "xa.py": False, "yb.py": True, "ya.py": False,
        "doc/a.md": True, "doc/d/a.md": False, "!odd": True, "sp ": True,
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_ignored(F.col("p"), rules)).collect()
    assert dict(tuple(r) for r in rows) == paths
    assert not spark.range(1).select(is_ignored(F.lit("a"), [])).head()[0]


def test_only_what_changed(spark, tmp_path):
    """An update opens the changed files only, and other buckets keep theirs; readers see whole states."""
    from symweave.sources.files import contents

    root = tmp_path / "tree"
    root.mkdir()
    for k in range(12):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    return g{k}()\n")
    index = Index(spark, str(root), str(tmp_path / "index"))
    index.build()
    before, old = index.store.manifest(), index.store.table("symbols")
    (root / "m3.py").write_text("def changed():\n    pass\n")
    one = contents(spark.createDataFrame([(str(root / "m3.py"),), (str(root / "absent.py"),)], "file_path string"))
    assert {Path(r.file_path).name: (r.content is None, r.error is None) for r in one.collect()} == {"m3.py": (False, True), "absent.py": (True, False)}
    assert index.update().head().indexed == 1
    after = index.store.manifest()
    kept = sum(after["symbols"].get(b) == v for b, v in before["symbols"].items())
    assert kept == len(before["symbols"]) - 1
    assert old.count() == 12  # the reader's state is still there
    assert {r.name for r in index.store.table("symbols").collect()} == {f"f{k}" for k in range(12) if k != 3} | {"changed"}
    assert [r.name for r in index.full_text("changed").collect()] == ["changed"] and index.full_text("f3").count() == 0
    (root / "m4.py").write_text("def fresh():\n    pass\n")
    assert index.freshen(str(root / "m4.py")) and not index.freshen(str(root / "m4.py")) and index.get_symbol("fresh").count() == 1
    (root / "m4.py").unlink()
    assert index.freshen(str(root / "m4.py")) and index.get_symbol("fresh").count() == 0
    assert index.store.vacuum(1) > 0 and index.store.vacuum(1) == 0 and index.store.table("symbols").count() == 11


def test_isolated(spark):
    from symweave.streaming.watch import isolated, snapshot_events

    done, failed = [], []

    def apply(files):
        names = [r[0] for r in files.collect()]
        if "bad" in names or "worse" in names:
            raise ValueError
        done.extend(names)

    isolated(spark.createDataFrame([(x,) for x in ["a", "b", "bad", "c", "worse", "d"]], "file_path string"), apply, lambda path, e: failed.append(path))
    assert sorted(done) == ["a", "b", "c", "d"] and sorted(failed) == ["bad", "worse"]
    state = "file_path string, file_size bigint, mtime_ns bigint, checksum string"
    was, is_ = [("a", 1, 1, None), ("b", 1, 1, None), ("c", 1, 1, None)], [("a", 1, 1, None), ("b", 2, 1, None), ("d", 1, 1, None)]
    found = snapshot_events(spark.createDataFrame(was, state), spark.createDataFrame(is_, state)).collect()
    assert {r.file_path: r.event for r in found} == {"b": "modified", "c": "deleted", "d": "created"}


def test_json_array(spark, tmp_path):
    from symweave.operators.lookup import export
    from symweave.schemas import SYMBOLS

    rows = [(k, f"n{k}", "function", f"f{k % 3}", k, k, 's "q"', None, None, None, "go", "c", None) for k in range(50)]
    for name, data in (("some", rows), ("none", [])):
        export(spark.createDataFrame(data, SYMBOLS), str(tmp_path / name), "array")
        text = "\n".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        found = json.loads(text)
        assert [x["start_line"] for x in found] == sorted(range(len(data)), key=lambda k: (k % 3, k))


def test_code_only(spark):
    from symweave.extract.symbols import symbols_and_calls

    js = "function f() {\n  a(1); // b(2)\n  /* c(3)\n d(4) */ e('g(5)', \"h(6)\", `i(7)`);\n}\n"
    rust = "fn k<'a>(x: &'a str) {\n    l('m', \"n(1)\"); // o(2)\n}\n"
    md = "Title\n=====\n\nPart\n---\ntext\n\n```\n# not a heading\n```\n- item\n---\n"
    bad = "class A:\n    def b(self):\n        return (\n"
    rows = [("a.js", "javascript", js), ("b.rs", "rust", rust), ("c.md", "markdown", md), ("d.py", "python", bad)]
    files = spark.createDataFrame([(*r, "sum") for r in rows], "file_path string, language string, text string, checksum string")
    symbols, calls, errors = symbols_and_calls(files)
    assert sorted((r.file_path, r.callee_name) for r in calls.collect()) == [("a.js", "a"), ("a.js", "e"), ("b.rs", "l")]
    assert sorted((r.file_path, r.name, r.kind) for r in symbols.collect()) == [
        ("a.js", "f", "function"), ("b.rs", "k", "function"), ("c.md", "Part", "section"), ("c.md", "Title", "section"), ("d.py", "A", "class"), ("d.py", "b", "method"),
    ]
    assert [r.file_path for r in errors.collect()] == ["d.py"]


def test_scan(spark, tmp_path):
    """Names that begin with an underscore or a dot are listed, folders never entered aren't, however wide or deep the tree is."""
    from symweave.sources.files import scan

    names = ["__init__.py", ".env", "a b.py", "_x/y.py", "src/deep/er/and/er/z.py", *(f"d{k}/e/f{k}.py" for k in range(9))]
    for name in [*names, "node_modules/x.js", ".git/y", "src/__pycache__/z.pyc"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "__init__.py" else "x")
    for tasks in (1, 4, 64):
        rows = scan(spark, str(tmp_path), tasks).collect()
        assert sorted(r.file_path for r in rows) == sorted(str(tmp_path / n) for n in names)
    assert {r.file_path.rsplit("/", 1)[1]: r.file_size for r in rows}["__init__.py"] == 0
    assert all(r.mtime_ns == (Path(r.file_path)).stat().st_mtime_ns for r in rows)
