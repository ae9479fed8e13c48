from datetime import datetime

import pytest

from symweave.llm.docpairs import pairs, parameter_types, tells

ROW = "id bigint, name string, kind string, file_path string, signature string, docstring string, parent_name string, language string, indexed_at timestamp_ntz, description string"
NOW = datetime(2024, 1, 1)

YES = [
    ("Ignores case.", "find", "def find(x):"),
    ("/**\n * @deprecated\n * Never blocks.\n * @param x the x\n */", "take", "take(x) {"),
    ("Stub entries are removed too, so that the registry never sees one.", "sweep", "fn sweep() {"),
    ("Todo lists older than six days are merged.", "merge_plan", "def merge_plan():"),
    ("<p>Merge the plan. Blocks until all readers are closed.</p>", "merge_plan", "def merge_plan():"),
    ("/// Sortiert die Namen und verwirft spätere Werte.", "run", "fn run()"),
    ("Calling it twice does no harm.", "close", "def close():"),
    ("/**\n * @brief Reads ahead and checks the length.\n * @param x the x\n */", "take", "take(x) {"),
    ("@return null if there are none", "take", "take(x) {"),
    (":param x: the x\n:returns: the longest of them, or nothing", "take", "def take(x):"),
    ("Возвращает самую длинную строку.", "take", "def take(x):"),
]
NO = [
    (None, "f", "def f():"),
    (" \t\n", "f", "def f():"),
    ("TODO", "f", "def f():"),
    ("/**\n * Merges the plan using the given size.\n */", "merge_plan", "def merge_plan(size):"),
    ("This function renders the order.", "renderOrder", "function renderOrder() {"),
    ("// Parameters\n// ----------\n// rows\n// path", "f", "def f(a):"),
    (":param a: the a\n:return:\n:rtype: int", "f", "def f(a):"),
    ("@param size the size to use", "f", "def f(size):"),
    ("No docs yet, sorry. Ask the team.", "f", "def f():"),
    ("Wird noch beschrieben, sobald jemand Zeit hat.", "f", "def f():"),
    ("Pendiente de describir.", "f", "def f():"),
    ("See base class.", "f", "def f():"),
    ("{@inheritDoc}", "f", "def f():"),
    ("n/a", "f", "def f():"),
    ('<a href="#f"></a>', "f", "def f():"),
    ("def load_rows(path)", "load_rows", "def load_rows(path):"),
    ("***", "f", "def f():"),
]


@pytest.mark.parametrize("case", YES)
def test_tells(case):
    assert tells(*case)


@pytest.mark.parametrize("case", NO)
def test_tells_nothing(case):
    assert not tells(*case)


def test_long_text_is_read_to_its_end():
    assert tells("TODO\n" * 20_000 + "Never blocks.", "f", "def f():")


def test_pairs(spark):
    def row(i, name, doc, kind=" Function ", signature="int f(int a, char b) {", path="src/f.c", at=NOW):
        return (i, name, kind, path, signature, doc, None, "c", at, "clash")

    rows = [
        row(1, "f", "Never blocks.", path="include/f.h", signature="int f(int x, char y);"),
        row(2, "f", None),  # the definition of 1, with other parameter names
        row(3, "f", "TODO", signature="int f(int a) {"),  # an overload without documentation
        row(4, "g", "Never blocks.", signature=" "),
        row(5, "h", "Never blocks.", kind="class"),
        row(6, "k", "Never blocks."),
        row(6, "k", "TODO", at=NOW.replace(year=2025)),  # the current row tells nothing
        row(7, "m", "Never blocks.", kind="METHOD"),
        row(7, "m", "Never blocks.", kind="METHOD"),
        row(None, "n", "Never blocks."),
        row(8, None, "Never blocks."),
        row(9, "p", "Never blocks.", signature=None),
    ]
    got = sorted((r.id, r.documented_id) for r in pairs(spark.createDataFrame(rows, ROW)).collect())
    assert got == [(1, 1), (2, 1), (7, 7), (8, 8)]
    assert pairs(spark.createDataFrame([], ROW)).count() == 0


@pytest.mark.parametrize(
    ("signature", "name", "language", "types"),
    [
        ("int f(int a, char b) {", "f", "c", "int,char"),
        ("int f(int, char *);", "f", "c", "int,char*"),
        ("void f(void)", "f", "c", ""),
        ("int f(unsigned n, char b[8])", "f", "c", "unsigned,char[8]"),
        ("void put(Map<String, List<Integer>> m, int k) {", "put", "java", "Map<String,List<Integer>>,int"),
        ("void put(final @Nullable String s)", "put", "java", "String"),
        ("template <class A, class B> B fold(std::function<B(A, B)> f, B start = B(1, 2))", "fold", "cpp", "std::function<B(A,B)>,B"),
        ("def f(self, a: dict[str, int] = {}, *args, b=(1, 2)) -> int:", "f", "python", "dict[str,int],?,?"),
        ("on(name: string, then: (a: number, b: number) => void, last = \",)\"): void", "on", "typescript", "string,(a:number,b:number)=>void,?"),
        ("func (b *Box) Fill(n int, s []string) error {", "Fill", "go", "int,[]string"),
        ("fn run(&mut self, f: impl Fn(u8, u8) -> u8)", "run", "rust", "impl Fn(u8,u8)->u8"),
        ("func f(", "f", "go", ""),
        (None, "f", "go", ""),
        ("x = 3", None, None, ""),
    ],
)
def test_parameter_types(signature, name, language, types):
    assert parameter_types(signature, name, language) == types


def test_overloads_templates_and_headers(spark):
    def row(i, name, signature, doc, path, parent=None):
        return (i, name, "method", path, signature, doc, parent, "cpp", NOW, "")

    rows = [
        row(1, "put", "void put(std::map<int, int> m, int k);", "Never blocks.", "C:\\p\\include\\box.hpp", "Box"),
        row(2, "put", "void put(int k);", "Fails on zero keys.", "C:\\p\\include\\box.hpp", "Box"),
        row(3, "put", "void put();", "TODO", "C:\\p\\include\\box.hpp", "Box"),
        row(4, "Box<T>::put", "void Box<T>::put(std::map<int, int> other, int at) {", None, "/p/./src//box.cpp"),
        row(5, "Box::put", "void Box::put(int key) {", " ", "/p/src/box.cpp"),
        row(6, "Box::put", "void Box::put() {", None, "/p/src/box.cpp"),
        row(7, "put", "void put(int k) {", None, "/p/src/box.cpp", "Other"),
        row(8, "Box::put", "void Box::put(int key) {", "n/a", "/q/src/box.cpp"),
    ]
    rows += [row(100 + i, "copy", "void copy(int k) {", None, "/p/src/copy.cpp") for i in range(300)]  # a hot name
    rows += [row(99, "copy", "void copy(int k);", "Keeps the older one.", "/p/src/copy.h")]
    got = {r.id: (r.documented_id, r.description) for r in pairs(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {1: (1, "Never blocks."), 2: (2, "Fails on zero keys."), 4: (1, "Never blocks."), 5: (2, "Fails on zero keys."), 99: (99, "Keeps the older one.")} | {
        100 + i: (99, "Keeps the older one.") for i in range(300)
    }
