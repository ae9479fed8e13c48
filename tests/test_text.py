import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.functions import text as t
from symweave.operators import fulltext


def fts(rows, tokenizer="porter unicode61"):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table x using fts5(name, doc, tokenize='{tokenizer}')")
    db.executemany("insert into x(rowid, name, doc) values (?, ?, ?)", rows)
    return db


def test_stems_are_those_of_the_independent_index():
    words = """relational conditional rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization
    predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize
    electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement
    adjustment dependent adoption homologou communism activate angularity homologous effective bowdlerize probate rate cease controll roll
    caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing
    filing happy sky handlers restoring writers broken serialization""".split()
    stems = {}
    for word in words:
        db = fts([(1, word, "")])
        db.execute("create virtual table v using fts5vocab(x, 'row')")
        stems[word] = db.execute("select term from v").fetchone()[0]
    assert {w: t.porter(w) for w in words} == stems


@given(st.text(alphabet="aeiouybdlsztngr", min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_stems_are_never_longer(word):
    assert 0 < len(t.porter(word)) <= len(word) + 1


ROWS = [
    (1, "get_user_login", "Handles the login of users, handler included"),
    (2, "Élan vital", "élan and handlers; login login"),
    (3, "getUser", None),
    (4, "", "nothing here"),
    (5, "user", "user user handler"),
]


@pytest.mark.parametrize("query", ["user", "handler login", "elan", "handlers", "nothing", "absent", "user login"])
def test_scores_are_those_of_the_independent_index(spark, query):
    db = fts([(i, n or "", d or "") for i, n, d in ROWS])
    want = db.execute("select rowid, -rank from x where x match ? order by rank, rowid", (" ".join(query.split()),)).fetchall()
    tokens = fulltext.tokenized(spark.createDataFrame(ROWS, "id bigint, name string, doc string"), "id", ["name", "doc"])
    got = [(r.id, r.score) for r in fulltext.match(tokens, query).collect()]
    assert dict(got) == pytest.approx(dict(want), abs=1e-6)
    tables = fulltext.postings(tokens), fulltext.row_lengths(tokens)
    assert {r.id: r.score for r in fulltext.match_postings(*tables, fulltext.query_phrases(query)).collect()} == pytest.approx(dict(got))


def test_phrase_prefix_column_any(spark):
    tokens = fulltext.tokenized(spark.createDataFrame(ROWS, "id bigint, name string, doc string"), "id", ["name", "doc"], stem=False)
    ids = lambda **o: sorted(r.id for r in fulltext.search(tokens, **o).collect())
    assert ids(phrases=[["user", "login"]]) == [1]
    assert ids(phrases=[["handl"]], prefix=True) == [1, 2, 5]
    assert ids(phrases=[["user"]], field="name") == [1, 5]
    assert ids(phrases=[["vital"], ["nothing"]], any_of=True) == [2, 4]
    assert ids(phrases=[]) == [] and ids(phrases=[[]]) == []


def test_like_folds_ascii_only(spark):
    rows = spark.createDataFrame([("Order",), ("É",), ("a\\b",), ("a%b",), (None,)], "v string")
    found = lambda q: [r.v for r in rows.where(t.like_ascii(rows.v, q)).collect()]
    assert found("ORD") == ["Order"] and found("é") == [] and found("\\") == ["a\\b"] and found("r_e") == ["Order"]
