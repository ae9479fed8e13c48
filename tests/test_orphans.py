import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from symweave.operators.orphans import orphan_calls, orphans, reference

START = datetime(2024, 1, 1)
CALLS = "id bigint, caller_id bigint, callee_name string, indexed_at timestamp_ntz, callee string"
SYMBOLS = "id bigint, name string, indexed_at timestamp_ntz, field string"
EXTERNALS = "name string, language string"


def at(hours):
    return START + timedelta(hours=hours)


def brute(calls, symbols, externals):
    out = set()
    known = {n for n, _ in externals}
    for id_, caller, callee, when, *_ in calls:
        before = [s for s in symbols if when is not None and s[2] is not None and s[2] <= when]
        if caller is not None and not any(s[0] == caller for s in before):
            out.add((id_, "caller_id"))
        name = (callee or "").strip(" \t")
        if name and not (when is not None and name in known) and not any(s[1] == name for s in before):
            out.add((id_, "callee_name"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "ä", "A", " padded", "", "x" * 5000, None, "ext"]
    calls = [
        (i // 2, r.choice([None, *range(12)]), r.choice(["a", " a\t", "b", "ä", "A", "nowhere", "", "  ", None, "ext", "x" * 5000]),
         r.choice([None, at(r.randint(0, 50))]), "clash")
        for i in range(300)
    ]
    symbols = [(r.choice([None, *range(10)]), r.choice(names), r.choice([None, at(r.randint(0, 50))]), "clash") for _ in range(60)]
    externals = [("ext", None), ("ext", "go"), (None, "c")]
    found = orphan_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(externals, EXTERNALS))
    assert {(x.call_id, x.field) for x in found.collect()} == brute(calls, symbols, externals)


def test_hot_key_in_small_chunks(spark):
    refs = spark.range(5000).select(reference("f", F.col("id"), F.lit(7), F.lit(at(1)), named=False))
    parents = spark.range(100).select(reference("f", F.lit(None), F.col("id"), F.lit(at(2)), named=False))
    assert orphans(refs, parents, range_rows=10, chunk_rows=300).count() == 5000
    early = spark.range(100).select(reference("f", F.lit(None), F.col("id"), F.lit(at(0)), named=False))
    assert orphans(refs, early, range_rows=10, chunk_rows=300).count() == 0


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (CALLS, SYMBOLS, EXTERNALS)]
    assert orphan_calls(*none).count() == 0
    calls = spark.createDataFrame([(1, 2, "n", at(1), "")], CALLS)
    assert orphan_calls(calls, *none[1:]).count() == 2
