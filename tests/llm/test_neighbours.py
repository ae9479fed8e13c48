import numpy as np
import pyarrow as pa
import pytest

from symweave.llm import additive
from symweave.llm.neighbours import _blocks, nearest, pack, pairs, unpack

ROW = "id bigint, embedding array<float>, h string"


def brute(rows, width, k):
    good = {i: np.array(v, np.float64) for i, v, _ in rows if i is not None and v is not None and len(v) == width and None not in v and np.isfinite(v).all() and any(v)}
    out = set()
    for i, v in good.items():
        near = sorted((((v - w) ** 2).sum(), j) for j, w in good.items() if j != i)[:k]
        out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def found(spark, rows, width, k, **options):
    df = pairs(nearest(spark.createDataFrame(rows, ROW), width=width, k=k, **options))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def vectors(n, width, seed, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    return [[float(np.float32(x)) for x in np.round((centres[i % groups] + 0.3 * r.normal(size=width)) * 64) / 64] for i in range(n)]


def test_exact_on_small_data_with_dirt(spark):
    v = vectors(120, 8, 1)
    rows = [(i, x, "clash") for i, x in enumerate(v)]
    rows += rows[:5]  # exact repeats
    rows += [(500 + i, v[3], None) for i in range(15)] + [(600, v[4], "")]  # equal vectors of several ids
    rows += [(700, None, ""), (701, [0.0] * 8, ""), (702, [float("nan")] + [1.0] * 7, ""), (703, [1.0] * 7, ""), (704, [float("inf")] * 8, ""), (None, v[0], ""), (705, [], "")]
    assert found(spark, rows, 8, 4) == brute(rows, 8, 4)


def test_recall_in_many_cells(spark):
    rows = [(i, x, "") for i, x in enumerate(vectors(1500, 16, 2, groups=40))]
    got = found(spark, rows, 16, 5, cell_rows=60, region_rows=300, shortlist=60, levels=4, entries=16)
    want = brute(rows, 16, 5)
    assert len(got & want) >= 0.95 * len(want)


def test_hot_group_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], "") for i in range(400)] + [(1000 + i, x, "") for i, x in enumerate(vectors(100, 4, 3))]
    assert found(spark, rows, 4, 3) == brute(rows, 4, 3)


@pytest.mark.parametrize("rows", [[], [(1, None, "")], [(1, [1.0, 0.0], "")]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows, 2, 10) == set()


def test_codes_and_packing():
    x = np.random.default_rng(0).normal(size=(300, 12)).astype(np.float32)
    assert (unpack(pack(x), 300, 12) == x).all()
    books = additive.train(x, 10, levels=3, entries=8)
    codes, norms, near, far = books.encode(x, 3, 3)
    sums = books.cells[codes[:, 0]] + sum(books.books[m][codes[:, 1 + m]] for m in range(3))
    assert np.allclose((sums**2).sum(1), norms, rtol=1e-3, atol=1e-3)
    assert np.allclose(((x - books.cells[near[:, 0, 0]]) ** 2).sum(1), far[:, 0], rtol=1e-3, atol=1e-3) and (np.diff(far, axis=1) >= 0).all()
    greedy = books.encode(x, 1)[0]
    other = books.cells[greedy[:, 0]] + sum(books.books[m][greedy[:, 1 + m]] for m in range(3))
    assert ((x - sums) ** 2).sum() <= ((x - other) ** 2).sum()
    scores = norms[:, None] - 2 * sums @ x[:5].T
    picked = additive.search(books, x[:5], codes, norms, 7)
    assert all(set(picked[q]) == set(np.argsort(scores[:, q])[:7]) for q in range(5))


def test_cells_of_two_levels(spark):
    """With few sample rows the cells go on with the code, and the regions cut coarse cells."""
    rows = [(i, x, "") for i, x in enumerate(vectors(3000, 16, 4, groups=30))]
    options = dict(cell_rows=5, region_rows=100, shortlist=120, levels=4, entries=8, sample_rows=300, spill=4)
    got, want = found(spark, rows, 16, 5, **options), brute(rows, 16, 5)
    assert len(got & want) >= 0.9 * len(want)


def test_names_of_cells():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    books = additive.train(x, 4, levels=3, entries=4, depth=2, rows=500, region_rows=20)
    _, _, near, far = books.encode(x, 2, 3)
    number, region = books.names(near)
    assert near.shape == (500, 3, 3) and number.max() < 4 * 16 and 20 <= books.regions and region.max() < books.regions
    sums = books.cells[near[..., 0]] + books.books[0][near[..., 1]] + books.books[1][near[..., 2]]
    assert np.allclose(((x[:, None] - sums) ** 2).sum(-1), far, rtol=1e-3, atol=1e-3)
    pairs_ = {(int(n), int(r)) for n, r in zip(number.ravel(), region.ravel())}
    assert len(pairs_) == len({n for n, _ in pairs_})  # a cell lies in one region
    assert np.bincount(region[:, 0]).max() < 200


def test_sample_of_few_usable_rows(spark):
    """Repeats and unusable vectors neither starve nor swell the sample."""
    v = vectors(60, 4, 5)
    rows = [(i, x, "") for i, x in enumerate(v)] + [(7, v[7], "")] * 800 + [(1000 + i, [0.0] * 4, "") for i in range(800)]
    assert found(spark, rows, 4, 3, sample_rows=40) == brute(rows, 4, 3)


def test_places_of_the_least():
    """Equal numbers and what is no number don't change how many places come."""
    scores = np.random.default_rng(0).normal(size=(4, 50)).astype(np.float32)
    scores[1, :30] = -9.0
    scores[2] = np.nan
    scores[2, 7:9] = 1.0
    got = additive.least(scores, 5)
    assert got.shape == (4, 5) and all(len(set(row)) == 5 for row in got.tolist())
    assert all(set(got[q]) == set(np.argsort(scores[q])[:5]) for q in (0, 3)) and got[1].max() < 30 and {7, 8} <= set(got[2])


def test_vectors_are_dealt_in_large_lots():
    """Many regions don't make rows of a vector or two, and each vector goes once to each of its regions."""
    x = np.random.default_rng(1).normal(size=(9000, 8)).astype(np.float32)
    books = additive.train(x[:3000], 100, levels=2, entries=8, depth=1, rows=90_000, region_rows=100)
    lists = pa.ListArray.from_arrays(np.arange(0, 8 * 9000 + 1, 8, dtype=np.int32), x.ravel())
    whole = pa.record_batch([pa.array(range(9000)), pa.array(range(9000)), lists], ["id", "h", "embedding"])
    got = list(_blocks(books, 8, 3, 2, 1.4)(whole.slice(a, 900) for a in range(0, 9000, 900)))
    regions = [(r["region"], r["part"]) for b in got for r in b.to_pylist()]
    assert books.regions > 100 and len(regions) == len(set(regions))
    sent = [(r["region"], r["part"], i) for b in got for r in b.to_pylist() for i in np.frombuffer(r["ids"], np.int64)]
    assert len(sent) == len(set(sent)) and {i for *_, i in sent} == set(range(9000))


def test_queries_of_a_full_region_are_shared(spark):
    """A region that can't be cut is answered in several tasks, with the same neighbours."""
    x = np.round(np.random.default_rng(2).normal(size=(2000, 8)) * 64).astype(np.float32) / 64
    x[200:] = x[200:] * 0.125 + 4  # nine tenths lie in one cell
    books = additive.train(x, 2, levels=3, entries=8, rows=2000, region_rows=300)
    held = np.bincount(books.names(books.encode(x, 2, 1)[2])[1][:, 0], minlength=books.regions)
    assert len(books.tasks) == books.regions and books.tasks.max() >= 3 and (held / books.tasks).max() <= 700
    rows = [(i, v, "") for i, v in enumerate(x[::2].tolist())]
    assert found(spark, rows, 8, 5, cell_rows=500, region_rows=50, shortlist=900) == brute(rows, 8, 5)
