"""Additive quantisation of vectors: residual codebooks, beam-search encoding, table scoring.

A vector is approximated by a sum of one entry of each of several full-dimensional codebooks.
The first codebook is the cells of the index; each further one is trained on what the ones before
have left. Scores need only the inner products of a query with the entries and the stored norm of
each approximation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms, double = (centres * centres).sum(1), np.ascontiguousarray(-2 * centres.T)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 1024):
        far = x[a : a + 1024] @ double
        far += norms
        out[a : a + 1024] = far.argmin(1)
    return out


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each of ``k`` clusters."""
    out = np.zeros((k, x.shape[1]), x.dtype)
    if k > 64:
        order, end = np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=k))
        for c, (a, b) in enumerate(zip(np.r_[0, end[:-1]], end)):
            x[order[a:b]].sum(0, out=out[c])
        return out
    for a in range(0, len(x), 1024):
        part = at[a : a + 1024]
        member = np.zeros((k, len(part)), x.dtype)
        member[part, np.arange(len(part))] = 1
        out += member @ x[a : a + 1024]
    return out


def spread_start(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` rows as first centres: each next batch is drawn in proportion to the squared distance from those before."""
    centres = [x[random.choice(len(x), 1)]]
    left = ((x - centres[0]) ** 2).sum(1)
    own = (x * x).sum(1)
    n = 1
    while n < k and left.sum() > 0:
        some = np.unique(random.choice(len(x), min(k - n, max(8, n // 2)), p=left / left.sum()))
        new = x[some]
        far = (own[:, None] + (new * new).sum(1) - 2 * x @ new.T).min(1)
        left = np.minimum(left, np.maximum(far, 0))
        left[some] = 0
        centres.append(new)
        n += len(new)
    return np.concatenate(centres)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 0, spread: bool = False) -> np.ndarray:
    """Centres of ``k`` clusters, or of fewer if there are fewer rows."""
    random = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = spread_start(x, k, random) if spread else x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        held = np.flatnonzero(n)
        centres[held] = _sums(x, at, len(centres))[held] / n[held, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[random.choice(len(x), len(empty))]
    return centres


@dataclass
class Codebooks:
    """The coarse cells, the regions they lie in, and the residual codebooks.

    A cell is named by the first ``1 + depth`` places of the code: the coarse cell and entries of
    the first ``depth`` codebooks. So the number of cells can grow with the data while the sample
    that they are learnt from doesn't.
    """

    cells: np.ndarray  # k0 x d
    books: np.ndarray  # levels x k x d
    depth: int
    first_region: np.ndarray  # k0, the first region of each coarse cell
    parts: np.ndarray  # k0, in how many regions it is cut
    place: np.ndarray  # k, the place of each entry of the first codebooks along their main axis
    tasks: np.ndarray | None = None  # in how many tasks the queries of each region are answered

    def prepare(self) -> None:
        levels, k, d = self.books.shape
        flat = self.books.reshape(levels * k, d)
        self.cell_norms = (self.cells**2).sum(1)
        self.book_norms = (flat**2).sum(1).reshape(levels, k)
        self.book_gram = (flat @ flat.T).reshape(levels, k, levels, k)
        self.cell_gram = (self.cells @ flat.T).reshape(len(self.cells), levels, k)

    @property
    def regions(self) -> int:
        return int((self.first_region + self.parts).max())

    def coarse(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest coarse cells of each row, nearest first."""
        score = x @ self.cells.T
        score *= -2
        score += self.cell_norms
        n = min(n, score.shape[1])
        if n <= 8:  # so few are found sooner one after the other
            top, rows = np.empty((len(x), n), np.intp), np.arange(len(x))
            for place in range(n):
                top[:, place] = score.argmin(1)
                score[rows, top[:, place]] = np.inf
            return top
        top = np.argpartition(score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(x), 1))
        order = np.argsort(np.take_along_axis(score, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)

    def names(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the region of the cells with these codes (last axis: coarse cell, entries)."""
        k = self.books.shape[1]
        number, at = prefix[..., 0].astype(np.int64), np.zeros(prefix.shape[:-1], np.int64)
        for level in range(self.depth):
            number = number * k + prefix[..., 1 + level]
            at = at * k + self.place[level][prefix[..., 1 + level]]
        region = self.first_region[prefix[..., 0]] + at * self.parts[prefix[..., 0]] // k**self.depth
        return number, region

    def encode(self, x: np.ndarray, beam: int, spill: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes (coarse cell, then one entry per level), squared norms of the approximations, and the
        codes of the ``spill`` nearest cells with their squared distances, nearest first.

        The beam begins with the nearest coarse cells and keeps the ``beam`` best partial sums; the
        error of a partial sum s is |s|^2 - 2 x.s, up to |x|^2.
        """
        n, levels, k = len(x), *self.books.shape[:2]
        inner = (x @ self.books.reshape(levels * k, -1).T).reshape(n, levels, k)
        wide = max(beam, spill)
        starts = self.coarse(x, wide)
        rows = np.arange(n)[:, None]
        dot = np.einsum("nd,nbd->nb", x, self.cells[starts])
        norm = self.cell_norms[starts]
        codes = starts[:, :, None]
        own = (x * x).sum(1)[:, None]
        for level in range(levels + 1):
            if level == self.depth:
                error = norm - 2 * dot
                order = np.argsort(error, axis=1, kind="stable")
                near = codes[rows, order[:, :spill]]
                distance = np.maximum(np.take_along_axis(error, order[:, :spill], 1) + own, 0)
                codes, norm, dot = codes[rows, order[:, :beam]], np.take_along_axis(norm, order[:, :beam], 1), np.take_along_axis(dot, order[:, :beam], 1)
            if level == levels:
                break
            cross = self.cell_gram[codes[:, :, 0], level]
            for before in range(level):
                cross = cross + self.book_gram[before, codes[:, :, 1 + before], level]
            norms = norm[:, :, None] + self.book_norms[level] + 2 * cross
            dots = dot[:, :, None] + inner[:, None, level]
            error = (norms - 2 * dots).reshape(n, -1)
            keep = min(beam if level >= self.depth else wide, error.shape[1])
            best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
            from_, to = best // k, best % k
            codes = np.concatenate([codes[rows, from_], to[:, :, None]], axis=2)
            norm = np.take_along_axis(norms.reshape(n, -1), best, 1)
            dot = np.take_along_axis(dots.reshape(n, -1), best, 1)
        won = (norm - 2 * dot).argmin(1)
        return codes[np.arange(n), won], norm[np.arange(n), won].astype(np.float32), near, distance


def train(
    sample: np.ndarray, cells: int, *, levels: int, entries: int, depth: int = 0, rows: int | None = None, region_rows: int | None = None, seed: int = 0
) -> Codebooks:
    """Codebooks from a sample of ``rows`` rows, with regions of about ``region_rows``.

    Cells that hold very much of the sample are split again, so that no cell holds a large share. Where
    a region holds more than twice ``region_rows`` all the same, several tasks share its queries.
    """
    rows, region_rows = rows or len(sample), region_rows or rows or len(sample)
    centres = kmeans(sample, cells, rounds=4, seed=seed, spread=True)
    most = max(16, 20 * len(sample) // max(1, len(centres)))
    for again in range(4):
        at = _nearest(sample, centres)
        n = np.bincount(at, minlength=len(centres))
        full = np.flatnonzero(n > most)
        if not len(full):
            break
        parts = [kmeans(sample[at == c], -(-int(n[c]) // most) + 1, seed=seed + again) for c in full]
        centres = np.concatenate([np.delete(centres, full, axis=0), *parts])
    else:
        at = _nearest(sample, centres)
    left, books, prefix = sample - centres[at], [], [at]
    for level in range(levels):
        book = np.zeros((entries, sample.shape[1]), np.float32)
        got = kmeans(left, entries, seed=seed + level)
        book[: len(got)] = got
        prefix.append(_nearest(left, book))
        left = left - book[prefix[-1]]
        books.append(book)
    share = np.bincount(at, minlength=len(centres)) / len(sample)
    parts = np.clip(np.ceil(share * rows / region_rows), 1, entries**depth).astype(np.int64)
    whole = np.flatnonzero(parts == 1)
    region = np.zeros(len(centres), np.int64)
    regions = 0
    if len(whole):
        wanted = max(1, round(share[whole].sum() * rows / region_rows))
        region[whole] = _balanced(centres[whole], share[whole] + 1e-9, min(wanted, len(whole)))
        regions = int(region[whole].max()) + 1
    for c in np.flatnonzero(parts > 1):
        region[c], regions = regions, regions + int(parts[c])
    place = np.stack([_along(b) for b in books[:depth]]) if depth else np.zeros((0, entries), np.int64)
    found = Codebooks(centres.astype(np.float32), np.stack(books), depth, region, parts, place)
    found.prepare()
    held = np.bincount(found.names(np.stack(prefix, axis=1))[1], minlength=found.regions) * (rows / len(sample))
    found.tasks = np.maximum(1, np.ceil(held / (2 * region_rows))).astype(np.int64)
    return found


def _axis(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    axis = np.random.default_rng(0).normal(size=x.shape[1])
    for _ in range(12):
        axis = x.T @ (weight * (x @ axis))
        axis /= np.linalg.norm(axis) + 1e-30
    return axis


def _along(book: np.ndarray) -> np.ndarray:
    """The place of each entry in the order along the main axis."""
    x = book - book.mean(0)
    return np.argsort(np.argsort(x @ _axis(x, np.ones(len(x))), kind="stable"), kind="stable")


def _balanced(centres: np.ndarray, weight: np.ndarray, regions: int) -> np.ndarray:
    """A region for each cell: halves along the main axis, again and again, of equal weight."""
    out = np.zeros(len(centres), np.int64)
    groups = [np.arange(len(centres))]
    while len(groups) < regions:
        groups.sort(key=lambda g: -weight[g].sum() if len(g) > 1 else 0.0)
        if len(groups[0]) < 2:
            break
        g = groups.pop(0)
        x = centres[g] - np.average(centres[g], axis=0, weights=weight[g])
        order = np.argsort(x @ _axis(x, weight[g]), kind="stable")
        cut = int(np.searchsorted(np.cumsum(weight[g][order]), weight[g].sum() / 2))
        cut = min(max(1, cut), len(g) - 1)
        groups += [g[order[:cut]], g[order[cut:]]]
    for k, g in enumerate(groups):
        out[g] = k
    return out


def search(
    books: Codebooks, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, n: int
) -> np.ndarray:
    """Places in ``codes`` of the ``n`` best scores of each query, by table lookup."""
    if n >= len(codes):
        return np.tile(np.arange(len(codes)), (len(queries), 1))
    used, at = np.unique(codes[:, 0], return_inverse=True)
    double = -2 * queries.T
    tables = [books.cells[used] @ double] + [book @ double for book in books.books]
    places = np.ascontiguousarray(codes.T, dtype=np.intp)
    places[0] = at
    scores = np.empty((len(queries), len(codes)), np.float32)
    rows = max(64, 32768 // len(queries))  # sums and looked up values of so many codes stay in the cache
    sums, part = np.empty((2, min(rows, len(codes)), len(queries)), np.float32)
    for a in range(0, len(codes), rows):
        b = min(a + rows, len(codes))
        into, found = sums[: b - a], part[: b - a]
        np.take(tables[0], places[0, a:b], axis=0, out=into, mode="clip")
        into += norms[a:b, None]
        for table, place in zip(tables[1:], places[1:]):
            into += np.take(table, place[a:b], axis=0, out=found, mode="clip")
        scores[:, a:b] = into.T
    return least(scores, n)


def least(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` smallest numbers of each row, in any order."""
    within = scores <= np.partition(scores, n - 1, axis=1)[:, n - 1 : n]
    clear = np.count_nonzero(within, axis=1) == n  # no more of them are equal, nor is any no number
    if clear.all():
        return np.flatnonzero(within).reshape(-1, n) - np.arange(len(scores))[:, None] * scores.shape[1]
    out = np.empty((len(scores), n), np.intp)
    for row, mine, into in zip(scores, within, out):
        at = np.flatnonzero(mine)
        if len(at) > n:  # as many as needed of those equal to the last
            equal = row[at] == row[at].max()
            at = np.r_[at[~equal], at[equal][: n - np.count_nonzero(~equal)]]
        into[:] = at if len(at) == n else np.argpartition(row, n - 1)[:n]
    return out
