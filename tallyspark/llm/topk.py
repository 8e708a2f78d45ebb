"""Exact top-k by integer inner product, by aggregation of sorted lists without random access."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame

from tallyspark.llm.scratch import written
from tallyspark.llm.vectors import CANDIDATES, QUERIES, Part, against_all, best, packed, top_places, usable

#: A list is read in so many steps; at each turn so large a part of the lists, those of the widest unread range, goes a step further.
STEPS, TURN = 8, 4
LONG = 1 << 63


def integers(cells: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as Python's integers where they may not fit 64 bits."""
    whole = np.floor(scale * cells)
    if not whole.size or np.abs(whole).max() < 1 << 62:
        return whole.astype(np.int64)
    return np.array([int(v) for v in whole.ravel()], dtype=object).reshape(whole.shape)


def sorted_lists(scale: float):
    """The index of a block: for each dimension the places of its rows in order of their components."""

    def index(cells: np.ndarray) -> bytes:
        return np.argsort(integers(cells, scale), axis=0, kind="stable").T.astype("<u2").tobytes()

    return index


def exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """A type that holds all sums of products and all differences of them, which reach twice as far: doubles where they stay whole numbers, else 64 bits, else Python's integers."""
    most = x.shape[1] * max(1, int(np.abs(x).max())) * max(1, int(np.abs(q).max()))
    return np.float64 if most < 1 << 52 else np.int64 if most < 1 << 61 else object


class Reader:
    """The sorted lists of a block, read for all queries of a block of queries at once: as far from the one end of a list as from the other, so that each query meets its better entries first."""

    def __init__(self, x: np.ndarray, places: np.ndarray, queries: np.ndarray):
        self.x, self.places, self.n = x, places, len(x)
        self.queries, self.up, self.down = queries, np.maximum(queries, 0), np.minimum(queries, 0)
        self.first, self.last = self.entries(np.zeros(x.shape[1], dtype=np.int64)), self.entries(np.full(x.shape[1], self.n - 1))
        self.high, self.low = self.last.copy(), self.first.copy()  # the entries that come next from above and from below
        self.depth = np.zeros(x.shape[1], dtype=np.int64)
        self.rank = np.empty(x.shape, dtype=np.int64)
        np.put_along_axis(self.rank, places.T.astype(np.int64), np.arange(self.n)[:, None], axis=0)
        self.read = 0

    def entries(self, at: np.ndarray) -> np.ndarray:
        d = np.arange(self.x.shape[1])
        return self.x[self.places[d, at], d]

    def most(self) -> np.ndarray:
        """For each query the most that a row may score of which nothing is seen."""
        return self.up @ self.high + self.down @ self.low

    def on(self, asked: np.ndarray) -> bool:
        """Reads on, in the lists whose unread range is widest for the queries asked, until half of that range is left; whether there was anything to read."""
        up, down, step = self.up[asked].sum(axis=0), -self.down[asked].sum(axis=0), -(-self.n // STEPS)
        used, start, any_read = (self.queries[asked] != 0).sum(axis=0), None, False
        while True:
            width = up * (self.high - self.first) + down * (self.last - self.low)
            left = np.flatnonzero((self.depth < self.n) & (used > 0))
            start = width.sum() if start is None else start
            if not len(left) or any_read and 2 * width.sum() <= start:
                return any_read
            turn = left[np.argsort(-width[left], kind="stable")][: max(1, len(width) // TURN)]
            was = self.depth[turn]
            self.depth[turn] = np.minimum(self.n, was + step)
            self.read += int(((self.depth[turn] - was) * used[turn]).sum())
            done = self.depth == self.n
            inside = np.minimum(self.depth, self.n - 1)
            self.high, self.low = np.where(done, self.first, self.entries(self.n - 1 - inside)), np.where(done, self.last, self.entries(inside))
            any_read = True

    def bounds(self, asked: np.ndarray, rows: np.ndarray, above: bool) -> np.ndarray:
        """A bound of the score of each row for each query asked: what is seen of it, and of what is not the best that may come next (above), or the worst of the list."""
        whole, part, none = self.depth == self.n, (self.depth > 0) & (self.depth < self.n), self.depth == 0
        high, low = (self.high, self.low) if above else (self.first, self.last)
        up, down, x, rank = self.up[asked], self.down[asked], self.x[rows], self.rank[rows][:, part]
        rising = np.where(rank >= self.n - self.depth[part], x[:, part], high[part])
        falling = np.where(rank < self.depth[part], x[:, part], low[part])
        sums = self.queries[asked][:, whole] @ x[:, whole].T + up[:, part] @ rising.T + down[:, part] @ falling.T
        return sums + (up[:, none] @ high[none] + down[:, none] @ low[none])[:, None]


def nra(k: int, scale: float):
    """The search of a block, by which the k best of each query may be found; search.read counts the entries that it has read."""

    def search(part: Part, q_ids: np.ndarray, q_cells: np.ndarray, least: np.ndarray | None):
        x, q = integers(part.cells, scale), integers(q_cells, scale)
        kind, (n, dim) = exact_kind(x, q), x.shape
        none = -1 - dim * int(np.abs(x).max()) * int(np.abs(q).max())  # less than any bound
        x, q = x.astype(kind), q.astype(kind)
        beat = np.full(len(q), None, dtype=object) if least is None else least.copy()
        bars = np.array([none if b is None else max(none, min(-none, int(b))) for b in beat]).astype(kind)
        known = np.array([b is not None for b in beat], dtype=bool)
        reader = Reader(x, np.frombuffer(part.lists, "<u2").reshape(dim, n), q)
        alive = (part.ids != q_ids[:, None]) & (reader.most() >= bars).astype(bool)[:, None]  # where that is false, nothing in this block can qualify
        asked = np.arange(len(q))
        while len(asked := asked[alive[asked].sum(axis=1) > k]) and reader.on(asked):
            rows = np.flatnonzero(alive[asked].any(axis=0))
            if len(fresh := asked[~known[asked]]):  # no block before gives a score to beat: the k-th lower bound does
                lower = np.where(alive[np.ix_(fresh, rows)], reader.bounds(fresh, rows, above=False), bars[fresh][:, None])
                bars[fresh] = (np.sort if kind is object else partial(np.partition, kth=len(rows) - k))(lower, axis=1)[:, len(rows) - k]
            alive[np.ix_(asked, rows)] &= (reader.bounds(asked, rows, above=True) >= bars[asked][:, None]).astype(bool)
        search.read += reader.read
        query, row = np.nonzero(alive)
        score = (q @ x.T)[query, row] if 16 * len(row) > alive.size else (x[row] * q[query]).sum(axis=1)
        fine = np.flatnonzero((score >= bars[query]).astype(bool))
        query, row, score = query[fine], row[fine], score[fine]
        found = [np.zeros(0, dtype=np.int64)]
        starts = np.searchsorted(query, np.arange(len(q) + 1))
        for j in np.flatnonzero(starts[1:] > starts[:-1]):
            own = slice(starts[j], starts[j + 1])
            top = starts[j] + top_places(score[own], part.ids[row[own]], k)
            found.append(top)
            if len(top) == k:
                worst = int(score[top].min())
                beat[j] = worst if beat[j] is None else max(beat[j], worst)
        top = np.concatenate(found)
        fits = np.array([max(-LONG, min(LONG - 1, int(v))) for v in score[top]], dtype=np.int64)
        return (query[top], row[top], fits), beat

    search.read = 0
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row of vectors (vec_id: long, embedding) its k best other rows.

    A component x counts as floor(scale * x); the score is the integer inner product. A block of candidates is written with one sorted
    list for each dimension. The lists are read step by step for a block of queries at once, from the end that is better for each, those with the widest unread range first. What has been
    seen of a candidate bounds its score from below (unread: the list's least part) and above (unread: what comes next in the list), which is compared whenever half of the unread range is gone. Candidates whose upper
    bound lies below the k-th lower bound, or below the k-th score of the blocks before, go, and reading stops for a query when no more than k are left or nothing is left to read. Those that stay
    get their final scores. The blocks' k best then meet. Ties go to the smaller vec_id; fewer candidates than
    k give all of them. Sums too large for 64 bits are made of Python's integers; a score beyond a long is given as the largest or smallest long. Rows with null vec_id, or vectors that
    are null, empty, or hold nulls or non-finite components take no part; a zero vector does. Rows of another dimension are no candidates. Rows that share a vec_id
    each take part, as queries each with k of their own, but none is a candidate of its own id.
    """
    rows = usable(vectors, zero_too=True)
    candidates, queries = packed(rows, CANDIDATES, "candidates", sorted_lists(scale)), packed(rows.where(is_query), QUERIES, "queries")
    return best(written(against_all(candidates, queries, nra(k, scale), "long", k), "hits"), k)
