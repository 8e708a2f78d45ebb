"""Approximate nearest neighbours by multi-index hashing: learned binary codes, substring indexes, pigeonhole probing, exact rerank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import written
from tallyspark.llm.vectors import CANDIDATES, QUERIES, Part, against_all, best, packed, query_rows, usable

SUBSTRING = 8
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_FAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class Codes:
    """A rotation of the centred principal components, learned so that signs lose little; dimensions are kept, filled up to whole substrings."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray):
        self.mean, self.turn = mean, turn

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 30) -> Codes:
        mean = sample.mean(axis=0)
        centred = sample - mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1].T
        parts = centred @ axes.T
        turn = np.linalg.qr(np.random.default_rng(17).normal(size=(parts.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(parts @ turn >= 0, 1.0, -1.0).T @ parts)
            turn = (u @ v).T
        return cls(mean, axes.T @ turn)

    def of(self, cells: np.ndarray) -> np.ndarray:
        """uint8 substrings of each row's code."""
        return np.packbits((cells - self.mean) @ self.turn >= 0, axis=1)

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _ONES[a ^ b].sum(axis=-1, dtype=np.int64)


def probe_radii(radius: int, parts: int) -> list[int]:
    """Pigeonhole: a code within radius lies within radius div parts in one of the first (radius mod parts) + 1 substrings, or one less in another."""
    whole, rest = divmod(radius, parts)
    return [whole if j <= rest else whole - 1 for j in range(parts)]


def substring_index(codes: Codes):
    """The index of a block, made once: its rows' substrings, and for each substring the rows in order of its value."""

    def index(cells: np.ndarray) -> bytes:
        own = codes.of(cells)
        return own.tobytes() + np.argsort(own, axis=0, kind="stable").T.astype("<u2").tobytes()

    return index


class Probes:
    """The index of a block as it is asked: rows by value in each substring, and for each value asked the rows of all values near enough, as bits, found once for all queries."""

    def __init__(self, part: Part, parts: int, radius: int):
        n = len(part.ids)
        self.lists, self.radius = part.lists, radius
        self.own = np.frombuffer(part.lists, np.uint8, n * parts).reshape(n, parts)
        self.order = np.frombuffer(part.lists, "<u2", offset=n * parts).reshape(parts, n)
        self.radii = probe_radii(radius, parts)
        self.bounds = np.stack([np.searchsorted(self.own[self.order[j], j], np.arange(257)) for j in range(parts)])
        self.rows, self.known = np.zeros((parts, 256, -(-n // 8)), dtype=np.uint8), np.zeros((parts, 256), dtype=bool)

    def probe(self, j: int, value: int) -> None:
        values = np.flatnonzero(_FAR[value] <= self.radii[j])
        starts, lens = self.bounds[j, values], self.bounds[j, values + 1] - self.bounds[j, values]
        total = np.cumsum(lens)
        hit = np.zeros(len(self.own), dtype=bool)
        hit[self.order[j, np.repeat(starts - total + lens, lens) + np.arange(total[-1])]] = True
        self.rows[j, value], self.known[j, value] = np.packbits(hit), True

    def near(self, codes: Codes, asked: np.ndarray) -> np.ndarray:
        """For each code asked, which rows lie within the radius: those that a probe reaches, if the full distance allows them."""
        n, parts = self.own.shape
        bits = np.zeros((len(asked), self.rows.shape[2]), dtype=np.uint8)
        for j in range(parts):
            if self.radii[j] >= 0:
                for value in np.flatnonzero((np.bincount(asked[:, j], minlength=256) > 0) & ~self.known[j]):
                    self.probe(j, value)
                bits |= self.rows[j, asked[:, j]]
        hit = np.unpackbits(bits, axis=1, count=n).view(bool)
        if 16 * np.count_nonzero(hit) > hit.size:
            a, b = (np.unpackbits(c, axis=1).astype(np.float32) * 2 - 1 for c in (asked, self.own))
            return hit & (a @ b.T >= 8 * parts - 2 * self.radius)
        query, row = np.nonzero(hit)
        hit[query, row] = codes.far(self.own[row], asked[query]) <= self.radius
        return hit


def mih(k: int, codes: Codes, radius: int):
    """For a block: probes, then full distance, then floats; those that may be among the k best are summed once more, each in the same order."""
    probes: Probes | None = None

    def search(part: Part, q_ids: np.ndarray, q_cells: np.ndarray, least: np.ndarray | None):
        nonlocal probes
        ids, cells = part.ids, part.cells
        asked = codes.of(q_cells)
        if probes is None or probes.lists is not part.lists:
            probes = Probes(part, asked.shape[1], min(radius, 8 * asked.shape[1]))
        near = probes.near(codes, asked) & (ids != q_ids[:, None])
        beat = np.full(len(q_ids), None, dtype=object) if least is None else least.copy()
        new = np.array([b is None for b in beat], dtype=bool)
        bars = np.array([-np.inf if b is None else b for b in beat], dtype=np.float64)
        with np.errstate(all="ignore"):
            score = q_cells @ cells.T
            if len(ids) > k and new.any():
                bars[new] = np.partition(np.where(near[new], score[new], -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
            # sums of the same products in two orders differ by less than that
            bars -= 4 * cells.shape[1] * np.finfo(np.float64).eps * np.sqrt((q_cells**2).sum(axis=1)) * np.sqrt((cells**2).sum(axis=1).max())
            query, row = np.nonzero(near & ~(score < bars[:, None]))
            return (query, row, (cells[row] * q_cells[query]).sum(axis=1)), beat

    return search


def learned(sample: np.ndarray, k: int, recall: float, tried: int = 200) -> tuple[Codes, int]:
    """Codes fitted to the sample, and the radius within which the given share of its rows' k nearest lie."""
    codes = Codes.fit(sample)
    bits = codes.of(sample)
    at = np.linspace(0, len(sample) - 1, min(tried, len(sample))).astype(int)
    seen = []
    for i in at:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        seen.append(codes.far(bits[near], bits[i]))
    flat = np.sort(np.concatenate(seen)) if seen else np.zeros(0)
    return codes, int(flat[min(len(flat) - 1, int(np.ceil(recall * len(flat))))]) if len(flat) else 0


def smallest_by_hash(rows: DataFrame, many: int, most: int) -> DataFrame:
    """The `most` rows (all, if fewer) of smallest hash of vec_id, in that order, written. many: how many rows there are.

    An order with a limit takes `most` rows of every task, and to the driver if they are collected there; so a bound on the hash, raised until enough rows are below it,
    goes before it, and the rows that stay meet in a task.
    """
    share = 2 * most / many
    while True:
        low = rows.where(F.xxhash64("vec_id") < int((share - 0.5) * (1 << 64))) if share < 1 else rows
        found = written(low.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most), "smallest")
        if share >= 1 or found.count() == most:
            return found
        share *= 8


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, sample_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row of vectors (vec_id: long, embedding) the k found nearest by inner product.

    Codes and the radius are learned, for each dimension, from a sample of at most sample_rows rows (those of smallest hash of vec_id), so that the given
    share of true neighbours lies within the radius; every row is indexed, each block once, and the index is written with it. A query that finds fewer than k within the radius
    searches once more without one. Scores are inner products of the original vectors in double precision; ties go to
    the smaller vec_id; fewer candidates than k give all of them. Rows with null vec_id, or vectors that are null, empty, zero or hold null or non-finite components
    take no part. Rows of another dimension are no candidates. Rows that share a vec_id each take part, as queries each with k of their own, but none
    is a candidate of its own id.
    """
    rows = usable(vectors, zero_too=False)
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    out = None
    for dim, many in sorted(sizes.items()):
        own = rows.where(F.size("v") == dim)
        sample = smallest_by_hash(own, many, sample_rows).select("v").toPandas()
        codes, radius = learned(np.stack(sample["v"]).astype(np.float64), k, recall)
        candidates, queries = packed(own, CANDIDATES, "candidates", substring_index(codes)), packed(own.where(is_query), QUERIES, "queries")
        hits = written(against_all(candidates, queries, mih(k, codes, radius), "double", k), "hits")
        got = hits.groupBy("query").agg(F.count("*").alias("got"))
        few = written(query_rows(queries.table).join(got.hint("merge"), "query", "left").where(F.coalesce("got", F.lit(0)) < min(k, many - 1)).select("query", "vec_id", "v"), "few")
        again = packed(few.select("vec_id", "v"), QUERIES, "again")
        more = against_all(candidates, again, mih(k, codes, 8 * (-(-dim // 8))), "double", k).withColumn("query", -1 - F.col("query"))
        part = best(hits.join(few.select("query").hint("merge"), "query", "left_anti").unionByName(more), k)
        out = part if out is None else out.union(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

