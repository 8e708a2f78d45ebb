"""Vectors in blocks: rows of one task, packed as arrays, and a set of queries against all blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import spread, written

BLOCK = "block long, dim long, ids binary, cells binary, lists binary"
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 512


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """vec_id, v (array of doubles) of the rows of vectors (vec_id: long, embedding) that take part: no null vec_id, no null, empty or non-finite vector, nor (unless zero_too) one of zeros."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero_too else F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & some)


def _pack(size: int, index: Callable[[np.ndarray], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 32, {}
        made = 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, cells = held.pop(dim)
            made += 1
            flat = np.concatenate(cells)
            return pa.RecordBatch.from_pylist([{"block": base + made, "dim": dim, "ids": np.array(ids, dtype="<i8").tobytes(), "cells": flat.tobytes(), "lists": index(flat.reshape(-1, dim)) if index else b""}])

        for batch in batches:
            v = batch.column("v")
            flat, offsets = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                dim = int(offsets[i + 1] - offsets[i])
                ids, cells = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                cells.append(flat[offsets[i] : offsets[i + 1]])
                if len(ids) == size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


class Blocks(NamedTuple):
    """A written table of blocks, and the number of tasks that packed them."""

    table: DataFrame
    tasks: int


def packed(rows: DataFrame, size: int, name: str, index: Callable[[np.ndarray], bytes] | None = None) -> Blocks:
    """Blocks of at most `size` rows, each of one dimension, written once with their index, which is what index gives for a block's cells; a task packs about 16 blocks."""
    many = rows.count()
    parts = max(1, min(4 * spread(rows.sparkSession), -(-many // size)), -(-many // (16 * size)))
    return Blocks(written(rows.repartition(parts).mapInArrow(_pack(size, index), BLOCK), name), parts)


class Part(NamedTuple):
    """A block of candidates."""

    ids: np.ndarray
    cells: np.ndarray
    lists: bytes


HITS = "query long, query_id long, vec_id long"
#: A query row goes by its block and its place there.
PLACES = 10
#: Bytes of queries that a task holds, about.
HELD = 32 << 20
NO_HITS = (np.zeros(0, dtype=np.int64),) * 3


class Asked:
    """A block of queries in a task: the best found so far, and the scores to beat in the next block of candidates."""

    def __init__(self, block: int, ids: np.ndarray, cells: np.ndarray):
        self.block, self.ids, self.cells = block, ids, cells
        self.least: np.ndarray | None = None
        self.hits: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def meet(self, part: Part, search: Callable, k: int) -> None:
        (query, row, score), self.least = search(part, self.ids, self.cells, self.least)
        found = (query, part.ids[row], score)
        query, ids, score = found if self.hits is None else (np.concatenate(c) for c in zip(self.hits, found))
        order = np.lexsort((ids, ~score if score.dtype.kind == "i" else -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < k]
        self.hits = (query[place < k], ids[kept], score[kept])
        if self.least is not None:
            for j, s in zip(query[place == k - 1], score[order[place == k - 1]].tolist()):
                if s > -(1 << 63):
                    self.least[j] = s if self.least[j] is None else max(self.least[j], s)

    def batch(self) -> pa.RecordBatch:
        query, ids, score = self.hits or NO_HITS
        return pa.record_batch([pa.array((self.block << PLACES) + query), pa.array(self.ids[query]), pa.array(ids), pa.array(score)], names=["query", "query_id", "vec_id", "score"])


def against_all(candidates: Blocks, queries: Blocks, search: Callable, kind: str, k: int) -> DataFrame:
    """Of each query row the k best candidates of each slice of the candidates.

    Queries go in groups of about HELD bytes, candidates in slices, a few for each core; each group meets each slice in a task of its own, which holds the
    group and takes the blocks of the slice one by one. Both sides are shuffled: nothing is broadcast, and a block crosses once for each task that needs it.
    search(block of candidates, query ids, query cells, least) gives (place of the query, place of the candidate, score) of what may stay, a few rows for
    each query, and the scores to beat in the next block; least holds those of the blocks before, or is None.
    """
    spark = queries.table.sparkSession
    held = queries.table.agg(F.sum(F.col("dim") * F.length("ids"))).first()[0] or 0
    groups = max(1, -(-held // HELD))
    slices = max(1, min(candidates.tasks, -(-4 * spark.sparkContext.defaultParallelism // groups)))
    task = F.shiftright("block", 32)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = queries.table.select((task % groups).alias("group"), each(slices).alias("slice"), F.lit(0).alias("kind"), "block", "dim", "ids", "cells", F.lit(b"").alias("lists"))
    own = candidates.table.select(each(groups).alias("group"), (task % slices).alias("slice"), F.lit(1).alias("kind"), "block", "dim", "ids", "cells", "lists")
    both = sent.select(*own.columns).union(own).withColumn("cell", (F.col("group") * slices + F.col("slice")).cast("int")).drop("group", "slice")
    dealt = both.repartitionById(groups * slices, F.col("cell")).sortWithinPartitions("kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[Asked] = []
        for batch in batches:
            for i in range(len(batch)):
                is_candidate, block, dim, ids, cells, lists = (batch.column(c)[i].as_py() for c in ("kind", "block", "dim", "ids", "cells", "lists"))
                ids, cells = np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<f8").reshape(-1, dim)
                if not is_candidate:
                    asked.append(Asked(block, ids, cells))
                    continue
                for q in asked:
                    if q.cells.shape[1] == dim:
                        q.meet(Part(ids, cells, lists), search, k)
        for q in asked:
            if q.hits:
                yield q.batch()

    return dealt.mapInArrow(run, f"{HITS}, score {kind}")


def query_rows(queries: DataFrame) -> DataFrame:
    """query, vec_id, v of the rows of packed queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, cells in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                ids, cells = np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<f8")
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(cells))
                yield pa.record_batch([pa.array((block << PLACES) + np.arange(len(ids))), pa.array(ids), v], names=["query", "vec_id", "v"])

    return queries.select("block", "dim", "ids", "cells").mapInArrow(run, "query long, vec_id long, v array<double>")


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query row's k highest scores, ties to the smaller vec_id."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_places(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]
