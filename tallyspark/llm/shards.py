"""Shards: rows of a task packed to about equal sizes, as one row of byte arrays each, and groups of sorted rows named across all shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import bucketed
from tallyspark.llm.text import column_bytes
from tallyspark.llm.worker import forget, lean

TEXTS = "shard long, ids binary, none binary, bounds binary, data binary"


def cells(**arrays: np.ndarray) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(a).tobytes() for name, a in arrays.items()}


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        base, made, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal made, held, size
            ids, none, lens, data = (np.concatenate(x) for x in zip(*held))
            row = cells(ids=ids, none=none, bounds=np.append(0, np.cumsum(lens)).astype("<i8")) | {"shard": base + made, "data": pa.compress(data.tobytes(), codec="zstd", asbytes=True)}
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("ids", "none", "bounds", "data")]]))

        for batch in batches:
            buf, bounds = column_bytes(batch.column("text"))
            none = np.array(batch.column("doc_id").is_null())
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            row, n = 0, len(ids)
            while row < n:
                stop = min(n, max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit - size, side="right")) - 1))
                held.append((ids[row:stop].astype("<i8"), none[row:stop].astype("<u1"), np.diff(bounds[row : stop + 1]), buf[bounds[row] : bounds[stop]]))
                size += int(bounds[stop] - bounds[row])
                row = stop
                if size >= limit or row < n:
                    yield out()
        if held:
            yield out()

    return run


def text_shards(docs: DataFrame, limit: int) -> DataFrame:
    """The rows of docs (doc_id: long, text) in shards of about `limit` bytes (a longer text fills one alone), written once in buckets of shards: shard, ids, none (whether the id is null), bounds and data (compressed). A null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bucketed(rows.mapInArrow(lean(_packed(limit)), TEXTS), "shard", "shards", dealt=False)


def texts_of(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """The bytes of a shard's texts."""
    return np.frombuffer(pa.decompress(data, int(bounds[-1]), codec="zstd", asbytes=True) if bounds[-1] else b"", np.uint8)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a shard."""
    bounds = np.frombuffer(row["bounds"], "<i8")
    return texts_of(row["data"], bounds), bounds


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """One shard at a time, so that only its arrays are held."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _named(keys: list[str], order: list[str], step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, before = (step << 59) | (TaskContext.get().partitionId() << 39), 0
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            nonlocal before
            columns = [table.column(c).to_numpy() for c in keys]
            new = np.ones(len(table), dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            starts = np.flatnonzero(new)
            whole = len(table) if last else int(starts[-1])
            starts = starts if last else starts[:-1]
            if not len(starts):
                return None, table
            sizes = np.diff(np.append(starts, whole))
            totals = np.add.reduceat(table.column("n").to_numpy()[:whole], starts)
            name = base + before + np.cumsum(totals) - totals
            first = np.zeros(whole, dtype=bool)
            by = [table.column(c).to_numpy(zero_copy_only=False)[:whole] for c in reversed(order)]
            first[np.lexsort([*by, np.repeat(np.arange(len(sizes)), sizes)])[starts] if by else starts] = True
            before += int(totals.sum())
            keep = np.flatnonzero(np.repeat(totals > 1, sizes))
            part = table.slice(0, whole).take(pa.array(keep))
            arrays = [part.column("shard"), part.column("k"), pa.array(np.repeat(name, sizes)[keep]), pa.array(first[keep])]
            return pa.table(arrays, names=["shard", "k", "name", "first"]), table.slice(whole)

        for batch in batches:
            if not len(batch):
                continue
            same = held and all(batch.column(c)[-1] == held[0].column(c)[0] for c in keys)
            held.append(batch)
            if same:
                continue  # one group goes on; it has at most one row for each shard
            found, rest = out(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.combine_chunks().to_batches()
            if found is not None:
                yield from found.combine_chunks().to_batches()
        if held:
            found, _ = out(pa.Table.from_batches(held).combine_chunks(), True)
            yield from found.combine_chunks().to_batches()

    return run


NAMED = "shard long, k long, name long, first boolean"


def named_groups(rows: DataFrame, keys: list[str], order: list[str] = [], step: int = 0) -> DataFrame:
    """shard, k, name, first of the rows (keys, n, shard, k, and order) whose group of equal keys counts more than one by the sum of n.

    The order of groups is that of the partition to which their key is dealt by hash, then that of keys; name is the place of the group among all members (n) in that
    order (step sets its highest bits), and `first` marks the first row of a group in `order`. With one row for each shard and key, a group is never larger than the number of shards.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_named(keys, order, step)), NAMED)
