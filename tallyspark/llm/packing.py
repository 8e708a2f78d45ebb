"""Packing by concatenating and cutting: two passes of prefix sums give global offsets, fixed windows give the pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.scratch import written
from tallyspark.llm.tokens import WordBPE, made
from tallyspark.llm.worker import lean


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, lens in made(WordBPE, path).rows(batch.column("text")):
                n = len(lens)
                whole = np.empty(len(ids) + n, dtype="<u4" if ids.itemsize == 4 else "<u2")
                stops = np.cumsum(lens + 1)
                last = np.zeros(len(whole), dtype=bool)
                last[stops - 1] = True
                whole[last], whole[~last] = end_id, ids
                offsets = np.append(0, stops).astype(np.int64) * whole.itemsize
                cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                starts = at + stops - lens - 1
                at += int(stops[-1])
                yield pa.record_batch([batch.column("doc_id").slice(first, n), pa.array(np.full(n, part)), pa.array(starts), pa.array(lens + 1), pa.array(np.full(n, whole.itemsize)), cells], names=["doc_id", "part", "at", "n", "width", "ids"])

    return run


ENCODED = "doc_id long, part long, at long, n long, width long, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row for each row of docs, written once: doc_id, part (the task's number), at (ids before it in its part), n, width (bytes of an id), ids.

    Each text's ids are followed by end_id; a null text counts as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(lean(_encode(tokenizer, end_id)), ENCODED), "encoded")


def ids_of(cell: bytes, width: int) -> np.ndarray:
    return np.frombuffer(cell, dtype="<u2" if width == 2 else "<u4")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id")
            base, width = (batch.column(c).to_numpy() for c in ("base", "width"))
            for i in range(len(batch)):
                ids = ids_of(batch.column("ids")[i].as_py(), int(width[i])).astype("<u4")
                begin, n = int(base[i]), len(ids)
                edges = np.arange(begin // length + 1, (begin + n - 1) // length + 1) * length - begin
                starts = np.append(0, edges)
                sizes = np.diff(np.append(starts, n))
                parts = [ids[s : s + k].tobytes() for s, k in zip(starts, sizes)]
                yield pa.record_batch(
                    [
                        doc.slice(i, 1).take(pa.array(np.zeros(len(starts), dtype=np.int64))),
                        pa.array(starts.astype(np.int64)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                        pa.array(np.full(len(starts), n)),
                        pa.array((begin + starts) // length),
                        pa.array((begin + starts) % length),
                        pa.array(parts, pa.binary()),
                    ],
                    names=PIECE_NAMES,
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for piece in run(batches):
            held.append(piece)
            if len(held) >= 1000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """All texts of docs (doc_id: long, text), each with end_id behind it, as pieces of sequences of `length` ids.

    The texts stand one behind another in the order in which the table is read and encoded, which the written table
    of ids keeps. First each part's ids are summed, and sums of the parts before give each part's place; then every
    text is cut where a sequence ends. One row for each piece: doc_id, start (ids of the document before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, ids (those 32-bit ids). All
    sequences but the last are full. A null text counts as empty and is its end_id alone; null and repeated doc_ids are packed like any row; an empty table
    has no pieces; other columns are ignored.
    """
    ids = encoded(docs, tokenizer, end_id)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("place"))
    based = ids.join(F.broadcast(places), "part").select("doc_id", (F.col("place") + F.col("at")).alias("base"), "width", "ids")
    return based.mapInArrow(lean(_cut(length)), PIECES)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, ids (padded with pad_id to length, or to the next power of two where that is shorter), n_ids, doc_ids."""
    as_ids = F.pandas_udf(lambda s: s.map(lambda b: np.frombuffer(b, dtype="<u4").astype(np.int64)), "array<long>")
    rows = pieces.select("sequence_id", F.struct("offset", as_ids("ids").alias("ids"), "doc_id").alias("p"))
    rows = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    rows = rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids")).withColumn("n_ids", F.size("ids").cast("long"))
    full = F.least(F.lit(length), F.pow(F.lit(2), F.ceil(F.log2("n_ids"))).cast("int"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), full - F.col("n_ids").cast("int"))).alias("ids"), "n_ids", "doc_ids")
