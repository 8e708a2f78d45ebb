"""Token ids of all documents as files of rANS blocks, written in order of doc_id and read again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.files import manifest, new_file, opened, read_whole, write_manifest
from tallyspark.llm.packing import encoded, ids_of
from tallyspark.llm.rans import Model, Writer, read_file
from tallyspark.llm.scratch import new_folder, spread, written
from tallyspark.llm.worker import lean

#: Ids of a file, about.
FILE_IDS = 1 << 24


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for cell, width in zip(batch.column("ids"), batch.column("width").to_pylist()):
            own = np.bincount(ids_of(cell.as_buffer(), width))
            if len(own) > len(total):
                total = np.append(total, np.zeros(len(own) - len(total), dtype=np.int64))
            total[: len(own)] += own
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])


def shared_model(ids: DataFrame) -> Model:
    """Frequencies of the ids of all documents; what comes to the driver is one row for each id of the vocabulary that occurs."""
    rows = ids.select("width", "ids").mapInArrow(lean(_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"]] = rows["n"]
    return Model.of_counts(counts)


TABLE_NAME = "frequencies.trnf"
FILES = "shard long, path string, docs long, ids long, bytes long"


def _write(folder: str, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/ids-{shard:06d}.trns"
        with new_file(path) as stream:
            writer = Writer(stream, model)
            batch = first
            while batch is not None:
                for doc_id, width, cell in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids")):
                    writer.add(doc_id, ids_of(cell.as_buffer(), width))
                batch = next(batches, None)
            done = writer.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, **done}])

    return run


def _read(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = opened(row["path"])
                at, rows = row["place"], []
                with store.open_input_file(path) as file:
                    for doc_id, ids in read_file(file, model):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _table(rows)
                            rows = []
                yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in cells], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> tuple[DataFrame, Model]:
    """Writes the ids of docs (doc_id: long, text), each text's with end_id behind them, in ascending order of doc_id.

    Gives the files (shard, path, docs, ids, bytes), which manifest.json in the folder also lists, and the frequencies, which
    the folder holds as the file that the manifest names: read_token_folder needs nothing but the folder.
    Null doc_ids come first; rows that share a doc_id stand in order of length and ids; a null text counts as empty; an empty
    table gives no files; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    ids = encoded(docs, tokenizer, end_id)
    model = shared_model(ids)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, min(spread(spark), -(-total // (FILE_IDS // 16))), -(-total // FILE_IDS))
    dealt = ids.select("doc_id", "n", "width", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "n", F.substring("ids", 1, 8)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    files = written(dealt.mapInArrow(lean(_write(folder, model)), FILES), "files")
    data = model.table()
    with new_file(f"{folder}/{TABLE_NAME}") as stream:
        stream.write(data)
    write_manifest(folder, files, frequencies={"name": TABLE_NAME, "ids": len(model.freq), "bytes": len(data), "crc32": zlib.crc32(data)})
    return files, model


def read_token_files(files: DataFrame, model: Model) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), from the files."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("place"))
    return placed.repartition(spread(files.sparkSession)).mapInArrow(lean(_read(model)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_folder(spark: SparkSession, folder: str) -> DataFrame:
    """What read_token_files gives, from a folder alone, wherever it has been moved: its manifest, its frequencies and its files."""
    found = manifest(folder)
    data = read_whole(f"{folder}/{found['frequencies']['name']}")
    if zlib.crc32(data) != found["frequencies"]["crc32"]:
        raise ValueError("the frequencies of token ids are damaged")
    rows = [(f["shard"], f"{folder}/{f['path'].rpartition('/')[2]}", f["docs"], f["ids"], f["bytes"]) for f in found["files"]]
    return read_token_files(spark.createDataFrame(rows, FILES), Model.of_table(data))
