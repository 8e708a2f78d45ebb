"""Capture of a folder's files under a budget of bytes: listed without their contents, admitted by running sums, read once in bounded pieces."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fnmatch import translate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.folds import ranged, running
from tallyspark.operators.lineage import is_safe_path
from tallyspark.operators.snapshot import broken
from tallyspark.sources.store import settled

#: Bytes of a file that a task holds at once.
PIECE_BYTES = 8 << 20
_SCHEME = r"^file:"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    store, where = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), re.sub(_SCHEME, "", root))
    return store, where.rstrip("/")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (within root), bytes of all files below root, empty and hidden ones too, whose name is like glob; what is no regular file has no bytes. No content is read.

    Tasks list the folders of one depth side by side, round by round until no folder is left: the driver sees counts alone. (Spark's own source of binary files leaves empty ones out.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _opened(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{where}/{folder}".rstrip("/")))
                names = [f"{folder}/{i.base_name}".lstrip("/") for i in found]
                sizes = [i.size if i.type == fs.FileType.File else None for i in found]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())], names=["path", "bytes", "folder"])

    level, files = spark.createDataFrame([("",)], "path string"), spark.createDataFrame([], "path string, bytes long")
    while True:
        found = settled(level.mapInArrow(run, "path string, bytes long, folder boolean"), "folders")
        files = files.union(found.where("not folder").select("path", "bytes"))
        level = found.where("folder").select("path").repartition("path")
        if found.where("folder").isEmpty():
            break
    if glob == "*":
        return files
    return files.where(F.element_at(F.split("path", "/"), -1).rlike(translate(glob)))


def listing_violations(files: DataFrame) -> DataFrame:
    """path, rule of listed files (path, bytes) that a capture may not hold: an unsafe name, a size that is unknown or below zero, a name that is there twice."""
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("twice").alias("rule"))
    return broken(files, ["path"], {"name": ~is_safe_path(F.col("path")), "size": F.col("bytes").isNull() | (F.col("bytes") < 0)}).union(twice)


def admission(files: DataFrame, most_bytes: int) -> DataFrame:
    """path, bytes, before (bytes of all files earlier by path), admitted: whether the file and all before it fit in most_bytes. Sums run in two steps, so no task sees the whole listing."""
    if most_bytes < 1:
        raise ValueError("a capture's budget must be positive")
    rows = ranged(files.select(F.lit(0).alias("capture"), "path", "bytes"), "capture", ["path"])
    sums = running(rows, "capture", ["path"], before="bytes")
    return sums.select("path", "bytes", F.col("before").cast("long").alias("before"), (F.col("before") + F.col("bytes") <= most_bytes).alias("admitted"))


PIECES = "path string, piece long, data binary, bytes long, sha256 string, fault string"


def read_pieces(files: DataFrame, root: str) -> DataFrame:
    """The contents of files (path, bytes) below root as rows of pieces (path, piece, data), and behind each file's a row without piece: bytes and sha256 of what was read, fault.

    No more than one byte beyond the listed size is asked for: a file that has it has grown, one that ends before it has ended early, and one that is not there any more is missing. A task holds one piece.
    """
    kinds = pa.schema([("path", pa.string()), ("piece", pa.int64()), ("data", pa.binary()), ("bytes", pa.int64()), ("sha256", pa.string()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _opened(root)
        row = lambda **cells: pa.RecordBatch.from_pylist([cells], schema=kinds)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                digest, seen, piece, fault = hashlib.sha256(), 0, 0, None
                try:
                    with store.open_input_stream(f"{where}/{path}") as stream:
                        while data := stream.read(min(PIECE_BYTES, size - seen + 1)):
                            if seen + len(data) > size:
                                fault = "grown"
                                break
                            seen += len(data)
                            digest.update(data)
                            yield row(path=path, piece=piece, data=data)
                            piece += 1
                except FileNotFoundError:
                    fault = "missing"
                fault = fault or ("ended" if seen < size else None)
                yield row(path=path, bytes=seen, sha256=None if fault else digest.hexdigest(), fault=fault)

    return files.select("path", "bytes").mapInArrow(run, PIECES)
