"""Parquet segments with one commit: tasks write and re-read them, then a catalog chunk, a summary and last a pointer make all of a batch visible at once.

A base folder holds staged/ (what no commit has named yet), segments/, catalog/ (chunks of entries, each with the digest of the one before), summaries/ and current.json, the pointer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyspark.functions.bits import compact_json

FORMAT = "tallyspark_segments"
#: Rows of a segment at most.
SEGMENT_ROWS = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: an entry for each segment, and the largest cursor of each source among its rows."""

    entries: list[dict] = field(default_factory=list)
    cursors: dict[str, int] = field(default_factory=dict)


def _opened(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base)


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as stream:
        return stream.read()


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """The file is there whole or not at all."""
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as stream:
        stream.write(data)
    store.move(temporary, path)


def pointer(base: str) -> dict | None:
    """The pointer of a base folder, or None before the first commit."""
    store, root = _opened(base)
    path = f"{root}/current.json"
    return json.loads(_read(store, path)) if store.get_file_info(path).type == fs.FileType.File else None


def entries(base: str) -> list[dict]:
    """The entries (one for each segment) that the pointer leads to, in order. Chunks are followed back by their digests; one that is missing or another than was named is an error."""
    store, root = _opened(base)
    now, found = pointer(base), []
    named = now and now["catalog"]
    total = named["entries"] if named else 0
    while named:
        data = _read(store, f"{root}/{named['path']}")
        if hashlib.sha256(data).hexdigest() != named["sha256"]:
            raise ValueError(f"{named['path']} is not the chunk that was committed")
        chunk = json.loads(data)
        found.append(chunk["entries"])
        named = chunk["previous"]
    out = [e for chunk in reversed(found) for e in chunk]
    if len(out) != total:
        raise ValueError("the catalog does not hold as many entries as its pointer says")
    return out


class _Segments:
    """Staging by tasks and the commit of what they have staged."""

    def __init__(self, options: dict, schema: StructType):
        self.base, self.by, self.cursor, self.source, self.rows = options["path"], options.get("by"), options.get("cursor"), options.get("source"), int(options.get("rows", SEGMENT_ROWS))
        self.contract = options.get("contract", "")
        self.names = schema.names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.base)
        out, held, many, label = Written(), [], 0, None

        def close() -> None:
            nonlocal held, many
            if held:
                out.entries.append(self._staged(store, root, pa.Table.from_batches(held), label))
            held, many = [], 0

        for batch in batches:
            if self.cursor:
                keys = batch.column(self.source).cast(pa.string()).to_pylist() if self.source else [""] * len(batch)
                for key, at in zip(keys, batch.column(self.cursor).to_pylist()):
                    if at is not None:
                        out.cursors[key] = max(at, out.cursors.get(key, at))
            while len(batch):
                here = str(batch.column(self.by)[0].as_py()) if self.by else None
                if held and (here != label or many == self.rows):
                    close()
                label, stop = here, min(len(batch), self.rows - many)
                if self.by:
                    column = batch.column(self.by).cast(pa.string()).to_pylist()
                    stop = next((k for k in range(1, stop) if str(column[k]) != here), stop)
                held.append(batch.slice(0, stop))
                many += stop
                batch = batch.slice(stop)
        close()
        return out

    def _staged(self, store: fs.FileSystem, root: str, table: pa.Table, label: str | None) -> dict:
        """A segment under a name of its own, its footer read again: rows, columns and contract are those that were to be written."""
        table = table.replace_schema_metadata({"contract": self.contract, "rows": str(len(table))})
        path = f"staged/{uuid.uuid4().hex}.parquet"
        store.create_dir(f"{root}/staged", recursive=True)
        with store.open_output_stream(f"{root}/{path}", compression=None) as stream:
            pq.write_table(table, stream, compression="zstd", write_statistics=True)
        footer = pq.read_metadata(f"{root}/{path}", filesystem=store)
        if footer.num_rows != len(table) or footer.schema.to_arrow_schema().names != self.names or footer.metadata[b"contract"] != self.contract.encode():
            raise ValueError(f"{path} does not hold what was written")
        data = _read(store, f"{root}/{path}")
        return {"staged": path, "rows": len(table), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "label": label}

    def _commit(self, messages: list[Written | None], epoch: int | None) -> None:
        store, root = _opened(self.base)
        now = pointer(self.base)
        last = -1 if now is None else now["epoch"]
        epoch = last + 1 if epoch is None else epoch
        messages = [m for m in messages if m is not None]
        if epoch <= last:
            return self._abort(messages)  # a repeated batch: all of it is there
        fresh = sorted((e for m in messages for e in m.entries), key=lambda e: (e["label"] or "", e["sha256"], e["staged"]))
        for e in fresh:
            store.create_dir(f"{root}/segments", recursive=True)
            store.copy_file(f"{root}/{e['staged']}", f"{root}/segments/{epoch:06d}-{e['sha256']}.parquet")
        named = [{"path": f"segments/{epoch:06d}-{e['sha256']}.parquet", "epoch": epoch, **{c: e[c] for c in ("rows", "bytes", "sha256", "label")}} for e in fresh]
        chunk = compact_json({"previous": now and now["catalog"], "entries": named}).encode()
        digest = hashlib.sha256(chunk).hexdigest()
        catalog = {"path": f"catalog/{epoch:06d}-{digest}.json", "sha256": digest, "entries": (now["catalog"]["entries"] if now else 0) + len(named)}
        _put(store, f"{root}/{catalog['path']}", chunk)
        cursors = dict(now["cursors"]) if now else {}
        for m in messages:
            for source, at in m.cursors.items():
                cursors[source] = max(at, cursors.get(source, at))
        summary = compact_json({"epoch": epoch, "rows": (now["rows"] if now else 0) + sum(e["rows"] for e in named), "segments": catalog["entries"], "cursors": cursors}).encode()
        summary_path = f"summaries/{epoch:06d}-{hashlib.sha256(summary).hexdigest()}.json"
        _put(store, f"{root}/{summary_path}", summary)
        _put(store, f"{root}/current.json", compact_json({"epoch": epoch, "catalog": catalog, "summary": summary_path, "rows": json.loads(summary)["rows"], "cursors": cursors}).encode())
        self._abort(messages)

    def _abort(self, messages: list[Written | None]) -> None:
        """What tasks have staged goes."""
        store, root = _opened(self.base)
        for m in messages:
            for e in m.entries if m is not None else []:
                if store.get_file_info(f"{root}/{e['staged']}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{e['staged']}")


class SegmentWriter(_Segments, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class SegmentStreamWriter(_Segments, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  the interface's name
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class SegmentSource(DataSource):
    """Options: path (the base folder), rows (of a segment at most), by (a column; a segment holds one of its values, of rows that come sorted), cursor and source (columns of offsets and of whose they are), contract (kept in each footer)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("segments are read by committed_segments")

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("committed segments are never overwritten")
        return SegmentWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> SegmentStreamWriter:  # noqa: N802  the interface's name
        return SegmentStreamWriter(self.options, schema)


def replace_file(path: str, other: str) -> None:
    """path holds from now on what other holds: a fault, for tests of what finds it."""
    store, target = _opened(path)
    store.copy_file(_opened(other)[1], target)


def write_segments(rows: DataFrame, base: str, /, **options: str) -> None:
    """Commits rows as segments of base; see SegmentSource for options."""
    rows.sparkSession.dataSource.register(SegmentSource)
    rows.write.format(FORMAT).mode("append").options(path=base, **options).save()


def segment_stream(stream: DataFrame, base: str, /, **options: str):
    """A stream's writer into base: every micro-batch is one commit of rows, cursors, catalog chunk and summary; a batch that is repeated after a restart changes nothing."""
    stream.sparkSession.dataSource.register(SegmentSource)
    return stream.writeStream.format(FORMAT).options(path=base, **options).option("checkpointLocation", f"{base}/checkpoint")


def committed_segments(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """The rows that the pointer leads to, in segments (see telemetry_segments), and nothing that was only staged."""
    from tallyspark.sources.files import telemetry_segments

    paths = [f"{base}/{e['path']}" for e in entries(base)]
    return telemetry_segments(spark, paths, schema) if paths else spark.createDataFrame([], schema)


def segment_footers(spark: SparkSession, base: str) -> DataFrame:
    """path, label, epoch, rows, footer_rows of the committed segments: what their entries and what their footers say; footers are read by tasks."""
    from tallyspark.sources.files import footers

    rows = [(f"{base}/{e['path']}", e["label"], e["epoch"], e["rows"]) for e in entries(base)]
    named = spark.createDataFrame(rows, "path string, label string, epoch long, rows long")
    return named.join(footers(spark, [r[0] for r in rows]), "path") if rows else named.selectExpr("*", "cast(null as long) as footer_rows")
