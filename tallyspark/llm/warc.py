"""WARC archives: records in order of page_id, files rolled by compressed size, headers and digests made anew, and a reader."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.files import new_file, opened, write_manifest
from tallyspark.llm.scratch import new_folder, spread, written

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard long, roll long, path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def file_head(name: str) -> bytes:
    """The record that says what a file is, as its own gzip member."""
    block = b"software: tallyspark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One record as its own gzip member: a response with its payload, or a revisit of refers_to with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(folder: str, roll_bytes: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """Rows come by page_id, digest, kind: what was decided for a page (kind 0) stands before its payload (kind 1)."""
        decided = None
        for batch in batches:
            names = ("page_id", "digest", "kind", "n_bytes", "refers_to", "url")
            for i, (page, digest, kind, n, to, url) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if kind == 0:
                    decided = (page, digest, to)
                    continue
                if decided is None or decided[:2] != (page, digest):
                    raise ValueError(f"nothing was decided for the payload of page {page}")
                payload = batch.column("html")[i].as_py() or ""
                yield record(page, url, payload.encode("utf-8"), n, digest, decided[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, roll, rows = TaskContext.get().partitionId(), 0, members(batches)
        member = next(rows, None)
        while member is not None:
            name = f"pages-{shard:06d}-{roll:06d}.warc.gz"
            path, n, head = f"{folder}/{name}", 0, file_head(name)
            size = len(head)
            with new_file(path) as stream:
                stream.write(head)
                while member is not None and (n == 0 or size + len(member) <= roll_bytes):
                    stream.write(member)
                    n, size = n + 1, size + len(member)
                    member = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "roll": roll, "path": path, "records": n, "bytes": size}])
            roll += 1

    return run


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = 1 << 26, same_bytes: int = 100) -> DataFrame:
    """Writes one record for each row of pages (page_id: long, url, html) and gives the files: shard, roll, path, records, bytes.

    Of rows with equal payloads of at least same_bytes, that with the smallest page_id is a response and the others
    revisit it; all other rows are responses. Null html is an empty payload; a null url leaves its header out; rows of a null
    page_id are written first, as revisits where another page has their payload, and never revisited; rows that share a page_id are each written, those with the response's page_id as responses; an empty table gives
    no files; other columns are ignored. A warcinfo record heads each file. manifest.json lists the files once all are whole.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    keys = rows.select("page_id", "digest", "n_bytes")
    first = keys.where(F.col("n_bytes") >= same_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1").select("digest", "first")
    first = written(first, "first")  # on its own, so that the join reads both sides from exchanges and a hot payload is split
    decided = keys.join(first, "digest", "left").selectExpr("page_id", "digest", "0 as kind", "n_bytes", "case when not first <=> page_id then first end as refers_to", "cast(null as string) as url", "cast(null as string) as html")
    payloads = rows.selectExpr("page_id", "digest", "1 as kind", "n_bytes", "cast(null as long) as refers_to", "url", "html")
    order = ["page_id", "digest", "kind", "url"]
    dealt = decided.union(payloads).repartitionByRange(spread(spark), "page_id", "digest").sortWithinPartitions(*order)
    files = written(dealt.mapInArrow(_write(folder, roll_bytes), FILES), "warc-files")
    write_manifest(folder, files)
    return files


def records_of(stream) -> Iterator[dict]:
    """The records of an open archive of gzip members, their digests checked."""
    data, unpacker, text = b"", zlib.decompressobj(31), bytearray()
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        text += unpacker.decompress(data)
        data = unpacker.unused_data
        if unpacker.eof:
            row = _parsed(bytes(text))
            if row is not None:
                yield row
            unpacker, text = zlib.decompressobj(31), bytearray()
    if text:
        raise ValueError("the archive ends within a record")


def _parsed(text: bytes) -> dict | None:
    """A record as a row; None for the record that heads a file."""
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record of the archive is damaged")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if response and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload of the archive does not match its digest")
    page = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if response else page("WARC-Refers-To"), "url": fields.get("WARC-Target-URI"), "payload": payload if response else None}


def _read(payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, where = opened(path)
                rows: list[dict] = []
                with store.open_input_stream(where, compression=None) as stream:
                    for row in records_of(stream):
                        rows.append(row if payloads else {**row, "payload": None})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of files (path): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (of responses, if asked for)."""
    return files.select("path").repartition(spread(files.sparkSession)).mapInArrow(_read(payloads), RECORDS)
