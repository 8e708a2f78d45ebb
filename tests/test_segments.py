"""Segments with one commit: batches, streams that are restarted, commits that fail, files that are short."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import segments

SCHEMA = "id long, source string, v double"


def rows(spark, low, high):
    return spark.range(low, high, numPartitions=3).select("id", F.concat(F.lit("s"), F.col("id") % 2).alias("source"), (F.col("id") / 2).alias("v"))


def read(spark, base):
    return sorted(r.id for r in segments.committed_segments(spark, base, spark.createDataFrame([], SCHEMA).schema).collect())


def test_batches_are_committed_whole(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    assert segments.pointer(base) is None and segments.entries(base) == []
    segments.write_segments(rows(spark, 0, 50), base, cursor="id", source="source", rows="7", contract="set-1")
    segments.write_segments(rows(spark, 50, 60), base, cursor="id", source="source")
    now = segments.pointer(base)
    assert read(spark, base) == list(range(60)) and now["rows"] == 60 and now["epoch"] == 1 and now["cursors"] == {"s0": 58, "s1": 59}
    found = segments.entries(base)
    assert sum(e["rows"] for e in found) == 60 and max(e["rows"] for e in found if e["epoch"] == 0) == 7 and now["catalog"]["entries"] == len(found)
    assert all(r["rows"] == r["footer_rows"] for r in segments.segment_footers(spark, base).collect())
    assert list(Path(f"{tmp_path}/base/staged").iterdir()) == []
    assert pq.read_metadata(f"{tmp_path}/base/{found[0]['path']}").metadata[b"contract"] == b"set-1"
    assert json.loads(Path(f"{tmp_path}/base/{now['summary']}").read_text())["rows"] == 60
    chunk = Path(f"{tmp_path}/base/{now['catalog']['path']}")
    chunk.write_bytes(chunk.read_bytes().replace(b'"rows":', b'"rowz":'))
    with pytest.raises(ValueError, match="not the chunk"):
        segments.entries(base)


def test_a_commit_that_fails_leaves_the_old_pointer(spark, tmp_path):
    base = f"file://{tmp_path}/base"
    segments.write_segments(rows(spark, 0, 10), base)
    before = segments.pointer(base)
    (Path(f"{tmp_path}/base/summaries")).rename(f"{tmp_path}/base/kept")
    Path(f"{tmp_path}/base/summaries").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017  Spark wraps it
        segments.write_segments(rows(spark, 10, 20), base)
    assert segments.pointer(base) == before and read(spark, base) == list(range(10))
    assert list(Path(f"{tmp_path}/base/staged").iterdir()) == []
    Path(f"{tmp_path}/base/summaries").unlink()
    segments.write_segments(rows(spark, 10, 20), base)
    assert read(spark, base) == list(range(20))
    writer = segments.SegmentStreamWriter({"path": base}, rows(spark, 0, 1).schema)
    again = segments.pointer(base)
    writer.commit([segments.Written()], 1)  # a batch that is repeated
    assert segments.pointer(base) == again


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    base, source = f"file://{tmp_path}/base", f"{tmp_path}/in"
    for low in (0, 20, 40):
        rows(spark, low, low + 20).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        segments.segment_stream(stream, base, cursor="id", source="source").trigger(availableNow=True).start().awaitTermination(120)
        assert read(spark, base) == list(range(low + 20))
    assert segments.pointer(base)["cursors"] == {"s0": 58, "s1": 59} and segments.pointer(base)["epoch"] == 2
