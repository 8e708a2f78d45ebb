"""Pages of a bounded number of bytes, and archives that are split where they overflow."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyspark.operators import transport


def test_pages_grow_with_the_data_and_are_bounded(spark):
    rng = random.Random(2)
    content = {f"o{i}": rng.randbytes(n) for i, n in enumerate([0, 1, 4096, 700_000, *[rng.randrange(9000) for _ in range(60)]])}
    objects = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary").repartition(3)
    pieces = transport.chunk_plan(objects, "path", 4096).withColumn("snapshot", F.lit("s"))
    pages = transport.deal_pages(pieces, "snapshot", 50_000)
    weights = [r.w for r in pages.groupBy("page").agg(F.sum(F.length("piece") + transport.OVERHEAD).alias("w")).collect()]
    assert max(weights) <= 50_000 + 4096 + transport.OVERHEAD
    assert len(weights) >= sum(weights) // 50_000 > 15
    parts = transport.build_parts(pages, "snapshot", "page", 1 << 20)
    assert {r.path: bytes(r.content) for r in transport.restore(parts).collect()} == content


def test_a_page_that_overflows_is_split(spark):
    rng = random.Random(3)
    content = {**{f"o{i}": rng.randbytes(20_000) for i in range(5)}, "long": rng.randbytes(100_000), "empty": b""}
    rows = [("s", 0, k, 0, bytearray(v)) for k, v in content.items()]
    pieces = spark.createDataFrame(rows, "snapshot string, page long, path string, offset long, piece binary")
    parts = transport.build_parts(pieces, "snapshot", "page", 30_000).cache()
    sizes = [r.n for r in parts.select(F.length("archive").alias("n")).collect()]
    assert len(sizes) > 7 and max(sizes) <= 30_000
    assert {r.path: bytes(r.content) for r in transport.restore(parts).collect()} == content
