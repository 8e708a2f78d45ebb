"""Export and receive as a user calls them, and a native reader that says what it lacks."""

from __future__ import annotations

import hashlib
import importlib.util
import random

import pytest
from pyspark.sql import functions as F

from tallyspark import api

ARTIFACT = "commit long, pos long, path string, role string, profile string, media_type string, bytes long, sha256 string, dependencies array<string>, telemetry_catalog boolean"


@pytest.fixture(scope="module")
def job(spark):
    rng = random.Random(7)
    data = {f"f{i}": rng.randbytes(n) for i, n in enumerate([0, 10, 3_000_000, 500, 70_000])}
    data["f9"] = data["f1"]
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}
    rows = [(1, i, k, "physics.analysis", "full-state" if k == "f3" else "science", "text/plain", len(v), sha[k], ["f1"] if k == "f2" else [], True) for i, (k, v) in enumerate(data.items())]
    return data, sha, spark.createDataFrame(rows, ARTIFACT), spark.createDataFrame([(sha[k], bytearray(v)) for k, v in data.items()], "sha256 string, content binary")


def test_what_is_exported_is_received_in_any_order(spark, job):
    data, sha, artifacts, contents = job
    phases = []
    parts, receipt = api.export(artifacts, contents, "science", 1_000_000, phases.append)
    assert [p["phase"] for p in phases] == ["collecting", "capturing", "compressing", "completed"] and phases[1]["total_files"] == 4
    assert parts.count() > 3 and parts.agg(F.max("bytes")).first()[0] <= 1_000_000
    back = {r.path: bytes(r.content) for r in api.receive(parts.orderBy(F.rand(1)), receipt).collect()}
    assert back == {f"objects/{sha[k]}.txt": v for k, v in data.items() if k != "f3"}
    shown = api.preview(artifacts, "science").first()
    assert (shown.files, shown.objects) == (5, 4)
    first = receipt.agg(F.min("index")).first()[0]
    for bad in (parts.where(F.col("index") != first), parts.union(parts.where(F.col("index") == first)), parts.withColumn("archive", F.when(F.col("index") == first, F.concat("archive", F.lit(b"x"))).otherwise(F.col("archive")))):
        with pytest.raises(api.ContractError):
            api.receive(bad, receipt)


def test_what_is_not_as_its_commit_says_is_refused(spark, job):
    _, sha, artifacts, contents = job
    for a, c in [
        (artifacts.where("path <> 'f1'"), contents), (artifacts, contents.where(F.col("sha256") != sha["f4"])), (artifacts, contents.withColumn("content", F.when(F.col("sha256") == sha["f4"], F.lit(b"other")).otherwise(F.col("content")))),
        (artifacts.withColumn("bytes", F.when(F.col("path") == "f9", 11).otherwise(F.col("bytes"))), contents), (artifacts.withColumn("media_type", F.lit("image/png")), contents),
    ]:
        with pytest.raises(api.ContractError):
            api.export(a, c)
    with pytest.raises(ValueError):
        api.export(artifacts, contents, "everything")


@pytest.mark.skipif(importlib.util.find_spec("h5py") is not None, reason="the reader is installed")
def test_native_files_without_their_reader_are_refused_by_name(spark):
    from tallyspark.sources.native_files import NativeArrays

    spark.dataSource.register(NativeArrays)
    with pytest.raises(Exception, match="h5py"):
        spark.read.format("native_arrays").load("file:///nowhere.h5").collect()
