"""Files as rows: captured whole, checked against what a commit says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.strict_json import json_fault


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256, content of files; drop content if only the digest counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def capture_violations(files: DataFrame, artifacts: DataFrame, key: str = "path") -> DataFrame:
    """key, rule of artifacts (key, bytes, sha256) of which the file is missing, or has another size or digest."""
    seen = files.select(key, F.col("bytes").alias("seen_bytes"), F.col("sha256").alias("seen_sha256"))
    rule = F.when(F.col("seen_bytes").isNull(), "missing").when(F.col("seen_bytes") != F.col("bytes"), "size").when(F.col("seen_sha256") != F.col("sha256"), "digest")
    return artifacts.join(seen, key, "left").select(key, rule.alias("rule")).where("rule is not null")


def container_faults(files: DataFrame) -> DataFrame:
    """path, fault of files by their media type: JSON by the strict rules, text as UTF-8."""
    kind = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    text = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    return files.select("path", F.when(kind == "json", json_fault(F.col("content"))).when(kind.isin("txt", "md"), text).alias("fault")).where("fault is not null")


def telemetry_segments(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Parquet segments by a closed contract: the schema is given, never inferred; rows keep their file and place for ordered proofs."""
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.select("*", F.col("_metadata.file_path").alias("segment"), F.col("_metadata.row_index").alias("segment_row"))


def contract_violations(df: DataFrame, schema) -> list[str]:
    """How a table's columns differ from the contract's, in both directions."""
    want, have = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in df.schema}
    return sorted([f"missing {n}" for n in want.keys() - have.keys()] + [f"unknown {n}" for n in have.keys() - want.keys()] + [f"type of {n}" for n in want.keys() & have.keys() if want[n] != have[n]])


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, footer_rows: what the footers of Parquet files say that they hold; only the ends of files are read, by tasks."""
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, where = fs.FileSystem.from_uri(path)
                yield pa.record_batch([pa.array([path]), pa.array([pq.read_metadata(where, filesystem=store).num_rows], pa.int64())], names=["path", "footer_rows"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), 1000))).mapInArrow(run, "path string, footer_rows long")


def footer_violations(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """segment, rows, footer_rows of segments (telemetry_segments) of which another number of rows was decoded than the footer (path, footer_rows) says."""
    found = rows.groupBy("segment").agg(F.count("*").alias("rows"))
    both = expected.withColumnRenamed("path", "segment").join(found, "segment", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return both.where("rows <> footer_rows").select("segment", "rows", "footer_rows")
