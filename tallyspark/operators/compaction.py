"""Many small segments written anew as one file for each group, in order, with every bit kept and proven by reading it again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators.proofs import payload_digest, payload_hash
from tallyspark.operators.snapshot import differences

#: Rows of a row group of a compacted file, and of a batch of its proof.
GROUP_ROWS, BATCH_ROWS = 65_536, 4_096


def reblocked(rows: DataFrame, segment: str, place: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """rows with ordinal and batch: their number over all segments in order, and its block of batch_rows, which runs across the segments' ends.

    Segments' lengths are summed first, so no window runs over rows.
    """
    ends = rows.groupBy(segment).agg(F.count("*").alias("n"))
    bases = ends.select(segment, (F.sum("n").over(W.orderBy(segment).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    out = rows.join(F.broadcast(bases), segment).withColumn("ordinal", F.col("base") + F.col(place)).drop("base")
    return out.withColumn("batch", F.expr(f"ordinal div {batch_rows}"))


def write_compacted(rows: DataFrame, by: str, order: str, folder: str) -> DataFrame:
    """by, path, n, bytes: one Parquet file for each group (by: text) with all its rows in order, written by Arrow, since a Parquet writer of the JVM would change NaNs. A file gets its name once it is whole."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, writer, done = None, None, []

        def close() -> None:
            writer.close()
            store.move(path + ".writing", path)
            done.append({by: here, "path": f"{folder}/{here}.parquet", "n": n, "bytes": store.get_file_info(path).size})

        for batch in batches:
            keys = batch.column(by).to_pylist()
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for first, stop in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[first] != here:
                    if writer is not None:
                        close()
                    here, n = keys[first], 0
                    store, path = fs.FileSystem.from_uri(f"{folder}/{here}.parquet")
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = pq.ParquetWriter(path + ".writing", batch.select(names).schema, filesystem=store, compression="zstd", use_dictionary=True)
                part = batch.select(names).slice(first, stop - first)
                writer.write_table(pa.Table.from_batches([part]), row_group_size=GROUP_ROWS)
                n += part.num_rows
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([(by, pa.string()), ("path", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())]))

    dealt = rows.repartition(by).sortWithinPartitions(by, order)
    from tallyspark.sources.store import settled

    return settled(dealt.mapInArrow(run, f"{by} string, path string, n long, bytes long"), "compacted")


def compaction_proof(spark: SparkSession, rows: DataFrame, files: DataFrame, by: str, order: str, columns: list[str], folder: str) -> DataFrame:
    """by, rule where the compacted files, read again, do not hold the rows that they were made of: another number, or another digest of bits and order. Whole files have none."""
    named = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    again = spark.read.schema(rows.drop(by).schema).parquet(folder).select("*", F.regexp_replace(named, r"\.parquet$", "").alias(by))
    digest = lambda df: payload_digest(payload_hash(df, by, order, columns), by)
    return differences(digest(rows), digest(again), by, ["n", "digest"], ("source", "compacted"))
