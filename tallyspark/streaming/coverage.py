"""Telemetry as streams: the aggregates of the batch operators, kept up to date by micro-batches that commit as a whole."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.telemetry import COARSE_SECONDS, IDENTITY_FIELDS
from tallyspark.sources.store import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_each: int = 1) -> DataFrame:
    """A table's files as a stream; maxFilesPerTrigger bounds what a micro-batch admits."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(f"{path}*")


def committed(stream: DataFrame, mode: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs what is there to the end. Each micro-batch writes a folder of its own, named by its number, so a repeated one changes nothing; where a batch has the whole result (complete), the last whole folder counts."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(commit_to(base)).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = committed_rows(spark, base)
    if mode == "complete":
        rows = rows.where(F.col("epoch") == rows.agg(F.max("epoch")).first()[0])
    return keep(rows) if keep else rows.drop("epoch")


def commit_to(base: str) -> Callable[[DataFrame, int], None]:
    """The sink of a micro-batch: its rows first, then its name in the list of commits. Done again, both are replaced by the same."""

    def commit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/epoch={epoch}")
        batch.sparkSession.createDataFrame([(epoch,)], "committed long").coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={epoch}")

    return commit


def committed_rows(spark: SparkSession, base: str, until: int | None = None) -> DataFrame:
    """The rows of committed batches, up to batch `until` if given: a reader sees a fixed prefix while others append, and nothing of a batch that did not end."""
    commits = spark.read.parquet(f"{base}/commits").select("committed").where(F.lit(True) if until is None else F.col("committed") <= until)
    rows = spark.read.option("basePath", f"{base}/data").parquet(f"{base}/data")
    return rows.join(F.broadcast(commits), rows.epoch == commits.committed, "left_semi")


def tumbling_counts(stream: DataFrame, time: str, minutes: int = 15) -> DataFrame:
    """Rows of each window; nothing is dropped as late, so there is no watermark and results are complete ones."""
    return stream.groupBy(F.window(F.col(time).cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


#: What the state keeps of an allocation, as JSON: whole numbers keep all their digits there.
STATE = "state string"
COUNTS = ("samples", "valid_intervals", "missing_samples", "discontinuous_intervals", "coarse_intervals")
SUMS = ("covered_wall_seconds", "cpu_seconds", "allocated_cpu_seconds", "observed_capacity_cpu_seconds", "coarse_wall_seconds", "fine_wall_seconds")
RESULT = "allocation_id string, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SUMS]) + ", longest_interval_seconds double, first_sample_ns long, last_sample_ns long"
#: Whole numbers that go to the fold as text: beside a null pandas would make them doubles, which do not hold nanoseconds.
WHOLE = ("sample_sequence", "monotonic_ns", "cpu_count", "pid", "process_start_ticks")
FIRST = {**dict.fromkeys(COUNTS, 0), **dict.fromkeys(SUMS, 0.0), "longest_interval_seconds": None, "first_sample_ns": None, "last_sample_ns": None, "before": None}


def fold(s: dict, row: dict) -> None:
    """One sample, in order of arrival, by the batch operator's rules; s["before"] is the latest sample of the run."""
    stamp, cpu, width = row["monotonic_ns"], row["cpu_time_seconds"], row["cpu_count"]
    s["samples"] += 1
    if stamp is not None:
        s["first_sample_ns"] = stamp if s["first_sample_ns"] is None else s["first_sample_ns"]
        s["last_sample_ns"] = stamp
    if cpu is None or stamp is None or not width or row["missing_reason"]:
        s["missing_samples"] += 1
        s["before"] = None
        return
    before, now = s["before"], {n: row[n] for n in ("monotonic_ns", "cpu_time_seconds", *IDENTITY_FIELDS)}
    if before is not None and stamp <= before["monotonic_ns"]:
        s["discontinuous_intervals"] += 1
        s["last_sample_ns"] = before["monotonic_ns"]
        return
    s["before"] = now
    if before is None:
        return
    if cpu < before["cpu_time_seconds"] or any(now[n] != before[n] for n in IDENTITY_FIELDS):
        s["discontinuous_intervals"] += 1
        return
    wall, used, quota = (stamp - before["monotonic_ns"]) / 1e9, cpu - before["cpu_time_seconds"], row["cpu_quota_cores"]
    s["valid_intervals"] += 1
    s["coarse_intervals"] += wall > COARSE_SECONDS
    s["coarse_wall_seconds" if wall > COARSE_SECONDS else "fine_wall_seconds"] += wall
    s["covered_wall_seconds"] += wall
    s["cpu_seconds"] += used
    s["allocated_cpu_seconds"] += wall * width
    s["observed_capacity_cpu_seconds"] += wall * (width if quota is None else min(width, quota))
    s["longest_interval_seconds"] = max(wall, s["longest_interval_seconds"] or wall)


#: Samples of an allocation that a task sorts at once, and those of each sorted run that it holds as it merges them.
RUN, PIECE = 100_000, 2048


def in_order(frames: Iterable[pd.DataFrame], run: int = RUN) -> Iterator[dict]:
    """The samples of frames by their number, equal ones as they come. Beyond `run` of them, sorted runs go to files of the task and are merged, so that a task never holds a whole allocation."""
    with tempfile.TemporaryDirectory() as folder:
        paths: list[str] = []
        held: list[pd.DataFrame] = []

        def ordered() -> pa.Table:
            table = pa.Table.from_pandas(pd.concat(held), preserve_index=False)
            for c in WHOLE:
                at = table.schema.get_field_index(c)
                table = table.set_column(at, c, table.column(c).cast(pa.int64()))
            return table.take(pc.sort_indices(table, [("sample_sequence", "ascending")]))

        def rows_of(path: str) -> Iterator[dict]:
            with pa.OSFile(path) as file:
                reader = pa.ipc.open_file(file)
                for i in range(reader.num_record_batches):
                    yield from reader.get_batch(i).to_pylist()

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= run:
                table = ordered()
                paths.append(f"{folder}/{len(paths)}")
                with pa.OSFile(paths[-1], "wb") as file, pa.ipc.new_file(file, table.schema) as writer:
                    writer.write_table(table, max_chunksize=PIECE)
                held.clear()
        rest = (row for batch in ordered().to_batches(max_chunksize=PIECE) for row in batch.to_pylist()) if held else iter(())
        yield from heapq.merge(*map(rows_of, paths), rest, key=lambda r: r["sample_sequence"])


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import json

    s = json.loads(state.get[0]) if state.exists else dict(FIRST)
    for row in in_order(frames):
        fold(s, row)
    state.update((json.dumps(s),))
    yield pd.DataFrame([[key[0], *(s[c.split()[0]] for c in RESULT.split(", ")[1:])]], columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)


def coverage_stream(resources: DataFrame) -> DataFrame:
    """cpu_coverage of each allocation after each micro-batch: all its fields."""
    kept = resources.where(~F.col("sampling_mode").eqNullSafe("profile_window") & (F.coalesce("allocation_id", F.lit("")) != ""))
    names = ["allocation_id", "sample_sequence", "monotonic_ns", "cpu_time_seconds", "missing_reason", *IDENTITY_FIELDS]
    sent = kept.select(*[F.col(c).cast("string").alias(c) if c in WHOLE else F.col(c) for c in dict.fromkeys(names)])
    return sent.groupBy("allocation_id").applyInPandasWithState(_fold, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """Of each allocation's updates the last one."""
    names = [c for c in rows.columns if c not in ("epoch", "allocation_id")]
    return rows.groupBy("allocation_id").agg(F.max_by(F.struct(*names), "epoch").alias("s")).select("allocation_id", "s.*")


