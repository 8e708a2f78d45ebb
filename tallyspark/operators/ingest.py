"""Telemetry ingest: rows in order of arrival become bounded batches; rows and source cursors become durable together.

rows: session, arrival (order within a session), table_name and the table's fields. What is sequential by definition (when a buffer is full) streams through a fold of
constant state for each session; sessions are worked on side by side. All else is joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.canonical_json import canonical_json

#: Bounds of a batch's rows, bytes and age that a writer may be given, and what it has without.
BATCH_ROWS, MOST_BATCH_ROWS, BATCH_BYTES, LEAST_BATCH_BYTES, BUFFER_SECONDS, MOST_BUFFER_SECONDS = 256, 65_536, 4 << 20, 1024, 15.0, 60.0
#: What a hardware passport should tell.
HARDWARE_FIELDS = ("cpu_model", "topology", "affinity", "cpu_quota", "julia_threads", "blas_threads", "gc_threads", "compile_target", "libraries")


def check_bounds(rows: int = BATCH_ROWS, size: int = BATCH_BYTES, seconds: float = BUFFER_SECONDS) -> None:
    """Refuses bounds that a writer may not have."""
    if isinstance(rows, bool) or not 1 <= rows <= MOST_BATCH_ROWS or size < LEAST_BATCH_BYTES or not 0 < seconds <= MOST_BUFFER_SECONDS:
        raise ValueError(f"a batch of {rows} rows, {size} bytes, {seconds} s is out of bounds")


def row_bytes(df: DataFrame, names: list[str]) -> Column:
    """Bytes of a row's payload: those of its texts in UTF-8, and 8 for every other value, nulls too."""
    kinds = dict(df.dtypes)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(8)) if kinds[c] == "string" else F.lit(8)
    return sum((size(c) for c in names), F.lit(0)).cast("long")


def sequenced(rows: DataFrame, accepted: Column) -> DataFrame:
    """Accepted rows with sample_sequence, their number in session and table. A row that is refused for its values has used its number up, so there is a gap."""
    number = F.row_number().over(W.partitionBy("session", "table_name").orderBy("arrival")) - 1
    return rows.withColumn("sample_sequence", number.cast("long")).where(accepted)


def bounded_batches(rows: DataFrame, most_rows: int, most_bytes: int, most_seconds: float) -> DataFrame:
    """session, arrival, batch of rows (session, arrival, at: seconds, bytes, control): the buffer is closed before a row that would make it too large or finds it too old,
    and right behind a control event. A row that alone is above most_bytes is refused: its batch is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held, size, since = None, 0, 0, 0, 0.0
        for batch in batches:
            out = []
            for session, at, n, control in zip(*(batch.column(c).to_pylist() for c in ("session", "at", "bytes", "control"))):
                if here is None or session != here[0]:
                    here, number, held, size = (session,), 0, 0, 0
                if n > most_bytes:
                    out.append(None)
                    continue
                if held and (held + 1 > most_rows or size + n > most_bytes or at - since >= most_seconds):
                    number, held, size = number + 1, 0, 0
                since = since if held else at
                out.append(number)
                held, size = held + 1, size + n
                if control:
                    number, held, size = number + 1, 0, 0
            yield pa.record_batch([batch.column("session"), batch.column("arrival"), pa.array(out, pa.int64())], names=["session", "arrival", "batch"])

    kinds = dict(rows.dtypes)
    dealt = rows.select("session", "arrival", "at", "bytes", "control").repartition("session").sortWithinPartitions("session", "arrival")
    return dealt.mapInArrow(run, f"session {kinds['session']}, arrival {kinds['arrival']}, batch long")


def atomic_batches(rows: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source batches (keys) of which no row breaks a rule: one that does takes its whole batch along, before anything is written."""
    return rows.join(violations.select(*keys).distinct(), keys, "left_anti")


def committed_cursors(staged: DataFrame, watermarks: DataFrame) -> DataFrame:
    """session, source, offset: how far each source (staged: session, source, batch, offset) is durable, by the last committed batch of its session (watermarks: session, batch). What was staged later is not in it."""
    durable = staged.join(watermarks.withColumnRenamed("batch", "committed"), "session").where("batch <= committed")
    return durable.groupBy("session", "source").agg(F.max(F.struct("batch", "offset")).alias("last")).select("session", "source", F.col("last.offset").alias("offset"))


def to_replay(journal: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows of the sources' journals (session, source, offset) behind the committed cursor, or of sources without one: what a recovery has to send again."""
    rows = journal.join(cursors.select("session", "source", F.col("offset").alias("durable")), ["session", "source"], "left")
    return rows.where("durable is null or offset > durable").drop("durable")


def retried(committed: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a repeated batch adds: those whose keys are not committed yet, each once."""
    return again.join(committed.select(*keys), keys, "left_anti").dropDuplicates(keys)


def prefix(rows: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The rows (session, batch) that a reader of a watermark (session, batch) sees, while others append."""
    return rows.join(watermarks.withColumnRenamed("batch", "committed"), "session").where("batch <= committed").drop("committed")


def registered(index: DataFrame, opened: DataFrame) -> DataFrame:
    """The registry (session, pointer) with newly opened sessions; one that is there keeps its pointer."""
    return index.union(opened.join(index.select("session"), "session", "left_anti").select(*index.columns))


def missing_hardware(passports: DataFrame) -> DataFrame:
    """session, missing: fields that a passport (session, hardware: map) lacks, by name."""
    wanted = F.array(*[F.lit(f) for f in sorted(HARDWARE_FIELDS)])
    return passports.select("session", F.array_join(F.array_except(wanted, F.map_keys("hardware")), ",").alias("missing"))


def summary_documents(spans: DataFrame, resources: DataFrame, control: DataFrame, cursors: DataFrame) -> DataFrame:
    """session, document: each session's summary as compact JSON, from the rows of its tables and its committed cursors. A phase that was not measured is not in it, and a peak that nobody has seen is null.

    Each table is aggregated on its own by session and key before the few rows that result meet.
    """

    def keyed(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value.alias("v"))))).alias(name))

    whole = spans.where("measurement_kind = 'phase_duration'").groupBy("session", F.concat_ws(":", "phase", "timing_kind").alias("key"))
    phases = whole.agg(F.sum("duration_seconds").alias("s"), F.sum("call_count").alias("n"), F.count_if("warmup").alias("warm"), F.sum(F.when(F.col("warmup"), F.col("duration_seconds"))).alias("ws"))
    other = spans.where("measurement_kind in ('interval', 'delay')").groupBy("session", F.col("phase").alias("key")).agg(F.struct(F.count("*").alias("count"), F.greatest(F.max("duration_seconds"), F.lit(0.0)).alias("max_seconds"), F.sum("duration_seconds").alias("total_seconds")).alias("s"))
    counted = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    parts = [
        keyed(phases, "phase_seconds", F.col("s")), keyed(phases, "phase_calls", F.col("n")), keyed(phases.where("warm > 0"), "warmup_seconds", F.col("ws")), keyed(other, "intervals_and_delays", F.col("s")),
        counted(spans, "n_spans"), counted(resources, "n_resources"), counted(control, "n_control"), resources.groupBy("session").agg(F.max(F.greatest("rss_bytes", "peak_rss_bytes")).alias("max_observed_rss_bytes")),
        keyed(control.groupBy("session", F.col("event").alias("key")).agg(F.count("*").alias("n")), "control_events", F.col("n")), control.groupBy("session").agg(F.sum("samples_dropped").alias("samples_dropped")),
        cursors.groupBy("session").agg(F.bool_and(F.coalesce("complete_at_observation", F.lit(False))).alias("consumed")),
    ]
    sessions = spans.select("session").union(resources.select("session")).union(control.select("session")).distinct()
    rows = sessions
    for part in parts:
        rows = rows.join(part, "session", "left")
    none = lambda name, kind: F.coalesce(F.col(name), F.create_map().cast(f"map<string,{kind}>")).alias(name)
    zero = lambda name, other: F.coalesce(F.col(name), F.lit(0)).alias(other)
    fields = [
        F.coalesce("consumed", F.lit(True)).alias("all_observed_sources_consumed"), none("control_events", "bigint"),
        F.coalesce("intervals_and_delays", F.create_map().cast("map<string,struct<count:bigint,max_seconds:double,total_seconds:double>>")).alias("intervals_and_delays"), "max_observed_rss_bytes",
        none("phase_calls", "bigint"), none("phase_seconds", "double"), F.struct(zero("n_control", "control_events"), zero("n_resources", "resources"), zero("n_spans", "spans")).alias("rows"), zero("samples_dropped", "samples_dropped"), none("warmup_seconds", "double"),
    ]
    return rows.select("session", canonical_json(F.struct(*fields)).alias("document"))
