"""The whole summary of a session: every aggregate of its tables, its cursors and its writer's bounds, as one document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.canonical_json import canonical_json
from tallyspark.operators import ingest, telemetry

#: The name of the event that tells of a failed capture, what makes a writer flush, and segments of each table behind the last science window.
CAPTURE_ERROR, BARRIERS, TAIL_SEGMENTS = "performance_capture_incomplete", ("flush", "control_transition", "checkpoint", "export", "close"), 3


def _by_key(rows: DataFrame, **values: Column) -> DataFrame:
    """session and, for each value, a map of it by key; keys whose value is null are left out."""
    entry = lambda v: F.collect_list(F.when(v.isNotNull(), F.struct("key", v.alias("value"))))
    return rows.groupBy("session").agg(*[F.map_from_entries(F.array_sort(entry(v))).alias(name) for name, v in values.items()])


def _span_blocks(spans: DataFrame) -> list[DataFrame]:
    """Phases, warm-up, producer's phases by `phase:timing_kind`, and intervals and delays by phase."""
    keyed = spans.withColumn("key", F.concat_ws(":", "phase", "timing_kind"))
    whole = keyed.where("measurement_kind = 'phase_duration'").groupBy("session", "key").agg(
        F.sum("duration_seconds").alias("s"), F.sum("call_count").alias("n"), F.sum(F.when(F.col("warmup"), F.col("duration_seconds"))).alias("ws"), F.sum(F.when(F.col("warmup"), F.col("call_count"))).alias("wn")
    )
    ends = telemetry.boundary_measurements(keyed, "session", "key")
    measured = F.struct(
        "calls", F.col("wall_seconds").alias("duration_seconds"),
        F.col("process_cpu_seconds").alias("cpu_seconds"), F.col("process_cpu_seconds_calls").alias("cpu_measured_calls"), F.col("process_cpu_seconds_wall").alias("cpu_measured_wall_seconds"),
        "gc_seconds", F.col("gc_seconds_calls").alias("gc_measured_calls"), F.col("gc_seconds_wall").alias("gc_measured_wall_seconds"),
        "allocated_bytes", F.col("allocated_bytes_calls").alias("allocations_measured_calls"), F.col("allocated_bytes_wall").alias("allocations_measured_wall_seconds"),
    )
    other = spans.where("measurement_kind in ('interval', 'delay')").groupBy("session", F.col("phase").alias("key")).agg(F.count("*").alias("count"), F.greatest(F.max("duration_seconds"), F.lit(0.0)).alias("max_seconds"), F.sum("duration_seconds").alias("total_seconds"))
    return [
        _by_key(whole, phase_seconds=F.col("s"), phase_calls=F.col("n"), warmup_seconds=F.col("ws"), warmup_calls=F.col("wn")),
        _by_key(ends, producer_phase_seconds=F.col("wall_seconds"), producer_phase_calls=F.col("calls"), producer_phase_measurements=measured),
        _by_key(other, intervals_and_delays=F.struct("count", "max_seconds", "total_seconds")),
    ]


def session_coverage(resources: DataFrame) -> DataFrame:
    """session, allocations (in order of their first samples), unidentified_samples, profile_samples_excluded: cpu_coverage with its ratios, under the names of the document."""
    rows = telemetry.cpu_coverage(resources, "session")
    ratios = telemetry.coverage_ratios(rows, "session")
    kept = resources.where(~F.col("sampling_mode").eqNullSafe("profile_window"))
    first = kept.groupBy("session", "allocation_id").agg(F.min_by(F.struct("execution_id"), "sample_sequence").alias("own"), F.min("sample_sequence").alias("met"))
    both = rows.join(ratios, ["session", "allocation_id"]).join(first, ["session", "allocation_id"])
    same = ["allocation_id", "samples", "valid_intervals", "missing_samples", "discontinuous_intervals", "covered_wall_seconds", "cpu_seconds", "allocated_cpu_seconds", "observed_capacity_cpu_seconds", "coarse_intervals", "coarse_wall_seconds", "observed_window_seconds"]
    named = {"execution_id": "own.execution_id", "fine_resolution_wall_seconds": "fine_wall_seconds", "maximum_observed_interval_seconds": "longest_interval_seconds", "first_sample_monotonic_ns": "first_sample_ns", "last_sample_monotonic_ns": "last_sample_ns", "fraction_of_observed_window_covered": "window_covered", "mean_busy_logical_cpus": "mean_busy_cpus", "fraction_of_allocated_cpu": "allocated_share", "fraction_of_observed_capacity": "capacity_share"}
    row = F.struct(*same, *[F.col(c).alias(name) for name, c in named.items()])
    lists = both.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("met", "allocation_id", row.alias("row")))).alias("met")).select("session", F.col("met.row").alias("allocations"))
    return telemetry.excluded_samples(resources, "session").join(lists, "session", "left").withColumnRenamed("profile_samples", "profile_samples_excluded")


def session_summaries(sessions: DataFrame, spans: DataFrame, resources: DataFrame, control: DataFrame, cursors: DataFrame, rows: int = ingest.BATCH_ROWS, size: int = ingest.BATCH_BYTES, seconds: float = ingest.BUFFER_SECONDS, constants: dict | None = None) -> DataFrame:
    """session, document: the summary of each row of sessions (session, closed, recorded_until_monotonic_ns) as canonical JSON.

    spans: session, phase, timing_kind, measurement_kind, event_kind, duration_seconds, call_count, warmup and the producer's counters; resources: session and a sample's fields; control: session, event,
    samples_dropped; cursors: session, source, complete_at_observation and what else a committed cursor has. A phase that nobody measured is not in the document, a counter or peak that nobody saw is null, and
    a session without rows has empty objects. rows, size and seconds are the writer's bounds. constants are what every document says beside its numbers (schema, wording of policies), merged object by object.
    Each table is aggregated on its own by session and key; what meets is one row for each session.
    """
    ingest.check_bounds(rows, size, seconds)
    counted = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    cursor = F.struct(*[c for c in cursors.columns if c not in ("session", "source")])
    parts = [
        *_span_blocks(spans), session_coverage(resources), counted(spans, "n_spans"), counted(resources, "n_resources"), counted(control, "n_control"),
        resources.groupBy("session").agg(F.max(F.greatest("rss_bytes", "peak_rss_bytes")).alias("max_observed_rss_bytes")),
        _by_key(control.groupBy("session", F.col("event").alias("key")).agg(F.count("*").alias("n")), control_events=F.col("n")), control.groupBy("session").agg(F.sum("samples_dropped").alias("samples_dropped")),
        _by_key(cursors.select("session", F.col("source").alias("key"), cursor.alias("c")), sources=F.col("c")), telemetry.all_sources_consumed(cursors, "session"),
    ]
    whole = reduce(lambda left, part: left.join(part, "session", "left"), parts, sessions)
    kinds = {f.name: f.dataType for f in whole.schema}
    none = lambda name: F.coalesce(F.col(name), F.create_map().cast(kinds[name])).alias(name)
    zero = lambda name, other=None: F.coalesce(F.col(name), F.lit(0)).alias(other or name)
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("double")
    blocks = {
        "cpu_coverage": [F.coalesce("allocations", F.array().cast(kinds["allocations"])).alias("allocations"), zero("unidentified_samples"), zero("profile_samples_excluded"), unknown.alias("maximum_interval_seconds"), F.lit(telemetry.COARSE_SECONDS).alias("temporal_resolution_target_seconds"), no.alias("missing_is_zero"), yes.alias("intervals_overlap_across_allocations")],
        "phase_attribution": [yes.alias("resource_endpoint_labels_are_not_interval_attribution"), unknown.alias("admission_wait_seconds"), no.alias("missing_counters_are_zero")],
        "measurement_coverage": [none("sources"), F.coalesce(F.try_element_at("control_events", F.lit(CAPTURE_ERROR)), F.lit(0)).alias("capture_error_events"), F.coalesce("all_consumed", yes).alias("all_observed_sources_consumed"), no.alias("jit_separately_measured"), yes.alias("initialization_includes_possible_compilation")],
        "durability": [F.lit(rows).alias("maximum_staged_batch_rows"), F.lit(2 * rows).alias("maximum_synchronous_flush_rows"), F.lit(size).alias("maximum_batch_payload_bytes"), F.lit(seconds).alias("maximum_buffer_seconds"), F.array(*map(F.lit, BARRIERS)).alias("barriers")],
        "science_window_policy": [F.lit(telemetry.WINDOW_SECONDS).alias("period_seconds"), F.lit(rows).alias("maximum_batch_rows"), F.lit(TAIL_SEGMENTS).alias("cutoff_tail_segments_per_table")],
        "rows": [zero("n_control", "control_events"), zero("n_resources", "resources"), zero("n_spans", "spans")],
    }
    maps = ("phase_seconds", "phase_calls", "producer_phase_seconds", "producer_phase_calls", "producer_phase_measurements", "warmup_seconds", "warmup_calls", "intervals_and_delays", "control_events")
    fields = [F.col("session").alias("session_id"), "max_observed_rss_bytes", *map(none, maps), zero("samples_dropped"), yes.alias("phase_sum_is_not_wall_time"), "closed", (~F.col("closed")).alias("uncommitted_resource_batch_at_risk"), "recorded_until_monotonic_ns"]
    return whole.select("session", canonical_json(F.struct(*fields, *[F.struct(*block).alias(name) for name, block in blocks.items()]), constants).alias("document"))
