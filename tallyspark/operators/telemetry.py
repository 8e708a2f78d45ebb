"""Telemetry aggregates over spans, resources and control events. A missing measurement is never a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fields of which a change breaks a counter's continuity.
IDENTITY_FIELDS = ("execution_id", "pid", "process_start_ticks", "clock_domain_id", "cpu_count", "cpu_quota_cores", "cgroup_path", "cgroup_scope")
COARSE_SECONDS = 10.0
WINDOW_SECONDS = 900


def phase_totals(spans: DataFrame) -> DataFrame:
    """Seconds and calls of each `phase:timing_kind`, over spans of kind phase_duration."""
    kept = spans.where(F.col("measurement_kind") == "phase_duration")
    key = F.concat_ws(":", "phase", "timing_kind").alias("phase_key")
    return kept.groupBy(key).agg(F.sum("duration_seconds").alias("duration_seconds"), F.sum("call_count").alias("call_count"))


def warmup_totals(spans: DataFrame) -> DataFrame:
    """phase_totals of warm-up spans alone: only keys that have any."""
    return phase_totals(spans.where("warmup"))


def interval_measurements(spans: DataFrame) -> DataFrame:
    """Number, seconds and longest of the interval and delay spans of each phase; the longest is never below zero."""
    kept = spans.where(F.col("measurement_kind").isin("interval", "delay"))
    return kept.groupBy("phase").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("duration_seconds"), F.greatest(F.max("duration_seconds"), F.lit(0.0)).alias("longest_seconds"))


def boundary_measurements(spans: DataFrame, *keys: str) -> DataFrame:
    """Producer measurements at the ends of phases, for each phase or value of keys: calls are events; each counter's sum is null where nobody measured it, and has its own calls and seconds."""
    ends = spans.where((F.col("measurement_kind") == "phase_boundary") & (F.col("event_kind") == "end"))
    measured = []
    for name in ("process_cpu_seconds", "gc_seconds", "allocated_bytes"):
        seconds = F.sum(F.when(F.col(name).isNotNull(), F.col("duration_seconds")))
        measured += [F.sum(name).alias(name), F.count(name).alias(f"{name}_calls"), F.coalesce(seconds, F.lit(0.0)).alias(f"{name}_wall")]
    return ends.groupBy(*(keys or ("phase",))).agg(F.count("*").alias("calls"), F.sum("duration_seconds").alias("wall_seconds"), *measured)


def control_counts(events: DataFrame) -> DataFrame:
    """Number of each control event, and samples that it reports as dropped (null: none)."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.coalesce(F.sum("samples_dropped"), F.lit(0)).alias("samples_dropped"))


def peak_rss(resources: DataFrame) -> DataFrame:
    """The largest resident size that any sample or retained peak has; null if none has one."""
    return resources.agg(F.max(F.greatest("rss_bytes", "peak_rss_bytes")).alias("peak_rss_bytes"))


def table_row_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each named table, from one union of counts."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def all_sources_consumed(cursors: DataFrame, *keys: str) -> DataFrame:
    """Whether each group's sources were all complete at observation: a null is not, no source at all is."""
    return cursors.groupBy(*keys).agg(F.coalesce(F.bool_and(F.coalesce("complete_at_observation", F.lit(False))), F.lit(True)).alias("all_consumed"))


def _is_gap() -> Column:
    unknown = F.col("cpu_time_seconds").isNull() | F.col("monotonic_ns").isNull()
    return unknown | (F.coalesce("cpu_count", F.lit(0)) == 0) | (F.coalesce("missing_reason", F.lit("")) != "")


def cpu_coverage(resources: DataFrame, *keys: str) -> DataFrame:
    """What each allocation's cumulative CPU counter covers, in order of arrival (sample_sequence); with keys (a session, say) for each of their values.

    A sample without counter, stamp or width, or with a reason, is missing and ends a run. A sample not later than the latest
    one of its run is late: it is counted, and the next one is measured from the latest. An interval with a falling counter or another identity
    is discontinuous. All others are valid; those over COARSE_SECONDS are coarse. Profile samples and those without an allocation are left out.
    """
    kept = resources.where(~F.col("sampling_mode").eqNullSafe("profile_window") & (F.coalesce("allocation_id", F.lit("")) != ""))
    arrival = W.partitionBy(*keys, "allocation_id").orderBy("sample_sequence")
    run = W.partitionBy(*keys, "allocation_id", "run").orderBy("sample_sequence")
    chain = W.partitionBy(*keys, "allocation_id", "run", "kind").orderBy("sample_sequence")
    rows = kept.withColumn("gap", _is_gap()).withColumn("run", F.sum(F.col("gap").cast("int")).over(arrival))
    rows = rows.withColumn("latest", F.max(F.when(~F.col("gap"), F.col("monotonic_ns"))).over(run.rowsBetween(W.unboundedPreceding, -1)))
    kind = F.when(F.col("gap"), 0).when(F.col("latest").isNotNull() & (F.col("monotonic_ns") <= F.col("latest")), 1).otherwise(2)
    rows = rows.withColumn("kind", kind)
    before = F.lag(F.struct("monotonic_ns", "cpu_time_seconds", *IDENTITY_FIELDS)).over(chain)
    rows = rows.withColumn("before", F.when(F.col("kind") == 2, before))
    same = F.lit(True)
    for name in IDENTITY_FIELDS:
        same = same & F.col(name).eqNullSafe(F.col("before").getField(name))
    cpu = F.col("cpu_time_seconds") - F.col("before.cpu_time_seconds")
    wall = (F.col("monotonic_ns") - F.col("before.monotonic_ns")) / F.lit(1e9)
    rows = rows.withColumn("valid", F.col("before").isNotNull() & (cpu >= 0) & same)
    rows = rows.withColumn("wall", F.when(F.col("valid"), wall)).withColumn("cpu", F.when(F.col("valid"), cpu))
    width = F.least("cpu_count", F.coalesce("cpu_quota_cores", "cpu_count"))
    stamped = F.col("monotonic_ns").isNotNull()
    seen = F.when(F.col("kind") == 1, F.col("latest")).otherwise(F.col("monotonic_ns"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    coarse = F.col("wall") > COARSE_SECONDS
    return rows.groupBy(*keys, "allocation_id").agg(
        F.count("*").alias("samples"),
        F.count_if("valid").alias("valid_intervals"),
        F.count_if("gap").alias("missing_samples"),
        F.count_if((F.col("kind") == 1) | (F.col("before").isNotNull() & ~F.col("valid"))).alias("discontinuous_intervals"),
        F.count_if(coarse).alias("coarse_intervals"),
        zero(F.sum("wall")).alias("covered_wall_seconds"),
        zero(F.sum("cpu")).alias("cpu_seconds"),
        zero(F.sum(F.col("wall") * F.col("cpu_count"))).alias("allocated_cpu_seconds"),
        zero(F.sum(F.col("wall") * width)).alias("observed_capacity_cpu_seconds"),
        zero(F.sum(F.when(coarse, F.col("wall")))).alias("coarse_wall_seconds"),
        zero(F.sum(F.when(~coarse, F.col("wall")))).alias("fine_wall_seconds"),
        F.max("wall").alias("longest_interval_seconds"),
        F.min_by("monotonic_ns", F.when(stamped, F.col("sample_sequence"))).alias("first_sample_ns"),
        F.max_by(seen, F.when(stamped, F.col("sample_sequence"))).alias("last_sample_ns"),
    )


def excluded_samples(resources: DataFrame, *keys: str) -> DataFrame:
    """For each value of keys, samples that cpu_coverage leaves out: profile samples, and others without an allocation."""
    profile = F.col("sampling_mode").eqNullSafe("profile_window")
    return resources.groupBy(*keys).agg(F.count_if(profile).alias("profile_samples"), F.count_if(~profile & (F.coalesce("allocation_id", F.lit("")) == "")).alias("unidentified_samples"))


def coverage_ratios(coverage: DataFrame, *keys: str) -> DataFrame:
    """Shares of cpu_coverage's rows, by the same keys; null wherever the denominator is unknown or zero."""
    window = (F.col("last_sample_ns") - F.col("first_sample_ns")) / F.lit(1e9)
    share = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return coverage.select(
        *keys,
        "allocation_id",
        window.alias("observed_window_seconds"),
        F.when(window > 0, F.col("covered_wall_seconds") / window).alias("window_covered"),
        share("cpu_seconds", "covered_wall_seconds").alias("mean_busy_cpus"),
        share("cpu_seconds", "allocated_cpu_seconds").alias("allocated_share"),
        share("cpu_seconds", "observed_capacity_cpu_seconds").alias("capacity_share"),
    )


def science_windows(batches: DataFrame, transitions: DataFrame) -> DataFrame:
    """batches (session, table_name, batch, closed_seconds, requested) of resources, spans and control_events with bucket and science_window.

    A batch was asked for, or holds control events; or it is its table's first in a bucket of WINDOW_SECONDS; or it is the first of its table to close at or after a transition
    (session, batch: those that close with it have this number) and the first of all. A transition at which nothing closes so promotes the next batch, whenever it closes.
    """
    bucket = F.floor(F.col("closed_seconds") / WINDOW_SECONDS).cast("long")
    rows = batches.select("session", "table_name", "batch", bucket.alias("bucket"), F.coalesce("requested", F.lit(False)).alias("requested"), F.lit(1).alias("kind"))
    marks = transitions.select("session", F.lit(None).cast("string").alias("table_name"), "batch", F.lit(None).cast("long").alias("bucket"), F.lit(False).alias("requested"), F.lit(0).alias("kind"))
    seen = F.sum(1 - F.col("kind")).over(W.partitionBy("session").orderBy("batch", "kind"))
    rows = rows.union(marks).withColumn("seen", seen).where("kind = 1")
    order = W.partitionBy("session", "table_name").orderBy("batch")
    first = F.row_number().over(W.partitionBy("session", "table_name", "bucket").orderBy("batch")) == 1
    fresh = F.col("table_name").isin("resources", "spans") & (first | ~F.lag("seen").over(order).eqNullSafe(F.col("seen")))
    window = F.col("requested") | (F.col("table_name") == "control_events") | fresh
    return rows.select("session", "table_name", "batch", "bucket", window.alias("science_window"))


#: Defaults of a span's optional fields and what its enumerations allow.
SPAN_DEFAULTS = {"timing_kind": "inclusive", "call_count": 1, "warmup": False, "measurement_kind": "phase_duration", "timestamp_kind": "measurement"}
TIMING_KINDS = ("inclusive", "exclusive")
MEASUREMENT_KINDS = ("phase_duration", "interval", "delay", "phase_boundary")


def normalised_spans(spans: DataFrame, identity: dict[str, str]) -> DataFrame:
    """spans with defaults in place of columns that they lack (a null that is there stays), and identity fields of the session."""
    out = spans
    for name, value in {**SPAN_DEFAULTS, **identity}.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


def span_violations(spans: DataFrame, key: str) -> DataFrame:
    """(key, rule) for each rule that a span breaks: required fields, finite and non-negative numbers, enumerations."""
    duration = F.col("duration_seconds")
    rules = {
        "phase_required": F.col("phase").isNull(),
        "duration_required": duration.isNull(),
        "duration_range": duration.isNotNull() & (F.isnan(duration) | (duration < 0) | (duration == float("inf"))),
        "call_count_range": F.col("call_count") < 0,
        "timing_kind": ~F.col("timing_kind").isin(*TIMING_KINDS),
        "measurement_kind": ~F.col("measurement_kind").isin(*MEASUREMENT_KINDS),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return spans.select(F.col(key), F.explode(broken).alias("rule"))


def unknown_fields(df: DataFrame, contract: list[str]) -> list[str]:
    """Columns that a closed contract does not know, by name; reading is refused if there are any."""
    return sorted(set(df.columns) - set(contract))
