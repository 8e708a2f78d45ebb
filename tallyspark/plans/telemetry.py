"""Queries over telemetry operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import telemetry as ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def epoch_us(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_returnflag").alias("phase"),
        F.col("l_linestatus").alias("timing_kind"),
        F.lit("phase_duration").alias("measurement_kind"),
        F.col("l_quantity").alias("duration_seconds"),
        F.col("l_linenumber").cast("long").alias("call_count"),
        (F.col("l_tax") == 0).alias("warmup"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_resources(table(spark, sf_dir, "events"))


def as_resources(events: DataFrame, *more: Column) -> DataFrame:
    """Events as samples of 20 allocations, with more columns of theirs: counters that fall every 500 events, gaps, late stamps, changes of width, profile samples."""
    n = F.col("event_id")
    every = lambda k: n % k == 0
    return events.select(
        *more,
        n.alias("sample_sequence"),
        F.when(~every(31), F.concat(F.lit("a"), F.col("user_id") % 20)).alias("allocation_id"),
        F.when(~every(41), (epoch_us("ts") - F.when(every(11), 7_200_000_000).otherwise(0)) * 1000).alias("monotonic_ns"),
        F.when(~every(13), (n % 500) * F.lit(0.5)).alias("cpu_time_seconds"),
        (F.lit(8) + n.cast("long") % 3000 - n % 1500).cast("long").alias("cpu_count"),
        F.lit(4.0).alias("cpu_quota_cores"),
        F.when(every(37), F.lit("unreadable")).alias("missing_reason"),
        F.when(every(29), F.lit("profile_window")).otherwise(F.lit("baseline")).alias("sampling_mode"),
        F.floor(n / 700).cast("long").alias("pid"),
        F.lit("e").alias("execution_id"),
        F.lit(1).cast("long").alias("process_start_ticks"),
        F.lit("boot").alias("clock_domain_id"),
        F.lit(None).cast("string").alias("cgroup_path"),
        F.lit("node").alias("cgroup_scope"),
        F.when(~every(3), n * 10).alias("rss_bytes"),
        F.when(every(5), n * 11).alias("peak_rss_bytes"),
    )


RESOURCES_SQL = """
    r AS (
        SELECT event_id AS seq, CASE WHEN event_id % 31 <> 0 THEN 'a' || (user_id % 20) END AS alloc,
               CASE WHEN event_id % 41 <> 0 THEN (epoch_us(ts) - CASE WHEN event_id % 11 = 0 THEN 7200000000 ELSE 0 END) * 1000 END AS stamp,
               CASE WHEN event_id % 13 <> 0 THEN (event_id % 500) * CAST(0.5 AS DOUBLE) END AS cpu,
               8 + event_id % 3000 - event_id % 1500 AS width, 4.0::DOUBLE AS quota,
               CASE WHEN event_id % 37 = 0 THEN 'unreadable' END AS reason, event_id % 29 = 0 AS profile, event_id // 700 AS pid
        FROM events
    )"""
COVERAGE_SQL = f"""{RESOURCES_SQL},
    b AS (SELECT *, cpu IS NULL OR stamp IS NULL OR width = 0 OR reason IS NOT NULL AS gap FROM r WHERE NOT profile AND alloc IS NOT NULL),
    c AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY alloc ORDER BY seq) AS run FROM b),
    d AS (SELECT *, max(CASE WHEN NOT gap THEN stamp END) OVER (PARTITION BY alloc, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM c),
    e AS (SELECT *, CASE WHEN gap THEN 0 WHEN stamp <= hi THEN 1 ELSE 2 END AS kind FROM d),
    f AS (SELECT *, lag(stamp) OVER w AS p_stamp, lag(cpu) OVER w AS p_cpu, lag(width) OVER w AS p_width, lag(pid) OVER w AS p_pid FROM e
          WINDOW w AS (PARTITION BY alloc, run, kind ORDER BY seq)),
    g AS (SELECT *, kind = 2 AND p_stamp IS NOT NULL AS has, kind = 2 AND p_stamp IS NOT NULL AND cpu >= p_cpu AND width = p_width AND pid = p_pid AS valid FROM f),
    h AS (SELECT *, CASE WHEN valid THEN (stamp - p_stamp) / 1e9::DOUBLE END AS wall, CASE WHEN valid THEN cpu - p_cpu END AS used FROM g),
    cov AS (SELECT alloc AS allocation_id, count(*) AS samples, count_if(valid)::BIGINT AS valid_intervals, count_if(gap)::BIGINT AS missing_samples,
               count_if(kind = 1 OR (has AND NOT valid))::BIGINT AS discontinuous_intervals, count_if(wall > 10)::BIGINT AS coarse_intervals,
               coalesce(sum(wall), 0) AS covered_wall_seconds, coalesce(sum(used), 0) AS cpu_seconds, coalesce(sum(wall * width), 0) AS allocated_cpu_seconds,
               coalesce(sum(wall * least(width, quota)), 0) AS observed_capacity_cpu_seconds, coalesce(sum(CASE WHEN wall > 10 THEN wall END), 0) AS coarse_wall_seconds,
               coalesce(sum(CASE WHEN wall <= 10 THEN wall END), 0) AS fine_wall_seconds, max(wall) AS longest_interval_seconds,
               arg_min(stamp, seq) FILTER (stamp IS NOT NULL) AS first_sample_ns, arg_max(CASE WHEN kind = 1 THEN hi ELSE stamp END, seq) FILTER (stamp IS NOT NULL) AS last_sample_ns
        FROM h GROUP BY alloc)"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no errors close a batch of a table of their user's session."""
    tables = F.array(F.lit("resources"), F.lit("spans"), F.lit("control_events"))
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select(
        (F.col("user_id") % 5).alias("session"),
        F.element_at(tables, F.when(F.col("event_id") % 97 == 0, 3).otherwise((F.col("user_id") % 2 + 1).cast("int"))).alias("table_name"),
        F.col("event_id").alias("batch"),
        (F.col("event_id") * 30).cast("double").alias("closed_seconds"),
        (F.col("event_id") % 101 == 0).alias("requested"),
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are the transitions, half of them of a number that a batch of the session may have."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("session"), (F.col("event_id") + F.col("event_id") % 2).alias("batch"))


def boundary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("phase"),
        F.lit("phase_boundary").alias("measurement_kind"),
        F.when(F.col("l_linestatus") == "F", "end").otherwise("start").alias("event_kind"),
        F.col("l_quantity").alias("duration_seconds"),
        F.when(line % 3 != 0, F.col("l_quantity")).alias("process_cpu_seconds"),
        F.when(line % 2 != 0, F.col("l_quantity")).alias("gc_seconds"),
        F.when(line > 100, line.cast("long")).alias("allocated_bytes"),
    )


def checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 17 != 0, F.col("event_type")).alias("phase"),
        F.when(n % 19 == 0, -F.col("value")).when(n % 23 == 0, F.lit(float("nan"))).when(n % 29 != 0, F.col("value")).alias("duration_seconds"),
        F.when(n % 31 == 0, -1).otherwise(1).alias("call_count"),
        F.when(n % 37 == 0, "other").otherwise("inclusive").alias("timing_kind"),
        F.lit("interval").alias("measurement_kind"),
    )


QUERIES = {
    "span_phase_totals": lambda s, d: ops.phase_totals(spans(s, d)),
    "span_warmup_totals": lambda s, d: ops.warmup_totals(spans(s, d)),
    "interval_measurements": lambda s, d: rounded(ops.interval_measurements(table(s, d, "events").select(F.col("event_type").alias("phase"), F.when(F.col("event_id") % 2 == 0, "interval").otherwise("delay").alias("measurement_kind"), F.col("value").alias("duration_seconds")))),
    "producer_phase_measurements": lambda s, d: ops.boundary_measurements(boundary_spans(s, d)),
    "control_event_counts": lambda s, d: ops.control_counts(table(s, d, "events").select(F.col("event_type").alias("event"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).alias("samples_dropped"))),
    "peak_rss": lambda s, d: ops.peak_rss(resources(s, d)),
    "table_row_counts": lambda s, d: ops.table_row_counts(**{t: table(s, d, t) for t in ("lineitem", "orders", "events")}),
    "sources_all_consumed": lambda s, d: ops.all_sources_consumed(table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") == "F").alias("complete_at_observation")), "o_custkey"),
    "cpu_coverage": lambda s, d: rounded(ops.cpu_coverage(resources(s, d))),
    "cpu_coverage_excluded": lambda s, d: ops.excluded_samples(resources(s, d)),
    "cpu_coverage_ratios": lambda s, d: rounded(ops.coverage_ratios(ops.cpu_coverage(resources(s, d)))),
    "science_windows": lambda s, d: ops.science_windows(batches(s, d), transitions(s, d)),
    "normalise_violations": lambda s, d: ops.span_violations(checked_spans(s, d), "event_id"),
}

ROUNDED = "valid_intervals, missing_samples, discontinuous_intervals, coarse_intervals, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("covered_wall_seconds", "cpu_seconds", "allocated_cpu_seconds", "observed_capacity_cpu_seconds", "coarse_wall_seconds", "fine_wall_seconds", "longest_interval_seconds"))

SQL = {
    "span_phase_totals": """
        SELECT l_returnflag || ':' || l_linestatus AS phase_key, sum(l_quantity) AS duration_seconds, CAST(sum(l_linenumber) AS BIGINT) AS call_count
        FROM lineitem GROUP BY 1""",
    "span_warmup_totals": """
        SELECT l_returnflag || ':' || l_linestatus AS phase_key, sum(l_quantity) AS duration_seconds, CAST(sum(l_linenumber) AS BIGINT) AS call_count
        FROM lineitem WHERE l_tax = 0 GROUP BY 1""",
    "interval_measurements": """
        SELECT event_type AS phase, count(*) AS n, round(sum(value), 6) AS duration_seconds, round(greatest(max(value), 0), 6) AS longest_seconds FROM events GROUP BY 1""",
    "producer_phase_measurements": """
        WITH b AS (SELECT l_returnflag AS phase, l_quantity AS q, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS cpu,
                          CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS gc, CASE WHEN l_linenumber > 100 THEN l_linenumber END AS mem FROM lineitem WHERE l_linestatus = 'F')
        SELECT phase, count(*) AS calls, sum(q) AS wall_seconds,
               sum(cpu) AS process_cpu_seconds, count(cpu) AS process_cpu_seconds_calls, coalesce(sum(CASE WHEN cpu IS NOT NULL THEN q END), 0) AS process_cpu_seconds_wall,
               sum(gc) AS gc_seconds, count(gc) AS gc_seconds_calls, coalesce(sum(CASE WHEN gc IS NOT NULL THEN q END), 0) AS gc_seconds_wall,
               CAST(sum(mem) AS BIGINT) AS allocated_bytes, count(mem) AS allocated_bytes_calls, coalesce(sum(CASE WHEN mem IS NOT NULL THEN q END), 0) AS allocated_bytes_wall
        FROM b GROUP BY phase""",
    "control_event_counts": """
        SELECT event_type AS event, count(*) AS n, CAST(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 5 END), 0) AS BIGINT) AS samples_dropped FROM events GROUP BY 1""",
    "peak_rss": """
        SELECT max(greatest(CASE WHEN event_id % 3 <> 0 THEN event_id * 10 END, CASE WHEN event_id % 5 = 0 THEN event_id * 11 END)) AS peak_rss_bytes FROM events""",
    "table_row_counts": """
        SELECT 'lineitem' AS table_name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events""",
    "sources_all_consumed": """
        SELECT o_custkey, bool_and(coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'F' END, false)) AS all_consumed FROM orders GROUP BY 1""",
    "cpu_coverage": f"WITH {COVERAGE_SQL} SELECT allocation_id, samples, {ROUNDED}, first_sample_ns, last_sample_ns FROM cov",
    "cpu_coverage_excluded": f"WITH {RESOURCES_SQL} SELECT count_if(profile)::BIGINT AS profile_samples, count_if(NOT profile AND alloc IS NULL)::BIGINT AS unidentified_samples FROM r",
    "cpu_coverage_ratios": f"""
        WITH {COVERAGE_SQL}, x AS (SELECT *, (last_sample_ns - first_sample_ns) / 1e9::DOUBLE AS w FROM cov)
        SELECT allocation_id, round(w, 6) AS observed_window_seconds, round(CASE WHEN w > 0 THEN covered_wall_seconds / w END, 6) AS window_covered,
               round(cpu_seconds / nullif(covered_wall_seconds, 0), 6) AS mean_busy_cpus, round(cpu_seconds / nullif(allocated_cpu_seconds, 0), 6) AS allocated_share,
               round(cpu_seconds / nullif(observed_capacity_cpu_seconds, 0), 6) AS capacity_share FROM x""",
    "science_windows": """
        WITH b AS (SELECT user_id % 5 AS session, CASE WHEN event_id % 97 = 0 THEN 'control_events' WHEN user_id % 2 = 0 THEN 'resources' ELSE 'spans' END AS table_name, event_id AS batch, event_id * 30 // 900 AS bucket, event_id % 101 = 0 AS requested FROM events WHERE event_type <> 'error'),
        t AS (SELECT user_id % 5 AS session, event_id + event_id % 2 AS batch FROM events WHERE event_type = 'error'),
        p AS (SELECT *, lag(batch) OVER (PARTITION BY session, table_name ORDER BY batch) AS before, row_number() OVER (PARTITION BY session, table_name, bucket ORDER BY batch) AS place FROM b),
        x AS (SELECT p.*, EXISTS (SELECT 1 FROM t WHERE t.session = p.session AND t.batch <= p.batch AND t.batch > p.before) AS after FROM p)
        SELECT session, table_name, batch, bucket, requested OR table_name = 'control_events' OR (table_name IN ('resources', 'spans') AND (place = 1 OR after OR before IS NULL)) AS science_window FROM x""",
    "normalise_violations": """
        WITH b AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS phase,
                          CASE WHEN event_id % 19 = 0 THEN -value WHEN event_id % 23 = 0 THEN 'nan'::DOUBLE WHEN event_id % 29 <> 0 THEN value END AS d,
                          event_id % 31 = 0 AS negative, event_id % 37 = 0 AS other FROM events)
        SELECT event_id, 'phase_required' AS rule FROM b WHERE phase IS NULL
        UNION ALL SELECT event_id, 'duration_required' FROM b WHERE d IS NULL
        UNION ALL SELECT event_id, 'duration_range' FROM b WHERE d IS NOT NULL AND (isnan(d) OR d < 0 OR isinf(d))
        UNION ALL SELECT event_id, 'call_count_range' FROM b WHERE negative
        UNION ALL SELECT event_id, 'timing_kind' FROM b WHERE other""",
}
