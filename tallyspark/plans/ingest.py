"""Queries over telemetry ingest: users are sessions, events arrive in order of their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ingest as ops
from tallyspark.operators import summaries, telemetry
from tallyspark.plans.telemetry import COVERAGE_SQL, ROUNDED, as_resources, epoch_us, rounded, table

ROWS, BYTES, SECONDS = 20, 2_000, 40_000.0


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").withColumn("props", F.when(n % 71 == 0, F.lpad("props", 3_000, "é")).when(n % 9 != 0, F.col("props")))
    return events.select((F.col("user_id") % 20).alias("session"), n.alias("arrival"), F.when(F.col("event_type") == "error", "control_events").otherwise("spans").alias("table_name"), (epoch_us("ts") / 1e6).alias("at"), ops.row_bytes(events, ["event_type", "props", "value", "user_id"]).alias("bytes"), (F.col("event_type") == "error").alias("control"), "value")


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bounded_batches(rows(spark, sf_dir), ROWS, BYTES, SECONDS)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event moves one of its session's three sources on; ten events are a batch."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), (n % 3).alias("source"), F.floor(n / 10).alias("batch"), (n * 64).alias("offset"))


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed are the batches before a session's middle one."""
    return staged(spark, sf_dir).groupBy("session").agg(F.floor(F.max("batch") / 2).alias("batch"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("session"), F.floor(n / 10).alias("batch"), n.alias("arrival"), F.when(n % 37 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"))


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    has = [F.when(n % (i + 2) == 0, F.lit(f)) for i, f in enumerate(ops.HARDWARE_FIELDS)]
    return table(spark, sf_dir, "customer").select(n.alias("session"), F.map_from_entries(F.transform(F.array_compact(F.array(*has)), lambda k: F.struct(k, F.lit("x")))).alias("hardware"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    kind = F.when(line % 4 == 0, "interval").when(line % 4 == 1, "delay").otherwise("phase_duration")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("session"), F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("timing_kind"), kind.alias("measurement_kind"), F.col("l_quantity").alias("duration_seconds"), line.cast("long").alias("call_count"), (F.col("l_tax") == 0).alias("warmup"))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("session"), F.when(n % 3 != 0, n * 10).alias("rss_bytes"), F.when(n % 5 == 0, n * 11).alias("peak_rss_bytes"))


def _control(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where("user_id % 6 <> 2").select((F.col("user_id") % 6).alias("session"), F.col("event_type").alias("event"), F.when(n % 3 == 0, n % 5).alias("samples_dropped"))


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("session"), F.when(F.col("s_suppkey") % 7 != 3, F.col("s_suppkey") % 4 != 1).alias("complete_at_observation"))


def _whole_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans of three kinds; half of the boundaries are ends."""
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    kind = F.when(line % 4 == 0, "interval").when(line % 4 == 1, "phase_boundary").otherwise("phase_duration")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("session"), F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("timing_kind"), kind.alias("measurement_kind"),
        F.when(F.col("l_partkey") % 2 == 0, "end").otherwise("begin").alias("event_kind"), q.alias("duration_seconds"), line.cast("long").alias("call_count"), (F.col("l_tax") == 0).alias("warmup"),
        F.when(F.col("l_suppkey") % 3 != 0, q).alias("process_cpu_seconds"), F.when(F.col("l_partkey") % 3 == 0, q).alias("gc_seconds"), F.when(line > 4, line.cast("long")).alias("allocated_bytes"),
    )


def _whole_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_resources(table(spark, sf_dir, "events"), (F.col("user_id") % 6).alias("session"))


def _whole_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((n % 4).alias("session"), F.col("s_name").alias("source"), F.when(n % 7 != 3, n % 4 != 1).alias("complete_at_observation"), (n * 64).cast("long").alias("offset"))


def whole_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each rest of a user's number, the odd ones closed."""
    user = F.col("user_id") % 6
    sessions = table(spark, sf_dir, "events").groupBy(user.alias("session")).agg(F.max("event_id").cast("long").alias("recorded_until_monotonic_ns")).withColumn("closed", F.col("session") % 2 == 1)
    return summaries.session_summaries(sessions, _whole_spans(spark, sf_dir), _whole_resources(spark, sf_dir), _control(spark, sf_dir), _whole_cursors(spark, sf_dir))


QUERIES = {
    "payload_bytes": lambda s, d: rows(s, d).select("arrival", "bytes"),
    "sample_sequences": lambda s, d: ops.sequenced(rows(s, d), F.col("value") < 150).select("session", "table_name", "arrival", "sample_sequence"),
    "bounded_batches": batched,
    "atomic_ingest": lambda s, d: ops.atomic_batches(ingested(s, d), ingested(s, d).where("value < 0"), ["session", "batch"]).select("arrival"),
    "committed_cursors": lambda s, d: ops.committed_cursors(staged(s, d), watermarks(s, d)),
    "replayed_rows": lambda s, d: ops.to_replay(staged(s, d).drop("batch"), ops.committed_cursors(staged(s, d), watermarks(s, d))),
    "retried_rows": lambda s, d: ops.retried(ingested(s, d).where("arrival % 4 <> 0").select("session", "arrival"), ingested(s, d).where("arrival % 3 = 0").select("session", "arrival").union(ingested(s, d).where("arrival % 6 = 0").select("session", "arrival")), ["session", "arrival"]),
    "committed_prefix": lambda s, d: ops.prefix(staged(s, d), watermarks(s, d)).groupBy("session").agg(F.count("*").alias("n"), F.max("offset").alias("last")),
    "session_registry": lambda s, d: ops.registered(table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session"), F.lit("old").alias("pointer")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("session"), F.lit("new").alias("pointer"))),
    "missing_hardware": lambda s, d: ops.missing_hardware(passports(s, d)),
    "session_documents": lambda s, d: ops.summary_documents(_spans(s, d), _resources(s, d), _control(s, d), _cursors(s, d)),
    "whole_session_summaries": whole_summaries,
    "session_cpu_coverage": lambda s, d: rounded(telemetry.cpu_coverage(_whole_resources(s, d), "session"), 3),
    "session_coverage_ratios": lambda s, d: rounded(telemetry.coverage_ratios(telemetry.cpu_coverage(_whole_resources(s, d), "session"), "session")),
    "session_excluded_samples": lambda s, d: telemetry.excluded_samples(_whole_resources(s, d), "session"),
    "session_producer_phases": lambda s, d: telemetry.boundary_measurements(_whole_spans(s, d), "session", "phase", "timing_kind"),
}

_EVENTS = """e AS (SELECT user_id % 20 AS session, event_id AS arrival, event_type = 'error' AS control, epoch_us(ts) / 1e6::DOUBLE AS secs, value,
    octet_length(encode(event_type)) + 16 + CASE WHEN event_id % 71 = 0 THEN (3000 - length(props)) * 2 + octet_length(encode(props)) WHEN event_id % 9 <> 0 THEN octet_length(encode(props)) ELSE 8 END AS bytes FROM events)"""
_STAGED = "s AS (SELECT user_id % 20 AS session, event_id % 3 AS source, event_id // 10 AS batch, event_id * 64 AS off FROM events), w AS (SELECT session, max(batch) // 2 AS done FROM s GROUP BY 1), k AS (SELECT session, source, max(off) AS off FROM s JOIN w USING (session) WHERE batch <= done GROUP BY 1, 2)"

#: Allocations of different sessions under names of their own, so that the same steps as for one session serve.
_BY_SESSION = COVERAGE_SQL.replace("'a' || (user_id % 20)", "(user_id % 6) || ':a' || (user_id % 20)")
_SESSION = "CAST(split_part(allocation_id, ':', 1) AS BIGINT) AS session, split_part(allocation_id, ':', 2) AS allocation_id"

SQL = {
    "session_cpu_coverage": f"WITH {_BY_SESSION} SELECT {_SESSION}, samples, {ROUNDED.replace(", 6)", ", 3)")}, first_sample_ns, last_sample_ns FROM cov",
    "session_coverage_ratios": f"""
        WITH {_BY_SESSION}, x AS (SELECT *, (last_sample_ns - first_sample_ns) / 1e9::DOUBLE AS w FROM cov)
        SELECT {_SESSION}, round(w, 6) AS observed_window_seconds, round(CASE WHEN w > 0 THEN covered_wall_seconds / w END, 6) AS window_covered,
               round(cpu_seconds / nullif(covered_wall_seconds, 0), 6) AS mean_busy_cpus, round(cpu_seconds / nullif(allocated_cpu_seconds, 0), 6) AS allocated_share,
               round(cpu_seconds / nullif(observed_capacity_cpu_seconds, 0), 6) AS capacity_share FROM x""",
    "session_excluded_samples": "SELECT user_id % 6 AS session, count_if(event_id % 29 = 0)::BIGINT AS profile_samples, count_if(event_id % 29 <> 0 AND event_id % 31 = 0)::BIGINT AS unidentified_samples FROM events GROUP BY 1",
    "session_producer_phases": """
        WITH b AS (SELECT l_suppkey % 5 AS session, l_returnflag AS phase, l_linestatus AS timing_kind, l_quantity AS q, CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity END AS cpu,
                          CASE WHEN l_partkey % 3 = 0 THEN l_quantity END AS gc, CASE WHEN l_linenumber > 4 THEN l_linenumber END AS mem FROM lineitem WHERE l_linenumber % 4 = 1 AND l_partkey % 2 = 0)
        SELECT session, phase, timing_kind, count(*) AS calls, sum(q) AS wall_seconds,
               sum(cpu) AS process_cpu_seconds, count(cpu) AS process_cpu_seconds_calls, coalesce(sum(CASE WHEN cpu IS NOT NULL THEN q END), 0) AS process_cpu_seconds_wall,
               sum(gc) AS gc_seconds, count(gc) AS gc_seconds_calls, coalesce(sum(CASE WHEN gc IS NOT NULL THEN q END), 0) AS gc_seconds_wall,
               CAST(sum(mem) AS BIGINT) AS allocated_bytes, count(mem) AS allocated_bytes_calls, coalesce(sum(CASE WHEN mem IS NOT NULL THEN q END), 0) AS allocated_bytes_wall
        FROM b GROUP BY ALL""",
    "payload_bytes": f"WITH {_EVENTS} SELECT arrival, bytes::BIGINT AS bytes FROM e",
    "sample_sequences": f"WITH {_EVENTS}, q AS (SELECT session, CASE WHEN control THEN 'control_events' ELSE 'spans' END AS table_name, arrival, value, row_number() OVER (PARTITION BY session, control ORDER BY arrival) - 1 AS sample_sequence FROM e) SELECT session, table_name, arrival, sample_sequence FROM q WHERE value < 150",
    "bounded_batches": f"""
        WITH RECURSIVE {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY arrival) AS rn FROM e WHERE bytes <= {BYTES}),
        f AS (SELECT session, arrival, rn, 0::BIGINT AS batch, CASE WHEN control THEN 0 ELSE 1 END AS held, bytes AS size, secs AS since, CASE WHEN control THEN 1 ELSE 0 END::BIGINT AS next FROM n WHERE rn = 1
              UNION ALL SELECT n.session, n.arrival, n.rn, f.next + x.close, CASE WHEN n.control THEN 0 WHEN x.close = 1 OR f.held = 0 THEN 1 ELSE f.held + 1 END, CASE WHEN x.close = 1 OR f.held = 0 THEN n.bytes ELSE f.size + n.bytes END,
                               CASE WHEN x.close = 1 OR f.held = 0 THEN n.secs ELSE f.since END, f.next + x.close + CASE WHEN n.control THEN 1 ELSE 0 END
              FROM f JOIN n ON n.session = f.session AND n.rn = f.rn + 1, LATERAL (SELECT CASE WHEN f.held > 0 AND (f.held + 1 > {ROWS} OR f.size + n.bytes > {BYTES} OR n.secs - f.since >= {SECONDS}) THEN 1 ELSE 0 END AS close) x)
        SELECT session, arrival, batch FROM f UNION ALL SELECT session, arrival, NULL FROM e WHERE bytes > {BYTES}""",
    "atomic_ingest": "SELECT event_id AS arrival FROM events WHERE (user_id % 20, event_id // 10) NOT IN (SELECT (user_id % 20, event_id // 10) FROM events WHERE event_id % 37 = 0 AND value > 0)",
    "committed_cursors": f'WITH {_STAGED} SELECT session, source, off AS "offset" FROM k',
    "replayed_rows": f'WITH {_STAGED} SELECT s.session, s.source, s.off AS "offset" FROM s LEFT JOIN k ON k.session = s.session AND k.source = s.source WHERE k.off IS NULL OR s.off > k.off',
    "retried_rows": "SELECT user_id % 20 AS session, event_id AS arrival FROM events WHERE event_id % 3 = 0 AND event_id % 4 = 0",
    "committed_prefix": f'WITH {_STAGED} SELECT session, count(*) AS n, max(off) AS "last" FROM s JOIN w USING (session) WHERE batch <= done GROUP BY 1',
    "session_registry": "SELECT c_custkey AS session, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS pointer FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0",
    "missing_hardware": "SELECT c_custkey AS session, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN c_custkey % {i + 2} <> 0 THEN '{f}' END" for i, f in enumerate(ops.HARDWARE_FIELDS)) + "], lambda x: x IS NOT NULL)), ',') AS missing FROM customer",
    "session_documents": """
        WITH sp AS (SELECT l_suppkey % 5 AS session, l_returnflag AS phase, l_returnflag || ':' || l_linestatus AS key, CASE l_linenumber % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'd' ELSE 'p' END AS kind, l_quantity AS q, l_linenumber AS n, l_tax = 0 AS warm FROM lineitem),
        ph AS (SELECT session, key, sum(q) AS s, sum(n)::BIGINT AS n, count_if(warm) AS warm, sum(q) FILTER (warm) AS ws FROM sp WHERE kind = 'p' GROUP BY 1, 2),
        iv AS (SELECT session, phase AS key, {'count': count(*), 'max_seconds': greatest(max(q), 0), 'total_seconds': sum(q)} AS s FROM sp WHERE kind <> 'p' GROUP BY 1, 2),
        ct AS (SELECT user_id % 6 AS session, event_type AS key, count(*) AS n FROM events WHERE user_id % 6 <> 2 GROUP BY 1, 2),
        j AS (SELECT session, (SELECT map_from_entries(list((key, s) ORDER BY key)) FROM ph WHERE ph.session = x.session) AS phase_seconds, (SELECT map_from_entries(list((key, n) ORDER BY key)) FROM ph WHERE ph.session = x.session) AS phase_calls,
                     (SELECT map_from_entries(list((key, ws) ORDER BY key)) FROM ph WHERE ph.session = x.session AND warm > 0) AS warmup_seconds, (SELECT map_from_entries(list((key, s) ORDER BY key)) FROM iv WHERE iv.session = x.session) AS intervals,
                     (SELECT map_from_entries(list((key, n) ORDER BY key)) FROM ct WHERE ct.session = x.session) AS control,
                     (SELECT max(greatest(CASE WHEN event_id % 3 <> 0 THEN event_id * 10 END, CASE WHEN event_id % 5 = 0 THEN event_id * 11 END)) FROM events WHERE user_id % 6 = x.session) AS peak,
                     (SELECT count(*) FROM events WHERE user_id % 6 = x.session) AS n_r, (SELECT count(*) FROM sp WHERE sp.session = x.session) AS n_s, (SELECT count(*) FROM events WHERE user_id % 6 = x.session AND user_id % 6 <> 2) AS n_c,
                     (SELECT coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 5 END), 0)::BIGINT FROM events WHERE user_id % 6 = x.session AND user_id % 6 <> 2) AS dropped,
                     (SELECT coalesce(bool_and(coalesce(CASE WHEN s_suppkey % 7 <> 3 THEN s_suppkey % 4 <> 1 END, false)), true) FROM supplier WHERE s_suppkey % 4 = x.session) AS consumed
              FROM (SELECT DISTINCT user_id % 6 AS session FROM events UNION SELECT DISTINCT session FROM sp) x)
        SELECT session, to_json({'all_observed_sources_consumed': consumed, 'control_events': coalesce(control, MAP {}), 'intervals_and_delays': coalesce(intervals, MAP {}), 'max_observed_rss_bytes': peak, 'phase_calls': coalesce(phase_calls, MAP {}), 'phase_seconds': coalesce(phase_seconds, MAP {}),
               'rows': {'control_events': n_c, 'resources': n_r, 'spans': n_s}, 'samples_dropped': dropped, 'warmup_seconds': coalesce(warmup_seconds, MAP {})})::VARCHAR AS document FROM j""",
}
