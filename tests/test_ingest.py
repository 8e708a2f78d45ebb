"""Ingest and streams: bounds against a fold, cursors and rows together, batches that are repeated, streams against their batch twins."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ingest, telemetry
from tallyspark.streaming import coverage

RESOURCE = "allocation_id string, sample_sequence long, monotonic_ns long, cpu_time_seconds double, cpu_count long, cpu_quota_cores double, missing_reason string, sampling_mode string, execution_id string, pid long, process_start_ticks long, clock_domain_id string, cgroup_path string, cgroup_scope string"


def test_batches_are_closed_by_rows_bytes_age_and_control_events(spark):
    rng = random.Random(3)
    rows = [(s, i, i * rng.choice([0.1, 0.1, 1.0]) + i, rng.randrange(8, 120), rng.random() < 0.05) for s in "abc" for i in range(200)]
    rows = [(s, i, float(i * 2), n, c) for s, i, _, n, c in rows]
    got = {(r.session, r.arrival): r.batch for r in ingest.bounded_batches(spark.createDataFrame(rows, "session string, arrival long, at double, bytes long, control boolean").repartition(5), 6, 300, 9.0).collect()}
    for session in "abc":
        number, held = 0, []
        for _, i, at, n, control in (r for r in rows if r[0] == session):
            if held and (len(held) == 6 or sum(x[1] for x in held) + n > 300 or at - held[0][0] >= 9.0):
                number, held = number + 1, []
            assert got[session, i] == number
            held.append((at, n))
            if control:
                number, held = number + 1, []


def test_bounds_of_a_writer():
    ingest.check_bounds()
    for bad in ({"rows": 0}, {"rows": 65_537}, {"rows": True}, {"size": 1000}, {"seconds": 0.0}, {"seconds": 61.0}):
        with pytest.raises(ValueError):
            ingest.check_bounds(**bad)


def test_refused_rows_leave_a_gap_in_the_sequence(spark):
    rows = spark.createDataFrame([("s", 5, "spans", 1.0), ("s", 6, "spans", -1.0), ("s", 7, "spans", 2.0), ("s", 8, "resources", 3.0)], "session string, arrival long, table_name string, v double")
    assert [(r.arrival, r.sample_sequence) for r in ingest.sequenced(rows, F.col("v") >= 0).orderBy("arrival").collect()] == [(5, 0), (7, 2), (8, 0)]


def test_what_is_staged_but_not_committed_is_sent_again(spark):
    staged = spark.createDataFrame([("s", "a", 0, 10), ("s", "a", 1, 20), ("s", "b", 1, 7), ("s", "a", 2, 30)], "session string, source string, batch long, offset long")
    marks = spark.createDataFrame([("s", 1)], "session string, batch long")
    cursors = ingest.committed_cursors(staged, marks)
    assert {tuple(r) for r in cursors.collect()} == {("s", "a", 20), ("s", "b", 7)}
    journal = spark.createDataFrame([("s", "a", 20), ("s", "a", 30), ("s", "b", 7), ("s", "c", 1)], "session string, source string, offset long")
    assert {tuple(r) for r in ingest.to_replay(journal, cursors).collect()} == {("s", "a", 30), ("s", "c", 1)}
    assert ingest.prefix(staged, marks).count() == 3


def test_a_repeated_micro_batch_changes_nothing_and_a_prefix_stays(spark, tmp_path):
    base = f"file://{tmp_path}/stream"
    commit = coverage.commit_to(base)
    commit(spark.createDataFrame([(1,), (2,)], "v int"), 0)
    commit(spark.createDataFrame([(3,)], "v int"), 1)
    before = sorted(map(tuple, coverage.committed_rows(spark, base).collect()))
    commit(spark.createDataFrame([(3,)], "v int"), 1)
    assert sorted(map(tuple, coverage.committed_rows(spark, base).collect())) == before == [(1, 0), (2, 0), (3, 1)]
    spark.createDataFrame([(9,)], "v int").write.parquet(f"{base}/data/epoch=2")  # rows of a batch that did not end
    assert coverage.committed_rows(spark, base).count() == 3 and coverage.committed_rows(spark, base, until=0).count() == 2


def test_the_stream_of_coverage_is_its_batch_twin_to_the_nanosecond(spark, tmp_path):
    rng = random.Random(8)
    rows, at = [], 1_700_000_000_000_000_000
    for i in range(160):
        at += rng.choice([100, 100, 7_000_000_000, 12_000_000_000, -5_000])
        stamp = None if rng.random() < 0.1 else at
        rows.append((rng.choice(["a", "b", "c", None]), i, stamp, rng.choice([None, *[float(i)] * 9]), rng.choice([0, 8, 8, 8]), rng.choice([None, 4.0]), rng.choice([None] * 9 + ["lost"]), rng.choice(["baseline"] * 9 + ["profile_window"]), "e", rng.choice([1, 1, 1, 2]), 1, "c", None, None))
    whole = spark.createDataFrame(rows, RESOURCE)
    folder = f"{tmp_path}/resources.parquet"
    for k in range(4):
        whole.where(f"sample_sequence div 40 = {k}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(whole.schema).parquet(folder)
    got = coverage.committed(coverage.coverage_stream(stream), "update", coverage.latest)
    names = got.columns
    text = lambda df: {r.allocation_id: tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(names).collect()}
    assert text(got) == text(telemetry.cpu_coverage(whole))
    assert len(names) == 15


def test_a_transition_promotes_the_next_batch_whenever_it_closes(spark):
    rows = [("s", "spans", b, 10.0 * b, False) for b in (1, 2, 3, 6, 7)] + [("s", "resources", 6, 60.0, False), ("s", "control_events", 4, 40.0, False), ("t", "spans", 5, 50.0, False), ("s", "spans", 99, 990.0, False)]
    batches = spark.createDataFrame(rows, "session string, table_name string, batch long, closed_seconds double, requested boolean")
    marks = spark.createDataFrame([("s", 3), ("s", 5)], "session string, batch long")
    got = {(r.session, r.table_name, r.batch) for r in telemetry.science_windows(batches, marks).where("science_window").collect()}
    assert got == {("s", "spans", 1), ("s", "spans", 3), ("s", "spans", 6), ("s", "spans", 99), ("s", "resources", 6), ("s", "control_events", 4), ("t", "spans", 5)}


def test_a_document_tells_unknown_from_zero(spark):
    spans = spark.createDataFrame([("s", "p", "inclusive", "phase_duration", 2.0, 3, False)], "session string, phase string, timing_kind string, measurement_kind string, duration_seconds double, call_count long, warmup boolean")
    resources = spark.createDataFrame([("t", None, None)], "session string, rss_bytes long, peak_rss_bytes long")
    control = spark.createDataFrame([], "session string, event string, samples_dropped long")
    cursors = spark.createDataFrame([("s", None)], "session string, complete_at_observation boolean")
    got = {r.session: json.loads(r.document) for r in ingest.summary_documents(spans, resources, control, cursors).collect()}
    assert got["s"]["phase_seconds"] == {"p:inclusive": 2.0} and got["s"]["warmup_seconds"] == {} and not got["s"]["all_observed_sources_consumed"]
    assert got["t"]["max_observed_rss_bytes"] is None and got["t"]["rows"] == {"control_events": 0, "resources": 1, "spans": 0} and got["t"]["all_observed_sources_consumed"]
