"""Whole summaries against a plain fold over each session's rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import summaries, telemetry
from tallyspark.streaming import coverage
from tests.test_ingest import RESOURCE

SPAN = "session string, phase string, timing_kind string, measurement_kind string, event_kind string, duration_seconds double, call_count long, warmup boolean, process_cpu_seconds double, gc_seconds double, allocated_bytes long"
SESSIONS = [("a", True, 70), ("b", False, None), ("c", False, 3)]


def spans_of(rng):
    for _ in range(300):
        kind = rng.choice(["phase_duration", "interval", "delay", "phase_boundary"])
        maybe = lambda v: v if rng.random() < 0.6 else None
        yield rng.choice("ab"), rng.choice("pq"), rng.choice(["inclusive", "exclusive"]), kind, rng.choice(["begin", "end"]), rng.randrange(64) / 16, rng.randrange(4), rng.random() < 0.2, maybe(rng.randrange(9) / 4), maybe(0.25), maybe(rng.randrange(1 << 20)) if rng.random() < 0.1 else None


def plain_spans(rows):
    out = {n: {} for n in ("phase_seconds", "phase_calls", "warmup_seconds", "warmup_calls", "producer_phase_seconds", "producer_phase_calls", "producer_phase_measurements", "intervals_and_delays")}

    def add(name, key, value):
        out[name][key] = out[name].get(key, 0) + value

    for _, phase, timing, kind, event, seconds, calls, warm, cpu, gc, memory in rows:
        key = f"{phase}:{timing}"
        if kind == "phase_duration":
            for name in ("phase", "warmup") if warm else ("phase",):
                add(f"{name}_seconds", key, seconds)
                add(f"{name}_calls", key, calls)
        elif kind != "phase_boundary":
            old = out["intervals_and_delays"].get(phase, {"count": 0, "max_seconds": 0.0, "total_seconds": 0.0})
            out["intervals_and_delays"][phase] = {"count": old["count"] + 1, "max_seconds": max(old["max_seconds"], seconds), "total_seconds": old["total_seconds"] + seconds}
        elif event == "end":
            add("producer_phase_seconds", key, seconds)
            add("producer_phase_calls", key, 1)
            m = out["producer_phase_measurements"].setdefault(key, {"calls": 0, "duration_seconds": 0.0} | {f"{n}_measured_{c}": 0 for n in ("cpu", "gc", "allocations") for c in ("calls", "wall_seconds")} | dict.fromkeys(("cpu_seconds", "gc_seconds", "allocated_bytes")))
            m["calls"] += 1
            m["duration_seconds"] += seconds
            for value, total, name in ((cpu, "cpu_seconds", "cpu"), (gc, "gc_seconds", "gc"), (memory, "allocated_bytes", "allocations")):
                if value is not None:
                    m[total] = (m[total] or 0) + value
                    m[f"{name}_measured_calls"] += 1
                    m[f"{name}_measured_wall_seconds"] += seconds
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(8)
    spans = list(spans_of(rng))
    samples = []
    for n in range(400):
        allocation = rng.choice(["x", "y", "z", None, ""])
        samples.append((rng.choice("ab"), allocation, n, None if rng.random() < 0.05 else n * 2_000_000_000 - rng.choice([0, 0, 0, 9_000_000_000]), None if rng.random() < 0.05 else n / 4 - (n // 90) * 8, 8, rng.choice([None, 4.0]), None, rng.choice(["baseline"] * 5 + ["profile_window", None]), f"e{n // 150}", 1, 1, "boot", None, "node", n if n % 3 else None, n + 7 if n % 5 == 0 else None))
    control = [("a", "start", None), ("a", summaries.CAPTURE_ERROR, 3), ("a", summaries.CAPTURE_ERROR, 4), ("b", "start", None)]
    cursors = [("a", "s1", True, 64), ("a", "s2", True, 7), ("b", "s1", None, 5)]
    got = summaries.session_summaries(
        spark.createDataFrame(SESSIONS, "session string, closed boolean, recorded_until_monotonic_ns long"),
        spark.createDataFrame(spans, SPAN),
        spark.createDataFrame(samples, "session string, " + RESOURCE + ", rss_bytes long, peak_rss_bytes long").repartition(4),
        spark.createDataFrame(control, "session string, event string, samples_dropped long"),
        spark.createDataFrame(cursors, "session string, source string, complete_at_observation boolean, offset long"),
        rows=100,
        constants={"schema": "v1", "closed": "never seen", "durability": {"compression": "zstd", "barriers": []}},
    ).collect()
    return spans, samples, {r.session: (r.document, json.loads(r.document)) for r in got}


def test_spans_of_a_session_are_those_of_the_fold(made):
    spans, _, got = made
    for session in "abc":
        want = plain_spans([r for r in spans if r[0] == session])
        assert {n: got[session][1][n] for n in want} == want


def test_coverage_of_a_session_is_that_of_the_fold(made):
    _, samples, got = made
    names = [c.split()[0] for c in RESOURCE.split(", ")]
    renamed = {"fine_wall_seconds": "fine_resolution_wall_seconds", "longest_interval_seconds": "maximum_observed_interval_seconds", "first_sample_ns": "first_sample_monotonic_ns", "last_sample_ns": "last_sample_monotonic_ns"}
    for session in "ab":
        rows = [dict(zip(names, r[1:])) for r in samples if r[0] == session]
        baseline = [r for r in rows if r["sampling_mode"] != "profile_window"]
        block = got[session][1]["cpu_coverage"]
        assert block["profile_samples_excluded"] == len(rows) - len(baseline) and block["unidentified_samples"] == sum(not r["allocation_id"] for r in baseline)
        order = list(dict.fromkeys(r["allocation_id"] for r in baseline if r["allocation_id"]))
        assert [a["allocation_id"] for a in block["allocations"]] == order
        for seen in block["allocations"]:
            own = [r for r in baseline if r["allocation_id"] == seen["allocation_id"]]
            state = dict(coverage.FIRST)
            for r in own:
                coverage.fold(state, r)
            want = {renamed.get(n, n): v for n, v in state.items() if n != "before"}
            assert {n: seen[n] for n in want} == pytest.approx(want) and seen["execution_id"] == own[0]["execution_id"]
            window = (seen["last_sample_monotonic_ns"] - seen["first_sample_monotonic_ns"]) / 1e9
            assert seen["observed_window_seconds"] == pytest.approx(window) and seen["fraction_of_allocated_cpu"] == pytest.approx(seen["cpu_seconds"] / seen["allocated_cpu_seconds"])


def test_cursors_bounds_and_constants(made):
    _, samples, got = made
    text, a = got["a"]
    assert text == json.dumps(a, sort_keys=True, separators=(",", ":"))
    assert a["measurement_coverage"]["sources"] == {"s1": {"complete_at_observation": True, "offset": 64}, "s2": {"complete_at_observation": True, "offset": 7}}
    assert a["measurement_coverage"]["capture_error_events"] == 2 and a["measurement_coverage"]["all_observed_sources_consumed"] and not got["b"][1]["measurement_coverage"]["all_observed_sources_consumed"]
    assert (a["closed"], a["uncommitted_resource_batch_at_risk"], a["schema"], a["samples_dropped"]) == (True, False, "v1", 7)
    assert a["durability"] == {"barriers": list(summaries.BARRIERS), "compression": "zstd", "maximum_staged_batch_rows": 100, "maximum_synchronous_flush_rows": 200, "maximum_batch_payload_bytes": 4 << 20, "maximum_buffer_seconds": 15.0}
    assert a["max_observed_rss_bytes"] == max(v for r in samples if r[0] == "a" for v in r[-2:] if v is not None)


def test_a_session_without_rows_has_empty_objects(made):
    c = made[2]["c"][1]
    assert c["rows"] == {"control_events": 0, "resources": 0, "spans": 0} and c["phase_seconds"] == {} and c["max_observed_rss_bytes"] is None
    assert c["cpu_coverage"]["allocations"] == [] and c["measurement_coverage"]["sources"] == {} and c["measurement_coverage"]["all_observed_sources_consumed"]
    assert c["uncommitted_resource_batch_at_risk"] and c["recorded_until_monotonic_ns"] == 3


def test_bounds_that_a_writer_may_not_have_are_refused(spark):
    none = spark.createDataFrame([], "session string")
    with pytest.raises(ValueError, match="out of bounds"):
        summaries.session_summaries(none, none, none, none, none, rows=0)


def test_sessions_of_one_allocation_are_told_apart(spark):
    rows = [(s, "x", n, n * 1_000_000_000, n / 2, 4, None, None, None, "e", 1, 1, "c", None, "n") for n, s in enumerate("ababab")]
    got = {r.session: (r.samples, r.covered_wall_seconds) for r in telemetry.cpu_coverage(spark.createDataFrame(rows, "session string, " + RESOURCE), "session").select("session", "samples", F.col("covered_wall_seconds")).collect()}
    assert got == {"a": (3, 4.0), "b": (3, 4.0)}
