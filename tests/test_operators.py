"""Known results and folds written by hand for the ordered operators."""

from __future__ import annotations

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.bits import canonical
from tallyspark.functions.strict_json import fault
from tallyspark.operators import history, lineage, proofs, telemetry, transport, views, witnesses

RESOURCE = "allocation_id string, sample_sequence long, monotonic_ns long, cpu_time_seconds double, cpu_count long, cpu_quota_cores double, missing_reason string, sampling_mode string, execution_id string, pid long, process_start_ticks long, clock_domain_id string, cgroup_path string, cgroup_scope string"


def samples(spark, rows, **more):
    made = []
    for i, (allocation, wall, cpu, width, *rest) in enumerate(rows):
        extra = {**more, **(rest[0] if rest else {})}
        made.append((allocation, i, int(wall * 1e9) if wall is not None else None, float(cpu) if cpu is not None else None, width, extra.get("quota"), extra.get("reason"), extra.get("mode"), "e", extra.get("pid", 1), 1, extra.get("clock", "c"), None, None))
    return spark.createDataFrame(made, RESOURCE)


def test_coverage_weighs_allocations_by_their_width(spark):
    rows = [("a", 10, 100, 32), ("b", 11, 20, 16), ("a", 12, 132, 32), ("b", 12, 32, 16), ("a", 15, 204, 32)]
    found = {r.allocation_id: r for r in telemetry.cpu_coverage(samples(spark, rows)).collect()}
    assert (found["a"].covered_wall_seconds, found["a"].cpu_seconds, found["b"].cpu_seconds) == (5.0, 104.0, 12.0)
    shares = {r.allocation_id: r for r in telemetry.coverage_ratios(telemetry.cpu_coverage(samples(spark, rows))).collect()}
    assert (shares["a"].allocated_share, shares["a"].mean_busy_cpus, shares["b"].allocated_share) == (0.65, 20.8, 0.75)


def test_coverage_counts_gaps_resets_and_changes_of_width(spark):
    rows = [("a", 1, 10, 32), ("a", 2, None, 32), ("a", 3, 20, 32), ("a", 4, 2, 32), ("a", 5, 10, 16), ("a", 20, 40, 16)]
    r = telemetry.cpu_coverage(samples(spark, rows)).first()
    assert (r.missing_samples, r.discontinuous_intervals, r.covered_wall_seconds, r.coarse_wall_seconds) == (1, 2, 15.0, 15.0)
    assert telemetry.coverage_ratios(telemetry.cpu_coverage(samples(spark, rows))).first().allocated_share == 0.125


def test_coverage_restores_the_predecessor_after_a_late_sample(spark):
    rows = [("a", 1, 10, 8), ("a", 2, 17, 8, {"mode": "profile_window"}), ("a", 16, 115, 8), ("a", 3, 24, 8), ("a", 31, 220, 8), (None, 5, 5, 8)]
    r = telemetry.cpu_coverage(samples(spark, rows)).first()
    assert (r.cpu_seconds, r.covered_wall_seconds, r.discontinuous_intervals, r.coarse_intervals, r.fine_wall_seconds) == (210.0, 30.0, 1, 2, 0.0)
    assert tuple(telemetry.excluded_samples(samples(spark, rows)).first()) == (1, 1)


@pytest.mark.parametrize("change", [{"pid": 2}, {"clock": "d"}, {"quota": 4.0}])
def test_coverage_stops_at_another_identity(spark, change):
    r = telemetry.cpu_coverage(samples(spark, [("a", 1, 10, 8), ("a", 16, 100, 8, change)])).first()
    assert (r.covered_wall_seconds, r.discontinuous_intervals) == (0.0, 1)


def fold_coverage(rows):
    previous, out = None, [0, 0, 0, 0.0]
    for stamp, cpu, width, pid in rows:
        if stamp is None or cpu is None or not width:
            out[1], previous = out[1] + 1, None
            continue
        if previous is not None:
            if stamp <= previous[0]:
                out[2] += 1
                continue
            if cpu < previous[1] or (width, pid) != previous[2:]:
                out[2] += 1
            else:
                out[0], out[3] = out[0] + 1, out[3] + stamp - previous[0]
        previous = (stamp, cpu, width, pid)
    return out


def test_coverage_equals_a_fold_on_random_samples(spark):
    rng = random.Random(5)
    cases = {f"a{k}": [(rng.choice([None, *range(1, 12)]), rng.choice([None, *range(1, 9)]), rng.choice([0, 4, 4, 4]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randrange(1, 14))] for k in range(120)}
    rows = [(a, s, c, w, {"pid": p}) for a, own in cases.items() for s, c, w, p in own]
    found = {r.allocation_id: r for r in telemetry.cpu_coverage(samples(spark, rows)).collect()}
    for a, own in cases.items():
        r = found[a]
        assert [r.valid_intervals, r.missing_samples, r.discontinuous_intervals, r.covered_wall_seconds] == fold_coverage(own), (a, own)


def test_boundary_measurements_keep_unknown_apart_from_zero(spark):
    rows = [("dyson", "phase_boundary", "end", 2.0, 8.0, 0.25, 1024), ("dyson", "phase_boundary", "end", 3.0, None, None, None)]
    spans = spark.createDataFrame(rows, "phase string, measurement_kind string, event_kind string, duration_seconds double, process_cpu_seconds double, gc_seconds double, allocated_bytes long")
    r = telemetry.boundary_measurements(spans).first()
    assert (r.calls, r.wall_seconds, r.process_cpu_seconds, r.process_cpu_seconds_calls, r.process_cpu_seconds_wall, r.gc_seconds_wall) == (2, 5.0, 8.0, 1, 2.0, 2.0)


def test_witnesses_of_an_attempt(spark):
    ratios = [-1.0] * 4 + [1.0] * 8 + [3.0] + [1.0] * 7
    rows = spark.createDataFrame([(1, 1 + i, r) for i, r in enumerate(ratios)], "attempt int, sequence long, ratio double")
    assert sorted(r.sequence for r in witnesses.selected(rows).collect()) == [1, 5, 13, 20]
    assert witnesses.omitted(rows).count() == 16


def test_cycles_of_two_loops(spark):
    rows = spark.createDataFrame([("s", "scba", 1, 100 + i, it, o) for i, (it, o) in enumerate([(1, 1), (2, 1), (3, 1), (1, 2), (2, 2)])], "series string, phase string, attempt int, sequence long, iteration long, outer_iteration long")
    last = history.last_cycles(history.cycles(rows)).first()
    assert (last.cycle, last.outer_iteration, last.first_iteration, last.last_iteration, last.first_sequence, last.last_sequence, last.n) == (2, 2, 1, 2, 103, 104, 2)
    assert [tuple(r)[1:] for r in history.cycle_markers(history.cycles(rows)).collect()] == [(103, "μ=2 · a=1")]


def test_an_invalid_point_parts_the_line_into_dots(spark):
    points = spark.createDataFrame([("s", i, float(i), y) for i, y in enumerate([0.1, float("nan"), 0.001])], "series string, ordinal long, x double, y double")
    found = history.polyline_segments(points, logarithmic=True).collect()
    assert [(r.ordinal, r.dot) for r in sorted(found, key=lambda r: r.ordinal)] == [(0, True), (2, True)]


def test_an_envelope_keeps_a_spike_and_isolates_a_gap(spark):
    n = 25_000
    y = F.when(F.col("id") == 12_345, 1e12).when(F.col("id") == 12_349, F.lit(float("nan"))).otherwise(1e-6)
    points = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("ordinal"), F.col("id").cast("double").alias("x"), y.alias("y"), F.lit(False).alias("breaks"))
    found = history.envelope_points(history.envelope(points, logarithmic=True)).collect()
    assert max(r.y for r in found) == 1e12 and len(found) <= 1600
    assert {r.bin for r in found if r.invalid} == {12_349 // math.ceil(n / 400)}


def test_limits_without_points(spark):
    points = spark.createDataFrame([("s", 1.0, -1.0)], "series string, x double, y double")
    r = history.curve_limits(points, logarithmic=True).first()
    assert (r.x0, r.x1) == (0.0, 1.0) and r.y0 < -8 and r.y1 > 1


def test_page_layout_equals_a_fold(spark):
    rng = random.Random(9)
    rows = [(s, i, rng.randrange(1, 900)) for s in ("a", "b", "c") for i in range(200)]
    got = {(r.snapshot, r.i): r.page for r in transport.page_layout(spark.createDataFrame(rows, "snapshot string, i long, weight long"), "snapshot", ["i"], 1000, 600).collect()}
    for s in ("a", "b", "c"):
        page, used, empty = 0, 600, False
        for _, i, w in (r for r in rows if r[0] == s):
            if not empty and used + w > 1000:
                page, used = page + 1, 0
            used, empty = used + w, False
            assert got[s, i] == page


def test_transport_restores_what_it_packed_in_any_order(spark):
    rng = random.Random(1)
    objects = spark.createDataFrame([(f"o{i}", bytearray(rng.randbytes(rng.choice([0, 1, 5000, 20_000])))) for i in range(12)], "path string, content binary")
    pieces = transport.chunk_plan(objects, "path", 4096).withColumn("snapshot", F.lit("s")).withColumn("page", F.pmod(F.xxhash64("path", "offset"), F.lit(3)))
    parts = transport.build_parts(pieces, "snapshot", "page", 1 << 20).cache()
    back = {r.path: bytes(r.content) for r in transport.restore(parts.orderBy(F.rand(3))).collect()}
    assert back == {r.path: bytes(r.content) for r in objects.collect()}
    broken = parts.withColumn("archive", F.concat("archive", F.lit(b"x")))
    with pytest.raises(Exception, match="digest"):
        transport.restore(broken).collect()
    with pytest.raises(Exception, match="more than"):
        transport.build_parts(pieces, "snapshot", "page", 100).collect()


def test_a_prefix_differs_by_the_sign_of_zero_and_by_nan_payload(spark):
    nan = struct.unpack("<d", struct.pack("<Q", 0x7FF8000000001234))[0]
    old = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, None), (4, float("nan"))], "k int, v double")
    new = spark.createDataFrame([(1, -0.0), (2, 5.0), (3, None), (4, float("nan")), (5, nan)], "k int, v double")
    assert [tuple(r) for r in proofs.prefix_violations(old, new, ["k"]).collect()] == [(1, "v")]


def test_a_payload_hash_depends_on_order_signs_and_nulls(spark):
    def digest(values):
        rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i long, v double")
        return [r.digest for r in proofs.payload_hash(rows, "g", "i", ["v"]).orderBy("batch").collect()]

    values = [0.0, -0.0, float("nan"), None] * 1300
    assert len(digest(values)) == 2 and digest(values) == digest(values)
    assert len({digest(v)[0] for v in ([0.0, 1.0], [1.0, 0.0], [-0.0, 1.0], [None, 1.0])}) == 4
    bits = lambda v: struct.pack("<d", v)
    assert digest([2.5, None])[0] == hashlib.sha256((2).to_bytes(8, "little") + b"\x01\x00" + bits(2.5) + bits(0.0)).hexdigest()


def test_a_payload_hash_takes_texts_by_lengths_and_bytes(spark):
    rows = spark.createDataFrame([("g", 0, "é", True), ("g", 1, None, None), ("g", 2, "ab", False)], "g string, i long, t string, f boolean")
    want = (3).to_bytes(8, "little") + b"\x01\x00\x01" + struct.pack("<3i", 2, 0, 2) + "éab".encode() + b"\x01\x00\x01" + b"\x01\x00\x00"
    assert proofs.payload_hash(rows, "g", "i", ["t", "f"]).first().digest == hashlib.sha256(want).hexdigest()


def test_an_omission_digest_is_that_of_its_lines_in_order(spark):
    rows = spark.createDataFrame([("r", "x", i, f"line {i}") for i in range(50)], "role string, reason string, pos long, line string").repartition(5)
    got = lineage.ordered_digest(rows, ["role", "reason"], "pos", "line").first().digest
    assert got == hashlib.sha256("".join(f"line {i}\n" for i in range(50)).encode()).hexdigest()


def test_a_long_ancestry_is_walked_in_few_rounds(spark):
    commits = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "commit long, parent long")
    found = lineage.ancestors(commits)
    assert found.count() == 150 * 149 // 2
    assert {r.ancestor: r.depth for r in found.where("commit = 149").collect()}[0] == 149


@pytest.mark.parametrize(("text", "want"), [('{"k": 1}', None), ('{"k": 1, "k": 2}', "repeated"), ('{"k": NaN}', "number"), ('{"k": 1e999}', "number"), ('{"k": 1,}', "syntax"), ('{"k": 1} x', "syntax"), ("[1]", "root"), (b"\xff", "encoding"), ('{"a":' * 70 + "1" + "}" * 70, "depth"), (None, "missing")])
def test_strict_json(text, want):
    assert fault(text) == want


def test_canonical_bytes_tell_types_apart():
    assert len({canonical({"v": v}) for v in (1, 1.0, True, -0.0, 0.0, "1", None, [1])}) == 8
    assert canonical({"a": 1, "b": 2}) == canonical({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        canonical(float("nan"))
    with pytest.raises(TypeError):
        canonical({1: 2})
    assert canonical({"b": [1, -0.0, None], "a": "é"}) == b"m2{s1:as2:\xc3\xa9s1:ba3[i1:1f16:8000000000000000n;]}"


def test_colours_and_nearest_cells(spark):
    cells = spark.createDataFrame([("f", 1.0), ("f", -1e22), ("f", float("nan")), ("f", 0.0), ("f", 1e22)], "figure string, value double")
    r = views.colour_range(cells, "figure").first()
    assert (r.limit, r.low, r.high, r.missing) == (1e22, -1e22, 1e22, 1)
    got = [tuple(x)[1:] for x in views.coloured(cells, "figure").orderBy("value").collect()]
    assert got[0][1:] == (0, 0, 255) and got[-1][1:] == (155, 155, 155)
    axis = spark.createDataFrame([("f", i, x) for i, x in enumerate([0.0, 1.0, 9.0])], "figure string, i long, coordinate double")
    grid = spark.createDataFrame([("f", k, x) for k, x in enumerate([0.0, 0.5, 0.6, 5.0, 5.1])], "figure string, place long, x double")
    assert [r.i for r in views.nearest_cells(grid, axis, "figure").orderBy("place").collect()] == [0, 0, 1, 1, 2]
