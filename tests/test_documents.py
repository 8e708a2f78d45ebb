"""Bins without points, numbers in JSON, layouts that are refined until they fit, and the walk over references."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.canonical_json import canonical_json, json_number
from tallyspark.operators import history, ingest, snapshot, transport


def test_a_bin_without_a_point_breaks_the_line(spark):
    y = [1.0, 1.0, float("nan"), 1.0, None, 2.0]
    rows = spark.createDataFrame([("a", k, float(k), v, False) for k, v in enumerate(y)], "series string, ordinal long, x double, y double, breaks boolean")
    for logarithmic in (False, True):
        got = [tuple(r) for r in history.envelope_points(history.envelope(rows, logarithmic, bins=6)).orderBy("bin", "place").select("bin", "invalid", "place", "x", "y").collect()]
        assert got == [(0, False, 0, 0.0, 1.0), (1, False, 0, 1.0, 1.0), (2, True, 0, None, None), (3, False, 0, 3.0, 1.0), (4, True, 0, None, None), (5, False, 0, 5.0, 2.0)]
    late = spark.createDataFrame([("a", 1, "scba", k, k, 1, 1.0, None if k < 4 else 3.0) for k in range(1, 9)], "series string, attempt long, phase string, sequence long, iteration long, outer_iteration long, r_a double, r_b double")
    found = history.history_view(late, False, bins=8).where("metric = 'r_b'").orderBy("bin").collect()
    assert [(r.bin, r.invalid, r.x) for r in found] == [(0, True, None), (1, True, None), (2, True, None)] + [(k, False, k + 1.0) for k in range(3, 8)]


NUMBERS = [0.0004, 2e7, 1.5e7, 1e-7, 1e16, 123456789.125, -0.0, 0.1 + 0.2, 5e-324, 1.7976931348623157e308, 3.0]


def test_numbers_are_written_as_json_writes_them(spark):
    rows = spark.createDataFrame([(k, v, {"b": v, "a": None}, [v], "é\"\n", None) for k, v in enumerate(NUMBERS)], "k int, v double, m map<string,double>, l array<double>, t string, n string")
    for r in rows.select("k", json_number(F.col("v")).alias("number"), canonical_json(F.struct("v", "t", "n", "m", "l")).alias("text")).collect():
        v = NUMBERS[r.k]
        assert r.number == json.dumps(v)
        assert r.text == json.dumps({"v": v, "t": "é\"\n", "n": None, "m": {"b": v, "a": None}, "l": [v]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.5e7,)], "v double").select(history.as_text(F.col("v")).alias("t"))
    assert [r.t for r in odd.collect()] == ["NaN", "Infinity", None, "15000000.0"]


def test_a_summary_and_an_identity_hold_small_and_large_numbers(spark):
    spans = spark.createDataFrame([(1, "solve", "inclusive", "phase_duration", 4e-4, 1, True), (1, "solve", "inclusive", "phase_duration", 2e7, 1, False), (1, "wait", None, "interval", 1e-5, 1, False)], "session long, phase string, timing_kind string, measurement_kind string, duration_seconds double, call_count long, warmup boolean")
    resources = spark.createDataFrame([], "session long, rss_bytes long, peak_rss_bytes long")
    control = spark.createDataFrame([], "session long, event string, samples_dropped long")
    cursors = spark.createDataFrame([(1, True)], "session long, complete_at_observation boolean")
    document = ingest.summary_documents(spans, resources, control, cursors).first().document
    value = json.loads(document)
    assert value["phase_seconds"] == {"solve:inclusive": 4e-4 + 2e7} and value["warmup_seconds"] == {"solve:inclusive": 0.0004} and value["max_observed_rss_bytes"] is None
    assert document == json.dumps(value, sort_keys=True, separators=(",", ":")) and '"warmup_seconds":{"solve:inclusive":0.0004}' in document
    fields = spark.createDataFrame([(1, 2e7, None, [3, 1])], "k long, limit double, plan string, commits array<long>")
    assert snapshot.snapshot_identity(fields, "k").select(F.col("identity") == F.sha2(F.lit('{"commits":[3,1],"limit":20000000.0,"plan":null}').cast("binary"), 256)).first()[0]


def test_a_layout_is_refined_until_it_fits(spark):
    def split(pages, at):
        """One step as the format has it; members are (name, offset, bytes)."""
        page = pages[at]
        if len(page) > 1:
            half = max(1, len(page) // 2)
            return pages[:at] + [page[:half], page[half:]] + pages[at + 1 :]
        if at == 0:
            return [[], page] + pages[1:]
        name, offset, size = page[0]
        step = max(1, size // 2)
        return pages[:at] + [[(name, offset + k, min(step, size - k))] for k in range(0, size, step)] + pages[at + 1 :]

    rng = random.Random(6)
    pages = [[(f"u{p}-{k}", 0, rng.randrange(1, 90)) for k in range(rng.randrange(1, 6))] for p in range(7)]
    rows = [("s", p, k, *m) for p, page in enumerate(pages) for k, m in enumerate(page)]
    units = spark.createDataFrame(rows, "s string, page long, place long, name string, offset long, bytes long")
    found = transport.fitted_layout(units, "s", lambda u: u.groupBy("s", "page").agg(F.sum("bytes").alias("sum")).where(F.col("sum") + F.when(F.col("page") == 0, 30).otherwise(0) > 60))
    heavy = lambda: next((i for i, p in enumerate(pages) if p and sum(m[2] for m in p) + (30 if i == 0 else 0) > 60), None)
    while (at := heavy()) is not None:
        pages = split(pages, at)
    want = sorted((p, k, *m) for p, page in enumerate(pages) for k, m in enumerate(page))
    assert sorted((r.page, r.place, r.name, r.offset, r.bytes) for r in found.collect()) == want
    with pytest.raises(ValueError, match="headers"):
        transport.fitted_layout(units, "s", lambda u: u.where("page > 0").select("s", "page"))
    with pytest.raises(ValueError, match="metadata"):
        transport.fitted_layout(units.limit(1).withColumn("page", F.lit(0).cast("long")), "s", lambda u: u.select("s", F.lit(0).cast("long").alias("page")))


@pytest.mark.parametrize("seed", [1, 2])
def test_references_are_followed_in_order(spark, seed):
    rng = random.Random(seed)
    parent = {c: rng.choice([None, *range(c)]) if c else None for c in range(60)}
    parent[0] = 7 if seed == 2 else None  # a cycle ends too
    given = [(rng.choice(snapshot.REFERENCE_KINDS[:4]), k, rng.randrange(60)) for k in range(14)]
    given += [(kind, 99, c) for kind, _, c in given[:4]]
    listed = []
    for _, _, c in sorted(given, key=lambda r: (snapshot.REFERENCE_KINDS.index(r[0]), r[1])):
        if c not in listed:
            listed.append(c)
    for c in listed:
        if parent[c] is not None and parent[c] not in listed:
            listed.append(parent[c])
    references = spark.createDataFrame([(kind, k, c) for kind, k, c in given], "kind string, pos long, commit long")
    parents = spark.createDataFrame(list(parent.items()), "commit long, parent long")
    got = snapshot.reference_walk(references, parents).collect()
    order = sorted(got, key=lambda r: (r.level, r.kind_no, r.place))
    # positions repeat over kinds, never within one, but for those of position 99
    assert [r.commit for r in order if r.place != 99] == [c for c in listed if c in {r.commit for r in order if r.place != 99}]
    assert {r.commit for r in got} == set(listed)
