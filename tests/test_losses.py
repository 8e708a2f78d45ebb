"""Each way in which a record can lose something is found, and an unchanged one has no fault."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import compaction, lineage, native, snapshot, transport

WITNESS = "sequence long, path string, shape array<int>, attributes map<string,string>, values array<double>"
HISTORY = "series string, sequence long, r_a double, J double"


def witnesses(spark, change=None):
    rows = [[s, p, [2, 2], {"unit": "eV", "axis": "z"}, [float(s), 0.0, 1.0, float("nan")]] for s in (1, 4, 9) for p in ("a/x", "a/y")]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], WITNESS)


def put(i, k, v):
    return lambda rows: rows[i].__setitem__(k, v)


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda rows: rows.pop(0), "missing"), (put(0, 1, "a/z"), "missing"), (put(1, 0, 2), "missing"), (put(2, 2, [4, 1]), "shape"), (put(2, 3, {"unit": "eV"}), "annotation"),
        (put(2, 3, {"unit": "meV", "axis": "z"}), "annotation"), (put(3, 4, [4.0, -0.0, 1.0, float("nan")]), "values"), (put(3, 4, [4.0, 0.0, 1.0]), "values"), (put(3, 4, [4.0, 0.0, 2.0, float("nan")]), "values"),
    ],
)
def test_a_changed_witness_is_found(spark, change, rule):
    assert {r.rule for r in native.witness_violations(witnesses(spark), witnesses(spark, change)).collect()} == {rule}


def test_an_unchanged_or_better_annotated_witness_is_fine(spark):
    more = witnesses(spark, lambda rows: [r[3].update(note="n") for r in rows])
    assert native.witness_violations(witnesses(spark), more).collect() == []
    grown = witnesses(spark, lambda rows: rows.extend([[1, "a/new", [1], {}, [0.0]], [10, "a/x", [1], {}, [0.0]]]))
    assert [tuple(r) for r in native.added_arrays(witnesses(spark), grown).collect()] == [(1, "a/new")]


def history(n):
    return [["s", i + 1, float(i), 1.0 / (i + 1)] for i in range(n)]


@pytest.mark.parametrize(
    "change",
    [lambda rows: rows.pop(3), lambda rows: rows.insert(0, ["s", 0, 9.0, 9.0]), put(5, 2, -1.0), put(0, 2, -0.0), put(7, 3, None), lambda rows: rows.__delitem__(slice(9, None)), lambda rows: rows.clear()],
)
def test_a_history_that_lost_something_is_no_replacement(spark, change):
    rows = history(30)
    change(rows)
    source = lambda n, payload="p": spark.createDataFrame([("s", f"d{i}", payload) for i in range(n)], "series string, sha256 string, payload string")
    old, new = spark.createDataFrame(history(12), HISTORY), spark.createDataFrame([tuple(r) for r in rows], HISTORY)
    assert native.history_proof(old, new, source(2), source(3), "series", "sequence").first().faults > 0
    whole = spark.createDataFrame(history(30), HISTORY)
    assert tuple(native.history_proof(old, whole, source(2), source(3), "series", "sequence").first()) == ("s", 12, 30, 2, 3, 0)
    assert native.history_proof(old, whole, source(2), source(3, "q"), "series", "sequence").first().faults == 2
    assert native.history_proof(old, whole, source(4), source(3), "series", "sequence").first().faults == 1


def test_compacted_files_keep_nan_payloads_signs_nulls_and_order(spark, tmp_path):
    nan = struct.unpack("<d", struct.pack("<Q", 0x7FF8000000001234))[0]
    values = [nan, -0.0, 0.0, None, float("inf"), 5e-324] * 900
    for k, part in enumerate((values[:1000], values[1000:1001], values[1001:])):
        base = [0, 1000, 1001][k]
        pq.write_table(pa.table({"table_name": ["t"] * len(part), "ordinal": list(range(base, base + len(part))), "v": pa.array(part, pa.float64())}), f"{tmp_path}/{k}.parquet")
    rows = spark.read.parquet(*[f"{tmp_path}/{k}.parquet" for k in range(3)])
    folder = f"file://{tmp_path}/compacted"
    files = compaction.write_compacted(rows, "table_name", "ordinal", folder)
    assert [(r.table_name, r.n) for r in files.collect()] == [("t", 5400)]
    assert compaction.compaction_proof(spark, rows, files, "table_name", "ordinal", ["ordinal", "v"], folder).collect() == []
    got = pq.read_table(f"{tmp_path}/compacted/t.parquet").column("v").combine_chunks()
    assert got.is_valid().to_pylist() == [v is not None for v in values]
    bits = lambda cells: [struct.pack("<d", v) for v in cells if v is not None]
    assert bits(got.to_pylist()) == bits(values)
    changed = rows.withColumn("v", F.when(F.col("ordinal") == 2, F.lit(-0.0)).otherwise(F.col("v")))
    assert [r.rule for r in compaction.compaction_proof(spark, changed, files, "table_name", "ordinal", ["ordinal", "v"], folder).collect()] == ["digest"]


def test_units_carry_every_byte_once_within_the_budget(spark):
    rng = random.Random(4)
    content = {f"o{i}": data for i, data in enumerate([b"", b"x" * 500, b"same" * 9000, rng.randbytes(9000), rng.randbytes(2001), rng.randbytes(1)])}
    objects = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "name string, content binary")
    found = {}
    for r in transport.transport_units(objects, "name", 3000).collect():
        found.setdefault(r.name, []).append(r)
    for name, data in content.items():
        units = sorted(found[name], key=lambda r: r.offset)
        assert sum(u.bytes for u in units) == len(data) and [u.offset for u in units] == [sum(v.bytes for v in units[:k]) for k in range(len(units))]
        assert all(u.weight <= 3000 + transport.OVERHEAD for u in units)
    assert [u.kind for u in found["o2"]] == ["whole"] and found["o2"][0].weight < 3000 and len(found["o3"]) == 5
    for bad in (0, True, 200_000_001, 1.5):
        with pytest.raises(ValueError):
            transport.check_part_limit(bad)


def test_replacements_go_to_the_highest_generation_of_a_long_chain(spark):
    n = 70
    rows = [(i, i - 1 if i else None, "p", i, 1 if i % 3 else 0, i % 5 == 0) for i in range(n)] + [(200, 10, "p", 900, 1, False)]
    commits = spark.createDataFrame(rows, "commit long, parent long, identity string, generation long, histories int, required boolean")
    got = {r.ancestor: r.replacement for r in lineage.history_replacements(commits).collect()}
    assert got == {i: 200 if i <= 10 else 68 for i in range(68) if i % 3 and i % 5}
    assert lineage.replacement_violations(commits).collect() == []


def test_inventories_are_compared_both_ways(spark):
    a = spark.createDataFrame([("x", "1", 1), ("y", "2", 2), ("z", None, 3)], "path string, sha256 string, bytes long")
    b = spark.createDataFrame([("x", "1", 1), ("y", "3", 2), ("w", "4", 4), ("z", None, 4)], "path string, sha256 string, bytes long")
    assert {tuple(r) for r in snapshot.manifest_inventory_diff(a, b).collect()} == {("y", "sha256"), ("w", "only_in_inventory"), ("z", "bytes")}
    assert snapshot.manifest_inventory_diff(a, a).collect() == []
