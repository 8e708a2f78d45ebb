"""Captures: budgets, names, files that change between listing and reading, equal contents."""

from __future__ import annotations

import hashlib
import os

import pytest

from tallyspark import api
from tallyspark.operators import capture


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.txt": b"one", "deep/b c.bin": bytes(range(256)) * 9, "deep/d.txt": b"one", "empty": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_files_are_captured_whole_and_equal_ones_once(spark, folder, monkeypatch):
    monkeypatch.setattr(capture, "PIECE_BYTES", 1000)
    seen = []
    entries, pieces = api.capture(spark, str(folder), 10_000, progress=seen.append)
    rows = {r.source_path: r for r in entries.collect()}
    assert set(rows) == {"a.txt", "deep/b c.bin", "deep/d.txt", "empty"}
    held = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.object, r.piece)):
        held.setdefault(r.object, []).append(bytes(r.data))
    assert sorted(map(len, held.values())) == [1, 3]
    for name, r in rows.items():
        data = (folder / name).read_bytes()
        assert (r.bytes, r.sha256, r.object) == (len(data), hashlib.sha256(data).hexdigest(), f"objects/{r.sha256}.bin") and b"".join(held.get(r.object, [])) == data
    assert [s["phase"] for s in seen] == ["listing", "capturing", "completed"] and seen[-1] == {"phase": "completed", "total_files": 4, "total_bytes": 2310}


def test_the_budget_is_met_exactly_or_nothing_is_read(spark, folder, monkeypatch):
    assert api.capture(spark, f"file://{folder}", 2310)[0].count() == 4
    monkeypatch.setattr(capture, "read_pieces", lambda *_: pytest.fail("was read"))
    with pytest.raises(api.ContractError, match="more than 2309 bytes"):
        api.capture(spark, str(folder), 2309)
    with pytest.raises(ValueError, match="positive"):
        api.capture(spark, str(folder), 0)


def test_files_that_changed_since_they_were_listed_are_refused(spark, folder, monkeypatch):
    listed = capture.listing(spark, str(folder)).collect()
    files = spark.createDataFrame(listed, "path string, bytes long")
    (folder / "a.txt").write_bytes(b"more than one")
    (folder / "deep/d.txt").write_bytes(b"on")
    (folder / "empty").unlink()
    got = {r.path: (r.bytes, r.fault) for r in capture.read_pieces(files, str(folder)).where("piece is null").collect()}
    assert got == {"a.txt": (0, "grown"), "deep/d.txt": (2, "ended"), "empty": (0, "missing"), "deep/b c.bin": (2304, None)}
    monkeypatch.setattr(capture, "listing", lambda *_: files)
    with pytest.raises(api.ContractError, match="changed while it was read"):
        api.capture(spark, str(folder), 10_000)


def test_names_are_filtered_and_what_is_no_file_has_no_size(spark, folder):
    os.mkfifo(folder / "deep/pipe.txt")
    (folder / "none").mkdir()
    (folder / ".hidden.txt").write_bytes(b"h")
    got = {r.path: r.bytes for r in capture.listing(spark, str(folder), "*.txt").collect()}
    assert got == {"a.txt": 3, "deep/d.txt": 3, "deep/pipe.txt": None, ".hidden.txt": 1}
    with pytest.raises(api.ContractError, match="may not be captured.*rule=size"):
        api.capture(spark, str(folder), 10_000)


def test_a_folder_without_files_gives_no_rows(spark, tmp_path):
    assert [df.count() for df in api.capture(spark, str(tmp_path), 1)] == [0, 0]


def test_names_that_may_not_be_are_found(spark):
    files = spark.createDataFrame([("a", 1), ("a", 1), ("/b", 1), ("c/../d", 1), ("e", -1), (None, 1), ("f", None)], "path string, bytes long")
    assert {(r.path, r.rule) for r in capture.listing_violations(files).collect()} == {("a", "twice"), ("/b", "name"), ("c/../d", "name"), ("e", "size"), (None, "name"), ("f", "size")}


def test_only_a_prefix_is_admitted(spark):
    files = spark.createDataFrame([(f"f{i:03}", 10) for i in range(100)] + [("f050x", 1000), ("g", 0)], "path string, bytes long").repartition(7)
    got = {r.path: (r.before, r.admitted) for r in capture.admission(files, 1000).collect()}
    assert got["f050"] == (500, True) and got["f050x"] == (510, False) and got["f051"] == (1510, False) and got["g"] == (2000, False) and sum(a for _, a in got.values()) == 51
    assert capture.admission(files.where("false"), 5).count() == 0
