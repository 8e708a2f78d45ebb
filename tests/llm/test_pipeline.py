"""The pipeline's stages one after another, and the registered queries."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tallyspark.llm import queries
from tallyspark.llm.graph import components
from tallyspark.llm.scratch import small_table

SF = "/root/testdata/sf0.001"


def test_stages_decide_and_pass_on_documents(spark, tmp_path):
    rng = random.Random(1)
    words = "the of and to in is that it was for on are with as this be at one have not".split()

    def text(n):
        return " ".join((f"{rng.choice(words)}{rng.randrange(50)}" if rng.random() < 0.5 else rng.choice(words)) + ("." if i % 8 == 7 else "") for i in range(n)) + "."

    shared = text(80)
    bodies = [text(120) for _ in range(30)]
    rows = [(i, b, "en", f"s{i % 3}", len(b)) for i, b in enumerate(bodies)]
    rows += [(100, bodies[0], "en", "s0", 1), (101, bodies[1].replace("the", "a", 1), "en", "s1", 1), (102, "1234 5678", None, "s1", 9), (103, None, "en", None, 0)]
    rows += [(104, text(60) + " " + shared, "en", "s0", 1), (105, text(70) + "\n" + shared + "\n" + text(20), "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept, names = {}, [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {}
        for r in docs.collect():
            kept[name].setdefault(r.doc_id, []).append(r)
    clean = set(range(30))
    assert set(kept["language_id"]) == clean | {100, 101, 104, 105}
    assert set(kept["near_dedup"]) == clean | {104, 105}
    assert set(kept["substring_dedup"]) == clean | {104, 105}
    assert all(kept["substring_dedup"][i][0].text == bodies[i] for i in clean)
    assert shared in kept["substring_dedup"][104][0].text and shared not in kept["substring_dedup"][105][0].text
    pieces = [p for own in kept["packing"].values() for p in own]
    assert sorted((p.sequence_id, p.offset) for p in pieces)[0] == (0, 0) and sum(p.length for p in pieces) > 0


def test_stages_take_odd_rows(spark, tmp_path):
    """No rows; null, empty and very long texts; rows that repeat whole or share a doc_id; null doc_ids; columns with the stages' own names."""
    rng = random.Random(4)
    a, b, c = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" + ("." if i % 9 == 8 else "") for i in range(90)) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (None, a, "en", "s", 1), (2, b, "en", None, 1), (2, c, "en", "t", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "word " * 200_000, "de", "t", 1), (None, b + " x.", "en", "s", 1)]
    extra = ", key long, band long, row string, component_id long, n_removed long, taken long, own_id long"
    docs = spark.createDataFrame([(*r, 1, 2, "z", 3, 4, 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == [], name
        assert stage(spark, docs, str(tmp_path)).columns[:1] == ["doc_id"], name
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, (r.text or "")[:20])
    assert sorted(map(key, near.collect())) == sorted([(False, 1, a[:20]), (False, 2, b[:20]), (False, 2, c[:20]), (False, 3, ""), (False, 4, ""), (False, 5, ("word " * 20)[:20])])
    clean = stages["substring_dedup"](spark, near, str(tmp_path)).collect()
    assert sorted(map(key, clean)) == sorted(map(key, near.collect())) and {r.text for r in clean if r.doc_id == 2} == {b, c}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_gives_pieces_of_whole_sequences(spark):
    got = corpus_pipeline.run(spark, SF).select("sequence_id", "offset", "length").collect()
    at = 0
    for r in sorted(got):
        assert (r.sequence_id, r.offset) == divmod(at, 4096)
        at += r.length
    assert at > 0


def test_mixing_counts_words_once_and_starts_no_second_kind_of_worker(spark):
    """A plain join by size had its UDF once more in a filter, which is a second worker of each task; few rows given as they are start a Python daemon of their own."""
    docs = spark.createDataFrame([(i, "a b c " * (i % 5), "en", f"s{i % 2}", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    few = small_table(spark, [(1, "a"), (2, None)], pa.schema({"k": pa.int64(), "v": pa.string()}))
    assert few.dtypes == [("k", "bigint"), ("v", "string")]
    assert sorted(map(tuple, few.collect())) == [(1, "a"), (2, None)]
    assert "PythonRDD" not in few._jdf.queryExecution().toRdd().toDebugString()
    assert small_table(spark, [], pa.schema({"k": pa.int64()})).count() == 0


def test_rounds_of_a_small_graph_write_few_files(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("60", "false")):
        spark.conf.set(k, v)
    try:
        found = components(spark.range(600).selectExpr("id src", "id - id % 3 dst"))
        assert {r.node: r.component for r in found.collect()} == {i: i - i % 3 for i in range(600)}
        assert len(found.inputFiles()) <= 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
