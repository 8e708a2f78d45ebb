"""Queries meet candidates in bounded groups, without a broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import multi_index, topk, vectors


@pytest.mark.parametrize("held", [1 << 25, 2000])
def test_groups_of_queries_meet_slices_without_a_broadcast(spark, monkeypatch, held):
    x = np.random.default_rng(5).normal(size=(700, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "HELD", held)
    rows = vectors.usable(df, zero_too=True)
    candidates, queries = vectors.packed(rows, 32, "c", topk.sorted_lists(256.0)), vectors.packed(rows.where("vec_id % 10 = 0"), 16, "q")
    met = vectors.against_all(candidates, queries, topk.nra(3, 256.0), "long", 3)
    assert "Broadcast" not in met._jdf.queryExecution().toString()
    hits = met.collect()
    assert len(hits) <= 70 * 3 * min(candidates.tasks, 4 * spark.sparkContext.defaultParallelism)
    got = {}
    for r in hits:
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    ints = np.floor(256 * x).astype(int)
    for q in range(0, 700, 10):
        assert sorted(got[q])[:3] == sorted((-int(ints[q] @ ints[j]), j) for j in range(700) if j != q)[:3]


def test_lists_are_read_for_a_block_of_queries_at_once():
    rng = np.random.default_rng(9)
    cells = rng.normal(size=(2000, 24))
    part = topk.Part(np.arange(2000), cells, topk.sorted_lists(256.0)(cells))
    ints = np.floor(256 * cells).astype(int)
    search = topk.nra(5, 256.0)
    (query, row, score), beat = search(part, np.arange(64), cells[:64], None)
    for j in range(64):
        want = [i for i in np.lexsort((np.arange(2000), -(ints @ ints[j]))) if i != j][:5]
        assert row[query == j].tolist() == want and score[query == j].tolist() == (ints[want] @ ints[j]).tolist() and beat[j] == score[query == j][-1]
    (query, _, _), _ = search(part, np.arange(64), cells[:64], np.array([10**30] * 64, dtype=object))
    assert not len(query)


def sent_to_driver(spark):
    """Bytes of results of each stage that has run."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}


@pytest.mark.parametrize("ids", ["id", "id div 500"])
def test_a_sample_is_not_sent_by_every_task(spark, ids):
    rows = spark.range(0, 20_000, 1, 25).selectExpr(f"{ids} AS vec_id", "transform(sequence(1, 16), i -> sin(id * i)) AS embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))
    seen = set(sent_to_driver(spark))
    found = multi_index.nearest(rows, F.col("vec_id") == 20, k=2, sample_rows=1000)
    sent = {k: v for k, v in sent_to_driver(spark).items() if k not in seen}
    assert found.count() and max(sent.values()) < 600_000  # 25 tasks send 3 MB in all
    got = multi_index.smallest_by_hash(vectors.usable(rows, zero_too=False), 20_000, 1000).collect()
    hashes = sorted(r.h for r in rows.select(F.xxhash64("vec_id").alias("h")).collect())[:1000]
    assert [r.h for r in spark.createDataFrame(got).select(F.xxhash64("vec_id").alias("h")).collect()] == hashes


@pytest.mark.parametrize("radius", [2, 20, 40])
def test_a_block_gives_the_best_within_the_radius_and_what_beats_those_before(radius):
    rng = np.random.default_rng(12)
    x = rng.integers(-3, 4, size=(600, 40)).astype(float)
    x[300:330] = x[:30]
    codes, asked = multi_index.Codes.fit(x), vectors.Asked(1, np.arange(0, 50), x[:50])
    search, index = multi_index.mih(7, codes, radius), multi_index.substring_index(codes)
    for a in range(0, 600, 200):
        asked.meet(multi_index.Part(np.arange(600)[a : a + 200], x[a : a + 200], index(x[a : a + 200])), search, 7)
        query, ids, score = asked.hits
        for j in range(50):
            near = [i for i in range(a + 200) if i != j and codes.far(codes.of(x[i : i + 1])[0], codes.of(x[j : j + 1])[0]) <= radius]
            best = sorted((-(x[i] * x[j]).sum(), i) for i in near)[:7]
            assert [(-s, i) for s, i in zip(score[query == j].tolist(), ids[query == j].tolist())] == best
