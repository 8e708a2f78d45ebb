"""Pages of next-fit against the fold, with snapshots that are split over many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import folds, transport


def fold(weights, budget, first_weight):
    pages, used = [[]], first_weight
    for w in weights:
        if (pages[-1] or len(pages) == 1) and used + w > budget:
            pages.append([])
            used = 0
        pages[-1].append(w)
        used += w
    return [n for n, page in enumerate(pages) for _ in page]


@pytest.mark.parametrize(("seed", "first_weight"), [(1, 0), (2, 40), (3, 500)])
def test_pages_are_those_of_the_fold(spark, seed, first_weight):
    rng = random.Random(seed)
    sets = {"one": [rng.randrange(0, 60) for _ in range(1500)], "heavy": [rng.choice([0, 99, 100, 101, 5000]) for _ in range(200)], "single": [7], "none of the budget": [0] * 50}
    rows = [(name, k, w) for name, ws in sets.items() for k, w in enumerate(ws)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        units = spark.createDataFrame(rows, "snapshot string, name long, weight long")
        got = transport.page_layout(units, "snapshot", ["name"], 100, first_weight).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for name, weights in sets.items():
        assert [r.page for r in sorted((r for r in got if r.snapshot == name), key=lambda r: r.name)] == fold(weights, 100, first_weight)


def test_a_large_group_is_dealt_to_many_parts(spark):
    rows = spark.range(40_000).select(F.lit("s").alias("g"), "id", (F.col("id") % 7).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = folds.ranged(rows, "g", ["id"])
        sums = folds.running(parts, "g", ["id"], before="w")
        assert parts.select("part").distinct().count() == 4
        assert sums.where("id = 39999").first().before == sum(k % 7 for k in range(39_999))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_units(spark):
    assert transport.page_layout(spark.createDataFrame([], "snapshot string, name long, weight long"), "snapshot", ["name"], 100, 0).collect() == []
