"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import spread, written

#: Edges for each file of a round's tables, and the least number of tasks that write one.
FILE_EDGES, LEAST_TASKS = 1 << 18, 12


def _in_few(df: DataFrame, n: int) -> DataFrame:
    """df, made of n edges, in as many partitions as that takes: else every round of a small graph writes three files for each shuffle partition."""
    return df.coalesce(min(spread(df.sparkSession), max(LEAST_TASKS, -(-n // FILE_EDGES))))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    least = written(_in_few(least, n), "least")  # on its own, so that the join reads both sides from exchanges and a hub's edges are split
    moved = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.where("src <> dst").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = written(_in_few(edges.groupBy("src").agg(F.min("dst").alias("low")), n), "least")
    moved = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst: long): component is the smallest node reachable.

    Loops and repeated edges change nothing; no edges give no rows. Each round's edges are written to the shared
    folder, and only their number and a checksum come to the driver.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    edges, mark = written(edges, "edges"), None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if found[0] == 0 or found == mark:
            break
        mark = found
        edges = written(_in_few(_small_star(_large_star(edges, found[0]), found[0]), found[0]), "edges")
    roots = edges.select("dst").distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("dst", "dst"))
