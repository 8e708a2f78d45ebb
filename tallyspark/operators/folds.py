"""Greedy folds without a fold: running sums in two steps, and the starts that a chain of jumps reaches, in rounds that double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.sources.store import settled


def ranged(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with part: the number of their range of (by, order), written once. A large group is split over many parts."""
    return settled(rows.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id().cast("long")), "ranged")


def running(parts: DataFrame, by: str, order: list[str], **sums: str) -> DataFrame:
    """parts (see ranged) with, for each name of sums, the sum of that column over the rows of the same `by` before. Sums of parts first, one row for each part and group, then sums within a part."""
    totals = parts.groupBy(by, "part").agg(*[F.sum(c).alias(f"{name}_total") for name, c in sums.items()])
    earlier = W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(by, "part", *[F.coalesce(F.sum(f"{name}_total").over(earlier), F.lit(0)).alias(f"{name}_base") for name in sums])
    within = W.partitionBy(by, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return parts.join(bases, [by, "part"]).select(*parts.columns, *[(F.col(f"{name}_base") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()])


def _exits(by: str):
    """For each place of a part the first start behind the part that it leads to: jumps are composed with themselves until none stays inside."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("i").to_numpy())
        i, to = (rows.column(c).to_numpy()[order] for c in ("i", "next"))
        low, high, leaves = int(i[0]), int(i[-1]), to.copy()
        while (inside := leaves <= high).any():
            leaves[inside] = leaves[leaves[inside] - low]
        return pa.table([rows.column(by).take(pa.array(order)), rows.column("part").take(pa.array(order)), pa.array(i), pa.array(leaves)], names=[by, "part", "i", "leaves"])

    return run


def _walked(by: str):
    """The starts of a part that its entries lead to."""

    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(rows) or not len(entries):
            return pa.table([rows.column(by).slice(0, 0), pa.array([], pa.int64())], names=[by, "i"])
        order = np.argsort(rows.column("i").to_numpy())
        i, to = (rows.column(c).to_numpy()[order] for c in ("i", "next"))
        low, high, found = int(i[0]), int(i[-1]), []
        at = int(entries.column("i").to_numpy().min())  # all entries of a part lie on one chain
        while at <= high:
            found.append(at)
            at = int(to[at - low])
        return pa.table([rows.column(by).slice(0, 1).take(pa.array([0] * len(found), pa.int64())), pa.array(found, pa.int64())], names=[by, "i"])

    return run


def reached(jumps: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """by, i of the places that the chain from its root (by, i) reaches. jumps: by, part, i (consecutive in a part), next (> i; behind the last place where the chain ends).

    A part tells where each of its places leaves it; of those only what some part leaves to is an entry, so that parts times the places of a jump remain. Their jumps are doubled until no
    further entry is reached, in about log2(parts) rounds; then each part is walked from its entry.
    """
    kind = dict(jumps.dtypes)[by]
    exits = settled(jumps.groupBy(by, "part").applyInArrow(_exits(by), f"{by} {kind}, part long, i long, leaves long"), "exits")
    entries = exits.select(by, F.col("leaves").alias("i")).union(roots.select(by, "i")).distinct()
    hops, seen, many = settled(exits.join(entries, [by, "i"]).select(by, "i", "leaves"), "hops"), settled(roots.select(by, "i"), "seen"), -1
    while (now := seen.count()) != many:
        many = now
        onward = seen.join(hops, [by, "i"]).select(by, F.col("leaves").alias("i"))
        seen = settled(seen.union(onward).distinct(), "seen")
        further = hops.select(by, F.col("i").alias("leaves"), F.col("leaves").alias("further"))
        hops = settled(hops.join(further, [by, "leaves"], "left").select(by, "i", F.coalesce("further", "leaves").alias("leaves")), "hops")
    placed = seen.join(exits.select(by, "part", "i"), [by, "i"])
    return jumps.select(by, "part", "i", "next").groupBy(by, "part").cogroup(placed.select(by, "part", "i").groupBy(by, "part")).applyInArrow(_walked(by), f"{by} {kind}, i long")


def next_fit(rows: DataFrame, by: str, order: list[str], weight: str, budget: int, first_weight: int) -> DataFrame:
    """rows with `page`, next-fit in order within each group: a row that no longer fits opens a page. The first page holds first_weight already and may stay without rows; any other takes at least one row, however heavy.

    From running sums of weights, a row's page, if it opened one, would end before the first row whose sum lies beyond its own and the budget: all ends and all those
    limits, in order, give that by one running count. Which rows do open pages is what the chain from the first page reaches.
    """
    keys = [f"order{k}" for k in range(len(order))]  # the rows' own columns travel in one, so that no name clashes
    own = rows.select(F.col(by).alias("group"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(c).alias(k) for c, k in zip(order, keys)], F.col(weight).cast("long").alias("weight"), F.lit(1).cast("long").alias("one"))
    places = settled(running(ranged(own, "group", keys), "group", keys, i="one", before="weight"), "places")
    end, none = F.col("before") + F.col("weight"), F.lit(0).cast("long")
    ends = places.select("group", end.alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("i"), F.lit(1).cast("long").alias("end"))
    limits = places.select("group", (F.col("before") + budget).alias("at"), F.lit(1).alias("kind"), "i", none.alias("end"))
    first = places.select("group").distinct().select("group", F.lit(budget - first_weight).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("i"), none.alias("end"))
    lines = ranged(ends.union(limits).union(first), "group", ["at", "kind", "i"])
    limits = settled(running(lines, "group", ["at", "kind", "i"], fits="end").where("kind = 1").select("group", "i", F.greatest(F.col("i") + 1, "fits").alias("next")), "limits")
    roots = limits.where("i = -1").select("group", F.col("next").alias("i"))
    jumps = settled(places.select("group", "part", "i").join(limits.where("i >= 0"), ["group", "i"]), "jumps")
    starts = reached(jumps, roots, "group").withColumn("start", F.lit(1).cast("long"))
    marked = settled(places.join(starts, ["group", "i"], "left").withColumn("start", F.coalesce("start", none)), "marked")
    return running(marked, "group", ["i"], pages="start").select("row.*", (F.col("pages") + F.col("start")).alias("page"))
