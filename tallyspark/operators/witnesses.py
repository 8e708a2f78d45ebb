"""Representative records of each attempt, and ragged arrays packed by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def selected(rows: DataFrame, by: str = "attempt") -> DataFrame:
    """by, sequence of each attempt's witnesses (by, sequence, ratio): the first, the last, the first of the highest finite ratio and the first finite one above zero.

    Extremes come from one aggregate of ordered structs, so no attempt's rows are gathered.
    """
    finite = F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") < float("inf"))
    found = rows.groupBy(by).agg(
        F.min("sequence").alias("first"), F.max("sequence").alias("last"),
        F.min(F.when(finite, F.struct((-F.col("ratio")).alias("n"), "sequence"))).getField("sequence").alias("peak"),
        F.min(F.when(finite & (F.col("ratio") > 0), F.col("sequence"))).alias("positive"),
    )
    return found.select(by, F.explode(F.array_distinct(F.array_compact(F.array("first", "last", "peak", "positive")))).alias("sequence"))


def omitted(rows: DataFrame, by: str = "attempt") -> DataFrame:
    """The witnesses that selected() leaves out."""
    return rows.select(by, "sequence").join(selected(rows, by), [by, "sequence"], "left_anti")


def attempt_proof(rows: DataFrame, by: str = "attempt") -> DataFrame:
    """For each attempt: witnesses, kept ones and the kept sequences in order."""
    kept = selected(rows, by).groupBy(by).agg(F.count("*").alias("kept"), F.array_join(F.array_sort(F.collect_list("sequence")), ",").alias("sequences"))
    return rows.groupBy(by).agg(F.count("*").alias("witnesses")).join(kept, by)


def packed_offsets(arrays: DataFrame, by: str, order: str, values: str) -> DataFrame:
    """Each array's offset in its group's flat storage, and its size: [0] and running sums, in order."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    size = F.size(values).cast("long")
    return arrays.select(by, order, (F.sum(size).over(w) - size).alias("offset"), size.alias("size"))


def offset_violations(packed: DataFrame, by: str) -> DataFrame:
    """Arrays (by, ix, offset, size, declared) that do not begin where the one before ends (the first: at 0), or whose shape's product is not their size."""
    w = W.partitionBy(by).orderBy("ix")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0))
    return packed.withColumn("expected", expected).where("offset <> expected or size <> declared").select(by, "ix", "offset", "expected")


def packed_slices(flat: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, values: each slice (keys, place, offset, size) of a flat array (place, values), without exploding either."""
    return flat.join(offsets, "place").select(*keys, F.slice("values", F.col("offset") + 1, F.col("size")).alias("values"))


def reindexed(kept: DataFrame, by: str, order: str) -> DataFrame:
    """kept rows with new indexes 0, 1, ... in order of the old ones."""
    return kept.withColumn("new_index", (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).cast("long"))
