"""Frames that a renderer draws: nearest cells on a display grid, colours, series of points."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def axis_violations(axis: DataFrame, by: str) -> DataFrame:
    """Axes with fewer than two samples, or with one that is not finite or not above the one before."""
    before = F.lag("coordinate").over(W.partitionBy(by).orderBy("i"))
    bad = F.col("coordinate").isNull() | F.isnan("coordinate") | (F.abs("coordinate") == float("inf")) | (F.col("coordinate") <= F.col("before"))
    return axis.withColumn("before", before).groupBy(by).agg(F.count("*").alias("n"), F.count_if(bad).alias("wrong")).where("n < 2 or wrong > 0").select(by)


def nearest_cells(grid: DataFrame, axis: DataFrame, by: str) -> DataFrame:
    """grid (by, place, x) with the index of the nearest sample of its axis (by, i, coordinate): the number of midpoints between samples strictly below x, so a tie goes to the lower one.

    Midpoints and places stand in one order, and a running count gives the number: neither is gathered, nor searched for each place.
    """
    mid = (F.col("coordinate") + F.lead("coordinate").over(W.partitionBy(by).orderBy("i"))) / 2
    marks = axis.select(by, F.lit(None).cast(dict(grid.dtypes)["place"]).alias("place"), mid.alias("x"), F.lit(1).alias("mark")).where("x is not null")
    both = grid.select(by, "place", "x", F.lit(0).alias("mark")).union(marks)
    below = F.sum("mark").over(W.partitionBy(by).orderBy("x", "mark"))
    return both.withColumn("i", below.cast("long")).where("mark = 0").select(by, "place", "x", "i")


def is_regular(axis: DataFrame, by: str) -> DataFrame:
    """by, regular: whether all steps of an axis (by, i, coordinate) are its mean step, within 1e-7 of that and 1e-12 of its ends."""
    step = F.lead("coordinate").over(W.partitionBy(by).orderBy("i")) - F.col("coordinate")
    rows = axis.withColumn("step", step)
    ends = rows.groupBy(by).agg(F.min("coordinate").alias("a"), F.max("coordinate").alias("b"), F.count("*").alias("n"))
    mean = (F.col("b") - F.col("a")) / (F.col("n") - 1)
    near = F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-12)) * 1e-12 + 1e-7 * F.abs(mean)
    return rows.join(ends, by).where("step is not null").groupBy(by).agg(F.bool_and(F.abs(F.col("step") - mean) <= near).alias("regular"))


def display_grid(axis: DataFrame, by: str, least: int, most: int) -> DataFrame:
    """by, place, x: evenly spaced places from the first to the last sample of an axis, as many as it has samples, but at least `least` and at most `most`."""
    ends = axis.groupBy(by).agg(F.min("coordinate").alias("a"), F.max("coordinate").alias("b"), F.count("*").alias("n"))
    count = F.least(F.lit(most), F.greatest(F.lit(least), F.col("n"))).cast("int")
    rows = ends.select(by, "a", "b", count.alias("count"), F.explode(F.sequence(F.lit(0), count - 1)).alias("place"))
    return rows.select(by, "place", F.when(F.col("place") == F.col("count") - 1, F.col("b")).otherwise(F.col("a") + F.col("place") * ((F.col("b") - F.col("a")) / (F.col("count") - 1))).alias("x"))


def limit_violations(ranges: DataFrame, limits: DataFrame, by: str) -> DataFrame:
    """by, supplied, needed where a supplied colour limit (by, supplied) is not finite or below the largest magnitude of colour_range: no finite value may be clipped."""
    rows = limits.join(ranges.select(by, F.coalesce("limit", F.lit(0.0)).alias("needed")), by)
    return rows.where(F.isnan("supplied") | (F.col("supplied") == float("inf")) | (F.col("supplied") < F.col("needed"))).select(by, "supplied", "needed")


def candidate_states(cells: DataFrame, by: str, most: int = 12) -> DataFrame:
    """The cells (by, state, k, n_k) of a wavefunction that a view may draw: the first `most` states at the first, middle and last k."""
    return cells.where((F.col("state") < most) & F.expr("k in (0, n_k div 2, n_k - 1)"))


def thinned_labels(labels: DataFrame, by: str, gap: float) -> DataFrame:
    """labels (by, at, label) with printed: those at least gap from the last one printed before, the first one too. Labels stream through a fold with one number of state."""
    kinds = dict(labels.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, 0.0
        for batch in batches:
            out = []
            for series, at in zip(batch.column(by).to_pylist(), batch.column("at").to_pylist()):
                fresh = here is None or series != here[0] or at - last >= gap
                here, last = (series,), at if fresh else last
                out.append(fresh)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "printed"])

    rows = labels.select(by, "at", "label").repartition(by).sortWithinPartitions(by, "at", "label")
    return rows.mapInArrow(run, f"{by} {kinds[by]}, at {kinds['at']}, label {kinds['label']}, printed boolean")


def annotated_curves(arrays: DataFrame, axes: tuple, by: str) -> DataFrame:
    """by, i, x, y of one-dimensional arrays (by, axis_order, shape, x, y: arrays) whose annotations say that their axes are `axes` and their length is their shape; others are left to annotation_faults, never transposed."""
    fine = F.col("axis_order").eqNullSafe(F.array(*map(F.lit, axes))) & (F.size("y") == F.element_at("shape", 1)) & (F.size("x") == F.size("y"))
    rows = arrays.where(fine).select(by, F.posexplode(F.arrays_zip("x", "y")).alias("i", "p"))
    return rows.select(by, F.col("i").cast("long").alias("i"), "p.x", "p.y")


def annotation_faults(arrays: DataFrame, axes: tuple, by: str) -> DataFrame:
    """by, rule of arrays whose axes are not `axes`, or whose length is not their shape."""
    rules = F.array_compact(F.array(F.when(~F.col("axis_order").eqNullSafe(F.array(*map(F.lit, axes))), "axes"), F.when((F.size("y") != F.element_at("shape", 1)) | (F.size("x") != F.size("y")), "shape")))
    return arrays.select(by, F.explode(rules).alias("rule"))


def colour_range(cells: DataFrame, by: str) -> DataFrame:
    """by, limit (largest magnitude), low, high over finite values, and how many are missing."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    of = lambda c: F.when(fine, c)
    return cells.groupBy(by).agg(F.max(of(F.abs("value"))).alias("limit"), F.min(of(F.col("value"))).alias("low"), F.max(of(F.col("value"))).alias("high"), F.count_if(~fine).alias("missing"))


def colours(value: Column, limit: Column) -> Column:
    """Red for positive, blue for negative, white for zero, grey for missing values, as a struct of r, g, b."""
    fine = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    s = F.coalesce(F.try_divide(value, limit), F.lit(0.0))
    channel = lambda c: F.when(fine, F.floor(F.lit(255) * (F.lit(1.0) - c)).cast("int")).otherwise(155)
    zero = F.lit(0.0)
    return F.struct(channel(F.greatest(zero, -s)).alias("r"), channel(F.abs(s)).alias("g"), channel(F.greatest(zero, s)).alias("b"))


def coloured(cells: DataFrame, by: str) -> DataFrame:
    """cells (by, key columns, value) with r, g, b by the group's own range."""
    limits = colour_range(cells, by).select(by, "limit")
    return cells.join(limits, by).withColumn("c", colours(F.col("value"), F.col("limit"))).select(*cells.columns, "c.r", "c.g", "c.b")


def series_curves(points: DataFrame, by: list[str]) -> DataFrame:
    """by, place, x, y, marker of points (by, order, pos, x, y, accepted): those without y go; in the line an unaccepted one is a gap (null), and it stands again as a marker."""
    kept = points.where("y is not null")
    w = W.partitionBy(*by).orderBy(F.coalesce("order", F.lit(0)), "pos")
    placed = kept.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    line = placed.select(*by, "place", "x", F.when(F.col("accepted"), F.col("y")).alias("y"), F.lit(False).alias("marker"))
    return line.union(placed.where("not coalesce(accepted, false)").select(*by, "place", "x", "y", F.lit(True)))
