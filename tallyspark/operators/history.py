"""Iteration histories: cycles, holes, attempt spans, envelopes that never bridge an invalid interval, display limits.

A history has columns series (any grouping of one curve's rows), attempt, phase, sequence, iteration, outer_iteration and metric columns.
All windows are over one series, so that series are worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.canonical_json import json_number

MOST_MARKERS, BINS = 24, 400


def sequence_holes(rows: DataFrame, by: str = "series") -> DataFrame:
    """rows with `hole`: more than one step after the row before (the first one: after 0)."""
    step = F.col("sequence") - F.coalesce(F.lag("sequence").over(W.partitionBy(by).orderBy("sequence")), F.lit(0))
    return rows.withColumn("hole", step > 1)


def sequence_violations(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows whose sequence, in the order that `order` gives, is not positive or does not increase."""
    before = F.lag("sequence").over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("before", before).where((F.col("sequence") <= 0) | (F.col("sequence") <= F.col("before")))


def overlapping_segments(segments: DataFrame, by: str) -> DataFrame:
    """Segments (first, last) that begin before the one before them ends, or end before they begin."""
    before = F.lag("last").over(W.partitionBy(by).orderBy("first", "last"))
    return segments.withColumn("before", before).where((F.col("last") < F.col("first")) | (F.col("before") >= F.col("first")))


def cycles(rows: DataFrame, by: str = "series") -> DataFrame:
    """rows with `ordinal`, `cycle_start` and `cycle` (from 1).

    A cycle begins at the first row, where the attempt changes, where the iteration does not increase, and in phase scba where the outer iteration changes.
    """
    w = W.partitionBy(by).orderBy("sequence")
    last = lambda c: F.lag(c).over(w)
    start = last("sequence").isNull() | (F.col("attempt") != last("attempt")) | (F.col("iteration") <= last("iteration")) | ((F.col("phase") == "scba") & (F.col("outer_iteration") != last("outer_iteration")))
    marked = rows.withColumn("cycle_start", start).withColumn("ordinal", F.row_number().over(w) - 1)
    return marked.withColumn("cycle", F.sum(F.col("cycle_start").cast("long")).over(w))


def cycle_contexts(cycled: DataFrame, by: str = "series") -> DataFrame:
    """One row for each cycle: attempt, outer iteration, first and last iteration and sequence, rows."""
    first, last = (lambda c: F.min_by(c, "sequence")), (lambda c: F.max_by(c, "sequence"))
    return cycled.groupBy(by, "cycle").agg(
        first("attempt").alias("attempt"), first("outer_iteration").alias("outer_iteration"), first("iteration").alias("first_iteration"), last("iteration").alias("last_iteration"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count("*").alias("n"),
    )


def last_cycles(cycled: DataFrame, by: str = "series") -> DataFrame:
    """The context of each series' last cycle."""
    contexts = cycle_contexts(cycled, by)
    return contexts.withColumn("latest", F.max("cycle").over(W.partitionBy(by))).where("cycle = latest").drop("latest")


def cycle_markers(cycled: DataFrame, by: str = "series") -> DataFrame:
    """Sequence and label where cycles begin, from the second one, MOST_MARKERS at most."""
    label = F.when(F.col("outer_iteration").isNull(), F.concat(F.lit("a="), F.col("attempt"))).otherwise(F.concat(F.lit("μ="), F.col("outer_iteration"), F.lit(" · a="), F.col("attempt")))
    return cycled.where(F.col("cycle_start") & F.col("cycle").between(2, MOST_MARKERS + 1)).select(by, "sequence", label.alias("label"))


def attempt_spans(counts: DataFrame, by: str) -> DataFrame:
    """(by, attempt, n) as spans of row ordinals in order of the attempt's number: first, last."""
    w = W.partitionBy(by).orderBy("attempt").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum("n").over(w)
    return counts.where("n > 0").select(by, "attempt", (stop - F.col("n")).alias("first"), (stop - 1).alias("last"))


def row_attempts(rows: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """rows (by, ordinal) with the attempt whose span holds the ordinal; null where none does.

    Spans of a group neither overlap nor leave gaps, so the last span to begin at or before a row decides: one
    window over both in order, instead of a join by range.
    """
    begin = spans.select(by, F.col("first").alias("ordinal"), F.lit(0).alias("kind"), F.struct("attempt", "last").alias("span"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("r"))
    both = rows.select(by, "ordinal", F.lit(1).alias("kind"), F.lit(None).cast(begin.schema["span"].dataType).alias("span"), F.struct("*").alias("r")).union(begin.select(by, "ordinal", "kind", "span", "r"))
    held = F.last("span", ignorenulls=True).over(W.partitionBy(by).orderBy("ordinal", "kind"))
    out = both.withColumn("held", held).where("kind = 1")
    return out.select("r.*", F.when(F.col("held.last") >= F.col("ordinal"), F.col("held.attempt")).alias("attempt"))


def is_valid(y: Column, logarithmic: bool) -> Column:
    """Whether a point can be drawn: finite, and above zero on a logarithmic axis. A null cannot."""
    fine = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    return fine & (y > 0) if logarithmic else fine


def envelope(points: DataFrame, logarithmic: bool, by: str = "series", bins: int = BINS) -> DataFrame:
    """At most four points of each bin: first, last, lowest, highest valid one, ties to the earliest; and whether the bin is invalid.

    points: by, ordinal, x (strictly increasing), y, breaks (a cycle or hole begins here). A bin spans ceil(rows / bins)
    ordinals. It is invalid if it holds a point that cannot be drawn, or a break other than at ordinal 0: its points then stand alone.
    """
    whole = W.partitionBy(by)
    rows = points.withColumn("width", F.greatest(F.lit(1), F.ceil(F.count("*").over(whole) / bins))).withColumn("bin", F.expr("cast(ordinal div width as long)"))
    ok = is_valid(F.col("y"), logarithmic)
    rows = rows.withColumn("ok", ok)
    found = rows.groupBy(by, "bin").agg(
        F.bool_or(~F.col("ok") | (F.col("breaks") & (F.col("ordinal") > 0))).alias("invalid"),
        F.min(F.when(F.col("ok"), F.struct("x", "y"))).alias("p0"), F.max(F.when(F.col("ok"), F.struct("x", "y"))).alias("p1"),
        F.min(F.when(F.col("ok"), F.struct("y", "x"))).alias("low"), F.min(F.when(F.col("ok"), F.struct((-F.col("y")).alias("n"), "x"))).alias("high"),
    )
    point = lambda x, y: F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    four = F.array("p0", "p1", point(F.col("low.x"), F.col("low.y")), point(F.col("high.x"), -F.col("high.n")))
    return found.select(by, "bin", "invalid", F.array_sort(F.array_distinct(F.array_compact(four))).alias("points"))


def envelope_points(bins: DataFrame, by: str = "series") -> DataFrame:
    """The envelope as rows: by, bin, invalid, place, x, y. Whoever draws an invalid bin breaks the line around each of its points; one without a point that can be drawn is a row without x and y, which breaks the line too."""
    rows = bins.select(by, "bin", "invalid", F.posexplode_outer("points").alias("place", "p"))
    return rows.select(by, "bin", "invalid", F.coalesce("place", F.lit(0)).cast("long").alias("place"), "p.x", "p.y")


def curve_limits(points: DataFrame, logarithmic: bool, by: str = "series") -> DataFrame:
    """Display limits of x and y (log10 on a logarithmic axis) over points that can be drawn.

    Without any they are 0 and 1. A logarithmic axis reaches from -8 to -4 at least, and 3.5 % beyond; equal ends are widened.
    """
    value = F.log10("y") if logarithmic else F.col("y")
    ok = is_valid(F.col("y"), logarithmic) & is_valid(F.col("x"), False)
    found = points.groupBy(by).agg(F.min(F.when(ok, F.col("x"))).alias("x0"), F.max(F.when(ok, F.col("x"))).alias("x1"), F.min(F.when(ok, value)).alias("y0"), F.max(F.when(ok, value)).alias("y1"))
    for name, default in (("x0", 0.0), ("x1", 1.0), ("y0", 0.0), ("y1", 1.0)):
        found = found.withColumn(name, F.coalesce(name, F.lit(default)))
    if logarithmic:
        found = found.withColumn("y0", F.least("y0", F.lit(-8.0))).withColumn("y1", F.greatest("y1", F.lit(-4.0))).withColumn("pad", (F.col("y1") - F.col("y0")) * 0.035)
        found = found.withColumn("y0", F.col("y0") - F.col("pad")).withColumn("y1", F.col("y1") + F.col("pad"))
    found = found.withColumn("x1", F.when(F.col("x0") == F.col("x1"), F.col("x0") + 1).otherwise(F.col("x1")))
    wider = F.col("y0") + F.greatest(F.abs("y0") * 0.05, F.lit(1e-12))
    return found.withColumn("y1", F.when(F.col("y0") == F.col("y1"), wider).otherwise(F.col("y1"))).select(by, "x0", "x1", "y0", "y1")


def stride_sample(points: DataFrame, by: str = "series", most: int = 4096) -> DataFrame:
    """Every ceil(n / most)-th row by ordinal, and the last one."""
    whole = W.partitionBy(by)
    rows = points.withColumn("n_rows", F.count("*").over(whole))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / most))
    return rows.where((F.col("ordinal") % stride == 0) | (F.col("ordinal") == F.col("n_rows") - 1)).drop("n_rows")


def polyline_segments(points: DataFrame, logarithmic: bool, by: str = "series", most: int = 4096) -> DataFrame:
    """The sampled points of lines: by, ordinal, x, y, segment, dot. An invalid row anywhere between two sampled ones parts the line; a segment of one point is a dot."""
    w = W.partitionBy(by).orderBy("ordinal")
    bad = ~is_valid(F.col("y"), logarithmic)
    rows = points.withColumn("bad", bad).withColumn("bad_until", F.sum(bad.cast("long")).over(w))
    kept = stride_sample(rows, by, most)
    gap = F.col("bad_until") > F.coalesce(F.lag("bad_until").over(w), F.lit(0))
    kept = kept.withColumn("segment", F.sum(gap.cast("long")).over(w)).where("not bad")
    return kept.withColumn("dot", F.count("*").over(W.partitionBy(by, "segment")) == 1).select(by, "ordinal", "x", "y", "segment", "dot")


def tails(rows: DataFrame, by: str, order: list[str], most: int = 32) -> DataFrame:
    """The last `most` rows of each group."""
    w = W.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= most).drop("from_end")


def as_text(v: Column) -> Column:
    """A double as JSON text that keeps what JSON cannot hold: NaN and the infinities by name."""
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity").otherwise(json_number(v))


def metric_columns(names: list[str]) -> list[str]:
    """The columns of a history that are drawn: residuals by their prefix, and the current."""
    return [c for c in names if c == "J" or c.startswith("r_")]


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, y: one row for each drawn column of each row; a column that a segment lacks is null there, and so no point of it can be drawn."""
    return rows.unpivot(keys, metric_columns(rows.columns), "metric", "y")


def history_view(rows: DataFrame, monitor: bool, by: str = "series", bins: int = BINS) -> DataFrame:
    """by, metric, bin, invalid, place, x, y: the envelope of every drawn column of a history (by, attempt, phase, sequence, iteration, outer_iteration, columns); residuals are drawn on a logarithmic axis.

    The whole history is drawn by sequence, and broken where a cycle begins or a sequence is missing; the monitor is the last cycle alone, by iteration, broken where a sequence is missing.
    """
    found = sequence_holes(cycles(rows, by), by)
    if monitor:
        latest = F.max("cycle").over(W.partitionBy(by))
        found = found.withColumn("latest", latest).where("cycle = latest").withColumn("ordinal", F.row_number().over(W.partitionBy(by).orderBy("sequence")) - 1)
    x = F.col("iteration" if monitor else "sequence").cast("double")
    breaks = F.col("hole") if monitor else F.col("hole") | F.col("cycle_start")
    long = metrics(found.select(by, F.col("ordinal").cast("long").alias("ordinal"), x.alias("x"), breaks.alias("breaks"), *metric_columns(rows.columns)), [by, "ordinal", "x", "breaks"])
    curve = long.withColumn("curve", F.struct(by, "metric"))
    parts = [envelope_points(envelope(curve.where((F.col("metric") == "J") == current), not current, "curve", bins), "curve") for current in (False, True)]
    return parts[0].union(parts[1]).select(F.col(f"curve.{by}").alias(by), "curve.metric", "bin", "invalid", "place", "x", "y")


def column_tails(cells: DataFrame, by: str, most_rows: int = 32, most_columns: int = 256) -> DataFrame:
    """by, column, start_row, rows, values: the last rows of the first columns by name of each table (by, column, ordinal, value: text, which may be null); each list has most_rows entries at most."""
    lasts = cells.groupBy(by, "column").agg((F.max("ordinal") + 1).alias("rows"))
    kept = lasts.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("column"))).where(F.col("rank") <= most_columns).drop("rank")
    ends = cells.join(kept, [by, "column"]).where(F.col("ordinal") >= F.col("rows") - most_rows)
    ends = ends.groupBy(by, "column", "rows").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("value", F.lit("null")).alias("value")))).alias("v"))
    return ends.select(by, "column", F.greatest(F.lit(0), F.col("rows") - most_rows).cast("long").alias("start_row"), F.col("rows").cast("long").alias("rows"), F.array_join("v.value", ",").alias("values"))


def omitted_columns(cells: DataFrame, by: str, most_columns: int = 256) -> DataFrame:
    """by, columns, omitted: how many columns of each table its tails leave out."""
    found = cells.groupBy(by).agg(F.count_distinct("column").alias("columns"))
    return found.withColumn("omitted", F.greatest(F.lit(0).cast("long"), F.col("columns") - most_columns))
