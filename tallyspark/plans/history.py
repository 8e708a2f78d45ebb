"""Queries over history operators: each user's events are a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import history as ops
from tallyspark.plans.telemetry import rounded, table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("series"), n.alias("sequence"), F.lit("scba").alias("phase"), F.floor(n / 4000).cast("long").alias("attempt"),
        (n % 17).alias("iteration"), F.floor(n / 170).cast("long").alias("outer_iteration"), "value",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with injected NaN, infinite, zero and negative ones; a break at each new cycle."""
    n = F.col("event_id")
    y = F.when(n % 101 == 0, F.lit(float("nan"))).when(n % 103 == 0, F.lit(0.0)).when(n % 107 == 0, -F.col("value")).when(n % 109 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    found = ops.cycles(rows(spark, sf_dir).withColumn("event_id", F.col("sequence")).withColumn("y", y).withColumn("iteration", F.col("sequence") % 997).withColumn("outer_iteration", F.lit(1)))
    return found.select("series", F.col("ordinal").cast("long").alias("ordinal"), F.col("sequence").cast("double").alias("x"), "y", F.col("cycle_start").alias("breaks"), "cycle")


def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last cycle of each series alone, by iteration."""
    found = points(spark, sf_dir)
    last = found.groupBy("series").agg(F.max("cycle").alias("cycle"), F.max_by("ordinal", "ordinal").alias("top"))
    own = found.join(last.select("series", "cycle"), ["series", "cycle"])
    first = own.groupBy("series").agg(F.min("ordinal").alias("base"))
    return own.join(first, "series").select("series", (F.col("ordinal") - F.col("base")).alias("ordinal"), "x", "y", F.lit(False).alias("breaks"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("series"), F.year("o_orderdate").cast("long").alias("attempt")).agg(F.count("*").alias("n"))


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("series"), "o_orderkey")
    return orders.withColumn("ordinal", (F.row_number().over(W.partitionBy("series").orderBy("o_orderkey")) - 1 + (F.col("series") % 2) * 3).cast("long"))


QUERIES = {
    "cycle_index": lambda s, d: ops.cycle_contexts(ops.cycles(rows(s, d))),
    "last_cycle": lambda s, d: ops.last_cycles(ops.cycles(rows(s, d))),
    "cycle_markers": lambda s, d: ops.cycle_markers(ops.cycles(rows(s, d))),
    "sequence_holes": lambda s, d: ops.sequence_holes(rows(s, d)).groupBy("series").agg(F.count_if("hole").alias("holes")),
    "sequence_violations": lambda s, d: ops.sequence_violations(rows(s, d).select("series", F.col("sequence").alias("place"), (F.col("sequence") - F.when(F.col("sequence") % 53 == 0, 500).otherwise(0)).alias("sequence")), "series", "place").select("series", "place", "sequence"),
    "segment_overlaps": lambda s, d: ops.overlapping_segments(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.col("o_orderkey") % 5000).alias("last")), "o_custkey").select("o_custkey", "first", "last"),
    "history_envelope": lambda s, d: ops.envelope_points(ops.envelope(points(s, d), logarithmic=True, bins=40)),
    "history_envelope_linear": lambda s, d: ops.envelope_points(ops.envelope(points(s, d), logarithmic=False, bins=40)),
    "monitor_envelope": lambda s, d: ops.envelope_points(ops.envelope(monitor(s, d), logarithmic=True, bins=10)),
    "curve_limits": lambda s, d: rounded(ops.curve_limits(points(s, d), logarithmic=True)),
    "attempt_spans": lambda s, d: ops.attempt_spans(counts(s, d), "series"),
    "row_attempts": lambda s, d: ops.row_attempts(ordinals(s, d), ops.attempt_spans(counts(s, d), "series"), "series"),
    "stride_sample": lambda s, d: ops.stride_sample(points(s, d).select("series", "ordinal", "x"), most=37),
    "polyline_segments": lambda s, d: ops.polyline_segments(points(s, d), logarithmic=True, most=100),
    "history_tails": lambda s, d: ops.tails(table(s, d, "events").select("event_type", "event_id", "value"), "event_type", ["event_id"]),
    "nonfinite_text": lambda s, d: points(s, d).where("isnan(y) or abs(y) = double('infinity')").select("series", "ordinal", ops.as_text(F.col("y")).alias("text")),
}

_ROWS = "r AS (SELECT user_id % 20 AS series, event_id AS sequence, event_id // 4000 AS attempt, event_id % 17 AS iteration, event_id // 170 AS outer_iteration, value FROM events)"
_CYCLES = f"""{_ROWS}, l AS (SELECT *, lag(sequence) OVER w AS s0, lag(attempt) OVER w AS a0, lag(iteration) OVER w AS i0, lag(outer_iteration) OVER w AS o0 FROM r WINDOW w AS (PARTITION BY series ORDER BY sequence)),
    c AS (SELECT *, s0 IS NULL OR attempt <> a0 OR iteration <= i0 OR outer_iteration <> o0 AS start FROM l),
    k AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY series ORDER BY sequence)::BIGINT AS cycle FROM c)"""
_CONTEXT = """SELECT series, cycle, arg_min(attempt, sequence) AS attempt, arg_min(outer_iteration, sequence) AS outer_iteration, arg_min(iteration, sequence) AS first_iteration,
    arg_max(iteration, sequence) AS last_iteration, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) AS n FROM k GROUP BY series, cycle"""
_POINTS = """b AS (SELECT user_id % 20 AS series, event_id AS sequence, event_id // 4000 AS attempt, event_id % 997 AS iteration,
        CASE WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE WHEN event_id % 103 = 0 THEN 0 WHEN event_id % 107 = 0 THEN -value WHEN event_id % 109 = 0 THEN 'inf'::DOUBLE ELSE value END AS y FROM events),
    l AS (SELECT *, lag(attempt) OVER w AS a0, lag(iteration) OVER w AS i0, row_number() OVER w - 1 AS ordinal FROM b WINDOW w AS (PARTITION BY series ORDER BY sequence)),
    q AS (SELECT *, a0 IS NULL OR attempt <> a0 OR iteration <= i0 AS breaks FROM l),
    p AS (SELECT series, ordinal, sequence::DOUBLE AS x, y, breaks, sum(CAST(breaks AS INT)) OVER (PARTITION BY series ORDER BY sequence) AS cycle FROM q)"""


def _envelope_sql(points_sql: str, source: str, logarithmic: bool, bins: int) -> str:
    ok = "isfinite(y)" + (" AND y > 0" if logarithmic else "")
    return f"""WITH {points_sql},
    w AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY series) / {bins}.0))::BIGINT AS width, {ok} AS ok FROM {source}),
    g AS (SELECT *, ordinal // width AS bin FROM w),
    i AS (SELECT series, bin, bool_or(NOT ok OR (breaks AND ordinal > 0)) AS invalid, min(y) FILTER (ok) AS lo, max(y) FILTER (ok) AS hi, min(x) FILTER (ok) AS x0, max(x) FILTER (ok) AS x1 FROM g GROUP BY series, bin),
    t AS (SELECT g.series, g.bin, i.invalid, g.x, g.y, g.x = i.x0 OR g.x = i.x1 AS ends, g.y = i.lo AS is_lo, g.y = i.hi AS is_hi FROM g JOIN i ON g.series = i.series AND g.bin = i.bin WHERE g.ok),
    e AS (SELECT *, is_lo AND row_number() OVER (PARTITION BY series, bin, is_lo ORDER BY x) = 1 AS lo1, is_hi AND row_number() OVER (PARTITION BY series, bin, is_hi ORDER BY x) = 1 AS hi1 FROM t)
    SELECT series, bin, invalid, row_number() OVER (PARTITION BY series, bin ORDER BY x, y) - 1 AS place, x, y FROM e WHERE ends OR lo1 OR hi1
    UNION ALL SELECT series, bin, true, 0, NULL, NULL FROM i WHERE x0 IS NULL"""


_MONITOR = f"""{_POINTS}, z AS (SELECT *, max(cycle) OVER (PARTITION BY series) AS top FROM p),
    m AS (SELECT series, ordinal - min(ordinal) OVER (PARTITION BY series) AS ordinal, x, y, false AS breaks FROM z WHERE cycle = top)"""
_SPANS = """c AS (SELECT o_custkey % 50 AS series, year(o_orderdate) AS attempt, count(*) AS n FROM orders GROUP BY 1, 2),
    s AS (SELECT series, attempt, (sum(n) OVER w - n)::BIGINT AS first, (sum(n) OVER w - 1)::BIGINT AS last FROM c WINDOW w AS (PARTITION BY series ORDER BY attempt))"""

SQL = {
    "cycle_index": f"WITH {_CYCLES} {_CONTEXT}",
    "last_cycle": f"WITH {_CYCLES}, x AS ({_CONTEXT}) SELECT * FROM x QUALIFY cycle = max(cycle) OVER (PARTITION BY series)",
    "cycle_markers": f"WITH {_CYCLES} SELECT series, sequence, 'μ=' || outer_iteration || ' · a=' || attempt AS label FROM k WHERE start AND cycle BETWEEN 2 AND 25",
    "sequence_holes": f"WITH {_ROWS}, l AS (SELECT series, sequence - coalesce(lag(sequence) OVER (PARTITION BY series ORDER BY sequence), 0) > 1 AS hole FROM r) SELECT series, count_if(hole)::BIGINT AS holes FROM l GROUP BY 1",
    "sequence_violations": """
        WITH b AS (SELECT user_id % 20 AS series, event_id AS place, event_id - CASE WHEN event_id % 53 = 0 THEN 500 ELSE 0 END AS sequence FROM events),
        l AS (SELECT *, lag(sequence) OVER (PARTITION BY series ORDER BY place) AS before FROM b)
        SELECT series, place, sequence FROM l WHERE sequence <= 0 OR sequence <= before""",
    "segment_overlaps": """
        WITH b AS (SELECT o_custkey, o_orderkey AS first, o_orderkey + o_orderkey % 5000 AS last FROM orders),
        l AS (SELECT *, lag(last) OVER (PARTITION BY o_custkey ORDER BY first, last) AS before FROM b)
        SELECT o_custkey, first, last FROM l WHERE last < first OR before >= first""",
    "history_envelope": _envelope_sql(_POINTS, "p", True, 40),
    "history_envelope_linear": _envelope_sql(_POINTS, "p", False, 40),
    "monitor_envelope": _envelope_sql(_MONITOR, "m", True, 10),
    "curve_limits": f"""
        WITH {_POINTS}, a AS (SELECT series, min(x) AS x0, max(x) AS x1, least(min(log10(y)), -8) AS y0, greatest(max(log10(y)), -4) AS y1 FROM p WHERE isfinite(y) AND y > 0 GROUP BY 1)
        SELECT series, round(x0, 6) AS x0, round(CASE WHEN x0 = x1 THEN x0 + 1 ELSE x1 END, 6) AS x1, round(y0 - (y1 - y0) * 0.035::DOUBLE, 6) AS y0, round(y1 + (y1 - y0) * 0.035::DOUBLE, 6) AS y1 FROM a""",
    "attempt_spans": f"WITH {_SPANS} SELECT series, attempt, first, last FROM s",
    "row_attempts": f"""
        WITH {_SPANS}, o AS (SELECT o_custkey % 50 AS series, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 + (o_custkey % 50 % 2) * 3 AS ordinal FROM orders)
        SELECT o.series, o.o_orderkey, o.ordinal, s.attempt FROM o LEFT JOIN s ON o.series = s.series AND o.ordinal BETWEEN s.first AND s.last""",
    "stride_sample": f"""
        WITH {_POINTS}, n AS (SELECT series, ordinal, x, count(*) OVER (PARTITION BY series) AS n FROM p)
        SELECT series, ordinal, x FROM n WHERE ordinal % greatest(1, ceil(n / 37.0))::BIGINT = 0 OR ordinal = n - 1""",
    "polyline_segments": f"""
        WITH {_POINTS}, v AS (SELECT *, NOT (isfinite(y) AND y > 0) AS bad, count(*) OVER (PARTITION BY series) AS n FROM p),
        u AS (SELECT *, sum(CAST(bad AS INT)) OVER (PARTITION BY series ORDER BY ordinal) AS until FROM v),
        k AS (SELECT *, lag(until) OVER (PARTITION BY series ORDER BY ordinal) AS before FROM u WHERE ordinal % greatest(1, ceil(n / 100.0))::BIGINT = 0 OR ordinal = n - 1),
        g AS (SELECT *, sum(CAST(until > coalesce(before, 0) AS INT)) OVER (PARTITION BY series ORDER BY ordinal)::BIGINT AS segment FROM k)
        SELECT series, ordinal, x, y, segment, count(*) OVER (PARTITION BY series, segment) = 1 AS dot FROM g WHERE NOT bad""",
    "history_tails": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 32",
    "nonfinite_text": f"WITH {_POINTS} SELECT series, ordinal, CASE WHEN isnan(y) THEN 'NaN' WHEN y > 0 THEN 'Infinity' ELSE '-Infinity' END AS text FROM p WHERE NOT isfinite(y)",
}
