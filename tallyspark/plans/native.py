"""Queries over checks of native records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import native as ops
from tallyspark.operators import witnesses as selecting
from tallyspark.plans.proofs import rows as witness_rows
from tallyspark.plans.telemetry import table


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as artifacts, each with a table of so many rows."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact"), (F.col("s_suppkey") % 90).alias("n"))


def columns(spark: SparkSession, sf_dir: str, kinds: dict[str, str], extra: str) -> DataFrame:
    """Their columns, by number: some are missing, too long, of another kind or width; and one more."""
    names = [*kinds.items(), (extra, "i")]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(k).alias("kind")) for i, (n, k) in enumerate(names)])).alias("c")
    rows = tables(spark, sf_dir).select("artifact", "n", each).select("artifact", "n", "c.*").withColumn("h", F.col("artifact") * 7 + F.col("i"))
    width = F.when(F.col("name").isin(*ops.NARROW), 1).otherwise(8)
    return rows.where("h % 53 <> 3").select("artifact", "name", F.when(F.col("h") % 47 == 5, "x").otherwise(F.col("kind")).alias("kind"), (width + F.when(F.col("h") % 43 == 6, 4).otherwise(0)).alias("width"), (F.col("n") + F.when(F.col("h") % 41 == 8, 1).otherwise(0)).alias("n"))


MARKERS = {"sequence": "i", "available": "i", **ops.MARKER_KINDS}


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("sequence"), (n % 5 != 0).cast("int").alias("available"), F.when(n % 7 != 0, "available").otherwise("failed").alias("fresh_map_status"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sequence"), F.when(line == 1, "").otherwise(F.concat(F.lit("c"), line % 3)).alias("channel"), F.element_at(F.array(*map(F.lit, ("retarded", "lesser", "greater", "mixed"))), (line % 4 + 1).cast("int")).alias("component"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select((n % 20).alias("series"), F.floor(n / 20).cast("long").alias("ordinal"), (n + 1).alias("sequence"), "value", "user_id")


def beside(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The history with markers and witness scalars: a few rows are missing, out of step, or flagged wrongly."""
    rows = history(spark, sf_dir)
    n = F.col("sequence")
    m = rows.where(n % 101 != 4).select("series", "ordinal", (n + F.when(n % 103 == 5, 1).otherwise(0)).alias("sequence"), F.when(n % 107 == 6, 2).when(n % 2 == 0, 1).otherwise(0).alias("available"), F.when(n % 50 == 8, 7).otherwise(1).alias("equilibrium_applicable"))
    w = rows.select("series", "ordinal", n.alias("sequence"), F.when(n % 113 == 7, -1).otherwise(1).alias("available"))
    return rows, m, w


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    matrix = F.when(n % 4 == 0, F.when(n % 12 == 0, 17).otherwise(18))
    return table(spark, sf_dir, "part").select(n.alias("artifact"), F.when(n % 4 == 0, n).alias("matrix_rows"), matrix.alias("matrix_columns"), F.when(n % 3 == 0, n + 1).alias("sequence_rows"), F.when(n % 5 == 0, n + 2).alias("row_count"))


SCHEMAS = {"science.history": ("scientific-history-v4",), "physics.analysis": ("analysis-v4", "analysis-v5")}


def enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    role = F.when(n % 2 == 0, "science.history").otherwise("physics.analysis")
    groups = F.array_compact(F.array(F.lit("metadata"), F.when(n % 11 != 0, "scba"), F.lit("more")))
    return table(spark, sf_dir, "part").select(n.alias("artifact"), role.alias("role"), F.when(n % 3 == 0, "analysis-v4").when(n % 3 == 1, "analysis-v5").otherwise("scientific-history-v4").alias("schema"), F.when(n % 13 != 0, "set-1").alias("contract_set"), F.when(n % 17 != 0, "4.0").otherwise("3.9").alias("version"), groups.alias("groups"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as source segments of their order's history."""
    n = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact"), F.concat(F.lit("s"), F.col("l_linenumber")).alias("sha256"), (F.col("l_orderkey") % 9 + F.when(n % 31 == 2, 1).otherwise(0)).alias("point"), F.col("l_linenumber").cast("long").alias("attempt"), F.when(n % 37 == 1, -1).otherwise(F.col("l_quantity").cast("long")).cast("long").alias("n"))


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("artifact")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return own.select("artifact", (F.col("artifact") % 9).alias("point"), F.lit(5).cast("long").alias("attempt"), "n")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("segment"), F.col("o_custkey").alias("series"), (F.col("o_custkey") % 7 + F.when(n % 23 == 2, 1).otherwise(0)).alias("point"), (n % 6).alias("attempt"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(n.alias("series"), (n % 7).alias("point"), (n % 4 + 1).alias("attempt"))


def annotations(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    n = F.col("p_partkey")
    key = F.element_at(F.array(*map(F.lit, ("units", "logical_shape", "axis", "nonfinite_count"))), (n % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.concat(key, F.lit(""), F.when(n % 4 < 2, "").otherwise("")).alias("key"), (F.when(n % 29 == 3, n + 1) if new else n).cast("string").alias("value") if new else n.cast("string").alias("value"), n)
    return rows.withColumn("value", F.coalesce("value", n.cast("string"))).where("p_partkey % 19 <> 6" if new else "true").select("path", "key", "value")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a series as intervals of event numbers, some with a wrong count."""
    n = F.col("event_id")
    found = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("series"), F.floor(n / 200).alias("attempt")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"))
    return found.select("series", "first", "last", (F.col("n") + F.when((F.col("attempt") + F.col("series")) % 3 == 0, 1).otherwise(0)).alias("n"))


def packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as packed arrays: their order is the record, their part the descriptor."""
    n = F.col("l_partkey")
    payloads = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100_000 + n * 10 + F.col("l_linenumber")).alias("ix"), F.col("l_orderkey").alias("record_ix"), n.alias("descriptor_ix"), F.col("l_linenumber").cast("long").alias("offset"), (n % 6 * 2).alias("size"))
    records = table(spark, sf_dir, "orders").where("o_orderkey % 33 <> 4").select(F.col("o_orderkey").alias("record_ix"), (F.col("o_orderkey") + 1).alias("sequence"))
    p = F.col("p_partkey")
    path = F.when(p % 27 == 1, F.concat(F.lit("/a/"), p)).when(p % 27 == 2, F.concat(F.lit("a/../"), p)).otherwise(F.concat(F.lit("a/"), p))
    descriptors = table(spark, sf_dir, "part").where("p_partkey % 35 <> 6").select(p.alias("descriptor_ix"), path.alias("path"), F.array((p % 6).cast("long"), F.when(p % 25 == 7, F.lit(3)).otherwise(F.lit(2)).cast("long")).alias("shape"))
    return payloads, records, descriptors


def evidence(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Vectors as witnesses; the new ones lack some, and have other shapes, annotations and signs of zero in others."""
    n = F.col("vec_id")
    values = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    if new:
        values = F.when(n % 17 == 3, F.transform(values, lambda x: -x)).when(n % 19 == 4, F.array(F.lit(-0.0), F.lit(0.0))).otherwise(values)
    values = values if new else F.when(n % 19 == 4, F.array(F.lit(0.0), F.lit(0.0))).otherwise(values)
    unit = F.when(n % 23 == 5, "meV").otherwise("eV") if new else F.lit("eV")
    rows = table(spark, sf_dir, "embeddings").select(n.alias("sequence"), F.concat(F.lit("p/"), n % 3).alias("path"), F.array(F.lit(2), F.when(n % 29 == 6, 1 if new else 2).otherwise(2)).alias("shape"), F.create_map(F.lit("unit"), unit, F.lit("v"), F.col("label").cast("string")).alias("attributes"), values.alias("values"))
    return rows.where("sequence % 13 <> 2") if new else rows


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = evidence(spark, sf_dir, True).where("sequence % 31 = 1").withColumn("path", F.lit("p/more"))
    return evidence(spark, sf_dir, True).union(more).union(more.withColumn("sequence", F.col("sequence") + 1_000_000))


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where("sequence <= 600")


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sequence")
    return history(spark, sf_dir).withColumn("value", F.when((n % 97 == 3) & (F.col("series") % 2 == 0), F.col("value") + 1).otherwise(F.col("value")))


def parts_of(rows: DataFrame, change: bool) -> DataFrame:
    """Source segments of a history: 100 sequences each."""
    made = rows.groupBy("series", F.floor((F.col("sequence") - 1) / 100).alias("segment")).agg(F.count("*").alias("n"))
    payload = F.when((F.col("series") == 7) & (F.col("segment") == 2), F.lit(-1)).otherwise(F.col("segment")) if change else F.col("segment")
    return made.select("series", F.concat(F.lit("d"), "segment").alias("sha256"), payload.cast("string").alias("payload"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(n.alias("dataset"), F.array((n % 7 + 1).cast("long"), (n % 11 * 40 + 1).cast("long")).alias("shape"), F.lit(8).alias("item_bytes"))


QUERIES = {
    "marker_column_violations": lambda s, d: ops.marker_column_violations(columns(s, d, MARKERS, "extra"), tables(s, d)),
    "child_column_violations": lambda s, d: ops.child_column_violations(columns(s, d, ops.CHILD_KINDS["channels"], "extra"), tables(s, d), "channels"),
    "measured_child_violations": lambda s, d: ops.measured_child_violations(channels(s, d), markers(s, d), "channels"),
    "diagnostic_violations": lambda s, d: ops.diagnostic_violations(*beside(s, d), "series"),
    "native_history_rows": lambda s, d: ops.history_rows(counted(s, d)),
    "native_envelope_violations": lambda s, d: ops.envelope_violations(enveloped(s, d), SCHEMAS, "4.0", ("metadata", "scba")),
    "cumulative_source_violations": lambda s, d: ops.source_violations(sources(s, d), cumulative(s, d)),
    "history_identity": lambda s, d: ops.identity_violations(segments(s, d), expected(s, d), False).withColumn("cumulative", F.lit(False)).union(ops.identity_violations(segments(s, d), expected(s, d), True).withColumn("cumulative", F.lit(True))),
    "annotation_violations": lambda s, d: ops.annotation_violations(annotations(s, d, False), annotations(s, d, True)),
    "interval_row_counts": lambda s, d: ops.row_count_violations(intervals(s, d), table(s, d, "events").select((F.col("user_id") % 20).alias("series"), F.col("event_id").alias("sequence")), "series"),
    "lost_witnesses": lambda s, d: ops.lost_witnesses(witness_rows(s, d), witness_rows(s, d).where("sequence % 8 <> 3"), ["attempt", "sequence"]),
    "decoded_payloads": lambda s, d: ops.decoded_payloads(*packed(s, d)).select("record_ix", "sequence", "path", F.element_at("shape", 2).alias("columns"), "offset", "size"),
    "packed_payload_violations": lambda s, d: ops.payload_violations(*packed(s, d)),
    "witness_violations": lambda s, d: ops.witness_violations(evidence(s, d, False), evidence(s, d, True)),
    "grown_witnesses": lambda s, d: ops.added_arrays(evidence(s, d, False), grown(s, d)),
    "history_row_counts": lambda s, d: ops.history_counts(table(s, d, "lineitem").select(F.col("l_orderkey").alias("artifact"), "l_returnflag"), table(s, d, "lineitem").where("l_linenumber % 5 <> 1").groupBy(F.col("l_orderkey").alias("artifact"), "l_returnflag").agg(F.count("*").alias("n")), ["artifact", "l_returnflag"]),
    "history_proof": lambda s, d: ops.history_proof(earlier(s, d).select("series", "sequence", "value", "user_id"), later(s, d).select("series", "sequence", "value", "user_id"), parts_of(earlier(s, d), False), parts_of(later(s, d), True), "series", "sequence"),
    "witness_rewrites": lambda s, d: ops.worth_selecting(witness_rows(s, d).where("attempt <> 3 or sequence < 25"), selecting.selected(witness_rows(s, d).where("attempt <> 3 or sequence < 25")), "attempt"),
    "array_blocks": lambda s, d: ops.array_blocks(arrays(s, d), 800).select("dataset", "block", F.element_at("starts", 1).alias("i"), F.element_at("starts", 2).alias("j"), F.element_at("sizes", 1).alias("rows"), F.element_at("sizes", 2).alias("columns")),
}


def _columns_sql(kinds: dict[str, str], exact: bool) -> str:
    names = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate([*kinds.items(), ("extra", "i")]))
    known = "name <> 'extra'"
    wrong = "h % 47 = 5 OR (kind <> 's' AND h % 43 = 6)"
    return f"""
        WITH k AS (SELECT * FROM (VALUES {names}) v(i, name, kind)), r AS (SELECT s_suppkey AS artifact, name, kind, s_suppkey * 7 + i AS h FROM supplier, k)
        SELECT artifact, name, 'missing' AS rule FROM r WHERE h % 53 = 3 AND {known} UNION ALL SELECT artifact, name, 'length' FROM r WHERE h % 53 <> 3 AND h % 41 = 8
        UNION ALL SELECT artifact, name, 'kind' FROM r WHERE h % 53 <> 3 AND ({wrong}) {f'AND {known}' if exact else ''} {"UNION ALL SELECT artifact, name, 'unknown' FROM r WHERE h % 53 <> 3 AND name = 'extra'" if exact else ''}"""


_PACKED = """y AS (SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ix, l_orderkey AS record_ix, l_partkey AS descriptor_ix, l_linenumber::BIGINT AS off, l_partkey % 6 * 2 AS size FROM lineitem),
    r AS (SELECT o_orderkey AS record_ix, o_orderkey + 1 AS sequence FROM orders WHERE o_orderkey % 33 <> 4),
    x AS (SELECT p_partkey AS descriptor_ix, CASE p_partkey % 27 WHEN 1 THEN '/a/' WHEN 2 THEN 'a/../' ELSE 'a/' END || p_partkey AS path, p_partkey % 27 IN (1, 2) AS unsafe, p_partkey % 6 AS s1, CASE WHEN p_partkey % 25 = 7 THEN 3 ELSE 2 END AS s2 FROM part WHERE p_partkey % 35 <> 6)"""

SQL = {
    "marker_column_violations": _columns_sql(MARKERS, False),
    "child_column_violations": _columns_sql(ops.CHILD_KINDS["channels"], True),
    "measured_child_violations": """
        WITH c AS (SELECT l_orderkey AS sequence, CASE WHEN l_linenumber = 1 THEN '' ELSE 'c' || (l_linenumber % 3) END AS channel, ['retarded', 'lesser', 'greater', 'mixed'][l_linenumber % 4 + 1] AS state, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
        SELECT sequence, channel, state, 'unmeasured' AS rule FROM c WHERE sequence NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) UNION ALL SELECT sequence, channel, state, 'state' FROM c WHERE state = 'mixed'
        UNION ALL SELECT sequence, channel, state, 'channel' FROM c WHERE channel = '' UNION ALL SELECT sequence, channel, state, 'repeated' FROM c WHERE n > 1""",
    "diagnostic_violations": """
        WITH h AS (SELECT event_id % 20 AS series, event_id // 20 AS ordinal, event_id + 1 AS n FROM events)
        SELECT series, ordinal, 'sequence' AS rule FROM h WHERE n % 101 = 4 OR n % 103 = 5 UNION ALL SELECT series, ordinal, 'available' FROM h WHERE n % 101 <> 4 AND (n % 107 = 6 OR n % 113 = 7)
        UNION ALL SELECT series, ordinal, 'applicable' FROM h WHERE n % 101 <> 4 AND n % 107 <> 6 AND n % 2 = 0 AND n % 50 = 8""",
    "native_history_rows": """
        SELECT p_partkey AS artifact, CASE WHEN p_partkey % 12 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_partkey WHEN p_partkey % 3 = 0 THEN p_partkey + 1 WHEN p_partkey % 5 = 0 THEN p_partkey + 2 END AS n,
               CASE WHEN p_partkey % 12 = 0 THEN 'columns' WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'no_count' END AS fault FROM part""",
    "native_envelope_violations": """
        SELECT p_partkey AS artifact, 'contract_set' AS rule FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey, 'version' FROM part WHERE p_partkey % 17 = 0
        UNION ALL SELECT p_partkey, 'schema' FROM part WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 2) UNION ALL SELECT p_partkey, 'group' FROM part WHERE p_partkey % 11 = 0""",
    "cumulative_source_violations": """
        WITH s AS (SELECT l_orderkey AS artifact, 's' || l_linenumber AS sha256, l_partkey % 31 = 2 AS other, l_linenumber > 5 AS late, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS twice, l_partkey % 37 = 1 AS negative, l_quantity::BIGINT AS q FROM lineitem)
        SELECT DISTINCT artifact, sha256, 'point' AS rule FROM s WHERE other UNION ALL SELECT DISTINCT artifact, sha256, 'attempt' FROM s WHERE late UNION ALL SELECT DISTINCT artifact, sha256, 'repeated' FROM s WHERE twice
        UNION ALL SELECT DISTINCT artifact, sha256, 'rows' FROM s WHERE negative UNION ALL SELECT artifact, NULL, 'sum' FROM s GROUP BY artifact HAVING sum(CASE WHEN negative THEN -1 ELSE q END) <> sum(q)""",
    "history_identity": """
        WITH j AS (SELECT o_orderkey AS segment, o_orderkey % 23 = 2 AS other, o_orderkey % 6 AS attempt, o_custkey % 4 + 1 AS cutoff FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT unnest([true, false]) AS cumulative)
        SELECT segment, 'point' AS rule, cumulative FROM j, c WHERE other UNION ALL SELECT segment, 'attempt', cumulative FROM j, c WHERE attempt < 1 OR attempt > cutoff OR (NOT cumulative AND attempt <> cutoff)""",
    "annotation_violations": "SELECT p_brand AS path, CASE p_partkey % 4 WHEN 0 THEN 'units' ELSE 'axis' END AS key FROM part WHERE p_partkey % 4 IN (0, 2) AND (p_partkey % 19 = 6 OR p_partkey % 29 = 3)",
    "interval_row_counts": """
        WITH f AS (SELECT user_id % 20 AS series, event_id // 200 AS attempt, min(event_id) AS first, max(event_id) AS last, count(*) AS found FROM events GROUP BY 1, 2)
        SELECT series, first, last, found + 1 AS n, found FROM f WHERE (attempt + series) % 3 = 0""",
    "lost_witnesses": "SELECT label AS attempt, vec_id AS sequence FROM embeddings WHERE vec_id % 8 = 3",
    "decoded_payloads": f'WITH {_PACKED} SELECT y.record_ix, sequence, path, s2::BIGINT AS "columns", off AS "offset", size FROM y JOIN r ON y.record_ix = r.record_ix JOIN x ON x.descriptor_ix = y.descriptor_ix',
    "packed_payload_violations": f"""
        WITH {_PACKED}, j AS (SELECT y.*, r.sequence, x.path, x.unsafe, x.s1 * x.s2 AS product, count(*) OVER (PARTITION BY y.record_ix, x.path) AS times FROM y LEFT JOIN r ON y.record_ix = r.record_ix LEFT JOIN x ON x.descriptor_ix = y.descriptor_ix)
        SELECT ix, 'record' AS rule FROM j WHERE sequence IS NULL UNION ALL SELECT ix, 'descriptor' FROM j WHERE path IS NULL UNION ALL SELECT ix, 'path' FROM j WHERE unsafe UNION ALL SELECT ix, 'shape' FROM j WHERE product <> size
        UNION ALL SELECT ix, 'repeated' FROM j WHERE path IS NOT NULL AND times > 1""",
    "witness_violations": """
        WITH n AS (SELECT vec_id AS sequence, 'p/' || (vec_id % 3) AS path FROM embeddings)
        SELECT sequence, path, 'missing' AS rule FROM n WHERE sequence % 13 = 2 UNION ALL SELECT sequence, path, 'shape' FROM n WHERE sequence % 13 <> 2 AND sequence % 29 = 6
        UNION ALL SELECT sequence, path, 'annotation' FROM n WHERE sequence % 13 <> 2 AND sequence % 23 = 5 UNION ALL SELECT sequence, path, 'values' FROM n WHERE sequence % 13 <> 2 AND (sequence % 17 = 3 OR sequence % 19 = 4)""",
    "grown_witnesses": "SELECT vec_id AS sequence, 'p/more' AS path FROM embeddings WHERE vec_id % 13 <> 2 AND vec_id % 31 = 1",
    "history_row_counts": """
        WITH f AS (SELECT l_orderkey AS artifact, l_returnflag, count(*) AS found, count_if(l_linenumber % 5 <> 1)::BIGINT AS declared FROM lineitem GROUP BY 1, 2) SELECT artifact, l_returnflag, declared, found FROM f WHERE declared <> found""",
    "history_proof": """
        WITH h AS (SELECT event_id % 20 AS series, event_id + 1 AS n, event_id // 100 AS segment FROM events), o AS (SELECT * FROM h WHERE n <= 600)
        SELECT series, count(*) FILTER (n <= 600) AS previous_rows, count(*) AS replacement_rows, count(DISTINCT segment) FILTER (n <= 600) AS previous_source_segments, count(DISTINCT segment) AS replacement_source_segments,
               count(*) FILTER (n <= 600 AND n % 97 = 3 AND series % 2 = 0) + CASE WHEN series = 7 AND count(*) FILTER (n <= 600 AND segment = 2) > 0 THEN 1 ELSE 0 END AS faults FROM h GROUP BY series HAVING count(*) FILTER (n <= 600) > 0""",
    "witness_rewrites": """
        WITH w AS (SELECT label AS attempt, vec_id AS sequence, CASE WHEN vec_id % 41 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 43 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 5 = 0 THEN round(embedding[1]::DOUBLE, 1) ELSE embedding[1]::DOUBLE END AS ratio FROM embeddings WHERE label <> 3 OR vec_id < 25),
        a AS (SELECT attempt, count(*) AS n, min(sequence) AS f, max(sequence) AS l, min(sequence) FILTER (isfinite(ratio) AND ratio > 0) AS p, max(ratio) FILTER (isfinite(ratio)) AS top FROM w GROUP BY 1),
        k AS (SELECT a.attempt, n, len(list_distinct(list_filter([f, l, p, (SELECT min(sequence) FROM w WHERE w.attempt = a.attempt AND w.ratio = a.top)], lambda x: x IS NOT NULL))) AS kept FROM a)
        SELECT attempt, n AS source_witnesses, kept::BIGINT AS selected_witnesses FROM k WHERE n > 4 AND kept < n""",
    "array_blocks": """
        WITH a AS (SELECT s_suppkey AS dataset, s_suppkey % 7 + 1 AS n, s_suppkey % 11 * 40 + 1 AS m FROM supplier), b AS (SELECT *, least(m, 100) AS sm, least(n, greatest(1, 100 // least(m, 100))) AS sn FROM a),
        c AS (SELECT *, ceil(m / sm)::BIGINT AS km, ceil(n / sn)::BIGINT AS kn FROM b), d AS (SELECT *, unnest(range(km * kn)) AS block FROM c)
        SELECT dataset, block, block // km * sn AS i, block % km * sm AS j, least(sn, n - block // km * sn) AS "rows", least(sm, m - block % km * sm) AS "columns" FROM d""",
}
