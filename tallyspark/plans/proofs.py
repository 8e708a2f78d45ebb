"""Queries over witnesses and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import bits
from tallyspark.operators import proofs as ops
from tallyspark.operators import witnesses
from tallyspark.plans.telemetry import table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as witnesses: label is the attempt, the first component the ratio; some are NaN or infinite."""
    n, first = F.col("vec_id"), F.element_at("embedding", 1).cast("double")
    ratio = F.when(n % 41 == 0, F.lit(float("nan"))).when(n % 43 == 0, F.lit(float("inf"))).when(n % 5 == 0, F.round(first, 1)).otherwise(first)
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("attempt"), n.alias("sequence"), ratio.alias("ratio"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.expr("slice(embedding, 1, cast(vec_id % 7 + 1 as int))").alias("values"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders without some rows, with a few changed prices, one of them only in the sign of zero, and more rows."""
    n = F.col("o_orderkey")
    return orders(spark, sf_dir).where("o_orderkey % 501 <> 7").withColumn("o_totalprice", F.when(n % 703 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where("o_orderkey % 3 <> 1")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_type", (F.row_number().over(W.partitionBy("event_type").orderBy("event_id")) - 1).alias("ordinal"), F.when(F.col("event_id") % 9 == 0, F.lit(-0.0)).when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


QUERIES = {
    "witness_selection": lambda s, d: witnesses.selected(rows(s, d)),
    "witness_omitted": lambda s, d: witnesses.omitted(rows(s, d)),
    "witness_attempt_proof": lambda s, d: witnesses.attempt_proof(rows(s, d)),
    "packed_offsets": lambda s, d: witnesses.packed_offsets(ragged(s, d), "label", "vec_id", "values"),
    "packed_offset_violations": lambda s, d: witnesses.offset_violations(witnesses.packed_offsets(ragged(s, d), "label", "vec_id", "values").select("label", F.col("vec_id").alias("ix"), (F.col("offset") + F.when(F.col("vec_id") % 50 == 9, 1).otherwise(0)).alias("offset"), "size", (F.col("size") + F.when(F.col("vec_id") % 60 == 8, 1).otherwise(0)).alias("declared")), "label"),
    "packed_slices": lambda s, d: witnesses.packed_slices(table(s, d, "embeddings").select(F.col("vec_id").alias("place"), F.col("embedding").alias("values")), table(s, d, "embeddings").select(F.col("vec_id").alias("place"), F.explode(F.array(F.struct(F.lit(0).alias("offset"), F.lit(3).alias("size")), F.struct(F.lit(3).alias("offset"), (F.col("vec_id") % 5).cast("int").alias("size")))).alias("o")).select("place", "o.*"), ["place", "offset"]),
    "packed_reindex": lambda s, d: witnesses.reindexed(rows(s, d).join(witnesses.selected(rows(s, d)), ["attempt", "sequence"], "left_semi").select("attempt", "sequence"), "attempt", "sequence"),
    "prefix_proof": lambda s, d: ops.prefix_violations(orders(s, d), changed(s, d), ["o_orderkey"]),
    "source_segments_preserved": lambda s, d: ops.payload_violations(orders(s, d), changed(s, d), "o_orderkey", "o_totalprice"),
    "coordinate_agreement": lambda s, d: ops.disagreements(chosen(s, d), changed(s, d).where("o_orderkey % 3 <> 0"), "o_orderkey", "o_totalprice"),
    "marker_child_violations": lambda s, d: ops.child_violations(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), orders(s, d).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", ["l_orderkey", "l_linenumber"], {"l_returnflag": ("A", "R")}),
    "compaction_ranges": lambda s, d: ops.compaction_ranges(days(s, d), "event_type", "day"),
    "compaction_payload_hash": lambda s, d: ops.payload_hash(numbered(s, d), "event_type", "ordinal", ["ordinal", "event_type", "value"]),
    "compaction_payload_digest": lambda s, d: ops.payload_digest(ops.payload_hash(numbered(s, d), "event_type", "ordinal", ["ordinal", "event_type", "value"]), "event_type"),
    "double_bits": lambda s, d: table(s, d, "customer").select("c_custkey", bits.double_bits(F.when(F.col("c_custkey") % 7 == 0, F.lit(-0.0)).when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))).alias("bits")),
}

_W = """w AS (SELECT label AS attempt, vec_id AS sequence, CASE WHEN vec_id % 41 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 43 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 5 = 0 THEN round(embedding[1]::DOUBLE, 1) ELSE embedding[1]::DOUBLE END AS ratio FROM embeddings),
    f AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY sequence) = 1 AS is_first, row_number() OVER (PARTITION BY attempt ORDER BY sequence DESC) = 1 AS is_last,
          isfinite(ratio) AND row_number() OVER (PARTITION BY attempt, isfinite(ratio) ORDER BY ratio DESC, sequence) = 1 AS is_peak,
          isfinite(ratio) AND ratio > 0 AND row_number() OVER (PARTITION BY attempt, isfinite(ratio) AND ratio > 0 ORDER BY sequence) = 1 AS is_positive FROM w),
    k AS (SELECT attempt, sequence, is_first OR is_last OR is_peak OR is_positive AS kept FROM f)"""
_OFF = "o AS (SELECT label, vec_id, (sum(vec_id % 7 + 1) OVER (PARTITION BY label ORDER BY vec_id) - (vec_id % 7 + 1))::BIGINT AS \"offset\", vec_id % 7 + 1 AS size FROM embeddings)"
_NEW = "n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 703 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 501 <> 7)"

SQL = {
    "witness_selection": f"WITH {_W} SELECT attempt, sequence FROM k WHERE kept",
    "witness_omitted": f"WITH {_W} SELECT attempt, sequence FROM k WHERE NOT kept",
    "witness_attempt_proof": f"WITH {_W} SELECT attempt, count(*) AS witnesses, count_if(kept)::BIGINT AS kept, string_agg(sequence::VARCHAR, ',' ORDER BY sequence) FILTER (kept) AS sequences FROM k GROUP BY attempt",
    "packed_offsets": f'WITH {_OFF} SELECT label, vec_id, "offset", size FROM o',
    "packed_offset_violations": f"""
        WITH {_OFF}, p AS (SELECT label, vec_id AS ix, "offset" + CASE WHEN vec_id % 50 = 9 THEN 1 ELSE 0 END AS off, size, size + CASE WHEN vec_id % 60 = 8 THEN 1 ELSE 0 END AS declared FROM o),
        e AS (SELECT *, coalesce(lag(off + size) OVER (PARTITION BY label ORDER BY ix), 0) AS expected FROM p)
        SELECT label, ix, off AS "offset", expected FROM e WHERE off <> expected OR size <> declared""",
    "packed_slices": 'SELECT vec_id AS place, 0 AS "offset", embedding[1:3] AS "values" FROM embeddings UNION ALL SELECT vec_id, 3, embedding[4:3 + vec_id % 5] FROM embeddings',
    "packed_reindex": f"WITH {_W} SELECT attempt, sequence, row_number() OVER (PARTITION BY attempt ORDER BY sequence) - 1 AS new_index FROM k WHERE kept",
    "prefix_proof": f"""
        WITH {_NEW} SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'row' ELSE 'o_totalprice' END AS "column" FROM orders o LEFT JOIN n ON o.o_orderkey = n.o_orderkey
        WHERE n.o_orderkey IS NULL OR n.price <> o.o_totalprice""",
    "source_segments_preserved": f"""
        WITH {_NEW} SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS rule FROM orders o LEFT JOIN n ON o.o_orderkey = n.o_orderkey
        WHERE n.o_orderkey IS NULL OR n.price <> o.o_totalprice""",
    "coordinate_agreement": f"""
        WITH {_NEW}, a AS (SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 1), b AS (SELECT * FROM n WHERE o_orderkey % 3 <> 0),
        x AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'only_in_second' WHEN b.o_orderkey IS NULL THEN 'only_in_first' WHEN a.price <> b.price THEN 'different' END AS rule
              FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
        SELECT o_orderkey, rule FROM x WHERE rule IS NOT NULL""",
    "marker_child_violations": """
        SELECT l_orderkey, l_linenumber, 'no_parent' AS rule FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        UNION ALL SELECT l_orderkey, l_linenumber, 'repeated' FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
        UNION ALL SELECT l_orderkey, l_linenumber, 'value' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')""",
    "compaction_ranges": """
        WITH f AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, day, (sum(n) OVER w - n)::BIGINT AS row_start, (sum(n) OVER w)::BIGINT AS row_stop FROM f WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
}
