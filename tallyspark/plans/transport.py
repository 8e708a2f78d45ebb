"""Queries over transport, views, strict JSON, identities and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.bits import canonical
from tallyspark.functions.strict_json import json_fault
from tallyspark.operators import snapshot, telemetry, transport, views
from tallyspark.plans.telemetry import COVERAGE_SQL, ROUNDED, as_resources, rounded, table
from tallyspark.streaming import coverage

STEP = 500
#: Roles that references have here: one of each place, and some that only look like one.
ROLES = ("model", "science.comparison", "performance.summary", "control.state", "science.history", "performance.window", "performance.full", "history.x", "control.series", "physics.analysis", "science.figure")
#: Bytes of a page of archives before compression, about.
PAGE_BYTES = 8 << 20


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "doc_id", (F.col("n_chars") + transport.OVERHEAD).alias("weight"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a fault in every 97th document: its second chunk is shifted."""
    plan = transport.chunk_plan(objects(spark, sf_dir), "doc_id", STEP).select("doc_id", "offset", "bytes")
    return plan.withColumn("offset", F.col("offset") + F.when((F.col("doc_id") % 97 == 3) & (F.col("offset") == STEP), 1).otherwise(0))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).select("doc_id", (F.length("content") + F.when(F.col("doc_id") % 89 == 2, 1).otherwise(0)).cast("long").alias("bytes"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("snapshot"), (F.floor(F.col("page_id") / 10) + 1).alias("part"))
    counts = rows.groupBy("snapshot").agg(F.count("*").alias("count"))
    kept = rows.where("part % 7 <> 3")
    return kept.union(kept.where("part % 11 = 4")).join(counts, "snapshot")


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks in archives, restored; one row for each with whether its digest is still the same."""
    docs = objects(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    pieces = transport.chunk_plan(docs, "path", 4096).withColumn("snapshot", F.lit("s"))
    archives = transport.build_parts(transport.deal_pages(pieces, "snapshot", PAGE_BYTES), "snapshot", "page", 200_000_000)
    restored = transport.restore(archives).select("path", F.col("sha256").alias("restored"))
    return docs.select("doc_id", "path", F.sha2("content", 256).alias("sha256")).join(restored, "path", "left").select("doc_id", F.col("sha256").eqNullSafe(F.col("restored")).alias("same"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % len(ROLES) + 1).cast("int")).alias("role"))


def placed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units: their order is the snapshot, four parts share a page."""
    w = F.row_number().over(W.partitionBy("l_orderkey", "page").orderBy("name")) - 1
    n = F.col("l_partkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", n.alias("name")).agg(F.max("l_quantity").cast("long").alias("bytes"))
    return rows.withColumn("page", F.expr("name % 4").cast("long")).withColumn("place", w.cast("long")).select("l_orderkey", "page", "place", "name", F.lit(0).cast("long").alias("offset"), "bytes")


def set_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("snapshot"), F.lit(40).cast("long").alias("count"), (n * 1000 + 1000).alias("maximum_part_bytes"), F.sha2(n.cast("string"), 256).alias("snapshot_identity"), F.sha2(F.concat(F.lit("i"), n), 256).alias("index_sha256"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parts of their nation's snapshot."""
    n, k = F.col("c_custkey"), F.col("c_nationkey")
    most = F.when(n % 17 == 1, 0).otherwise(k * 1000 + 1000)
    identity = F.sha2((k + F.when(n % 19 == 2, 1).otherwise(0)).cast("string"), 256)
    return table(spark, sf_dir, "customer").select(k.alias("snapshot"), (n % 42).alias("index"), F.lit(40).cast("long").alias("count"), (n * 20).alias("bytes"), most.alias("maximum_part_bytes"), identity.alias("snapshot_identity"), F.sha2(F.concat(F.lit("i"), k), 256).alias("index_sha256"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of documents against the members of the archives that carry them, with a fault in each: none but those may be found."""
    docs = objects(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    pieces = transport.chunk_plan(docs, "path", 4096).withColumn("snapshot", F.lit("s"))
    dealt = transport.deal_pages(pieces, "snapshot", PAGE_BYTES)
    archives = transport.build_parts(dealt.where("path <> '5'"), "snapshot", "page", 200_000_000)
    found = transport.archive_members(archives.withColumn("part", F.concat_ws("-", "page", "split")), "part").withColumnRenamed("member", "path")
    index = pieces.select(F.concat_ws("@", "path", "offset").alias("path"), F.when(F.col("path") == "7", F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("path") == "9", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"))
    return snapshot.differences(index, found.where("path not like '11@%'"), "path", ["sha256", "bytes"], ("index", "archives"))


def compacting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_partkey") * 10 + F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("table_name"), n.alias("object"), F.col("l_quantity").cast("long").alias("bytes"))
    return items, items.where("object % 7 = 0").select("object")


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes of each brand as a non-uniform axis."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("figure"), F.col("p_size").cast("double").alias("coordinate")).distinct()
    return rows.withColumn("i", F.row_number().over(W.partitionBy("figure").orderBy("coordinate")) - 1)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = table(spark, sf_dir, "part").select(F.col("p_brand").alias("figure")).distinct()
    return figures.select("figure", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("place")).withColumn("x", F.col("place") * 0.5)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, price = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("figure"), n, F.when(n % 13 == 0, F.lit(float("nan"))).when(n % 17 != 0, price - F.lit(1000.0)).alias("value"))


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("branch"), (F.col("o_custkey") % 5).alias("temperature"), F.when(n % 3 == 0, n % 7).alias("order"), n.alias("pos"),
        n.cast("double").alias("x"), F.when(n % 11 != 0, F.col("o_totalprice")).alias("y"), F.when(n % 19 != 0, F.col("o_orderstatus") == "F").alias("accepted"),
    )


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties, some of them spoilt in one of seven ways."""
    n, p = F.col("event_id"), F.col("props")
    bad = ['{"k": 1, "k": 2}', '{"k": NaN}', '{"k": 1e999}', '{"k": 1,}', '{"k": 1} x', "[1]", '{"k": ']
    text = p
    for i, b in enumerate(bad):
        text = F.when(n % 50 == i, F.lit(b)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def model_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each customer's canonical bytes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            digests = [hashlib.sha256(canonical({"key": r["c_custkey"], "segment": r["c_mktsegment"]})).hexdigest() for r in rows]
            yield pa.record_batch([batch.column("c_custkey"), pa.array(digests, pa.string())], names=["c_custkey", "digest"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").mapInArrow(run, "c_custkey long, digest string")


def stream_cpu_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = coverage.stream_of(spark, sf_dir, "events")
    return rounded(coverage.committed(coverage.coverage_stream(as_resources(events)), "update", coverage.latest))


QUERIES = {
    "object_priority": lambda s, d: transport.object_priority(table(s, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % len(ROLES) + 1).cast("int")).alias("role"))),
    "object_order": lambda s, d: transport.object_order(table(s, d, "documents").select("lang", F.concat(F.lit("objects/"), "doc_id").alias("name"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 9 == 2, "?").otherwise("")), 256).alias("sha256")), transport.object_priority(roles(s, d)), "lang"),
    "transport_units": lambda s, d: transport.transport_units(objects(s, d), "doc_id", 3_000),
    "refined_layout": lambda s, d: transport.refined_layout(placed_units(s, d), placed_units(s, d).where("(l_orderkey + page) % 3 = 0").select("l_orderkey", "page").distinct(), "l_orderkey"),
    "layout_faults": lambda s, d: transport.layout_faults(placed_units(s, d), placed_units(s, d).where("l_orderkey % 3 = 0").select("l_orderkey", "page").union(placed_units(s, d).where("l_orderkey % 5 = 0").select("l_orderkey", F.lit(0).cast("long"))).distinct(), "l_orderkey"),
    "part_headers": lambda s, d: transport.part_headers(table(s, d, "customer").select(F.col("c_nationkey").alias("snapshot"), F.col("c_custkey").alias("index")), set_of(s, d).drop("count"), "snapshot"),
    "header_violations": lambda s, d: transport.header_violations(headers(s, d), set_of(s, d), "snapshot"),
    "metadata_fits": lambda s, d: transport.metadata_fits(table(s, d, "pages").select((F.col("page_id") % 20).alias("snapshot"), F.concat(F.lit("m"), "page_id").alias("name"), F.encode("html", "UTF-8").alias("content")), "snapshot", 3_000),
    "compaction_groups": lambda s, d: transport.compaction_groups(*compacting(s, d)),
    "archive_verification": verified,
    "page_layout": lambda s, d: transport.page_layout(units(s, d), "lang", ["doc_id"], 60_000, 5_000),
    "chunk_plan": lambda s, d: transport.chunk_plan(objects(s, d), "doc_id", STEP).drop("piece"),
    "segment_contiguity": lambda s, d: transport.contiguity_violations(segments(s, d), sizes(s, d), "doc_id"),
    "transport_index": lambda s, d: transport.transport_index(transport.chunk_plan(objects(s, d), "doc_id", STEP).select("doc_id", "offset", "bytes", (F.col("doc_id") % 9).alias("part")), "doc_id"),
    "part_set_validation": lambda s, d: transport.part_set_violations(parts(s, d), "snapshot"),
    "transport_roundtrip": roundtrip,
    "heatmap_nearest": lambda s, d: views.nearest_cells(grid(s, d), axis(s, d), "figure"),
    "heatmap_range": lambda s, d: rounded(views.colour_range(cells(s, d), "figure")),
    "heatmap_colors": lambda s, d: views.coloured(cells(s, d), "figure").select("figure", "p_partkey", "r", "g", "b"),
    "axis_violations": lambda s, d: views.axis_violations(axis(s, d).withColumn("coordinate", F.when(F.col("figure").endswith("3") & (F.col("i") == 2), F.lit(-1.0)).otherwise(F.col("coordinate"))), "figure"),
    "series_curves": lambda s, d: views.series_curves(series_points(s, d), ["branch", "temperature"]),
    "json_strict": lambda s, d: raw_json(s, d).select("event_id", json_fault(F.col("text")).alias("fault")),
    "model_identity": model_identity,
    "stream_span_totals": lambda s, d: coverage.committed(telemetry.phase_totals(_stream_spans(s, d)), "complete"),
    "stream_tumbling": lambda s, d: coverage.committed(coverage.tumbling_counts(coverage.stream_of(s, d, "events"), "ts"), "complete"),
    "stream_cpu_coverage": stream_cpu_coverage,
}


def _stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = coverage.stream_of(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("timing_kind"), F.lit("phase_duration").alias("measurement_kind"), F.col("l_quantity").alias("duration_seconds"), F.col("l_linenumber").cast("long").alias("call_count"))


_CHUNKS = "c AS (SELECT doc_id, unnest(range(0, greatest(octet_length(encode(text)), 1), 500)) AS off, encode(text) AS b FROM documents), k AS (SELECT doc_id, off, least(500, octet_length(b) - off) AS n, b FROM c)"
_AXIS = "a AS (SELECT figure, coordinate, row_number() OVER (PARTITION BY figure ORDER BY coordinate) - 1 AS i FROM (SELECT DISTINCT p_brand AS figure, p_size::DOUBLE AS coordinate FROM part))"
_CELLS = "c AS (SELECT p_brand AS figure, p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 17 <> 0 THEN p_retailprice - 1000 END AS value FROM part), l AS (SELECT figure, max(abs(value)) FILTER (isfinite(value)) AS lim FROM c GROUP BY 1)"

SQL = {
    "stream_cpu_coverage": f"WITH {COVERAGE_SQL} SELECT allocation_id, samples, {ROUNDED}, first_sample_ns, last_sample_ns FROM cov",
    "object_priority": f"""
        WITH r AS (SELECT sha256(text) AS sha256, {list(ROLES)}[doc_id % {len(ROLES)} + 1] AS role FROM documents)
        SELECT sha256, min(CASE WHEN role IN ('model', 'plan', 'science.comparison', 'performance.summary', 'control.state') THEN 0 WHEN role = 'science.history' THEN 1 WHEN role IN ('performance.window', 'performance.full') THEN 3 ELSE 5 END)::INTEGER AS priority FROM r GROUP BY 1""",
    "chunk_plan": f"WITH {_CHUNKS} SELECT doc_id, off AS \"offset\", n AS bytes, sha256(unhex(substr(hex(b), off * 2 + 1, n * 2))) AS sha256 FROM k",
    "object_order": f"""
        WITH r AS (SELECT sha256(text) AS sha256, {list(ROLES)}[doc_id % {len(ROLES)} + 1] AS role FROM documents),
        p AS (SELECT sha256, min(CASE WHEN role IN ('model', 'plan', 'science.comparison', 'performance.summary', 'control.state') THEN 0 WHEN role = 'science.history' THEN 1 WHEN role IN ('performance.window', 'performance.full') THEN 3 ELSE 5 END)::INTEGER AS priority FROM r GROUP BY 1),
        o AS (SELECT lang, 'objects/' || doc_id AS name, sha256(text || CASE WHEN doc_id % 9 = 2 THEN '?' ELSE '' END) AS sha256 FROM documents)
        SELECT lang, name, coalesce(priority, 10)::INTEGER AS priority, row_number() OVER (PARTITION BY lang ORDER BY coalesce(priority, 10), name) - 1 AS place FROM o LEFT JOIN p USING (sha256)""",
    "refined_layout": """
        WITH u AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS name, max(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2), p AS (SELECT *, name % 4 AS page FROM u),
        q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY name) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey, page) AS n, (l_orderkey + page) % 3 = 0 AS over FROM p),
        c AS (SELECT l_orderkey, page, place, name, CASE WHEN over AND n > 1 AND place >= greatest(1, n // 2) THEN 1 WHEN over AND n = 1 AND page = 0 THEN 1 ELSE 0 END AS part, 0 AS off, bytes FROM q WHERE NOT (over AND n = 1 AND page > 0)
              UNION ALL SELECT l_orderkey, page, place, name, k, k * greatest(1, bytes // 2), least(greatest(1, bytes // 2), bytes - k * greatest(1, bytes // 2)) FROM q, LATERAL (SELECT unnest(range(0, ceil(bytes / greatest(1, bytes // 2))::BIGINT)) AS k) WHERE over AND n = 1 AND page > 0),
        d AS (SELECT DISTINCT l_orderkey, page, part FROM c UNION SELECT DISTINCT l_orderkey, 0, 0 FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, part) - 1 AS new FROM d)
        SELECT l_orderkey, new AS page, row_number() OVER (PARTITION BY l_orderkey, new ORDER BY place, off) - 1 AS place, name, off AS "offset", bytes FROM c JOIN e USING (l_orderkey, page, part)""",
    "layout_faults": """
        WITH u AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS name, max(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, name % 4 AS page, count(*) AS n, max(bytes) AS bytes FROM u GROUP BY 1, 2),
        v AS (SELECT l_orderkey, page FROM p WHERE l_orderkey % 3 = 0 UNION SELECT l_orderkey, 0 FROM u WHERE l_orderkey % 5 = 0)
        SELECT l_orderkey, page, CASE WHEN n IS NULL THEN 'metadata' ELSE 'headers' END AS fault FROM v LEFT JOIN p USING (l_orderkey, page) WHERE n IS NULL OR (page > 0 AND n = 1 AND bytes <= 1)""",
    "part_headers": """
        WITH c AS (SELECT c_nationkey AS snapshot, count(*) AS n FROM customer GROUP BY 1)
        SELECT snapshot, c_custkey AS "index", to_json({'count': n, 'index': c_custkey, 'index_sha256': sha256('i' || snapshot), 'maximum_part_bytes': snapshot * 1000 + 1000, 'snapshot_identity': sha256(snapshot::VARCHAR)})::VARCHAR AS header FROM customer JOIN c ON c_nationkey = snapshot""",
    "header_violations": """
        WITH h AS (SELECT c_nationkey AS snapshot, c_custkey % 42 AS "index", c_custkey * 20 AS bytes, CASE WHEN c_custkey % 17 = 1 THEN 0 ELSE c_nationkey * 1000 + 1000 END AS most, c_custkey % 19 = 2 OR c_custkey % 17 = 1 AS other FROM customer)
        SELECT snapshot, "index", 'place' AS rule FROM h WHERE "index" NOT BETWEEN 1 AND 40 UNION ALL SELECT snapshot, "index", 'limit' FROM h WHERE most = 0 UNION ALL SELECT snapshot, "index", 'size' FROM h WHERE bytes > most UNION ALL SELECT snapshot, "index", 'other_set' FROM h WHERE other""",
    "compaction_groups": """
        SELECT l_orderkey AS record, l_returnflag AS table_name, count(*) AS segments, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem
        WHERE l_partkey * 10 + l_linenumber NOT IN (SELECT l_partkey * 10 + l_linenumber FROM lineitem WHERE (l_partkey * 10 + l_linenumber) % 7 = 0) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "archive_verification": """
        WITH k AS (SELECT doc_id, unnest(range(0, greatest(octet_length(encode(text)), 1), 4096)) AS off FROM documents)
        SELECT doc_id || '@' || off AS path, CASE doc_id WHEN 7 THEN 'sha256' WHEN 9 THEN 'bytes' ELSE 'only_in_index' END AS rule FROM k WHERE doc_id IN (5, 7, 9, 11)""",
    "page_layout": """
        WITH RECURSIVE u AS (SELECT lang, doc_id, n_chars + 1024 AS weight, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
        f AS (SELECT lang, doc_id, weight, rn, CASE WHEN 5000 + weight > 60000 THEN 1 ELSE 0 END AS page, CASE WHEN 5000 + weight > 60000 THEN weight ELSE 5000 + weight END AS used FROM u WHERE rn = 1
              UNION ALL SELECT u.lang, u.doc_id, u.weight, u.rn, CASE WHEN f.used + u.weight > 60000 THEN f.page + 1 ELSE f.page END, CASE WHEN f.used + u.weight > 60000 THEN u.weight ELSE f.used + u.weight END
              FROM f JOIN u ON u.lang = f.lang AND u.rn = f.rn + 1)
        SELECT lang, doc_id, weight, page::BIGINT AS page FROM f""",
    "segment_contiguity": f"""
        WITH {_CHUNKS}, s AS (SELECT doc_id, off + CASE WHEN doc_id % 97 = 3 AND off = 500 THEN 1 ELSE 0 END AS off, n FROM k),
        p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM s)
        SELECT DISTINCT doc_id, 'gap' AS rule FROM p WHERE off <> expected UNION ALL SELECT DISTINCT doc_id, 'empty' FROM s WHERE n = 0
        UNION ALL SELECT doc_id, 'total' FROM documents WHERE doc_id % 89 = 2""",
    "transport_index": f"""
        WITH {_CHUNKS} SELECT doc_id, CASE WHEN count(*) = 1 THEN 'whole' ELSE 'chunks' END AS kind, string_agg((doc_id % 9) || ':' || off || ':' || n, ',' ORDER BY off) AS segments FROM k GROUP BY doc_id""",
    "part_set_validation": """
        WITH r AS (SELECT page_id % 10 AS snapshot, page_id // 10 + 1 AS part FROM pages), c AS (SELECT snapshot, count(*) AS n FROM r GROUP BY 1), k AS (SELECT * FROM r WHERE part % 7 <> 3),
        w AS (SELECT snapshot, unnest(range(1, n + 1)) AS part FROM c)
        SELECT snapshot, part, 'missing' AS rule FROM w WHERE (snapshot, part) NOT IN (SELECT (snapshot, part) FROM k) UNION ALL SELECT snapshot, part, 'twice' FROM k WHERE part % 11 = 4""",
    "heatmap_nearest": f"""
        WITH {_AXIS}, m AS (SELECT figure, (coordinate + lead(coordinate) OVER (PARTITION BY figure ORDER BY i)) / 2 AS mid FROM a),
        g AS (SELECT figure, place::INTEGER AS place, place * 0.5::DOUBLE AS x FROM (SELECT DISTINCT p_brand AS figure FROM part), range(0, 120) r(place))
        SELECT g.figure, g.place, g.x, count(m.mid) AS i FROM g LEFT JOIN m ON m.figure = g.figure AND m.mid < g.x GROUP BY 1, 2, 3""",
    "heatmap_range": f'WITH {_CELLS} SELECT figure, round(max(abs(value)) FILTER (isfinite(value)), 6) AS "limit", round(min(value) FILTER (isfinite(value)), 6) AS low, round(max(value) FILTER (isfinite(value)), 6) AS high, count_if(value IS NULL OR NOT isfinite(value))::BIGINT AS missing FROM c GROUP BY 1',
    "heatmap_colors": f"""
        WITH {_CELLS}, s AS (SELECT c.figure, p_partkey, value IS NOT NULL AND isfinite(value) AS fine, value / lim AS s FROM c JOIN l ON c.figure = l.figure)
        SELECT figure, p_partkey, CASE WHEN fine THEN floor(255 * (1 - greatest(0, -s)))::INTEGER ELSE 155 END AS r, CASE WHEN fine THEN floor(255 * (1 - abs(s)))::INTEGER ELSE 155 END AS g,
               CASE WHEN fine THEN floor(255 * (1 - greatest(0, s)))::INTEGER ELSE 155 END AS b FROM s""",
    "axis_violations": f"WITH {_AXIS} SELECT figure FROM a GROUP BY figure HAVING count(*) < 2 OR (figure LIKE '%3' AND count(*) > 2)",
    "series_curves": """
        WITH p AS (SELECT o_orderpriority AS branch, o_custkey % 5 AS temperature, o_orderkey::DOUBLE AS x, o_totalprice AS y, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus = 'F' END AS accepted,
                          row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 5 ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END, 0), o_orderkey) - 1 AS place FROM orders WHERE o_orderkey % 11 <> 0)
        SELECT branch, temperature, place, x, CASE WHEN accepted THEN y END AS y, false AS marker FROM p UNION ALL SELECT branch, temperature, place, x, y, true FROM p WHERE NOT coalesce(accepted, false)""",
    "json_strict": """
        SELECT event_id, CASE event_id % 50 WHEN 0 THEN 'repeated' WHEN 1 THEN 'number' WHEN 2 THEN 'number' WHEN 3 THEN 'syntax' WHEN 4 THEN 'syntax' WHEN 5 THEN 'root' WHEN 6 THEN 'syntax' END AS fault FROM events""",
    "model_identity": "SELECT c_custkey, sha256('m2{s3:keyi' || length(c_custkey::VARCHAR) || ':' || c_custkey || 's7:segments' || octet_length(encode(c_mktsegment)) || ':' || c_mktsegment || '}') AS digest FROM customer",
    "stream_span_totals": "SELECT l_returnflag || ':' || l_linestatus AS phase_key, sum(l_quantity) AS duration_seconds, CAST(sum(l_linenumber) AS BIGINT) AS call_count FROM lineitem GROUP BY 1",
    "stream_tumbling": "SELECT epoch_us(ts) // 900000000 * 900000000 AS start_us, count(*) AS n FROM events GROUP BY 1",
}
