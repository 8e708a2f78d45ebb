"""Queries over files, compaction and views that need no further tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.strict_json import contract_fault
from tallyspark.operators import capture, compaction, history, lineage, telemetry, views
from tallyspark.plans.proofs import numbered
from tallyspark.plans.telemetry import rounded, table
from tallyspark.plans.transport import axis, cells
from tallyspark.sources import files
from tallyspark.sources import segments as commits
from tallyspark.sources.store import shared_folder


def captured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files and as a commit's artifacts: files are missing, longer, or changed."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    text = F.when(n % 41 == 2, F.concat("text", F.lit("x"))).when(n % 43 == 3, F.regexp_replace("text", "^.", "~")).otherwise(F.col("text"))
    own = docs.where(n % 37 != 1).select(n.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))
    return own.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")), docs.select(n.cast("string").alias("path"), F.octet_length("text").alias("bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of three media types, some of them damaged."""
    n = F.col("event_id")
    name = F.concat(n, F.when(n % 3 == 0, ".json").when(n % 3 == 1, ".txt").otherwise(".bin"))
    data = F.when(n % 11 == 4, F.concat(F.encode("props", "UTF-8"), F.unhex(F.lit("FF")))).when(n % 13 == 5, F.encode(F.lit("[1]"), "UTF-8")).otherwise(F.encode("props", "UTF-8"))
    return table(spark, sf_dir, "events").select(name.alias("path"), data.alias("content"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    schema = F.when(n % 7 == 1, "other").otherwise("index-v2")
    text = F.concat(F.lit('{"schema":"'), schema, F.lit('"'), F.when(n % 5 != 2, F.lit(',"contract_set":"set-1"')).otherwise(""), F.lit(',"pad":"'), F.repeat(F.lit("p"), (n % 90).cast("int")), F.lit('"'), F.when(n % 11 == 3, "").otherwise("}"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return files.telemetry_segments(spark, [path], spark.read.parquet(path).schema)


def committed(spark: SparkSession, sf_dir: str) -> str:
    """Events as segments of their types, in two commits: those of even ids, then those of odd ones."""
    base = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for odd in (0, 1):
        rows = events.where(F.col("event_id") % 2 == odd).repartition("event_type").sortWithinPartitions("event_type", "event_id")
        commits.write_segments(rows, base, by="event_type", cursor="event_id", source="event_type", rows=str(1 << 40), contract="events")
    return base


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from committed segments, by their entries, with the committed cursor of each type."""
    base = committed(spark, sf_dir)
    named = spark.createDataFrame([(f"{base}/{e['path']}", e["label"], e["epoch"]) for e in commits.entries(base)], "path string, label string, epoch long")
    rows = commits.committed_segments(spark, base, table(spark, sf_dir, "events").select("event_id", "event_type", "value").schema)
    found = rows.groupBy(F.regexp_extract("segment", "[^/]+$", 0).alias("name"), "event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    cursors = spark.createDataFrame(list(commits.pointer(base)["cursors"].items()), "event_type string, cursor long")
    both = named.join(found, F.regexp_extract("path", "[^/]+$", 0) == F.col("name")).where("label = event_type")
    return both.join(cursors, "event_type").select("label", "epoch", "rows", "first", "last", "cursor")


def short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed segments whose footers hold another number of rows than their entries say: one file has been replaced by another type's."""
    base = committed(spark, sf_dir)
    found = {(e["label"], e["epoch"]): f"{base}/{e['path']}" for e in commits.entries(base)}
    labels = sorted(label for label, _ in found)
    commits.replace_file(found[labels[-1], 1], found[labels[0], 0])
    return commits.segment_footers(spark, base).where("rows <> footer_rows").select("label", "epoch", "rows", "footer_rows")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, with NaNs and signed zeros, written anew by their type and read again: faults of the proof, and one row for each file."""
    folder = f"{shared_folder(spark)}/compacted-{uuid.uuid4().hex}"
    rows = numbered(spark, sf_dir)
    made = compaction.write_compacted(rows, "event_type", "ordinal", folder)
    faults = compaction.compaction_proof(spark, rows, made, "event_type", "ordinal", ["ordinal", "value"], folder)
    return made.select("event_type", "n").join(faults.groupBy("event_type").agg(F.count("*").alias("faults")), "event_type", "left").select("event_type", "n", F.coalesce("faults", F.lit(0)).alias("faults"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as hash-linked chunks: some are lost, repeated, follow another one, or miscount."""
    from pyspark.sql import Window as W

    n = F.col("o_orderkey")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    rows = table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).withColumn("before", F.when(n % 53 == 4, F.lag("o_orderkey", 2).over(w)).otherwise(F.lag("o_orderkey").over(w)))
    rows = rows.where(n % 59 != 5).select(F.col("o_custkey").alias("catalog"), sha(n).alias("sha256"), sha(F.col("before")).alias("previous"), (F.col("place") * 50 + F.when(n % 61 == 6, 1).otherwise(0)).alias("entries"), F.lit(50).alias("n"), n)
    return rows.union(rows.where("o_orderkey % 67 = 7")).drop("o_orderkey")


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of two residuals and a current; the second residual appears late, and gaps and bad values are in all."""
    n = F.col("event_id")
    bad = lambda k: F.when(n % k == 0, F.lit(float("nan"))).when(n % (k + 2) == 0, F.lit(0.0)).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").where(n % 211 != 7)
    return rows.select((F.col("user_id") % 5).alias("series"), F.lit("outer").alias("phase"), F.floor(n / 4000).cast("long").alias("attempt"), n.alias("sequence"), (n % 397).alias("iteration"), F.lit(1).alias("outer_iteration"), bad(101).alias("r_a"), F.when(n >= 300, bad(71)).alias("r_b"), (F.col("value") - 100).alias("J"), F.lit("x").alias("note"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumn("ordinal", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")) - 1)
    value = F.when(n % 5 == 0, F.lit(float("nan"))).when(n % 7 == 0, F.lit(float("inf"))).when(n % 11 != 0, F.col("value"))
    return rows.select("event_type", "ordinal", F.explode(F.array(*[F.struct(F.lit(f"c{i}").alias("column"), history.as_text(value if i % 2 else n.cast("double")).alias("value")) for i in range(6)])).alias("c")).select("event_type", "ordinal", "c.*")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    order = F.when(n % 9 == 2, F.array(F.lit("z"), F.lit("k"))).otherwise(F.array(F.lit("z")))
    y = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(n.alias("figure"), order.alias("axis_order"), F.array(F.when(n % 8 == 3, 63).otherwise(64)).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double")).alias("x"), y.alias("y"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("series"), F.col("event_id").cast("double").alias("at"), F.col("event_type").alias("label"))


#: Bytes that the queries' captures may hold.
CAPTURE_BYTES = 300_000


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as listed files: some names are unsafe, some there twice, some sizes unknown."""
    n = F.col("page_id")
    name = F.concat(F.when(n % 23 == 1, "/").when(n % 29 == 2, "a//").when(n % 31 == 3, "../").otherwise("p/"), F.when(n % 37 == 4, n - 1).otherwise(n).cast("string"))
    return table(spark, sf_dir, "pages").select(F.when(n % 41 == 5, F.lit(None)).otherwise(name).alias("path"), F.when(n % 43 == 6, F.lit(None)).when(n % 47 == 7, F.lit(-1)).otherwise(F.octet_length("html")).cast("long").alias("bytes"))


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_ = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return capture.admission(files_, CAPTURE_BYTES)


QUERIES = {
    "capture_admission": admitted,
    "capture_listing_violations": lambda s, d: capture.listing_violations(listed(s, d)),
    "capture_violations": lambda s, d: files.capture_violations(*captured(s, d)),
    "container_faults": lambda s, d: files.container_faults(contents(s, d)),
    "contract_faults": lambda s, d: contracts(s, d).select("event_id", contract_fault(F.col("text"), "index-v2", "set-1", 110).alias("fault")),
    "reblocked_segments": lambda s, d: compaction.reblocked(segments(s, d), "segment", "segment_row", 300).groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")),
    "footer_violations": short_segments,
    "segment_commits": recorded,
    "compaction_roundtrip": compacted,
    "catalog_chain": lambda s, d: lineage.chain_violations(linked(s, d)),
    "normalised_spans": lambda s, d: telemetry.normalised_spans(table(s, d, "events").select("event_id", F.col("event_type").alias("phase"), F.when(F.col("event_id") % 2 == 0, "exclusive").alias("timing_kind")), {"execution_id": "e1"}).drop("timestamp_kind"),
    "history_view": lambda s, d: history.history_view(drawn(s, d), False, bins=40),
    "history_monitor": lambda s, d: history.history_view(drawn(s, d), True, bins=20),
    "column_tails": lambda s, d: history.column_tails(tables(s, d), "event_type", 32, 4),
    "omitted_columns": lambda s, d: history.omitted_columns(tables(s, d), "event_type", 4),
    "regular_axes": lambda s, d: views.is_regular(axis(s, d).withColumn("coordinate", F.when(F.col("figure").endswith("1"), F.col("i") * 0.25).otherwise(F.col("coordinate"))), "figure"),
    "display_grid": lambda s, d: rounded(views.display_grid(axis(s, d), "figure", 60, 100)),
    "colour_limits": lambda s, d: rounded(views.limit_violations(views.colour_range(cells(s, d), "figure"), cells(s, d).select("figure").distinct().withColumn("supplied", F.when(F.col("figure").endswith("2"), F.lit(1.0)).otherwise(F.lit(1e9))), "figure")),
    "candidate_states": lambda s, d: views.candidate_states(table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("state"), (F.col("l_suppkey") % 8).alias("k"), F.lit(8).cast("long").alias("n_k")), "l_orderkey"),
    "thinned_labels": lambda s, d: views.thinned_labels(labels(s, d), "series", 145.0),
    "annotated_curves": lambda s, d: rounded(views.annotated_curves(waves(s, d), ("z",), "figure").groupBy("figure").agg(F.count("*").alias("n"), F.max("x").alias("last"), F.sum("y").alias("total")), 4),
    "annotation_faults": lambda s, d: views.annotation_faults(waves(s, d), ("z",), "figure"),
}


def _view_sql(monitor: bool, bins: int) -> str:
    rows = """r AS (SELECT user_id % 5 AS series, event_id AS sequence, event_id // 4000 AS attempt, event_id % 397 AS iteration, value,
        CASE WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE WHEN event_id % 103 = 0 THEN 0 ELSE value END AS r_a, CASE WHEN event_id >= 300 THEN CASE WHEN event_id % 71 = 0 THEN 'nan'::DOUBLE WHEN event_id % 73 = 0 THEN 0 ELSE value END END AS r_b, value - 100 AS j FROM events WHERE event_id % 211 <> 7),
        l AS (SELECT *, lag(sequence) OVER w AS s0, lag(attempt) OVER w AS a0, lag(iteration) OVER w AS i0, row_number() OVER w - 1 AS ordinal FROM r WINDOW w AS (PARTITION BY series ORDER BY sequence)),
        b AS (SELECT *, s0 IS NULL OR attempt <> a0 OR iteration <= i0 AS starts, sequence - coalesce(s0, 0) > 1 AS hole FROM l), k AS (SELECT *, sum(starts::INT) OVER (PARTITION BY series ORDER BY sequence) AS cycle FROM b),"""
    last = "z AS (SELECT * FROM k QUALIFY cycle = max(cycle) OVER (PARTITION BY series)), m AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sequence) - 1 AS place0, iteration::DOUBLE AS x, hole AS breaks FROM z)," if monitor else "m AS (SELECT *, ordinal AS place0, sequence::DOUBLE AS x, hole OR starts AS breaks FROM k),"
    return f"""WITH {rows} {last}
        u AS (SELECT series, 'r_a' AS metric, place0, x, breaks, r_a AS y, r_a IS NOT NULL AND isfinite(r_a) AND r_a > 0 AS ok FROM m UNION ALL SELECT series, 'r_b', place0, x, breaks, r_b, coalesce(isfinite(r_b) AND r_b > 0, false) FROM m UNION ALL SELECT series, 'J', place0, x, breaks, j, isfinite(j) FROM m),
        g AS (SELECT *, place0 // greatest(1, ceil(count(*) OVER (PARTITION BY series, metric) / {bins}.0))::BIGINT AS bin FROM u),
        i AS (SELECT series, metric, bin, bool_or(NOT ok OR (breaks AND place0 > 0)) AS invalid, min(y) FILTER (ok) AS lo, max(y) FILTER (ok) AS hi, min(x) FILTER (ok) AS x0, max(x) FILTER (ok) AS x1 FROM g GROUP BY ALL),
        t AS (SELECT g.*, i.invalid, g.x = i.x0 OR g.x = i.x1 AS ends, g.y = i.lo AS is_lo, g.y = i.hi AS is_hi FROM g JOIN i USING (series, metric, bin) WHERE g.ok),
        e AS (SELECT *, is_lo AND row_number() OVER (PARTITION BY series, metric, bin, is_lo ORDER BY x) = 1 AS lo1, is_hi AND row_number() OVER (PARTITION BY series, metric, bin, is_hi ORDER BY x) = 1 AS hi1 FROM t)
        SELECT series, metric, bin, invalid, row_number() OVER (PARTITION BY series, metric, bin ORDER BY x, y) - 1 AS place, x, y FROM e WHERE ends OR lo1 OR hi1
        UNION ALL SELECT series, metric, bin, true, 0, NULL, NULL FROM i WHERE x0 IS NULL"""


_TAILS = """r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ordinal, count(*) OVER (PARTITION BY event_type) AS n,
    CASE WHEN event_id % 5 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN 'Infinity' WHEN event_id % 11 <> 0 THEN value::VARCHAR END AS v FROM events)"""
_AXIS = "a AS (SELECT figure, coordinate, row_number() OVER (PARTITION BY figure ORDER BY coordinate) - 1 AS i FROM (SELECT DISTINCT p_brand AS figure, p_size::DOUBLE AS coordinate FROM part))"

SQL = {
    "capture_admission": f"""
        WITH f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes FROM documents),
        s AS (SELECT path, bytes, (sum(bytes) OVER (ORDER BY path) - bytes)::BIGINT AS before FROM f)
        SELECT path, bytes, before, before + bytes <= {CAPTURE_BYTES} AS admitted FROM s""",
    "capture_listing_violations": """
        WITH f AS (SELECT CASE WHEN page_id % 41 <> 5 THEN CASE WHEN page_id % 23 = 1 THEN '/' WHEN page_id % 29 = 2 THEN 'a//' WHEN page_id % 31 = 3 THEN '../' ELSE 'p/' END || (page_id - CASE WHEN page_id % 37 = 4 THEN 1 ELSE 0 END)::VARCHAR END AS path,
                          CASE WHEN page_id % 43 = 6 THEN NULL WHEN page_id % 47 = 7 THEN -1 ELSE octet_length(encode(html)) END AS bytes FROM pages)
        SELECT path, 'name' AS rule FROM f WHERE path IS NULL OR path NOT LIKE 'p/%' UNION ALL SELECT path, 'size' FROM f WHERE bytes IS NULL OR bytes < 0
        UNION ALL SELECT path, 'twice' FROM f GROUP BY path HAVING count(*) > 1""",
    "capture_violations": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 37 = 1 THEN 'missing' WHEN doc_id % 41 = 2 THEN 'size' WHEN octet_length(encode(text)) <> octet_length(encode(regexp_replace(text, '^.', '~'))) THEN 'size' ELSE 'digest' END AS rule FROM documents WHERE doc_id % 37 = 1 OR doc_id % 41 = 2 OR (doc_id % 43 = 3 AND text <> regexp_replace(text, '^.', '~'))",
    "container_faults": """
        SELECT event_id || CASE event_id % 3 WHEN 0 THEN '.json' ELSE '.txt' END AS path, CASE WHEN event_id % 11 = 4 THEN 'encoding' ELSE 'root' END AS fault FROM events
        WHERE (event_id % 3 < 2 AND event_id % 11 = 4) OR (event_id % 3 = 0 AND event_id % 13 = 5)""",
    "contract_faults": """
        WITH t AS (SELECT event_id, 11 + CASE WHEN event_id % 7 = 1 THEN 5 ELSE 8 END + 1 + CASE WHEN event_id % 5 <> 2 THEN 23 ELSE 0 END + 8 + event_id % 90 + 1 + CASE WHEN event_id % 11 = 3 THEN 0 ELSE 1 END AS n FROM events)
        SELECT event_id, CASE WHEN n > 110 THEN 'size' WHEN event_id % 11 = 3 THEN 'syntax' WHEN event_id % 7 = 1 THEN 'schema' WHEN event_id % 5 = 2 THEN 'contract_set' END AS fault FROM t""",
    "reblocked_segments": "WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch FROM events) SELECT batch, count(*) AS n, min(event_id) AS \"first\", max(event_id) AS \"last\" FROM r GROUP BY 1",
    "footer_violations": """
        WITH c AS (SELECT event_type AS label, event_id % 2 AS epoch, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT min(event_type) AS low, max(event_type) AS high FROM events)
        SELECT label, epoch, n AS "rows", (SELECT c0.n FROM c c0, t WHERE c0.label = t.low AND c0.epoch = 0) AS footer_rows FROM c, t WHERE label = t.high AND epoch = 1 AND n <> (SELECT c0.n FROM c c0, t WHERE c0.label = t.low AND c0.epoch = 0)""",
    "segment_commits": """
        SELECT event_type AS label, event_id % 2 AS epoch, count(*) AS "rows", min(event_id) AS "first", max(event_id) AS "last", max(max(event_id)) OVER (PARTITION BY event_type) AS "cursor" FROM events GROUP BY 1, 2""",
    "compaction_roundtrip": "SELECT event_type, count(*) AS n, 0::BIGINT AS faults FROM events GROUP BY 1",
    "catalog_chain": """
        WITH o AS (SELECT *, row_number() OVER w AS place, CASE WHEN o_orderkey % 53 = 4 THEN lag(o_orderkey, 2) OVER w ELSE lag(o_orderkey) OVER w END AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        c AS (SELECT o_custkey AS catalog, o_orderkey AS k, before, place * 50 + CASE WHEN o_orderkey % 61 = 6 THEN 1 ELSE 0 END AS entries FROM o WHERE o_orderkey % 59 <> 5), d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE k % 67 = 7),
        j AS (SELECT d.*, (SELECT min(entries) FROM c p WHERE p.catalog = d.catalog AND p.k = d.before) AS prior, count(*) OVER (PARTITION BY d.catalog, d.before) AS followers FROM d)
        SELECT DISTINCT catalog, sha256(k::VARCHAR) AS sha256, 'repeated' AS rule FROM j WHERE k % 67 = 7 UNION SELECT catalog, sha256(k::VARCHAR), 'missing' FROM j WHERE before IS NOT NULL AND prior IS NULL
        UNION SELECT catalog, sha256(k::VARCHAR), 'entries' FROM j WHERE coalesce(prior, 0) + 50 <> entries UNION SELECT catalog, sha256(k::VARCHAR), 'fork' FROM j WHERE followers > 1""",
    "normalised_spans": "SELECT event_id, event_type AS phase, CASE WHEN event_id % 2 = 0 THEN 'exclusive' END AS timing_kind, 1 AS call_count, false AS warmup, 'phase_duration' AS measurement_kind, 'e1' AS execution_id FROM events",
    "history_view": _view_sql(False, 40),
    "history_monitor": _view_sql(True, 20),
    "column_tails": f"""
        WITH {_TAILS}, c AS (SELECT event_type, 'c' || k AS col, ordinal, n, CASE WHEN k % 2 = 1 THEN coalesce(v, 'null') ELSE event_id::DOUBLE::VARCHAR END AS value FROM r, range(0, 4) x(k) WHERE ordinal >= n - 32)
        SELECT event_type, col AS "column", greatest(0, n - 32) AS start_row, n AS "rows", string_agg(value, ',' ORDER BY ordinal) AS "values" FROM c GROUP BY event_type, col, n""",
    "omitted_columns": 'SELECT DISTINCT event_type, 6::BIGINT AS "columns", 2::BIGINT AS omitted FROM events',
    "regular_axes": f"""
        WITH {_AXIS}, b AS (SELECT figure, i, CASE WHEN figure LIKE '%1' THEN i * 0.25::DOUBLE ELSE coordinate END AS c FROM a), s AS (SELECT figure, lead(c) OVER (PARTITION BY figure ORDER BY i) - c AS step FROM b), m AS (SELECT figure, (max(c) - min(c)) / (count(*) - 1) AS mean, max(abs(c)) AS e FROM b GROUP BY 1)
        SELECT figure, bool_and(abs(step - mean) <= 1e-7 * mean + greatest(e, 1e-12) * 1e-12) AS regular FROM s JOIN m USING (figure) WHERE step IS NOT NULL GROUP BY 1""",
    "display_grid": f"""
        WITH {_AXIS}, e AS (SELECT figure, min(coordinate) AS lo, max(coordinate) AS hi, least(100, greatest(60, count(*))) AS n FROM a GROUP BY 1)
        SELECT figure, k::INTEGER AS place, round(lo + k * ((hi - lo) / (n - 1)), 6) AS x FROM e, LATERAL (SELECT unnest(range(n)) AS k)""",
    "colour_limits": """
        WITH c AS (SELECT p_brand AS figure, CASE WHEN p_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 17 <> 0 THEN p_retailprice - 1000 END AS value FROM part), l AS (SELECT figure, max(abs(value)) FILTER (isfinite(value)) AS needed FROM c GROUP BY 1)
        SELECT figure, 1.0::DOUBLE AS supplied, round(needed, 6) AS needed FROM l WHERE figure LIKE '%2' AND needed > 1""",
    "candidate_states": "SELECT l_orderkey, l_partkey AS state, l_suppkey % 8 AS k, 8::BIGINT AS n_k FROM lineitem WHERE l_partkey < 12 AND l_suppkey % 8 IN (0, 4, 7)",
    "thinned_labels": """
        WITH RECURSIVE e AS (SELECT user_id % 20 AS series, event_id::DOUBLE AS spot, event_type AS label, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS rn FROM events),
        f AS (SELECT series, spot, label, rn, true AS printed, spot AS last FROM e WHERE rn = 1 UNION ALL SELECT e.series, e.spot, e.label, e.rn, e.spot - f.last >= 145, CASE WHEN e.spot - f.last >= 145 THEN e.spot ELSE f.last END FROM f JOIN e ON e.series = f.series AND e.rn = f.rn + 1)
        SELECT series, spot AS "at", label, printed FROM f""",
    "annotated_curves": "SELECT vec_id AS figure, 64::BIGINT AS n, 63.0::DOUBLE AS \"last\", round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id % 9 <> 2 AND vec_id % 8 <> 3",
    "annotation_faults": "SELECT vec_id AS figure, 'axes' AS rule FROM embeddings WHERE vec_id % 9 = 2 UNION ALL SELECT vec_id, 'shape' FROM embeddings WHERE vec_id % 8 = 3",
}
