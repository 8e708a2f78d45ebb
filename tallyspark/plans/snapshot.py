"""Queries over snapshot operators: documents stand for objects, orders for commits, customers for sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import lineage
from tallyspark.operators import snapshot as ops
from tallyspark.plans.telemetry import rounded, table


def digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a manifest: every document but some."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(n % 31 != 7).select(F.concat(F.lit("objects/"), n).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a transport: others are missing, some digests and sizes are changed."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(n % 37 != 5).select(F.concat(F.lit("objects/"), n).alias("path"), F.sha2(F.concat("text", F.when(n % 41 == 1, "x").otherwise("")), 256).alias("sha256"), (F.col("n_chars") + F.when(n % 43 == 2, 1).otherwise(0)).alias("bytes"))


def receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("page_id % 29 <> 3").select(F.col("page_id").alias("index"), digest(F.col("page_id")).alias("sha256"), (F.col("page_id") * 100_000).alias("bytes"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select(n.alias("index"), digest(n + F.when(n % 23 == 4, 1).otherwise(0)).alias("sha256"), (n * 100_000).alias("bytes"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(n % 50 != 9).select(n.alias("commit"), F.concat(F.lit("commits/"), n).alias("path"), digest(n).alias("sha256"), (n % 7).alias("generation"), n.cast("double").alias("published_unix"), (n % 3 != 0).alias("telemetry_catalog"))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer points to an order with the customer's number; some digests and generations are wrong."""
    n = F.col("c_custkey")
    sha = F.when(n % 13 == 1, "short").otherwise(digest(n + F.when(n % 17 == 2, 1).otherwise(0)))
    return table(spark, sf_dir, "customer").select(n.alias("root"), F.concat(F.lit("commits/"), n).alias("commit_path"), sha.alias("sha256"), (n % 7 + F.when(n % 19 == 3, 1).otherwise(0)).alias("generation"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as artifacts of their order, with the role that their flag and status stand for."""
    flag = F.concat("l_returnflag", "l_linestatus")
    role = F.when(flag == "NO", "physics.analysis").when(flag == "RF", "science.history").when(flag == "AF", "performance.summary").otherwise("physics.full")
    n = F.col("l_partkey") * 100 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), n.alias("pos"), F.concat(F.lit("x/"), F.when(n % 2 == 0, "summary-").otherwise("part-"), "l_partkey").alias("path"), role.alias("role"), digest(F.col("l_partkey")).alias("sha256"), n.alias("bytes"), F.when(n % 5 == 0, "text/plain").otherwise("application/json").alias("media_type"))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for every seventh line's path."""
    rows = artifacts(spark, sf_dir).where("pos % 7 = 0")
    return rows.select("commit", "path", "sha256", (F.col("bytes") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).alias("bytes"), F.when(F.col("pos") % 4 == 0, F.array(F.lit("other"))).otherwise(F.array("path")).alias("dependencies")).distinct()


def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(n % 3 == 0).select(F.concat(F.lit("objects/"), n).alias("object"), F.array(F.concat(F.lit("objects/"), n + 4)).alias("dependencies"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", n.alias("point_id"), F.when(n % 10 == 1, "no_committed_physical_record").otherwise("committed").alias("status"))


def selected_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_custkey % 4 <> 1").select("o_custkey", F.when(n % 3 == 0, "physics.analysis").when(n % 3 == 1, "science.comparison").otherwise("physics.full").alias("role"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("job_status", F.when(F.col("o_custkey") % 5 == 0, "running").otherwise("completed"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders referred to several times: as points, as sessions, as ancestors."""
    n = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    kind = lambda name, key, where: orders.where(where).select(F.lit(name).alias("kind"), n.alias("pos"), key.alias("commit"))
    return kind("point", n % 700, "o_orderkey % 2 = 0").union(kind("session", n % 900, "o_orderkey % 3 = 0")).union(kind("ancestor", n, "true")).union(kind("campaign", n, "o_orderkey = 4"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return rows.union(rows.where("session_id % 20 = 6"))


def session_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(n % 12 != 5).select(n.alias("session_id"), n.alias("commit"), digest(n + F.when(n % 14 == 3, 1).otherwise(0)).alias("sha256"))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(digest(n).alias("sha256"), F.concat(F.lit("s"), n).alias("session_id"), F.when(n % 4 != 0, n).alias("recorded_until_monotonic_ns"), (n % 2 == 0).alias("closed"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each customer: its orders, in order, and what else enters the identity."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("commits"))
    return orders.select("o_custkey", "commits", F.lit("science").alias("profile"), F.when(F.col("o_custkey") % 2 == 0, "p").alias("plan"), F.lit(200_000_000).cast("long").alias("maximum_bytes"))


CUTOFF = 5_000.5
def ancestries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Some orders are referred to; every order's science parent is the customer's order before, but for some without one, and some whose parent is one far back that others lead to as well."""
    from pyspark.sql import Window as W

    n, w = F.col("o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderkey")
    kind = F.when(n % 7 == 0, "campaign").when(n % 11 == 0, "session").when(n % 13 == 0, "point")
    orders = table(spark, sf_dir, "orders")
    roots = orders.select(kind.alias("kind"), (n % 1009 * 1000003 + n).alias("pos"), n.alias("commit")).where("kind is not null")
    again = roots.where("commit % 2 = 1").withColumn("kind", F.lit("standalone")).withColumn("pos", F.col("commit"))
    before = F.when(n % 17 == 3, None).when(n % 5 == 2, F.first(n).over(w)).otherwise(F.lag(n).over(w))
    return roots.union(again), orders.select(n.alias("commit"), F.when(before < n, before).alias("parent"))


QUERIES = {
    "manifest_inventory_diff": lambda s, d: ops.manifest_inventory_diff(manifest(s, d), inventory(s, d)),
    "receipt_parts": lambda s, d: ops.receipt_violations(receipt(s, d), parts(s, d), 10_000_000),
    "pointer_violations": lambda s, d: ops.pointer_violations(pointers(s, d), commits(s, d)),
    "reference_set": lambda s, d: ops.reference_set(references(s, d)),
    "reference_walk": lambda s, d: ops.reference_walk(*ancestries(s, d)),
    "appended_artifacts": lambda s, d: ops.appended(artifacts(s, d).where("pos % 3 = 0").select("commit", "pos", "path"), artifacts(s, d).where("pos % 3 = 1").select("commit", "pos", "path")).groupBy("commit").agg(F.max("pos").alias("last"), F.min_by("path", "pos").alias("first_path")),
    "repeated_paths": lambda s, d: ops.repeated_paths(artifacts(s, d)),
    "recovery_violations": lambda s, d: ops.recovery_violations(recovery(s, d), artifacts(s, d)),
    "object_names": lambda s, d: artifacts(s, d).select(ops.object_name(F.col("sha256"), F.when(F.col("pos") % 11 == 0, "image/png").otherwise(F.col("media_type"))).alias("name")).groupBy("name").agg(F.count("*").alias("n")),
    "unreferenced_objects": lambda s, d: ops.unreferenced(table(s, d, "documents").select(F.concat(F.lit("objects/"), "doc_id").alias("object")), included(s, d)),
    "missing_records": lambda s, d: ops.missing_records(coverage(s, d), selected_roles(s, d), "o_custkey"),
    "snapshot_completeness": lambda s, d: ops.completeness(coverage(s, d), ops.missing_records(coverage(s, d), selected_roles(s, d), "o_custkey"), jobs(s, d), "o_custkey", lineage.TERMINAL),
    "snapshot_identity": lambda s, d: ops.snapshot_identity(fields(s, d), "o_custkey"),
    "analysis_freshness": lambda s, d: rounded(ops.analysis_freshness(commits(s, d), artifacts(s, d), CUTOFF)),
    "telemetry_freshness": lambda s, d: rounded(ops.telemetry_freshness(commits(s, d), artifacts(s, d), told(s, d), CUTOFF)),
    "last_coordinates": lambda s, d: ops.last_coordinates(table(s, d, "events").select("user_id", (F.col("event_id") % 2).alias("phase"), F.col("event_id").alias("sequence"), (F.col("event_id") % 17).alias("iteration"), F.floor(F.col("event_id") / 170).alias("outer_iteration")), ["user_id", "phase"]),
    "session_summaries": lambda s, d: ops.session_summaries(sessions(s, d).distinct(), session_pointers(s, d), commits(s, d), artifacts(s, d)),
    "session_violations": lambda s, d: ops.session_violations(sessions(s, d), session_pointers(s, d), commits(s, d)),
    "acceptance_kind": lambda s, d: table(s, d, "orders").select("o_orderkey", ops.acceptance_kind(F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.when(F.col("o_orderkey") % 4 == 0, "operator_checks_passed").otherwise("current"), F.lit(1))), F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("operator_checks"), F.lit(1)))).alias("kind")),
    "phase_seconds": lambda s, d: rounded(ops.phase_seconds(table(s, d, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("phase")), "user_id")),
}

_COMMITS = "c AS (SELECT o_orderkey AS commit_id, sha256(o_orderkey::VARCHAR) AS sha256, o_orderkey % 7 AS generation, o_orderkey::DOUBLE AS published, o_orderkey % 3 <> 0 AS catalogued FROM orders WHERE o_orderkey % 50 <> 9)"
_ART = """a AS (SELECT l_orderkey AS commit_id, l_partkey * 100 + l_linenumber AS pos, 'x/' || CASE WHEN (l_partkey * 100 + l_linenumber) % 2 = 0 THEN 'summary-' ELSE 'part-' END || l_partkey AS path,
    CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'physics.analysis' WHEN 'RF' THEN 'science.history' WHEN 'AF' THEN 'performance.summary' ELSE 'physics.full' END AS role, sha256(l_partkey::VARCHAR) AS sha256,
    l_partkey * 100 + l_linenumber AS bytes, CASE WHEN (l_partkey * 100 + l_linenumber) % 5 = 0 THEN 'text/plain' ELSE 'application/json' END AS media_type FROM lineitem)"""
_MISSING = """m AS (SELECT o_custkey, o_orderkey::VARCHAR AS point_id, 'no_committed_physical_record' AS availability FROM orders WHERE o_orderkey % 10 = 1
    UNION ALL SELECT DISTINCT o_custkey, NULL, 'no_committed_scientific_records' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 1 AND o_orderkey % 3 IN (0, 1)))"""

SQL = {
    "manifest_inventory_diff": """
        WITH m AS (SELECT 'objects/' || doc_id AS path, sha256(text) AS sha, n_chars AS n FROM documents WHERE doc_id % 31 <> 7),
        i AS (SELECT 'objects/' || doc_id AS path, sha256(text || CASE WHEN doc_id % 41 = 1 THEN 'x' ELSE '' END) AS sha, n_chars + CASE WHEN doc_id % 43 = 2 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 37 <> 5)
        SELECT path, 'only_in_manifest' AS rule FROM m WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'only_in_inventory' FROM i WHERE path NOT IN (SELECT path FROM m)
        UNION ALL SELECT m.path, 'sha256' FROM m JOIN i USING (path) WHERE m.sha <> i.sha UNION ALL SELECT m.path, 'bytes' FROM m JOIN i USING (path) WHERE m.n <> i.n""",
    "receipt_parts": """
        SELECT page_id AS "index", 'only_in_parts' AS rule FROM pages WHERE page_id % 29 = 3 UNION ALL SELECT page_id, 'sha256' FROM pages WHERE page_id % 29 <> 3 AND page_id % 23 = 4
        UNION ALL SELECT page_id, 'over_limit' FROM pages WHERE page_id * 100000 > 10000000""",
    "pointer_violations": f"""
        WITH {_COMMITS}, p AS (SELECT c_custkey AS root, CASE WHEN c_custkey % 13 = 1 THEN 'short' ELSE sha256((c_custkey + CASE WHEN c_custkey % 17 = 2 THEN 1 ELSE 0 END)::VARCHAR) END AS sha, c_custkey % 7 + CASE WHEN c_custkey % 19 = 3 THEN 1 ELSE 0 END AS gen FROM customer),
        j AS (SELECT p.*, c.sha256, c.generation FROM p LEFT JOIN c ON c.commit_id = p.root)
        SELECT root, 'missing' AS rule FROM j WHERE sha256 IS NULL UNION ALL SELECT root, 'digest' FROM j WHERE sha <> sha256 UNION ALL SELECT root, 'generation' FROM j WHERE gen <> generation UNION ALL SELECT root, 'digest_form' FROM j WHERE length(sha) <> 64""",
    "reference_walk": """
        WITH RECURSIVE o AS (SELECT o_orderkey AS k, first_value(o_orderkey) OVER w AS oldest, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        p AS (SELECT k, CASE WHEN k % 17 = 3 THEN NULL WHEN k % 5 = 2 THEN oldest ELSE before END AS parent FROM o),
        r AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'campaign' WHEN k % 11 = 0 THEN 'session' ELSE 'point' END AS kind, k % 1009 * 1000003 + k AS pos FROM o WHERE k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0),
        a AS (SELECT * FROM r UNION ALL SELECT k, 'standalone', k FROM r WHERE k % 2 = 1),
        s AS (SELECT k, min({'no': list_position(['campaign', 'point', 'standalone', 'session', 'ancestor'], kind), 'pos': pos, 'kind': kind}) AS f FROM a GROUP BY k),
        w AS (SELECT k, 0 AS level, f.no AS no, f.pos AS pos FROM s UNION ALL SELECT p.parent, level + 1, no, pos FROM w JOIN p USING (k) WHERE p.parent IS NOT NULL AND p.parent < p.k),
        m AS (SELECT k, min({'level': level, 'no': no, 'pos': pos}) AS f FROM w GROUP BY k)
        SELECT m.k AS "commit", CASE WHEN m.f.level = 0 THEN s.f.kind ELSE 'ancestor' END AS kind, m.f.level AS level, m.f.no AS kind_no, m.f.pos AS place FROM m LEFT JOIN s USING (k)""",
    "reference_set": """
        WITH r AS (SELECT 2 AS o, 'point' AS kind, o_orderkey AS pos, o_orderkey % 700 AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 4, 'session', o_orderkey, o_orderkey % 900 FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 5, 'ancestor', o_orderkey, o_orderkey FROM orders UNION ALL SELECT 1, 'campaign', o_orderkey, o_orderkey FROM orders WHERE o_orderkey = 4)
        SELECT k AS "commit", kind, pos AS place FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, pos) = 1""",
    "appended_artifacts": f"""
        WITH {_ART}, u AS (SELECT commit_id, path, row_number() OVER (PARTITION BY commit_id ORDER BY pos % 3, pos) - 1 AS place FROM a WHERE pos % 3 IN (0, 1))
        SELECT commit_id AS "commit", max(place) AS "last", arg_min(path, place) AS first_path FROM u GROUP BY 1""",
    "repeated_paths": f'WITH {_ART} SELECT commit_id AS "commit", path, count(*) AS n FROM a GROUP BY 1, 2 HAVING count(*) > 1',
    "recovery_violations": f"""
        WITH {_ART}, r AS (SELECT DISTINCT commit_id, path, sha256, bytes + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS bytes, pos % 4 <> 0 AS right_one FROM a WHERE pos % 7 = 0),
        f AS (SELECT * FROM a WHERE role = 'physics.full'), j AS (SELECT r.*, count(f.path) AS n, min(f.sha256) AS own_sha, min(f.bytes) AS own_bytes FROM r LEFT JOIN f ON f.commit_id = r.commit_id AND f.path = r.path GROUP BY ALL)
        SELECT commit_id AS "commit", 'not_one' AS rule FROM j WHERE n <> 1 UNION ALL SELECT commit_id, 'dependencies' FROM j WHERE NOT right_one UNION ALL SELECT commit_id, 'sha256' FROM j WHERE n = 1 AND sha256 <> own_sha
        UNION ALL SELECT commit_id, 'bytes' FROM j WHERE n = 1 AND bytes <> own_bytes""",
    "object_names": f"WITH {_ART} SELECT CASE WHEN pos % 11 = 0 THEN NULL ELSE 'objects/' || sha256 || CASE media_type WHEN 'text/plain' THEN '.txt' ELSE '.json' END END AS name, count(*) AS n FROM a GROUP BY 1",
    "unreferenced_objects": "SELECT 'objects/' || doc_id AS object FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id + 4 FROM documents WHERE doc_id % 3 = 0)",
    "missing_records": f"WITH {_MISSING} SELECT * FROM m",
    "snapshot_completeness": f"""
        WITH {_MISSING}, n AS (SELECT o_custkey, count(*) AS missing FROM m GROUP BY 1), j AS (SELECT DISTINCT o_custkey FROM orders)
        SELECT o_custkey, o_custkey % 5 <> 0 AS job_complete, coalesce(missing, 0) AS missing, o_custkey % 5 <> 0 AND missing IS NULL AS complete FROM j LEFT JOIN n USING (o_custkey)""",
    "snapshot_identity": """
        WITH f AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS c FROM orders GROUP BY 1)
        SELECT o_custkey, sha256(to_json({'commits': c, 'maximum_bytes': 200000000, 'plan': CASE WHEN o_custkey % 2 = 0 THEN 'p' END, 'profile': 'science'})::VARCHAR) AS identity FROM f""",
    "analysis_freshness": f"""
        WITH {_COMMITS}, {_ART}, n AS (SELECT commit_id, bool_or(role = 'physics.analysis') AS present FROM a WHERE role IN ('physics.analysis', 'science.history') GROUP BY 1)
        SELECT commit_id AS "commit", generation, present AS analysis_present, CASE WHEN present THEN published END AS analysis_unix, round(CASE WHEN present AND published <= {CUTOFF} THEN {CUTOFF}::DOUBLE - published END, 6) AS analysis_age_seconds FROM c JOIN n USING (commit_id)""",
    "telemetry_freshness": f"""
        WITH {_COMMITS}, {_ART}, s AS (SELECT sha256(p_partkey::VARCHAR) AS sha256, 's' || p_partkey AS session_id, p_partkey % 2 = 0 AS closed FROM part WHERE p_partkey % 4 <> 0)
        SELECT c.commit_id AS "commit", session_id, generation, round(CASE WHEN published <= {CUTOFF} THEN {CUTOFF}::DOUBLE - published END, 6) AS committed_age_seconds, closed
        FROM c JOIN a ON a.commit_id = c.commit_id AND a.role = 'performance.summary' AND media_type = 'application/json' JOIN s ON s.sha256 = a.sha256 WHERE catalogued""",
    "last_coordinates": "SELECT user_id, event_id % 2 AS phase, max(event_id) AS sequence, max(event_id) % 17 AS iteration, max(event_id) // 170 AS outer_iteration FROM events GROUP BY 1, 2",
    "session_summaries": f"""
        WITH {_COMMITS}, {_ART}, p AS (SELECT c_custkey AS session_id FROM customer WHERE c_custkey % 12 <> 5 AND c_custkey % 14 <> 3)
        SELECT session_id, c.commit_id AS "commit", path FROM p JOIN c ON c.commit_id = p.session_id JOIN a ON a.commit_id = c.commit_id WHERE role = 'performance.summary' AND path LIKE 'x/summary%'""",
    "session_violations": f"""
        WITH {_COMMITS}, p AS (SELECT c_custkey AS session_id, c_custkey % 12 <> 5 AS there, c_custkey % 14 = 3 AS wrong, commit_id FROM customer LEFT JOIN c ON commit_id = c_custkey)
        SELECT session_id, 'repeated' AS rule FROM p WHERE session_id % 20 = 6 UNION ALL SELECT session_id, 'no_pointer' FROM p WHERE NOT there UNION ALL SELECT session_id, 'digest' FROM p WHERE there AND (wrong OR commit_id IS NULL)""",
    "acceptance_kind": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'operator' ELSE 'stationary' END AS kind FROM orders",
    "phase_seconds": """
        WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), s AS (SELECT * FROM l WHERE before IS DISTINCT FROM event_type),
        u AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM s) SELECT user_id, event_type AS phase, sum(until - event_id)::BIGINT AS seconds FROM u WHERE until IS NOT NULL GROUP BY 1, 2""",
}
