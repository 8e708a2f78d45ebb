"""Queries over lineage operators: documents stand for artifacts, orders for commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import lineage as ops
from tallyspark.plans.telemetry import rounded, table


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("pos"), F.concat(F.when(n % 5 == 0, "resources-").otherwise("part-"), n).alias("path"),
        F.when(n % 3 == 0, "performance.full").otherwise(F.col("source")).alias("role"),
        F.when(F.col("lang") == "en", "science").when(F.col("lang") == "fr", "full-state").otherwise("local").alias("profile"),
        F.lit("text/plain").alias("media_type"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"),
        F.array(F.concat(F.when((n + 1) % 5 == 0, "resources-").otherwise("part-"), n + 1)).alias("dependencies"), (n % 11).alias("commit"), (n % 11 != 3).alias("telemetry_catalog"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders: each one's parent is the order before; every 40th has lost its parent's record."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.lag("o_orderkey").over(w).alias("parent"), F.col("o_orderpriority").alias("identity"), F.row_number().over(w).cast("long").alias("generation"))


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one point's commits: most have a history, and on some histories another artifact depends."""
    n = F.col("commit")
    return commits(spark, sf_dir).withColumn("histories", F.when(n % 5 == 0, 0).otherwise(1)).withColumn("required", n % 6 == 0)


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of those with two histories, or without their parent's record."""
    n = F.col("commit")
    return cumulative(spark, sf_dir).where(n % 40 != 0).withColumn("histories", F.when(n % 7 == 0, 2).otherwise(F.col("histories")))


def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts(spark, sf_dir).withColumn("bytes", F.col("bytes") + F.when(F.col("pos") % 50 == 7, 1).otherwise(0))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running").alias("state"))


def covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(F.lit("x").alias("sha256"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 50 of each language's catalog; every seventh chunk declares one entry too many."""
    rows = table(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1)
    made = rows.groupBy(F.col("lang").alias("catalog"), F.floor(F.col("rn") / 50).alias("chunk")).agg(F.count("*").alias("n"), (F.max("rn") + 1).alias("entries"))
    return made.select("catalog", (F.col("entries") + F.when(F.col("chunk") % 7 == 2, 1).otherwise(0)).cast("long").alias("entries"), "n")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    tail = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.when(n % 7 == 0, F.concat(F.lit("/"), tail)).when(n % 11 == 0, F.concat(F.lit("a/../"), tail)).when(n % 13 == 0, F.concat(F.lit("a//"), tail)).when(n % 17 == 0, F.lit("./a")).otherwise(tail).alias("path"))


QUERIES = {
    "profile_selection": lambda s, d: ops.selection(artifacts(s, d), "science").select("pos", "path", "role"),
    "omission_summary": lambda s, d: ops.omission_summary(artifacts(s, d), "science"),
    "dependency_closure": lambda s, d: ops.dangling_dependencies(artifacts(s, d), ops.selection(artifacts(s, d), "full-state")),
    "digest_conflicts": lambda s, d: ops.digest_conflicts(conflicting(s, d)),
    "content_dedup": lambda s, d: ops.content_dedup(artifacts(s, d), "pos"),
    "ancestry": lambda s, d: ops.ancestors(commits(s, d)),
    "ancestry_violations": lambda s, d: ops.ancestry_violations(commits(s, d).where("commit % 40 <> 0")),
    "history_replacement": lambda s, d: ops.history_replacements(cumulative(s, d)),
    "replacement_violations": lambda s, d: ops.replacement_violations(faulty(s, d)),
    "superseded_histories": lambda s, d: ops.superseded(cumulative(s, d).select("commit", F.concat(F.lit("history-"), "commit").alias("path"), F.lit("science.history").alias("role"), F.sha2(F.col("commit").cast("string"), 256).alias("sha256")), ops.history_replacements(cumulative(s, d)).withColumn("replacement_sha256", F.sha2(F.col("replacement").cast("string"), 256)).drop("generation")),
    "catalog_prefix_check": lambda s, d: ops.catalog_violations(chunks(s, d)),
    "coverage_report": lambda s, d: ops.coverage_report(ops.coverage(points(s, d), covering(s, d)), "o_custkey"),
    "freshness": lambda s, d: rounded(ops.freshness(table(s, d, "events").select("event_id", (F.col("event_id") * 10).cast("double").alias("published_unix")), 50_000.5)),
    "preview_totals": lambda s, d: ops.preview_totals(artifacts(s, d)),
    "accepted_results": lambda s, d: table(s, d, "orders").select("o_orderkey", ops.is_accepted(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running"), F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 5 != 0, F.lit(True)), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") > 1000)).alias("accepted")),
    "path_safety": lambda s, d: paths(s, d).select("page_id", ops.is_safe_path(F.col("path")).alias("safe")),
}

_ARTIFACTS = """a AS (SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'resources-' ELSE 'part-' END || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'performance.full' ELSE source END AS role,
    CASE lang WHEN 'en' THEN 'science' WHEN 'fr' THEN 'full-state' ELSE 'local' END AS profile, 'text/plain' AS media_type, octet_length(encode(text)) AS bytes, sha256(text) AS sha256,
    CASE WHEN (doc_id + 1) % 5 = 0 THEN 'resources-' ELSE 'part-' END || (doc_id + 1) AS dependency, doc_id % 11 <> 3 AS catalogued FROM documents)"""
_KEPT = "profile = 'science' OR (catalogued AND role = 'performance.full' AND (path LIKE 'resources-%' OR path LIKE 'spans-%'))"
_COMMITS = """c AS (SELECT o_orderkey AS commit_id, lag(o_orderkey) OVER w AS parent, o_orderpriority AS identity, row_number() OVER w AS generation
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""
_CUMULATIVE = """h AS (SELECT o_orderkey AS commit_id, lag(o_orderkey) OVER w AS parent, o_custkey, o_orderpriority AS identity, row_number() OVER w AS generation, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS histories, o_orderkey % 6 = 0 AS required
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""
_UP = f"""RECURSIVE {_COMMITS}, u AS (SELECT commit_id, parent AS ancestor, 1::BIGINT AS depth FROM c WHERE parent IS NOT NULL
    UNION ALL SELECT u.commit_id, c.parent, u.depth + 1 FROM u JOIN c ON c.commit_id = u.ancestor WHERE c.parent IS NOT NULL)"""

SQL = {
    "profile_selection": f"WITH {_ARTIFACTS} SELECT pos, path, role FROM a WHERE {_KEPT}",
    "omission_summary": f"""
        WITH {_ARTIFACTS}, o AS (SELECT *, CASE WHEN profile = 'full-state' THEN 'available_in_full_state' ELSE 'omitted_by_policy' END AS reason FROM a WHERE NOT ({_KEPT}))
        SELECT role, reason, count(*) AS n, sum(bytes)::BIGINT AS bytes, arg_min(path, pos) AS first_path, arg_max(path, pos) AS last_path,
               sha256(string_agg(to_json({{'bytes': bytes, 'dependencies': [dependency], 'media_type': media_type, 'path': path, 'profile': profile, 'role': role, 'sha256': sha256}})::VARCHAR || chr(10), '' ORDER BY pos)) AS digest FROM o GROUP BY role, reason""",
    "dependency_closure": f"WITH {_ARTIFACTS}, s AS (SELECT * FROM a WHERE profile IN ('science', 'full-state')) SELECT path, dependency FROM s WHERE dependency NOT IN (SELECT path FROM s)",
    "digest_conflicts": f"WITH {_ARTIFACTS} SELECT sha256 FROM a GROUP BY sha256 HAVING count(DISTINCT bytes + CASE WHEN pos % 50 = 7 THEN 1 ELSE 0 END) > 1",
    "content_dedup": f"WITH {_ARTIFACTS} SELECT sha256, min(pos) AS pos, count(*) AS n FROM a GROUP BY sha256",
    "ancestry": f'WITH {_UP} SELECT commit_id AS "commit", ancestor, depth FROM u',
    "ancestry_violations": f"""
        WITH {_COMMITS}, k AS (SELECT * FROM c WHERE commit_id % 40 <> 0)
        SELECT k.commit_id AS "commit", CASE WHEN p.commit_id IS NULL THEN 'unknown_parent' ELSE 'other_identity' END AS rule FROM k LEFT JOIN k p ON k.parent = p.commit_id
        WHERE k.parent IS NOT NULL AND (p.commit_id IS NULL OR p.identity IS DISTINCT FROM k.identity)""",
    "history_replacement": f"""
        WITH {_CUMULATIVE}, t AS (SELECT *, max(CASE WHEN histories > 0 THEN generation END) OVER (PARTITION BY o_custkey) AS top FROM h), b AS (SELECT o_custkey, commit_id AS replacement, generation FROM t WHERE generation = top)
        SELECT t.commit_id AS ancestor, b.replacement, b.generation FROM t JOIN b USING (o_custkey) WHERE t.histories > 0 AND NOT t.required AND t.generation < b.generation""",
    "superseded_histories": f"""
        WITH {_CUMULATIVE}, t AS (SELECT *, max(CASE WHEN histories > 0 THEN generation END) OVER (PARTITION BY o_custkey) AS top FROM h), b AS (SELECT o_custkey, commit_id AS replacement, generation FROM t WHERE generation = top)
        SELECT 'science.history' AS role, sha256(t.commit_id::VARCHAR) AS sha256, 'history-' || t.commit_id AS path, 'superseded_by_verified_cumulative_history' AS reason, sha256(b.replacement::VARCHAR) AS replacement_sha256, b.replacement AS replacement_commit
        FROM t JOIN b USING (o_custkey) WHERE t.histories > 0 AND NOT t.required AND t.generation < b.generation""",
    "replacement_violations": f"""
        WITH {_CUMULATIVE}, k AS (SELECT *, CASE WHEN commit_id % 7 = 0 THEN 2 ELSE histories END AS n FROM h WHERE commit_id % 40 <> 0), j AS (SELECT k.*, p.commit_id AS there, p.identity AS p_identity FROM k LEFT JOIN k p ON k.parent = p.commit_id WHERE k.n > 0)
        SELECT commit_id AS "commit", 'several_histories' AS rule FROM j WHERE n > 1 UNION ALL SELECT commit_id, 'incomplete' FROM j WHERE parent IS NOT NULL AND there IS NULL
        UNION ALL SELECT commit_id, 'crosses_identity' FROM j WHERE there IS NOT NULL AND identity IS DISTINCT FROM p_identity""",
    "catalog_prefix_check": """
        WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents),
        k AS (SELECT lang AS catalog, rn // 50 AS chunk, count(*) AS n, max(rn) + 1 AS entries FROM r GROUP BY 1, 2),
        e AS (SELECT catalog, entries + CASE WHEN chunk % 7 = 2 THEN 1 ELSE 0 END AS entries, n FROM k),
        x AS (SELECT *, coalesce(lag(entries) OVER (PARTITION BY catalog ORDER BY entries), 0) + n AS expected FROM e)
        SELECT catalog, entries, expected FROM x WHERE entries <> expected""",
    "coverage_report": """
        WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem), p AS (SELECT o_custkey, o_orderstatus, l_orderkey IS NULL AS missing FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
        SELECT o_custkey, count(*) AS points, count_if(missing)::BIGINT AS missing, bool_and(o_orderstatus IN ('F', 'O')) AS preview_complete, bool_and(o_orderstatus IN ('F', 'O')) AND count_if(missing) = 0 AS complete FROM p GROUP BY 1""",
    "freshness": "SELECT event_id, (event_id * 10)::DOUBLE AS published_unix, round(CASE WHEN event_id * 10 <= 50000.5 THEN 50000.5::DOUBLE - event_id * 10 END, 6) AS age_seconds FROM events",
    "preview_totals": f"WITH {_ARTIFACTS}, o AS (SELECT sha256, min(bytes) AS b FROM a GROUP BY 1) SELECT (SELECT count(*) FROM a) AS files, (SELECT string_agg(role, ',' ORDER BY role) FROM (SELECT DISTINCT role FROM a)) AS roles, count(*) AS objects, sum(b)::BIGINT AS bytes FROM o",
    "accepted_results": "SELECT o_orderkey, coalesce(o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND CASE WHEN o_orderkey % 5 <> 0 THEN true END AND coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice > 1000 END, true), false) AS accepted FROM orders",
    "path_safety": r"""
        WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS tail FROM pages),
        q AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/' || tail WHEN page_id % 11 = 0 THEN 'a/../' || tail WHEN page_id % 13 = 0 THEN 'a//' || tail WHEN page_id % 17 = 0 THEN './a' ELSE tail END AS path FROM p)
        SELECT page_id, NOT starts_with(path, '/') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS safe FROM q""",
}
