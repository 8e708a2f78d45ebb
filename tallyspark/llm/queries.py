"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import alignment, language_id, minhash, mixing, multi_index, packing, spelling, substring_dedup, suffixes, token_counts, token_files, topk, warc
from tallyspark.llm.scratch import new_folder

WORDS, PIECES, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).withColumn("changed", F.col("n_removed") > 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.LanguageModels(PIECES), fold() != 0, with_text=False)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS).drop("ids")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).documents()


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearDuplicates(width=2))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), WORDS, folder=folder)
    return token_files.read_token_folder(spark, folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), noise=31)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), alignment.Alignment(BYTES, PIECES))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_language_id, op3_packing, op4_mixing, op5_minhash, op6_token_counts, op7_top_k, op8_token_files, op9_warc, op10_nearest, op11_spelling, op12_alignment, op13_suffix_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_spelling": """
            WITH RECURSIVE bits AS (
                SELECT i AS byte, 0 AS turn, CAST(i AS UINTEGER) AS r FROM range(256) t(i)
                UNION ALL SELECT byte, turn + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UINTEGER) ELSE r >> 1 END FROM bits WHERE turn < 8
            ), crc AS (SELECT list(r ORDER BY byte) AS tab FROM bits WHERE turn = 8
            ), found AS (
                SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
            ), runs AS (
                SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS many FROM found GROUP BY ALL
            ), coded AS (
                SELECT run, many, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)), '..'),
                    lambda b: CAST(16 * (position(b[1] IN '0123456789ABCDEF') - 1) + position(b[2] IN '0123456789ABCDEF') - 1 AS UINTEGER)) AS bytes FROM runs
            ), hashed AS (
                SELECT run, many, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS BIGINT) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) AS h FROM coded, crc
            ), noisy AS (
                SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, many FROM hashed
            ), words AS (
                SELECT word, CAST(sum(many) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(many) >= 2
            ), cuts AS (
                SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
            ), near AS (
                SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
                UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word
            ), ranked AS (
                SELECT near.word, v.word AS near, v.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, v.word) AS place
                FROM near JOIN words v ON v.word = near.near
            ), forms AS (
                SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
                FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
            ), way AS (
                SELECT word, word AS root, 0 AS steps FROM forms
                UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL
            )
            SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
            FROM forms f JOIN (SELECT word, max_by(root, steps) AS root FROM way GROUP BY word) w ON w.word = f.word""",
        "op7_top_k": """
            WITH v AS (
                SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op9_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
            d AS (SELECT page_id, n, sha256(html) AS digest FROM p),
            f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
            SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
                   CASE WHEN f.first IS DISTINCT FROM d.page_id AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
            FROM d LEFT JOIN f ON d.digest = f.digest""",
    }
