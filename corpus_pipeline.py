"""From raw documents to packed sequences: language ID, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import language_id, minhash, mixing, packing, substring_dedup
from tallyspark.llm.queries import PIECES, WORDS, fold
from tallyspark.llm.scratch import Passing, dropped, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    found = language_id.identify(docs.select(COLUMNS), language_id.LanguageModels(PIECES), fold() != 0)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs, each row under a number of its own as doc_id, and its own doc_id as own_id: rows that share a doc_id, or have none, are told apart. Written once, so that a number stays with its row."""
    return written(docs.select(*COLUMNS).withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "keyed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more: that of the smallest doc_id (null last), one row of it. Texts without words are in no group and stay."""
    with Passing() as scope:
        rows = keyed(docs)
        found = written(minhash.near_duplicates(rows).select("doc_id", "component_id"), "components")
        many = written(found.groupBy("component_id").agg(F.count("*").alias("many")).where("many > 1"), "many")
        group = found.join(many, "component_id").select("doc_id", "component_id")
        named = written(group.join(rows.select("doc_id", "own_id"), "doc_id"), "named")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "doc_id")).alias("first"))
        gone = written(named.join(first.select(F.col("first.doc_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id"), "gone")
        scope.keep(rows, gone)
    return rows.join(gone, "doc_id", "left_anti").withColumn("doc_id", F.col("own_id")).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier row has; documents of which nothing is left go. Each row goes by its own text, whatever its doc_id."""
    cleaned = substring_dedup.substring_dedup(keyed(docs)).where("n_removed = 0 or n_removed < n_sentences")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).withColumn("doc_id", F.col("own_id")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs.select(COLUMNS), mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, WORDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the models, the draws nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written_path"):
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
