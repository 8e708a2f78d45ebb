"""Token counts: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tokens import PieceCounts, WordBPE, made
from tallyspark.llm.worker import lean


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            if path.endswith(".model"):
                counts = made(PieceCounts, path).counts(text)
                yield pa.record_batch([batch.column("doc_id"), _size(text), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])
                continue
            for first, _, lens in made(WordBPE, path).rows(text):
                yield pa.record_batch([batch.column("doc_id").slice(first, len(lens)), _size(text.slice(first, len(lens))), pa.array(lens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _size(text: pa.Array) -> pa.Array:
    return pc.fill_null(pc.binary_length(text.cast(pa.large_string())), 0).cast(pa.int64())


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """For each row of docs (doc_id: long, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: a .model file of sentencepiece or a word-level .json file of tokenizers; no tokens are added, nothing is cut off. A worker takes
    texts in blocks of about equal bytes; a longer text is cut where no token can cross. A null text counts as empty,
    an empty text has no bytes and no tokens. Null and repeated doc_ids stay as they are; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(_count(tokenizer)), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
