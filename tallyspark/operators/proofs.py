"""Proofs that one table holds another: bit-equal prefixes, closed inventories, payload hashes. Each violation is a row; a proof has none."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.bits import double_bits


def _comparable(df: DataFrame, names: list[str], prefix: str) -> list:
    kinds = dict(df.dtypes)
    return [(double_bits(F.col(c)) if kinds[c] == "double" else F.col(c)).alias(f"{prefix}{c}") for c in names]


def prefix_violations(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column: cells of old that new, at the same keys, lacks or has with other bits. New may have more rows and more columns."""
    names = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *_comparable(old, names, "old_"))
    b = new.select(*keys, F.lit(True).alias("there"), *_comparable(new, names, "new_"))
    rules = [F.when(F.col("there").isNull(), "row")] + [F.when(F.col("there").isNotNull() & ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), c) for c in names]
    return a.join(b, keys, "left").select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("column"))


def payload_violations(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys of old that new lacks, or has with another payload."""
    b = new.select(key, F.lit(True).alias("there"), F.col(payload).alias("other"))
    rule = F.when(F.col("there").isNull(), "missing").when(~F.col(payload).eqNullSafe(F.col("other")), "changed")
    return old.join(b, key, "left").select(key, rule.alias("rule")).where("rule is not null")


def disagreements(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, rule wherever two tables do not have the same value at the same key."""
    left = a.select(key, F.col(value).alias("a_value"), F.lit(True).alias("in_a"))
    right = b.select(key, F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    rule = F.when(F.col("in_a").isNull(), "only_in_second").when(F.col("in_b").isNull(), "only_in_first").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "different")
    return left.join(right, key, "full").select(key, rule.alias("rule")).where("rule is not null")


def child_violations(children: DataFrame, parents: DataFrame, key: str, identity: list[str], allowed: dict[str, tuple]) -> DataFrame:
    """identity, rule of child rows without a parent, that share an identity, or hold a value that is not allowed."""
    orphans = children.join(parents.select(key).distinct(), key, "left_anti").select(*identity, F.lit("no_parent").alias("rule"))
    repeated = children.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1").select(*identity, F.lit("repeated").alias("rule"))
    wrong = F.lit(False)
    for column, values in allowed.items():
        wrong = wrong | ~F.col(column).isin(*values)
    return orphans.union(repeated).union(children.where(wrong).select(*identity, F.lit("value").alias("rule")))


def compaction_ranges(files: DataFrame, by: str, order: str) -> DataFrame:
    """Rows [row_start, row_stop) of each source file (by, order, n) in the compacted one."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum("n").over(w)
    return files.select(by, order, (stop - F.col("n")).alias("row_start"), stop.alias("row_stop"))


def _column_bytes(cells: pa.Array) -> bytes:
    """Validity, then values: strings as lengths and bytes, all others as little-endian native values; what a null holds has no meaning and counts as zero."""
    valid = cells.is_valid().to_numpy(zero_copy_only=False).tobytes()
    if pa.types.is_string(cells.type):
        texts = [(t or "").encode("utf-8") for t in cells.to_pylist()]
        return valid + np.array([len(t) for t in texts], dtype="<i4").tobytes() + b"".join(texts)
    values = pc.fill_null(cells, False if pa.types.is_boolean(cells.type) else 0).to_numpy(zero_copy_only=False)
    return valid + values.astype(values.dtype.newbyteorder("<")).tobytes()


def batch_bytes(batch: pa.Table) -> bytes:
    """The bytes of a batch of rows that a proof hashes: their number, and each column's bytes."""
    return batch.num_rows.to_bytes(8, "little") + b"".join(_column_bytes(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in batch.columns)


def payload_hash(rows: DataFrame, by: str, ordinal: str, columns: list[str], batch_rows: int = 4096) -> DataFrame:
    """by, batch, n, digest: SHA-256 of each batch of batch_rows rows in order. Doubles go through as they are, so no NaN and no sign of zero is changed; a group's batches are hashed side by side."""
    number = F.expr(f"cast({ordinal} div {batch_rows} as long)")
    keys = F.col(by).alias("_by"), number.alias("_batch"), F.col(ordinal).alias("_ordinal")
    dealt = rows.select(*keys, *columns).repartition("_by", "_batch").sortWithinPartitions("_by", "_batch", "_ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.record_batch([held[0].column("_by").slice(0, 1), pa.array([here[1]], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([hashlib.sha256(batch_bytes(table.select(columns))).hexdigest()])], names=[by, "batch", "n", "digest"])

        for batch in batches:
            keys = list(zip(batch.column("_by").to_pylist(), batch.column("_batch").to_pylist()))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for first, stop in zip(cuts, [*cuts[1:], len(keys)]):
                if held and keys[first] != here:
                    yield done()
                    held = []
                here = keys[first]
                held.append(batch.slice(first, stop - first))
        if held:
            yield done()

    return dealt.mapInArrow(run, f"{by} {dict(rows.dtypes)[by]}, batch long, n long, digest string")


def payload_digest(hashes: DataFrame, by: str) -> DataFrame:
    """by, n, digest: one digest of a group's batches in order (of payload_hash: one row for every few thousand), which any change of a row, of the order or of the cut into batches changes."""
    ordered = F.array_sort(F.collect_list(F.struct("batch", "digest")))
    return hashes.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda x: x.digest), "\n"), 256).alias("digest"))
