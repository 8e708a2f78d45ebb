"""Mixing sources to target weights: word blocks of one length, multinomial counts for each output shard, permuted block indexes, a join by index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.scratch import key_ranges, small_table, spread, written
from tallyspark.llm.text import blocks, word_bounds
from tallyspark.llm.worker import forget, lean

#: Sources whose table goes to every task; more are joined by a shuffle. Blocks of an output shard; the last one has the rest.
MOST_BROADCAST, SHARD_BLOCKS = 100_000, 8192
#: Slots above which the generator has no hypergeometric draw.
EXACT = 10**9


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        sizes = np.zeros(len(batch), dtype=np.int64)
        for block in blocks(batch.column("text")):
            starts, _, before = word_bounds(block.buf, block.bounds)
            sizes[block.first : block.first + len(block.bounds) - 1] += np.diff(before)
        yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(sizes)], names=["doc_id", "source", "size"])


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words for each source: `share` times all sizes by weight; none above `most` times its size, the excess dealt anew by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), {i for i, s in enumerate(sizes) if s > 0}
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else left * weights[i] / weight
        left -= sum(out[i] for i in full) if full else left
        open_ = open_ - full if full else set()
    return out


def split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among `take` slots drawn without replacement from `counts`: a multivariate hypergeometric draw. Where all slots are EXACT or
    more, each source in turn is drawn from a binomial (up to 2**20 slots) or a rounded normal of the same mean and spread, kept within what the others leave possible."""
    if counts.sum() < EXACT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out, left, todo = np.zeros_like(counts), int(counts.sum()), int(take)
    for i, n in enumerate(counts.tolist()):
        share = todo / left if left else 0.0
        spread_ = (n * share * (1 - share) * (left - n) / max(1, left - 1)) ** 0.5
        drawn = rng.binomial(n, share) if n <= 1 << 20 else round(rng.normal(n * share, spread_))
        out[i] = min(max(drawn, todo - (left - n), 0), n, todo)
        left, todo = left - n, todo - int(out[i])
    return out


def shard_counts(slots: np.ndarray, size: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Output shards low..high-1: the shard, each source's slots before it, and its draw over the sources.

    A shard has `size` slots (the last one the rest). A multinomial draw of each shard whose totals over all shards are to be `slots` is a draw without replacement; it is made
    down a binary tree of shards, each node from a seed of its own, so that any task draws its shards alone, in the number of sources times the tree's depth.
    """
    slots = np.asarray(slots, dtype=np.int64)
    stack = [(0, -(-int(slots.sum()) // size), slots, np.zeros_like(slots))]
    while stack:
        first, end, counts, before = stack.pop()
        if end <= max(low, first) or first >= high:
            continue
        if end - first == 1:
            yield first, before, counts
            continue
        middle = (first + end) // 2
        left = split(counts, (middle - first) * size, np.random.default_rng([seed, first, end]))
        stack += [(middle, end, counts - left, before + left), (first, middle, left, before)]


def _shards(slots: list[int], blocks_: list[int], size: int, seed: int):
    """Each shard's draw, made where its number is: source_no, shard, first (slots of the source before), n, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for shard, before, counts in shard_counts(np.array(slots), size, seed, int(numbers.min()), int(numbers.max()) + 1) if len(numbers) else ():
                some = np.flatnonzero(counts)
                cells = [some, np.full(len(some), shard), before[some], counts[some], np.array(blocks_)[some]]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cells], names=["source_no", "shard", "first", "n", "blocks"])

    return run


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at k: four Feistel rounds on the next even power of two, walked until within n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 4, dtype=np.uint64)
    x, out = np.asarray(k).astype(np.uint64), np.asarray(k).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            mix = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ (((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31)) & low)
        x = (left << np.uint64(half)) | right
        done = x < n
        out[todo[done]] = x[done]
        todo, x = todo[~done], x[~done]
    return out.astype(np.int64)


def _draw(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for first in range(row["first"], row["first"] + row["n"], 1 << 16):
                    k = np.arange(first, min(first + (1 << 16), row["first"] + row["n"]))
                    block = permuted(k % row["blocks"], row["blocks"], seed + row["source_no"])
                    same = lambda v: pa.array(np.full(len(k), v))
                    yield pa.record_batch([same(row["source_no"]), same(row["shard"]), pa.array(k), pa.array(block)], names=["source_no", "shard", "k", "block"])

    return run


class Mix:
    """A plan for docs: `documents` has what is taken of each row, `slots` the blocks of each output shard in order."""

    def __init__(self, pieces: DataFrame, empty: DataFrame, slots: DataFrame, block: int):
        self.pieces, self.empty, self.slots, self.block = pieces, empty, slots, block

    def ranges(self) -> DataFrame:
        """One row for each piece of a document within a block: the document's columns, first (word of the document), words, copies."""
        copies = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("copies"))
        return self.pieces.join(copies, ["source_no", "block"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, source of each row."""
        keys = ["doc_id", "source", "size", "source_size", "target"]
        rows = self.ranges().groupBy(*keys, "start").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
        rows = rows.select(*keys, "taken").union(self.empty.select(*keys, F.lit(0).cast("long").alias("taken")))
        return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 20, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Plans a mix of docs (doc_id: long, text, source: string) of `share` times all their words.

    A source's weight is that of its rank by code point (null last) among `weights`, repeated. Its documents' words stand one behind another in
    order of doc_id (null first) and size, cut into blocks of `block` words. It gets as many slots as its target holds blocks of its mean length. Every output shard has
    `shard_blocks` slots (the last one the rest), dealt to the sources by a multinomial draw of the shard's own that keeps the sources' totals, so that shards grow in number with the mix alone;
    slot k of a source takes the block at k of its permutation, which starts over when all its blocks are used. One row for each source comes to the driver and goes to the tasks that draw. So no block is used more than `most` times, rounded up, and
    reruns agree however the input is split. A text without words, or null, has size 0 and gives nothing; an empty
    table gives an empty plan; repeated rows each count; other columns are ignored.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    sizes = written(sizes.mapInArrow(lean(_sizes), "doc_id long, source string, size long"), "sizes")
    known = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
    known.sort(key=lambda r: (r.source is None, r.source or ""))
    target = targets([r.n for r in known], [weights[i % len(weights)] for i in range(len(known))], share, most)
    planned = [(i, r.source, r.n, t, -(-r.n // block), round(t * -(-r.n // block) / r.n) if r.n else 0) for i, (r, t) in enumerate(zip(known, target))]
    sources = small_table(spark, planned, pa.schema({"source_no": pa.int64(), "name": pa.string(), "source_size": pa.int64(), "target": pa.float64()}))

    named = sizes.join(F.broadcast(sources) if len(known) <= MOST_BROADCAST else sources, sizes.source.eqNullSafe(F.col("name"))).drop("name")
    ranged = named.where("size > 0").withColumn("bucket", key_ranges(sizes, "doc_id", spread(spark), F.col("size")))
    totals = ranged.groupBy("source_no", "bucket").agg(F.sum("size").alias("total"))
    bases = totals.select("source_no", "bucket", F.coalesce(F.sum("total").over(W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = W.partitionBy("source_no", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(bases, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "bucket")
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = cut.withColumn("first", low - F.col("start")).withColumn("words", high - low)

    dealt = [r[-1] for r in planned]
    drawn = spark.range(0, -(-sum(dealt) // shard_blocks), 1, spread(spark)).mapInArrow(lean(_shards(dealt, [r[-2] for r in planned], shard_blocks, seed)), "source_no long, shard long, first long, n long, blocks long")
    rows = drawn.repartition(spread(spark), "source_no", "shard")
    slots = written(rows.mapInArrow(lean(_draw(seed)), "source_no long, shard long, k long, block long"), "slots")
    return Mix(pieces, named.where("size = 0"), slots, block)


def mixed_documents(docs: DataFrame, plan: Mix) -> DataFrame:
    """docs as the mix takes them, with the same columns: each document as often as its most used block, each time with the words of the blocks used that often; n_chars, if there, is made anew."""
    keys = ["doc_id", "source", "size"]
    parts = plan.ranges().where("copies > 0").groupBy(*keys, "start").agg(F.array_sort(F.collect_list(F.struct("first", "words", "copies"))).alias("parts"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "parts"))).alias("each"))
    names = docs.columns
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    counted = texts.select("*", _count_udf()("text").alias("size"))
    numbered = counted.withColumn("no", F.row_number().over(W.partitionBy(*keys).orderBy("text")))
    # null-safe for sizes too: of a plain equality Spark makes a filter below, which counts the words once more by a second Python worker of the task
    joined = numbered.join(rows, [numbered[c].eqNullSafe(rows[c]) for c in keys])
    out = joined.select("row", numbered.text, F.try_element_at("each", F.col("no")).getField("parts").alias("parts")).where("parts is not null")
    out = out.select("row", F.explode(_take_udf()("text", "parts")).alias("taken"))
    made = {"text": F.col("taken"), "n_chars": F.length("taken").cast("long")}
    return out.select(*[(made[c].cast(docs.schema[c].dataType) if c in made else F.col("row").getField(c)).alias(c) for c in names])


def _count_udf():
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            sizes = np.zeros(len(text), dtype=np.int64)
            for block in blocks(text):
                sizes[block.first : block.first + len(block.bounds) - 1] += np.diff(word_bounds(block.buf, block.bounds)[2])
            yield pa.array(sizes)

    return F.arrow_udf(count, "long")


def _take_udf():
    def take(cells: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, parts in cells:
            out = []
            for t, ranges in zip(text, parts.to_pylist()):
                data = t.as_py().encode("utf-8")
                starts, _, _ = word_bounds(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
                edge = np.append(starts, len(data))
                edge[0] = 0
                made = []
                for turn in range(1, max(r["copies"] for r in ranges) + 1):
                    made.append(b"".join(data[edge[r["first"]] : edge[r["first"] + r["words"]]] for r in ranges if r["copies"] >= turn).decode("utf-8"))
                out.append(made)
            yield pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(take, "array<string>")
