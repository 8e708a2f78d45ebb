"""Spelling variants: words one edit apart, found in blocks of a forward and a reversed sorted dictionary, since one edit leaves a half of a word intact."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import Passing, written
from tallyspark.llm.text import LOWER, blocks, byte_hashes
from tallyspark.llm.worker import forget, lean


@dataclass(frozen=True)
class Variants:
    """shortest: code points of a word; least: its occurrences; ratio: a form has so many times the word's; block: words of a block that are compared with
    one another, larger ones are subdivided; cells: code points compared at once; remembered: words that a task counts before it hands them on."""

    shortest: int = 7
    least: int = 2
    ratio: int = 10
    block: int = 32
    cells: int = 1 << 21
    remembered: int = 200_000


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = True


def runs(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the byte C3 and the one behind it)."""
    solid = np.zeros(len(buf) + 2, dtype=bool)
    solid[1:-1] = _LETTER[buf]
    solid[2:-1] |= buf[:-1] == 0xC3
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


class Checksums:
    """crc32 of one byte string behind another from those of both: the first one's register, carried over as many zero bytes as the second has, and the second's."""

    LONGEST = 64

    def __init__(self):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
        carried = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        rows = [carried]
        for _ in range(self.LONGEST):
            carried = (carried >> np.uint32(8)) ^ table[carried & np.uint32(255)]
            rows.append(carried)
        self.carry = np.stack(rows)

    def joined(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = second.copy()
        for k in range(4):
            out ^= self.carry[size, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def _counted(p: Variants, noise: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums, counts = Checksums(), {}

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            names = [f"{'null' if i is None else i}:".encode() for i in batch.column("doc_id").to_pylist()]
            heads = np.array([zlib.crc32(x) for x in names], dtype=np.uint32)
            for block in blocks(batch.column("text")):
                buf = LOWER[block.buf]
                starts, ends, row = runs(buf, block.bounds)
                if not len(starts):
                    continue
                _, first, number = np.unique(byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
                data, sizes = buf.tobytes(), (ends - starts)[first]
                words = [data[starts[i] : ends[i]] for i in first]
                wide = np.append(0, np.cumsum(buf == 0xC3))
                points = sizes - (wide[ends] - wide[starts])[first]
                keep = np.ones(len(starts), dtype=bool)
                if noise:
                    crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
                    h = sums.joined(heads[block.first + row], crc[number], np.minimum(sizes, sums.LONGEST)[number])
                    for i in np.flatnonzero(sizes[number] > sums.LONGEST):
                        h[i] = zlib.crc32(words[number[i]], int(heads[block.first + row[i]]))
                    keep = h % noise != 0
                    for i in np.flatnonzero(~keep & (points[number] > p.shortest)):
                        word = words[number[i]].decode()
                        at = int(h[i]) % len(word)
                        word = (word[:at] + word[at + 1 :]).encode()
                        counts[word] = counts.get(word, 0) + 1
                n = np.bincount(number[keep], minlength=len(words))
                for i in np.flatnonzero((n > 0) & (points >= p.shortest)):
                    counts[words[i]] = counts.get(words[i], 0) + int(n[i])
                if len(counts) > p.remembered:
                    yield out()
        if counts:
            yield out()

    return run


def word_counts(docs: DataFrame, p: Variants = Variants(), noise: int | None = None) -> DataFrame:
    """word and n (occurrences) of the words of docs (doc_id: long, text) with at least p.shortest code points and p.least occurrences.

    A word is a maximal run of A-Z, a-z, U+00C0 to U+00FF of a whole text, A-Z lowered. noise: let h be the crc32 of `<doc_id>:<run>` (a missing id is "null");
    where noise divides h, the run loses its code point number h % length. Null and empty texts have no words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_counted(p, noise)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least)


#: A row of a dictionary: the word in the class of words of `short` and of `short` + 1 code points, of which the first `head` and the last `tail` are taken to be intact.
KEY = ["short", "head", "tail", "intact"]
ROW = "word string, n long, short int, head int, tail int, intact string"
SCANNED = f"{ROW}, near string, near_n long"


def dictionary(words: DataFrame, p: Variants) -> DataFrame:
    """Each word in its own class and in that of shorter words: in the forward dictionary by its first half, in the reversed one by its last."""
    size = F.length("word")
    classes = F.filter(F.array(size, size - 1), lambda a: a >= p.shortest)
    rows = words.select("word", "n", F.explode(classes).alias("short"))
    half = F.floor(F.col("short") / 2).cast("int")
    sides = F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("short") - half).alias("tail")))
    rows = rows.select("word", "n", "short", F.explode(sides).alias("side")).select("word", "n", "short", "side.head", "side.tail")
    return rows.withColumn("intact", F.concat(F.substring("word", F.lit(1), F.col("head")), F.when(F.col("tail") > 0, F.right("word", F.col("tail"))).otherwise("")))


class Words:
    """Words of a table as code points."""

    def __init__(self, words: list[str]):
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def shared(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """The code points that words i and j share at their begins, or at their ends."""
        size = np.minimum(self.sizes[i], self.sizes[j])
        k = np.arange(int(size.max()) + 1 if len(size) else 1)
        at = [np.clip(self.starts[x][:, None] + (self.sizes[x][:, None] - 1 - k if back else k), 0, len(self.flat) - 1) for x in (i, j)]
        same = (self.flat[at[0]] == self.flat[at[1]]) & (k < size[:, None])
        return np.argmin(same, axis=1)


def near_pairs(words: Words, short: np.ndarray, head: np.ndarray, tail: np.ndarray, starts: np.ndarray, stops: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs one edit apart of each block of rows, of which this block is the one to tell: their common beginning is at least its head and ends before its tail."""
    one = np.flatnonzero(words.sizes == short)
    width = (stops - starts)[one]
    done = 0
    total = np.cumsum(width)
    while done < len(one):
        longest = int(words.sizes[one[done:]].max()) + 2
        most = max(1, cells // longest)
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")))
        rows, sizes = one[done:to], width[done:to]
        i = np.repeat(rows, sizes)
        j = np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        fine = (words.sizes[j] > words.sizes[i]) | (j > i)
        i, j = i[fine], j[fine]
        before = words.shared(i, j, False)
        fine = (before >= head[i]) & ((tail[i] == 0) | (before < short[i] - tail[i]))
        i, j, before = i[fine], j[fine], before[fine]
        after = words.shared(i, j, True)
        fine = np.where(words.sizes[i] == words.sizes[j], before + after == short[i] - 1, before + after >= short[i])
        yield i[fine], j[fine]
        done = to


def _scanned(p: Variants, last: bool):
    """Blocks of rows in the order of their keys: links of whole blocks of up to p.block words (last: of any size), and the rows of all others, each with one more half of what is left taken to be intact."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("short", pa.int32()), ("head", pa.int32()), ("tail", pa.int32()), ("intact", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def links(table: pa.Table, starts: np.ndarray, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = Words(table.column("word").to_pylist())
        short, head, tail = (table.column(c).to_numpy().astype(np.int64) for c in ("short", "head", "tail"))
        for i, j in near_pairs(words, short, head, tail, starts, stops, p.cells):
            own, other = np.append(i, j), np.append(j, i)
            a, b = (table.select(["word", "n"]).take(pa.array(x)) for x in (own, other))
            empty = [pa.nulls(len(own), f.type) for f in schema][2:6]
            yield from pa.table([a.column("word"), a.column("n"), *empty, b.column("word"), b.column("n")], schema=schema).combine_chunks().to_batches()

    def halves(table: pa.Table) -> Iterator[pa.RecordBatch]:
        short, head, tail = (table.column(c).to_numpy().astype(np.int64) for c in ("short", "head", "tail"))
        words, left = table.column("word").to_pylist(), short - head - tail
        for h, t in ((head + left // 2, tail), (head, tail + left - left // 2)):
            intact = [w[: int(x)] + (w[len(w) - int(y) :] if y else "") for w, x, y in zip(words, h, t)]
            arrays = [table.column("word"), table.column("n"), table.column("short"), pa.array(h, pa.int32()), pa.array(t, pa.int32()), pa.array(intact, pa.string())]
            yield from pa.table([*arrays, pa.nulls(len(table), pa.string()), pa.nulls(len(table), pa.int64())], schema=schema).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edge = None, not last  # edge: the block at hand may have begun in the task before

        def out(table: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, edge
            new = np.zeros(len(table), dtype=bool)
            for c in KEY:
                column = table.column(c).combine_chunks()
                new[1:] |= np.array(pc.not_equal(column[1:], column[:-1]))
            starts = np.append(0, np.flatnonzero(new)).astype(np.int64)
            stops = np.append(starts[1:], len(table))
            whole, large = np.ones(len(starts), dtype=bool), stops - starts > p.block
            if last:
                large[:] = False
            elif edge:
                large[0] = True  # its other words may be elsewhere
            if not end:
                whole[-1] = False
                if large[-1]:
                    whole[-1] = True  # goes on as it comes
            elif not last:
                large[-1] = True
            size = stops - starts
            fine = np.repeat(whole & ~large, size)
            if fine.any():
                part = table.filter(pa.array(fine))
                sizes = size[whole & ~large]
                begin = np.cumsum(sizes) - sizes
                yield from links(part, np.repeat(begin, sizes), np.repeat(begin + sizes, sizes))
            rest = np.repeat(whole & large, size)
            if rest.any():
                yield from halves(table.filter(pa.array(rest)))
            held = None if whole[-1] else table.slice(int(starts[-1]))
            edge = not last and (len(starts) == 1 and edge or bool(whole[-1] and not end))

        for batch in batches:
            if len(batch):
                yield from out(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]), False)
        if held is not None:
            yield from out(held, True)

    return run


def near_words(words: DataFrame, p: Variants = Variants()) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of different words (word, n) of p.shortest code points at least that differ by one inserted, deleted or replaced code point, once.

    Blocks of words that share what is taken to be intact are scanned in the order of a sorted dictionary, dealt by ranges of key and word, so that a large block
    is split over tasks. A block above p.block words, or at the edge of a task, is subdivided: its words come again under keys with one more half of the rest intact,
    until one place is left. What then shares a block has at most one or two free letters, which bounds it by the alphabet (8,190 words).
    """
    rows, found = dictionary(words, p).select(*[c.split()[0] for c in ROW.split(", ")]), None
    rows = written(rows, "dictionary")
    left = F.col("short") - F.col("head") - F.col("tail")
    while True:
        free = rows.where(left > 1).repartitionByRange(*KEY, "word").sortWithinPartitions(*KEY, "word").mapInArrow(lean(_scanned(p, False)), SCANNED)
        fixed = rows.where(left <= 1).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word").mapInArrow(lean(_scanned(p, True)), SCANNED)
        scanned = written(free.union(fixed), "scanned")
        links = scanned.where("near is not null").select("word", "n", "near", "near_n")
        found = links if found is None else found.union(links)
        rows = scanned.where("near is null").select(*[c.split()[0] for c in ROW.split(", ")])
        if not rows.head(1):
            return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last word that following forms leads to. Each round doubles the way."""
    way = written(forms.select("word", F.col("form").alias("root")), "way")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "way")
        if not step.where("moved").head(1):
            return way
        way = step.select("word", "root")


def variants(words: DataFrame, p: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n: one row for each word).

    n_near counts the words one edit away. form is the one of them of largest n (of equal ones the smallest in code-point order) if that is at least p.ratio times
    the word's, else null, with its n as form_n; root is where following forms ends, the word itself if it has none. An empty table gives no rows.
    """
    with Passing() as scope:
        words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
        near = near_words(words, p)
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
        fits = F.col("near_n") >= p.ratio * F.col("n")
        rows = written(rows.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
        last = written(roots(rows.where("form is not null")), "roots")
        scope.keep(rows, last)
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, p: Variants = Variants(), noise: int | None = None) -> DataFrame:
    """The variants among the words of docs; see word_counts and variants."""
    return variants(word_counts(docs, p, noise), p)
