"""Substring dedup: hashed runs of consecutive sentences, joined over all documents; what a repeated run covers goes, but for the first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import written
from tallyspark.llm.text import Spans, blocks, byte_hashes, column_bytes, word_bounds
from tallyspark.llm.worker import forget, lean


@dataclass(frozen=True)
class Runs:
    """A run is the shortest row of at least `sentences` consecutive sentences that has at least `words` words. A sentence ends at a line's end or
    after a word that ends in a full stop, question or exclamation mark (a closing quote or bracket may follow); one of more than
    `longest` words is cut before each word that has the last smallest hash of some `cut` consecutive words of the sentence. So cuts are at most
    `cut` words apart, and more than `cut` - 2 words inside a passage they stand at the same places wherever it does: any 4 * cut + words - 3 shared
    words (49) without a sentence end hold a whole run. Of a longer passage at most 2 * cut - 2 words before its runs stay, and 3 * cut - 2 behind them."""

    sentences: int = 2
    words: int = 20
    longest: int = 24
    cut: int = 8


class Rows(NamedTuple):
    """Whole rows: words of all of them, sentences (first word of each, one entry more), the sentences before each row."""

    first: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray
    before: np.ndarray


_STOP = np.zeros(256, dtype=bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[[ord('"'), ord("'"), ord(")"), ord("]")]] = True


def sentences(column: pa.Array, p: Runs) -> Iterator[Rows]:
    whole, bounds = column_bytes(column)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    for block in blocks(column):
        starts, ends, before = word_bounds(block.buf, block.bounds)
        hashes = byte_hashes(block.buf, starts, ends)
        buf = block.buf
        if not (block.begins and block.ends):
            held.append((starts + at, ends + at, hashes))
            at += len(block.buf)
            if not block.ends:
                continue
            starts, ends, hashes = (np.concatenate(x) for x in zip(*held))
            buf, before = whole[bounds[block.first] : bounds[block.first + 1]], np.array([0, len(starts)])
            held, at = [], 0
        yield _cut(block.first, buf, starts, ends, hashes, before, p)


def _cut(first: int, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, before: np.ndarray, p: Runs) -> Rows:
    n = len(starts)
    last = buf[ends - 1]
    closed = _STOP[last] | (_CLOSE[last] & (ends - starts > 1) & _STOP[buf[np.maximum(ends - 2, 0)]])
    lines = np.flatnonzero(buf == 0x0A)
    new = np.zeros(n + 1, dtype=bool)
    new[1:n] = closed[:-1] | (np.searchsorted(lines, ends[:-1]) < np.searchsorted(lines, starts[1:])) if n else False
    new[before] = True
    edges = np.flatnonzero(new)
    new[_lows(hashes, edges, p)] = True
    new[n] = True
    edges = np.flatnonzero(new)
    return Rows(first, buf, starts, ends, hashes, edges, np.searchsorted(edges, before))


def _lows(hashes: np.ndarray, edges: np.ndarray, p: Runs) -> np.ndarray:
    """The words of long sentences that have the last smallest hash of some p.cut consecutive words of their sentence."""
    sizes = np.diff(edges)
    long_ones = sizes > p.longest
    at = np.flatnonzero(np.repeat(long_ones, sizes))
    first, stop = (np.repeat(x[long_ones], sizes[long_ones]) for x in (edges[:-1], edges[1:]))
    own, wide = hashes[at], np.ones(len(at), dtype=np.int64)
    left, right = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    for k in range(1, p.cut):
        left &= (at - k >= first) & (hashes[np.maximum(at - k, 0)] >= own)
        right &= (at + k < stop) & (hashes[np.minimum(at + k, len(hashes) - 1)] > own)
        wide += left
        wide += right
    return at[wide >= p.cut]


def _runs(p: Runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for rows in sentences(batch.column("text"), p):
                counts = np.diff(rows.before)
                n = int(counts.sum())
                if not n:
                    continue
                row = np.repeat(np.arange(len(counts)), counts)
                here = np.arange(n)
                word = np.searchsorted(rows.edges, np.minimum(rows.edges[:n] + p.words - 1, max(0, len(rows.hashes) - 1)), side="right") - 1
                until = np.maximum(word, here + p.sentences - 1)
                stop = rows.before[row + 1]
                enough = rows.edges[np.minimum(until + 1, n)] - rows.edges[:n] >= p.words
                fits = (until < stop) & enough
                here, until = here[fits], until[fits]
                hashes = Spans(rows.hashes).hashes(rows.edges[here], rows.edges[until + 1])
                yield pa.record_batch(
                    [pa.array(hashes.view(np.int64)), batch.column("doc_id").take(pa.array(rows.first + row[here])), pa.array(here - rows.before[row[here]]), pa.array(until - here + 1)],
                    names=["run", "doc_id", "at", "n"],
                )

    return run


def _clean(p: Runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone_of = batch.column("gone")
            for rows in sentences(batch.column("text"), p):
                texts, totals, removed, words = [], [], [], []
                for r in range(len(rows.before) - 1):
                    i, a, b = rows.first + r, rows.before[r], rows.before[r + 1]
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    for s, n in ((g["at"], g["n"]) for g in gone_of[i].as_py() or []):
                        gone[s] += 1
                        gone[min(s + n, b - a)] -= 1
                    out = np.cumsum(gone[:-1]) > 0
                    totals.append(b - a)
                    removed.append(int(out.sum()))
                    words.append(int(np.diff(rows.edges[a : b + 1])[out].sum()))
                    if not out.any():
                        texts.append(batch.column("text")[i].as_py())
                        continue
                    data = (batch.column("text")[i].as_py() or "").encode("utf-8")
                    base = rows.starts[rows.edges[a]]
                    lead = _lead(data)
                    marks = np.append(rows.starts[rows.edges[a:b]] - base + lead, len(data))
                    texts.append((data[:lead] + b"".join(data[marks[j] : marks[j + 1]] for j in np.flatnonzero(~out))).decode("utf-8"))
                k = len(texts)
                yield pa.record_batch([batch.column("row").slice(rows.first, k), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64())], names=["row", "text", "n_sentences", "n_removed", "removed_words"])

    return run


def _lead(data: bytes) -> int:
    return len(data) - len(data.lstrip(b" \t\n\r\x0b\x0c"))


def repeated_runs(docs: DataFrame, p: Runs = Runs()) -> DataFrame:
    """doc_id, at (sentence), n (sentences) of each run of docs (doc_id: long, text) that is not the first of its kind by doc_id and place."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    runs = rows.mapInArrow(lean(_runs(p)), "run long, doc_id long, at long, n long")
    found = runs.groupBy("run").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "at")).alias("first")).where("many > 1").select("run", "first")
    firsts = written(found, "firsts")  # on its own, so that the join below reads both sides from exchanges and a hot run is split
    return runs.join(firsts, "run").where("struct(doc_id, at) <> first").select("doc_id", "at", "n")


def substring_dedup(docs: DataFrame, p: Runs = Runs()) -> DataFrame:
    """docs with cleaned texts: its own columns, and n_sentences, n_removed, removed_words.

    A run of sentences that stands in several places stays in the first one, by doc_id and then place; in all others its
    sentences go, with the white space behind them. Texts too short for a run stay as they are, as do rows of a null doc_id. Rows
    that share a doc_id count as one document: the same run at the same place of both is one. A text of which everything goes is empty; a null
    text stays null; an empty table gives no rows. A column of docs that has an added one's name gives way to it; n_chars is left as it is.
    """
    hits = repeated_runs(docs, p).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    hits = written(hits, "gone")
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed_words")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    base = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = base.where("doc_id is not null").join(hits, "doc_id", "left").select("row", "text", "gone")
    joined = found.union(base.where("doc_id is null").select("row", "text", F.lit(None).cast(hits.schema["gone"].dataType).alias("gone")))
    schema = f"row {joined.schema['row'].dataType.simpleString()}, text string, n_sentences long, n_removed long, removed_words long"
    out = joined.mapInArrow(lean(_clean(p)), schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], "n_sentences", "n_removed", "removed_words")
