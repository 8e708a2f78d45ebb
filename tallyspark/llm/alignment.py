"""Cross-tokenizer alignment: DuckDB aligns the token intervals of the distinct words of an Arrow partition, Spark merges the counts of id pairs.

Neither tokenizer lets a token reach across a space that follows a plain character, so both cut a text there: it is a row of units (a space and what
follows it), and a unit's tokens, groups and links are the same wherever it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import Passing, written
from tallyspark.llm.shards import rows_of
from tallyspark.llm.text import blocks, byte_hashes
from tallyspark.llm.worker import kept, lean

#: What a space may follow where units are cut: printable ASCII. (After any other character, which may be white space to a tokenizer, no cut is made.)
PLAIN = np.zeros(256, dtype=bool)
PLAIN[0x21:0x7F] = True


@dataclass(frozen=True)
class Alignment:
    """byte_level: a byte-level BPE file of the tokenizers library (A); pieces: a sentencepiece model (B). shard: bytes of text whose counts of pairs go to Spark
    together; units: distinct units that a worker remembers; batch: units that DuckDB aligns at once; memory: of DuckDB."""

    byte_level: str
    pieces: str
    shard: int = 1 << 24
    units: int = 400_000
    batch: int = 50_000
    memory: str = "256MB"


def _byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: a and b hold the tokens of valid units: i (number in order), u (unit), s and e (bytes from the first unit's begin), id.
SQL = """
CREATE TEMP TABLE ga AS SELECT a.i, a.u, a.id, a.s, a.e, coalesce(sum(CAST(b.e IS NOT NULL AS INT)) OVER (ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
    FROM a LEFT JOIN b ON a.e = b.e;
CREATE TEMP TABLE gb AS SELECT b.i, b.u, b.id, b.s, b.e, coalesce(sum(CAST(a.e IS NOT NULL AS INT)) OVER (ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
    FROM b LEFT JOIN a ON a.e = b.e;
CREATE TEMP TABLE spans AS SELECT f.i, f.u, f.id, f.low, l.i AS high
    FROM (SELECT ga.i, ga.u, ga.id, ga.e, gb.i AS low FROM ga ASOF JOIN gb ON ga.s >= gb.s) f ASOF JOIN gb l ON f.e > l.s;
CREATE TEMP TABLE links AS SELECT u, a, b, count(*) AS n FROM (
    SELECT spans.u, spans.id AS a, gb.id AS b FROM spans JOIN gb ON gb.i = spans.low WHERE spans.low = spans.high
    UNION ALL SELECT spans.u, spans.id, gb.id FROM spans JOIN gb ON gb.i BETWEEN spans.low AND spans.high WHERE spans.low < spans.high) GROUP BY ALL;
"""
#: Units that go to a tokenizer as one text.
TOGETHER = 128


class Aligner:
    """Both tokenizers and the aligned units that a worker remembers."""

    def __init__(self, p: Alignment):
        import os

        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.p = p
        self.a = Tokenizer.from_file(p.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=p.pieces)
        letters = _byte_letters()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if any(" " in x.decode("utf-8", "ignore").lstrip(" ") for x in self.b_bytes):
            raise ValueError("this model joins words; its texts have no safe boundaries at spaces")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.numerals = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.lone = self.b.piece_to_id("▁")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": p.memory, "temp_directory": ""})
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; all 0: the tokens do not give the unit's bytes
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros((0, 3), np.int64)  # a, b, n of each unit's links

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """The number of each unit; a bare one gets a space before it."""
        hashes = byte_hashes(buf, np.where(bare, starts, starts + 1), ends)
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        fresh = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(fresh):
            data = buf.tobytes()
            units = [(b" " if bare[i] else b"") + data[starts[i] : ends[i]] for i in first[fresh]]
            numbers = np.arange(len(units)) + len(self.groups)
            for k in range(0, len(units), self.p.batch):
                self.add(units[k : k + self.p.batch])
            keys, place = np.append(self.keys, hashes[fresh]), np.append(self.place, numbers)
            order = np.argsort(keys)
            self.keys, self.place = keys[order], place[order]
        return self.place[np.searchsorted(self.keys, hashes)][inverse]

    def add(self, units: list[bytes]) -> None:
        """Aligns further units."""
        encode = lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        pieces = lambda texts: [[self.lone] if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1))]
        (a_ids, n_a), (b_ids, n_b) = self.tokens(units, encode, self.a_bytes), self.tokens(units, pieces, self.b_bytes)
        valid = (n_a > 0) & (n_b > 0)
        self.db.register("a", self.intervals(a_ids, n_a, valid, self.a_sizes))
        self.db.register("b", self.intervals(b_ids, n_b, valid, self.b_sizes))
        self.db.execute(SQL)
        links = self.db.execute("SELECT u, a, b, n FROM links ORDER BY u").fetchnumpy()
        sides = [self.db.execute(f"SELECT u, id, g FROM {name} ORDER BY i").fetchnumpy() for name in ("ga", "gb")]
        for name in ("ga", "gb", "spans", "links"):
            self.db.execute(f"DROP TABLE {name}")
        strings, n_groups = self.shown(sides, len(units))
        n_links = np.bincount(links["u"], weights=links["n"], minlength=len(units)).astype(np.int64)
        self.groups += strings
        self.counts = np.concatenate([self.counts, np.stack([np.where(valid, n_a, 0), np.where(valid, n_b, 0), n_groups, n_links], axis=1)])
        sizes = np.bincount(links["u"], minlength=len(units))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.pairs = np.concatenate([self.pairs, np.stack([links["a"], links["b"], links["n"]], axis=1).astype(np.int64)])

    def tokens(self, units: list[bytes], encode, table: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """The ids of each unit, and their number, 0 where their bytes are not the unit's. Units that end with a plain character go to the tokenizer many at a time: it cuts their text where they end."""
        ids: list[list[int]] = [[]] * len(units)
        plain = [i for i, u in enumerate(units) if PLAIN[u[-1]]]
        alone = [i for i, u in enumerate(units) if not PLAIN[u[-1]]]
        sets = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for own, found in zip(sets, encode([b"".join([units[i] for i in own]).decode("utf-8") for own in sets])):
            parts = list(map(table.__getitem__, found))
            ends = np.cumsum(list(map(len, parts)))
            want = np.cumsum([len(units[i]) for i in own])
            at = np.searchsorted(ends, want)
            if b"".join(parts) != b"".join([units[i] for i in own]) or not np.array_equal(ends[at], want):
                alone += own
                continue
            begin = 0
            for i, stop in zip(own, (at + 1).tolist()):
                ids[i] = found[begin:stop]
                begin = stop
        for i, found in zip(alone, encode([units[i].decode("utf-8") for i in alone])):
            ids[i] = found if b"".join(map(table.__getitem__, found)) == units[i] else []
        return ids, np.array([len(x) for x in ids], dtype=np.int64)

    def intervals(self, ids: list[list[int]], n: np.ndarray, valid: np.ndarray, sizes: np.ndarray) -> pa.Table:
        """The tokens of valid units one after another, with the bytes that they stand for."""
        flat = np.array([i for x, v in zip(ids, valid.tolist()) if v for i in x], dtype=np.int32)
        ends = np.cumsum(sizes[flat])
        return pa.table({"i": np.arange(len(flat)), "u": np.repeat(np.arange(len(ids)), np.where(valid, n, 0)), "s": ends - sizes[flat], "e": ends, "id": flat})

    def shown(self, sides: list[dict], n_units: int) -> tuple[list[bytes], np.ndarray]:
        """Each unit's groups as text, and their number: both sides' ids in the order of group and side, with the mark that follows each."""
        unit, ids, key = (np.concatenate([np.asarray(x[c]) for x in sides]).astype(np.int64) for c in ("u", "id", "g"))
        key = 2 * key + (np.arange(len(key)) >= len(sides[0]["u"]))
        order = np.argsort(key, kind="stable")
        unit, ids, key = unit[order], ids[order], key[order]
        same, last = np.append(key[1:] == key[:-1], False), np.append(unit[1:] != unit[:-1], True)
        mark = np.where(same, 0, np.where(key % 2 == 0, 1, np.where(last, 3, 2)))
        parts: list[str] = [""] * (2 * len(ids))
        parts[0::2], parts[1::2] = map(self.numerals.__getitem__, ids.tolist()), map((",", "|", ";", "").__getitem__, mark.tolist())
        text = "".join(parts).encode()
        size = np.searchsorted(10 ** np.arange(1, 7), ids, side="right") + 1 + (mark < 3)
        stops = np.append(0, np.cumsum(size))[np.searchsorted(unit, np.arange(n_units + 1))].tolist()
        return [text[x:y] for x, y in zip(stops, stops[1:])], np.bincount(unit[mark >= 2], minlength=n_units)


def unit_bounds(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of rows."""
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:-1] = (buf[1:] == 0x20) & PLAIN[buf[:-1]]
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    cut[len(buf)] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts


#: A shard: its documents' counts, and in compressed arrays the numbers of units and how often each occurs in each document, the links of the units, and the id pairs that these name.
SHARD = {"ids": "<i8", "none": "<u1", "counts": "<i8", "sums": "<u1", "documents": "<i4", "units": "<i4", "times": "<i4", "starts": "<i4", "links": "<i4", "each": "<i4", "a": "<i4", "b": "<i4", "n": "<i8"}
SHARDS = "shard long, " + ", ".join(f"{c} binary" for c in SHARD)


def _compressed(a: np.ndarray, kind: str) -> bytes:
    data = a.astype(kind).tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _array(cell: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(cell[:8], "little")
    return np.frombuffer(pa.decompress(cell[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


class Documents:
    """The documents of a shard as they come, block by block."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.size = aligner, 0
        self.ids, self.none, self.totals, self.digests, self.rows, self.units = [], [], [], [], [], []

    def close(self, doc_id: int | None, parts: list[np.ndarray], digest) -> None:
        """One document of which all units are known."""
        all_units = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        counts = self.aligner.counts[all_units]
        fine = bool(len(all_units)) and bool((counts[:, 0] > 0).all())
        self.ids.append(doc_id or 0)
        self.none.append(doc_id is None)
        self.totals.append(counts.sum(axis=0) if fine else np.zeros(4, np.int64))
        self.digests.append(digest.digest() if fine else bytes(32))
        self.rows.append(len(all_units) if fine else 0)
        if fine:
            self.units.append(all_units)

    def row(self, shard: int) -> pa.RecordBatch:
        units = np.concatenate([*self.units, np.zeros(0, np.int64)])
        document = np.repeat(np.arange(len(self.ids)), self.rows)
        used, local = np.unique(units, return_inverse=True)
        keys, times = np.unique(document * max(1, len(used)) + local, return_counts=True)
        document, local = np.divmod(keys, max(1, len(used)))
        sizes = self.aligner.starts[used + 1] - self.aligner.starts[used]
        starts = np.append(0, np.cumsum(sizes))
        links = self.aligner.pairs[np.repeat(self.aligner.starts[used] - starts[:-1], sizes) + np.arange(starts[-1])]
        pairs, link = np.unique(links[:, 0] << 32 | links[:, 1], return_inverse=True)
        often = np.bincount(local, weights=times, minlength=len(used)).astype(np.int64)
        n = np.bincount(link, weights=links[:, 2] * np.repeat(often, sizes), minlength=len(pairs)).astype(np.int64)
        arrays = {
            "ids": np.array(self.ids, np.int64), "none": np.array(self.none), "counts": np.array(self.totals, np.int64), "sums": np.frombuffer(b"".join(self.digests), np.uint8), "documents": np.bincount(document, minlength=len(self.ids)),
            "units": np.diff(local, prepend=0), "times": times, "starts": starts, "links": link, "each": links[:, 2], "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n,
        }
        row = {c: _compressed(arrays[c], kind) for c, kind in SHARD.items()} | {"shard": shard}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in SHARD]]))


def _aligned(p: Alignment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(p, lambda: Aligner(p))
        shard = TaskContext.get().partitionId() << 24
        docs = Documents(aligner)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            parts, digest = [], hashlib.sha256()
            for block in blocks(batch.column("text"), after=PLAIN):
                starts, ends = unit_bounds(block.buf, block.bounds)
                bare = np.isin(starts, block.bounds[:-1][0 if block.begins else 1 :])
                units = aligner.find(block.buf, starts, ends, bare)
                before = np.searchsorted(starts, block.bounds)
                for r in range(len(block.bounds) - 1):
                    own = units[before[r] : before[r + 1]]
                    text = b";".join(map(aligner.groups.__getitem__, own.tolist()))
                    digest.update(b";" + text if parts else text)
                    if len(own):
                        parts.append(own)
                    if block.ends:
                        docs.close(ids[block.first + r], parts, digest)
                        parts, digest = [], hashlib.sha256()
                docs.size += len(block.buf)
                if block.ends and (docs.size >= p.shard or len(aligner.groups) > p.units):
                    yield docs.row(shard)
                    shard += 1
                    if len(aligner.groups) > p.units:
                        aligner.clear()
                    docs = Documents(aligner)
        if docs.ids:
            yield docs.row(shard)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in rows_of(batch):
            a, b, n = (_array(row[c], SHARD[c]) for c in "abn")
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(n), pa.array(np.full(len(a), row["shard"])), pa.array(np.arange(len(a)))], names=["a", "b", "n", "shard", "k"])


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(_, shards: pa.Table, totals: pa.Table) -> pa.Table:
    row = next(rows_of(shards))
    x = {c: _array(row[c], kind) for c, kind in SHARD.items()}
    total, best = np.zeros(len(x["a"]), np.int64), np.zeros(len(x["a"]), np.int64)
    k = totals.column("k").to_numpy()
    total[k], best[k] = totals.column("total").to_numpy(), totals.column("best").to_numpy(zero_copy_only=False)
    link, each = x["links"], x["each"].astype(np.int64)
    at, edges = np.cumsum(x["units"]), np.append(0, np.cumsum(x["documents"]))
    sums = []
    for value in (best, total):
        units = np.diff(np.append(0, np.cumsum(value[link] * each))[x["starts"]])
        sums.append(np.diff(np.append(0, np.cumsum(units[at] * x["times"]))[edges]))
    counts = x["counts"].reshape(-1, 4)
    digests = [s.tobytes().hex() if n else "" for s, n in zip(x["sums"].reshape(-1, 32), counts[:, 0])]
    ids = pa.array(x["ids"], mask=x["none"].astype(bool))
    return pa.table([ids, *[pa.array(counts[:, c]) for c in range(4)], *[pa.array(s) for s in sums], pa.array(digests, pa.string())], names=[c.split()[0] for c in OUT.split(", ")])


def _totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))


def id_pairs(docs: DataFrame, p: Alignment) -> DataFrame:
    """a, b, total, best: how many links of all texts of docs hold an A id and a B id, and whether no other A id has more with that B id."""
    with Passing() as scope:
        shards = written(_shards(docs, p), "aligned")
        totals = written(_totals(_rows(shards)), "totals")
        scope.keep(totals)
    return _best(totals)


def _shards(docs: DataFrame, p: Alignment) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_aligned(p)), SHARDS)


def _rows(shards: DataFrame) -> DataFrame:
    return shards.select("shard", "a", "b", "n").mapInArrow(lean(_pairs), "a int, b int, n long, shard long, k long")


def _best(totals: DataFrame) -> DataFrame:
    highest = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, p: Alignment) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs (doc_id: long, text).

    A are the tokens of a space and the text, B those of the text, each with the bytes it stands for; special tokens' strings are plain text. Offsets where tokens of both end cut them into groups;
    a link is a pair of tokens whose byte ranges overlap, its count how many links of all texts hold the same two ids; n_best counts the links of which no other A id has more with the same B id.
    groups_sha256 is that of `a1,a2|b1;a3|b2,b3`. Texts null, empty, or of which the tokens' bytes are not the text's have zeros and an empty groups_sha256, and count nowhere.
    Every row has its own result, also rows of one or of no doc_id; an empty table gives no rows; other columns are ignored.

    A task aligns each distinct unit once, in DuckDB: tables of token intervals, as-of joins for the first and last overlapping token, a range join for those between, running sums of common ends for groups.
    It writes its documents as rows of units, in shards. Pairs of a shard go to Spark with their counts, and come back with the totals.
    """
    with Passing() as scope:
        shards = written(_shards(docs, p), "aligned")
        totals = written(_totals(_rows(shards)), "totals")
        back = written(_rows(shards).join(_best(totals), ["a", "b"]).select("shard", "k", "total", "best"), "back")
        scope.keep(shards, back)
    return shards.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_summed, OUT)
