"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning on signatures, exact check of the survivors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.graph import components
from tallyspark.llm.scratch import Passing, spread, written
from tallyspark.llm.text import mixed, row_words
from tallyspark.llm.worker import forget, lean


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. A pair of similarity `threshold` shares no band with probability (1 - threshold**rows)**bands, 3e-6 as given.

    width: words of a shingle. rows, bands: minhash values of a band, and bands; the groups of the first `early` bands are worked on before all others.
    compared: minhash values that the Bayesian check may read, in batches of `batch`. miss: a candidate is dropped once the posterior probability
    (uniform prior) that its similarity reaches the threshold is below this. block_rows, block_bytes: rows of a group that one task compares, and bytes of
    their shingles; a larger group is dealt to several blocks.
    """

    width: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 42
    compared: int = 128
    batch: int = 32
    miss: float = 1e-5
    early: int = 4
    block_rows: int = 2048
    block_bytes: int = 1 << 24

    def __post_init__(self):
        if not 0 < self.bands <= 64:
            raise ValueError("the bands' numbers must fit their keys")

    @property
    def threshold(self) -> float:
        return self.percent / 100

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m): with fewer than m equal values among the first n, a pair is dropped."""
        found, t = [], self.threshold
        for n in range(self.batch, self.compared + 1, self.batch):
            below, m = 0.0, 0
            while m <= n:  # posterior P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
                below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
                if below >= self.miss:
                    break
                m += 1
            found.append((n, m))
        return found


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct 64-bit shingle hashes row after row, bounds by row) of blocks of rows.

    A-Z count as a-z. A text of 1 to width-1 words is one shingle; a text without words has none.
    """
    odd = np.random.default_rng(104_729).integers(1, 1 << 63, width + 1, dtype=np.uint64) | np.uint64(1)
    for first, words, before in row_words(column, lower=True):
        counts = np.diff(before)
        rows = np.repeat(np.arange(len(counts)), counts)
        if len(words) >= width:
            n = len(words) - width + 1
            h = words[:n] * odd[0]
            for j in range(1, width):
                h = h + words[j : j + n] * odd[j]
            inside = rows[:n] == rows[width - 1 :]
            h, of = h[inside], rows[:n][inside]
        else:
            h, of = words[:0], rows[:0]
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            part = words[before[r] : before[r + 1]]
            one = np.append(part * odd[: len(part)], odd[width:] * np.uint64(len(part))).sum(dtype=np.uint64)
            at = np.searchsorted(of, r)
            h, of = np.insert(h, at, one), np.insert(of, at, r)
        h = mixed(h)
        bounds = np.searchsorted(of, np.arange(len(counts) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            h[a:b].sort()
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield first, h[fresh], np.searchsorted(of[fresh], np.arange(len(counts) + 1))


def digests(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each row's set, by which equal sets are known."""
    out, some = [], np.flatnonzero(np.diff(bounds))
    for key in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        d = np.zeros(len(bounds) - 1, dtype=np.uint64)
        if len(some):
            d[some] = np.add.reduceat(mixed(sets ^ np.uint64(key)), bounds[:-1][some])
        out.append(d)
    return out


#: The bits of a band's key that hold the band's number.
PLACES = np.uint64(63)
SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, compared binary, bands array<long>"


def sketcher(p: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        k = p.rows * p.bands
        rng = np.random.default_rng(15_485_863)
        scale = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
        shift = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        seeds = rng.integers(1, 1 << 63, (p.bands, p.rows + 1), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, sets, bounds in shingle_sets(batch.column("text"), p.width):
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                d1, d2 = digests(sets, bounds)
                values = np.full((len(n), k), 0xFFFFFFFF, dtype=np.uint32)
                if len(some):
                    at = bounds[:-1][some]
                    short = (sets >> np.uint64(32)).astype(np.uint32)
                    for i in range(k):
                        values[some, i] = np.minimum.reduceat(short * scale[i] + shift[i], at)
                wide = values.astype(np.uint64).reshape(len(n), p.bands, p.rows)
                keys = mixed((wide * seeds[:, :-1]).sum(axis=2, dtype=np.uint64) + seeds[:, -1])
                keys = ((keys & ~PLACES) | np.arange(p.bands, dtype=np.uint64)).view(np.int64)
                cells = values[:, : p.compared].astype("<u2").tobytes()
                yield pa.record_batch(
                    [
                        ids.slice(first, len(n)),
                        pa.array(n.astype(np.int64)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, 2 * p.compared * (len(n) + 1), 2 * p.compared, dtype=np.int32)), pa.py_buffer(cells)]),
                        pa.ListArray.from_arrays(np.arange(0, p.bands * (len(n) + 1), p.bands, dtype=np.int32), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "compared", "bands"],
                )

    return run


SET = "doc_id long, d1 long, shingles binary"


def set_maker(p: NearDuplicates):
    """doc_id, d1 (as the sketch has it) and the sorted shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets, bounds in shingle_sets(batch.column("text"), p.width):
                n = len(bounds) - 1
                cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64) * 8), pa.py_buffer(sets)]).cast(pa.binary())
                yield pa.record_batch([batch.column("doc_id").slice(first, n), pa.array(digests(sets, bounds)[0].view(np.int64)), cells], names=["doc_id", "d1", "shingles"])

    return run


class Apart:
    """Labels of a block's rows that links join: union-find, the smaller label leads."""

    def __init__(self, labels: np.ndarray):
        self.label, self.place = np.unique(labels, return_inverse=True)
        self.up = np.arange(len(self.label))

    def roots(self) -> np.ndarray:
        """The root of each row."""
        while not np.array_equal(self.up, self.up[self.up]):
            self.up = self.up[self.up]
        return self.up[self.place]

    def root(self, row: int) -> int:
        x = self.place[row]
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the rows a and b were apart until now."""
        x, y = self.root(a), self.root(b)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Block:
    """Rows of a group: ids, labels, set sizes, signatures and sets, and the links found between them."""

    #: Signature values compared at once.
    PAIRS = 1 << 17
    #: Survivors of a row that are verified one by one, the likeliest first; the rest are verified together.
    SINGLY = 8

    def __init__(self, p: NearDuplicates, columns: dict[str, list]):
        self.p, self.ids = p, np.array(columns["doc_id"], dtype=np.int64)
        self.kind = np.array(columns["kind"], dtype=np.int64)
        self.size = np.array(columns["n_shingles"], dtype=np.int64)
        self.cells = np.frombuffer(b"".join(columns["compared"]), dtype="<u2").reshape(-1, p.compared)
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in columns.get("shingles", ())]
        self.apart, self.links = Apart(np.array(columns["label"], dtype=np.int64)), []

    def survivors(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that set sizes and, batch by batch, the bound on the posterior similarity leave; and their equal values."""
        fit = 100 * np.minimum(self.size[i], self.size[j]) >= self.p.percent * np.maximum(self.size[i], self.size[j])
        i, j, seen = i[fit], j[fit], 0
        equal = np.zeros(len(i), dtype=np.int64)
        for n, least in self.p.least_matches():
            equal += (self.cells[i, seen:n] == self.cells[j, seen:n]).sum(axis=1)
            seen, keep = n, equal >= least
            i, j, equal = i[keep], j[keep], equal[keep]
        return i, j, equal

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        """Of the rows js those whose full sets are similar enough to that of row i."""
        own, others = self.sets[i], [self.sets[j] for j in js]
        sizes = self.size[js]
        every = np.concatenate(others)
        hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        return js[100 * common >= self.p.percent * (len(own) + sizes - common)]

    def verify(self, i: int, js: np.ndarray) -> int:
        """Joins row i with those of js, the likeliest first, that are alike and still apart from it; and how many labels that joined."""
        new = 0
        for first, stop in [*((k, k + 1) for k in range(min(self.SINGLY, len(js)))), *((k, k + 256) for k in range(self.SINGLY, len(js), 256))]:
            part = js[first:stop]
            part = part[[self.apart.root(j) != self.apart.root(i) for j in part]]
            for j in self.linked(i, part) if len(part) else ():
                if self.apart.join(i, j):
                    self.links.append((self.ids[i], self.ids[j]))
                    new += 1
        return new

    def kept(self, asked: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The survivors of all pairs of different labels, one of asked and one of others, in steps."""
        step = max(1, self.PAIRS // max(1, len(others)))
        for at in range(0, len(asked), step):
            rows, roots = asked[at : at + step], self.apart.roots()
            x, y = np.nonzero(roots[rows][:, None] != roots[others][None, :])
            yield self.survivors(rows[x], others[y])

    def against(self, asked: np.ndarray, others: np.ndarray) -> int:
        """Compares rows of different labels, each of asked with each of others; how many labels that joined."""
        new = 0
        for i, j, equal in self.kept(asked, others):
            order = np.lexsort((j, -equal, i))
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(i))):
                new += self.verify(i[a], j[a:b])
        return new

    def within(self) -> None:
        """All rows with each other: a leader with all that are apart from it while that finds much, then all others in full."""
        n = len(self.ids)
        every = np.arange(n)
        for leader in every[:: max(1, n // 8)] if n > 32 else ():
            if self.against(np.array([leader]), every) * 32 < n:
                break
        self.against(self.outside(), every)

    def outside(self) -> np.ndarray:
        """The rows outside the largest label."""
        roots = self.apart.roots()
        return np.flatnonzero(roots != np.bincount(roots).argmax())

    def sifted(self) -> np.ndarray:
        """Whether each row is in a pair that the signatures keep."""
        asked = np.flatnonzero(self.kind == 0)
        sides = (asked, np.flatnonzero(self.kind == 1)) if len(asked) else (self.outside(), np.arange(len(self.ids)))
        out = np.zeros(len(self.ids), dtype=bool)
        for i, j, _ in self.kept(*sides):
            out[i] = out[j] = True
        return out

    def found(self) -> list[tuple[int, int]]:
        asked = np.flatnonzero(self.kind == 0)
        if len(asked):
            self.against(asked, np.flatnonzero(self.kind == 1))
        else:
            self.within()
        return self.links


PLACE = ["band", "asking", "asked"]
SIGNED = ["kind", "doc_id", "label", "n_shingles", "compared"]
DEALT = "band long, asking int, asked int, kind int, doc_id long, d1 long, label long"


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of batches sorted by PLACE."""
    here, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in PLACE])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for first, stop in zip([0, *cuts], [*cuts, len(batch)]):
            if held and tuple(keys[:, first]) != here:
                yield pa.Table.from_batches(held)
                held = []
            here = tuple(keys[:, first])
            held.append(batch.slice(first, stop - first))
    if held:
        yield pa.Table.from_batches(held)


def sifter(p: NearDuplicates):
    """Of blocks, sorted by PLACE, the rows that are in a pair that the signatures keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            keep = Block(p, {c: table.column(c).to_pylist() for c in SIGNED}).sifted()
            yield from table.select([c.split()[0] for c in DEALT.split(", ")]).filter(pa.array(keep)).to_batches()

    return run


def comparer(p: NearDuplicates):
    """Of blocks, sorted by PLACE, links between rows of different labels, no more than join them. Rows of kind 0 are compared with those of kind 1; where there are none, all with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            links = Block(p, {c: table.column(c).to_pylist() for c in [*SIGNED, "shingles"]}).found()
            yield pa.record_batch([pa.array([int(x[k]) for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return run


def _in_blocks(dealt: DataFrame, beside: DataFrame, columns: list[str]) -> DataFrame:
    """Rows dealt to blocks (DEALT) with columns of `beside`, sorted by block."""
    full = dealt.join(beside.select("doc_id", "d1", *columns), ["doc_id", "d1"]).select(*PLACE, "kind", "doc_id", "d1", "label", *columns)
    return full.repartition(spread(dealt.sparkSession), *PLACE).sortWithinPartitions(*PLACE, "kind")


def _blocks(rows: str, size: str, p: NearDuplicates):
    """Blocks that so many rows with so many shingles take."""
    return F.expr(f"cast(greatest(1, ceil({rows} / {p.block_rows}), ceil(8 * {size} / {p.block_bytes})) as int)")


def _compared(dealt: DataFrame, near: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links of the rows dealt to blocks."""
    return written(_in_blocks(dealt, near, ["n_shingles", "compared", "shingles"]).mapInArrow(lean(comparer(p)), "src long, dst long"), "links")


#: Whether a band is one of the first so many.
IS_EARLY = f"((band & {int(PLACES)}) < {{}})"


def _first_links(members: DataFrame, near: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links within the blocks of the first bands' groups."""
    rows = members.where(IS_EARLY.format(p.early))
    own = F.expr("pmod(xxhash64(doc_id, d1, band), blocks)").cast("int")
    return _compared(rows.select("band", F.lit(0).alias("asking"), own.alias("asked"), F.lit(1).alias("kind"), "doc_id", "d1", F.col("doc_id").alias("label")), near, p)


def _other_links(members: DataFrame, reps: DataFrame, near: DataFrame, labels: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links within groups that the first round left apart: of one block, or rows outside the largest label against all rows, block by block. Signatures alone go first; only rows that they keep are joined by their sets."""
    rows = members.where(f"not {IS_EARLY.format(p.early)} or blocks > 1")
    rows = rows.join(labels, rows.doc_id == labels.node, "left").select("band", "doc_id", "d1", "n_shingles", "blocks", F.coalesce("component", "doc_id").alias("label"))
    rows = written(rows, "placed")
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("size"))
    groups = sizes.groupBy("band").agg(F.max(F.struct("many", "label", "size")).alias("top"), F.sum("many").alias("n"), F.sum("size").alias("all")).where("n > top.many")
    groups = groups.select("band", F.col("top.label").alias("top"), (F.col("n") - F.col("top.many")).alias("many"), (F.col("all") - F.col("top.size")).alias("size")).select("band", "top", _blocks("many", "size", p).alias("out_blocks"))
    rows = rows.join(written(groups, "apart"), "band")  # written, so that the join can split a hot band
    hashed = lambda n: F.expr(f"pmod(xxhash64(doc_id, d1, band), {n})").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = rows.where("blocks = 1").select("band", F.lit(0).alias("asking"), F.lit(0).alias("asked"), F.lit(1).alias("kind"), "doc_id", "d1", "label")
    asking = rows.where("blocks > 1 and label <> top").select("band", hashed("out_blocks").alias("asking"), each("blocks").alias("asked"), F.lit(0).alias("kind"), "doc_id", "d1", "label")
    asked = rows.where("blocks > 1").select("band", each("out_blocks").alias("asking"), hashed("blocks").alias("asked"), F.lit(1).alias("kind"), "doc_id", "d1", "label")
    dealt = _in_blocks(whole.union(asking).union(asked), reps, ["n_shingles", "compared"])
    return _compared(written(dealt.mapInArrow(lean(sifter(p)), DEALT), "sifted"), near, p)


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row for each row of docs (doc_id: long, text): doc_id, n_shingles, component_id, kept.

    Rows of equal shingle sets form one class; only the classes' smallest doc_ids go on. Classes that share a band
    are candidates; of bands with the same members one is kept. A group's rows are dealt to blocks of bounded size. In a block rows of different labels are
    compared by their signatures, batch by batch, and by their full sets if the posterior bound keeps them, the likeliest first; once two labels are linked, no further pair of them is
    compared, and only links that join two labels leave the block. The first bands' blocks come first; what is then still apart in a
    group is compared in full: rows outside its largest label against all its rows, block by block. So no candidate pair of different
    components is left out, no pair leaves a task but as a link, and a task holds two blocks.

    Rows of a null doc_id link with nothing (component null, kept). Rows that share a doc_id go each by its own text; only where that id is the
    smallest of several classes are these linked through it. Texts without words are empty sets
    and link with nothing. Other columns are ignored.
    """
    with Passing() as scope:
        source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        sketches = written(source.mapInArrow(lean(sketcher(p)), SKETCH), "sketches")
        key = ["n_shingles", "d1", "d2"]
        full = sketches.where("doc_id is not null and n_shingles > 0")
        classes = written(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
        reps = full.join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id", *key])
        reps = written(reps, "reps")
        banded = reps.select("doc_id", "d1", "n_shingles", F.explode("bands").alias("band"))
        shared = banded.groupBy("band").agg(F.count("*").alias("many")).where("many > 1").select("band")
        # Merge joins at every size: lists of bands and of texts of groups grow with the input, and so would their broadcasts.
        rows = written(banded.join(shared.hint("merge"), "band"), "banded")
        groups = rows.groupBy("band").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("size"), F.min("doc_id").alias("low"), F.bit_xor(F.xxhash64("doc_id", "d1")).alias("same"))
        groups = groups.groupBy("many", "size", "low", "same").agg(F.min(F.struct((F.col("band").bitwiseAND(int(PLACES))).alias("place"), "band")).alias("one"))
        groups = written(groups.select("one.band", _blocks("many", "size", p).alias("blocks")), "groups")
        members = written(rows.join(groups, "band").select("band", "blocks", "doc_id", "d1", "n_shingles"), "members")
        involved = members.select("doc_id").distinct()
        sets = source.join(involved.hint("merge"), "doc_id", "left_semi").mapInArrow(lean(set_maker(p)), SET).dropDuplicates(["doc_id", "d1"])
        near = written(reps.select("doc_id", "d1", "n_shingles", "compared").join(sets, ["doc_id", "d1"]), "near")

        first = _first_links(members, near, p)
        labels = written(components(first), "labels")
        links = first.union(_other_links(members, reps, near, labels, p))
        labels = written(components(links), "labels")
        scope.keep(sketches, classes, labels)
    component = classes.join(labels, classes.rep == labels.node, "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", *key).join(component, key, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
