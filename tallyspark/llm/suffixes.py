"""Suffix-array dedup: the suffixes of each shard, merged with those of all others by refining their interleave, give repeated intervals; bytes of strings that also start earlier go.

Which suffixes: a text is cut at anchors, the places of the leftmost smallest hash of 8 bytes in each window of half the length. Every string of
`length` bytes holds the anchor of its first window, whatever stands around it. A shard's transform is kept in inverse form, as the block in the
merged order of each of its anchored suffixes in text order, so that the step from a suffix to the one that begins an anchor earlier is a step to the left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import Passing, bucketed, dropped, written
from tallyspark.llm.shards import cells, named_groups, rows_of, text_shards, texts_of, unpacked
from tallyspark.llm.text import byte_hashes, byte_spans, mixed
from tallyspark.llm.worker import lean


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a string that counts (4 at least); shard: bytes of text of a shard; strip: bytes worked on at once; few: rounds end
    when only this part of the suffixes is neither settled nor alone, whose strings are then compared one by one."""

    length: int = 100
    shard: int = 1 << 23
    strip: int = 1 << 19
    few: float = 0.01

    @property
    def window(self) -> int:
        return self.length // 2

    @property
    def symbol(self) -> int:
        """Bytes behind an anchor that its first symbol tells: as many as any string with this anchor has, and no fewer than lie between two anchors."""
        return self.length + 1 - self.window


#: Symbols of a text's first and last bytes, where no window puts an anchor, are others than those of the same bytes elsewhere.
EDGES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _slide(values: np.ndarray, width: int, what: np.ufunc) -> np.ndarray:
    """what (minimum or maximum) of each `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values, size = what(values[:-size], values[size:]), 2 * size
    return what(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(buf: np.ndarray, bounds: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all texts in order, their symbols, and first and last start (low > high: none) of the strings of which each is the anchor."""
    w, gram, found = p.window, min(8, p.symbol), []
    fits = np.zeros(len(buf) + 1, dtype=np.int8)
    long_ones = np.flatnonzero(np.diff(bounds) >= p.length)
    heads, tails = bounds[long_ones], bounds[long_ones + 1]
    np.add.at(fits, heads, 1)
    np.add.at(fits, tails - p.length + 1, -1)
    fits = np.cumsum(fits[:-1], dtype=np.int8).astype(bool)
    for x in range(0, len(buf), p.strip):
        seg, fit = buf[x : x + p.strip + p.length - 1], fits[x : x + p.strip]
        if not fit.any():
            continue
        spans = byte_spans(seg)
        grams = (spans.total[gram:] - spans.total[:-gram]) * spans.back[: len(seg) - gram + 1]
        key = (mixed(grams) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = _slide(key, w, np.minimum)[: len(fit)].copy()
        low[~fit[: len(low)]] = 0
        # Starts of which the leftmost smallest hash is the same stand in a row: it changes where another value is the smallest, or the place itself has left the window.
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (key[: len(low) - 1] == low[:-1])))
        last = np.append(first[1:], len(low)) - 1
        some = low[first] > 0
        first, last = first[some], last[some]
        came = (first > 0) & (low[first] < low[first - 1])
        at = np.where(came, first + w - 1, last)
        inside = np.flatnonzero(~came & (key[last] != low[last]))
        at[inside] = first[inside] + np.argmax(key[first[inside, None] + np.arange(w)] == low[first[inside], None], axis=1)
        first, last = first + x, last + x
        found.append((at + x, spans.hashes(at, at + p.symbol), first, last))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, key, first, last = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(at, kind="stable")
    at, key, first, last = at[order], key[order], first[order], last[order]
    one = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # strips share anchors
    at, key, first, last = at[one], key[one], np.minimum.reduceat(first, one), np.maximum.reduceat(last, one)
    for places, mark in zip((heads, tails - p.symbol), EDGES):
        places = places[at[np.searchsorted(at, places).clip(max=len(at) - 1)] != places]
        flat = buf[(places[:, None] + np.arange(p.symbol)).ravel()]
        starts = np.arange(len(places)) * p.symbol
        symbols = mixed(byte_hashes(flat, starts, starts + p.symbol) ^ mark) if len(places) else np.zeros(0, np.uint64)
        at, key = np.append(at, places), np.append(key, symbols)
        first, last = np.append(first, places + 1), np.append(last, places)
        order = np.argsort(at, kind="stable")
        at, key, first, last = at[order], key[order], first[order], last[order]
    return at, key, first, last


ANCHORS = "shard long, ids binary, none binary, bounds binary, at binary, key binary, low binary, high binary"


def _anchored(p: Repeats):
    """Each shard's anchors, found once: places (as differences), symbols, and the distances back to the first and last strings of which each is the anchor (low, high; no such string: 0 and 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                at, key, first, last = anchors(*unpacked(row), p)
                some = first <= last
                found = cells(at=np.diff(at, prepend=0).astype("<i4"), key=key.astype("<u8"), low=np.where(some, at - first, 0).astype("<u1"), high=np.where(some, at - last, 255).astype("<u1"))
                kept = {c: row[c] for c in ("shard", "ids", "none", "bounds")}
                yield pa.RecordBatch.from_pylist([kept | found], schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("ids", "none", "bounds", *found)]]))

    return run


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's sorted distinct symbols."""
    for batch in batches:
        for row in rows_of(batch):
            keys, n = np.unique(np.frombuffer(row["key"], "<u8"), return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.full(len(keys), row["shard"])), pa.array(np.arange(len(keys)))], names=["key", "n", "shard", "k"])


#: A shard's state: for each suffix whose first symbol is repeated its place, number among the shard's anchors, text, first block, block (-1: no other suffix is
#: alike any more), bytes that its block shares (depth) and needs to share for all strings up to the next anchor (need), and where the strings of its anchor
#: start; whether those strings start earlier too (hit), are still open, and are to be compared one by one.
STATE = {"at": "<i4", "ord": "<i4", "origin": "<i8", "block": "<i8", "depth": "<i4", "need": "<i4", "low": "<u1", "high": "<u1", "hit": "<u1", "open": "<u1", "compare": "<u1", "ids": "<i8", "none": "<u1", "bounds": "<i8"}
STATES = "shard long, suffixes long, active long, " + ", ".join(f"{c} binary" for c in STATE)
_SCHEMA = pa.schema([("shard", pa.int64()), ("suffixes", pa.int64()), ("active", pa.int64()), *[(c, pa.binary()) for c in STATE]])


def _row(shard: int, arrays: dict[str, np.ndarray]) -> pa.Table:
    """A state as a row; places are kept as differences, which take little room."""
    active = int(((arrays["block"] >= 0) & (arrays["depth"] < arrays["need"])).sum())
    arrays = {c: np.diff(a, prepend=0) if c in ("at", "ord", "bounds") else a for c, a in arrays.items()}
    row = cells(**{c: arrays[c].astype(kind) for c, kind in STATE.items()})
    return pa.Table.from_pylist([row | {"shard": shard, "suffixes": len(arrays["at"]), "active": active}], schema=_SCHEMA)


class State:
    """A shard's state as arrays."""

    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.__dict__.update({c: np.frombuffer(row[c], kind) for c, kind in STATE.items()})
        self.at, self.ord, self.bounds = np.cumsum(self.at), np.cumsum(self.ord), np.cumsum(self.bounds)
        self.text = np.searchsorted(self.bounds, self.at, side="right") - 1

    def row(self, **new: np.ndarray) -> pa.Table:
        return _row(self.shard, {c: getattr(self, c) for c in STATE} | new)

    def settled(self) -> np.ndarray:
        return (self.block >= 0) & (self.need > 0) & (self.depth >= self.need)

    def ordered(self, places: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The order of places by whether the id is null, id and place."""
        return np.lexsort((places, self.ids[text], self.none[text]))

    def position(self, text: np.ndarray) -> list[pa.Array]:
        return [pa.array(self.none[text].astype(bool)), pa.array(self.ids[text]), pa.array(np.full(len(text), self.shard))]

    def windows(self, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of the strings that begin before the next anchor."""
        return self.at, np.where(self.need > 0, self.at + self.need - p.length + 1, self.at)

    def hits_before(self, places: np.ndarray, p: Repeats) -> np.ndarray:
        """Strings that start before these places and are known to start earlier too."""
        start, end = (x[self.hit > 0] for x in self.windows(p))
        total = np.append(0, np.cumsum(end - start))
        i = np.searchsorted(start, places, side="right")
        inside = np.minimum(places, end[np.maximum(i - 1, 0)]) - start[np.maximum(i - 1, 0)] if len(start) else np.zeros(len(places), np.int64)
        return np.where(i > 0, total[np.maximum(i - 1, 0)] + inside, 0)

    def pairs(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that are to be refined by the block of the one `step` anchors behind, that one, and the distinct (block, distance, block) of each as a number."""
        n = len(self.at)
        to = np.minimum(np.searchsorted(self.ord, self.ord + step), max(0, n - 1))
        fine = (self.block >= 0) & (self.depth < self.need)
        if n:
            fine &= (self.ord[to] == self.ord + step) & (self.text[to] == self.text) & (self.block[to] >= 0)
        who = np.flatnonzero(fine)
        return who, to[who], self.at[to[who]] - self.at[who]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct tuple, and for each row the number of its tuple."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _names(rows: pa.Table, size: int) -> np.ndarray:
    """By k the name, or -1."""
    out = np.full(size, -1, dtype=np.int64)
    out[rows.column("k").to_numpy()] = rows.column("name").to_numpy()
    return out


def _begun(p: Repeats):
    """States from the anchors of a shard and the names of its repeated symbols."""

    def run(_, found: pa.Table, names: pa.Table) -> pa.Table:
        row = next(rows_of(found))
        at, key, low, high = (np.frombuffer(row[c], kind) for c, kind in (("at", "<i4"), ("key", "<u8"), ("low", "<u1"), ("high", "<u1")))
        at, bounds = np.cumsum(at, dtype=np.int64), np.frombuffer(row["bounds"], "<i8")
        symbols, k = np.unique(key, return_inverse=True)
        block = _names(names, len(symbols))[k]
        text = np.searchsorted(bounds, at, side="right") - 1
        after = np.append(at[1:], bounds[-1])
        end = np.minimum(after, bounds[text + 1] - p.length + 1)
        need = np.where(end > at, end - 1 - at + p.length, 0)
        keep = np.flatnonzero(block >= 0)
        arrays = {"at": at, "ord": np.arange(len(at)), "origin": block, "block": block, "depth": np.full(len(at), p.symbol), "need": need, "low": low, "high": high, **{c: np.zeros(len(at)) for c in ("hit", "open", "compare")}}
        texts = {"ids": np.frombuffer(row["ids"], "<i8"), "none": np.frombuffer(row["none"], "<u1"), "bounds": bounds}
        return _row(row["shard"], {c: a[keep] for c, a in arrays.items()} | texts)

    return run


def _pairs(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in map(State, rows_of(batch)):
                who, to, gap = state.pairs(step)
                some, number = _distinct(state.block[who], gap, state.block[to])
                columns = [state.block[who][some], gap[some], state.block[to][some], np.bincount(number, minlength=len(some)), np.full(len(some), state.shard), np.arange(len(some))]
                yield pa.record_batch([pa.array(c) for c in columns], names=["block", "gap", "next", "n", "shard", "k"])

    return run


def _refined(step: int):
    """A round: suffixes get the names of their pairs; those of which no other is alike leave."""

    def run(_, states: pa.Table, names: pa.Table) -> pa.Table:
        state = State(next(rows_of(states)))
        who, to, gap = state.pairs(step)
        some, number = _distinct(state.block[who], gap, state.block[to])
        block = np.where((state.block >= 0) & (state.depth < state.need), -1, state.block)
        block[who] = _names(names, len(some))[number]
        depth = state.depth.copy()
        depth[who] = gap + state.depth[to]
        return state.row(block=block, depth=depth)

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first suffix of each block in each shard."""
    for batch in batches:
        for state in map(State, rows_of(batch)):
            mine = np.flatnonzero(state.settled())
            mine = mine[state.ordered(state.at[mine], state.text[mine])]
            blocks, first, n = np.unique(state.block[mine], return_index=True, return_counts=True)
            who = mine[first]
            yield pa.record_batch([pa.array(blocks), pa.array(n), *state.position(state.text[who]), pa.array(state.at[who])], names=["block", "n", "none", "id", "shard", "k"])


def _hits(p: Repeats):
    """Suffixes of a repeated block but its first; anchors of which some string is still open."""

    def run(_, states: pa.Table, names: pa.Table) -> pa.Table:
        state = State(next(rows_of(states)))
        own = names.column("k").to_numpy()
        firsts = own[names.column("first").to_numpy(zero_copy_only=False)]
        repeated = state.block[np.searchsorted(state.at, own)]  # blocks of which another settled suffix stands here or elsewhere
        hit = state.settled() & np.isin(state.block, repeated) & ~np.isin(state.at, firsts)
        state.hit = hit.astype(np.uint8)
        low, high = state.at - state.low, state.at - state.high
        some = state.high < 255
        inside = state.hits_before(high + 1, p) - state.hits_before(low, p)
        return state.row(open=some & (inside < high - low + 1))

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for state in map(State, rows_of(batch)):
            origins, n = np.unique(state.origin[state.open > 0], return_counts=True)
            yield pa.record_batch([pa.array(origins), pa.array(n), pa.array(np.full(len(origins), state.shard)), pa.array(origins)], names=["origin", "n", "shard", "k"])


def _compared(_, states: pa.Table, names: pa.Table) -> pa.Table:
    state = State(next(rows_of(states)))
    return state.row(compare=(state.open > 0) & np.isin(state.origin, names.column("k").to_numpy()))


def _strings(row: dict, p: Repeats) -> tuple[State, np.ndarray, np.ndarray, np.ndarray]:
    """The open strings that are compared one by one: start, group number, and the first of each group."""
    state = State(row)
    buf = texts_of(row["data"], state.bounds)
    who = np.flatnonzero(state.compare)
    at = state.at[who]
    low, size = at - state.low[who], state.low[who].astype(np.int64) - state.high[who] + 1
    start = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    anchor = np.repeat(who, size)
    free = state.hits_before(start + 1, p) == state.hits_before(start, p)
    start, anchor = start[free], anchor[free]
    order = np.argsort(start, kind="stable")
    start, anchor = start[order], anchor[order]
    hashes = np.zeros(len(start), dtype=np.uint64)
    for x in range(0, len(buf), p.strip):
        a, b = np.searchsorted(start, (x, x + p.strip))
        if a < b:
            own = start[a:b] - x
            hashes[a:b] = byte_hashes(buf[x : x + p.strip + p.length], own, own + p.length)
    order = state.ordered(start, state.text[anchor])
    start, anchor, hashes = start[order], anchor[order], hashes[order].view(np.int64)
    some, number = _distinct(state.origin[anchor], hashes)
    return state, start, number, np.stack([some, state.origin[anchor[some]], hashes[some], state.text[anchor[some]]]) if len(some) else np.zeros((4, 0), np.int64)


def _emitted(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                state, start, number, (some, origin, hashes, text) = _strings(row, p)
                columns = [pa.array(origin), pa.array(hashes), pa.array(np.bincount(number, minlength=len(some))), *state.position(text), pa.array(start[some])]
                yield pa.record_batch(columns, names=["origin", "hash", "n", "none", "id", "shard", "k"])

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cleaned(p: Repeats):
    def run(_, texts: pa.Table, names: pa.Table) -> pa.Table:
        row = next(rows_of(texts))
        state, start, number, (some, *_) = _strings(row, p)
        bounds = state.bounds
        buf = texts_of(row["data"], bounds)
        verdict = np.zeros(len(some), dtype=np.int8)  # 1: starts first here, 2: elsewhere
        order = np.argsort(start[some])
        who = order[np.searchsorted(start[some], names.column("k").to_numpy(), sorter=order)]
        verdict[who] = np.where(names.column("first").to_numpy(zero_copy_only=False), 1, 2)
        gone = verdict[number] > 0
        gone[some[verdict == 1]] = False
        begin, end = (x[state.hit > 0] for x in state.windows(p))
        edge = np.zeros(len(buf) + 1, dtype=np.int32)
        np.add.at(edge, np.append(begin, start[gone]), 1)
        np.add.at(edge, np.append(end - 1, start[gone]) + p.length, -1)
        out = np.cumsum(edge[:-1]) > 0
        rise = out.copy()
        rise[1:] &= ~out[:-1]
        heads = bounds[:-1][np.diff(bounds) > 0]
        rise[heads] = out[heads]
        counts = [np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (out, rise)]
        sizes = np.diff(bounds)
        kept = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes - counts[0])).astype(np.int64)), pa.py_buffer(buf[~out].tobytes())]).cast(pa.binary())
        ids = pa.array(state.ids, mask=state.none.astype(bool))
        return pa.table([ids, pa.array(sizes), pa.array(counts[0]), pa.array(counts[1]), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _met(left: DataFrame, names: DataFrame, run, schema: str) -> DataFrame:
    return left.groupBy("shard").cogroup(names.groupBy("shard")).applyInArrow(run, schema)


def merged_blocks(texts: DataFrame, p: Repeats) -> DataFrame:
    """States of all shards in which every suffix with block >= 0 shares `depth` >= `need` bytes with the others of its block, and no other suffix is alike.

    The first round interleaves the shards' sorted symbols (`symbol` bytes behind an anchor). Each further round refines blocks by the block of the suffix one anchor on
    (then two, then as many as the depth has, so that a text of one repeated letter takes a few rounds): shards send their distinct pairs of blocks with
    counts, those of a range are named by their places in order, and a suffix whose pair stands only once leaves. A suffix that shares all that it needs keeps its block.
    Only what still stands more than once is sorted, and no more than its pair of blocks.
    """
    found = bucketed(texts.mapInArrow(lean(_anchored(p)), ANCHORS), "shard", "anchors", dealt=True)
    symbols = found.select("shard", "key").mapInArrow(lean(_symbols), "key long, n long, shard long, k long")
    states, depth, step, number = bucketed(_met(found, named_groups(symbols, ["key"]), _begun(p), STATES), "shard", "begun", dealt=True), 1, 1, 1
    dropped(found)
    while True:
        size, active = states.agg(F.sum("suffixes"), F.sum("active")).first()
        if (active or 0) <= p.few * (size or 0):
            return states
        pairs = states.mapInArrow(lean(_pairs(step)), "block long, gap long, next long, n long, shard long, k long")
        names = named_groups(pairs, ["block", "gap", "next"], step=number)
        refined = bucketed(_met(states, names, _refined(step), STATES), "shard", "refined", dealt=True)
        dropped(states)
        states, depth = refined, depth + step
        step, number = (2 if depth < 6 else depth), number + 1


def without_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) for each row of docs (doc_id: long, text).

    A byte goes if some string of p.length bytes that covers it also starts earlier: in a row of smaller doc_id, or before it in the same row. Strings are
    judged on the texts as they come, may overlap, and never reach across texts. Rows without a doc_id come after all others; rows that share a doc_id are told apart, in the order in which
    they are read. A null text is empty, and texts shorter than p.length stay whole; an empty table gives no rows; other columns are ignored. What is kept need not be whole characters.

    Suffixes that begin at an anchor and share all strings up to the next one with an earlier suffix are found by merging the shards (merged_blocks). What is left are strings around the
    ends of repeats: of those whose anchor's symbol has open strings in two places at least, each is compared by symbol and hash.
    """
    with Passing() as scope:
        texts = text_shards(docs, p.shard)
        states = merged_blocks(texts, p)
        at = ["none", "id", "shard", "k"]
        settled = states.mapInArrow(lean(_settled), "block long, n long, none boolean, id long, shard long, k long")
        hits = bucketed(_met(states, named_groups(settled, ["block"], at), _hits(p), STATES), "shard", "hits", dealt=True)
        dropped(states)
        several = named_groups(hits.mapInArrow(lean(_open), "origin long, n long, shard long, k long"), ["origin"])
        states = bucketed(_met(hits, several, _compared, STATES), "shard", "compared", dealt=True)
        dropped(hits)
        both = texts.select("shard", "data").join(states, "shard")
        strings = both.mapInArrow(lean(_emitted(p)), "origin long, hash long, n long, none boolean, id long, shard long, k long")
        named = written(named_groups(strings, ["origin", "hash"], at), "strings")
        scope.keep(texts, states, named)
    return _met(both, named, _cleaned(p), OUT)
