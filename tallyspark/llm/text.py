"""Whole Arrow columns of text as byte arrays: blocks of bounded size, word bounds and 64-bit span hashes, all vectorised.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, that is `[^\\x20\\x09-\\x0D]+` of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is cut where a space follows a word.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord("."), ord(",")]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_VALUE = np.random.default_rng(7_919).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


class Spans:
    """Hashes of spans of values (uint64); equal spans have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _power("up", _BASE, len(values)), out=self.total[1:])
        self.back = _power("down", pow(_BASE, -1, 1 << 64), len(values) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.back[starts]
        return mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def byte_spans(buf: np.ndarray) -> Spans:
    return Spans(_BYTE_VALUE[buf])


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_spans(buf).hashes(starts, ends)


class Block(NamedTuple):
    """Rows first..first+len(bounds)-2 of a column; row i is buf[bounds[i]:bounds[i+1]]. begins, ends: whether the first row begins, the last row ends here."""

    first: int
    buf: np.ndarray
    bounds: np.ndarray
    begins: bool
    ends: bool


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and their bounds; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf, bounds


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, after: np.ndarray = ~SPACE) -> Iterator[Block]:
    """The column in blocks of about limit bytes: whole rows, or parts of one long row that are cut before a space that follows a byte of `after` (any non-space)."""
    if not len(column):
        return
    buf, bounds = column_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        if bounds[row + 1] - bounds[row] > limit:
            at, stop = int(bounds[row]), int(bounds[row + 1])
            while at < stop:
                cut = _cut(buf, at, stop, limit, after)
                yield Block(row, buf[at:cut], np.array([0, cut - at]), at == bounds[row], cut == stop)
                at = cut
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield Block(row, buf[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row], True, True)
        row = last


def _cut(buf: np.ndarray, at: int, stop: int, limit: int, after: np.ndarray) -> int:
    if stop - at <= limit:
        return stop
    window = buf[at + limit // 2 : at + limit]
    found = np.flatnonzero((window[1:] == 0x20) & after[window[:-1]])
    if len(found):
        return at + limit // 2 + int(found[-1]) + 1
    rest = buf[at + limit - 1 : stop]
    found = np.flatnonzero((rest[1:] == 0x20) & after[rest[:-1]])
    return at + limit + int(found[0]) if len(found) else stop


def word_bounds(buf: np.ndarray, bounds: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one entry more than rows).

    marks: cut words also before a full stop or comma that follows one of A-Z, a-z.
    """
    solid = np.zeros(len(buf) + 2, dtype=bool)
    solid[1:-1] = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    if marks:
        edge[1:-1] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends, np.searchsorted(starts, bounds)


def row_words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, for each row the words before it, one more than rows) of whole rows; a long row comes alone."""
    held: list[np.ndarray] = []
    for block in blocks(column):
        buf = LOWER[block.buf] if lower else block.buf
        starts, ends, before = word_bounds(buf, block.bounds)
        hashes = byte_hashes(buf, starts, ends)
        if block.begins and block.ends:
            yield block.first, hashes, before
            continue
        held.append(hashes)
        if block.ends:
            whole = np.concatenate(held)
            held = []
            yield block.first, whole, np.array([0, len(whole)])


def row_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of values by row, each row's from its own values alone; before as given by word_bounds."""
    out = np.zeros((len(before) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.diff(before) > 0
    if some.any():
        out[some] = np.add.reduceat(values[: before[-1]], before[:-1][some], axis=0)
    return out
