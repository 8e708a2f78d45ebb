"""Static range asymmetric numeral system for token ids, vectorised over lanes and blocks, and its file format.

A block holds LANES * steps ids, the id at i in lane i % LANES. All lanes of a block share one stream of 24-bit words;
states lie in [2**28, 2**52), where a quotient of doubles, cut to an integer, is exact.
Each INTERVAL steps a checkpoint keeps the lanes' states and the place in the stream, so that a block's parts decode at
the same time. Frequencies, of 2**PRECISION in all, are shared by all files of a table.

Frequencies: TABLE; zlib of one little-endian unsigned 32-bit number for each id from 0.
File: HEAD; blocks (BLOCK, checkpoints, words); index (zlib: doc_ids, their validity, their numbers of ids, block offsets); TAIL.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

LANES, STEPS, INTERVAL, PRECISION = 32, 1024, 256, 20
HEAD = struct.Struct("<4sHHIII")  # magic, version, precision, lanes, interval, crc32 of the frequencies
BLOCK = struct.Struct("<IIIII")  # ids, steps, words, crc32 of ids, crc32 of checkpoints and words
TAIL = struct.Struct("<QIII4s")  # ids of the file, bytes and crc32 of the index, blocks, magic
TABLE = struct.Struct("<4sHHII")  # magic, version, precision, ids, crc32 of the frequencies
TABLE_MAGIC = b"TRNF"
MAGIC, VERSION, LOW, WORD = b"TRNS", 1, 1 << 28, 24
#: Blocks encoded or decoded at once.
WIDE = 64


class Model:
    """Frequencies that sum to 2**PRECISION; each id that occurs has one of at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        total = 1 << PRECISION
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), dtype=np.int64)
        if len(used):
            if len(used) > total:
                raise ValueError("more different ids than the precision allows")
            share = counts[used].astype(np.float64) / counts[used].sum() * (total - len(used))
            freq[used] = 1 + np.floor(share).astype(np.int64)
            freq[used[np.argmax(counts[used])]] += total - int(freq.sum())
        return cls(freq)

    def table(self) -> bytes:
        return TABLE.pack(TABLE_MAGIC, VERSION, PRECISION, len(self.freq), self.crc) + zlib.compress(self.freq.astype("<u4").tobytes(), 1)

    @classmethod
    def of_table(cls, data: bytes) -> Model:
        """The model of table(); a damaged one raises."""
        try:
            head, body = TABLE.unpack_from(data), zlib.decompress(data[TABLE.size :])
        except (struct.error, zlib.error) as error:
            raise ValueError("the frequencies of token ids are damaged") from error
        if head != (TABLE_MAGIC, VERSION, PRECISION, len(body) // 4, zlib.crc32(body)):
            raise ValueError("the frequencies of token ids are damaged")
        return cls(np.frombuffer(body, "<u4"))

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)
        return self._symbol


def encode(model: Model, ids: np.ndarray, steps: int) -> Iterator[bytes]:
    """The blocks of ids, each of LANES * steps of them; of the last one's, missing ids count as the most frequent one."""
    size = LANES * steps
    n_blocks = -(-len(ids) // size)
    grid = np.full(n_blocks * size, int(np.argmax(model.freq)), dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    x = np.full(n_blocks * LANES, LOW, dtype=np.int64)
    words = np.zeros((steps, len(x)), dtype="<u4")
    given = np.zeros((steps, len(x)), dtype=bool)
    states = []
    for t in range(steps - 1, -1, -1):
        f = model.freq.take(grid[t])
        out = np.greater_equal(x, f << 32, out=given[t])
        words[t] = x & 0xFFFFFF
        x >>= out * np.int64(WORD)
        x += (x / f).astype(np.int64) * ((1 << PRECISION) - f) + model.start.take(grid[t])
        if t % INTERVAL == 0:
            states.append(x.reshape(n_blocks, LANES).copy())
    states.reverse()
    words, given = words.reshape(steps, n_blocks, LANES), given.reshape(steps, n_blocks, LANES)
    for b in range(n_blocks):
        own, mask = words[:, b], given[:, b]
        stream = own[mask].view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        places = np.append(0, np.cumsum(mask.sum(axis=1)))[:-1:INTERVAL].astype("<u4")
        part = np.asarray(ids[b * size : (b + 1) * size]).astype("<u4")
        body = places.tobytes() + b"".join(s[b].astype("<i8").tobytes() for s in states) + stream
        yield BLOCK.pack(len(part), steps, len(stream) // 3, zlib.crc32(part.tobytes()), zlib.crc32(body)) + body


def decode(model: Model, blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks of one number of steps, all parts between checkpoints at once; a wrong checksum raises."""
    places, states, streams, heads, base = [], [], [], [], 0
    steps = BLOCK.unpack_from(blocks[0])[1]
    n_parts = -(-steps // INTERVAL)
    for block in blocks:
        n, own_steps, n_words, ids_crc, body_crc = BLOCK.unpack_from(block)
        at = BLOCK.size
        places.append(np.frombuffer(block, "<u4", n_parts, at).astype(np.int64) + base)
        at += 4 * n_parts
        states.append(np.frombuffer(block, "<i8", n_parts * LANES, at).reshape(n_parts, LANES))
        at += 8 * n_parts * LANES
        if own_steps != steps or len(block) != at + 3 * n_words or zlib.crc32(block[BLOCK.size :]) != body_crc:
            raise ValueError("a block of token ids is damaged")
        streams.append(np.frombuffer(block, np.uint8, 3 * n_words, at))
        heads.append((n, ids_crc))
        base += n_words
    stream = np.zeros((base, 4), dtype=np.uint8)
    stream[:, :3] = np.concatenate(streams).reshape(-1, 3)
    stream = stream.view("<u4").ravel().astype(np.int64)
    full = np.tile(np.minimum(INTERVAL, steps - np.arange(n_parts) * INTERVAL), len(blocks))
    x, p = np.concatenate(states), np.concatenate(places)
    out = np.zeros((int(full.max()), *x.shape), dtype="<u4")
    for t in range(len(out)):
        if t == full.min() and full.min() < full.max():  # the last parts of blocks are shorter: only the others go on
            keep = np.flatnonzero(full > t)
            x, p, target = x[keep], p[keep], np.zeros((len(out), len(keep), LANES), dtype="<u4")
            kept, out_long = keep, target
        slot = x & ((1 << PRECISION) - 1)
        s = model.symbol.take(slot)
        if len(x) == len(full):
            out[t] = s
        else:
            out_long[t] = s
        x = model.freq.take(s) * (x >> PRECISION) + slot - model.start.take(s)
        lack = np.flatnonzero(x < LOW)
        row = lack // LANES
        n_lack = np.bincount(row, minlength=len(x))
        first = np.cumsum(n_lack) - n_lack
        flat = x.ravel()
        flat[lack] = (flat[lack] << WORD) | stream[p[row] + np.arange(len(lack)) - first[row]]
        p = p + n_lack
    if len(x) < len(full):
        out[full.min() :, kept] = out_long[full.min() :]
    found = []
    for b, (n, crc) in enumerate(heads):
        parts = [out[: full[i], i].reshape(-1) for i in range(b * n_parts, (b + 1) * n_parts)]
        ids = np.concatenate(parts)[:n].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("decoded token ids do not match their checksum")
        found.append(ids)
    return found


class Writer:
    """Writes one file to an open stream: add() takes a document's ids, close() the rest."""

    def __init__(self, stream, model: Model):
        self.stream, self.model = stream, model
        self.docs, self.lens, self.offsets, self.held, self.n_held, self.n_ids = [], [], [], [], 0, 0
        self.at = 0
        self._put(HEAD.pack(MAGIC, VERSION, PRECISION, LANES, INTERVAL, model.crc))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lens.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= WIDE * LANES * STEPS:
            ids = np.concatenate(self.held)
            whole = len(ids) // (LANES * STEPS) * LANES * STEPS
            for first in range(0, whole, WIDE * LANES * STEPS):
                self._encode(ids[first : min(whole, first + WIDE * LANES * STEPS)], STEPS)
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _encode(self, ids: np.ndarray, steps: int) -> None:
        for block in encode(self.model, ids, steps):
            self.offsets.append(self.at)
            self._put(block)

    def close(self) -> dict:
        ids = np.concatenate([*self.held, np.zeros(0, dtype=np.uint32)])
        whole = len(ids) // (LANES * STEPS) * LANES * STEPS
        if whole:
            self._encode(ids[:whole], STEPS)
        if whole < len(ids):
            self._encode(ids[whole:], -(-(len(ids) - whole) // LANES))
        docs = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        valid = np.array([d is not None for d in self.docs], dtype=np.uint8)
        index = zlib.compress(struct.pack("<Q", len(docs)) + docs.tobytes() + valid.tobytes() + np.array(self.lens, dtype="<i8").tobytes() + np.array([*self.offsets, self.at], dtype="<u8").tobytes(), 1)
        self._put(index)
        self._put(TAIL.pack(self.n_ids, len(index), zlib.crc32(index), len(self.offsets), MAGIC))
        return {"docs": len(docs), "ids": self.n_ids, "bytes": self.at}


def read_file(file, model: Model) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of one open, seekable file, in order."""
    size = file.size()
    file.seek(size - TAIL.size)
    n_ids, n_index, crc, n_blocks, magic = TAIL.unpack(file.read(TAIL.size))
    file.seek(size - TAIL.size - n_index)
    index = file.read(n_index)
    file.seek(0)
    head = HEAD.unpack(file.read(HEAD.size))
    if magic != MAGIC or zlib.crc32(index) != crc or head != (MAGIC, VERSION, PRECISION, LANES, INTERVAL, model.crc):
        raise ValueError("this is no whole file of token ids, or not of these frequencies")
    index = zlib.decompress(index)
    n = struct.unpack_from("<Q", index)[0]
    docs = np.frombuffer(index, "<i8", n, 8)
    valid = np.frombuffer(index, np.uint8, n, 8 + 8 * n)
    lens = np.frombuffer(index, "<i8", n, 8 + 9 * n)
    offsets = np.frombuffer(index, "<u8", n_blocks + 1, 8 + 17 * n).astype(np.int64)
    held, n_held, block = [], 0, 0
    for i in range(n):
        while n_held < lens[i]:
            last = min(n_blocks, block + WIDE)
            file.seek(int(offsets[block]))
            data = file.read(int(offsets[last] - offsets[block]))
            cells = [data[a - offsets[block] : b - offsets[block]] for a, b in zip(offsets[block:last], offsets[block + 1 : last + 1])]
            even = [c for c in cells if BLOCK.unpack_from(c)[1] == STEPS]
            got = (decode(model, even) if even else []) + [decode(model, [c])[0] for c in cells[len(even) :]]
            held = [np.concatenate([*held, *got])]
            n_held, block = len(held[0]), last
        whole = held[0] if held else np.zeros(0, dtype="<u4")
        yield (int(docs[i]) if valid[i] else None), whole[: lens[i]]
        held, n_held = [whole[lens[i] :]], n_held - int(lens[i])
