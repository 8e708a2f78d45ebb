"""Exact token ids and counts of whole texts, encoding each distinct word once in a Python worker.

Neither tokenizer lets a token reach across the places where texts are cut here (see the two classes), so a text's
ids are those of its words one after another. Words are found by hash; the libraries encode the words not seen yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tallyspark.llm.text import SPACE, blocks, byte_hashes, row_sums, word_bounds
from tallyspark.llm.worker import kept

#: Bytes of words and ids that a worker remembers at most; beyond it starts anew.
MEMO_BYTES = 1 << 25


class Memo:
    """What encode gave for each word: a number of ids, and the ids."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype=np.uint16):
        """encode: gives for words their starts and lens in a third array, of ids (which stays empty where only lens count)."""
        self.encode, self.dtype = encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lens = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=self.dtype)
        self.used = 0

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its place in starts and lens."""
        if self.keys.nbytes + self.starts.nbytes + self.lens.nbytes + self.flat.nbytes > MEMO_BYTES:
            self._clear()
        hashes, first, inverse = np.unique(byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = buf.tobytes()
            new_starts, lens, ids = self.encode([data[starts[i] : ends[i]] for i in first[fresh]])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 2 + 2 * len(ids), dtype=self.dtype)])
            self.flat[self.used : self.used + len(ids)] = ids
            new_starts = new_starts + self.used
            self.used += len(ids)
            where = at[fresh]
            self.starts = np.insert(self.starts, where, new_starts)
            self.lens = np.insert(self.lens, where, lens)
            self.keys = np.insert(self.keys, where, hashes[fresh])
            at = np.searchsorted(self.keys, hashes)
        return at[inverse]

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        lens = self.lens[at].astype(np.int64)
        total = np.cumsum(lens)
        if not len(total):
            return self.flat[:0]
        return self.flat[np.repeat(self.starts[at] - total + lens, lens) + np.arange(total[-1])]


class WordBPE:
    """Ids of the tokenizers library for a file like word_bpe_49k.json.

    Its normalizer and its splitting pattern put no token across white space, and 0x20 and 0x09-0x0D are white space,
    so a text's ids are those of its words; nor across the place between a letter and a full stop or comma. Words of plain Latin letters and common marks are lowered and split here
    and go to the library's own model without its slow normalizer; all others go to the library as they are.
    """

    PLAIN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9.,;:!?()\-|#%&*$\"@=+/_\n]*"
    PART = r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
    GROUP = 256

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.fast = Tokenizer.from_file(path)
        self.fast.normalizer = None
        self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain, self.parts = regex.compile(self.PLAIN).fullmatch, regex.compile(self.PART).findall
        size = self.whole.get_vocab_size(with_added_tokens=True)
        #: The last token of each part, and no other, has the model's mark of a word's end.
        self.closing = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.memo = Memo(self._encode, np.uint32 if size > 1 << 16 else np.uint16)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain, odd = [], []
        for g in range(0, len(words), self.GROUP):
            texts = b"\n".join(words[g : g + self.GROUP]).decode("utf-8").split("\n")
            if self.plain("\n".join(texts)):
                plain += zip(range(g, g + len(texts)), texts)
            else:
                for i, t in enumerate(texts, g):
                    (plain if self.plain(t) else odd).append((i, t))
        joined, n_parts = [], []
        for g in range(0, len(plain), self.GROUP):
            parts = []
            for _, t in plain[g : g + self.GROUP]:
                own = [t.lower()] if t.isalpha() else self.parts(t.lower())
                parts += own
                n_parts.append(len(own))
            joined.append(" ".join(parts))
        ids = [np.array(e.ids, dtype=np.int64) for e in self.fast.encode_batch_fast(joined, add_special_tokens=False)]
        rest = [np.array(e.ids, dtype=np.int64) for e in self.whole.encode_batch_fast([t for _, t in odd], add_special_tokens=False)]
        flat = np.concatenate([*ids, *rest, np.zeros(0, dtype=np.int64)])
        part_ends = np.flatnonzero(self.closing[flat[: sum(map(len, ids))]]) + 1
        if len(part_ends) != sum(n_parts):
            raise ValueError("this tokenizer does not mark the ends of words")
        word_ends = part_ends[np.cumsum(n_parts) - 1] if n_parts else part_ends
        at = np.concatenate([[0], word_ends, (word_ends[-1] if n_parts else 0) + np.cumsum([len(x) for x in rest])]).astype(np.int64)
        order = np.array([i for i, _ in plain + odd], dtype=np.int64)
        starts, lens = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int32)
        starts[order], lens[order] = at[:-1], np.diff(at)
        return starts, lens, flat

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of rows one after another, number of ids by row) of whole rows, in order; a null is an empty text."""
        held: list[np.ndarray] = []
        for block in blocks(column):
            starts, ends, before = word_bounds(block.buf, block.bounds, marks=True)
            at = self.memo.find(block.buf, starts, ends)
            ids = self.memo.ids(at)
            if block.begins and block.ends:
                yield block.first, ids, row_sums(self.memo.lens[at].astype(np.int64), before)
                continue
            held.append(ids)
            if block.ends:
                whole = np.concatenate(held)
                held = []
                yield block.first, whole, np.array([len(whole)])


class PieceCounts:
    """Numbers of tokens of the sentencepiece library for a file like piece_bpe_32k.model.

    A space becomes a mark with which pieces begin, and no piece has the mark after another character; so nothing
    reaches across a space that follows a non-space, and what lies between two such places is encoded alone, its first
    space given by the library's own leading mark. Texts that hold the mark's character itself go to the library whole.
    """

    MARK = "▁".encode()

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode("a  b", out_type=str)[-1] != "▁b":
            raise ValueError("this model joins words; its texts have no safe boundaries at spaces")
        self.memo = Memo(self._encode)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = [len(x) for x in self.model.encode([w.decode("utf-8") for w in words], num_threads=1)]
        return np.zeros(len(lens), dtype=np.int64), np.array(lens, dtype=np.int32), self.memo.flat[:0]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row; a null is an empty text."""
        out = np.zeros(len(column), dtype=np.int64)
        for block in blocks(column):
            buf, bounds = block.buf, block.bounds
            blank = np.ones(len(buf) + 1, dtype=bool)
            blank[1:] = buf == 0x20
            cut = blank[1:] & ~blank[:-1]
            first = bounds[:-1][np.diff(bounds) > 0]
            cut[first] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(buf))
            begin = np.zeros(len(buf) + 1, dtype=bool)
            begin[first[0 if block.begins else 1 :]] = True
            starts = np.where(begin[starts], starts, starts + 1)  # the space that the library's leading mark stands for
            lone = starts == ends
            at = self.memo.find(buf, starts[~lone], ends[~lone])
            each = np.ones(len(starts), dtype=np.int64)
            each[~lone] = self.memo.lens[at]
            units = np.searchsorted(np.flatnonzero(cut), bounds)
            out[block.first : block.first + len(bounds) - 1] += row_sums(each, units)
        marked = [i for i, has in enumerate(pa.compute.match_substring(column, "▁").to_pylist()) if has]
        for i in marked:
            out[i] = len(self.model.encode(column[i].as_py()))
        return out


def made(kind: type, path: str):
    """One object for each file in a Python worker, kept from task to task until another one is needed."""
    return kept((kind, path), lambda: kind(path))
