"""Language identification by unigram models over a fixed vocabulary, with all segmentations of a text summed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.scratch import small_table, written
from tallyspark.llm.text import blocks, byte_hashes, byte_spans, row_sums, word_bounds
from tallyspark.llm.worker import forget, kept, lean

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModels:
    """Parameters. documents: training documents for each language, about (a bounded sample by hash); rounds: of expectation-maximisation;
    longest_piece: bytes; part: bytes of the parts in which training takes a longer word (predictions take words whole); blend: weight of the uniform distribution."""

    vocabulary: str
    documents: int = 1000
    rounds: int = 3
    longest_piece: int = 16
    part: int = 48
    blend: float = 0.01


class Pieces:
    """The vocabulary's pieces as bytes, the mark of a word's begin as a space, and every single byte."""

    def __init__(self, path: str, longest: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        named = {model.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in ids}
        self.all = sorted({p for p in named if 0 < len(p) <= longest} | {bytes([b]) for b in range(256)})
        data = np.frombuffer(b"".join(self.all), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in self.all])
        hashes = byte_hashes(data, ends - np.array([len(p) for p in self.all]), ends)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.longest = longest

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1)


class Lattice:
    """All pieces within words, by end and length: for each pair the words (longest first) that have a piece there, and that piece."""

    def __init__(self, marked: list[bytes], pieces: Pieces):
        """marked: words, their begins marked by a space."""
        self.order = np.argsort([-len(w) for w in marked], kind="stable")
        self.lens = np.array([len(marked[i]) for i in self.order], dtype=np.int64)
        spans = byte_spans(np.frombuffer(b"".join(marked[i] for i in self.order), dtype=np.uint8))
        offset = np.cumsum(self.lens) - self.lens
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for end in range(1, int(self.lens[0]) + 1 if len(marked) else 1):
            n = int(np.searchsorted(-self.lens, -end, side="right"))
            for begin in range(max(0, end - pieces.longest), end):
                piece = pieces.find(spans.hashes(offset[:n] + begin, offset[:n] + end))
                has = np.flatnonzero(piece >= 0)
                if len(has):
                    self.arcs.append((begin, end, has, piece[has]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix: (position, word, language). p is (piece, language), scaled by SCALE for each byte of a piece."""
        alpha = np.zeros((int(self.lens[0]) + 1, len(self.lens), p.shape[1]))
        alpha[0] = 1
        for begin, end, has, piece in self.arcs:
            alpha[end, has] += alpha[begin, has] * p[piece]
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.lens, np.arange(len(self.lens))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected numbers of each piece in words that occur counts[word, language] times."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.lens, np.arange(len(self.lens))] = counts[self.order] / self.totals(alpha)
        out = np.zeros_like(p)
        for begin, end, has, piece in reversed(self.arcs):
            part = p[piece] * beta[end, has]
            beta[begin, has] += part
            part = part * alpha[begin, has]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, weights=part[:, k], minlength=len(p))
        return out


#: Keeps sums of products of small probabilities within doubles; the same for all languages.
SCALE = 256.0


def scaled(p: np.ndarray, pieces: Pieces) -> np.ndarray:
    return p * SCALE ** np.array([len(x) for x in pieces.all])[:, None]


def in_parts(word: bytes, longest: int) -> Iterator[bytes]:
    """A marked word in parts of at most `longest` bytes that begin and end with characters."""
    while len(word) > longest:
        stop = longest
        while stop > 1 and 0x80 <= word[stop] < 0xC0:
            stop -= 1
        yield word[:stop]
        word = word[stop:]
    yield word


def long_totals(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-likelihoods (word, language) of marked words of any length: the same sums with only the prefixes that a piece can reach, rescaled again and again."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    lens = np.array([len(words[i]) for i in order], dtype=np.int64)
    spans = byte_spans(np.frombuffer(b"".join(words[i] for i in order), dtype=np.uint8))
    offset, width = np.cumsum(lens) - lens, pieces.longest + 1
    alpha = np.zeros((width, len(lens), p.shape[1]))
    alpha[0], logs, out = 1, np.zeros((len(lens), p.shape[1])), np.zeros((len(lens), p.shape[1]))
    for end in range(1, int(lens[0]) + 1):
        n = int(np.searchsorted(-lens, -end, side="right"))
        now = np.zeros((n, p.shape[1]))
        for begin in range(max(0, end - pieces.longest), end):
            piece = pieces.find(spans.hashes(offset[:n] + begin, offset[:n] + end))
            has = np.flatnonzero(piece >= 0)
            if len(has):
                now[has] += alpha[begin % width, has] * p[piece[has]]
        alpha[end % width, :n] = now
        if end % pieces.longest == 0:
            most = alpha[:, :n].max(axis=0)
            alpha[:, :n] /= most
            logs[:n] += np.log(most)
            now = alpha[end % width, :n]
        done = lens[:n] == end
        out[:n][done] = np.log(now[done]) + logs[:n][done]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return (out - lens[:, None] * np.log(SCALE))[back]


class Scorer:
    """Log-likelihoods of words for each language, remembered in a worker up to a bound."""

    #: Bytes of what is remembered, and of a table of prefix sums; bytes of a word above which only a window of them is kept, which is rescaled; and the least
    #: power of ten that a product without rescaling may reach.
    MEMO, TABLE, LONG, LEAST = 1 << 25, 1 << 24, 48, -250

    def __init__(self, m: LanguageModels, pieces: Pieces, p: np.ndarray):
        self.m, self.pieces, self.p = m, pieces, scaled(p, pieces)
        least = self.p[[len(x) == 1 for x in pieces.all]].min() if self.p.size else 1.0
        #: A word of so many bytes cannot underflow even if each is a piece of its own.
        self.short = min(self.LONG, int(self.LEAST / np.log10(least)) if least < 1 else self.LONG)
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros((0, p.shape[1]))

    def score(self, marked: list[bytes]) -> np.ndarray:
        """Log-likelihoods of marked words."""
        out = np.zeros((len(marked), self.p.shape[1]))
        order = np.argsort([len(w) for w in marked], kind="stable")
        lens, at = np.array([len(marked[i]) for i in order], dtype=np.int64), 0
        short = int(np.searchsorted(lens, self.short, side="right"))
        fits = lambda n: max(1, self.TABLE // (8 * self.p.shape[1] * (n + 1)))
        while at < len(order):
            if at < short:
                stop = min(short, at + fits(lens[at]))
                stop = min(stop, at + fits(lens[stop - 1]))
                lattice = Lattice([marked[i] for i in order[at:stop]], self.pieces)
                out[order[at:stop][lattice.order]] = np.log(lattice.totals(lattice.forward(self.p))) - lattice.lens[:, None] * np.log(SCALE)
            else:
                stop = min(len(order), at + fits(self.pieces.longest))
                out[order[at:stop]] = long_totals([marked[i] for i in order[at:stop]], self.pieces, self.p)
            at = stop
        return out

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.keys.nbytes + self.values.nbytes > self.MEMO:
            self.keys, self.values = self.keys[:0], self.values[:0]
        hashes, first, inverse = np.unique(byte_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = buf.tobytes()
            values = self.score([b" " + data[starts[i] : ends[i]] for i in first[fresh]])
            self.keys = np.insert(self.keys, at[fresh], hashes[fresh])
            self.values = np.insert(self.values, at[fresh], values, axis=0)
            at = np.searchsorted(self.keys, hashes)
        return self.values[at[inverse]]

    def rows(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.p.shape[1]))
        for block in blocks(column):
            starts, ends, before = word_bounds(block.buf, block.bounds)
            out[block.first : block.first + len(block.bounds) - 1] += row_sums(self.words(block.buf, starts, ends), before)
        return out


def _words(m: LanguageModels):
    """lang, word, n of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                seen: dict[bytes, int] = {}
                for block in blocks(batch.column("text").filter(pc.equal(batch.column("lang"), lang))):
                    starts, ends, _ = word_bounds(block.buf, block.bounds)
                    data = block.buf.tobytes()
                    for a, b in zip(starts, ends):
                        for part in in_parts(b" " + data[a:b], m.part):
                            seen[part] = seen.get(part, 0) + 1
                yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return run


def _expect(m: LanguageModels, langs: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(m.vocabulary, m.longest_piece)
        total, q = np.zeros_like(p), scaled(p, pieces)
        place = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            step = max(1, Scorer.TABLE // (8 * len(langs) * (m.part + 1)))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                counts = np.zeros((len(part), len(langs)))
                counts[np.arange(len(part)), [place[x] for x in part.column("lang").to_pylist()]] = part.column("n").to_numpy()
                total += Lattice(part.column("word").to_pylist(), pieces).expected(q, counts)
        piece, lang = np.nonzero(total)
        yield pa.record_batch([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang_no", "n"])

    return run


def fit(docs: DataFrame, m: LanguageModels) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and (piece, language) probabilities, from text and non-null lang of docs; every value of lang that has a text is learned.

    The sample has about m.documents different texts of each language, those of smallest hash, each once, so it does not grow with
    the input; only languages and a number for each piece and language come to the driver.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    langs, pieces = sorted(sizes), Pieces(m.vocabulary, m.longest_piece)
    p = np.full((len(pieces.all), len(langs)), 1 / len(pieces.all))
    if not langs:
        return langs, p
    share = small_table(rows.sparkSession, [(lang, float(min(1.0, m.documents / sizes[lang]))) for lang in langs], pa.schema({"lang": pa.string(), "share": pa.float64()}))
    sample = rows.join(F.broadcast(share), "lang").where((F.xxhash64("text") / F.lit(2.0**64) + 0.5) < F.col("share")).select("lang", "text").distinct()
    words = sample.mapInArrow(lean(_words(m)), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    for _ in range(m.rounds):
        found = words.mapInArrow(lean(_expect(m, langs, p)), "piece long, lang_no long, n double").groupBy("piece", "lang_no").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(p)
        counts[found["piece"], found["lang_no"]] = found["n"]
        p = (1 - m.blend) * counts / np.maximum(counts.sum(axis=0), 1e-300) + m.blend / len(p)
    return langs, p


def _predict(m: LanguageModels, langs: list[str], p: np.ndarray, key: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(m, Pieces(m.vocabulary, m.longest_piece), p))
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if not langs:
                letters[:] = False
            pred, score = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            if letters.any():
                logs = scorer.rows(text)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                top = logs.argmax(axis=1)
                pred[letters] = np.array(langs, dtype=object)[top[letters]]
                score[letters] = odds[np.arange(len(top)), top][letters]
            yield pa.record_batch([batch.column("row"), *[text] * with_text, pa.array(pred, pa.string()), pa.array(score)], names=["row", *["text"] * with_text, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, m: LanguageModels, train: Column, with_text: bool = True) -> DataFrame:
    """docs (text, lang), its own columns (the text, as string, only if with_text), with lang_pred and score (posterior probability, languages alike likely before).

    The models learn from text and lang of rows where `train` holds and both are not null; nothing but the text decides a
    prediction. A word's likelihood sums over all its segmentations into pieces (a forward algorithm over its bytes with the mark
    of its begin), however long it is; a text's is the product over its words. A null text, one without a letter, or nothing to learn from
    gives `und` and 0; ties go to the language first by code point; an empty table gives no rows; repeated rows are each predicted. A column of docs
    that has an added one's name gives way to it. The models take 8 bytes for each piece and language, on the driver and in each worker.
    """
    import uuid

    langs, p = fit(docs.where(train), m)
    names = [c for c in docs.columns if c not in ("lang_pred", "score") and (with_text or c != "text")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    base = docs.select(row, F.col("text").cast("string").alias("text"))
    schema = f"row {base.schema['row'].dataType.simpleString()}, {'text string, ' * with_text}lang_pred string, score double"
    out = base.mapInArrow(lean(_predict(m, langs, p, uuid.uuid4().hex, with_text)), schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], "lang_pred", "score")
