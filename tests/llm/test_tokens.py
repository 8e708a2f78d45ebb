"""Tokens: ids and counts are the libraries', packing and files lose none."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyspark.llm import packing, rans, token_counts, token_files, tokens
from tallyspark.llm.queries import PIECES, WORDS

ODD = ["", None, "a", "a ", "  a  b  ", " ", "  ", "\n", "x" * 5000, "<|endoftext|> hello<|startoftext|>x", "don't IT'S we'll ’s", "İstanbul ΣΑΣ straße", "é é J̌", "日本語テキスト。", "▁ ▁▁ a▁b", "a\t\tb \n c", "\x00\x01 z", "👍🏽 ok", "ab12cd.e,f", "--!!??..", "ﬁne", "A\x1cB", "tab\x0bvt\x0cff", "<s> </s> <unk>"]
DOCS = "doc_id long, text string, n long, ids string, part string"


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B", "'s", "'", "é", "é", " ", "  ", "\n", "\t", "1", "22", "!", "?", ".", ",", "Ω", "ς", "ß", "中", " ", "<|endoftext|>", "▁", "-", "ll", "word", "Word.", "the", " the", " of"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def library(all_texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [e.ids for e in t.encode_batch([x or "" for x in all_texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [None, 17])
def test_ids_and_counts_are_the_libraries(monkeypatch, limit):
    from sentencepiece import SentencePieceProcessor

    from tallyspark.llm import text

    if limit:
        monkeypatch.setattr(tokens, "blocks", lambda column: text.blocks(column, limit))
    rows = ODD + texts(400, 1)
    got, encoder = [], tokens.WordBPE(WORDS)
    for _, ids, lens in encoder.rows(pa.array(rows, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
    assert got == library(rows)
    model = SentencePieceProcessor(model_file=PIECES)
    assert tokens.PieceCounts(PIECES).counts(pa.array(rows, pa.string())).tolist() == [len(x) for x in model.encode([t or "" for t in rows])]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)


def numbered(rows):
    return list(zip([*range(0, 3 * len(rows), 3)], rows))


def test_token_counts(spark):
    rows = [*numbered(ODD), (None, "null id"), (0, "again"), (0, "again")]
    got = token_counts.token_counts(docs(spark, rows), PIECES, limit=3).collect()
    want = tokens.PieceCounts(PIECES).counts(pa.array([t for _, t in rows], pa.string())).tolist()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=key) == sorted(((i, len((t or "").encode()), n, n > 3) for (i, t), n in zip(rows, want)), key=key)
    assert token_counts.token_counts(docs(spark, []), PIECES).collect() == []


def test_packing_keeps_each_token_once(spark):
    rows = numbered(ODD + texts(60, 2) + ["long text " * 20_000])
    ids = {i: np.array([*x, 2], dtype="<u4") for (i, _), x in zip(rows, library([t for _, t in rows]))}
    pieces = packing.pack(docs(spark, rows).repartition(3), WORDS, length=64).collect()
    by_doc = {}
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(own.tobytes()) == p.ids_crc32 and bytes(p.ids) == own.tobytes()
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(x)
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert (p.sequence_id, p.offset) == divmod(at, 64)
        at += p.length
    assert at == sum(map(len, ids.values()))
    whole = packing.sequences(packing.pack(docs(spark, rows), WORDS, length=64), length=64).collect()
    assert sum(r.n_ids for r in whole) == at and {len(r.ids) for r in whole} <= {1, 2, 4, 8, 16, 32, 64}
    assert packing.pack(docs(spark, []), WORDS).collect() == []


@pytest.mark.parametrize("n", [1, 31, 33, 5000, 32768, 32769, 98309])
def test_blocks_decode_to_what_was_encoded(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000)
    model = rans.Model.of_counts(np.bincount(ids))
    assert model.freq.sum() == 1 << rans.PRECISION
    cells = list(rans.encode(model, ids, -(-n // 32) if n < 32768 else 1024))
    assert (np.concatenate([rans.decode(model, [c])[0] for c in cells]) == ids).all()
    assert (np.concatenate(rans.decode(model, cells)) == ids).all()
    spoilt = bytearray(cells[0])
    spoilt[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(model, [bytes(spoilt)])


def test_token_files_give_back_all_ids_in_order(spark):
    rows = [*numbered(ODD + texts(40, 5) + ["very long " * 60_000]), (None, "no id"), (0, "twice"), (0, "twice")]
    files, model = token_files.write_token_files(docs(spark, rows).repartition(4), WORDS)
    got = sorted(token_files.read_token_files(files, model).collect(), key=lambda r: r.start)
    encoded = [(i, np.array([*x, 2], dtype="<u4")) for (i, _), x in zip(rows, library([t for _, t in rows]))]
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)) == sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in encoded)
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id
    from tallyspark.llm.files import read_manifest

    folder = files.first().path.rpartition("/")[0]
    assert sum(f["ids"] for f in read_manifest(folder)) == at
    empty, model = token_files.write_token_files(docs(spark, []), WORDS)
    assert token_files.read_token_files(empty, model).collect() == []


def test_the_vocabulary_is_a_parameter():
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS
