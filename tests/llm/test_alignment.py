"""Groups and links of two tokenizers against the libraries and plain loops over whole texts."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm.alignment import Alignment, alignment, id_pairs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters():
    """As published with the vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    own = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + n)] = b
            n += 1
    return out


def plain(rows):
    a_lib, b_lib, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_lib.encode_special_tokens = True

    def spans(ids, parts):
        at, out = 0, []
        for i, x in zip(ids, parts):
            out.append((at, at + len(x), i))
            at += len(x)
        return out

    found, total = [], Counter()
    for doc_id, text in rows:
        a_ids = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b_lib.encode(text or "")
        a_parts = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a_ids]
        b_parts = [bytes([int(p[3:-1], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b_ids)]
        if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            found.append((doc_id, None))
            continue
        a, b = spans(a_ids, a_parts), spans(b_ids, b_parts)
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [[[], []] for _ in common]
        for side, tokens in enumerate((a, b)):
            for s, _, i in tokens:
                groups[bisect_right(common, s)][side].append(str(i))
        groups = ["|".join(",".join(ids) for ids in g) for g in groups]
        links, k = [], 0
        for s, e, i in a:
            while k and b[k][0] > s:
                k -= 1
            m = k
            while m < len(b) and b[m][0] < e:
                if b[m][1] > s:
                    links.append((i, b[m][2]))
                m += 1
            while k + 1 < len(b) and b[k][1] <= e - 1:
                k += 1
        total.update(links)
        found.append((doc_id, (len(a), len(b), groups, links)))
    most = {}
    for (_, j), n in total.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, total, most


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_groups_links_and_counts(spark):
    rng = random.Random(3)
    words = ["the", "Anblewh", "thonre", "éclairage", "straße", "don't", "12345", "x=y;", "<|endoftext|>", "<s>", "</s>", "<0x41>", "日本語", "naïve", "....", "a\tb", "\n", "\n\n  ", " ", "  ", " ", "　", "é", "é", "🙂"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "", "  "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += ["has ▁ in it", "▁", " ", "   ", " lead", "trail ", "trail  ", "\ttab", "nul\x00here", "  x", "﻿bom", "e" * 3000, "ab " * 9000, "漢字 " * 300]
    rows = [*enumerate(texts), (5, texts[5]), (5, "other"), (None, texts[2]), (None, None), (900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_a int, groups_sha256 string").repartition(3)
    want, total, most = plain(rows)
    for p in (Alignment(A, B), Alignment(A, B, shard=500, units=40, batch=7)):
        got = [tuple(r[c] for c in COLUMNS) for r in alignment(docs, p).collect()]
        assert ordered(got) == ordered(want)
    pairs = {(r.a, r.b): (r.total, r.best) for r in id_pairs(docs, Alignment(A, B)).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in total.items()}


def test_long_texts_are_cut_between_units(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdéß.") for _ in range(rng.randrange(1, 9))) for _ in range(260_000))
    rows = [(1, text), (2, "one two"), (3, text[:1000])]
    want, _, _ = plain(rows)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment(spark.createDataFrame(rows, "doc_id long, text string"), Alignment(A, B)).collect()]
    assert ordered(got) == ordered(want)


def test_no_documents(spark):
    assert alignment(spark.createDataFrame([], "doc_id long, text string"), Alignment(A, B)).collect() == []
