"""Strings that also start earlier, against a plain version over all strings."""

from __future__ import annotations

import random

import pytest

from tallyspark.llm.suffixes import Repeats, without_repeats


def plain(rows, length):
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        data = (rows[i][1] or "").encode()
        gone = [False] * len(data)
        for x in range(len(data) - length + 1):
            if data[x : x + length] in seen:
                gone[x : x + length] = [True] * length
            seen.add(data[x : x + length])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((rows[i][0], len(data), sum(gone), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone)), kept))
    return ordered(out)


def ordered(rows):
    return sorted(((i, *rest[:-1], bytes(rest[-1])) for i, *rest in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize(("seed", "length", "letters", "shard", "strip"), [(1, 100, "abcdefgh ", 5000, 4096), (2, 8, "ab", 300, 257), (3, 33, "aé漢b", 300, 4096)])
def test_every_byte_of_an_earlier_string_goes(spark, seed, length, letters, shard, strip):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [word(rng.randrange(1, 4 * length)) for _ in range(8)] + ["a" * rng.randrange(1, 400), "ab" * 200]
    rows = []
    for i in range(50):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else word(rng.randrange(30)) for _ in range(rng.randrange(6)))
        rows.append((i, text[rng.randrange(len(text) + 1) :] if rng.random() < 0.3 else text))
    rows += [(60, rows[7][1]), (60, rows[7][1]), (None, rows[3][1] + "end"), (None, None), (70, None), (71, "")]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, kept string, n_removed long").repartition(3)
    got = without_repeats(docs, Repeats(length, shard=shard, strip=strip)).collect()
    assert ordered(got) == plain(rows, length)
    assert sum(r.n_removed for r in got) > 1000


def test_copies_of_one_text_and_a_hot_passage(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklm ") for _ in range(n))
    same, passage = word(700), word(250)
    rows = [(i, same) for i in range(60)] + [(100 + i, word(150) + passage + word(150)) for i in range(60)] + [(300 + i, passage[: 100 + i]) for i in range(5)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), Repeats(shard=2000)).collect()
    assert ordered(got) == plain(rows, 100)


def test_no_documents_and_texts_too_short(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = without_repeats(spark.createDataFrame([(1, "x" * 99), (2, "x" * 99), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 99, 0), (2, 99, 0), (3, 0, 0)]
