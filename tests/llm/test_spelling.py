"""Words one edit apart, forms and roots against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm.spelling import Variants, near_words, spelling_groups, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), counts[form[w]] if w in form else -1) for w, n in counts.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize(("seed", "letters", "block"), [(1, "ab", 2), (2, "abcé", 4), (3, "abcdefghijklmnopqrstuvwxyzß", 32)])
def test_near_words_forms_and_roots(spark, seed, letters, block):
    rng = random.Random(seed)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 15])))
        for _ in range(rng.randrange(5)):
            counts[word] = rng.choice([2, 3, 30, 30, 400, 5000])
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])
            word = word if len(word) >= 7 else word + "a"
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    p = Variants(block=block, cells=1 << 10)
    pairs = sorted((r.word, r.near) for r in near_words(words, p).collect())
    assert pairs == sorted((a, b) for a in counts for b in counts if a != b and one_edit(a, b))
    assert rows_of(variants(words, p)) == plain(counts)


def test_words_that_share_a_long_beginning(spark):
    """A hot block: all words begin alike, so halves of it are subdivided until one letter is left."""
    rng = random.Random(5)
    counts = {"internat" + "".join(rng.choice("abc") for _ in range(6)): rng.choice([2, 50, 900]) for _ in range(500)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert rows_of(variants(words, Variants(block=8))) == plain(counts)


def test_words_of_texts(spark):
    rng = random.Random(7)
    base = ["Lettres", "éclairage", "straßenbahn", "windows", "interval", "ab", "x" * 80]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "×end", "中"]) for _ in range(120)]
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[3] + " windows interval"), (500, None), (501, ""), (502, "Éclairage, ÉCLAIRAGE"), (503, "windows " * 300_000)]
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    assert rows_of(spelling_groups(docs, Variants(remembered=3), noise=5)) == plain(counts)
    assert spelling_groups(docs.where("false")).collect() == []
