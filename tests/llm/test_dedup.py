"""Near-duplicates, repeated passages and graph components against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from tallyspark.llm import graph
from tallyspark.llm.minhash import NearDuplicates, near_duplicates
from tallyspark.llm.substring_dedup import Runs, substring_dedup

DOCS = "doc_id long, text string, band string, row string, n_removed long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(rows, width):
    """The component of each row with a doc_id and words: equal sets share their smallest doc_id, similar ones are joined."""
    smallest = {}
    for i, t in rows:
        key = frozenset(shingles(t, width))
        if i is not None and key:
            smallest[key] = min(i, smallest.get(key, i))
    parent = {i: i for i in smallest.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = list(smallest.items())
    for k, (a, i) in enumerate(sets):
        for b, j in sets[k + 1 :]:
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return lambda i, t: root(smallest[frozenset(shingles(t, width))]) if i is not None and shingles(t, width) else i


def made(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], DOCS)


@pytest.mark.parametrize("width", [2, 5])
def test_components_are_those_of_all_pairs(spark, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "ONE two"), (n + 7, "long " * 200_000), (None, "one two"), (None, None)]
    rows += [(3, "another row of document three that nobody else has"), (rows[0][0], rows[0][1])]
    want = plain_components(rows, width)
    got = near_duplicates(made(spark, rows).repartition(3), NearDuplicates(width=width)).collect()
    assert len(got) == len(rows)
    expected = sorted((i is not None, i or 0, len(shingles(t, width)), want(i, t) if i is not None else -1, i is None or want(i, t) == i) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got) == expected
    assert {r.n_shingles for r in got if r.doc_id in (n, n + 1, n + 2)} == {0}


@pytest.mark.parametrize("rows_each", [2048, 16])
def test_a_chain_in_one_large_group_is_followed(spark, rows_each):
    """Neighbours are alike, far ones are not, and all share most of their words: leaders alone would not find all links."""
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(120)]
    got = near_duplicates(made(spark, rows), NearDuplicates(width=2, block_rows=rows_each)).collect()
    assert {r.component_id for r in got} == {0}


def test_groups_of_many_blocks_lose_no_link(spark):
    """Templates that share most words, in several families: rows of one band stand in several blocks, and links lie between and within them."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for family in range(6):
        own = base[:46] + [f"f{family}x{i}" for i in range(14)]
        for _ in range(25):
            copy = list(own)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    want = plain_components(rows, 2)
    got = {r.doc_id: r.component_id for r in near_duplicates(made(spark, rows), NearDuplicates(width=2, block_rows=8)).collect()}
    assert got == {i: want(i, t) for i, t in rows} and len(set(got.values())) > 6


def test_no_documents(spark):
    empty = made(spark, [])
    assert near_duplicates(empty).collect() == []
    assert substring_dedup(empty).collect() == []


def test_components_of_a_graph(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2000, 2050)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert {k: root(k) for k in parent if k in got} == got
    assert {k for k in parent if k not in got} <= loops


def passage(rng, n=60):
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(n)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(words, 1)) + "."


def test_later_copies_of_a_passage_go_and_all_else_stays(spark):
    rng = random.Random(2)
    p = passage(rng)
    own = [passage(rng, 40) for _ in range(8)]
    rows = [(5, f"{own[0]} {p} {own[1]}"), (9, f"{own[2]}\n{p}\n{own[3]}"), (7, p), (8, own[4]), (1, own[5] + " " + own[6]), (2, None), (3, ""), (4, "a b. c d."), (6, "a b. c d."), (10, f"{p} {own[7]} {p}"), (None, p)]
    got = {(r.doc_id): r for r in substring_dedup(made(spark, rows).repartition(4)).collect()}
    assert got[5].text == rows[0][1] and got[5].n_removed == 0
    assert got[9].text.split() == f"{own[2]} {own[3]}".split()
    assert got[7].text == "" and got[7].n_removed == got[7].n_sentences > 0
    assert got[10].text.split() == own[7].split() and got[10].removed_words == 120
    for i in (8, 1, 2, 3, 4, 6, None):
        assert got[i].text == dict(rows)[i] and got[i].n_removed == 0, i
    assert set(got[5].asDict()) == {"doc_id", "text", "band", "row", "n_sentences", "n_removed", "removed_words"}


def test_passages_without_sentence_ends_and_very_long_texts(spark):
    rng = random.Random(8)
    p = " ".join(f"x{rng.randrange(10**6)}" for _ in range(120))
    long = " ".join(f"y{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, f"lead words {p} tail one"), (2, f"something else stands here {p} tail two"), (3, f"{long} {p}"), (4, long[: len(long) // 2])]
    got = {r.doc_id: r for r in substring_dedup(made(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].removed_words > 60 and "something else stands here" in got[2].text
    assert got[3].removed_words > 60 and len(got[4].text) < len(rows[3][1]) // 10


def test_runs_equal_a_plain_version(spark):
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 13))) + rng.choice([".", "!", "?"]) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    p = Runs(sentences=3, words=5)

    def cut(text):
        return re.findall(r"[^ ][^.!?]*[.!?]", text)

    seen, gone = {}, {i: set() for i, _ in rows}
    for i, t in rows:
        s = cut(t)
        for a in range(len(s)):
            b = a + 3
            while b <= len(s) and sum(len(x.split()) for x in s[a:b]) < 5:
                b += 1
            if b <= len(s):
                if tuple(s[a:b]) in seen:
                    gone[i] |= set(range(a, b))
                seen.setdefault(tuple(s[a:b]), (i, a))
    got = {r.doc_id: r for r in substring_dedup(made(spark, rows), p).collect()}
    for i, t in rows:
        assert got[i].text.split() == " ".join(x for k, x in enumerate(cut(t)) if k not in gone[i]).split(), i
