"""Repeated passages without sentence ends, glued into other text on both sides."""

from __future__ import annotations

import random

import numpy as np

from tallyspark.llm.substring_dedup import Runs, _lows, substring_dedup


def test_passages_of_51_to_60_words_are_found_wherever_they_stand(spark):
    rng = random.Random(11)

    def other(kind, n):
        return [f"{kind}{rng.randrange(10**9)}" for _ in range(n)]

    passages = [other("p", n) for n in range(51, 61) for _ in range(20)]
    passages += [[rng.choice([f"few{k}", f"{k}one", f"{k}some"]) for _ in range(n)] for k, n in enumerate(range(51, 61))]
    passages += [[f"same{k}"] * 51 for k in range(10)]
    rows, glue = [], {}
    for k, p in enumerate(passages):
        for i in (2 * k, 2 * k + 1):
            glue[i] = other("lead", rng.randrange(3, 40)), other("tail", rng.randrange(3, 40))
            rows.append((i, " ".join([*glue[i][0], *p, *glue[i][1]])))
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, (lead, tail) in glue.items():
        words = got[i].text.split()
        assert words[: len(lead)] == lead and words[-len(tail) :] == tail, i
        left = len(words) - len(lead) - len(tail)
        assert left <= 36 if i % 2 else left == len(passages[i // 2]) or i >= 420, (i, left)
        assert got[i].removed_words >= 20 or not i % 2, i


def test_cuts_are_the_last_smallest_of_each_window():
    rng = np.random.default_rng(5)
    for values in (3, 10**9):
        hashes = rng.integers(0, values, 400).astype(np.uint64)
        edges = np.array([0, 10, 34, 59, 61, 300, 400])
        want = set()
        for a, b in ((34, 59), (61, 300), (300, 400)):
            for s in range(a, b - 7):
                window = hashes[s : s + 8].tolist()
                want.add(s + 7 - window[::-1].index(min(window)))
        assert _lows(hashes, edges, Runs()).tolist() == sorted(want)
