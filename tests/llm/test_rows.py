"""What a row gives, whatever stands beside it: unseen characters, sums at the edge of doubles, query rows that share an id, hot keys."""

from __future__ import annotations

import threading

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import language_id, multi_index, topk, warc
from tallyspark.llm.scratch import Passing, written
from tallyspark.llm.substring_dedup import substring_dedup
from tallyspark.llm.text import row_sums

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def fitted(spark):
    rows = [(f"der und die {w} nicht", "de") for w in ("haus", "baum", "zug")] + [(f"the and of {w} not", "en") for w in ("house", "tree", "train")]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string"), language_id.LanguageModels(PIECES, rounds=2))


def plain_log(word: bytes, pieces, p):
    """Log-likelihoods of a marked word by its prefixes, each sum in logarithms."""
    place = {x: i for i, x in enumerate(pieces.all)}
    out = []
    for k in range(p.shape[1]):
        logs = [0.0]
        for end in range(1, len(word) + 1):
            ways = [logs[b] + np.log(p[place[word[b:end]], k]) for b in range(max(0, end - pieces.longest), end) if word[b:end] in place]
            logs.append(np.logaddexp.reduce(ways))
        out.append(logs[-1])
    return np.array(out)


def test_words_of_unseen_characters_have_scores_and_leave_others_alone(spark):
    langs, p = fitted(spark)
    pieces = language_id.Pieces(PIECES, 16)
    scorer = language_id.Scorer(language_id.LanguageModels(PIECES), pieces, p)
    words = ["ሀ" * n for n in range(1, 68)] + ["龘" * n for n in (25, 28, 31, 60)] + ["der", "und", "x" * 150]
    logs = scorer.score([b" " + w.encode() for w in words])
    assert np.isfinite(logs).all()
    for i in (0, 24, 29, 66, 70, 73):
        assert np.allclose(logs[i], plain_log(b" " + words[i].encode(), pieces, p), rtol=1e-9)
    texts = ["der und der und", "ሀ" * 30, "龘" * 28, None, "", "der und der und", "the and " + "龘" * 28]
    rows = scorer.rows(pa.array(texts, pa.string()))
    assert np.array_equal(rows[0], rows[5]) and np.isfinite(rows).all() and not rows[3:5].any()
    odds = np.exp(plain_log(b" der", pieces, p) * 2 + plain_log(b" und", pieces, p) * 2)
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100 + i, f"{a} {b} {c}", lang) for i, (a, b, c, lang) in enumerate([("der", "und", "die", "de"), ("the", "and", "of", "en")] * 3)], "doc_id long, text string, lang string").coalesce(1)
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.LanguageModels(PIECES, rounds=2), F.lit(True)).collect()}
    assert found[0].lang_pred == found[5].lang_pred == langs[int(odds.argmax())] == "de" and found[0].score == found[5].score > 0.5
    assert all(0 <= r.score <= 1 for r in found.values()) and found[3].lang_pred == found[4].lang_pred == "und" and found[6].lang_pred == "en"


def test_row_sums_take_each_row_alone():
    values = np.array([[1.0], [np.inf], [2.0], [3.0]])
    assert row_sums(values, np.array([0, 0, 2, 2, 4, 4])).ravel().tolist() == [0, np.inf, 0, 5, 0]


def test_top_k_is_exact_where_sums_leave_whole_doubles():
    rng = np.random.default_rng(12)
    for trial in range(120):
        dim = int(rng.choice([3, 7, 16]))
        most = int(np.sqrt((1 << int(rng.choice([51, 52, 53, 60, 61, 62]))) * rng.uniform(1, 2) / dim))
        cells = rng.integers(-most, most, (60, dim), endpoint=True).astype(np.float64)
        cells[1::2] = cells[::2] + rng.integers(-1, 2, (30, dim))
        (_, row, score), _ = topk.nra(5, 1.0)(topk.Part(np.arange(60), cells, topk.sorted_lists(1.0)(cells)), np.array([1000]), cells[:1], None)
        whole = [sum(int(a) * int(b) for a, b in zip(x, cells[0])) for x in cells]
        limit = (1 << 63) - 1
        want = [(j, max(-limit - 1, min(limit, whole[j]))) for j in sorted(range(60), key=lambda j: (-whole[j], j))[:5]]
        assert sorted(score.tolist(), reverse=True) == [s for _, s in want]
        assert sorted(row.tolist()) == sorted(j for j, _ in want)


def test_query_rows_of_one_id_have_candidates_of_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    ids = [0, 0, 0, *range(1, 56), 7, 20]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(100, [0.0] * 8), (101, [1.0] * 3), (20, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0, k=60).collect()
    want = []
    for q in (i for i, v in enumerate(ids) if v % 20 == 0):
        order = sorted((j for j in range(60) if ids[j] != ids[q]), key=lambda j: (-float((x[j] * x[q]).sum()), ids[j]))[:60]
        want += [(ids[q], k + 1, ids[j]) for k, j in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)
    exact = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted(r.rank for r in exact if r.query_id == 0) == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_half_of_the_rows_under_one_key(spark):
    payload = "<html>" + "x" * 200
    pages = spark.createDataFrame([(i, f"u{i}", payload if i % 2 else payload + str(i)) for i in range(400)], "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert sum(r.record_type == "revisit" and r.refers_to == 1 for r in got) == 199 and len(got) == 400
    run = " ".join(f"w{i}" for i in range(30)) + "."
    docs = spark.createDataFrame([(None if i % 2 else i, f"{run} own{i}. {run}") for i in range(200)], "doc_id long, text string")
    cleaned = substring_dedup(docs).collect()
    assert len(cleaned) == 200 and all(r.n_removed == 0 for r in cleaned if r.doc_id is None)


def test_scopes_of_two_threads_are_apart(spark):
    ready, go, kept = threading.Event(), threading.Event(), []

    def other():
        with Passing() as scope:
            table = written(spark.range(3), "other")
            ready.set()
            go.wait(60)
            kept.append(table.count())
            assert scope.paths == [table.written_path]

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with Passing():
        written(spark.range(5), "mine")
    go.set()
    thread.join()
    assert kept == [3]
