"""Language ID, mixing, archives and searches against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, mixing, multi_index, topk, warc
from tallyspark.llm.files import opened, read_manifest
from tallyspark.llm.queries import PIECES, fold

LANGUAGES = {"en": "the of and to in is that it was for on are with as".split(), "de": "der die und in den von zu das mit sich des auf für ist".split(), "fr": "de la le et les des en un du une que est pour qui".split()}


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LANGUAGES))
        words = [rng.choice(LANGUAGES[lang]) + rng.choice(["", "", "", rng.choice("abcdefgh")]) for _ in range(rng.randrange(4, 60))]
        rows.append((i, " ".join(words), lang if i % 7 else None, "x", 0.5))
    return rows


def test_language_of_held_out_documents(spark):
    rows = labelled(600) + [(1000, None, "en", "x", 0.0), (1001, "12 34 !!", "en", "x", 0.0), (1002, "", None, "x", 0.0), (1003, "the of " * 100_000, None, "x", 0.0), (1004, "ununterbrochen" * 5000, None, "x", 0.0), (None, "der die und", "de", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score double")
    models = language_id.LanguageModels(PIECES, documents=100, rounds=2)
    got = {r.doc_id: r for r in language_id.identify(docs, models, fold() != 0).withColumn("held", fold() == 0).collect()}
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2]}
    held = [r for i, r in got.items() if r.held and i in truth and i < 1000]
    assert len(held) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "de" and 0 <= got[1004].score <= 1
    nothing = language_id.identify(docs, models, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(docs.where("false"), models, fold() != 0).collect() == []


def test_all_segmentations_are_summed():
    pieces = language_id.Pieces(PIECES, 16)
    p = np.random.default_rng(0).random((len(pieces.all), 2))
    p /= p.sum(axis=0)
    place = {x: i for i, x in enumerate(pieces.all)}

    def total(word):
        if not word:
            return np.ones(2)
        return sum((p[place[word[:k]]] * total(word[k:]) for k in range(1, min(16, len(word)) + 1) if word[:k] in place), np.zeros(2))

    words = [b"the", b"other", "été".encode(), b"x"]
    lattice = language_id.Lattice([b" " + w for w in words], pieces)
    q = language_id.scaled(p, pieces)
    got = lattice.totals(lattice.forward(q)) / language_id.SCALE ** lattice.lens[:, None]
    assert np.allclose(got, [total(b" " + words[i]) for i in lattice.order])
    expected = lattice.expected(q, np.ones((4, 2)))
    lens = np.array([len(x) for x in pieces.all])
    assert np.allclose((expected * lens[:, None]).sum(axis=0), sum(len(w) + 1 for w in words))


def test_words_of_any_length_are_summed_whole():
    pieces = language_id.Pieces(PIECES, 16)
    rng = np.random.default_rng(5)
    p = rng.random((len(pieces.all), 3)) ** 4
    p /= p.sum(axis=0)
    place = {x: i for i, x in enumerate(pieces.all)}
    words = ["ununterbrochen" * 30, "語" * 200, "été", "a", "x" * 96, "the" * 33, "long" * 2000]
    marked = [b" " + w.encode() for w in words]
    got = language_id.Scorer(language_id.LanguageModels(PIECES), pieces, p).score(marked)
    for w, log in zip(marked, got):
        alpha, shift = [np.ones(3)], [np.zeros(3)]
        for end in range(1, len(w) + 1):
            terms = [(np.log(p[place[w[b:end]]]) + np.log(alpha[b]) + shift[b]) for b in range(max(0, end - 16), end) if w[b:end] in place]
            most = np.max(terms, axis=0)
            alpha.append(np.exp(np.array(terms) - most).sum(axis=0))
            shift.append(most)
        assert np.allclose(log, np.log(alpha[-1]) + shift[-1])
    assert b"".join(language_id.in_parts(marked[1], 48)) == marked[1] and all(x.decode() for x in language_id.in_parts(marked[1], 48))


def test_every_language_is_learned(spark):
    rows = [(9 * i + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + k * j) % 26)}" for k in range(30)), f"l{i:03d}") for i in range(300) for j in range(2)]
    docs = spark.createDataFrame(rows + [rows[0]] * 50, "doc_id long, text string, lang string")
    langs, p = language_id.fit(docs, language_id.LanguageModels(PIECES, documents=20, rounds=1))
    assert langs == [f"l{i:03d}" for i in range(300)] and np.allclose(p.sum(axis=0), 1)


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 500 / 3, 250 / 3])
    got = mixing.targets([10, 500, 500, 0], [5, 2, 1, 5], 1.5, 2.0)
    assert got[0] == 20 and got[3] == 0 and sum(got) == pytest.approx(1515)
    assert mixing.targets([], [], 1.5, 2.0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_indexes_are_permuted(n):
    got = mixing.permuted(np.arange(n), n, 3)
    assert sorted(got) == list(range(n)) and (n < 100 or (got != np.arange(n)).mean() > 0.9)


def test_every_shard_is_full_and_every_source_is_dealt_out():
    slots, size = np.array([30_000, 0, 501, 9_000, 1]), 1000
    shards = list(mixing.shard_counts(slots, size, 5, 0, 40))
    assert [s for s, _, _ in shards] == list(range(40)) and [int(n.sum()) for _, _, n in shards] == [1000] * 39 + [502]
    assert (sum(n for _, _, n in shards) == slots).all()
    before = np.zeros_like(slots)
    for _, first, n in shards:
        assert (first == before).all() and (n >= 0).all()
        before = before + n
    assert abs(np.array([n[0] for _, _, n in shards[:39]]).mean() - 1000 * 30_000 / 39_502) < 10
    for low, high in ((0, 1), (7, 9), (39, 40), (12, 31)):
        assert [(s, f.tolist(), n.tolist()) for s, f, n in mixing.shard_counts(slots, size, 5, low, high)] == [(s, f.tolist(), n.tolist()) for s, f, n in shards[low:high]]
    assert list(mixing.shard_counts(np.array([], dtype=np.int64), size, 5, 0, 3)) == [] == list(mixing.shard_counts(np.array([0]), size, 5, 0, 3))


def test_draws_from_more_slots_than_the_generator_takes_keep_totals():
    counts = np.array([3 * 10**9, 5, 2 * 10**6, 0, 7 * 10**8])
    take = int(counts.sum()) // 3
    left = mixing.split(counts, take, np.random.default_rng(3))
    assert left.sum() == take and (left >= 0).all() and (left <= counts).all()
    assert abs(left[0] / 1e9 - 1) < 1e-3 and abs(left[2] - 2e6 / 3) < 5000
    all_but_one = mixing.split(counts, int(counts.sum()) - 1, np.random.default_rng(3))
    assert all_but_one.sum() == counts.sum() - 1 and (all_but_one <= counts).all()
    assert mixing.split(counts, 0, np.random.default_rng(3)).sum() == 0


def test_shards_of_a_mix_have_one_size(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 5, 100, 300])), rng.choice("abc")) for i in range(90)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16, seed=4, shard_blocks=50)
    slots = plan.slots.collect()
    sizes = [sum(s.shard == n for s in slots) for n in range(max(s.shard for s in slots) + 1)]
    assert len(sizes) > 10 and sizes[:-1] == [50] * (len(sizes) - 1) and 0 < sizes[-1] <= 50
    for no in range(3):
        assert sorted(s.k for s in slots if s.source_no == no) == list(range(sum(s.source_no == no for s in slots)))


def test_taken_words_are_those_of_the_permuted_blocks(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 5, 100, 300])), rng.choice("abc")) for i in range(90)]
    got = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16, seed=4).documents().collect()}
    names = sorted({r[2] for r in rows})
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    for no, (name, size, target) in enumerate(zip(names, sizes, mixing.targets(sizes, [5, 2, 1], 1.5, 2.0))):
        n = -(-size // 16)
        k = np.arange(round(target * n / size))
        copies = np.bincount(mixing.permuted(k % n, n, 4 + no), minlength=n)
        owner = [i for i, t, s in sorted(rows) if s == name for _ in t.split()]
        want = dict.fromkeys((i for i, _, s in rows if s == name), 0)
        for at, i in enumerate(owner):
            want[i] += int(copies[at // 16])
        assert {i: got[i] for i in want} == want


def test_a_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 3, 80, 900]))), rng.choice(["a", "a", "b", "c", None]), "x", "y") for i in range(200)]
    rows += [(500, None, "a", "x", "y"), (501, "word " * 100_000, "c", "x", "y"), (None, "no id here", "b", "x", "y"), (1, "twice", "d", "x", "y"), (1, "twice", "d", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, block string")
    got = mixing.mix(docs).documents().collect()
    assert len(got) == len(rows)
    total, taken = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        total[r.source] = total.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in got:
        assert r.source_size == total[r.source] and abs(taken[r.source] - r.target) <= 256
    order = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in rows)
    assert order(mixing.mix(docs.repartition(7)).documents().collect()) == order(got)
    out = mixing.mixed_documents(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(docs.where("false")).documents().collect() == []


def test_archives_give_back_all_pages(spark):
    rng = random.Random(2)
    bodies = ["x" * 200, "é" * 60, "short", "", None, "y" * 99, "z" * 100, "<html>\r\n\r\n</html>" * 20]
    rows = [(i, rng.choice([f"http://h/{i} a\n", None]), rng.choice(bodies), "x") for i in rng.sample(range(1000), 120)] + [(2000, "u", "big " * 500_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    files = warc.write_warc(pages.repartition(5), roll_bytes=2000)
    got = {r.page_id: r for r in warc.read_warc(files, payloads=True).collect()}
    first = {}
    for i, _, html, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (html or "").encode()
        to = first.setdefault(data, i) if len(data) >= 100 else i
        r = got.pop(i)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
        assert r.payload is None if to != i else bytes(r.payload) == data
    assert not got
    listed = read_manifest(files.first().path.rpartition("/")[0])
    assert len(listed) == files.count() > 4 and all(f["bytes"] <= 2000 or f["records"] == 1 for f in listed)
    store, path = opened(listed[0]["path"])
    data = store.open_input_stream(path, compression=None).read()
    import io

    with pytest.raises(Exception):
        list(warc.records_of(io.BytesIO(data[:-20])))
    assert warc.read_warc(warc.write_warc(pages.where("false"))).collect() == []


def test_pages_without_an_id_and_pages_that_share_one(spark):
    same, other = "s" * 150, "o" * 150
    rows = [(None, "n", same), (None, "m", other), (None, None, other), (7, "a", same), (7, "b", same), (9, "c", same), (9, "c", None), (None, "t", "tiny")]
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(rows)
    own = sorted(((r.page_id is not None, r.page_id or 0), r.url or "", r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)
    none, seven, nine = (False, 0), (True, 7), (True, 9)
    assert own == sorted([(none, "n", 150, "revisit", 7), (none, "m", 150, "response", 0), (none, "", 150, "response", 0), (none, "t", 4, "response", 0), (seven, "a", 150, "response", 0), (seven, "b", 150, "response", 0), (nine, "c", 150, "revisit", 7), (nine, "c", 0, "response", 0)])


def vectors(spark, n, seed, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32) / 4
    x[n // 2 :: 7] = x[0]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(n)]
    bad = [(50_000, None, 1), (50_050, [None] * dim, 1), (50_100, [float("nan")] * dim, 1), (50_150, [float("inf")] + [0.0] * (dim - 1), 1), (None, [1.0] * dim, 1), (50_200, [], 1)]
    return x.astype(np.float64), spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, block int")


def test_top_k_is_that_of_all_scores(spark):
    x, df = vectors(spark, 900, 3)
    z = spark.createDataFrame([(60_000, [0.0] * 16, 1)], df.schema)
    ids, ints = np.append(np.arange(900), 60_000), np.vstack([np.floor(256 * x).astype(int), np.zeros((1, 16), dtype=int)])
    got = topk.top_k(df.union(z), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = ints @ ints[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:5]
        want += [(ids[q], k + 1, ids[j], score[j]) for k, j in enumerate(order)]
    assert [tuple(r) for r in got] == want
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_repeated_ids_and_other_dimensions_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [300_000.0, 0.0]), (2, [1.0, 1.0]), (3, [1e30, 1.0]), (3, [2.0, 0.0]), (0, [0.5, 0.0]), (4, [1.0, 2.0, 3.0]), (50, [0.0, 0.0]), (100, [1e30, 0.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[50]) == [(1, 0, 0), (2, 0, 0), (3, 1, 0)]
    most = (1 << 63) - 1
    assert sorted(got[100]) == [(1, 1, most), (2, 3, most), (3, 3, most)]
    assert sorted(got[0]) == sorted([(1, 3, most), (2, 100, most), (3, 1, 256 * 256 * 300_000), (1, 3, most), (2, 100, most), (3, 1, 128 * 256 * 300_000)])  # two query rows of one id
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [300_000.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(small, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(0, 1, 1, 256 * 256 * 300_000), (0, 2, 2, 65536)]
    ids, cells = np.arange(400), np.array([[float(v), 0.0] for v in range(400)])
    cells[7] = [1e20, 5.0]
    search = topk.nra(3, 1.0)
    part = topk.Part(ids, cells, topk.sorted_lists(1.0)(cells))
    (_, row, score), _ = search(part, np.array([1000]), np.array([[1e20, 3.0]]), None)
    assert row.tolist() == [7, 399, 398] and score[0] == most


def test_lists_are_left_early_where_few_entries_decide():
    rng = np.random.default_rng(8)
    cells = rng.normal(size=(4000, 32)) * np.geomspace(64, 0.01, 32)
    part, search = topk.Part(np.arange(4000), cells, topk.sorted_lists(256.0)(cells)), topk.nra(5, 256.0)
    whole = np.floor(256 * cells).astype(int)
    (_, row, score), beat = search(part, np.arange(4000, 4040), cells[:40], None)
    for j in range(40):
        every = whole @ whole[j]
        assert score[5 * j : 5 * j + 5].tolist() == sorted(every, reverse=True)[:5] and beat[j] == score[5 * j + 4]
    assert search.read < 0.5 * 40 * cells.size
    read = search.read
    search(part, np.arange(4000, 4040), cells[:40], beat + 1)
    assert search.read - read <= read


def test_nearest_finds_most_of_the_nearest(spark):
    x, df = vectors(spark, 1500, 4)
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        score = x @ x[q]
        order = [j for j in np.lexsort((np.arange(1500), -score)) if j != q][:20]
        assert [r.rank for r in own] == list(range(1, 21)) and np.allclose([r.score for r in own], score[[r.vec_id for r in own]])
        assert [r.vec_id for r in own] == sorted((r.vec_id for r in own), key=lambda j: (-[r.score for r in own if r.vec_id == j][0], j))
        hits += len({r.vec_id for r in own} & set(order))
    assert hits >= 0.9 * 75 * 20
    few = multi_index.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert multi_index.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_probes_reach_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(500, 32)), rng.normal(size=(5, 32))
    codes = multi_index.Codes.fit(x)
    part = multi_index.Part(np.arange(500), x, multi_index.substring_index(codes)(x))
    for radius in (0, 3, 9, 14, 32):
        (asked, got, _), _ = multi_index.mih(500, codes, radius)(part, np.arange(1000, 1005), q, None)
        for i in range(5):
            assert sorted(got[asked == i]) == np.flatnonzero(codes.far(codes.of(x), codes.of(q)[i]) <= radius).tolist()


def test_codes_prefer_a_rotation_that_loses_little():
    x = np.random.default_rng(2).normal(size=(2000, 16)) * np.linspace(1, 3, 16)
    codes, radius = multi_index.learned(x, 10, 0.97)
    assert np.allclose(codes.turn @ codes.turn.T, np.eye(16)) and 0 < radius <= 16
