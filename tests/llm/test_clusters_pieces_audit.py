"""Clustering, pieces and the filter audit against the library, brute force and odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from buildlens.llm import centroids, filter_audit, pieces, queries

MODEL = public_tokenizers.path(queries.PIECES)
DOCS = "doc_id long, text string, lang string, mask string, ids string, decoded string, first boolean, n long"


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(pieces.read_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def assert_same(coder, library, texts):
    found = coder.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        expected = library.encode(text, add_eos=True)
        assert ids.tolist() == expected, text[:200]
        assert coder.decode(ids) == library.decode(expected)


# -- pieces --------------------------------------------------------------------------
def test_pieces_equal_the_library_on_odd_texts(coder, library):
    texts = ["", " ", "a  b", "  x", "\tq\n", "▁a", "﻿é", "\x00a", "ﬁ ½", "中文字", "a </s> b <s>",
             "a ", "<0x41>", "🙂", "▁▁", "​ a", "▁" * 100, "x" * 5000, "\U0010ffff", "퟿"]
    for n in range(100):
        texts += [" " * n, " " * n + "word", "x" + " " * n + "中" + " " * n]
    assert_same(coder, library, texts)


@pytest.mark.parametrize("seed", range(6))
def test_pieces_equal_the_library_on_random_texts(coder, library, seed):
    rand = random.Random(seed)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    ranges = [(1, 0x7f), (0x80, 0x2fff), (0x3000, 0xd7ff), (0xe000, 0x10ffff)]
    texts = ["".join(rand.choice(known) for _ in range(rand.randint(0, 40))) for _ in range(150)]
    texts += ["".join(rand.choice("abthe ") for _ in range(rand.randint(0, 60))) for _ in range(150)]
    texts += ["".join(chr(rand.randint(*rand.choice(ranges))) for _ in range(30)) for _ in range(50)]
    texts += ["".join(rand.choice(["  ", "=", "==", "-", "a", "ab", "in", "er", "the", "▁"])
                      for _ in range(rand.randint(0, 60))) for _ in range(150)]
    assert_same(coder, library, texts)


def test_very_long_texts_are_encoded_whole(coder, library):
    rand = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["".join(rand.choice("abcdefghij") for _ in range(rand.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rand.choice(words) for _ in range(3_500_000))
    assert len(text) > 20_000_000
    assert_same(coder, library, [text])
    assert_same(coder, library, [" " * 300_000, "ab" * 100_000, "中文" * 50_000,
                                 "".join(rand.choice(letters) for _ in range(300_000))])


def test_decoding_equals_the_library_on_any_ids(coder, library):
    rand = random.Random(2)
    for _ in range(500):
        ids = [rand.randrange(32000) if rand.random() < 0.6 else rand.randint(0, 258)
               for _ in range(rand.randint(1, 12))]
        assert coder.decode(np.array(ids)) == library.decode(ids), ids


def test_a_forgetful_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "BLOCK", 5)
    small = pieces.Pieces(pieces.read_model(MODEL))
    for _ in range(3):
        assert_same(small, library, ["the cat sat on the mat again and again", "", "one more  text"])


def test_runs_are_cut_only_where_the_vocabulary_allows_it():
    kinds, texts = "u" + "n" * 6, ["<unk>", "▁", "a", "▁▁", "▁▁▁", "▁▁a", "aa"]
    odd = pieces.Pieces(pieces.Vocabulary(texts, [0.0, -9.0, -5.0, -9.0, -9.0, -3.0, -4.0], kinds, 0))
    assert odd.run == 0


def test_pieces_query_equals_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]], add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, library):
    rows = [(1, None, None, "m", "i", "d", True, 1), (2, "", "en", None, None, None, None, None),
            (3, "two  words", "en", "m", "i", "d", False, 2), (3, "two  words", "en", "m", "i", "d", False, 2),
            (None, "\n", None, None, None, None, None, None)]
    found = pieces.encode_and_decode(spark.createDataFrame(rows, DOCS), MODEL)
    assert found.columns == ["doc_id", "text", "lang", "mask", "first", "n", "ids", "decoded"]
    assert sorted((r["text"] or "", r["ids"]) for r in found.collect()) == sorted(
        (t or "", library.encode(t or "", add_eos=True)) for _, t, *_ in rows)
    assert pieces.encode_and_decode(spark.createDataFrame([], DOCS), MODEL).collect() == []


# -- clustering ------------------------------------------------------------------------
def brute_nearest(vector, centers):
    return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), i) for i, c in enumerate(centers))[::-1]


def brute_clusters(rows, count=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "x"
    centers = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:count]]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(brute_nearest(v, centers)[0], []).append(v)
        centers = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old
                   for c, old in enumerate(centers)]
    return sorted(((i, *brute_nearest(v, centers)) for i, v in kept), key=str), centers


@pytest.mark.parametrize("seed", range(20))
def test_tree_finds_what_comparing_all_finds(seed):
    rand = np.random.default_rng(seed)
    width, high = int(rand.integers(1, 5)), int(rand.integers(1, 6))
    # few values: equal centroids and ties everywhere
    centers = rand.integers(-high, high, (int(rand.integers(1, 40)), width))
    vectors = rand.integers(-high, high, (200, width))
    best, square, computed = centroids.VantageTree(centers).nearest(vectors)
    assert [(int(b), int(s)) for b, s in zip(best, square, strict=True)] == [
        brute_nearest(v.tolist(), centers.tolist()) for v in vectors]
    assert computed <= len(vectors) * len(centers)


def test_tree_skips_centroids_of_far_groups():
    rand = np.random.default_rng(0)
    groups = rand.integers(-10**6, 10**6, (8, 16))
    centers = np.concatenate([groups + rand.integers(-5, 5, (8, 16)) for _ in range(8)])
    vectors = np.concatenate([groups + rand.integers(-5, 5, (8, 16)) for _ in range(20)])
    *_, computed = centroids.VantageTree(centers).nearest(vectors)
    assert computed < 0.5 * len(vectors) * len(centers)


def test_numbers_of_any_size_are_exact():
    rand = random.Random(5)
    centers = [[rand.randint(-10**150, 10**150) for _ in range(3)] for _ in range(9)]
    centers.append([x + 1 for x in centers[0]])
    vectors = [[x + rand.randint(-1, 1) for x in rand.choice(centers)] for _ in range(60)]
    tree = centroids.VantageTree(centroids.as_integers(centers, 3))
    best, square, _ = tree.nearest(centroids.as_integers(vectors, 3))
    assert list(zip(best.tolist(), square.tolist(), strict=True)) == [brute_nearest(v, centers) for v in vectors]
    for n in (0, 5, -5, 10**40, -10**40 + 3):
        assert sum(d << centroids.DIGIT * p for p, d in centroids.digits(n)) == n


def test_clustering_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected, centers = brute_clusters(rows)
    got = queries.op11_centroid_clustering(spark, sf_dir).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == expected
    inertia = sum(d for *_, d in expected)
    for r in got:
        assert r["inertia"] == inertia
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(
            ",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_clustering_of_odd_vectors(spark):
    rand = random.Random(9)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [rand.uniform(-2, 2) for _ in range(64)], i) for i in range(40)]
    rows += [(3, rows[3][1], 0), (None, rows[5][1], 0), (50, None, 0), (51, [], 0), (52, [1.0] * 63, 0),
             (53, [1.0] * 65, 0), (54, [None] + [1.0] * 63, 0), (55, [nan] + [1.0] * 63, 0),
             (56, [inf] + [1.0] * 63, 0), (57, [0.0] * 64, 0), (58, [-0.0] * 64, 0), (58, [-1 / 64] * 64, 0)]
    schema = "vec_id long, embedding array<double>, cluster int"
    got = centroids.clusters_with_inertia(spark.createDataFrame(rows, schema)).collect()
    expected, _ = brute_clusters([r[:2] for r in rows])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == expected
    few = centroids.clusters_with_inertia(spark.createDataFrame(rows[:5], schema)).collect()
    assert sorted(r["cluster"] for r in few) == [0, 1, 2, 3, 4] and {r["inertia"] for r in few} == {0}
    assert centroids.clusters_with_inertia(spark.createDataFrame([], schema)).collect() == []
    # squares beyond a long: no distance, and no sum with it
    huge = [(i, [1e18 * (i + 1) * (-1) ** i] * 64, 0) for i in range(20)]
    got = centroids.clusters_with_inertia(spark.createDataFrame([*rows[:20], *huge], schema)).collect()
    expected, _ = brute_clusters([r[:2] for r in [*rows[:20], *huge]])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(
        ((i, c, d if d < 2**63 else None) for i, c, d in expected), key=str)
    assert {r["inertia"] for r in got} == {None}


# -- filter audit -----------------------------------------------------------------------
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    judged = []
    for i, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
                 i is not None and i > first[text]]
        judged.append((lang or "", {c for c, f in zip("ABCDE", fails, strict=True) if f},
                       i is not None and i in good, i is not None and i in toxic))
    rows, shapley = [], {}
    for part in {p for p, *_ in judged}:
        mine = [x for x in judged if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                fails = [x for x in mine if c in x[1]]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone),
                             sum(x[1] == {c} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_intervals_are_the_orders_that_remove_a_mask_at_a_step():
    ends = filter_audit.removal_differences(5).cumsum(axis=2)[:, :, :-1]
    for rank, order in enumerate(itertools.permutations(range(5))):
        assert filter_audit.lehmer_rank(order, 5) == rank
        for mask in range(32):
            step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
            assert ends[mask, :, rank].tolist() == [int(s == step) for s in range(5)]


def test_audit_of_odd_rows_against_brute_force(spark):
    rand = random.Random(4)
    texts = [None, "", " \n", "a B", "Ünïcödé ſ İ 日本語", "a # b", "word " * 250, "x" * 50_000,
             " ".join(map(str, range(300))), " ".join(map(str, range(300))) + " & " + "A" * 90]
    docs = [(rand.choice([None, *range(30)]), rand.choice(texts), rand.choice([None, "", "en", "de"]))
            for _ in range(300)]
    docs += [(7, "a B", "en")] * 3
    labels = [(i, rand.choice([None, 0, 1]), rand.choice([None, 0, 1])) for i in [None, None, *range(25), 3, 4]]
    frame = spark.createDataFrame([(*d, "m", "i", "d", True, 1) for d in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).collect() == []
    assert filter_audit.audit(frame, marks.limit(0)).agg({"good_lost": "sum"}).collect()[0][0] == 0


def test_audit_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", "quality", "toxic").collect()]
    got = queries.op13_filter_audit(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(docs, labels)
