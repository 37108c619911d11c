"""Clustering, top-k search and phrase counting against brute force, and on rows made of edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signpost.llm import centroid_clusters, collocations, nra_search

VECTORS = "vec_id long, embedding array<float>, label int, whole string, row int"


def vectors(spark, rows, parts=3):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "w", 2) for i, v in rows]
    return spark.createDataFrame(data, VECTORS).repartition(parts)


def usable(v, dim=None):
    return v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def brute_clusters(rows, k, rounds, dim, scale=1024):
    kept = [(i, whole(v, scale)) for i, v in rows if usable(v, dim)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cents = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            cents[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cents


def blobs(n, dim, seed, groups=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 3
    return [(i, (centers[i % groups] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


ODD = [
    (None, [0.5] * 8), (900, None), (901, [1.0] * 7), (902, [float("nan")] + [0.0] * 7), (903, [None] + [0.0] * 7),
    (904, [float("inf")] + [0.0] * 7), (905, [1e30] + [0.0] * 7), (906, []), (907, [0.25] * 8), (907, [0.25] * 8), (908, [0.25] * 8),
]


def test_clusters_equal_brute_force(spark):
    rows = blobs(300, 8, 1) + ODD
    found = centroid_clusters.cluster_vectors(vectors(spark, rows), k=8, rounds=10, dim=8, lead=3)
    expected, cents = brute_clusters([r for r in rows if r[0] != 905], 8, 10, 8)
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()), key=repr)
    assert got == expected and found.centroids.tolist() == cents
    shown = centroid_clusters.with_figures(found).collect()
    assert {r.inertia for r in shown} == {sum(d for _, _, d in expected)}
    for r in shown:
        assert r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_bounds_spare_most_distances(spark):
    found = centroid_clusters.cluster_vectors(vectors(spark, blobs(600, 8, 2)), k=8, dim=8, lead=4)
    assert 1 <= found.verified < 4


def test_bounds_stay_below_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**20), 2**20, (200, 16))
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0][:, :5]
    turn = centroid_clusters.Rotation(rng.normal(size=16) * 1000, axes)
    for scale in (1, 1000):
        c = x[:8] + rng.integers(-scale, scale + 1, (8, 16))
        exact = ((x[:, None, :] - c) ** 2).sum(axis=2)
        assert (centroid_clusters.lower_bounds(turn.of(x), turn.of(c)) <= exact).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [1.0] * 8)], [(None, [1.0] * 8), (2, [1.0] * 8), (2, [1.0] * 8)]])
def test_few_vectors_to_cluster(spark, rows):
    found = centroid_clusters.cluster_vectors(vectors(spark, rows), dim=8)
    kept = [r for r in rows if usable(r[1], 8)]
    assert [tuple(r) for r in centroid_clusters.with_figures(found).select("cluster", "distance", "inertia").collect()] == [(0, 0, 0)] * len(kept)


def brute_top(rows, is_query, k, scale=256):
    kept = [(i, whole(v, scale)) for i, v in rows if usable(v) and all(abs(x) < 2**27 / scale for x in v)]
    out = set()
    for qi, q in kept:
        if is_query(qi):
            scores = [(sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in kept if i != qi]
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
            out |= {(qi, r + 1, i, s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("dim,block,parts", [(8, 50, 3), (64, 400, 1), (2, 7, 2)])
def test_search_equals_brute_force(spark, monkeypatch, dim, block, parts):
    monkeypatch.setattr(nra_search, "BLOCK", block)
    rows = blobs(500, dim, dim, groups=4) + [(i, [1.0] * dim) for i in range(500, 540)]
    got = nra_search.top_k(vectors(spark, rows, parts), F.col("vec_id") % 20 == 0, k=5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == brute_top(rows, lambda i: i % 20 == 0, 5)


def test_search_defined_cases(spark):
    rows = ODD + [(0, [1.0] * 8), (0, [1.0] * 8), (2, []), (4, [2.0, -1.0]), (6, [-3.0] * 8)]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in nra_search.top_k(vectors(spark, rows), F.col("vec_id") < 10, k=3).collect()}
    # vectors that repeat the same id are one query, and the copies of 907 two partners
    assert got == brute_top(rows, lambda i: i is not None and i < 10, 3)
    assert nra_search.top_k(vectors(spark, []), F.col("vec_id") > 0).count() == 0


def test_lists_are_left_early():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 6)) * 100
    rows = x.astype(np.int32)
    block = nra_search.Block(np.arange(4000), np.argsort(rows, axis=0, kind="stable").T, rows)
    settled = []
    block.resolve = lambda w, r, s, f: settled.append(len(r))
    scores, found = np.full((20, 5), nra_search.NO_SCORE), np.full((20, 5), nra_search.NO_ID)
    block.search(rows[:20].astype(np.int64), np.arange(20), scores, found)
    assert len(settled) == 20 and max(settled) <= nra_search.FEW


def brute_phrases(rows, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cands = {p: c for p, c in f.items() if len(p) > 2 and c >= min_count}
    inside = {}
    for p, c in cands.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                key = (p[0], *p[i : i + k])
                inside[key] = max(inside.get(key, 0), c)
    rows = []
    for p, a in cands.items():
        if inside.get(p, 0) < a:
            cuts = []
            for k in range(1, len(p) - 1):
                left, right = f[p[: k + 1]], f[(p[0], *p[k + 1 :])]
                cuts.append((1000 * a * n[p[0]] // (left * right), k, left, right))
            s, _, left, right = min(cuts)
            rows.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], s))
    out = set()
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out |= {(lang, i + 1, *r[1:]) for i, r in enumerate(mine)}
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "É", "e\x01", "e\x00f", "\x00", "Ab", "z" * 50, "A", "of", "the"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", "\n", "!", ",x:"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*out, ("en", None), ("de", ""), (None, " \t. !"), ("fr", "alone"), ("en", "of the end " * 400), *[("es", "uno dos tres cuatro cinco seis")] * 30]


@pytest.mark.parametrize("entries,burst", [(1_000_000, 65_536), (40, 5), (300, 20)])
def test_phrases_equal_brute_force(spark, monkeypatch, entries, burst):
    rows = random_texts(entries, 150)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    docs = spark.createDataFrame([(i, t, la, 0, "k", "p") for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, key string, parts string")
    got = collocations.collocations(docs.repartition(3), min_count=8, top=60, entries=entries, burst=burst).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute_phrases(rows, 8, 60)


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "one two", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0


def test_containers_burst_and_spill():
    rng = np.random.default_rng(8)
    trie, total = collocations.Trie(burst=30), Counter()
    for _ in range(20):
        words = rng.zipf(1.4, (200, 5)).clip(1, 400).astype(np.int64)
        high = (words[:, 0] << 42) | (words[:, 1] << 21) | words[:, 2]
        low = (words[:, 3] << 21) | words[:, 4]
        trie.add(high, low, np.ones(200, np.int64))
        total.update(zip(high.tolist(), low.tolist(), strict=True))
    assert trie.entries == len(total) and len(trie.containers) > 20
    assert (np.diff(trie.starts) > 0).all()
    half = trie.spill(trie.entries // 2)
    rest = trie.spill(0)
    assert len(half[0]) >= len(total) // 2 and trie.entries == 0
    got = {(h, lo): n for part in (half, rest) for h, lo, n in zip(*(x.tolist() for x in part), strict=True)}
    assert got == total


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r may pass 64 bits; the division stays exact."""
    a, n, left, right = 123_456_789_012_345, 9_876_543_210_123_456, 7_654_321_098, 76_543
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations.pair_score("a", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (left * right)
