"""What the bounds of the Voronoi join leave out, and vectors of any finite size."""

from collections import Counter

import numpy as np

from quarterbook.llm import voronoi_knn as vk

SCHEMA = "vec_id long, embedding array<double>, score long, rank string, cell int, query_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    most = (1 << 63) - 1
    out = Counter()
    for q in {i for i, _ in whole if i % every == 0}:
        asks = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v, strict=False)), i) for i, v in whole if i != q)[:k]
        out.update((q, n, i, max(-most - 1, min(most, -s))) for n, (s, i) in enumerate(best, 1))
    return out


def clustered(n, groups, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (groups, 16)) * 10
    return [(i, (centres[i % groups] + rnd.normal(0, 0.05, 16)).round(3).tolist()) for i in range(n)]


def test_groups_are_sent_what_they_need(spark):
    rows = clustered(3000, 31, 1)
    groups, share = vk.share_sent(table(spark, rows))
    assert groups > 5 and share < 0.2
    assert Counter(tuple(r) for r in vk.top_k(table(spark, rows)).collect()) == brute(rows)


def test_chunks_and_parts_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("CHUNK", 50), ("SEEDS", 2), ("PIVOTS", 7)):
        monkeypatch.setattr(vk, name, value)
    rows = clustered(900, 4, 2) + [(i, [float(x) for x in np.random.default_rng(i).normal(0, 1, 16).round(2)]) for i in range(1000, 1200)]
    assert Counter(tuple(r) for r in vk.top_k(table(spark, rows)).collect()) == brute(rows)


def test_vectors_of_any_finite_size(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(0, 1, 4).round(2).tolist()) for i in range(120)]
    rows += [(200, [1e30, 1.0, -2.0, 0.5]), (201, [1e30, 1.5, -2.0, 0.5]), (202, [-1e38, 0.0, 1.0, 2.0]), (250, [3e7, 2e7, 0.0, 1.0]), (251, [3e7, 2e7, 0.0, 1.0]), (252, [9e15, 1.0, 0.0, 0.0]), (253, [9e15, 1.01, 0.0, 0.0])]
    assert Counter(tuple(r) for r in vk.top_k(table(spark, rows)).collect()) == brute(rows)
    only = [(0, [0.0, 0.0]), (1, [0.0]), (2, [5.0, 1.0]), (50, [1e200, 1e-200])]
    assert Counter(tuple(r) for r in vk.top_k(table(spark, only)).collect()) == brute(only)
    odd = table(spark, [*only, (100, [float("inf"), 0.0]), (150, None), (None, [1.0, 1.0]), (3, [1e307 * 10, 0.0])])
    assert {r.query_id for r in vk.top_k(odd).collect()} == {0, 50}
