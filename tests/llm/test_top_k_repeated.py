"""Top-k where rows of a query's own id are repeated more than k + 1 times."""

from collections import Counter

import numpy as np

from quarterbook.llm.voronoi_knn import top_k

SCHEMA = "vec_id long, embedding array<float>"


def test_own_rows_promise_nothing(spark):
    rows = [(0, [1.0, 0.0])] * 7 + [(i, [0.5, 0.0]) for i in range(1, 6)]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()] == [(0, k, k, 256 * 128) for k in range(1, 6)]


def test_repeated_rows_are_brute_force(spark):
    rnd = np.random.default_rng(4)
    vector = lambda: [float(x) for x in rnd.normal(0, 1, 4).round(2)]
    rows = [(i, vector()) for i in range(1, 300)]
    # ids of queries with many rows, of one vector and of several around it, and a repeated candidate
    rows += [(0, [3.0, 0.0, 0.0, 0.0])] * 9 + [(50, vector()) for _ in range(12)] + [(100, [2.0 + i / 100, 2.0, 0.0, 0.0]) for i in range(10)] + [(7, [2.0, 1.0, 0.0, 0.0])] * 8
    whole = [(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist())) for i, v in rows]
    want = Counter()
    for q in {i for i, _ in whole if i % 50 == 0}:
        asks = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v, strict=True)), i) for i, v in whole if i != q)[:5]
        want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    assert Counter(tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA)).collect()) == want
