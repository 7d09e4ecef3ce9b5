"""Exact top-k against all products."""

import math
import random

from pyspark.sql import functions as F

from loomstone.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, rank int, score long"


def brute(rows, k, scale=64):
    own = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((vec_id, [math.floor(scale * x) for x in vector]))
    out = []
    for q in {i for i, _ in own if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in own if i == q for c, w in own if c != q and len(w) == len(v))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in pivots.top_k(df, F.col("vec_id") % 20 == 0, **options).collect())


def test_equals_all_products(spark):
    rng = random.Random(1)
    unit = lambda: rng.choice([-1.0, -0.5, -0.25, 0.0, 0.125, 0.5, 1.0])
    rows = [(i, [unit() + (3.0 if i % 3 else 0.0) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # a hot group of equal vectors: ties by id
    rows += [(2000 + i, [unit() for _ in range(5)]) for i in range(60)]  # another length
    rows += [(3000, None), (3020, [1.0, None] + [0.0] * 6), (3040, [float("nan")] + [0.0] * 7), (3060, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (3080, [])]
    rows += [rows[0], rows[0], (20, [0.0] * 8), (20, [9.0] * 8), rows[7], rows[7], (9, [8.0] * 8)]
    want = brute(rows, 20)
    assert run(spark, rows, k=20) == want
    assert run(spark, rows, k=20, pivots=3, sample=40, wave=16) == want  # several waves, few pivots
    assert run(spark, rows, k=20, pivots=1, sample=1) == want


def test_far_outlier_does_not_break_bounds(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)] + [(999, [30000.0, -30000.0, 1.0, 0.0])]
    assert run(spark, rows, k=5) == brute(rows, 5)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])], k=20) == [(0, 1, 1, 8192)]
    assert run(spark, [], k=20) == []


def test_bounds_spare_candidates():
    """Where vectors lie in clusters, most candidates are never evaluated."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (8, 6))
    x = (centres[rng.integers(0, 8, 4000)] + rng.integers(-5, 6, (4000, 6))).astype(np.int64)
    norms = (x**2).sum(1).astype(float)
    chosen = pivots.choose_pivots(x[:500].tolist(), 16)[6]
    dists = pivots.distances(x.astype(float), norms, chosen)
    best = pivots.Best(np.arange(4000), np.full(4000, np.iinfo(np.int64).min), 20)
    seen = []
    add = best.add
    best.add = lambda at, c, s: (seen.append(s.size), add(at, c, s))
    row = np.arange(4000)
    for q in range(0, 200, 20):
        pivots._block(best, np.array([q]), {"row": row, "v": x, "norm": norms, "dists": dists}, row, x, norms, dists)
    assert sum(seen) < 10 * 4000 * 0.6
