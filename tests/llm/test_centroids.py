"""Operator 12 against plain rounds in Python integers, and its bounds alone."""

import hashlib
import math

import numpy as np
import pytest

from etholith.llm.centroids import Pivots, assign, cluster, distances, op12
from etholith.llm.common import table

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        c = [[sum(x) // len(part) for x in zip(*part, strict=True)] if (part := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, j, d in last:
        per[j] = per.get(j, 0) + d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=str)


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted((tuple(r) for r in op12(spark, sf).select(COLUMNS).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_cases(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 5) / 1024).tolist()) for i in range(60)]  # many ties
    rows += [(60, None), (61, []), (62, [1.0] * 4), (63, [1.0, None, 1.0, 1.0, 1.0]), (64, [float("nan")] * 5), (65, [float("-inf")] * 5), (66, [0.0] * 5), (None, [-0.5] * 5)]
    rows += [rows[3]] * 40 + [(3, [9.0] * 5)]
    df = spark.createDataFrame([(i, v, -1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(parts)
    for k in (8, 3, 1, 200):
        got = sorted((tuple(r) for r in cluster(df, k, 4, dim=5).select(COLUMNS).collect()), key=str)
        assert got == brute(rows, k, 4, 5)
    assert cluster(df.limit(0)).count() == 0 and cluster(df).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    for big in (8, 1 << 12, 1 << 26):
        middle = rng.integers(-big, big, (8, 64))
        v = middle[rng.integers(0, 8, 3000)] + rng.integers(-big // 8, big // 8 + 1, (3000, 64))
        pivots = Pivots(v[:8])
        cached = pivots.measure(v)
        for c in middle:
            assert (pivots.below(cached, pivots.measure(c[None])[0]) <= distances(v, c)).all()
        own, d, checks = assign(v, cached, middle, pivots)
        every = np.stack([distances(v, c) for c in middle], axis=1)
        assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and checks < 0.8 * every.size
    point = np.arange(64)[None]
    assert (Pivots(np.repeat(point, 3, axis=0)).below(np.zeros((1, 3)), np.zeros(3)) == 0).all()  # equal pivots bound nothing
