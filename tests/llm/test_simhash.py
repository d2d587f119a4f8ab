"""Operator 5 against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from etholith.llm.common import table
from etholith.llm.simhash import keep_first, links, near_duplicates, op5


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, radius=4):
    """items: (label, fingerprint); the least label reachable, by propagation over all pairs."""
    f = np.array([x for _, x in items], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f) <= radius
    label = np.array([i for i, _ in items])
    while True:
        new = np.where(near, label, label.max()).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_whole_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    items = [(i, fingerprint(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(items, classes(items), strict=True)]
    assert sorted(tuple(r) for r in op5(spark, sf).collect()) == want
    assert len({c for *_, c in want}) < len(want)


@pytest.mark.parametrize("bucket", [2, 9, 1 << 15])
def test_links_connect(spark, bucket):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2**63, 50).tolist())
    for center in list(fps)[:6]:
        for _ in range(25):
            x = center
            for b in rng.integers(0, 63, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    found = links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=bucket).collect()
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert (r.a ^ r.b).bit_count() <= 4
        a, b = sorted((root(r.a), root(r.b)))
        parent[b] = a
    want = classes([(f, f) for f in fps])
    assert len({root(f) for f in fps}) == len(set(want))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_crowded_buckets_at_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 63, k))) for c in rng.integers(0, 2**63, 8) for k in range(8) for _ in range(12)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a bucket is crowded only where it outgrows a batch
    try:
        found = links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, bucket=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in found:
        assert (r.a ^ r.b).bit_count() <= radius
        a, b = sorted((root(r.a), root(r.b)))
        parent[b] = a
    assert len({root(f) for f in fps}) == len(set(classes([(f, f) for f in fps], radius)))


def test_cases(spark):
    texts = [None, "", " \n", "one", "ONE", "one two three", "One two THREE", "one two three four five", "word " * 3000, "é ü", None]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(3, "one", 2.5), (None, "one", 0.5)], "doc_id long, text string, fp double")
    got = {(r.doc_id, r.content): r for r in near_duplicates(df).collect()}
    rows = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.values()), key=str)
    items = [(i, fingerprint(t)) for i, t in enumerate(texts)]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(items, classes(items), strict=True)}
    for i, f, c in rows:
        assert (f, c) == (want[i] if i is not None else want[3])
    assert near_duplicates(df).count() == 13
    kept = keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(c for _, c in want.values()))
    assert near_duplicates(df.limit(0)).count() == 0


def test_radius_out_of_reach(spark):
    nodes = spark.createDataFrame([(0,), (31,)], "fp long")
    for radius in (5, -1):
        with pytest.raises(ValueError):
            links(nodes, radius)
