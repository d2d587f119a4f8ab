"""Operator 8: recall against brute force, the index alone, edge cases."""

import numpy as np

from etholith.llm.common import table
from etholith.llm.neighbours import MultiIndex, nearest, op8


def brute(rows, asked, k=10):
    out = {}
    for i, q in asked:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in rows if j != i)
        out[i] = d[:k]
    return out


def test_recall(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
        want = brute(rows, [r for r in rows if r[0] % 100 == 0])
        got = op8(spark, sf).collect()
        vectors = dict(rows)
        assert len(got) == 10 * len(want)
        hits = 0
        for q, near in want.items():
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 11))
            assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
            for r in own:
                assert abs(r.score - np.sqrt(((np.array(vectors[r.vec_id]) - np.array(vectors[q])) ** 2).sum())) < 1e-12
            hits += len({j for _, j in near} & {r.vec_id for r in own})
        assert hits >= 0.9 * len(got)


def test_index_finds_every_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 3), dtype=np.uint64).astype(np.uint16)
    codes[250:] = codes[0] ^ (1 << rng.integers(0, 16, (250, 3))).astype(np.uint16)
    index = MultiIndex(codes)
    for radius in range(0, 49, 3):
        for q in codes[::50]:
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert (index.within(q, radius) == want).all()


def test_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(101)]
    rows += [(200, None), (300, [0.0] * 5), (400, [1.0, None, 0.0, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0, 0.0, 0.0]), (600, [float("inf")] * 5), (700, [1.0, 2.0]), (None, [1.0] * 5)]
    rows += [(k, rows[7][1]) for k in (800, 900, 901, 902)] + [(900, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = nearest(df, df.filter("vec_id % 100 = 0"), group=2)
    want = brute([r for r in rows if r[0] is not None and (r[0] <= 100 or r[0] >= 800)], [r for r in rows if r[0] in (0, 100, 800, 900)])
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == sorted((q, n + 1, j) for q, d in want.items() for n, (_, j) in enumerate(d))
    few = df.filter("vec_id < 4")
    assert nearest(few, few.filter("vec_id = 0")).count() == 3
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_many_neighbours(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(3000, 8)))]
    df = spark.createDataFrame(rows + [rows[0]], "vec_id long, embedding array<double>")
    got = nearest(df, df.filter("vec_id = 0"), k=2000)
    assert got.count() == 2000 and got.filter("vec_id = 0").count() == 0
    assert nearest(df, df.filter("vec_id = 0"), k=5000).count() == 2999
