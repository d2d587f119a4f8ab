"""Operator 2: held-out accuracy, whole texts, edge cases, gradient against differences."""

import numpy as np

from etholith.llm import quality
from etholith.llm.common import table
from etholith.llm.quality import ConvNet, chunk_bytes, classify, cut, op2


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op2(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.4


def test_chunks_cover_text():
    for n in (0, 1, 7, 8, 9, 511, 518, 519, 5000):
        data = (np.arange(n) % 255 + 1).astype(np.uint8)
        start, left, first = cut(data, np.array([0, n]))
        rows = chunk_bytes(data, start, left)
        seen = np.zeros(n, bool)
        for s in start:
            seen[s : s + quality.SPAN] = True
        assert seen.all() and len(rows) == first[-1] >= 1
        whole = np.append(data, np.zeros(quality.SPAN, np.uint8))
        assert all((r[: max(0, n - s)] == whole[s : s + quality.SPAN][: max(0, n - s)]).all() for r, s in zip(rows, start, strict=True))


def test_pooling_is_the_maximum():
    net, rng = ConvNet(), np.random.default_rng(0)
    rows = rng.integers(0, 256, (3, quality.SPAN)).astype(np.uint8)
    got = net.pooled(rows)
    for r, g in zip(rows, got, strict=True):
        act = [net.embed[r[p : p + 8]].ravel() @ net.filters + net.bias for p in range(0, 512, 2)]
        assert np.allclose(g, np.maximum(np.max(act, axis=0), 0), atol=1e-4)


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "a", 0.3), (3, "a", 0.3), (None, "b " * 9000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert classify(docs.limit(0), labels).count() == 0
    assert classify(docs, labels.limit(0)).count() == 5


def test_repeated_ids_and_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(120)
    other = docs.filter("doc_id % 3 = 0").selectExpr("doc_id", "reverse(text) AS text")
    docs = docs.union(other).union(docs.filter("doc_id % 7 = 0"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality").union(docs.filter("doc_id % 5 = 0").selectExpr("doc_id", "1 AS quality"))
    ways = [docs.repartition(1), docs.repartition(7), docs.orderBy(docs.text.desc())]
    found = [sorted((r.doc_id, r.text, r.score) for r in classify(way, labels, sample=40).collect()) for way in ways]
    assert all([r[:2] for r in rows] == [r[:2] for r in found[0]] for rows in found)
    scores = np.array([[r[2] for r in rows] for rows in found])
    assert abs(scores - scores[0]).max() < 1e-6 and len(set(scores[0].round(4))) > 50  # sums of single floats may differ by block
