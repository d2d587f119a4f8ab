"""The pipeline against plain Python versions of its stages."""

from collections import Counter

import pytest

import corpus_pipeline
from etholith.llm import quality
from etholith.llm.common import table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import shares
from tests.llm.test_simhash import classes, fingerprint
from tests.llm.test_substring import brute as repeats

pytestmark = pytest.mark.filterwarnings("ignore")


def plain(spark, docs, sf):
    """doc_id -> text after four stages; scores come from the fitted network."""
    rejected = {r.doc_id for r in quality.classify(docs, table(spark, sf, "labels")).filter("predicted = 0").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in rejected)
    label = classes([(i, fingerprint(t)) for i, t in rows])
    rows = [r for r, c in zip(rows, label, strict=True) if r[0] == c]
    kept = {i: k for i, _, n, k in repeats(rows, 35) if n}
    rows = [(i, kept.get(i, t)) for i, t in rows]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    return {d: t for (d, t), (_, _, h, _) in zip(rows, contaminated(rows, items), strict=True) if not h}


def test_run(spark, sf):
    docs = table(spark, sf, "documents")
    want = plain(spark, docs, sf)
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(want) < docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = Counter()
    for d, t in want.items():
        size[source[d]] += len((t or "").split())
    target = shares(size)
    copies = Counter(r.doc_id for r in out)
    for r in out:
        assert r.text == want[r.doc_id] and r.n_chars == len(r.text)
    for d in want:
        s = source[d]
        rate = target[s] / size[s] if size[s] else 0
        assert copies[d] in (int(rate), int(rate) + 1)
    assert set(copies) <= set(want) and {(r.doc_id, r.copy) for r in out} == {(d, k) for d in copies for k in range(copies[d])}


def test_columns_and_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").limit(30)
    odd = spark.createDataFrame([(10_000, None, None, None, None), (None, "", "en", "src0", 0), (10_001, "w " * 4000, "en", "é", 8000)], docs.schema)
    docs = docs.union(odd).union(odd)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (k == 4 or len(docs.columns) == 5)
        assert docs.limit(0).count() == 0
        docs = corpus_pipeline.stored(docs)
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
