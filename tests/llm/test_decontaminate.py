"""Operator 10 against brute force."""

import hashlib
import re

import pytest

from etholith.llm.common import table
from etholith.llm.decontaminate import build_index, contamination, n_hit, op10, remove_contaminated, search

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        out.append((d, len(w), hit, found))
    return out


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = sorted(
        (d, n, len(h), len(f), hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest(), bool(h)) for d, n, h, f in brute(docs, items)
    )
    got = sorted(tuple(r)[:6] for r in op10(spark, sf).collect())
    assert got == want and any(r[5] for r in got)


CASES = [
    (0, "alpha beta gamma"), (1, None), (2, ""), (3, "x ALPHA, beta... gamma y"), (4, "one two three four five six seven eight nine ten eleven"),
    (5, "q one two three four five six seven eight nine ten eleven z " * 2), (6, "two three four five six seven eight nine ten eleven"),
    (7, "one two three four five six seven eight nine ten"), (3, "x ALPHA, beta... gamma y"), (None, "é ü alpha beta gamma"), (8, "w " * 5000),
    (9, "one two NEW three four five six seven eight nine ten"), (10, "zéro zéro"),
]
ITEMS = [(1, "Alpha beta gamma"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, "--"), (5, "zéro"), (20, "alpha beta gamma"),
         (6, "w w w")]


def proximity(text, slop):
    """Windows (of each item) that match some place within ``slop`` words and none exactly."""
    w, n = words(text), 0
    for _, item in ITEMS:
        v = words(item)
        for k in range(max(1, len(v) - 9) if v else 0):
            win = v[k : k + 10]
            off = [max(min((abs(p - s - i) for p, x in enumerate(w) if x == y), default=99) for i, y in enumerate(win)) for s in range(len(w) - len(win) + 1)]
            n += bool(off) and 0 < min(off) <= slop
    return n


@pytest.mark.parametrize("block,shard", [(8 << 20, 16 << 20), (40, 64)])
def test_cases(spark, block, shard):
    docs = spark.createDataFrame([(d, t, 0) for d, t in CASES], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, bench, slop=2, block_bytes=block, shard_bytes=shard).select("doc_id", "n_words", n_hit().alias("h"), "items", "spans", "n_near").collect()
    want = sorted(((d, n, len(h), sorted(f)) for d, n, h, f in brute(CASES, ITEMS)), key=str)
    assert sorted(((r.doc_id, r.n_words, r.h, sorted(r["items"])) for r in got), key=str) == want
    near = [(r.doc_id, r.n_near) for r in got]
    assert sorted(near, key=str) == sorted(((d, proximity(t, 2)) for d, t in CASES), key=str)
    assert dict(near)[9] == 1 and contamination(docs, bench, block_bytes=block).filter("n_near > 0").count() == 0
    clean = remove_contaminated(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 9]


def test_empty(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).agg({"n_words": "sum"}).first()[0] > 0
    index = build_index(docs)
    assert search(index, bench.withColumn("item_id", bench.item_id.cast("string"))).count() == len(CASES)
