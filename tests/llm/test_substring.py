"""Operator 1 against a dictionary of all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from etholith.llm.common import table
from etholith.llm.substring import mark_repeats, op1, repeated_windows

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, width):
    words = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 35)]
    got = sorted((tuple(r) for r in op1(spark, sf).collect()), key=str)
    assert got == want and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [3, 10**6])
def test_cases(spark, hot):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 40, 400)]
    texts = [None, "", " \t\n", "a", "a " * 200, " ".join(base), " ".join(base[40:90]), "x " + "\n".join(base[300:]) + " y",
             "a " * 36, " ".join(base[100:134]), " ".join(base[100:135]), "é z " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "q " * 50), (7, "other")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    for width in (35, 12):
        got = sorted((tuple(r) for r in mark_repeats(df, width, hot=hot).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
        assert got == brute(rows, width)


def test_empty(spark):
    assert mark_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_alone():
    rng = np.random.default_rng(0)
    for _ in range(20):
        segs = [rng.integers(1, 4, rng.integers(6, 15)) for _ in range(30)]
        copies = rng.integers(1, 3, 30) * 0 + 1
        size = np.array([len(s) for s in segs])
        seq = np.concatenate([np.append(s, 0) for s in segs])
        first = np.cumsum(size + 1) - size - 1
        flags = repeated_windows(seq, first, size, copies, 6)
        seen = Counter(tuple(s[k : k + 6]) for s in segs for k in range(len(s) - 5))
        for s, f in zip(segs, flags, strict=True):
            assert [bool(f >> k & 1) for k in range(len(s) - 5)] == [seen[tuple(s[k : k + 6])] > 1 for k in range(len(s) - 5)]
