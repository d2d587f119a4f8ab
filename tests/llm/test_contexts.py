"""Operator 7: base scores by counting, the weighting against its definition, edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from etholith.llm.common import table
from etholith.llm.contexts import log_gamma, op7, scores


def tokens(t):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(rows):
    """rows: (text, learned) -> (n_tokens, n_known, N, base)."""
    c = Counter()
    for t, learned in rows:
        if learned:
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in ([*tokens(t), None] for t, _ in rows)]


def weighted(rows, depth):
    """The tree by its definition: dictionaries of counts, recursion over depths."""
    zero_one = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def stream(t):
        s = "".join(w + " " for w in tokens(t)).encode() + b"\n"
        padded = b"\n" * depth + s
        for k in range(len(s)):
            yield padded[k : k + depth], s[k]

    def bits(byte):
        for i in range(8):
            yield (1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1

    for t, learned in rows:
        if learned:
            for ctx, byte in stream(t):
                for node, bit in bits(byte):
                    for d in range(depth + 1):
                        zero_one[ctx[depth - d :], node][bit] += 1
                        if d:
                            children[ctx[depth - d + 1 :], node].add(ctx[depth - d :])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def pw(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*zero_one.get((ctx, node), (0, 0)))
            if len(ctx) == depth:
                memo[ctx, node] = own
            else:
                below = sum(pw(c, node) for c in children.get((ctx, node), ()))
                memo[ctx, node] = math.log(0.5) + np.logaddexp(own, below)
        return memo[ctx, node]

    def predict(ctx, node, bit, d=0):
        own_ctx = ctx[depth - d :]
        a = zero_one.get((own_ctx, node), (0, 0))
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == depth:
            return own
        stop = math.exp(math.log(0.5) + kt(*a) - pw(own_ctx, node))
        return stop * own + (1 - stop) * predict(ctx, node, bit, d + 1)

    return [sum(math.log10(predict(ctx, node, bit)) for ctx, byte in stream(t) for node, bit in bits(byte)) for t, _ in rows]


def test_base_on_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    want = base([(t, k) for (_, t), k in zip(docs, learned, strict=True)])
    got = {r.doc_id: r for r in op7(spark, sf).collect()}
    assert len(got) == len(docs)
    for (i, _), k, (n, known, total, b) in zip(docs, learned, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not k, n, known, total)
        assert math.isclose(r.base_score, b, rel_tol=1e-9)


def test_held_out_beats_base(spark):
    """With little text a table of whole words does better; from ten thousand documents on the tree does."""
    held = [r for r in op7(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_definition(spark, depth):
    rng = np.random.default_rng(depth)
    texts = [" ".join("".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(rng.integers(0, 40))) for _ in range(12)]
    texts += [None, "", "ABA abA", "ABA abA", "zzz unseen \x7f ÿ", " \n"]
    rows = [(t, k % 3 != 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, y, "x") for k, (t, y) in enumerate(rows)], "doc_id long, text string, y boolean, score string")
    for size, group in ((1 << 25, 100_000), (150, 100_000), (1 << 25, 3), (150, 0)):
        got = sorted(scores(df, F.col("y"), depth, size, group).collect(), key=lambda r: r.doc_id)
        for r, s, (n, known, total, b) in zip(got, weighted(rows, depth), base(rows), strict=True):
            assert math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.base_score, b, rel_tol=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)


def test_probabilities_sum_to_one(spark):
    rows = [("abab ab ba", True), ("ab", True)] + [(None, False)]
    texts = rows + [("a" + chr(c), False) for c in range(33, 127)]
    assert sum(10**s for s in weighted(texts, 2)[3:]) < 1


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "w " * 60000)], "doc_id long, text string")
    assert scores(df, F.lit(True)).count() == 3
    assert scores(df, F.lit(False)).filter("train_tokens <> 0 OR n_known <> 0").count() == 0
    assert scores(df.limit(0), F.lit(True)).count() == 0
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e3, 1e7]])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
