"""Operator 9: held-out accuracy, the kernel against sets, edge cases."""

import numpy as np

from etholith.llm.common import table
from etholith.llm.language import KernelModel, fit, identify, op9, spectra


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op9(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in got if r.held_out and r.lang is not None]
    assert len(got) == 1000 and np.mean(held) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def grams(t, n):
    b = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in t)
    return {b[k : k + n] for k in range(len(b) - n + 1)}


def test_kernel_is_exact():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc dé1"), rng.integers(0, 60))).encode() for _ in range(300)] + [b"", b"a", b"ab"]
    model = KernelModel(texts, ["x" if k % 2 else "y" for k in range(len(texts))], list(range(10)))
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    got = model.kernel(np.frombuffer(b"".join(texts), np.uint8), at)
    for i, t in enumerate(texts):
        for j in range(10):
            want = 0
            for n in (1, 2, 3):
                a, b = grams(t, n), grams(texts[j], n)
                want += len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) / 3
            assert abs(got[i, j] - want) < 1e-4
    assert sum(len(o) for o, _ in spectra(np.frombuffer(b"ab", np.uint8), np.array([0, 0, 2]))) == 3


def test_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "123 !?", "de", 3), (4, "the end of the story", "en", 4), (5, "le chat est là", "fr", 5),
            (6, "le chien est ici", "fr", 6), (7, "the house of the king", "en", 7), (8, "the " * 20000, None, 8), (8, "the " * 20000, None, 8), (None, "le roi", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = fit(df)
    got = identify(df, model).collect()
    assert len(got) == 10
    assert [r.lang_pred for r in sorted(got, key=lambda r: str(r.doc_id)) if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.lang_pred in ("en", "fr") for r in got if r.doc_id not in (1, 2, 3))
    assert identify(df, fit(df.limit(0))).filter("lang_pred <> 'und' OR score > 0").count() == 0
    assert identify(df.limit(0), model).count() == 0


def test_rare_languages_keep_their_rows(spark):
    # 25 languages of 400 rows and five of 12, each of words of its own.
    rows = [(1000 * k + i, f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 5 + "abcdefgh"[i % 8], f"l{k:02}", 0) for k in range(30) for i in range(400 if k < 25 else 12)]
    rows += [(5_000_000, "same same", "l24", 0)] * 3000  # repeated rows take no room
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = fit(df, per_lang=200, total=300, landmarks=4)
    assert model.langs == [f"l{k:02}" for k in range(30)]
    got = identify(df, model).select("lang", "lang_pred").where("doc_id <> 5000000").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    assert np.mean([r.lang == r.lang_pred for r in got if r.lang >= "l25"]) > 0.99
