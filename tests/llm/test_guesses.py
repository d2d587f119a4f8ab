"""Operator 13 against plain matching and against all ways to cut a value."""

import hashlib
import re

import numpy as np
import pytest

from etholith.llm.common import table
from etholith.llm.guesses import DECADES, brute_force, guess_cost, op13, pieces, scan_secrets

SCHEMA = "doc_id long, text string, spans string"
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]


def plain(doc_id, text):
    """Base spans, with every letter of the key words spelt in both cases."""
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "apikey"))
    key += "|[aA][pP][iI]_[kK][eE][yY]"
    kinds = [("assign", f"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    listed = ",".join(x for _, _, x in sorted(found))
    return (doc_id, *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()), listed


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table holds none
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op13(spark, sf).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(plain(*d)[0] for d in docs)
    texts = dict(docs)
    for r in got:
        base = plain(r.doc_id, texts[r.doc_id])[1].split(",")
        assert [s for s in r.spans.split(",") if not s.startswith("guess:")] == base or not r.spans
        assert r.spans.count("guess:") == r.n_guess
    assert sum(r.n_hex for r in got) > 0


def test_cases(spark):
    key = "AKIA" + "ABCD1234" * 2
    texts = [
        None, "", " ", "ſecret: aaaaaaa toKen=abcdef", "PassWord: 'abc' password = \"abcdef\" API_KEY=x/y+z= apikey:12345", "secret: token = abcdefgh token=a\u00e9",
        f"é {key} AKIA1 {key}x", "0123456789abcdef01234567 0123456789abcdef0123456 g0123456789abcdef01234567g", f"token = \"{key}\" " + "f" * 30,
        "x" * 300_000 + " token: " + "Ab1" * 20000, "токен token=ab.cd-ef_gh",
    ]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[6])]
    got = scan_secrets(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == sorted((plain(*r)[0] for r in rows), key=str)
    assert got.columns.count("spans") == 1 and scan_secrets(got.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,value",
    [
        ("pwd: x9$Kq!w2", "x9$Kq!w2"),
        ('"password": "Tr0b4d&r#3xZ"', "Tr0b4d&r#3xZ"),
        ("Authorization: Bearer eyJhbGci.OiJIUzI1", "eyJhbGci.OiJIUzI1"),
        ("see postgres://bob:k8#Vt2Lq9z@db/x ok", "k8#Vt2Lq9z"),
        ("access-key => 7hGq2LmZ81wP, and", "7hGq2LmZ81wP"),
    ],
)
def test_values_in_context(spark, text, value):
    (row,) = scan_secrets(spark.createDataFrame([(1, "é " + text)], "doc_id long, text string")).collect()
    (span,) = [s.split(":") for s in row.spans.split(",") if s.startswith("guess")]
    assert ("é " + text)[int(span[1]) : int(span[2])] == value


def test_cheap_values_stay(spark):
    texts = ["pwd: P@ssw0rd1", "pass: qwertyuiop", "passcode: 1999-12-31", "pwd=aaaaaaaaaaaaaaaaaaaa", "token: Großeltern", "pass: Unterschied.", "credentials: abcabcabc", "bearer of news", "http://a/b:c", "compass: x9$Kq!w2"]
    rows = scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("n_guess > 0").collect()
    assert rows == []


def test_least_over_all_cuts():
    rng = np.random.default_rng(3)
    parts = ["password", "P4ss", "1987", "2001-02-03", "aaa", "abab", "qwe", "asdf", "X", "9", "#", "letter", "é"]
    for _ in range(200):
        value = "".join(rng.choice(parts, rng.integers(1, 4)))[:18]
        edges = [(i, i + 1, brute_force(c)) for i, c in enumerate(value)] + [(s, e, d) for s, e, _, d in pieces(value)]

        def least(i, value=value, edges=edges):
            return 0.0 if i == len(value) else min(d + least(e) for s, e, d in edges if s == i)

        assert abs(guess_cost(value) - least(0)) < 1e-9
    assert guess_cost("") == 0 and guess_cost("password") == 0 and guess_cost("x9$Kq!w2") > DECADES > guess_cost("qwertyuiop")
