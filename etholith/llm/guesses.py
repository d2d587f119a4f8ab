"""Operator 13: secret scan with the guess cost of values in a credential context.

Three patterns give the base spans (an assigned credential, an access key, a long hexadecimal string).
Beyond them every value that a credential context names (``pwd: ...``, ``Authorization: Bearer ...``,
``scheme://user:...@host``) is priced as an attacker would guess it: the value is cut into common words
(also in capitals and with letters replaced by digits), unknown words, dates, repeats, keyboard walks and
brute-forced characters so that the product of their guesses is least, by dynamic programming over its
characters. A value of at least ``DECADES`` powers of ten that no base span holds becomes a span of kind
``guess``. Prose after such a context stays: a word costs no more than the words of its language.

Texts are independent of each other: one pass over the table, no shuffle. Bytes are looked at in arrays
and by substring searches first; only texts with a possible finding are decoded and matched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from etholith.llm.common import blocks, query, table

KINDS = ("assign", "access", "hex", "guess")
#: Decades of guesses from which a value counts as a secret.
DECADES = 9.0
LEAST = {"assign": 6, "access": 20, "hex": 24}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization"""
    r"""|(?:api|access|auth|private|client|account|encryption)[_-]?(?:key|token|secret|pass|password))"""
    r"""["']?[\x20\t]*(?:=>|[:=])[\x20\t]*(?:(?:bearer|basic)[\x20\t]+)?["']?([^\s"'<>`]+)""",
    re.A | re.I,
)
BEARER = re.compile(r"""(?<![a-z])bearer[\x20\t]+([^\s"'<>`]+)""", re.A | re.I)
LOGIN = re.compile(r"://[^\s:/@]+:([^\s/@]+)@")
#: One of these is in every text that one of the patterns above matches, in lower case.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"authorization", b"bearer", b"://")
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True

# Frequent words of passwords, most frequent first; the place is the number of guesses.
WORDS = """password qwerty dragon monkey letmein football baseball master michael shadow superman batman trustno
welcome login admin root user test guest hello love princess sunshine iloveyou ashley bailey charlie jordan hunter
ranger buster soccer hockey killer george andrew daniel joshua jessica jennifer amanda michelle nicole thomas robert
summer winter spring autumn monday friday flower cookie cheese banana orange apple pepper ginger purple yellow silver
golden diamond maggie tigger pokemon starwars computer internet service server secret default change access system
database oracle mysql postgres private public token example sample company office manager support secure security
account london berlin paris madrid america chelsea liverpool arsenal freedom forever friends family mother father
pass word key temp demo dev prod staging backup mail web app api site my the""".split()
RANK = {w: r for r, w in enumerate(WORDS, 1)}
LENGTHS = sorted({len(w) for w in WORDS})
PLAIN = str.maketrans("@4301$57!", "aaeoissti")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(
    r"(?:19|20)\d\d([-./_]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-./_]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d", re.A
)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)
#: An unknown word costs a lexicon of a million words, and more where it is longer than most.
LEXICON, USUAL, PER_LETTER = 6.0, 8, 0.25
#: Longest unit of a repeat, most consonants in a row of a word.
UNIT, CONSONANTS = 8, 4
_VOWELS = set("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ")
_TWO = math.log10(2)
_LETTERS = re.compile(r"[^\W\d_]+")


def brute_force(char: str) -> float:
    """Decades of guesses for one character of its class."""
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isalpha() else math.log10(33)


def _case(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    return _TWO if upper == len(word) or (upper == 1 and word[0].isupper()) else _TWO * (1 + upper)


def _wordlike(run: str) -> bool:
    if len(run) < 3 or not (run.islower() or run.isupper() or run[1:].islower()):
        return False
    row = most = 0
    for c in run.lower():
        row = 0 if c in _VOWELS else row + 1
        most = max(most, row)
    return most < len(run) and most <= CONSONANTS


def pieces(value: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, decades) of all parts of a value that are cheaper to guess than by brute force alone."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(PLAIN)
    n, out = len(value), []
    for i in range(n):
        for size in LENGTHS:
            if i + size > n:
                break
            for text in {low[i : i + size], plain[i : i + size]}:
                if text in RANK:
                    changed = sum(a != b for a, b in zip(low[i : i + size], text, strict=True))
                    out.append((i, i + size, "word", math.log10(RANK[text]) + _case(value[i : i + size]) + changed * _TWO))
        if value[i].isdigit():
            if date := DATE.match(value, i):
                out.append((i, date.end(), "date", math.log10(365 * 200) + (_TWO * 2 if date[1] or date[2] else 0.0)))
            if YEAR.match(value, i):
                out.append((i, i + 4, "date", math.log10(200)))
        for size in range(1, UNIT + 1):
            if i + 2 * size > n or (i and value[i - 1] == value[i - 1 + size]):  # else it starts further left
                continue
            unit, end = value[i : i + size], i + size
            while value.startswith(unit, end):
                end += size
            if end - i >= max(3, 2 * size):
                out.append((i, end, "repeat", guess_cost(unit) + math.log10((end - i) // size)))
    for run in _LETTERS.finditer(value):
        if _wordlike(run[0]):
            out.append((*run.span(), "word", LEXICON + PER_LETTER * max(0, len(run[0]) - USUAL) + _case(run[0])))
    i = 0
    while i < n:
        j, turns, way = i + 1, 0, None
        while j < n and low[j - 1] in PLACE and low[j] in PLACE:
            (y0, x0), (y1, x1) = PLACE[low[j - 1]], PLACE[low[j]]
            step = (y1 - y0, x1 - x0)
            if step == (0, 0) or abs(step[0]) > 1 or abs(step[1]) > 1:
                break
            turns, way = turns + (step != way), step
            j += 1
            if j - i >= 3:
                out.append((i, j, "walk", math.log10(len(PLACE) * (j - i)) + turns * 2 * _TWO + _case(value[i:j])))
        i = max(j - 1, i + 1)
    return out


def guess_cost(value: str) -> float:
    """Decades of the least product of guesses over all ways to cut the value into pieces and single characters."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, _, decades in pieces(value):
        ending.setdefault(end, []).append((start, decades))
    least = [0.0]
    for i, char in enumerate(value, 1):
        least.append(min([least[-1] + brute_force(char), *(least[s] + d for s, d in ending.get(i, ()))]))
    return least[-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind as a number, end) of the three patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], decades: float = DECADES) -> list[tuple[int, int, int]]:
    """Values in a credential context that are dear to guess and in no base span, each once."""
    found = set()
    for pattern in (CONTEXT, BEARER, LOGIN):
        for m in pattern.finditer(text):
            start = m.start(1)
            end = start + (len(m[1]) if pattern is LOGIN else len(m[1].rstrip(".,;:)]}")))
            if end > start:
                found.add((start, end))
    far, k, out = 0, 0, []
    for start, end in sorted(found):
        while k < len(base) and base[k][0] <= start:
            far = max(far, base[k][2])
            k += 1
        if end > far and guess_cost(text[start:end]) >= decades:
            out.append((start, 3, end))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, decades: float = DECADES) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_guess, base_sha256 and spans (``kind:start:end``, code points).

    Further columns stay, clashing ones give way. Null and empty texts have no spans: counts 0, the digest
    of the empty string, ''. Repeated rows are judged each.
    """
    made = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
    base = docs.select([c for c in docs.columns if c not in made])
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch["text"]):
                edge = np.flatnonzero(np.diff(_HEX[data].astype(np.int8), prepend=0, append=0))
                start, end = edge[::2], edge[1::2]
                long = np.searchsorted(offsets, start[end - start >= LEAST["hex"]], "right") - 1
                open_ = np.zeros(j - i, bool)
                open_[long] = True
                raw = data.tobytes()
                low = raw.lower()
                columns = [[] for _ in made]
                for k in range(j - i):
                    a, b = offsets[k], offsets[k + 1]
                    row = (0, 0, 0, 0, none, "")
                    if open_[k] or raw.find(b"AKIA", a, b) >= 0 or any(low.find(hint, a, b) >= 0 for hint in HINTS):
                        text = raw[a:b].decode()
                        found = base_spans(text)
                        guessed = guess_spans(text, found, decades)
                        n = [0] * len(KINDS)
                        for _, kind, _ in found + guessed:
                            n[kind] += 1
                        row = (*n, hashlib.sha256(_listed(found).encode()).hexdigest(), _listed(sorted(found + guessed)))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                part = batch.slice(i, j - i)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                new = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *made])

    kept = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(scan, f"{kept}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
