"""Operator 11: periodic run detection by recursive frequency splitting.

A run is a maximal stretch of words of smallest period q and length of at least ``max(6, 4 * q)``, so
each of its words occurs four times in it. Words that occur less often within the current segment
(first the whole text) can belong to no run: they split it. The parts are judged by their own counts
until nothing splits any more; what survives is scanned by lags.

The lag scan goes by powers of two. At scale b a run of a period in ``b .. 2 * b - 1`` holds one of the
blocks that start at multiples of b, and holds it again one period later; blocks are compared with
all words of the next two blocks by exact names (ranks of word pairs, doubled per scale), and each lag
that a block supports is extended to both sides by the names of all scales. A text of n words takes
about n log n comparisons, never n times n.

Texts are independent of each other: one pass over the table, no shuffle. Splitting is done for a
block of texts at once in arrays; the largest thing in memory is a block of 2 MB or one longer text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from etholith.llm.common import Words, blocks, query, table

LEAST = 6
COPIES = 4
RESULT = [
    ("n_runs", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("period", pa.int64()),
    ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
]
SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


def segments(words: np.ndarray, first: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches that survive the splitting; ``first`` has the texts' borders in ``words``."""
    starts, ends = first[:-1], first[1:]
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return starts, ends
        size = ends - starts
        owner = np.repeat(np.arange(len(starts)), size)
        at = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
        order = np.lexsort((words[at], owner))
        w, o = words[at[order]], owner[order]
        new = np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        rare = np.empty(len(at), bool)
        rare[order] = np.repeat(count < copies, count)
        if not rare.any():
            return starts, ends
        begin = ~rare & np.append(True, rare[:-1] | (owner[1:] != owner[:-1]))
        stop = ~rare & np.append(rare[1:] | (owner[1:] != owner[:-1]), True)
        starts, ends = at[begin], at[stop] + 1


def _names(words: np.ndarray, copies: int) -> list[np.ndarray]:
    """Per scale b = 1, 2, 4, ... the name of the b words at each place: equal names, equal words."""
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while copies * 2 << (len(names) - 1) <= len(words):
        half, b = names[-1], 1 << (len(names) - 1)
        pairs = half[:-b] * (int(half.max()) + 1) + half[b:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
    return names


def _extend(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``i`` and from ``j > i`` on are equal, to the right (step 1) or to the left of them (step -1)."""
    n = len(names[0])
    total = np.zeros(len(i), np.int64)
    top = len(names) - 1
    open_ = np.arange(len(i))
    while len(open_):  # whole blocks of the largest scale
        b = 1 << top
        x, y = (i[open_] + total[open_], j[open_] + total[open_]) if step > 0 else (i[open_] - total[open_] - b, j[open_] - total[open_] - b)
        fits = (x >= 0) & (y + b <= n)
        open_, x, y = open_[fits], x[fits], y[fits]
        open_ = open_[names[top][x] == names[top][y]]
        total[open_] += b
    for level in range(top - 1, -1, -1):
        b = 1 << level
        x, y = (i + total, j + total) if step > 0 else (i - total - b, j - total - b)
        fit = np.flatnonzero((x >= 0) & (y + b <= n))
        fit = fit[names[level][x[fit]] == names[level][y[fit]]]
        total[fit] += b
    return total


def lag_scan(words: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """(start, length, period) of all runs of one segment, by start, then period."""
    names = _names(words, copies)
    found = []
    for level, name in enumerate(names):
        b = 1 << level
        rows = -(-len(name) // b) - 1
        padded = np.append(name, np.full((rows + 1) * b - len(name), -1))
        m, lag = np.nonzero(padded[b:].reshape(rows, b) == name[: rows * b : b, None])
        i, q = m * b, lag + b
        left, right = _extend(names, i, i + q, -1), _extend(names, i, i + q, 1)
        start, length = i - left, left + right + q
        fine = length >= np.maximum(least, copies * q)
        found.append(np.unique(np.stack([start[fine], length[fine], q[fine]], axis=1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]
    runs = runs[first]  # of one stretch the smallest period; larger ones are its multiples
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(text, runs): all runs of a block of texts, starts counted within their text, in order of text, start and period."""
    starts, ends = segments(words, first, least, copies)
    out, text = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for s, e in zip(starts, ends, strict=True):
        runs = lag_scan(words[s:e], least, copies)
        if len(runs):
            own = int(np.searchsorted(first, s, "right")) - 1
            runs[:, 0] += s - first[own]
            out.append(runs)
            text.append(np.full(len(runs), own))
    return np.concatenate(text), np.concatenate(out)


def rewritten(doc_id, n: int) -> np.ndarray | None:
    """Which original word stands at each place, where the contract makes a text periodic; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """The run of greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    return best


def mark_runs(docs: DataFrame, rewrite=None, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``docs`` with its runs (list, start and length in words), the strongest one, and digests of runs and collapsed text.

    ``rewrite(doc_id, n_words)`` may say which original word stands at each place. Further columns stay,
    clashing ones give way. Null, empty and blank texts have no words and no runs: n_runs 0, nulls, the
    digest of the empty string. Repeated rows are judged each. Of a word repeated through a whole text
    the first stays.
    """
    taken = {name for name, _ in RESULT}
    base = docs.select([c for c in docs.columns if c not in taken])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            for i, j, data, offsets in blocks(texts):
                words = Words(data, offsets)
                h, first = words.hashes(), words.first
                moved = {}
                if rewrite is not None:
                    for k in range(j - i):
                        at = rewrite(ids[i + k].as_py(), int(first[k + 1] - first[k]))
                        if at is not None:
                            moved[k] = at
                            h[first[k] : first[k + 1]] = h[first[k] + at]
                text, runs = find_runs(h, first, least, copies)
                border = np.searchsorted(text, np.arange(j - i + 1))
                columns = [[] for _ in RESULT]
                raw = data.tobytes()
                for k in range(j - i):
                    own = runs[border[k] : border[k + 1]]
                    parts = raw[offsets[k] : offsets[k + 1]].split()
                    if k in moved:
                        parts = [parts[x] for x in moved[k].tolist()]
                    if len(own):
                        edge = np.zeros(len(parts) + 1, np.int64)
                        np.add.at(edge, own[:, 0] + own[:, 2], 1)
                        np.add.at(edge, own[:, 0] + own[:, 1], -1)
                        parts = [parts[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    best = strongest(own)
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
                    row = (
                        len(own),
                        *(best or (None, None, None)),
                        1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(lines.encode()).hexdigest(),
                        hashlib.sha256(b" ".join(parts)).hexdigest(),
                        [{"start": s, "length": n, "period": q} for s, n, q in own.tolist()],
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                part = batch.slice(i, j - i)
                made = [pa.array(c, kind) for c, (_, kind) in zip(columns, RESULT, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(name for name, _ in RESULT)])

    kept = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(scan, f"{kept}, {SCHEMA}")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_runs(docs, rewritten).drop("text", "runs")
