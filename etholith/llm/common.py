"""Helpers shared by the operators: stored tables, byte-level words, hashing, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can state the result, its SQL."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read back.

    Cuts the lineage where several branches read one result; a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- words as numpy arrays ------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of `[^\x20\x09-\x0D]+`; in UTF-8 no byte of a longer character is one of the six.
PLAIN = ~_SPACE
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: 0-9, a-z and all above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_RANDOM = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, 1 << int(n - 1).bit_length()) if n else _BLOCK
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` (or of ``codes[values[s:e]]``) for sorted spans, from prefix sums taken in blocks."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, first + _BLOCK // 2)))
        top = int(ends[i:j].max())
        up, down = _tables(top - first)
        part = values[first:top] if codes is None else codes[values[first:top]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s = starts[i:j] - first
        out[i:j] = (sums[ends[i:j] - first] - sums[s]) * down[s]
        i = j
    return mix(out)


class Words:
    """Words of a block of texts: byte spans, the text each belongs to, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN):
        inside = table[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, _RANDOM)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each word starts and ends there."""
        size = self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        out = slices(np.append(self.data, np.uint8(32)), self.starts, self.ends + 1)
        out[ends] = 32
        return out, starts, ends


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``data[s:e]`` of all spans, one after another."""
    size = ends - starts
    at = np.cumsum(size) - size
    return data[np.repeat(starts - at, size) + np.arange(int(size.sum()))]


def binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = slices(data, starts, ends)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _give_back() -> None:
    """Memory that freed arrays still hold goes back to the machine; a reused worker starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, offsets) of runs of texts of about ``limit`` bytes; null is empty.

    A text longer than that is a run of its own: texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, raw = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    _give_back()


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), by alternating stars.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them;
    the number of rounds grows with the logarithm of the longest chain. Edges are written between
    rounds and only a count reaches the driver. A node with very many neighbours is met in sums
    (`min`, combined before the shuffle) and in joins, never as a list.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if larger else e.select(F.greatest("a", "b"), F.least("a", "b"))
        both = both.toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if larger:
            linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = joined.select("b", "m").union(least.select("a", "m")).toDF("a", "b").filter("a <> b")
        return linked.distinct()

    current = stored(edges.select("a", "b").filter("a <> b").distinct())
    while current.limit(1).count():
        following = stored(star(star(current, True), False))
        changed = following.join(current, ["a", "b"], "left_anti").limit(1).count()
        same = following.count() == current.count()
        current = following
        if not changed and same:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
