"""Operator 5: near-duplicates by SimHash and pivot distance tables.

Fingerprints are made per text in Arrow batches; equal ones are one node from then on. Distances to
random references barely separate unrelated 64-bit fingerprints (their standard deviation is the
search radius), so the pivot table cannot be the key of a shuffle. Nodes are therefore dealt out by
agreement: ``radius`` differing bits leave at least ``BLOCKS - radius`` of the seven blocks of bits
untouched, so linked fingerprints agree in all bits of some three blocks. Inside a bucket the pivot
table decides: a pair whose distances to any reference differ by more than the radius is discarded,
survivors are verified bit by bit, and only a spanning forest of the links leaves the task.

A bucket of more than ``BUCKET`` different fingerprints is not held in a task. Its members go another
exact way: two fingerprints are within four bits if and only if some value is within two bits of
both, so each is linked to the least fingerprint that reaches the same value. For an odd radius one
of the two is a bit nearer, and the least of the nearer ones is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import Words, blocks, components, lower, query, signed, stored, table

SHINGLE = 4
RADIUS = 4
BLOCKS = 7
BUCKET = 1 << 15
SMALL = 8
#: Reference fingerprints of the distance table.
PIVOTS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, 24, dtype=np.uint64)


def fingerprints(words: Words, n_texts: int, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    flat, ws, we = words.joined()
    first = words.first
    size = np.diff(first)
    last = np.maximum(first[1:] - shingle + 1, first[:-1] + (size > 0))  # one shingle for a short text
    number = last - first[:-1]
    at = np.repeat(first[:-1] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    owner = np.repeat(np.arange(n_texts), number)
    stop = we[np.minimum(at + shingle, first[1:][owner]) - 1]
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    ones = np.zeros((n_texts, 64), np.int64)
    for a in range(0, len(at), 1 << 16):
        part = slice(a, a + (1 << 16))
        h = np.array([digest(raw[s:e], seed) for s, e in zip(ws[at[part]].tolist(), stop[part].tolist(), strict=True)], dtype=np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        who, begin = np.unique(owner[part], return_index=True)
        ones[who] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    set_ = 2 * ones > number[:, None]
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, content, fp): the fingerprint of every whole text as a signed long; zero for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch["text"]):
                fp = fingerprints(Words(lower(data), offsets), j - i, shingle)
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "content": batch["content"].slice(i, j - i), "fp": signed(fp)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(run, f"doc_id {kind}, content long, fp long")


def _block_masks() -> list[int]:
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, BLOCKS - RADIUS)]


MASKS = np.array(_block_masks(), dtype=np.uint64)


def _close(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs survive the pivot table, a few references at a time, and then the bit count."""
    left = np.arange(len(x))  # y has as many, or is one fingerprint
    pick = lambda a, i: a[i] if len(a) == len(x) else a
    for k in range(0, dx.shape[1], 6):
        gap = np.abs(pick(dx[:, k : k + 6], left) - pick(dy[:, k : k + 6], left)).max(axis=1)
        left = left[gap <= radius]
    return left[np.bitwise_count(pick(x, left) ^ pick(y, left)) <= radius]


def _distances(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)


def _forest(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is linked in one bucket; each fingerprint meets only those not yet reached."""
    d = _distances(fp)
    rest, out_a, out_b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _close(fp[rest], fp[x : x + 1], d[rest], d[x : x + 1], radius)
            if len(near):
                out_a.append(np.full(len(near), fp[x]))
                out_b.append(fp[rest[near]])
                queue.extend(rest[near].tolist())
                rest = np.delete(rest, near)
    return out_a, out_b


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of equal ``key`` (sorted)."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    keep = np.repeat((size > 1) & (size <= SMALL), size)
    out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    k, f = key[keep], fp[keep]
    d = _distances(f)
    for step in range(1, SMALL):
        i = np.flatnonzero(k[:-step] == k[step:]) if len(k) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[_close(f[i], f[i + step], d[i], d[i + step], radius)]
        out_a.append(f[i])
        out_b.append(f[i + step])
    for g in np.flatnonzero(size > SMALL):
        a, b = _forest(fp[edge[g] : edge[g + 1]], radius)
        out_a += a
        out_b += b
    return np.concatenate(out_a), np.concatenate(out_b)


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): enough links to connect all fingerprints (column ``fp``, distinct) within ``radius`` bits.

    ``radius`` is at most 4: that many blocks may be touched; another one is a ValueError.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4 bits")

    def keyed(batches):
        number = np.arange(len(MASKS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            key = (fp[:, None] & MASKS) ^ number  # equal keys of other blocks only add a pair to verify
            yield pa.record_batch({"key": signed(key.ravel()), "fp": signed(np.repeat(fp, len(MASKS)))})

    def paired(batches):
        key, fp, full = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def dense(members):
            return pa.record_batch({"a": signed(members), "b": pa.nulls(len(members), pa.int64())})

        def linked(k, f):
            a, b = bucket_links(k, f, radius)
            for i in range(0, len(a), 50_000):
                yield pa.record_batch({"a": signed(a[i : i + 50_000]), "b": signed(b[i : i + 50_000])})

        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy().view(np.uint64)])
            if full is not None:
                cut = int(np.searchsorted(key, full, "right"))
                yield dense(fp[:cut])
                key, fp = key[cut:], fp[cut:]
                if not len(key):
                    continue
                full = None
            cut = int(np.searchsorted(key, key[-1]))
            if cut:  # a bucket may be larger than a batch
                yield from linked(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if len(key) > bucket:
                full = key[0]
                yield dense(fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from linked(key, fp)

    found = stored(
        nodes.select("fp").mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(paired, "a long, b long")
    )
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    reach = [0] + [sum(1 << i for i in c) for n in range(1, (radius + 1) // 2 + 1) for c in combinations(range(64), n)]

    def ball(batches):
        masks = np.array(reach, dtype=np.uint64)
        near = np.bitwise_count(masks) <= radius // 2
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(fp), 100):
                part = fp[i : i + 100]
                yield pa.record_batch({"z": signed((part[:, None] ^ masks).ravel()), "fp": signed(np.repeat(part, len(masks))), "near": np.tile(near, len(part))})

    out = found.filter("b IS NOT NULL")
    if crowded.limit(1).count():
        around = crowded.mapInArrow(ball, "z long, fp long, near boolean")
        # For an odd radius only those within the lesser half may be linked to: the others reach as far as one bit more.
        least = around.groupBy("z").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND b IS NOT NULL").drop("n")
        out = out.union(around.join(least, "z").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct())
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, content, fingerprint, component_id) for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
    give repeated rows. ``component_id`` is the least doc_id that links reach; rows whose doc_id is
    null count as nodes but never name a component unless it has no other.
    """
    prints = stored(with_fingerprint(docs, shingle))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(links(nodes, radius, bucket))
    rooted = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = stored(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "content", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One row of each component: that of the least doc_id, null last (of equal ids, the least content hash)."""
    marks = near_duplicates(docs, **how)
    first = marks.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("f")).select("f.*").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content"))
    return docs.dropDuplicates(["doc_id", "text"]).join(first, on, "left_semi")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
