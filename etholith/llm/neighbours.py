"""Operator 8: nearest neighbours by multi-index hashing.

Vectors get ``bits`` binary digits from rotations learned by iterative quantisation on a bounded
sample. Tasks index the rows they hold, block by block: codes are split into 16-bit substrings and
each substring's values point to their rows. A query asks for every code within a Hamming radius. By
the pigeonhole principle such a code is close in one substring, so all present values near the
query's are probed, the codes behind them are verified, and what is left is ranked by exact Euclidean
distance. Where a block holds fewer than ``least`` (or ``k``) such codes
the radius is widened until it does.

Every row is indexed; queries travel to the blocks in groups of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etholith.llm.common import query, stored, table

BITS = 128
RADIUS = 53
LEAST = 256
SAMPLE = 4096
ROUNDS = 30
BLOCK = 1 << 16
QUERIES = 8192


class Rotations:
    """Centre and rotations of the binary codes, learned so that signs lose little of the vectors."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 0):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        x, turns = sample - self.centre, []
        for _ in range(-(-bits // dim)):
            turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
            for _ in range(ROUNDS if len(sample) else 0):
                u, _, v = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
                turn = u @ v
            turns.append(turn)
        self.turn = np.hstack(turns)[:, :bits]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 16) substrings."""
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1).view(np.uint16)


class MultiIndex:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            value, begin = np.unique(codes[order, j], return_index=True)
            self.tables.append((order, value, np.append(begin, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from ``code`` in at most ``radius`` bits."""
        each, rest = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.codes), bool)
        for j, (order, value, begin) in enumerate(self.tables):
            reach = each if j <= rest else each - 1
            near = np.flatnonzero(np.bitwise_count(value ^ code[j]) <= reach)
            n = begin[near + 1] - begin[near]
            hit[order[np.repeat(begin[near] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector has the commonest length, no null or non-finite component, and is not zero; and that length."""
    fine = (
        F.col("vec_id").isNotNull()
        & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(column, lambda v: v != 0)
    )
    fit = vectors.filter(fine)
    common = fit.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    return fit.filter(F.size(column) == dim).select("vec_id", F.col(column).cast("array<double>").alias("v")), dim


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, radius: int = RADIUS, least: int = LEAST, group: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, ties to the smaller vec_id.

    Both frames have vec_id and embedding; rows with a query's own vec_id are no candidates. Vectors
    of :func:`usable` only take part. A query with fewer candidates than ``k`` gets them all; equal
    rows are candidates each, a repeated query is asked once.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    asked, _ = usable(queries)
    asked = stored(asked.filter(F.size("v") == dim).dropDuplicates(["vec_id"]))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    turns = Rotations(_matrix(sample["v"], dim), bits)
    groups = max(1, -(-asked.count() // group))
    found = None

    def finder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_id, q, q_code = sent.value
            held, size = [], 0

            def answers(ids, x):
                index = MultiIndex(turns.codes(x))
                out_q, out_v, out_s = [], [], []
                for i, own, code in zip(range(len(q_id)), q_id, q_code, strict=True):
                    reach, others = radius, int((ids != own).sum())
                    while True:
                        at = index.within(code, reach)
                        at = at[ids[at] != own]
                        if len(at) >= min(max(least, k), others):
                            break
                        reach += 4
                    score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[at], score))[:k]
                    out_q.append(np.full(len(best), own))
                    out_v.append(ids[at][best])
                    out_s.append(score[best])
                    if len(out_q) == 2000 or i == len(q_id) - 1:
                        yield pa.record_batch({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})
                        out_q, out_v, out_s = [], [], []

            for batch in batches:
                held.append((batch["vec_id"].to_numpy().astype(np.int64), _matrix(batch["v"], dim)))
                size += batch.num_rows
                if size >= BLOCK:
                    yield from answers(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
            if size:
                yield from answers(*map(np.concatenate, zip(*held, strict=True)))

        return run

    for g in range(groups):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow().sort_by("vec_id")
        q = _matrix(part["v"], dim)
        sent = spark.sparkContext.broadcast((part["vec_id"].to_numpy().astype(np.int64), q, turns.codes(q)))
        one = rows.mapInArrow(finder(sent), "query_id long, vec_id long, score double")
        found = one if found is None else found.union(one)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op8_nearest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
