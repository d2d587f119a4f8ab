"""Operator 12: centroid clustering with Ptolemaic pivots.

Vectors become integers, so that every distance, sum and tie is exact and no result depends on the
partitioning. Their distances to ``k`` fixed pivots (the first centroids) are computed once and stored
with them. In each round the driver measures the ``k`` centroids against the pivots, and Ptolemy's
inequality gives for a vector o, a centroid c and two pivots p, q

    d(o, c) * d(p, q) >= |d(o, p) * d(c, q) - d(o, q) * d(c, p)|.

The largest such bound over all pairs of pivots is rounded down by more than floating point can be
wrong. The centroid of the least bound is measured first, the others only where their bound does not
exceed what was found, exactly, in integers; ties go to the smaller number.

Every round is one scan of the stored vectors: tasks hold ``k`` centroids and return ``k * dim`` partial
sums, added up in Spark; the driver sees ``k * dim`` numbers, whatever the table's size. Nothing is
exchanged by cluster, so a cluster with most rows costs what any other does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import query, stored, table

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Largest absolute integer component; squared distances of 64 such components fit into 63 bits.
LARGEST = 1 << 27
#: More than the relative error of a bound: three roundings of each product, two of the quotient.
SLACK = 2.0**-48


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    return ((v - c) ** 2).sum(axis=1)


class Pivots:
    """Lower bounds from cached distances to fixed pivots, over all pairs of different pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        gap = [(a, b, float(np.sqrt(distances(pivots[a : a + 1], pivots[b])[0]))) for a, b in combinations(range(len(pivots)), 2)]
        gap = [g for g in gap if g[2] > 0]
        self.a, self.b = (np.array([g[i] for g in gap], np.int64) for i in (0, 1))
        self.gap = np.array([g[2] for g in gap])

    def measure(self, v: np.ndarray) -> np.ndarray:
        """(rows, pivots) distances."""
        return np.stack([np.sqrt(distances(v, p).astype(np.float64)) for p in self.pivots], axis=1)

    def below(self, cached: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """Squares that no row's squared distance to the centroid falls below; ``centroid`` has its distances to the pivots."""
        if not len(self.gap):
            return np.zeros(len(cached))
        left, right = cached[:, self.a] * centroid[self.b], cached[:, self.b] * centroid[self.a]
        low = (np.abs(left - right) - SLACK * (left + right)) / self.gap
        return np.maximum(low.max(axis=1), 0.0) ** 2 * (1 - SLACK)


def assign(v: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact checks) of integer rows; ``cached`` has their distances to the pivots."""
    known = pivots.measure(centroids)
    low = np.stack([pivots.below(cached, c) for c in known], axis=1)
    order = np.argsort(low, axis=1, kind="stable")
    cluster = order[:, 0]
    best = distances(v, centroids[cluster])
    checks = len(v)
    for rank in range(1, len(centroids)):
        c = order[:, rank]
        rows = np.flatnonzero(low[np.arange(len(v)), c] <= best)
        if not len(rows):
            break  # bounds only grow from here
        checks += len(rows)
        d = distances(v[rows], centroids[c[rows]])
        better = (d < best[rows]) | ((d == best[rows]) & (c[rows] < cluster[rows]))
        rows, d = rows[better], d[better]
        cluster[rows], best[rows] = c[rows], d
    return cluster, best, checks


def _matrix(rows: pa.Array, kind) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(kind)


def integer_vectors(vectors: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of ``dim`` components, none null or non-finite, as ``floor(scale * x)``.

    Components beyond ``LARGEST`` (an x of 131,072 with these settings) take no part: their squared
    distances may not fit into a long.
    """
    fine = (F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return vectors.filter(fine).select("vec_id", whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of seed and vec_id; equal ids by their components, null ids last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, column: str = "embedding", dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that takes part.

    Which these are is said at :func:`integer_vectors`; an empty table gives none. With fewer than ``k``
    vectors there are as many centroids as vectors. Repeated rows count each, and may start as equal
    centroids, of which the later stay empty where they are. Further columns of ``vectors`` are left out.
    Inertia beyond a long is null.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, column, dim, scale)
    kind = dict(kept.dtypes)["vec_id"]
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        names = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
        return spark.createDataFrame([], f"vec_id {kind}, {names}")
    pivots = Pivots(centroids)

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pivots.measure(_matrix(batch["v"], np.int64))
                offsets = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, near.ravel())], names=["vec_id", "v", "near"])

    held = stored(kept.mapInArrow(cached, f"vec_id {kind}, v array<int>, near array<double>"))

    def sums(centroids: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch["v"], np.int64)
                    own, _, _ = assign(v, _matrix(batch["near"], np.float64), centroids, pivots)
                    np.add.at(total, own, v)
                    n += np.bincount(own, minlength=len(n))
            c, d = np.nonzero(np.broadcast_to(n[:, None], total.shape))
            yield pa.record_batch({"cluster": c.astype(np.int32), "at": d.astype(np.int32), "total": total[c, d], "n": n[c]})

        parts = held.select("v", "near").mapInArrow(run, "cluster int, at int, total long, n long")
        return parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))

    for _ in range(rounds):
        following = centroids.copy()
        for r in sums(centroids).collect():  # k * dim rows
            following[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
        centroids = following

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, d, _ = assign(_matrix(batch["v"], np.int64), _matrix(batch["near"], np.float64), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(own, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    final = stored(held.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    per = [(c, fits(s), fits(sum(inertia.values())), centroids[c].tolist(), digest(centroids[c])) for c, s in sorted(inertia.items())]
    about = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")  # k rows


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT r, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(cluster, (d, cluster)) AS cluster FROM d{i} GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT cluster, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM v JOIN a{i} USING (r)) GROUP BY cluster, k),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN
  (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM s{i} GROUP BY cluster) USING (cluster))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (cluster)"""
    )


@query("op12_centroid_clusters", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")
