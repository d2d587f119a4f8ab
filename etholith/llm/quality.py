"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over chunks that overlap by one filter and cover the whole
text, activations are max-pooled per chunk, and the chunks' pooled values (their maximum and their
mean over the text) give one probability. The network is fitted on a bounded sample of labelled rows
(``SAMPLE`` per class, each shown by at most ``VIEWS`` chunks spread over its text); scoring reads
every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import blocks, query, table

DIM, KERNEL, STRIDE, FILTERS = 8, 8, 2, 16
POSITIONS = 256
CHUNK = STRIDE * POSITIONS
SPAN = CHUNK + KERNEL - STRIDE
SAMPLE = 1500
VIEWS = 8
EPOCHS = 12
THRESHOLD = 0.3


def fold(doc_id: str, k: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(k))


class ConvNet:
    """Embedding, one convolution with rectifier, max pooling, and a logistic layer on (max, mean)."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0  # padding
        self.filters = rng.normal(0, 0.2, (KERNEL * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.out[:] = rng.normal(0, 0.1, 2 * FILTERS)
        self.last = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.last]

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Per chunk (rows of SPAN bytes) and filter the largest activation, and its position."""
        x = self.embed[chunks]
        step = x.strides
        view = np.lib.stride_tricks.as_strided(x, (len(x), POSITIONS, KERNEL * DIM), (step[0], STRIDE * step[1], step[2]))
        act = view.reshape(-1, KERNEL * DIM) @ self.filters
        act = act.reshape(len(x), POSITIONS, FILTERS)
        if where:
            at = act.argmax(axis=1)
            return np.maximum(np.take_along_axis(act, at[:, None], 1)[:, 0] + self.bias, 0), at
        return np.maximum(act.max(axis=1) + self.bias, 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability per text from its chunks; text ``t`` has chunks ``first[t]`` to ``first[t + 1]``, one at least."""
        top = np.maximum.reduceat(pooled, first[:-1], axis=0)
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
        z = np.hstack([top, mean]) @ self.out + self.last
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def cut(data: np.ndarray, offsets: np.ndarray, pick: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes left in the text, first chunk of each text) of the chunks of a block of texts.

    With ``pick``, at most so many of a text's chunks, evenly spread.
    """
    size = np.diff(offsets)
    number = np.maximum(1, -(-np.maximum(size - (KERNEL - STRIDE), 0) // CHUNK))
    used = number if pick is None else np.minimum(number, pick)
    first = np.append(0, np.cumsum(used))
    k = np.arange(first[-1]) - np.repeat(first[:-1], used)
    k = k * np.repeat(number, used) // np.repeat(used, used)
    start = np.repeat(offsets[:-1], used) + k * CHUNK
    return start, np.repeat(offsets[1:], used) - start, first


def chunk_bytes(data: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros((len(start), SPAN), np.uint8)
    reach = np.arange(SPAN)
    at = np.minimum(start[:, None] + reach, len(data) - 1)
    return np.where(reach < left[:, None], data[at], 0).astype(np.uint8)


def train(chunks: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ConvNet:
    """Adam on the class-balanced log loss; the gradient passes through the pooled windows only."""
    net, rng = ConvNet(seed), np.random.default_rng(seed)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    share = label.mean()
    weight = np.where(label == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for a in range(0, len(order), 64):
            docs = order[a : a + 64]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            local = np.append(0, np.cumsum(first[docs + 1] - first[docs]))
            part = chunks[rows]
            pooled, at = net.pooled(part, where=True)
            count = np.diff(local)
            p = net.combine(pooled, local)
            dz = ((p - label[docs]) * weight[docs] / len(docs)).astype(np.float32)
            owner = np.repeat(np.arange(len(docs)), count)
            top = np.maximum.reduceat(pooled, local[:-1], axis=0)
            mean = np.add.reduceat(pooled, local[:-1], axis=0) / count[:, None]
            d_out = np.hstack([top, mean]).T @ dz
            is_top = pooled == top[owner]
            is_top = is_top / np.maximum(np.add.reduceat(is_top, local[:-1], axis=0), 1)[owner]
            d_pool = dz[owner, None] * (net.out[:FILTERS] * is_top + net.out[FILTERS:] / count[owner, None]) * (pooled > 0)
            c, f = np.nonzero(d_pool)
            g = d_pool[c, f].astype(np.float32)
            byte = part[c[:, None], STRIDE * at[c, f][:, None] + np.arange(KERNEL)]
            x = net.embed[byte].reshape(len(c), -1)
            d_filters = np.zeros_like(net.filters)
            np.add.at(d_filters.T, f, g[:, None] * x)
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, byte.ravel(), (g[:, None] * net.filters.T[f]).reshape(-1, DIM))
            d_embed[0] = 0
            d_bias = np.bincount(f, g, FILTERS).astype(np.float32)
            step += 1
            for value, grad, (m, v) in zip(net.parameters(), [d_embed, d_filters, d_bias, d_out, np.array([dz.sum()])], state, strict=True):
                grad = grad + 1e-4 * value
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, views: int = VIEWS) -> ConvNet:
    """The network learned from at most ``sample`` rows of each label outside the held-out fold.

    Rows are chosen by smallest hash of their id. At most ``2 * sample * views`` chunks come to the
    driver, whatever the input. Of several texts with one doc_id that of the least content hash is
    learned, once with each label the id has; the order is by doc_id and label, so the network does not
    depend on the partitioning. Without rows of both labels the network stays as it was drawn.
    """
    known = labels.filter((fold("doc_id", 5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    few = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = few[0].union(few[1])

    def views_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch["text"]):
                start, left, first = cut(data, offsets, views)
                rows = chunk_bytes(data, start, left)
                packed = [rows[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "quality": batch["quality"].slice(i, j - i), "content": batch["content"].slice(i, j - i), "chunks": pa.array(packed, pa.binary())})

    kind, label = dict(docs.dtypes)["doc_id"], dict(labels.dtypes)["quality"]
    rows = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
        .join(F.broadcast(chosen), "doc_id")  # 2 * sample rows
        .select("doc_id", "quality", "content", "text")
        .mapInArrow(views_of, f"doc_id {kind}, quality {label}, content long, chunks binary")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("chunks", "content").alias("chunks"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    )
    label = rows["quality"].to_numpy().astype(np.float64)
    if not 0 < label.sum() < len(label):
        return ConvNet()
    packed = rows["chunks"].to_pylist()
    first = np.append(0, np.cumsum([len(p) // SPAN for p in packed]))
    return train(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, SPAN), first, label)


def scored(docs: DataFrame, net: ConvNet) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1 for every whole text (null counts as empty)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in blocks(batch["text"]):
                start, left, first = cut(data, offsets)
                pooled = np.empty((len(start), FILTERS), np.float32)
                for a in range(0, len(start), 256):
                    pooled[a : a + 256] = net.pooled(chunk_bytes(data, start[a : a + 256], left[a : a + 256]))
                out.append(net.combine(pooled, first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return base.mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold); one row per row, repeated rows score alike."""
    net = fit(docs, labels, **how)
    return scored(docs, net).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = classify(docs, table(spark, sf_dir, "labels"))
    return marks.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
