"""Operator 9: language identification with string kernels.

A text is the set of its byte n-grams for n = 1, 2, 3 (ASCII letters lower-cased, other ASCII as
space). The blended-spectrum presence kernel of two texts is the mean over n of their number of
common n-grams divided by the geometric mean of their set sizes. Landmarks stand in for the training
texts (Nyström): kernel values to them, whitened, are features of a one-versus-rest kernel ridge
regression. Scoring takes whole texts; presence rows of many texts at once are multiplied by the
landmarks' presence columns, then by the weights.

Landmarks and training texts are a bounded sample: ``PER_LANG`` texts for each language, ``TOTAL`` at
most, shared evenly but with ``LEAST`` left for each, each shown by a piece of up to ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etholith.llm.common import blocks, query, stored, table
from etholith.llm.quality import fold
from etholith.session import broadcast_if_small

ORDERS = (1, 2, 3)
PER_LANG = 200
TOTAL = 4000
LEAST = 10
LANDMARKS = 24
PIECE = 4000
RIDGE = 1e-2
BATCH = 128

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def spectra(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the distinct (text, n-gram) pairs of a block of texts, sorted."""
    flat = _FOLD[data].astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    out = []
    for n in ORDERS:
        m = len(flat) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        code = np.zeros(m, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | flat[k : m + k]
        inside = text[:m] == text[n - 1 :]
        pairs = np.unique((text[:m][inside] << np.uint64(24)) | code[inside])
        out.append(((pairs >> np.uint64(24)).astype(np.int64), (pairs & np.uint64(0xFFFFFF)).astype(np.int64)))
    return out


class KernelModel:
    """Landmarks' n-grams by order, the whitening of their kernel, and the weights per language."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: list[int]):
        self.langs = sorted(set(langs), key=lambda s: s.encode())
        marked = [texts[i] for i in landmarks]
        at = np.append(0, np.cumsum([len(t) for t in marked]))
        found = spectra(np.frombuffer(b"".join(marked), np.uint8), at)
        self.grams, self.presence = [], []
        for owner, code in found:
            grams, place = np.unique(code, return_inverse=True)
            matrix = np.zeros((len(grams) + 1, len(marked)), np.float32)  # the last row is for unknown n-grams
            size = np.maximum(np.bincount(owner, minlength=len(marked)), 1)
            matrix[place, owner] = 1 / np.sqrt(size[owner]) / len(ORDERS)
            self.grams.append(grams)
            self.presence.append(matrix)
        near = self.kernel(np.frombuffer(b"".join(marked), np.uint8), at).astype(np.float64)
        value, vector = np.linalg.eigh((near + near.T) / 2 + 1e-6 * np.eye(len(marked)))
        white = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        at = np.append(0, np.cumsum([len(t) for t in texts]))
        phi = self.kernel(np.frombuffer(b"".join(texts), np.uint8), at) @ white
        y = np.where(np.array(langs, dtype=object)[:, None] == np.array(self.langs, dtype=object), 1.0, -1.0)
        # Each language weighs the same, however many of its texts are in the sample.
        weight = (1 / (y > 0).sum(axis=0))[np.argmax(y, axis=1)]
        a = phi.T @ (weight[:, None] * phi) + RIDGE * len(self.langs) / len(marked) * np.eye(len(marked))
        self.weights = (white @ np.linalg.solve(a, phi.T @ (weight[:, None] * y))).astype(np.float32)

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Kernel values of texts (rows) and landmarks, in batches of dense presence rows."""
        n = len(offsets) - 1
        out = np.zeros((n, self.presence[0].shape[1]), np.float32)
        for (owner, code), grams, matrix in zip(spectra(data, offsets), self.grams, self.presence, strict=True):
            if not len(code) or not len(grams):
                continue
            place = np.searchsorted(grams, code)
            place = np.where(grams[np.minimum(place, len(grams) - 1)] == code, place, len(grams))
            size = np.bincount(owner, minlength=n)
            edge = np.searchsorted(owner, np.arange(0, n + BATCH, BATCH))
            for k, a in enumerate(range(0, n, BATCH)):
                b = min(n, a + BATCH)
                rows = np.zeros((b - a, len(grams) + 1), np.float32)
                part = slice(edge[k], edge[k + 1])
                rows[owner[part] - a, place[part]] = 1
                out[a:b] += (rows @ matrix) / np.sqrt(np.maximum(size[a:b], 1))[:, None]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = self.kernel(data, offsets) @ self.weights
        best = value.argmax(axis=1)
        return best, np.clip((1 + value[np.arange(len(best)), best].astype(np.float64)) / 2, 0, 1)


def fit(docs: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL, landmarks: int = LANDMARKS) -> KernelModel | None:
    """The model of the non-null languages outside the held-out fold; none if there is no such text.

    Distinct rows of smallest hash within each language. The first filter leaves some more of each than its share.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("doc_id", 5) != 0))
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_spot")
    narrow = stored(usable.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_content"), F.col("lang").alias("_lang"), spot).distinct())
    # One row per language, so the first filter runs before anything is exchanged by language.
    counts = broadcast_if_small(stored(narrow.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))))
    share = max(LEAST, min(per_lang, total // max(1, counts.count())))
    order = Window.partitionBy("_lang").orderBy("_spot", "_id", "_content")
    chosen = (
        narrow.join(counts, "_lang")
        .filter(F.col("_spot") * F.col("_n") <= (share + 8 * share**0.5 + 16) * (1 << 30))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= share)
        .dropDuplicates(["_id", "_content"])
        .drop("_rank")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content"))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), same)
        # Pieces of 100 bytes and more, from a place that follows from the hash.
        .withColumn("_size", (F.lit(100) + F.pmod(F.hash("doc_id", "text"), F.lit(PIECE - 100))))
        .select(F.col("_lang").alias("lang"), F.expr("substring(text, 1 + cast(pmod(_spot, greatest(length(text) - _size, 1)) AS int), _size)").alias("piece"))
        .toArrow()
    )
    langs, texts = rows["lang"].to_pylist(), [t.encode() for t in rows["piece"].to_pylist()]
    if not langs:
        return None
    order = sorted(range(len(langs)), key=lambda i: (langs[i], texts[i]))
    langs, texts = [langs[i] for i in order], [texts[i] for i in order]
    chosen = []
    for lang in sorted(set(langs)):
        own = [i for i in range(len(langs)) if langs[i] == lang]
        own.sort(key=lambda i: (-len(texts[i]), texts[i]))
        chosen += own[:landmarks]
    return KernelModel(texts, langs, chosen)


def identify(docs: DataFrame, model: KernelModel | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score. A null text, one without a letter, or no model: ``und``, 0.

    Without ``keep_text`` the texts do not travel back from the Python workers.
    """
    base = docs.drop("lang_pred", "score")
    if model is None:
        return base.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in base.columns if c != "text" or keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in blocks(batch["text"]):
                b, s = model.predict(data, offsets)
                best.append(b)
                score.append(s)
            named = pa.array(model.langs, pa.string()).take(pa.array(np.concatenate(best)))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), batch["_letters"], named, pa.array(np.concatenate(score))], names=[*kept, "_letters", "_lang", "_score"]
            )

    schema = "".join(f"`{c}` {t}, " for c, t in base.dtypes if c in kept)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    out = base.select("*", letters).mapInArrow(run, f"{schema}_letters boolean, _lang string, _score double")
    return out.select(*kept, F.when(F.col("_letters"), F.col("_lang")).otherwise("und").alias("lang_pred"), F.when(F.col("_letters"), F.col("_score")).otherwise(0.0).alias("score"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marks = identify(docs, fit(docs), keep_text=False)
    return marks.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
