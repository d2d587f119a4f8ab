"""Operator 7: language-model scores by context-tree weighting over bytes.

A text is scored as its lower-cased words, one space after each, and one line feed for the end. Each
byte is eight binary decisions; each decision, given the 0 to ``DEPTH`` bytes before, is a node of a
context tree with a Krichevsky-Trofimov estimate, and the tree weighs all depths: a node's weighted
probability is half its own estimate plus half the product of its children's. The learned counts are
frozen, so the code length of a byte is a function of it and its context.

Counts come from all learned texts. The scan packs texts into shards of about ``SHARD_BYTES`` and
lists, per shard, its distinct contexts with the next byte and its distinct words (for the base
score) with their numbers in learned texts; the packed texts and the lists are written once. Totals
are summed per context. Contexts meet by their two latest bytes to be weighed, or by three where two
are shared by many; the levels above, at most 65,280 nodes, are summed and sent to all tasks. Every shard then gets back, by a join, values
for what it listed, whether a learned text has it or not: no task ever holds the whole model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etholith.llm.common import Words, blocks, lower, query, signed, stored, table
from etholith.llm.quality import fold

DEPTH = 5
SHARD_BYTES = 48 << 20
END = 10


# --- estimates ------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2, by Stirling's series after a shift to 8 and more."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        shift[small] -= np.log(x[small])
        x[small] += 1
    inv = 1 / x
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680 + inv**9 / 1188
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, share of the node's own estimate) from counts and the children's ln product."""
    own = log_estimate(zeros, ones)
    both = np.logaddexp(own, below) + np.log(0.5)
    return both, np.exp(own + np.log(0.5) - both)


def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 8) nodes 1 to 255 of the byte's binary decisions, and the bits taken there."""
    at = np.arange(8)
    node = (1 << at) | (byte[:, None] >> (8 - at))
    return node, (byte[:, None] >> (7 - at)) & 1


#: Rows of a group that are weighed at once; slices end between third-latest bytes.
SLICE = 40_000


class Subtree:
    """The nodes at depth 2 to ``depth`` below one pair of latest bytes, and what they say of each row.

    Depth 3 and deeper are weighed slice by slice; depth 2 (255 nodes) sums over the slices. Rows may be
    those of some third-latest bytes only: their sums add up to the pair's, which :meth:`settle` is given.
    """

    def __init__(self, older: np.ndarray, byte: np.ndarray, n: np.ndarray, depth: int):
        self.node, self.bit = _decisions(byte)
        self.zeros, self.ones, self.below, self.depth = np.zeros(256), np.zeros(256), np.zeros(256), depth
        self.deeper = None if depth == 2 else np.empty(self.node.shape)
        third = older & 255
        order = np.argsort(third, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(third[order])) + 1, len(order))
        a = 0
        while a < len(order):
            b = int(ends[min(np.searchsorted(ends, a + SLICE), len(ends) - 1)])
            rows = order[a:b]
            each = np.repeat(n[rows], 8).astype(np.float64)
            node, bit = self.node[rows].ravel(), self.bit[rows].ravel()
            self.ones += np.bincount(node, each * bit, 256)
            self.zeros += np.bincount(node, each * (1 - bit), 256)
            if depth > 2:
                p, at, weighted = self._slice(older[rows], node, bit, each, depth)
                self.deeper[rows] = p.reshape(-1, 8)
                self.below += np.bincount(at, weighted, 256)
            a = b

    def settle(self, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        """Takes the sums of the whole pair in place of those of its own rows."""
        self.zeros, self.ones, self.below = zeros, ones, below

    @staticmethod
    def _slice(older, node, bit, each, depth):
        """Probabilities as depth 3 and deeper have them; decisions and ln weights of the depth 3 nodes."""
        level, place = np.unique(np.repeat(older, 8) << 8 | node, return_inverse=True)
        ones = np.bincount(place, each * bit, len(level))
        zeros = np.bincount(place, each, len(level)) - ones
        weighted = log_estimate(zeros, ones)
        p = (np.where(bit == 1, ones[place], zeros[place]) + 0.5) / (zeros + ones + 1.0)[place]
        for d in range(depth - 1, 2, -1):
            parent = level >> 8 & ((1 << 8 * (d - 2)) - 1)  # the oldest byte goes
            level, up = np.unique(parent << 8 | (level & 255), return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(level)), np.bincount(up, ones, len(level))
            weighted, stop = weigh(zeros, ones, np.bincount(up, weighted, len(level)))
            place = up[place]
            own = (np.where(bit == 1, ones[place], zeros[place]) + 0.5) / (zeros + ones + 1.0)[place]
            p = stop[place] * own + (1 - stop[place]) * p
        return p, level & 255, weighted

    def probability(self) -> np.ndarray:
        """(rows, 8) probabilities of the decisions taken, as depth 2 and deeper have them."""
        own = (np.where(self.bit == 1, self.ones[self.node], self.zeros[self.node]) + 0.5) / (self.zeros + self.ones + 1.0)[self.node]
        stop = pair_weights(self.zeros, self.ones, self.below, self.depth)[1][self.node]
        return own if self.deeper is None else stop * own + (1 - stop) * self.deeper


def pair_weights(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, own share) of nodes at depth 2; where the tree ends there, their own estimate alone."""
    return (log_estimate(zeros, ones), np.ones(len(zeros))) if depth == 2 else weigh(zeros, ones, below)


class Top:
    """Depths 1 and 0: own shares and counts per latest byte and decision."""

    def __init__(self, latest: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.counts, self.stop = np.zeros((257, 256, 2)), np.full((257, 256), 0.5)
        self.counts[latest, node, 0], self.counts[latest, node, 1] = zeros, ones
        weighted, self.stop[latest, node] = weigh(zeros, ones, below)
        root_zeros, root_ones = np.bincount(node, zeros, 256), np.bincount(node, ones, 256)
        self.counts[256, :, 0], self.counts[256, :, 1] = root_zeros, root_ones
        _, self.stop[256] = weigh(root_zeros, root_ones, np.bincount(node, weighted, 256))

    def mixed(self, latest: int, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        for row in (latest, 256):
            counts = self.counts[row, node]
            own = (np.where(bit == 1, counts[..., 1], counts[..., 0]) + 0.5) / (counts.sum(axis=-1) + 1.0)
            stop = self.stop[row, node]
            p = stop * own + (1 - stop) * p
        return p


# --- texts as bytes and words ---------------------------------------------------------------


class Stream:
    """Scored bytes of a block of texts with their contexts, and their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        words = Words(lower(data), offsets)
        flat, ws, _ = words.joined()
        n = len(offsets) - 1
        edge = np.append(ws, len(flat))[words.first]
        size = np.diff(edge) + 1
        pad = np.arange(n) * depth
        out = np.full(int(size.sum()) + n * depth, END, np.uint8)
        text = np.repeat(np.arange(n), size - 1)
        out[np.arange(len(flat)) + text + (pad + depth)[text]] = flat
        where = np.arange(len(out))
        begin = np.append(0, np.cumsum(size + depth))
        self.text = np.repeat(np.arange(n), size)
        scored = np.ones(len(out), bool)
        for k in range(depth):
            scored[begin[:-1] + k] = False
        at = where[scored]
        code = np.zeros(len(at), np.int64)
        for k in range(depth, -1, -1):
            code = code << 8 | out[at - k]
        self.code, self.words, self.word_text = code, signed(words.hashes()), words.text


def _tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.append(0, np.cumsum(n[order]))
    return keys[begin], sums[np.append(begin[1:], len(keys))[: len(begin)]] - sums[begin]


def _tally_codes(codes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_tally` for zeros and ones as numbers: they ride in the sorted keys' last bit."""
    both = np.sort(codes << 1 | learned)
    keys, ones = both >> 1, np.append(0, np.cumsum(both & 1))
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], ones[np.append(begin[1:], len(keys))[: len(begin)]] - ones[begin]


class Lookup:
    """Values of distinct keys by open addressing; keys are placed block by block, which bounds what placing takes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, block: int = 1 << 17):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.slot = keys, values, np.full(1 << bits, -1, np.int32)
        for a in range(0, len(keys), block):
            left = np.arange(a, min(a + block, len(keys)), dtype=np.int32)
            at = self._home(keys[a : a + block])
            while len(left):
                free = self.slot[at] < 0
                self.slot[at[free]] = left[free]  # of several on one place the last stays
                placed = self.slot[at] == left
                left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        at = self._home(keys)
        found = self.slot[at]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.slot[at[left]]
            left = left[self.keys[found[left]] != keys[left]]
        return self.values[found]


LIST, WORD, TEXT = 0, 1, 2
#: Contexts that two latest bytes may share before the third splits them.
GROUP = 100_000
#: Bytes of text and rows handled at once, and listed keys kept before they are merged: these bound a worker's memory.
BLOCK, ROWS, MERGE = 1 << 18, 1024, 250_000


def packed(depth: int, shard_bytes: int):
    """Rows (shard, kind, key, n, texts): lists of each shard, and its texts as compressed batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = TaskContext.get().partitionId() << 32, 0
        lists = {LIST: [], WORD: []}

        def merged(kind):
            if not lists[kind]:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            return _tally(*(np.concatenate(x) for x in zip(*lists[kind], strict=True)))

        def add(kind, found):
            lists[kind].append(found)
            if sum(len(k) for k, _ in lists[kind][1:]) > MERGE:
                lists[kind] = [merged(kind)]

        def flush():
            for kind in lists:
                key, n = merged(kind)
                lists[kind] = []
                for a in range(0, len(key), 50_000):
                    part = key[a : a + 50_000]
                    yield pa.record_batch({"shard": np.full(len(part), shard), "kind": np.full(len(part), kind, np.int8), "key": part, "n": n[a : a + 50_000], "texts": pa.nulls(len(part), pa.binary())})

        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            for i, j, data, offsets in blocks(batch["text"], BLOCK):
                if size and size + len(data) > shard_bytes:
                    yield from flush()
                    shard, size = shard + 1, 0
                part = batch.slice(i, j - i)
                learned = part["learned"].to_numpy(zero_copy_only=False).astype(np.int64)
                s = Stream(data, offsets, depth)
                add(LIST, _tally_codes(s.code, learned[s.text]))
                add(WORD, _tally(s.words, learned[s.word_text]))
                size += len(data)
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.record_batch({"shard": [shard], "kind": pa.array([TEXT], pa.int8()), "key": [0], "n": [part.num_rows], "texts": pa.array([out.getvalue().to_pybytes()], pa.binary())})
        yield from flush()

    return run


def model_values(lists: DataFrame, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """(key, value): log10 of the byte's probability for every listed context and byte.

    Contexts meet by their two latest bytes. A pair with over ``group`` rows is split by the
    third-latest byte: parts weigh what lies below them, their sums at depth 2 (255 nodes) are added up
    and handed back to each part.
    """
    latest = F.expr("cast((key >> 8) & 65535 AS int)").alias("latest")
    totals = stored(lists.groupBy("key").agg(F.sum("n").alias("n")).select("key", "n", latest))
    sizes = totals.groupBy("latest").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > group) & F.lit(depth > 2))
    large = stored(sizes.select("latest", F.lit(True).alias("_large")))  # at most 65,280 rows
    third = F.when(F.col("_large"), F.expr("cast((key >> 24) & 255 AS int)")).otherwise(-1).alias("third")
    dealt = totals.join(F.broadcast(large), "latest", "left").select("key", "n", "latest", third)
    pair = ["latest", "third"]

    def subtree(rows):
        key = rows["key"].to_numpy()
        return key, Subtree((key >> 24) & ((1 << 8 * (depth - 2)) - 1), key & 255, rows["n"].to_numpy(), depth)

    def part(rows):
        _, tree = subtree(rows)
        node = np.flatnonzero(tree.zeros + tree.ones)
        same = np.full(len(node), rows["latest"][0].as_py(), np.int32)
        return pa.table({"latest": same, "node": node.astype(np.int32), "zeros": tree.zeros[node], "ones": tree.ones[node], "below": tree.below[node]})

    def weighed(batches):
        for batch in batches:
            zeros, ones, below = (batch[c].to_numpy() for c in ("zeros", "ones", "below"))
            last = batch["latest"].to_numpy() & 255
            yield pa.record_batch({"last": last.astype(np.int32), "node": batch["node"], "zeros": zeros, "ones": ones, "below": pair_weights(zeros, ones, below, depth)[0]})

    numbers = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    parts = dealt.groupBy(*pair).applyInArrow(part, "latest int, node int, zeros double, ones double, below double")
    pairs = stored(parts.groupBy("latest", "node").agg(*numbers))
    level = pairs.mapInArrow(weighed, "last int, node int, zeros double, ones double, below double")
    level = level.groupBy("last", "node").agg(*numbers).toArrow().sort_by([("last", "ascending"), ("node", "ascending")])
    sent = lists.sparkSession.sparkContext.broadcast(Top(*(c.to_numpy() for c in level.columns)))

    def valued(rows, whole):
        key, tree = subtree(rows)
        if whole.num_rows:
            sums = np.zeros((3, 256))
            sums[:, whole["node"].to_numpy()] = [whole[c].to_numpy() for c in ("zeros", "ones", "below")]
            tree.settle(*sums)
        p = sent.value.mixed(rows["latest"][0].as_py() & 255, tree.node, tree.bit, tree.probability())
        return pa.table({"key": key, "value": np.log10(p).sum(axis=1)})

    thirds = dealt.filter("third >= 0").select(*pair).distinct()
    handed = thirds.join(pairs, "latest").select(F.col("latest").alias("of"), F.col("third").alias("part"), "node", "zeros", "ones", "below")
    return dealt.groupBy(*pair).cogroup(handed.groupBy("of", "part")).applyInArrow(valued, "key long, value double")


def scores(docs: DataFrame, learned: Column, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, content, learned, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``learned`` says which rows are learned from. Tokens are words and one end per text; null and
    empty texts are an end alone. The base is add-one over the learned tokens. Repeated rows count
    each. The number of tasks follows from the bytes of all texts, so shards stay near ``shard_bytes``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), F.coalesce(learned, F.lit(False)).alias("learned"), "text")
    rows = rows.coalesce(max(1, -(-total // shard_bytes)))
    known = stored(rows.mapInArrow(packed(depth, shard_bytes), "shard long, kind byte, key long, n long, texts binary"))
    lists = known.filter(F.col("kind") == LIST).select("shard", "key", "n")
    codes = lists.join(model_values(lists, depth, group), "key").select("shard", F.lit(LIST).cast("byte").alias("kind"), "key", "value", F.lit(False).alias("first"))
    same = Window.partitionBy("key")
    words = known.filter(F.col("kind") == WORD).select(
        "shard", "kind", "key", F.sum("n").over(same).cast("double").alias("value"), (F.min("shard").over(same) == F.col("shard")).alias("first")
    )
    texts = known.filter(F.col("kind") == TEXT).select(F.col("shard").alias("owner"), "texts")

    def scored(texts, found):
        kind = found["kind"].to_numpy()
        tables = [Lookup(*(found[c].to_numpy()[kind == k] for c in ("key", "value"))) for k in (LIST, WORD)]
        fresh = int(pc.sum(pc.and_(found["first"], pc.greater(found["value"], 0))).as_py() or 0)
        del kind
        out = []
        for raw in texts["texts"]:
            for part in pa.ipc.open_stream(raw.as_py()):
                n = part.num_rows
                tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                for i, j, data, offsets in blocks(part["text"], BLOCK):
                    s = Stream(data, offsets, depth)
                    score[i:j] = np.bincount(s.text, tables[LIST](s.code), j - i)
                    if len(s.words):
                        c = tables[WORD](s.words)
                        tokens[i:j] = np.bincount(s.word_text, minlength=j - i)
                        known[i:j] = np.bincount(s.word_text, c > 0, j - i)
                        base[i:j] = np.bincount(s.word_text, np.log10(c + 1), j - i)
                new = np.zeros(n, np.int64)
                new[:1], fresh = fresh, 0 if n else fresh
                out.append(pa.table([*(part[c] for c in ("doc_id", "content", "learned")), tokens, known, base, score, new], names=["doc_id", "content", "learned", "tokens", "known", "base", "score", "fresh"]))
        return pa.concat_tables(out)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, content long, learned boolean, tokens long, known long, base double, score double, fresh long"
    raw = stored(texts.groupBy("owner").cogroup(codes.union(words).groupBy("shard")).applyInArrow(scored, schema))
    ends, inner, vocabulary = raw.agg(F.count(F.when(F.col("learned"), 1)), F.sum(F.when(F.col("learned"), F.col("tokens")).otherwise(0)), F.sum("fresh")).first()
    train = (inner or 0) + ends
    kinds = (vocabulary or 0) + (1 if ends else 0)
    n_tokens = F.col("tokens") + 1
    base = F.col("base") + F.lit(float(np.log10(ends + 1))) - n_tokens * F.lit(float(np.log10(train + kinds + 1)))
    return raw.select(
        "doc_id", "content", "learned", n_tokens.alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


@query("op7_language_model")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(docs, fold("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
