"""Operator 1: substring dedup by a compressed FM-index per shard.

Equal windows must meet in one shard. A window of ``width`` words is routed by its anchor, the
``gram``-word sequence of smallest hash inside it, so equal windows have equal anchors. Runs of
windows with one anchor form a segment (their words, at most ``2 * width - gram`` of them). Anchors
are counted over the whole corpus; a window whose anchor occurs once occurs once, so only segments
of repeated anchors travel, as text, and equal segments are collapsed with their number before
they reach a shard. Which anchors repeat is told to the scan by a filter of a fixed number of bits
(it may let more pass, never less). Different segments of an anchor with over ``hot`` occurrences, the
contexts of a very common passage, are cut into single windows, which go to shards by their own hash
and are put together again, so that no anchor gathers them all in one task.

Per shard the segments are indexed: a suffix order of the words as deep as the longest segment, its
BWT in a wavelet matrix, and counts of occurrences. Every segment is then streamed through the index
by backward search; the matching statistic at a word is the longest sequence ending there with two
or more occurrences, and intervals of ``width`` words or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import Words, binary, blocks, mix, query, signed, span_hashes, stored, table

WIDTH = 35
GRAM = 8
FILTER_BITS = 26
HOT = 2_000
SHARD_WORDS = 400_000
#: Segments copied out of a block at once.
SLICE = 8_192


# --- the index of one shard -----------------------------------------------------------------


class WaveletMatrix:
    """Ranks over a sequence of small integers: one bit vector with counts per level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            one = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            sums = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=sums[1:])
            self.bits.append(words)
            self.sums.append(sums)
            self.zeros.append(len(seq) - int(one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])
        symbols = np.arange(sigma)
        self.base = self._descend(symbols, np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            at = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.sums[k][at] + np.bitwise_count(self.bits[k][at] & low)
            one = (c >> (self.levels - 1 - k)) & 1
            i = np.where(one == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i``, for arrays of both."""
        return self._descend(c, i) - self.base[c]


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols; ranks of three spans join in a round."""
    n = len(seq)
    rank, span = seq.astype(np.int64), 1
    while True:
        top = int(rank.max()) + 2
        key = rank + 1
        for k in (1, 2):
            key = key * top
            if span * k < n:
                key[: n - span * k] += rank[span * k :] + 1
        order = np.argsort(key, kind="stable")
        span *= 3
        if span >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))


class FMIndex:
    """Words of many segments, each ended by symbol 0; ``weights`` are the segments' numbers of copies."""

    def __init__(self, seq: np.ndarray, segment: np.ndarray, weights: np.ndarray, depth: int):
        sigma = int(seq.max()) + 1
        order = suffix_order(seq, depth)
        self.bwt = WaveletMatrix(seq[order - 1], sigma)
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.before[1:])
        self.copies = np.zeros(len(seq) + 1, np.int64)
        np.cumsum(weights[segment][order], out=self.copies[1:])

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns at once."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]


def repeated_windows(seq: np.ndarray, first: np.ndarray, size: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Per segment a bit for each window (from the left) that has two or more occurrences in the shard.

    ``seq`` holds the segments' word numbers (from 1), each segment followed by 0.
    """
    segment = np.repeat(np.arange(len(first)), size + 1)
    index = FMIndex(seq, segment, weights, int(size.max()))
    flags = np.zeros(len(first), np.int64)
    who = np.arange(len(first))
    end = first + size - 1
    at, lo, hi = end.copy(), np.zeros(len(first), np.int64), np.full(len(first), len(seq))
    while len(who):
        new_lo, new_hi = index.extend(seq[at], lo, hi)
        held = index.copies[new_hi] - index.copies[new_lo] >= 2
        lo, hi = np.where(held, new_lo, 0), np.where(held, new_hi, len(seq))
        at = at - held
        over = ~held | (at < first[who])
        if not over.any():
            continue
        w, e, p = who[over], end[over], at[over]
        length = e - p
        hit = length >= width
        a, n = (p + 1 - first[w])[hit], (length - width + 1)[hit]
        flags[w[hit]] |= ((np.int64(1) << n) - 1) << a
        e = np.where(hit, p + width - 1, e - 1)
        end[over], at[over], lo[over], hi[over] = e, e, 0, len(seq)
        live = end - first[who] >= width - 1
        live[over & (at < first[who])] = False
        if not live.all():
            who, end, at, lo, hi = who[live], end[live], at[live], lo[live], hi[live]
    return flags


# --- segments -------------------------------------------------------------------------------


class Segments:
    """Segments of a block of texts: first word, number of windows, anchor and content hash."""

    def __init__(self, words: Words, width: int, gram: int):
        h = words.hashes()
        n = len(h)
        self.words, self.start, self.count, self.anchor = words, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.width, self.hash = width, h
        if n < width:
            return
        grams = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0xBF58476D1CE4E5B9) + h[k : n - gram + 1 + k]
        grams = mix(grams)
        least, reach = np.uint64(20), width - gram + 1
        found = []
        for a in range(0, n - width + 1, 1 << 19):  # in blocks, so that a position takes 20 bits
            b = min(n - width + 1, a + (1 << 19))
            key = (grams[a : b + reach - 1] >> least << least) | np.arange(b - a + reach - 1, dtype=np.uint64)
            span = 1
            while span * 2 <= reach:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < reach:
                key = np.minimum(key[: -(reach - span)], key[reach - span :])
            found.append((key & np.uint64((1 << 20) - 1)).astype(np.int64) + a)
        place = np.concatenate(found)
        valid = words.text[: n - width + 1] == words.text[width - 1 :]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1] | (words.text[1 : len(place)] != words.text[: len(place) - 1])
        begin = np.flatnonzero(new & valid)
        stop = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid) + 1
        self.start, self.count, self.anchor = begin, stop - begin, grams[place[begin]]

    def routed(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, windows, anchor, content) of the segments that travel."""
        keep = within(repeated, self.anchor)
        start, count = self.start[keep], self.count[keep]
        return start, count, self.anchor[keep], span_hashes(self.hash, start, start + count + self.width - 1)


def within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds; two bits per key."""
    size = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & size
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of the column ``anchor``: at most ``2 ** bits / 64`` words come to the driver, whatever the input."""
    place = F.explode(F.array(F.col("anchor"), F.shiftrightunsigned("anchor", 32))).alias("p")
    at = keys.select(place).select((F.col("p").bitwiseAND((1 << bits) - 1)).alias("p"))
    words = at.groupBy(F.shiftrightunsigned("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("value")
    )
    out = np.zeros((1 << bits) // 64, np.uint64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch["text"]):
                found = Segments(Words(data, offsets), width, gram)
                key, n = np.unique(found.anchor, return_counts=True)
                yield pa.record_batch({"anchor": signed(key), "n": n.astype(np.int64)})

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, filter_bits: int = FILTER_BITS, hot: int = HOT) -> DataFrame:
    """(doc_id, content of the row, start, bits): windows of ``width`` words that occur more than once.

    Bit ``i`` stands for the window that starts at word ``start + i``. Rows are told apart by
    ``doc_id`` and ``xxhash64(text)``; equal rows are copies of each other. Null and short texts
    have no window.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    counted = texts.select("text").mapInArrow(_anchors(width, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counted = stored(counted.filter("n > 1"))
    repeated = spark.sparkContext.broadcast(_filter(counted, filter_bits))
    crowded = counted.filter(F.col("n") > hot)
    some = crowded.limit(1).count() > 0
    many = spark.sparkContext.broadcast(_filter(crowded, 20))

    def distinct(batches):
        for batch in batches:
            for _, _, data, offsets in blocks(batch["text"]):
                words = Words(data, offsets)
                start, count, key, content = Segments(words, width, gram).routed(repeated.value)
                if not len(start):
                    continue
                _, one, n = np.unique(content, return_index=True, return_counts=True)
                flat, ws, we = words.joined()
                for a in range(0, len(one), SLICE):
                    part = one[a : a + SLICE]
                    seg = binary(flat, ws[start[part]], we[start[part] + count[part] + width - 2])
                    yield pa.record_batch({"key": signed(key[part]), "seg": seg, "n": n[a : a + SLICE].astype(np.int64), "many": pa.array(within(many.value, key[part]))})

    def indexed(batches):
        held, size = [], 0
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            while batch.num_rows:  # shards end between keys
                key = batch["key"].to_numpy()
                length = np.cumsum(np.asarray(pa.compute.binary_length(batch["seg"]))) // 5
                cut = int(np.searchsorted(length, SHARD_WORDS - size)) if size < SHARD_WORDS else 0
                last = held[-1]["key"][-1].as_py() if held else None
                while cut < len(key) and key[cut] == (key[cut - 1] if cut else last):
                    cut += 1
                cut = cut if cut or held else 1
                if cut:
                    held.append(batch.slice(0, cut))
                    size += int(length[cut - 1])
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield from searched(pa.concat_tables(held))
                    held, size = [], 0
        if held:
            yield from searched(pa.concat_tables(held))

    def searched(shard):
        shard = shard.combine_chunks()
        _, _, data, offsets = next(blocks(shard["seg"], 1 << 62))
        words = Words(data, offsets)
        h = words.hashes()
        _, ids = np.unique(h, return_inverse=True)
        n = np.diff(words.first)
        first = words.first[:-1] + np.arange(len(n))
        seq = np.zeros(len(ids) + len(n), np.int64)
        seq[np.arange(len(ids)) + words.text] = ids + 1
        flags = repeated_windows(seq, first, n, shard["n"].to_numpy(), width)
        content = span_hashes(h, words.first[:-1], words.first[1:])
        hit = flags != 0
        for a in range(0, int(hit.sum()), 50_000):
            rows = np.flatnonzero(hit)[a : a + 50_000]
            yield pa.record_batch({"key": shard["key"].to_numpy()[rows], "seg_hash": signed(content[rows]), "bits": flags[rows]})

    def placed(batches):
        for batch in batches:
            for i, j, data, offsets in blocks(batch["text"]):
                words = Words(data, offsets)
                start, _, key, content = Segments(words, width, gram).routed(repeated.value)
                row = words.text[start]
                part = batch.slice(i, j - i)
                yield pa.record_batch(
                    {
                        "doc_id": part["doc_id"].take(pa.array(row)),
                        "content": part["content"].take(pa.array(row)),
                        "start": start - words.first[row],
                        "key": signed(key),
                        "seg_hash": signed(content),
                    }
                )

    def windows(batches):
        for batch in batches:
            for i, j, data, offsets in blocks(batch["seg"]):
                words = Words(data, offsets)
                h = words.hashes()
                n = np.diff(words.first) - width + 1
                owner = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = words.first[owner] + at
                own = span_hashes(h, words.first[:-1], words.first[1:])
                content = span_hashes(h, start, start + width)
                part = batch.slice(i, j - i)
                for a in range(0, len(owner), SLICE):
                    b = slice(a, a + SLICE)
                    seg = binary(data, words.starts[start[b]], words.ends[start[b] + width - 1])
                    yield pa.record_batch(
                        {
                            "key": signed(content[b]),
                            "seg": seg,
                            "n": part["n"].take(pa.array(owner[b])),
                            "of_key": part["key"].take(pa.array(owner[b])),
                            "of_hash": signed(own[owner[b]]),
                            "at": at[b],
                        }
                    )

    def searched_by_key(segments):
        return segments.repartition("key").sortWithinPartitions("key").mapInArrow(indexed, "key long, seg_hash long, bits long")

    segments = texts.select("text").mapInArrow(distinct, "key long, seg binary, n long, many boolean")
    segments = segments.groupBy("key", "seg", "many").agg(F.sum("n").alias("n")).select("key", "seg", "n", "many")
    if some:
        segments = stored(segments)
        single = segments.filter("many").select("key", "seg", "n").repartition("key", "seg").mapInArrow(windows, "key long, seg binary, n long, of_key long, of_hash long, at long")
        alone = single.groupBy("key", "seg").agg(F.sum("n").alias("n"))
        hits = stored(searched_by_key(segments.filter("NOT many").select("key", "seg", "n").union(alone)))
        back = single.select("key", "of_key", "of_hash", "at").join(hits.select("key"), "key")
        back = back.groupBy("of_key", "of_hash").agg(F.bit_or(F.expr("shiftleft(1L, cast(at AS int))")).alias("bits"))
        found = hits.union(back)
    else:
        found = searched_by_key(segments.select("key", "seg", "n"))
    kind = dict(docs.dtypes)["doc_id"]
    where = texts.mapInArrow(placed, f"doc_id {kind}, content long, start long, key long, seg_hash long")
    return where.join(found, ["key", "seg_hash"]).select("doc_id", "content", "start", "bits")


def mark_repeats(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """``docs`` with n_words, n_removed, kept (the text's words outside repeated windows, joined by one space).

    All columns of ``docs`` but clashing ones stay. Null and empty texts have no words: 0, 0, ''.
    Repeated rows are copies of each other. Only per-text lists of spans meet the texts again.
    """
    spans = (
        repeated_spans(docs, width, **how)
        .groupBy("doc_id", "content")
        .agg(F.sort_array(F.collect_set(F.struct("start", "bits"))).alias("_spans"))
        .select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "_spans")
    )
    base = docs.select([c for c in docs.columns if c not in ("n_words", "n_removed", "kept")])
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content")), "left").drop("_id", "_content")

    def kept(batches):
        for batch in batches:
            spans, texts = batch["_spans"], batch["text"]
            total, gone, out = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split() if not spans[i].is_valid else None
                if words is None:
                    raw = np.array(texts[i].as_py().encode().split(), dtype=object)
                    rows = spans[i].values
                    start, bits = rows.field("start").to_numpy(), rows.field("bits").to_numpy()
                    at, bit = np.nonzero((bits[:, None] >> np.arange(width)) & 1)
                    edge = np.zeros(len(raw) + width + 1, np.int64)
                    np.add.at(edge, start[at] + bit, 1)
                    np.add.at(edge, start[at] + bit + width, -1)
                    clear = np.cumsum(edge)[: len(raw)] == 0
                    words = list(raw[clear])
                    total.append(len(raw))
                else:
                    total.append(len(words))
                gone.append(total[-1] - len(words))
                out.append(b" ".join(words).decode())
            rest = batch.drop_columns(["_spans"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
                names=[*rest.schema.names, "n_words", "n_removed", "kept"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return joined.mapInArrow(kept, f"{schema}, n_words long, n_removed long, kept string")


SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, k, md5(array_to_string(ws[k:k + 34], ' ')) AS h FROM d, unnest(range(1, len(ws) - 33)) t(k)),
again AS (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM w JOIN again USING (h)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


@query("op1_substring_dedup", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
