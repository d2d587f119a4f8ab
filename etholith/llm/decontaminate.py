"""Operator 10: benchmark decontamination over a distributed positional inverted index.

``build_index`` writes, for shards of whole documents, one posting list per term: the positions of
the term among the shard's words, ascending. ``search`` takes the benchmark in blocks of a bounded
size; of each shard only the lists of the block's terms are read. A window's lists are intersected
from its rarest term in the shard to its most frequent one, each shifted by the term's place in the
window. With ``slop`` above zero a list may be met up to that many words off, which gives proximity
matches beside exact ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from etholith.llm.common import ALNUM, Words, binary, blocks, lower, query, stored, table

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, term, n, positions, rows, first): the stored index of ``docs`` (doc_id, text).

    A row with a term is its posting list, 32-bit positions in ``positions``. Per shard one row
    with a null term lists its documents (doc_id and ``xxhash64(text)``) and their first words.
    Documents are never cut; a longer one is a shard of its own.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, data, offsets in blocks(batch["text"], shard_bytes):
                serial += 1
                words = Words(lower(data), offsets, ALNUM)
                h = words.hashes()
                order = np.argsort(h, kind="stable").astype(np.int32)
                ordered = h[order]
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
                stop = np.append(begin[1:], len(h)) if len(h) else begin
                one = order[begin]
                terms = binary(words.data, words.starts[one], words.ends[one]).cast(pa.string())
                lists = pa.Array.from_buffers(
                    pa.binary(), len(begin), [None, pa.py_buffer((np.append(begin, len(h)) * 4).astype(np.int32)), pa.py_buffer(order)]
                )
                rows = pa.StructArray.from_arrays([batch["doc_id"].slice(i, j - i), batch["content"].slice(i, j - i)], names=["doc_id", "content"])
                none = pa.nulls(1, pa.string())
                for a in range(0, len(begin), 20_000):
                    part = slice(a, min(len(begin), a + 20_000))
                    n = part.stop - part.start
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, serial)),
                            terms.slice(part.start, n),
                            pa.array((stop - begin)[part]),
                            lists.slice(part.start, n),
                            pa.nulls(n, pa.list_(rows.type)),
                            pa.nulls(n, pa.list_(pa.int64())),
                        ],
                        names=NAMES,
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([serial]),
                        none,
                        pa.array([len(h)]),
                        pa.nulls(1, pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                        pa.array([words.first], pa.list_(pa.int64())),
                    ],
                    names=NAMES,
                )

    schema = f"shard long, term string, n long, positions binary, rows array<struct<doc_id:{kind},content:long>>, first array<long>"
    return stored(docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(run, schema))


NAMES = ["shard", "term", "n", "positions", "rows", "first"]


class Windows:
    """Windows of a block of items: term numbers (-1 past the end), length, item."""

    def __init__(self, items: pd.DataFrame, width: int):
        data = np.frombuffer(b"\n".join((t or "").encode() for t in items["text"]), np.uint8)
        size = np.array([len((t or "").encode()) for t in items["text"]], np.int64)
        offsets = np.append(np.cumsum(size + 1) - size - 1, max(len(data), 0)) if len(size) else np.zeros(1, np.int64)
        words = Words(lower(data), offsets, ALNUM)
        raw = words.data.tobytes()
        text = np.array([raw[s:e].decode() for s, e in zip(words.starts, words.ends, strict=True)], dtype=object)
        self.terms, ids = np.unique(text, return_inverse=True) if len(text) else (text, np.zeros(0, np.int64))
        n = np.diff(words.first)
        number = np.where(n == 0, 0, np.maximum(1, n - width + 1))
        self.item = np.repeat(np.arange(len(n)), number)
        start = np.repeat(words.first[:-1] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        self.length = np.minimum(width, n[self.item])
        place = start[:, None] + np.arange(width)
        self.ids = np.where(np.arange(width) < self.length[:, None], ids[np.minimum(place, max(len(ids) - 1, 0))] if len(ids) else -1, -1)
        self.item_ids = items["item_id"].tolist()


def intersect(win: Windows, n_terms: np.ndarray, flat: np.ndarray, begin: np.ndarray, first: np.ndarray, slop: int):
    """(window, first word, most words off) of all matches in one shard.

    ``flat`` has the posting lists one after another, that of term ``t`` at ``begin[t]`` with
    ``n_terms[t]`` positions; ``first`` the first word of each document and the number of words.
    A window matches at a place if each of its words occurs, in the same document, no more than
    ``slop`` words from where the window has it.
    """
    width, span = win.ids.shape[1], int(first[-1]) + 4 * slop + 64
    number = np.where(win.ids >= 0, n_terms[win.ids], np.iinfo(np.int64).max)
    alive = np.flatnonzero((number > 0).all(axis=1) & (win.length > 0))
    order = np.argsort(number[alive], axis=1, kind="stable")
    key = np.repeat(np.arange(len(n_terms)), n_terms) * span + flat + slop
    rare = win.ids[alive, order[:, 0]]
    n = n_terms[rare]
    w = np.repeat(np.arange(len(alive)), n)
    at = np.repeat(begin[rare] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    start = flat[at].astype(np.int64) - order[w, 0]
    if slop:  # the rarest word, too, may be off
        shift = np.arange(-slop, slop + 1)
        pairs = np.unique(np.stack([np.repeat(w, len(shift)), (start[:, None] + shift).ravel()], axis=1), axis=0)
        w, start = pairs[:, 0], pairs[:, 1]
    ok = (start >= 0) & (start < first[-1])
    w, start = w[ok], start[ok]
    doc = np.searchsorted(first, start, "right") - 1
    ok = first[doc + 1] >= start + win.length[alive[w]]
    w, start, doc = w[ok], start[ok], doc[ok]
    off = np.zeros(len(w), np.int64)
    for k in range(0 if slop else 1, width):
        place = order[w, k]
        term = win.ids[alive[w], place]
        past = term < 0
        home = np.where(past, 0, term) * span + slop
        want, low, high = home + start + place, home + first[doc], home + first[doc + 1]
        right = np.searchsorted(key, want)
        after, before = key[np.minimum(right, len(key) - 1)], key[np.maximum(right - 1, 0)]
        gap = np.minimum(
            np.where((after >= want) & (after < high), after - want, span), np.where((before >= low) & (before < want), want - before, span)
        )
        gap = np.where(past, 0, gap)
        ok = gap <= slop
        w, start, doc, off = w[ok], start[ok], doc[ok], np.maximum(off, gap)[ok]
    return alive[w], start, off


def search(index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, content, n_words, spans, items, n_near) for every row of the index.

    ``spans`` are the merged [from, to) word ranges inside exact matches, ``items`` the sorted
    item_ids with an exact match, ``n_near`` the number of windows that match with words up to
    ``slop`` off and nowhere in the document exactly.
    The benchmark goes through in blocks of ``block_bytes`` (by running sums of text sizes), each
    against all shards; more blocks mean more passes over the index, never fewer items.
    """
    spark = index.sparkSession
    key_type = benchmark.schema["item_id"].dataType
    listed = benchmark.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = listed.agg(F.sum("size")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_bytes))
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    out_type = T.StructType(
        [
            *index.schema["rows"].dataType.elementType.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
            T.StructField("items", T.ArrayType(key_type)),
            T.StructField("n_near", T.LongType()),
        ]
    )
    def matcher(sent):
        def matched(lists):
            win = sent.value
            head = lists.filter(pa.compute.is_null(lists["term"])).combine_chunks()
            rows, first = head["rows"].chunk(0).values, head["first"].chunk(0).values.to_numpy()
            lists = lists.filter(pa.compute.is_valid(lists["term"])).sort_by("number").combine_chunks()
            n_terms, begin = np.zeros(len(win.terms) + 1, np.int64), np.zeros(len(win.terms) + 1, np.int64)
            n_terms[lists["number"].to_numpy().astype(np.int64)] = lists["n"].to_numpy()
            begin[1:] = np.cumsum(n_terms[:-1])
            flat = np.frombuffer(b"".join(lists["positions"].to_pylist()), np.int32)
            size, n_docs = np.diff(first), len(first) - 1
            spans, items, near = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)], np.zeros(n_docs, np.int64)
            if len(flat):
                w, start, off = intersect(win, n_terms, flat, begin, first, slop)
                doc = np.searchsorted(first, start, "right") - 1
                exact = off == 0
                kinds = len(win.length)
                only = np.setdiff1d(doc[~exact] * kinds + w[~exact], doc[exact] * kinds + w[exact])
                near += np.bincount(only // kinds, minlength=n_docs)
                w, start, doc = (x[exact] for x in (w, start, doc))
                cover = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + win.length[w], -1)
                hit = np.cumsum(cover) > 0
                cut = np.zeros(len(hit) + 1, bool)
                cut[first] = True
                a = np.flatnonzero(hit & (~np.append(False, hit[:-1]) | cut[:-1]))
                b = np.flatnonzero(hit & (~np.append(hit[1:], False) | cut[1:])) + 1
                for d, x, y in zip((np.searchsorted(first, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
                    spans[d].append({"from": x - int(first[d]), "to": y - int(first[d])})
                for d, k in sorted(set(zip(doc.tolist(), win.item[w].tolist(), strict=True))):
                    items[d].append(win.item_ids[k])
            columns = [rows.field("doc_id"), rows.field("content"), pa.array(size), spans, [list(dict.fromkeys(x)) for x in items], near]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(out_type), strict=True)], names=out_type.names)

        return matched

    parts = []
    for block in range(n_blocks):
        chosen = dealt.filter(F.col("block") == block).select("item_id", "text")
        win = Windows(chosen.orderBy("item_id", "text").toPandas(), width)
        known = spark.createDataFrame([(t, k) for k, t in enumerate(win.terms)], "term string, number long")
        needed = index.join(F.broadcast(known), "term", "left").filter("term IS NULL OR number IS NOT NULL")
        parts.append(needed.groupBy("shard").applyInArrow(matcher(spark.sparkContext.broadcast(win)), out_type))
    if n_blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # The k-th equal row of each block is one row of the corpus.
    merged = every.groupBy("doc_id", "content").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("n_near").alias("n_near"),
        F.expr(f"count(*) div {n_blocks}").alias("copies"),
    )
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<from:bigint,to:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= s["from"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return merged.withColumn("spans", joined).select(*out_type.names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k")).drop("_k")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """:func:`search` over a fresh index of ``docs``. Null and empty texts have no words and no hits."""
    return search(build_index(docs.select("doc_id", "text"), shard_bytes), benchmark, width, slop, block_bytes)


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without any exact benchmark window."""
    hit = contamination(docs, benchmark, **how).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content")), "left_anti")


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark),
iw AS (SELECT item_id, least(len(ws), 10) AS n, md5(array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ')) AS h
  FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(k) WHERE len(ws) > 0),
dw AS (SELECT r, k, n, md5(array_to_string(ws[k:k + n - 1], ' ')) AS h FROM d, (SELECT DISTINCT n FROM iw) s, unnest(range(1, len(ws) - n + 2)) t(k)),
m AS (SELECT DISTINCT r, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.h = iw.h),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)"""


@query("op10_decontaminate", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )
