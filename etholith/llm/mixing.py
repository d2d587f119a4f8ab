"""Operator 4: mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etholith.llm.common import query, stored, table
from etholith.operators.ordered import row_index

CAP = 3
#: Parts that rows of equal id, source and text are numbered in.
PARTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... A target stops at ``cap`` times
    the source's size and the excess goes to the others by weight. Ranks come from key ranges, and
    each round of sharing is one aggregate of the source table; the driver holds its sums only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_last", F.struct(F.col("source").isNull(), "source"))
    ranked = row_index(per.withColumn("_all", F.lit(1)), ["_all"], ["_last"], "_rank")
    ranked = stored(ranked.select("source", "source_size", (1 + F.col("_rank") % 3).cast("long").alias("w"), (cap * F.col("source_size")).alias("most")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        capped = F.lit(level) * F.col("w") > F.col("most") if level is not None else F.lit(False)
        most, weight, n = ranked.agg(
            F.sum(F.when(capped, F.col("most")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("w"))), F.count(F.when(capped, 1))
        ).first()
        if n == full or not weight:
            break
        full, level = n, (total - most) / weight
    share = F.lit(float(level or 0)) * F.col("w")
    return ranked.select("source", "source_size", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share).alias("target"))


def content() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def draw(doc_id: str, content: str, nth: str) -> Column:
    """A number in [0, 1): 52 bits of the MD5 of id, text digest and the row's number among equal rows."""
    text = F.concat(F.lit("mix-"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("-"), F.col(nth).cast("string"), F.lit("-"), F.col(content))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``: the number, from 0, of a row among those of equal doc_id, source and ``_content``.

    Only rows that are equal to others are exchanged; their places are cut into ``PARTS`` parts that are
    numbered apart and shifted by the sizes of earlier parts, so no task sees more than a part of them.
    """
    names = ["doc_id", "source", "_content"]
    keys = rows.groupBy(names).count().filter("count > 1").select([F.col(c).alias(f"_key_{c}") for c in names])
    keys = stored(keys)
    if keys.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in names]
    once = rows.join(keys, same, "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    many = stored(rows.join(keys, same, "left_semi").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))))
    sizes = many.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select([F.col(c).alias(f"_key_{c}") for c in names] + [F.col("_part").alias("_key_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")])
    own = many.withColumn("_in", F.row_number().over(Window.partitionBy(*names, "_part").orderBy(F.lit(0))) - 1)
    shifted = own.join(shift, [*same, F.col("_part") == F.col("_key_part")]).withColumn("_nth", F.col("_in") + F.col("_before"))
    return once.unionByName(shifted.select(*rows.columns, "_nth"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate) and one more where the draw falls below the fraction."""
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def rated(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, _content, ...) with source_size, target and copies."""
    per = per.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = numbered(rows).join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("copies", copies(rate, draw("doc_id", "_content", "_nth")).cast("long")).drop("_nth", "_content")


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    ``copies`` is floor(target / source_size) plus one with the probability of the fraction, drawn
    from doc_id, text and the row's number among rows of equal doc_id, source and text: reruns and
    retries agree, and rows without an id or with a repeated one are drawn one by one. Null and empty
    texts have size 0; a source of size 0 has target 0 and no copies.
    """
    sizes = stored(docs.select("doc_id", "source", size_of("text").alias("size"), content().alias("_content")))
    return rated(sizes, targets(sizes, cap))


def emit(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, numbered from 0 in ``copy``.

    Of rows that agree in doc_id, source and text but not in other columns any may be the one taken
    once more.
    """
    per = targets(docs.select("source", size_of("text").alias("size")), cap)
    base = docs.drop("copy", "copies", "source_size", "target", "_source")
    n = F.col("copies").cast("int")
    return (
        rated(base.withColumn("_content", content()), per)
        .withColumn("copy", F.explode(F.array_remove(F.sequence(F.lit(0), n), n)))
        .select(*base.columns, "copy")
    )


SQL_TARGETS = """sizes AS (SELECT doc_id, source, md5(coalesce(text, '')) AS content,
  row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT source, source_size, 3 * source_size AS most,
  1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM per),
line AS (SELECT *, sum(most) OVER o - most AS full_most, sum(w) OVER o - w AS full_w, sum(source_size) OVER () AS total,
  sum(w) OVER () AS w_all, row_number() OVER o AS k FROM ranked WINDOW o AS (ORDER BY most / w, source ROWS UNBOUNDED PRECEDING)),
level AS (SELECT coalesce(arg_min(l, k) FILTER (most / w >= l), 0) AS l
  FROM (SELECT *, CAST(total - full_most AS DOUBLE) / CAST(w_all - full_w AS DOUBLE) AS l FROM line)),
per_source AS (SELECT source, source_size, least(l * w, CAST(most AS DOUBLE)) AS target FROM ranked, level),
drawn AS (SELECT sizes.doc_id, sizes.source, size, source_size, target,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '-' || nth || '-' || content), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sizes JOIN per_source ON sizes.source IS NOT DISTINCT FROM per_source.source)"""


@query(
    "op4_mix_sources",
    f"WITH {SQL_TARGETS} SELECT doc_id, size, source_size, target, "
    "CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
