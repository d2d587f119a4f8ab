"""Order statistics inside groups of any size.

A plain window partitioned by the group puts a hot group into one task. Here an
ordered group is cut into value ranges first: a bounded, hash-chosen sample of
the ordering keys (at most ``RANGES - 1`` of them, picked by smallest hash, so the
choice does not depend on how rows are spread) gives the split points; running
aggregates are computed inside each (group, range) and shifted by what the
earlier ranges of the group hold. The only window over a whole group sees one
row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
RANGES = 1 + sum(_STEPS)

_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def with_range(df: DataFrame, order: str, out: str = "_range") -> DataFrame:
    """Add the number of the key range a row's ``order`` value falls into."""
    key = F.col(order)
    sample = (
        df.filter(key.isNotNull())
        .select(key.alias("k"))
        .distinct()  # a value shared by many rows or groups takes one place
        .orderBy(F.xxhash64("k"), "k")
        .limit(RANGES - 1)
        .agg(F.sort_array(F.collect_list("k")).alias("points"))
    )
    points = F.col("_points")
    # Binary search: ever smaller steps while the point reached is not above the key.
    found = F.aggregate(
        F.array(*[F.lit(step) for step in _STEPS]),
        F.lit(0),
        lambda at, step: at + F.when(F.get(points, at + step - 1) <= key, step).otherwise(0),
    )
    return df.withColumn("_points", sample.scalar()).withColumn(out, found).drop("_points")


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` that also pairs NULL groups; keeps the left keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    outs: Mapping[str, tuple[str, Column]],
    totals: Mapping[str, Column] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Inclusive running aggregates along ``order`` inside each group.

    ``outs`` maps an output name to ``(kind, column)``, kind being sum, max or
    min; ``totals`` adds group-wide sums. ``order`` must be unique in a group.
    """
    by = list(by)
    # A frame that already carries its ranges (same order column) is not sampled again.
    ranged = df if "_range" in df.columns else with_range(df, order)
    totals = dict(totals or {})

    def along(column: str) -> Column:
        return F.col(column).desc() if reverse else F.col(column).asc()

    before = (
        Window.partitionBy(*by).orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    per_range = ranged.groupBy(*by, "_range").agg(
        *[_KINDS[kind](col).alias(f"_v_{name}") for name, (kind, col) in outs.items()],
        *[F.sum(col).alias(f"_t_{name}") for name, col in totals.items()],
    )
    # One seed row per range holds what the earlier ranges amount to. It enters the range's
    # window as its first row, so rows are shuffled once and never joined.
    seeds = per_range.select(
        *by,
        "_range",
        F.lit(True).alias("_seed"),
        *[_KINDS[kind](f"_v_{name}").over(before).alias(f"_v_{name}") for name, (kind, _) in outs.items()],
        *[F.sum(f"_t_{name}").over(whole).alias(f"_t_{name}") for name in totals],
    )
    own = ranged.select(
        "*", F.lit(False).alias("_seed"), *[col.alias(f"_v_{name}") for name, (_, col) in outs.items()]
    )
    inner = (
        Window.partitionBy(*by, "_range")
        .orderBy(F.col("_seed").desc(), along(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        own.unionByName(seeds, allowMissingColumns=True)
        .select(
            *df.columns,
            "_seed",
            *[_KINDS[kind](f"_v_{name}").over(inner).alias(name) for name, (kind, _) in outs.items()],
            *[F.max(f"_t_{name}").over(inner).alias(name) for name in totals],
        )
        .filter(~F.col("_seed"))
        .drop("_seed")
    )


def tie_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    extra: Mapping[str, Column] | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """One row per group and distinct value with its place in the group.

    Columns: the group, ``value``, ``n_ties``, ``n_below`` (rows with a smaller
    value), ``n_group``, ``avg_rank`` (mid-rank) and the ``extra`` aggregates.
    Rows are collapsed to distinct values before anything is ordered.
    """
    col = F.col(value) if isinstance(value, str) else value
    distinct = (
        df.withColumn("value", col)
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n_ties"), *[c.alias(n) for n, c in (extra or {}).items()])
    )
    if keep_range:
        distinct = with_range(distinct, "value")
    placed = running(
        distinct, by, "value", {"_cum": ("sum", F.col("n_ties"))}, {"n_group": F.col("n_ties")}
    )
    below = F.col("_cum") - F.col("n_ties")
    return (
        placed.withColumn("n_below", below)
        .withColumn("avg_rank", F.col("n_below") + (F.col("n_ties") + 1) / F.lit(2.0))
        .drop("_cum")
    )


def quantiles(
    df: DataFrame, by: Sequence[str], value: str | Column, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated (type 7) quantiles per group, e.g. ``{"median": 0.5}``."""
    return quantiles_of(tie_ranks(df, by, value), by, probs)


def quantiles_of(
    ranks: DataFrame, by: Sequence[str], probs: Mapping[str, float], *aggs: Column
) -> DataFrame:
    """Quantiles, and any further aggregates, from :func:`tie_ranks` rows."""

    def at(index: Column) -> Column:
        inside = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_ties"))
        return F.max(F.when(inside, F.col("value")))

    parts = []
    for name, p in probs.items():
        place = (F.col("n_group") - 1) * F.lit(float(p))
        low = F.floor(place)
        parts += [
            at(low).alias(f"_lo_{name}"),
            at(low + 1).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_w_{name}"),
        ]
    grouped = ranks.groupBy(*by).agg(*parts, F.max("n_group").alias("_n"), *aggs)
    keep = [c for c in grouped.columns if not c.startswith(("_lo_", "_hi_", "_w_", "_n"))]
    return grouped.select(
        *keep,
        *[
            F.when(F.col(f"_w_{name}") == 0, F.col(f"_lo_{name}").cast("double"))
            .otherwise(
                F.col(f"_lo_{name}")
                + F.col(f"_w_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
            )
            .alias(name)
            for name in probs
        ],
    )


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based position of each row in its group by a key that is unique there.

    The group size is added as ``n_group``.
    """
    placed = running(
        df.withColumn("_key", F.struct(*order)),
        by,
        "_key",
        {"_place": ("sum", F.lit(1).cast("long"))},
        {"n_group": F.lit(1).cast("long")},
    )
    return placed.withColumn(out, F.col("_place") - 1).drop("_key", "_place")


def with_group_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates by partial aggregation and a join, not a window."""
    if not by:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return df.withColumns({n: one.select(n).scalar() for n in aggs})
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_safe_join(df, stats, list(by))
