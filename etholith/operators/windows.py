"""Per-group order and normalisation on tables of any group size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from etholith.functions.ids import run_priority
from etholith.operators.frames import CHUNK, dense_index, expand_ranges, gaps, last_known
from etholith.operators.joins import complete, first_per_key
from etholith.operators.ordered import null_safe_join, row_index, tie_ranks, with_group_stats

THIRDS = ("Anterior", "Middle", "Posterior")


def rc_thirds(
    df: DataFrame, by: Sequence[str], section: str, tie: str, out: str = "rc_bin"
) -> DataFrame:
    """Thirds of the section order per animal; NULL under three rows or with a NULL section."""
    by = list(by)
    guarded = with_group_stats(
        df, by, _n=F.count(F.lit(1)), _known=F.count(section)
    )
    placed = row_index(guarded, by, [section, tie], "_idx")
    n, i = F.col("n_group"), F.col("_idx")
    size, extra = F.floor(n / 3), n % 3
    # The first `extra` tiles hold one row more.
    big = extra * (size + 1)
    tile = F.when(i < big, F.floor(i / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(i - big, size))
    )
    label = F.get(F.array(*[F.lit(t) for t in THIRDS]), tile.cast("int"))
    usable = (F.col("_n") >= 3) & (F.col("_n") == F.col("_known"))
    return placed.withColumn(out, F.when(usable, label)).drop("_n", "_known", "_idx", "n_group")


def cohort_order(df: DataFrame, cohort: str, order: Sequence[str], out: str = "cohort_order") -> DataFrame:
    return row_index(df, [cohort], order, "_idx").withColumn(out, F.col("_idx") + 1).drop("_idx", "n_group")


def z_score(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean)/sd inside the group; 0 where the sd is 0."""
    stats = with_group_stats(df, by, _m=F.avg(value), _s=F.stddev_samp(value))
    return stats.withColumn(
        out,
        F.when(F.col("_s") == 0, 0.0).otherwise(F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))),
    ).drop("_m", "_s")


def min_max_norm(df: DataFrame, by: Sequence[str], value: str, out: str = "value_norm") -> DataFrame:
    """Position in the range of finite values; 0.5 where there is no range."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    stats = with_group_stats(df, by, _lo=F.min(finite), _hi=F.max(finite))
    spread = F.col("_hi") - F.col("_lo")
    return stats.withColumn(
        out, F.when(F.coalesce(spread, F.lit(0.0)) <= 0, 0.5).otherwise((finite - F.col("_lo")) / spread)
    ).drop("_lo", "_hi")


def first_event(
    bouts: DataFrame, by: Sequence[str] = ("animal_id", "session_type"), order: Sequence[str] = ("start_sec", "ord")
) -> DataFrame:
    """Earliest bout per group with its behaviour and actor."""
    return first_per_key(bouts, list(by), list(order)).select(
        *by,
        F.col("start_sec").alias("latency_sec"),
        F.col("behavior").alias("first_behavior"),
        F.col("actor").alias("first_actor"),
    )


def censored_latency(
    bouts: DataFrame, qualifying: Sequence[str], sessions: Sequence[str]
) -> DataFrame:
    """First qualifying bout per animal and session; the session length where there is none."""
    found = first_event(bouts.filter(F.col("behavior").isin(*qualifying)))
    lengths = bouts.groupBy("session_type").agg(F.max("end_sec").alias("session_sec"))
    return (
        complete(found, bouts.select("animal_id"), {"session_type": sessions})
        .join(lengths, "session_type", "left")
        .withColumn("censored", F.col("latency_sec").isNull())
        .withColumn("latency_sec", F.coalesce("latency_sec", "session_sec"))
    )


def avg_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Mid-rank of each row inside its group; NULL values have none."""
    by = list(by)
    ranks = tie_ranks(df, by, value).select(*by, F.col("value").alias(value), F.col("avg_rank").alias(out))
    ranked = null_safe_join(df.filter(F.col(value).isNotNull()), ranks, [*by, value])
    return ranked.unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True)


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, list(key), list(order))


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def dedupe_prefer_coords(
    df: DataFrame, key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per key, one with coordinates if there is any; then the smallest by ``order``."""
    ranked = df.withColumn("_blank", (F.col("x").isNull() | F.col("y").isNull()).cast("int"))
    return first_per_key(ranked, list(key), ["_blank", *order]).drop("_blank")


def priority_merge(
    runs: DataFrame, key: Sequence[str] = ("animal_id",), axis: str = "frame_id"
) -> DataFrame:
    """Rows of the highest-priority run of each frame; that run wins the whole frame.

    ``resume`` and ``resume1`` share a priority; the larger name wins then.
    """
    by = [*key, axis]
    ranked = runs.withColumn("_p", F.struct(run_priority(F.col("run_name")).alias("p"), "run_name"))
    ranked = ranked.filter(F.col("_p.p").isNotNull())
    best = ranked.groupBy(*by).agg(F.max("_p").alias("_best"))
    return null_safe_join(ranked, best, by).filter(F.col("_p") == F.col("_best")).drop("_p", "_best")


def run_usage(runs: DataFrame, key: Sequence[str] = ("animal_id",), axis: str = "frame_id") -> DataFrame:
    """Per run: first and last frame it covers, frames it has, frames it wins."""
    by = [*key, "run_name"]
    covered = (
        runs.select(*by, axis)
        .distinct()
        .groupBy(*by)
        .agg(F.min(axis).alias("first_frame"), F.max(axis).alias("last_frame"), F.count(axis).alias("n_covered"))
    )
    used = (
        priority_merge(runs, key, axis).select(*by, axis).distinct().groupBy(*by).agg(F.count(axis).alias("n_used"))
    )
    return covered.join(used, by, "left").fillna({"n_used": 0})


def gap_fill_flag(
    rows: DataFrame, key: Sequence[str], obj: str = "obj_id", axis: str = "frame_id", chunk: int = CHUNK
) -> DataFrame:
    """Every missing frame inside the span once per known object, flagged ``is_gap``."""
    key = list(key)
    objects = rows.select(*key, obj).distinct()
    # Objects join the gaps, which are few, and only then do gaps unfold into frames.
    missing = expand_ranges(gaps(rows, key, axis, chunk).join(objects, key), "start", "end_exclusive", axis)
    filled = missing.select(*key, axis, obj).withColumn("is_gap", F.lit(True))
    own = rows.select(*key, axis, obj).distinct().withColumn("is_gap", F.lit(False))
    return own.unionByName(filled)


def carry_forward_seed(
    track: DataFrame,
    clicks: DataFrame,
    step: int = 500,
    key: Sequence[str] = ("animal_id",),
    obj: str = "obj_id",
    axis: str = "frame_id",
) -> DataFrame:
    """Seed points at the start of each block of frames.

    Known objects keep their last position. If no object of the video has one,
    the original clicks seed the block; a single unknown object is left out.
    """
    key = list(key)
    known = last_known(track, [*key, obj], step, axis).filter(F.col("x").isNotNull())
    span = track.groupBy(*key).agg(
        F.floor(F.min(axis) / step).cast("long").alias("_a"), F.floor(F.max(axis) / step).cast("long").alias("_b")
    )
    blocks = span.select(*key, F.explode(F.sequence("_a", "_b")).alias("block"))
    # An object whose track ended earlier still has a last position.
    final = track.groupBy(*key, obj).agg(F.max_by(F.struct("x", "y"), F.struct(axis, "x", "y")).alias("_p"), F.max(axis).alias("_f"))
    tail = (
        final.join(span, key)
        .withColumn("_from", F.floor(F.col("_f") / step).cast("long") + 1)
        .filter(F.col("_from") <= F.col("_b"))
        .select(*key, obj, F.explode(F.sequence("_from", "_b")).alias("block"), "_p.x", "_p.y")
    )
    carried = known.select(*key, obj, "block", "x", "y").unionByName(tail).withColumn("source", F.lit("carried"))
    lost = blocks.join(carried, [*key, "block"], "left_anti")
    again = lost.join(clicks, key).select(*key, obj, "block", "x", "y", F.lit("clicks").alias("source"))
    return carried.unionByName(again)


def shard_of(df: DataFrame, key: Sequence[str], per_shard: int = 500, axis: str = "frame_id") -> DataFrame:
    """Frames with their output shard: ``per_shard`` present frames each."""
    return dense_index(df, key, axis).withColumn(
        "shard", F.floor(F.col("position") / per_shard).cast("long")
    )


def expand_bins(lengths: DataFrame, width: float = 30.0, length: str = "session_sec") -> DataFrame:
    """Dense bin axis 0 .. ceil(length/width) of each row, as ``bin_start``."""
    return lengths.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(length) / width)))
    ).withColumn("bin_start", F.col("_b") * F.lit(float(width))).drop("_b")


def segment_cut(rows: DataFrame, segments: DataFrame, key: Sequence[str], axis: str = "frame_id") -> DataFrame:
    """Rows of each segment inside [its start, start of the next); the first reaches back to 0.

    ``segments`` has one row per key and segment (``start_frame``): a handful per video.
    """
    key = list(key)
    line = Window.partitionBy(*key).orderBy("start_frame")
    cut = segments.select(
        *key,
        "segment",
        F.when(F.lag("start_frame").over(line).isNull(), F.least(F.lit(0).cast("long"), F.col("start_frame")))
        .otherwise(F.col("start_frame"))
        .alias("_from"),
        F.lead("start_frame").over(line).alias("_to"),
    )
    frame = F.col(axis)
    return (
        rows.join(cut, [*key, "segment"])
        .filter((frame >= F.col("_from")) & (F.col("_to").isNull() | (frame < F.col("_to"))))
        .drop("_from", "_to")
    )


def nest_points(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], per_list: int = 4_096
) -> DataFrame:
    """List columns of at most ``per_list`` ordered rows; a large group spans several lists."""
    placed = row_index(df, list(by), list(order), "_idx")
    return (
        placed.withColumn("part", F.floor(F.col("_idx") / per_list).cast("long"))
        .groupBy(*by, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_idx", *values))).alias("coords"))
        .withColumn("coords", F.transform("coords", lambda s: F.struct(*[s[v].alias(v) for v in values])))
    )


def unnest_points(nested: DataFrame, by: Sequence[str]) -> DataFrame:
    return nested.select(*by, F.inline("coords"))


def unpivot_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Metric columns to rows; ``columns`` maps each to its (source, channel)."""
    source = F.create_map(*[F.lit(x) for c, (s, _) in columns.items() for x in (c, s)])
    channel = F.create_map(*[F.lit(x) for c, (_, ch) in columns.items() for x in (c, ch)])
    return df.unpivot(list(ids), list(columns), "metric", "value").select(
        *ids,
        "metric",
        F.element_at(source, F.col("metric")).alias("source"),
        F.element_at(channel, F.col("metric")).alias("channel"),
        "value",
    )


def pivot_wide(df: DataFrame, by: Sequence[str], names: str, values: Sequence[str], value: str) -> DataFrame:
    """One column per listed value, by conditional aggregation."""
    return df.groupBy(*by).agg(
        *[F.max(F.when(F.col(names) == v, F.col(value))).alias(str(v)) for v in values]
    )
