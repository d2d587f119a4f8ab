"""Row selection and data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from etholith.operators.frames import in_ranges
from etholith.operators.ordered import quantiles_of, tie_ranks

# Fixed values of the study.
MIN_BOUT_SEC = 0.5
LIKELIHOOD_MIN = 0.5
PROTECTED_JOINTS = ("nose",)
TUKEY_FACTOR = 1.5


def _long_enough(default: float, by_behavior: Mapping[str, float] | None) -> Column:
    limit = F.lit(default)
    for behavior, seconds in (by_behavior or {}).items():
        limit = F.when(F.col("behavior") == behavior, seconds).otherwise(limit)
    return F.col("duration_sec") >= limit


def min_duration(
    bouts: DataFrame, default: float = MIN_BOUT_SEC, by_behavior: Mapping[str, float] | None = None
) -> DataFrame:
    """Bouts at least as long as the threshold of their behaviour."""
    return bouts.filter(_long_enough(default, by_behavior))


def min_duration_report(
    bouts: DataFrame, default: float = MIN_BOUT_SEC, by: Sequence[str] = (), by_behavior: Mapping[str, float] | None = None
) -> DataFrame:
    """Kept and total bouts of :func:`min_duration` with the same thresholds."""
    return bouts.groupBy(*by).agg(
        F.count(F.when(_long_enough(default, by_behavior), 1)).alias("n_kept"), F.count(F.lit(1)).alias("n_total")
    )


def observed_min_duration(
    bouts: DataFrame, default: float = MIN_BOUT_SEC, by_behavior: Mapping[str, float] | None = None
) -> tuple[DataFrame, Observation]:
    """:func:`min_duration`, and kept and total bouts counted in the pass that filters.

    The observation has ``n_kept`` and ``n_total`` once an action has read the bouts; no second scan is made.
    Write the rows or aggregate them: an action that sorts by range reads its input twice and counts it twice.
    """
    return _observed(bouts, _long_enough(default, by_behavior))


def observed_drop_null_keys(df: DataFrame, key: str) -> tuple[DataFrame, Observation]:
    """:func:`drop_null_keys`, and kept and total rows counted in the pass that filters."""
    return _observed(df, F.col(key).isNotNull())


def _observed(df: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    counted = df.observe(seen, F.count(F.when(keep, 1)).alias("n_kept"), F.count(F.lit(1)).alias("n_total"))
    return counted.filter(keep), seen


def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def null_key_report(df: DataFrame, key: str, source: str) -> DataFrame:
    """How many rows of each source have no usable key."""
    return df.groupBy(source).agg(
        F.count(F.when(F.col(key).isNull(), 1)).alias("n_dropped"),
        F.count(key).alias("n_kept"),
    )


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_only(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.filter(_finite(F.col(c)))
    return df


def check_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns holding Inf or NaN with how many rows do, from one pass."""
    counts = df.agg(
        *[F.count(F.when(F.col(c).isNotNull() & ~_finite(F.col(c)), 1)).alias(c) for c in cols]
    )
    return counts.unpivot([], list(cols), "column_name", "n_nonfinite").filter("n_nonfinite > 0")


def cutoff_frames(df: DataFrame, cutoff: int, axis: str = "frame_id") -> DataFrame:
    return df.filter(F.col(axis) <= cutoff)


def cutoff_disposition(
    df: DataFrame, shard: Sequence[str], cutoff: int, axis: str = "frame_id"
) -> DataFrame:
    """What a cutoff does to each shard: unchanged, dropped or trimmed, and frames kept."""
    frames = df.select(*shard, axis).distinct()
    low, high = F.min(axis), F.max(axis)
    return frames.groupBy(*shard).agg(
        low.alias("first_frame"),
        high.alias("last_frame"),
        F.when(high <= cutoff, "unchanged").when(low > cutoff, "dropped").otherwise("trimmed")
        .alias("disposition"),
        F.count(F.when(F.col(axis) <= cutoff, 1)).alias("n_kept"),
    )


def likelihood_gate(df: DataFrame, limit: float = LIKELIHOOD_MIN) -> DataFrame:
    """NULL coordinates where the likelihood is known and below the limit."""
    low = F.col("likelihood") < limit
    return df.withColumns(
        {c: F.when(low, F.lit(None).cast("double")).otherwise(F.col(c)) for c in ("x", "y")}
    )


def is_protected(joint: Column, joints: Sequence = PROTECTED_JOINTS) -> Column:
    return joint.isin(*joints)


def frame_segments(df: DataFrame, ranges: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Rows whose frame lies inside any (start, end_exclusive) of its video."""
    return in_ranges(df, ranges, by)


def min_area(objects: DataFrame, limits: Mapping[str, float], cls: str = "marker", area: str = "area") -> DataFrame:
    """Objects not smaller than the minimum of their class; other classes pass."""
    limit = F.lit(0.0)
    for name, value in limits.items():
        limit = F.when(F.col(cls) == name, value).otherwise(limit)
    return objects.filter(F.col(area) >= limit)


def view_rows(bouts: DataFrame, view: str) -> DataFrame:
    """``total`` keeps all rows; ``exp`` and ``stim`` those of that actor."""
    return bouts if view == "total" else bouts.filter(F.col("actor") == view)


def behaviors_with_actor(bouts: DataFrame) -> DataFrame:
    """Behaviours for which an actor is ever recorded."""
    return (
        bouts.groupBy("behavior")
        .agg(F.bool_or(F.col("actor").isNotNull()).alias("has_actor"))
        .filter("has_actor")
        .select("behavior")
    )


def tukey_fence(
    df: DataFrame, by: Sequence[str], value: str, factor: float = TUKEY_FACTOR
) -> DataFrame:
    """Clip range by quartile fences; NULL where the spread is zero or nothing is clipped."""
    ranks = tie_ranks(finite_only(df, [value]), by, value)
    q = quantiles_of(
        ranks, by, {"q1": 0.25, "q3": 0.75}, F.min("value").alias("low"), F.max("value").alias("high")
    )
    iqr = F.col("q3") - F.col("q1")
    lower = F.greatest("low", F.col("q1") - factor * iqr)
    upper = F.least("high", F.col("q3") + factor * iqr)
    clips = (iqr != 0) & ((lower > F.col("low")) | (upper < F.col("high")))
    return q.select(
        *by, "q1", "q3", F.when(clips, lower).alias("lower"), F.when(clips, upper).alias("upper")
    )
