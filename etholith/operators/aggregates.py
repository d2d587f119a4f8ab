"""Aggregations over bouts, counts, keypoints, runs and rasters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etholith.functions import counts as C
from etholith.operators.joins import bout_bin_join, complete
from etholith.operators.ordered import (
    null_safe_join,
    quantiles,
    quantiles_of,
    tie_ranks,
    with_group_stats,
)

BOUT_KEY = ("animal_id", "session_type", "behavior")


def bout_totals(
    bouts: DataFrame, sessions: Sequence[str], behaviors: Sequence[str]
) -> DataFrame:
    """Duration and count per animal, session and behaviour for the total, exp and stim views.

    All three views come from one pass of conditional sums; absent cells are 0.
    """
    views = {"total": F.lit(True), "exp": F.col("actor") == "exp", "stim": F.col("actor") == "stim"}
    aggs = []
    for name, cond in views.items():
        aggs += [
            F.sum(F.when(cond, F.col("duration_sec")).otherwise(0.0)).alias(f"{name}_duration_sec"),
            F.count(F.when(cond, 1)).alias(f"{name}_frequency"),
        ]
    facts = bouts.groupBy(*BOUT_KEY).agg(*aggs)
    measures = [f"{v}_{m}" for v in views for m in ("duration_sec", "frequency")]
    return complete(
        facts,
        bouts.select("animal_id"),
        {"session_type": sessions, "behavior": behaviors},
        {m: 0 for m in measures},
    )


def bout_direction_totals(
    bouts: DataFrame,
    sessions: Sequence[str],
    directional: Sequence[str],
    actors: Sequence[str] = ("exp", "stim"),
) -> DataFrame:
    """Totals of directional behaviours by initiator, zero-filled."""
    facts = (
        bouts.filter(F.col("behavior").isin(*directional) & F.col("actor").isNotNull())
        .withColumnRenamed("actor", "initiated_by")
        .groupBy(*BOUT_KEY, "initiated_by")
        .agg(
            F.sum("duration_sec").alias("total_duration_sec"),
            F.count(F.lit(1)).alias("frequency"),
        )
    )
    return complete(
        facts,
        bouts.select("animal_id"),
        {"session_type": sessions, "behavior": directional, "initiated_by": actors},
        {"total_duration_sec": 0, "frequency": 0},
    )


def balance_check(df: DataFrame, by: Sequence[str], dim: str, expected: int = 2) -> DataFrame:
    """Groups that do not have ``expected`` distinct values of ``dim``."""
    return (
        df.groupBy(*by)
        .agg(F.countDistinct(dim).alias("n_distinct"))
        .filter(F.col("n_distinct") != expected)
    )


def bout_summary(bouts: DataFrame, by: Sequence[str] = BOUT_KEY) -> DataFrame:
    """Count, mean, median, sd, min and max of the durations per group."""
    by = list(by)
    ranks = tie_ranks(bouts, by, "duration_sec")
    middle = quantiles_of(ranks, by, {"median_dur": 0.5})
    plain = bouts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bouts"),
        F.avg("duration_sec").alias("mean_dur"),
        F.stddev_samp("duration_sec").alias("sd_dur"),
        F.min("duration_sec").alias("min_dur"),
        F.max("duration_sec").alias("max_dur"),
    )
    return null_safe_join(plain, middle, by)


def group_medians(df: DataFrame, by: Sequence[str], value: str, out: str = "median_value") -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})


def session_length(bouts: DataFrame, by: Sequence[str] = ("session_type",)) -> DataFrame:
    return bouts.groupBy(*by).agg(F.max("end_sec").alias("session_sec"))


def time_budget(totals: DataFrame, lengths: DataFrame) -> DataFrame:
    """Share of the longest session of its type, in percent."""
    return totals.join(lengths, "session_type").withColumn(
        "pct_time", 100 * C.ratio(F.col("total_duration_sec"), F.col("session_sec"))
    )


def marker_counts(points: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Markers per class as columns; an absent class counts 0."""
    return points.groupBy(*by).agg(
        *[
            F.count(F.when(F.col("marker") == m, 1)).alias(out)
            for m, out in (("GFP", "n_gfp"), ("cFOS", "n_cfos"), ("both", "n_both"))
        ]
    )


def animal_rollup(
    images: DataFrame, by: Sequence[str], sources: Mapping[str, tuple[str, str, str]], area: str | None = None
) -> DataFrame:
    """Sum counts per animal first, then derive ratios from the sums.

    ``sources`` maps a prefix (manual, auto) to its three count columns. Missing
    counts add nothing; ``n_<prefix>`` says how many images had them.
    """
    sums = [F.count(F.lit(1)).alias("n_images")]
    for prefix, cols in sources.items():
        sums += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{prefix}_{k}") for c, k in zip(cols, ("a_only", "b_only", "both"))]
        sums.append(F.count(cols[0]).alias(f"n_{prefix}"))
    if area:
        sums.append(F.sum(area).alias("area_um2"))
    out = images.groupBy(*by).agg(*sums)
    for prefix in sources:
        trio = [F.col(f"{prefix}_{k}") for k in ("a_only", "b_only", "both")]
        derived = C.derived_counts(*trio)
        if area:
            for name, count in (("a_density", derived["a_total"]), ("b_density", derived["b_total"]), ("both_density", trio[2])):
                derived[name] = C.density_mm2(count, F.col("area_um2"))
        out = out.withColumns({f"{prefix}_{k}": v for k, v in derived.items()})
    return out


def descriptives(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median and interquartile range per group."""
    by = list(by)
    q = quantiles_of(
        tie_ranks(df, by, value),
        by,
        {"q1": 0.25, "median_value": 0.5, "q3": 0.75},
        F.max("n_group").alias("n_values"),
    )
    means = df.groupBy(*by).agg(F.avg(value).alias("mean_value"))
    return null_safe_join(
        q.withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3"), means, by
    )


def mean_abs_error(df: DataFrame, flag: str, delta: str) -> DataFrame:
    return df.groupBy(flag).agg(
        F.avg(F.abs(F.col(delta))).alias("mean_abs_error"), F.count(delta).alias("n_images")
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return (
        df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("n_rows").desc(), col)
    )


def cleanup_summary(
    checked: DataFrame, subjects: Sequence[str], joint: str = "joint", subject: str = "subject"
) -> DataFrame:
    """Per joint and over all (TOTAL): points checked and removed, per subject and together.

    ``checked`` has ``mask_status``; rows never judged are left out.
    """
    # Counted before anything is left out: a filter would be pushed down and judge every point once more.
    status = F.col("mask_status")
    met = checked.groupBy(F.col(joint).cast("string").alias("_joint"), F.col(subject).alias("_subject"), status).agg(F.count(F.lit(1)).alias("_n"))

    def points(*which: Column) -> Column:
        wanted = status != "not_checked"
        for w in which:
            wanted = wanted & w
        return F.sum(F.when(wanted, F.col("_n")).otherwise(0))

    gone = status == "removed"
    aggs = []
    for s in subjects:
        mine = F.col("_subject") == s
        aggs += [points(mine).alias(f"{s}_total"), points(mine, gone).alias(f"{s}_removed")]
    aggs += [points().alias("total_all"), points(gone).alias("removed_all")]
    rolled = met.rollup("_joint").agg(F.grouping("_joint").alias("_top"), *aggs).filter("total_all > 0")

    def pct(removed: str, total: str):
        return F.round(100 * C.ratio(F.col(removed), F.col(total)), 2)

    return rolled.select(
        F.when(F.col("_top") == 1, "TOTAL").otherwise(F.col("_joint")).alias("joint"),
        *[
            c
            for s in subjects
            for c in (
                F.col(f"{s}_total"),
                F.col(f"{s}_removed"),
                F.coalesce(pct(f"{s}_removed", f"{s}_total"), F.lit(0.0)).alias(f"{s}_pct_removed"),
            )
        ],
        "total_all",
        "removed_all",
        F.coalesce(pct("removed_all", "total_all"), F.lit(0.0)).alias("pct_removed_all"),
    )


def bins_total(bouts: DataFrame, width: float = 30.0) -> DataFrame:
    return (
        bout_bin_join(bouts, width)
        .groupBy(*BOUT_KEY, "bin_start")
        .agg(F.sum("dur_in_bin").alias("dur_in_bin"))
    )


def n_distinct_per_group(df: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(entity).alias("n_distinct"))


def duplicate_content(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that share all the given values with at least one other row."""
    present = df.dropna(subset=list(cols))
    return with_group_stats(present, cols, n_sharing=F.count(F.lit(1))).filter("n_sharing > 1")


def cohort_mismatch(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct animal and cohort pairs that differ from the expected cohort (UNKNOWN if unlisted)."""
    return (
        df.select("animal_id", "cohort")
        .distinct()
        .join(expected, "animal_id", "left")
        .withColumn("expected_cohort", F.coalesce("expected_cohort", F.lit("UNKNOWN")))
        .filter(~F.col("cohort").eqNullSafe(F.col("expected_cohort")))
    )
