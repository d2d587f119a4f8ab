"""Joins: source tables, complete grids, lookups, frames and skeletons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etholith.operators.frames import in_ranges
from etholith.operators.ordered import running


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key, by a partial aggregation that keeps one row per task and key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def build_image_table(
    manual: DataFrame, areas: DataFrame, automatic: DataFrame, key: str = "image_id"
) -> DataFrame:
    """Full outer join of the three sources, each with unique, non-NULL keys."""
    return manual.join(areas, key, "full").join(automatic, key, "full")


def mismatch_report(sources: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]], key: str) -> DataFrame:
    """Keys of one source missing in another, tagged ``<a>_without_<b>``."""
    parts = [
        sources[a].select(key).distinct()
        .join(sources[b].select(key).distinct(), key, "left_anti")
        .select(F.lit(f"{a}_without_{b}").alias("problem"), key)
        for a, b in pairs
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grid(entities: DataFrame, dims: Mapping[str, Sequence]) -> DataFrame:
    """Every entity with every combination of the listed values, unfolded in place."""
    out = entities.distinct()
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def complete(
    facts: DataFrame,
    entities: DataFrame,
    dims: Mapping[str, Sequence],
    fill: Mapping[str, object] | None = None,
) -> DataFrame:
    """Facts on the complete grid; missing cells get ``fill`` or stay NULL."""
    cells = grid(entities, dims)
    out = cells.join(facts, cells.columns, "left")
    return out.fillna(fill) if fill else out


def zero_fill_grid(
    facts: DataFrame, entities: DataFrame, dims: Mapping[str, Sequence], measures: Sequence[str]
) -> DataFrame:
    return complete(facts, entities, dims, {m: 0 for m in measures})


def lookup_join(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of a dimension; it is broadcast at run time if it proves small."""
    return df.join(dim, on, "left")


def keep_present(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def view_router(totals: DataFrame, directional: Sequence[str]) -> DataFrame:
    """Rows of the exp view for directional behaviours, of the total view otherwise.

    ``totals`` is the output of the three-view aggregation: one column set per view.
    """
    chosen = F.col("behavior").isin(*directional)
    return totals.withColumns(
        {
            "view": F.when(chosen, "exp").otherwise("total"),
            "duration": F.when(chosen, F.col("exp_duration_sec")).otherwise(F.col("total_duration_sec")),
            "n_bouts": F.when(chosen, F.col("exp_frequency")).otherwise(F.col("total_frequency")),
        }
    )


def bout_bin_join(bouts: DataFrame, width: float = 30.0) -> DataFrame:
    """One row per bout and time bin it overlaps, with the overlap; zero overlaps are left out."""
    first = F.floor(F.col("start_sec") / width).cast("long")
    last = F.floor((F.col("end_sec") - 1e-9) / width).cast("long")
    binned = bouts.filter(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
    start = F.col("bin") * F.lit(float(width))
    overlap = F.least(F.col("end_sec"), start + width) - F.greatest(F.col("start_sec"), start)
    return (
        binned.withColumn("bin_start", start)
        .withColumn("dur_in_bin", overlap)
        .filter(F.col("dur_in_bin") > 0)
        .drop("bin")
    )


def frame_cogroup(keypoints: DataFrame, mask_frames: DataFrame, on: Sequence[str], centroids: DataFrame | None = None) -> DataFrame:
    """Keypoints beside the two masks of their frame; frames without masks keep NULLs.

    ``centroids`` (the key, obj_id, x, y; one row per object) add the stored tracks as ``t1``, ``t2``.
    """
    on = list(on)
    frames = mask_frames
    if centroids is not None:
        spot = F.struct("x", "y")
        tracks = centroids.groupBy(*on).agg(*[F.first(F.when(F.col("obj_id") == o, spot), ignorenulls=True).alias(f"t{o}") for o in (1, 2)])
        frames = mask_frames.join(tracks, on, "full")
    return keypoints.join(frames, on, "left")


def roi_attach(images: DataFrame, rois: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Replace an image's annotation by the ROI of its prefix, only where one exists."""
    return (
        images.join(rois, prefix, "left")
        .withColumn("annotation", F.coalesce("roi", "annotation"))
        .withColumn("roi_attached", F.col("roi").isNotNull())
        .drop("roi")
    )


def pair_self_join(
    keypoints: DataFrame, key: Sequence[str], subjects: tuple[str, str], values: Sequence[str]
) -> DataFrame:
    """The two subjects' detections of one joint in one row (``a_*`` and ``b_*``).

    Built by conditional aggregation, so no self-join; one row per key is assumed
    per subject, the smallest is taken otherwise.
    """
    picks = [
        F.min(F.when(F.col("subject") == s, F.struct(*values))).alias(side)
        for side, s in zip(("a", "b"), subjects)
    ]
    return (
        keypoints.groupBy(*key)
        .agg(*picks)
        .select(*key, *[F.col(f"{side}.{v}").alias(f"{side}_{v}") for side in "ab" for v in values])
    )


def skeleton_join(
    points: DataFrame, edges: Sequence[tuple], key: Sequence[str], joint: str = "joint"
) -> DataFrame:
    """Each point with each skeleton neighbour of the same key: ``other``, ``ox``, ``oy``, ``limit``.

    The points of a key, as many as the skeleton has joints, meet in one array; edges are a literal list,
    unfolded there. Points that come partitioned by ``key`` are not exchanged.
    """
    both = [*edges, *[(b, a, t) for a, b, t in edges]]
    by_joint: dict = {}
    for a, b, t in both:
        by_joint.setdefault(a, []).append((b, t))
    neighbours: Column = F.lit(None)
    for a, others in by_joint.items():
        listed = F.array(
            *[F.struct(F.lit(b).alias("other"), F.lit(float(t)).alias("limit")) for b, t in others]
        )
        neighbours = F.when(F.col(joint) == a, listed).otherwise(neighbours)
    rest = [c for c in points.columns if c not in key]
    whole = points.filter(F.col(joint).isin(list(by_joint)))
    for c in key:
        whole = whole.filter(F.col(c).isNotNull())
    met = whole.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_all"))
    probing = met.select(*key, "_all", F.inline("_all")).withColumn("_n", F.explode(neighbours)).select("*", "_n.*")
    wanted = F.col("other")
    found = F.transform(F.filter("_all", lambda e: e[joint] == wanted), lambda e: F.struct(e["x"].alias("ox"), e["y"].alias("oy")))
    return probing.select(*points.columns, "other", "limit", F.inline(found))


def odd_ranges(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Disjoint [start, end_exclusive) covered an odd number of times by inclusive [start, end].

    Every range flips the state at its start and after its end. Boundaries that
    occur an even number of times cancel; the rest pair up in order.
    """
    flips = (
        ranges.withColumn("_at", F.explode(F.array(F.col("start"), F.col("end") + 1)))
        .groupBy(*by, "_at")
        .agg((F.count(F.lit(1)) % 2).alias("_odd"))
        .filter(F.col("_odd") == 1)
    )
    placed = running(flips, by, "_at", {"_place": ("sum", F.col("_odd"))})
    return (
        placed.groupBy(*by, F.floor((F.col("_place") - 1) / 2).alias("_pair"))
        .agg(F.min("_at").alias("start"), F.max("_at").alias("end_exclusive"))
        .drop("_pair")
    )


def toggle_range_swap(
    df: DataFrame,
    ranges: DataFrame,
    subjects: tuple[str, str],
    by: Sequence[str] = ("video_id",),
    subject: str = "subject",
) -> DataFrame:
    """Exchange the two subjects in frames covered by an odd number of inclusive ranges."""
    odd = odd_ranges(ranges, by)
    one, two = subjects
    renamed = F.when(F.col(subject) == one, two).when(F.col(subject) == two, one).otherwise(F.col(subject))
    hit = in_ranges(df, odd, by, how="left_semi").withColumn(subject, renamed)
    return hit.unionByName(in_ranges(df, odd, by, how="left_anti"))


def cross_check_starts(named: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Runs whose start by name differs from the side file."""
    return named.join(listed, list(on)).filter(F.col("start_frame") != F.col("listed_start"))


def cross_specs(specs: Mapping[str, Sequence[str]], behaviors: Sequence[str], spark) -> DataFrame:
    """Rows (measure, session_type, behavior) of a measure -> allowed sessions map."""
    one = spark.range(1).select(
        F.explode(
            F.create_map(
                *[
                    x
                    for m, sessions in specs.items()
                    for x in (F.lit(m), F.array(*[F.lit(s) for s in sessions]))
                ]
            )
        ).alias("measure", "sessions")
    )
    return one.select("measure", F.explode("sessions").alias("session_type")).withColumn(
        "behavior", F.explode(F.array(*[F.lit(b) for b in behaviors]))
    )


