"""Identity repair of two tracked subjects from masks, centroids and a skeleton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etholith.functions import masks as M
from etholith.operators.frames import islands
from etholith.operators.joins import skeleton_join, toggle_range_swap

# Fixed values of the study.
TOLERANCE_PX = 15.0
SWAP_ROUNDS = 10
COLOR_MARGIN = 25.0
MIN_ZONE_FRAMES = 2
SKELETON = (
    ("nose", "right_ear", 117.0),
    ("nose", "left_ear", 110.0),
    ("right_ear", "spine_1", 44.6),
    ("left_ear", "spine_1", 49.0),
    ("nose", "spine_1", 124.4),
    ("spine_1", "center", 96.8),
    ("center", "spine_2", 78.0),
    ("spine_2", "tail_base", 60.6),
    ("tail_base", "tail_1", 97.0),
    ("tail_1", "tail_2", 102.4),
    ("tail_2", "tail_tip", 111.8),
    ("spine_1", "right_fhip", 56.0),
    ("spine_1", "left_fhip", 59.2),
    ("spine_2", "right_bhip", 74.0),
    ("spine_2", "left_bhip", 77.2),
)
# Costs that differ by rounding only are a tie.
TIE = 1e-9
# Neighbours that add a cost while detections are assigned.
COST_NEIGHBOURS = {
    "tail_2": (("tail_1", 102.4), ("tail_tip", 111.8)),
    "tail_tip": (("tail_2", 111.8),),
    "tail_1": (("tail_base", 97.0), ("tail_2", 102.4)),
    "nose": (("spine_1", 124.4), ("right_ear", 117.0), ("left_ear", 110.0)),
}


def mask_frames(masks: DataFrame, key: Sequence[str], h: int | None = None, w: int | None = None, obj: str = "obj_id") -> DataFrame:
    """One row per frame: words, size, edge pixels and centroid of both objects.

    ``masks`` has ``words``, or ``packed`` as :func:`etholith.sources.files.read_mask_shards` returns
    it. Without ``h`` and ``w`` the sizes are its columns of these names, row by row. Per-mask work
    happens here, once, before any keypoint is joined.
    """
    high = F.col("h") if h is None else F.lit(h)
    wide = F.col("w") if w is None else F.lit(w)
    if "words" not in masks.columns:
        masks = masks.withColumn("words", M.to_words(F.col("packed"), high, wide))
    seen = masks.withColumn("_o", M.outline(F.col("words"), high, wide))
    picked = F.struct(
        F.col("words").alias("words"),
        high.cast("long").alias("h"),
        wide.cast("long").alias("w"),
        *[F.col(f"_o.{c}").alias(c) for c in ("edge_x", "edge_y", "cx", "cy")],
    )
    return seen.groupBy(*key).agg(
        *[F.first(F.when(F.col(obj) == o, picked), ignorenulls=True).alias(f"m{o}") for o in (1, 2)]
    )


EVIDENCE = ("oob", *[f"{c}{o}" for o in (1, 2) for c in ("has", "in", "d", "c")])


def _apart(dx: Column, dy: Column) -> Column:
    """Distance as the root of the squares, as ``masks.nearest`` forms it; ``hypot`` may differ in the last bit and upset ties."""
    return F.sqrt(dx * dx + dy * dy)


def mask_evidence(rows: DataFrame, h: int | None = None, w: int | None = None) -> DataFrame:
    """What each keypoint sees of the two masks of its frame, in place of the masks.

    ``oob``; per object: ``has`` (a mask is there), ``in``, mask distance ``d``
    (NULL for an empty mask) and centroid distance ``c`` (NULL without one). The
    mask payload ends here: later shuffles carry a few numbers per keypoint.
    Without ``h`` and ``w`` the frame's own mask size holds; a stored centroid
    (``t1``, ``t2`` of ``frame_cogroup``) goes before the mean of the mask.
    """
    high = F.coalesce("m1.h", "m2.h") if h is None else F.lit(h)
    wide = F.coalesce("m1.w", "m2.w") if w is None else F.lit(w)
    px, py = M.pixel_of(F.col("x")), M.pixel_of(F.col("y"))
    inside = (px >= 0) & (px < wide) & (py >= 0) & (py < high)
    out = rows.withColumn("oob", ~inside).withColumn("_at", F.when(inside, py * wide + px))
    for o in (1, 2):
        side = F.col(f"m{o}")
        tracked = f"t{o}" in rows.columns
        cx, cy = (F.coalesce(f"t{o}.{c}", f"m{o}.c{c}") if tracked else side[f"c{c}"] for c in "xy")
        out = out.withColumns(
            {
                f"has{o}": side.isNotNull(),
                f"in{o}": M.word_bit(side["words"], F.col("_at")),
                f"c{o}": _apart(F.col("x") - cx, F.col("y") - cy),
            }
        )
        # The pixel under a point inside the mask is its nearest one: its edge is not looked at.
        own = _apart(px - F.col("x"), py - F.col("y"))
        edge = [F.when(F.col(f"in{o}"), None).otherwise(side[f"edge_{c}"]) for c in "xy"]
        out = out.withColumn(f"d{o}", F.coalesce(F.when(F.col(f"in{o}"), own), M.nearest(*edge, F.col("x"), F.col("y"))))
    return out.drop("_at", "m1", "m2", "t1", "t2")


def assign_single(tolerance: float = TOLERANCE_PX) -> Column:
    """Struct (assigned, reason) for a lone detection with :func:`mask_evidence` columns."""
    in1, in2 = F.coalesce("in1", F.lit(False)), F.coalesce("in2", F.lit(False))
    far = F.lit(float("inf"))
    d1, d2 = F.coalesce("d1", far), F.coalesce("d2", far)
    by_mask = (
        F.when(F.col("oob"), None)
        .when(in1 & ~in2, "obj1")
        .when(in2 & ~in1, "obj2")
        .when(in1 & in2, None)
        .when(F.least(d1, d2) > tolerance, None)
        .when(d1 < d2, "obj1")
        .otherwise("obj2")
    )
    why = (
        F.when(F.col("oob"), "out_of_bounds")
        .when(in1 & in2, "overlap")
        .when(in1 | in2, "mask_unique")
        .when(F.least(d1, d2) > tolerance, "no_mask")
        .otherwise("mask_nearest")
    )
    by_centre = F.when(F.coalesce(F.col("c1") < F.col("c2"), F.lit(False)), "obj1").otherwise("obj2")
    return F.struct(
        F.coalesce(by_mask, by_centre).alias("assigned"),
        F.when(by_mask.isNull(), F.concat(why, F.lit("_centroid_fallback"))).otherwise(why).alias("reason"),
    )


def detection_cost(obj: int, prefix: str = "") -> Column:
    """Mask distance, or centroid distance for an empty mask."""
    return F.coalesce(F.col(f"{prefix}d{obj}"), F.col(f"{prefix}c{obj}"))


def assign_pair(pair: DataFrame, tie: float = TIE) -> DataFrame:
    """Cheaper of the two exclusive assignments of detections ``a_*`` and ``b_*``; costs no more than ``tie`` apart keep the first."""
    straight = F.col("a_cost1") + F.col("b_cost2")
    crossed = F.col("a_cost2") + F.col("b_cost1")
    first = straight - crossed <= tie
    return pair.withColumns(
        {
            "cost_straight": straight,
            "cost_crossed": crossed,
            "a_assigned": F.when(first, "obj1").otherwise("obj2"),
            "b_assigned": F.when(first, "obj2").otherwise("obj1"),
        }
    )


def _settle_batches(neighbours: Mapping, tie: float):
    """Adds ``_first``, whether a joint's first detection is obj1, to frames of joints in their turns.

    All frames of an Arrow batch take one turn at a time, so a turn sees what its frame has placed before.
    """
    names = list(dict.fromkeys([*neighbours, *[o for others in neighbours.values() for o, _ in others]]))
    place = {j: i for i, j in enumerate(names)}
    most = max([len(v) for v in neighbours.values()], default=0)
    near, limit = np.full((len(names) + 1, most), -1), np.zeros((len(names) + 1, most))  # the last row is for other joints
    for j, others in neighbours.items():
        for k, (o, t) in enumerate(others):
            near[place[j], k], limit[place[j], k] = place[o], t

    def numbers(column: pa.Array) -> np.ndarray:
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def excess(placed: np.ndarray, joint: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(joint))
        for k in range(most):
            other = near[joint, k]
            d = np.hypot(x - placed[np.arange(len(joint)), other, 0], y - placed[np.arange(len(joint)), other, 1]) - limit[joint, k]
            total += np.where((other >= 0) & (d > 0), d, 0.0)  # a neighbour not placed gives NaN and costs nothing
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch["_joints"]
            size = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
            values = listed.flatten()
            joint = values.field("at").to_numpy(zero_copy_only=False)
            sides = []
            for side in ("p", "q"):
                one = values.field(side)
                fields = dict(zip([f.name for f in one.type], one.flatten(), strict=True))  # keeps the nulls of the whole
                sides.append({**{c: numbers(fields[c]) for c in ("x", "y", "k1", "k2")}, "known": fields["k1"].is_valid().to_numpy(zero_copy_only=False) & fields["k2"].is_valid().to_numpy(zero_copy_only=False)})
                if side == "p":
                    alone = pc.fill_null(pc.equal(fields["alone"], "obj1"), False).to_numpy(zero_copy_only=False)
                else:
                    lone = one.is_null().to_numpy(zero_copy_only=False)
            p, q = sides
            frame = np.repeat(np.arange(len(size)), size)
            turn = np.arange(len(frame)) - np.repeat(np.cumsum(size) - size, size)
            by_turn = np.argsort(turn, kind="stable")
            placed = np.full((len(size), 2, len(names) + 1, 2), np.nan)
            first = alone.copy()
            for rows in np.split(by_turn, np.cumsum(np.bincount(turn))[:-1]) if len(turn) else []:
                f, j = frame[rows], joint[rows]
                cost = {}
                for name, d in (("p", p), ("q", q)):
                    for o in (0, 1):
                        cost[name, o] = d[f"k{o + 1}"][rows] + excess(placed[f, o], j, d["x"][rows], d["y"][rows])
                straight = cost["p", 0] + cost["q", 1] - (cost["p", 1] + cost["q", 0]) <= tie
                straight |= ~(p["known"][rows] & q["known"][rows])
                first[rows] = np.where(lone[rows], alone[rows], straight)
                told = j < len(names)
                for d, o, take in ((p, np.where(first[rows], 0, 1), told), (q, np.where(first[rows], 1, 0), told & ~lone[rows])):
                    placed[f[take], o[take], j[take], 0] = d["x"][rows][take]
                    placed[f[take], o[take], j[take], 1] = d["y"][rows][take]
            flags = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(first, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], names=[*batch.schema.names, "_first"])

    return run, names


def assign_frames(
    evidence: DataFrame,
    frame: Sequence[str],
    order: Sequence[str],
    neighbours: Mapping = COST_NEIGHBOURS,
    tolerance: float = TOLERANCE_PX,
    joint: str = "joint",
    tie: float = TIE,
) -> DataFrame:
    """Object and reason for every detection; joints of a frame are settled in input order.

    Per (frame, joint) at most two detections with coordinates take part; the
    rest is set aside before the frame is folded (``extra_detection``), as are
    rows without coordinates (``nan_coords``) and frames without masks
    (``no_mask_frame``), so the folded array is bounded by the joint vocabulary.
    The turns are taken by all frames of an Arrow batch together. Rows that come
    partitioned by ``frame`` are not exchanged again.
    """
    frame = list(frame)
    blank = F.col("x").isNull() | F.col("y").isNull()
    rows = evidence.withColumns({"_ord": F.struct(*order), "_blank": blank, "_lost": ~F.col("has1") & ~F.col("has2")})
    # Blank rows stay in view because a joint takes its turn at its first row of any kind.
    per_joint = Window.partitionBy(*frame, joint, "_blank", "_lost").orderBy("_ord")
    rows = rows.withColumn("_rank", F.row_number().over(per_joint))
    top = rows.filter(~F.col("_lost")).filter("_rank <= 2")
    single = assign_single(tolerance)
    seen = top.select(*frame, F.struct(
        "_ord", F.col(joint).alias("joint"), "_blank", "x", "y",
        detection_cost(1).alias("k1"), detection_cost(2).alias("k2"), single["assigned"].alias("alone"),
    ).alias("_d"))
    listed = seen.groupBy(*frame).agg(F.sort_array(F.collect_list("_d")).alias("_l"))
    turns = F.array_distinct(F.transform("_l", lambda d: d["joint"]))
    paired_up = F.transform(
        F.transform(
            turns,
            lambda j: F.struct(
                j.alias("joint"), F.filter("_l", lambda d: (d["joint"] == j) & ~d["_blank"]).alias("dets")
            ),
        ),
        lambda e: F.struct(e["joint"].alias("joint"), F.get(e["dets"], F.lit(0)).alias("p"), F.get(e["dets"], F.lit(1)).alias("q")),
    )
    run, known = _settle_batches(neighbours, tie)

    def number(j: Column) -> Column:
        """The joint's place among those with neighbours; all others share the one after."""
        at = F.array_position(F.array(*[F.lit(k) for k in known]), j) if known else F.lit(0)
        return F.when(at > 0, at - 1).otherwise(len(known)).cast("int")

    joints = F.transform(F.filter(paired_up, lambda e: e["p"].isNotNull()), lambda e: F.struct(e["joint"].alias("joint"), number(e["joint"]).alias("at"), e["p"].alias("p"), e["q"].alias("q")))
    folded = listed.select(*frame, joints.alias("_joints"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema)
    flagged = folded.mapInArrow(run, f"{kinds}, _first array<boolean>")

    # What comes back is small, one row a frame; rows look up their joint and know their own rank.
    told = F.transform(
        F.arrays_zip("_joints", "_first"),
        lambda e: F.struct(e["_joints"]["joint"].alias("joint"), e["_first"].alias("first"), e["_joints"]["q"].isNotNull().alias("paired")),
    )
    settled = flagged.select(*frame, told.alias("_told"))
    row_joint = F.col(joint)
    own = F.get(F.filter("_told", lambda e: e["joint"] == row_joint), F.lit(0))
    placed = ~F.col("_blank") & ~F.col("_lost") & (F.col("_rank") <= 2)
    straight = F.col("_own.first") == (F.col("_rank") == 1)
    unsettled = (
        F.when(F.col("_blank"), "nan_coords").when(F.col("_lost"), "no_mask_frame").otherwise("extra_detection")
    )
    return (
        rows.join(settled, frame, "left")
        .withColumn("_own", F.when(placed, own))
        .withColumn("assigned", F.when(straight, "obj1").when(~straight, "obj2"))
        .withColumn("reason", F.when(F.col("_own").isNull(), unsettled).when(F.col("_own.paired"), "exclusive_pair").otherwise(single["reason"]))
        .drop("_ord", "_blank", "_lost", "_rank", "_told", "_own")
    )


def last_points(
    points: DataFrame, key: Sequence[str], order: Sequence[str], joint: str = "joint", values: Sequence[str] = ("x", "y")
) -> DataFrame:
    """The last point with coordinates per key and joint; copies are settled before any join."""
    return (
        points.dropna(subset=["x", "y"])
        .groupBy(*key, joint)
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_p"))
        .select(*key, joint, *[F.col(f"_p.{v}").alias(v) for v in values])
    )


def skeleton_violation(
    points: DataFrame,
    edges: Sequence[tuple] = SKELETON,
    key: Sequence[str] = ("video_id", "frame_id", "subject"),
    order: Sequence[str] = ("x", "y"),
    factor: float = 1.0,
) -> DataFrame:
    """(key, joint) of points farther from a present neighbour than the edge allows."""
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return (
        skeleton_join(last_points(points, key, order), edges, key)
        .groupBy(*key, "joint")
        .agg(F.bool_or(d > F.col("limit") * factor).alias("violated"))
        .filter("violated")
        .drop("violated")
    )


def _swap_batches(joints: list, edges: list, rounds: int):
    place = {j: i for i, j in enumerate(joints)}
    pairs = [(place[a], place[b], t) for a, b, t in edges if a in place and b in place]

    def valid(xy: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(F, J): would position ``at`` of each joint keep its limits against present neighbours ``xy``."""
        ok = np.ones(at.shape[:2], dtype=bool)
        for a, b, t in pairs:
            for i, k in ((a, b), (b, a)):
                d = np.hypot(at[:, i, 0] - xy[:, k, 0], at[:, i, 1] - xy[:, k, 1])
                ok[:, i] &= ~(d > t + TIE)  # an absent neighbour gives NaN and is no violation
        return ok

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            pts = np.full((n, 2, len(joints), 2), np.nan)
            seen = np.full((n, 2, len(joints)), np.inf)
            sizes = pdf["sides"].map(len).to_numpy()
            f = np.repeat(np.arange(n), sizes)
            s, j, xs, ys = (np.concatenate(pdf[c].to_numpy()) if n else np.empty(0, int) for c in ("sides", "at", "xs", "ys"))
            turn = np.arange(len(f)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pts[f, s, j, 0], pts[f, s, j, 1], seen[f, s, j] = xs, ys, turn
            touched = np.zeros((n, len(joints)), dtype=bool)
            flips = np.zeros((n, len(joints)), dtype=int)
            active = np.arange(n)
            for _ in range(rounds):
                changed = np.zeros(n, dtype=bool)
                for side in (0, 1):
                    own, other = pts[active, side], pts[active, 1 - side]
                    here = ~np.isnan(own[:, :, 0]) & ~np.isnan(other[:, :, 0])
                    can = here & ~valid(own, own) & valid(own, other) & valid(other, own)
                    first = np.where(can, seen[active, side], np.inf).argmin(axis=1)
                    hit = can.any(axis=1)
                    fr, jo = active[hit], first[hit]
                    held = pts[fr, side, jo].copy()
                    pts[fr, side, jo] = pts[fr, 1 - side, jo]
                    pts[fr, 1 - side, jo] = held
                    touched[fr, jo] = True
                    flips[fr, jo] += 1
                    changed[fr] = True
                active = np.flatnonzero(changed)
                if not len(active):
                    break
            fr, jo = np.nonzero(touched)
            out = pdf.iloc[fr].drop(columns=["sides", "at", "xs", "ys"]).reset_index(drop=True)
            out["joint"] = [joints[k] for k in jo]
            out["_odd"] = flips[fr, jo] % 2 == 1
            yield out

    return run


def anatomical_swap(
    rows: DataFrame,
    subjects: tuple[str, str],
    joints: Sequence,
    edges: Sequence[tuple] = SKELETON,
    frame: Sequence[str] = ("video_id", "frame_id"),
    order: Sequence[str] = ("joint",),
    subject: str = "subject_corrected",
    rounds: int = SWAP_ROUNDS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Exchange a joint between the subjects where that mends both skeletons.

    Rows that come partitioned by ``frame`` are not exchanged again. Each frame becomes one bounded row (the last point with coordinates per
    subject and joint); frames are worked through as Arrow batches with array
    arithmetic, at most one exchange per subject and round. Only the exchanged
    joints come back. x, y, likelihood and the ``carried`` columns travel
    together with their point, and the reason becomes ``anat_swap``.
    """
    frame = list(frame)
    moving = ["x", "y", "likelihood", *carried]
    side = F.when(F.col(subject) == subjects[0], 0).when(F.col(subject) == subjects[1], 1)
    keyed = rows.withColumn("_side", side).withColumn("_ord", F.struct(*order))
    last = (
        keyed.dropna(subset=["x", "y", "_side"])
        .groupBy(*frame, "_side", "joint")
        .agg(
            F.max_by(F.struct(*moving), "_ord").alias("_p"),
            F.min("_ord").alias("_seen"),
        )
    )
    # Joints outside the vocabulary take no part.
    known = F.array(*[F.lit(j) for j in joints])
    placed = last.withColumn("_at", (F.array_position(known, F.col("joint")) - 1).cast("int")).filter("_at >= 0")
    packed = (
        placed.groupBy(*frame)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_seen", "_side", "_at", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")))
            ).alias("_l"),
            F.min("_side").alias("_low"),
            F.max("_side").alias("_high"),
        )
        .filter("_low < _high")
        .select(
            *frame,
            F.transform("_l", lambda e: e["_side"]).alias("sides"),
            F.transform("_l", lambda e: e["_at"]).alias("at"),
            F.transform("_l", lambda e: e["x"].cast("double")).alias("xs"),
            F.transform("_l", lambda e: e["y"].cast("double")).alias("ys"),
        )
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in frame] + [f"joint {types['joint']}", "_odd boolean"])
    moved = packed.mapInPandas(_swap_batches(list(joints), list(edges), rounds), schema)
    # After an odd number of exchanges a row shows the other subject's point. Both joins are by frame
    # alone, so rows that come partitioned by it stay where they are; a frame has two points a joint at most.
    turned = moved.groupBy(*frame).agg(F.collect_list(F.struct("joint", "_odd")).alias("_moved"))
    its_joint = F.col("joint")
    odd = F.get(F.filter("_moved", lambda e: e["joint"] == its_joint), F.lit(0))["_odd"]
    new = last.join(turned, frame).withColumn("_o", odd).filter("_o IS NOT NULL").groupBy(*frame).agg(
        F.collect_list(
            F.struct("joint", F.when(F.col("_o"), 1 - F.col("_side")).otherwise(F.col("_side")).alias("side"), F.col("_p").alias("p"))
        ).alias("_points")
    )
    its_side = F.col("_side")
    point = F.get(F.filter("_points", lambda e: (e["joint"] == its_joint) & (e["side"] == its_side)), F.lit(0))["p"]
    joined = keyed.join(new, frame, "left").withColumn("_new", point).drop("_points")
    hit = F.col("_new").isNotNull()
    return joined.withColumns(
        {
            **{c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in moving},
            "reason": F.when(hit, "anat_swap").otherwise(F.col("reason")),
        }
    ).drop("_side", "_ord", "_new")


def mask_cleanup(
    rows: DataFrame,
    object_of: Mapping[str, int],
    tolerance: float = TOLERANCE_PX,
    protected: Sequence = ("nose",),
    subject: str = "subject_corrected",
) -> DataFrame:
    """Blank points outside their own mask by more than the tolerance, or out of bounds.

    Works on :func:`mask_evidence` columns. Adds ``mask_status`` (not_checked,
    kept, kept_protected, removed) and the original values. A point whose mask
    is missing or empty is not judged.
    """

    def own(prefix: str) -> Column:
        out = F.lit(None)
        for name, o in object_of.items():
            out = F.when(F.col(subject) == name, F.col(f"{prefix}{o}")).otherwise(out)
        return out

    safe = F.coalesce(F.col("joint").isin(*protected), F.lit(False)) if protected else F.lit(False)
    status = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "not_checked")
        .when(~F.col("has1") & ~F.col("has2"), "not_checked")
        .when(safe, "kept_protected")
        .when(~F.coalesce(own("has"), F.lit(False)), "not_checked")
        .when(F.col("oob"), "removed")
        .when(own("in"), "kept")
        .when(own("d").isNull(), "not_checked")
        .when(own("d") <= tolerance, "kept")
        .otherwise("removed")
    )
    gone = F.col("mask_status") == "removed"
    return (
        rows.withColumn("mask_status", status)
        .withColumns({f"orig_{c}": F.col(c) for c in ("x", "y", "likelihood")})
        .withColumns(
            {
                "x": F.when(~gone, F.col("x")),
                "y": F.when(~gone, F.col("y")),
                "likelihood": F.when(gone, 0.0).otherwise(F.col("likelihood")),
            }
        )
    )


def removed_details(cleaned: DataFrame, keys: Sequence[str], subject: str = "subject_corrected") -> DataFrame:
    return cleaned.filter(F.col("mask_status") == "removed").select(
        *keys,
        F.col(subject).alias("subject"),
        "joint",
        F.col("orig_x").alias("x_original"),
        F.col("orig_y").alias("y_original"),
        F.col("orig_likelihood").alias("likelihood_original"),
    )


def identity_flag(frames: DataFrame, light: str, dark: str, margin: float = COLOR_MARGIN) -> DataFrame:
    """Flag frames where the dark animal's patch is brighter than the light one's by more than the margin."""
    return frames.withColumn(
        "flagged", F.coalesce(F.col(dark) - F.col(light) > margin, F.lit(False))
    )


def swap_zones(
    flagged: DataFrame, by: Sequence[str], axis: str = "frame_id", min_len: int = MIN_ZONE_FRAMES
) -> DataFrame:
    """Suspected-swap zones: runs of consecutive flagged frames."""
    return islands(flagged.filter("flagged"), by, axis, min_len)


def autofix(
    rows: DataFrame, zones: DataFrame, subjects: tuple[str, str], by: Sequence[str] = ("video_id",), subject: str = "subject"
) -> DataFrame:
    """Exchange the subjects in every zone."""
    ranges = zones.select(*by, "start", (F.col("end_exclusive") - 1).alias("end"))
    return toggle_range_swap(rows, ranges, subjects, by, subject)


def segment_status(segments: DataFrame, annotated: DataFrame | None = None, key: Sequence[str] = ("video_id",)) -> DataFrame:
    """State of each video from its segments; a pending annotation comes first.

    ``segments``: key, start_frame, merged BOOLEAN.
    """
    state = segments.groupBy(*key).agg(
        F.count("start_frame").alias("n_segments"),
        F.min("start_frame").alias("first_start"),
        F.coalesce(F.bool_or("merged"), F.lit(False)).alias("_merged"),
    )
    status = (
        F.when(F.col("_merged"), "merged")
        .when(F.col("n_segments") == 0, "pending")
        .when((F.col("n_segments") > 1) | (F.col("first_start") > 0), "has_resume")
        .otherwise("done")
    )
    out = state.withColumn("status", status).drop("_merged")
    if annotated is not None:
        noted = annotated.select(*key).distinct().withColumn("_noted", F.lit(True))
        out = out.join(noted, list(key), "full").withColumn(
            "display", F.when(F.col("_noted"), "annotated").otherwise(F.coalesce("status", F.lit("pending")))
        ).drop("_noted")
    return out
