"""Queries for masks, tiles and identity repair."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions import masks as M
from etholith.operators import aggregates as A
from etholith.operators import joins as J
from etholith.operators import rasters as X
from etholith.operators import tracking as T
from etholith.operators import windows as W
from etholith.operators.filters import likelihood_gate
from etholith.plans.register import R, query, rd, rounded
from etholith.plans.repair import repair_tracks
from etholith.session import cut_lineage, shared_dir
from etholith.sources.sinks import write_mask_shards

# The keypoint view in mask units: an 8x8 mask covers 576 px, so one cell is 72 px.
CELL = 72.0
SIZE = 8
# Mask frames, about a kilobyte each, from which on they are never broadcast.
EXCHANGED_SLOTS = 10_000
CHAIN_LIMIT = 35.0
JOINTS = list(range(1, 8))
CHAIN = [(j, j + 1, CHAIN_LIMIT) for j in JOINTS[:-1]]
CELL_CHAIN = [(a, b, t / CELL) for a, b, t in CHAIN]
CELL_NEIGHBOURS = {
    j: tuple((k, CHAIN_LIMIT / CELL) for k in (j - 1, j + 1) if k in JOINTS) for j in JOINTS
}
ORDER = ["joint", "l_partkey", "l_suppkey", "l_extendedprice", "subject"]


# ---------------------------------------------------------------- rasters


@query(
    "z_max_projection",
    "SELECT stack, pos, max(v) AS value FROM (SELECT stack, unnest(pixels) AS v, unnest(range(64))::INTEGER AS pos FROM tiles) GROUP BY 1, 2",
    "tiles",
)
def z_max_projection(spark, d):
    return X.z_max_projection(V.tiles(spark, d), ["stack"])


CHANNEL = "CASE z % 3 WHEN 0 THEN 'ch00' WHEN 1 THEN 'ch01' ELSE 'ch02' END"


@query(
    "merge_channels",
    f"""SELECT stack, pos, max(v) FILTER (ch = 'ch01') AS c1, max(v) FILTER (ch = 'ch00') AS c2, max(v) FILTER (ch = 'ch02' AND stack % 4 <> 0) AS c3
        FROM (SELECT stack, {CHANNEL} AS ch, unnest(pixels) AS v, unnest(range(64))::INTEGER AS pos FROM tiles) GROUP BY 1, 2""",
    "tiles",
)
def merge_channels(spark, d):
    names = F.array(*[F.lit(c) for c in ("ch00", "ch01", "ch02")])
    tiles = V.tiles(spark, d).withColumn("channel", F.get(names, (F.col("z") % 3).cast("int")))
    tiles = tiles.filter((F.col("channel") != "ch02") | (F.col("stack") % 4 != 0))
    return X.merge_channels(X.z_max_projection(tiles, ["stack", "channel"]), ["stack"])


@query(
    "mask_stats",
    f"""SELECT vec_id, len(px) AS area, {R('list_avg(list_transform(px, lambda i: i % 8))')} AS cx, {R('list_avg(list_transform(px, lambda i: i // 8))')} AS cy FROM masks""",
    "masks",
)
def mask_stats(spark, d):
    out = X.mask_stats(V.masks(spark, d), SIZE, SIZE)
    return out.select("vec_id", F.col("area").cast("long").alias("area"), rd("cx").alias("cx"), rd("cy").alias("cy"))


PAIRS = "pairs AS (SELECT a.slot, a.px AS p1, b.px AS p2 FROM masks a JOIN masks b ON a.slot = b.slot AND a.obj_id = 1 AND b.obj_id = 2)"


def mask_pairs(spark, d):
    """Objects 1 and 2 of each frame slot side by side."""
    slot, side = F.floor(F.col("vec_id") / 2).cast("long"), F.col("vec_id") % 2
    return V.masks(spark, d).groupBy(slot.alias("slot")).agg(
        F.max(F.when(side == 0, F.col("words"))).alias("words1"), F.max(F.when(side == 1, F.col("words"))).alias("words2")
    )


@query(
    "mask_iou",
    f"""WITH {PAIRS}, n AS (SELECT slot, len(list_intersect(p1, p2)) AS n_both, len(p1) + len(p2) - len(list_intersect(p1, p2)) AS n_union FROM pairs)
        SELECT slot, n_both, n_union, {R('n_both / n_union')} AS iou, n_both / n_union > 0.3 AS alert FROM n""",
    "masks",
)
def mask_iou(spark, d):
    out = X.mask_iou(mask_pairs(spark, d))
    return out.select("slot", F.col("n_both").cast("long").alias("n_both"), F.col("n_union").cast("long").alias("n_union"), rd("iou").alias("iou"), "alert")


@query(
    "overlap_resolution",
    f"""WITH {PAIRS}, k AS (SELECT *, len(p1) >= len(p2) AS first_keeps FROM pairs)
        SELECT slot, array_to_string(CASE WHEN first_keeps THEN p1 ELSE list_filter(p1, lambda i: NOT list_contains(p2, i)) END, ',') AS px1,
        array_to_string(CASE WHEN first_keeps THEN list_filter(p2, lambda i: NOT list_contains(p1, i)) ELSE p2 END, ',') AS px2 FROM k""",
    "masks",
)
def overlap_resolution(spark, d):
    out = X.overlap_resolution(mask_pairs(spark, d))
    return out.select("slot", *[F.array_join(M.set_pixels(F.col(f"words{o}"), 64), ",").alias(f"px{o}") for o in (1, 2)])


@query(
    "connected_objects",
    """WITH RECURSIVE p AS (SELECT z, i FROM (SELECT z, unnest(range(64)) AS i, unnest(pixels) AS v FROM tiles) WHERE v > 135),
        e AS (SELECT a.z, a.i AS a, b.i AS b FROM p a JOIN p b ON a.z = b.z AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
        c AS (SELECT z, i, i AS root FROM p UNION SELECT c.z, e.b, c.root FROM c JOIN e ON e.z = c.z AND e.a = c.i),
        l AS (SELECT z, i, min(root) AS label FROM c GROUP BY 1, 2)
        SELECT z, label::INTEGER AS label, count(*) AS area, round(avg(i % 8), 6) + 0.0 AS cx, round(avg(i // 8), 6) + 0.0 AS cy FROM l GROUP BY 1, 2""",
    "tiles",
)
def connected_objects(spark, d):
    classes = V.tiles(spark, d).select("z", M.threshold(F.col("pixels"), 135.0).alias("class_map"))
    out = X.connected_objects(classes, ["z"], SIZE, SIZE)
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


# ---------------------------------------------------------------- evidence


def slots(spark, d):
    """Mask frames of the view: slot s holds masks 2s and 2s + 1 as objects 1 and 2."""
    masks = V.masks(spark, d).withColumns(
        {"slot": F.floor(F.col("vec_id") / 2).cast("long"), "obj_id": F.col("vec_id") % 2 + 1}
    )
    return T.mask_frames(masks, ["slot"], SIZE, SIZE)


def sized(frames, n: int):
    """Many mask frames are exchanged: their outlines are a hundred times what the files show of them, so a
    broadcast decided by that size does not fit the driver."""
    return frames.hint("merge") if n >= EXCHANGED_SLOTS else frames


def cell_points(spark, d):
    return V.keypoints(spark, d, spread_out=True).withColumns(
        {"x": F.col("x") / CELL, "y": F.col("y") / CELL, "slot": F.col("frame_id") % V.mask_slots(spark, d)}
    )


def evidence_of(spark, d):
    return T.mask_evidence(J.frame_cogroup(cell_points(spark, d), slots(spark, d), ["slot"]), SIZE, SIZE)


def _near(p: str) -> str:
    return f"list_min(list_transform({p}, lambda i: sqrt((i % 8 - u) * (i % 8 - u) + (i // 8 - v) * (i // 8 - v))))"


def _centre(p: str) -> str:
    return f"sqrt(power(u - list_avg(list_transform({p}, lambda i: i % 8)), 2) + power(v - list_avg(list_transform({p}, lambda i: i // 8)), 2))"


EVIDENCE = f"""{PAIRS}, k0 AS (SELECT k.*, x / 72 AS u, y / 72 AS v, p1, p2 FROM kpts k LEFT JOIN pairs ON slot = frame_id % (SELECT greatest(count(*) // 2, 1) FROM embeddings)),
    k1 AS (SELECT *, CAST(round_even(u, 0) AS BIGINT) AS pu, CAST(round_even(v, 0) AS BIGINT) AS pv FROM k0),
    ev AS (SELECT *, NOT (pu BETWEEN 0 AND 7 AND pv BETWEEN 0 AND 7) AS oob,
      CASE WHEN pu BETWEEN 0 AND 7 AND pv BETWEEN 0 AND 7 THEN list_contains(p1, pv * 8 + pu) END AS in1,
      CASE WHEN pu BETWEEN 0 AND 7 AND pv BETWEEN 0 AND 7 THEN list_contains(p2, pv * 8 + pu) END AS in2,
      {_near('p1')} AS d1, {_near('p2')} AS d2, {_centre('p1')} AS c1, {_centre('p2')} AS c2 FROM k1)"""


@query(
    "frame_cogroup",
    f"""WITH {EVIDENCE} SELECT video_id, subject, joint, count(*) AS n, count(*) FILTER (oob) AS n_oob, count(*) FILTER (in1) AS n_in1, count(*) FILTER (in2) AS n_in2,
        {R('sum(d1)')} AS d1, {R('sum(d2)')} AS d2, {R('sum(c1)')} AS c1 FROM ev GROUP BY 1, 2, 3""",
    "masks kpts",
)
def frame_cogroup(spark, d):
    return evidence_of(spark, d).groupBy("video_id", "subject", "joint").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("oob"), 1)).alias("n_oob"), F.count(F.when(F.col("in1"), 1)).alias("n_in1"),
        F.count(F.when(F.col("in2"), 1)).alias("n_in2"), rd(F.sum("d1")).alias("d1"), rd(F.sum("d2")).alias("d2"), rd(F.sum("c1")).alias("c1"),
    )


SINGLE = """one AS (SELECT *, CASE WHEN oob THEN NULL WHEN in1 AND NOT in2 THEN 'obj1' WHEN in2 AND NOT in1 THEN 'obj2' WHEN in1 AND in2 THEN NULL
      WHEN least(d1, d2) > 1 THEN NULL WHEN d1 < d2 THEN 'obj1' ELSE 'obj2' END AS by_mask,
      CASE WHEN oob THEN 'out_of_bounds' WHEN in1 AND in2 THEN 'overlap' WHEN in1 OR in2 THEN 'mask_unique' WHEN least(d1, d2) > 1 THEN 'no_mask'
      ELSE 'mask_nearest' END AS why FROM ev WHERE x IS NOT NULL)"""


@query(
    "assign_single",
    f"""WITH {EVIDENCE}, {SINGLE} SELECT subject, joint, coalesce(by_mask, CASE WHEN c1 < c2 THEN 'obj1' ELSE 'obj2' END) AS assigned,
        CASE WHEN by_mask IS NULL THEN why || '_centroid_fallback' ELSE why END AS reason, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame,
        CAST(sum(l_partkey * frame_id) AS BIGINT) AS checksum FROM one GROUP BY 1, 2, 3, 4""",
    "masks kpts",
)
def assign_single(spark, d):
    rows = evidence_of(spark, d).filter("x IS NOT NULL").withColumn("_a", T.assign_single(tolerance=1.0))
    return rows.groupBy("subject", "joint", F.col("_a.assigned").alias("assigned"), F.col("_a.reason").alias("reason")).agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"), F.sum(F.col("l_partkey") * F.col("frame_id")).alias("checksum")
    )


PAIRED = f"""{EVIDENCE}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, joint, subject ORDER BY u, v) AS rn FROM ev WHERE x IS NOT NULL),
    b AS (SELECT a.video_id, a.frame_id, a.joint, a.u AS ax, a.v AS ay, b.u AS bx, b.v AS by_, a.d1 + b.d2 AS straight, a.d2 + b.d1 AS crossed
      FROM f a JOIN f b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.joint = b.joint AND a.subject = 's1' AND b.subject = 's2' AND a.rn = 1 AND b.rn = 1)"""


def paired_detections(spark, d):
    ready = evidence_of(spark, d).filter("x IS NOT NULL").withColumns(
        {"cost1": T.detection_cost(1), "cost2": T.detection_cost(2)}
    )
    pairs = J.pair_self_join(ready, ["video_id", "frame_id", "joint"], ("s1", "s2"), ["x", "y", "cost1", "cost2"])
    return pairs.dropna(subset=["a_x", "b_x"])


@query(
    "pair_self_join",
    f"""WITH {PAIRED} SELECT video_id, joint, count(*) AS n, {R('sum(ax * by_)', 4)} AS mixed, {R('sum(sqrt((ax - bx) ** 2 + (ay - by_) ** 2))')} AS apart
        FROM b GROUP BY 1, 2""",
    "masks kpts",
)
def pair_self_join(spark, d):
    """Pairs by their coordinates alone; what they see of the masks does not enter."""
    seen = cell_points(spark, d).filter("x IS NOT NULL")
    pairs = J.pair_self_join(seen, ["video_id", "frame_id", "joint"], ("s1", "s2"), ["x", "y"]).dropna(subset=["a_x", "b_x"])
    return pairs.groupBy("video_id", "joint").agg(
        F.count("*").alias("n"), rd(F.sum(F.col("a_x") * F.col("b_y")), 4).alias("mixed"),
        rd(F.sum(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))).alias("apart"),
    )


@query(
    "assign_pair",
    f"""WITH {PAIRED} SELECT video_id, joint, CASE WHEN straight - crossed <= 1e-9 THEN 'obj1' ELSE 'obj2' END AS a_assigned, count(*) AS n,
        CAST(sum(frame_id) AS BIGINT) AS sum_frame, {R('sum(least(straight, crossed))')} AS cost FROM b GROUP BY 1, 2, 3""",
    "masks kpts",
)
def assign_pair(spark, d):
    return T.assign_pair(paired_detections(spark, d)).groupBy("video_id", "joint", "a_assigned").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"), rd(F.sum(F.least("cost_straight", "cost_crossed"))).alias("cost")
    )


@query(
    "nan_rows",
    """SELECT video_id, joint, subject AS subject_corrected, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame FROM kpts WHERE x IS NULL OR y IS NULL GROUP BY 1, 2, 3""",
    "kpts",
)
def nan_rows(spark, d):
    out = assigned_frames(spark, d).filter("reason = 'nan_coords'")
    return out.groupBy("video_id", "joint", F.coalesce("assigned", "subject").alias("subject_corrected")).agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame")
    )


def assigned_frames(spark, d):
    return T.assign_frames(cut_lineage(evidence_of(spark, d)).repartition("video_id", "frame_id"), ["video_id", "frame_id"], ORDER, CELL_NEIGHBOURS, tolerance=1.0)


def _stretch(d: str, o: int) -> str:
    return f"coalesce(greatest(0, sqrt(({d}u - x{o}) ** 2 + ({d}v - y{o}) ** 2) - {CHAIN_LIMIT} / {CELL}), 0)"


ASSIGNED = f"""RECURSIVE {EVIDENCE},
    dt AS (SELECT *, u IS NULL OR v IS NULL AS blank, row_number() OVER (PARTITION BY video_id, frame_id, joint, u IS NULL OR v IS NULL
      ORDER BY l_partkey, l_suppkey, l_extendedprice, subject) AS rn FROM ev),
    lone AS (SELECT *, CASE WHEN oob THEN NULL WHEN in1 AND NOT in2 THEN 'obj1' WHEN in2 AND NOT in1 THEN 'obj2' WHEN in1 AND in2 THEN NULL
      WHEN least(d1, d2) > 1 THEN NULL WHEN d1 < d2 THEN 'obj1' ELSE 'obj2' END AS by_mask,
      CASE WHEN oob THEN 'out_of_bounds' WHEN in1 AND in2 THEN 'overlap' WHEN in1 OR in2 THEN 'mask_unique' WHEN least(d1, d2) > 1 THEN 'no_mask'
      ELSE 'mask_nearest' END AS why FROM dt),
    pq AS (SELECT video_id, frame_id, joint, max(u) FILTER (rn = 1) AS pu, max(v) FILTER (rn = 1) AS pv, max(d1) FILTER (rn = 1) AS p1, max(d2) FILTER (rn = 1) AS p2,
      max(u) FILTER (rn = 2) AS qu, max(v) FILTER (rn = 2) AS qv, max(d1) FILTER (rn = 2) AS q1, max(d2) FILTER (rn = 2) AS q2,
      max(coalesce(by_mask, CASE WHEN c1 < c2 THEN 'obj1' ELSE 'obj2' END)) FILTER (rn = 1) AS alone FROM lone WHERE NOT blank AND rn <= 2 GROUP BY 1, 2, 3),
    walk AS (SELECT DISTINCT video_id, frame_id, 0::BIGINT AS joint, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2, NULL::BOOLEAN AS straight FROM kpts
      UNION ALL SELECT video_id, frame_id, joint, CASE WHEN first THEN pu ELSE qu END, CASE WHEN first THEN pv ELSE qv END,
        CASE WHEN first THEN qu ELSE pu END, CASE WHEN first THEN qv ELSE pv END, first FROM (
        SELECT w.video_id, w.frame_id, w.joint + 1 AS joint, pu, pv, qu, qv, CASE WHEN pu IS NULL THEN NULL WHEN qu IS NULL THEN alone = 'obj1'
          ELSE (p1 + {_stretch('p', 1)} + q2 + {_stretch('q', 2)}) - (p2 + {_stretch('p', 2)} + q1 + {_stretch('q', 1)}) <= 1e-9 END AS first
        FROM walk w LEFT JOIN pq ON pq.video_id = w.video_id AND pq.frame_id = w.frame_id AND pq.joint = w.joint + 1 WHERE w.joint < 7)),
    given AS (SELECT l.*, CASE WHEN blank OR l.rn > 2 THEN NULL WHEN (l.rn = 1) = straight THEN 'obj1' ELSE 'obj2' END AS assigned,
      CASE WHEN blank THEN 'nan_coords' WHEN l.rn > 2 THEN 'extra_detection' WHEN q1 IS NOT NULL THEN 'exclusive_pair'
        WHEN by_mask IS NULL THEN why || '_centroid_fallback' ELSE why END AS reason
      FROM lone l LEFT JOIN walk USING (video_id, frame_id, joint) LEFT JOIN pq USING (video_id, frame_id, joint))"""


@query(
    "assign_frames",
    f"WITH {ASSIGNED} SELECT joint, subject, assigned, reason, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame FROM given GROUP BY 1, 2, 3, 4",
    "masks kpts",
)
def assign_frames(spark, d):
    return assigned_frames(spark, d).groupBy("joint", "subject", "assigned", "reason").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame")
    )


# ---------------------------------------------------------------- skeleton and swaps


COPIES = ["l_partkey", "l_suppkey", "l_extendedprice"]
LAST = """la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, subject, joint
    ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM kpts WHERE x IS NOT NULL AND y IS NOT NULL) WHERE rn = 1)"""
BONES = """FROM la a JOIN la b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.subject = b.subject AND abs(a.joint - b.joint) = 1"""


@query(
    "skeleton_join",
    f"""WITH {LAST} SELECT a.joint, b.joint AS other, count(*) AS n, {R('sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))')} AS total {BONES} GROUP BY 1, 2""",
    "kpts",
)
def skeleton_join(spark, d):
    key = ["video_id", "frame_id", "subject"]
    points = T.last_points(V.keypoints(spark, d).repartition(*key), key, COPIES)
    dist = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return J.skeleton_join(points, CHAIN, key).groupBy("joint", "other").agg(F.count("*").alias("n"), rd(F.sum(dist)).alias("total"))


@query(
    "skeleton_violation",
    f"""WITH {LAST} SELECT DISTINCT a.video_id, a.frame_id, a.subject, a.joint {BONES} WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 > 35 * 35""",
    "kpts",
)
def skeleton_violation(spark, d):
    return T.skeleton_violation(V.keypoints(spark, d).repartition("video_id", "frame_id", "subject"), CHAIN, order=COPIES)


RANGES = "ranges AS (SELECT n_nationkey % 4 AS video_id, n_nationkey * 500 AS start, n_nationkey * 500 + 700 + (n_nationkey % 3) * 1400 AS stop FROM nation)"


def nation_ranges(spark, d):
    k = F.col("n_nationkey").cast("long")
    return V.table(spark, d, "nation").select((k % 4).alias("video_id"), (k * 500).alias("start"), (k * 500 + 700 + (k % 3) * 1400).alias("end"))


@query(
    "toggle_range_swap",
    f"""WITH {RANGES}, h AS (SELECT k.*, (SELECT count(*) FROM ranges r WHERE r.video_id = k.video_id AND k.frame_id BETWEEN r.start AND r.stop) % 2 AS odd FROM kpts k)
        SELECT video_id, CASE WHEN odd = 1 THEN CASE subject WHEN 's1' THEN 's2' ELSE 's1' END ELSE subject END AS subject, joint, count(*) AS n,
        CAST(sum(frame_id) AS BIGINT) AS sum_frame, {R('sum(x)')} AS sum_x FROM h GROUP BY 1, 2, 3""",
    "kpts",
)
def toggle_range_swap(spark, d):
    out = J.toggle_range_swap(V.keypoints(spark, d), nation_ranges(spark, d), ("s1", "s2"))
    return out.groupBy("video_id", "subject", "joint").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"), rd(F.sum("x")).alias("sum_x")
    )


def _keeps(at: str, around: str, limit: str) -> str:
    """Whether joint ``j`` at the place ``at`` has of it stays within reach of the neighbours ``around`` has."""
    far = [f"coalesce(({at}x[j] - {around}x[j {o} 1]) ** 2 + ({at}y[j] - {around}y[j {o} 1]) ** 2 > ({limit} + 1e-9) ** 2, false)" for o in "-+"]
    return f"NOT ({far[0]} OR {far[1]})"


def _with_joint(own: str, other: str) -> str:
    return f"CASE WHEN k IS NULL THEN {own} ELSE list_transform(range(1, 8), lambda i: CASE WHEN i = k THEN {other}[i] ELSE {own}[i] END) END"


def swaps_sql(points: str, limit: str = f"{CHAIN_LIMIT}") -> str:
    """``exchanged`` (video_id, frame_id, joints): joints in the order of their exchanges, from ``points`` (.., side, joint, px, py).

    One side at a time takes its turn; two turns without an exchange end a frame, and ten rounds do.
    """
    lists = ", ".join(f"list_transform(range(1, 8), lambda i: map_extract_value(map_from_entries(list(({'joint'}, {c})) FILTER (side = {s})), i)) AS {n}{c[1]}"
                      for s, n in ((0, "o"), (1, "p")) for c in ("px", "py"))
    return f"""start AS (SELECT video_id, frame_id, {lists} FROM {points} GROUP BY 1, 2 HAVING min(side) < max(side)),
    turns AS (SELECT video_id, frame_id, 0 AS t, ox, oy, px, py, []::BIGINT[] AS joints, 0 AS idle FROM start
      UNION ALL SELECT video_id, frame_id, t + 1, {_with_joint('px', 'ox')}, {_with_joint('py', 'oy')}, {_with_joint('ox', 'px')}, {_with_joint('oy', 'py')},
        CASE WHEN k IS NULL THEN joints ELSE list_append(joints, k) END,
        CASE WHEN k IS NOT NULL THEN 0 ELSE idle + 1 END FROM (
        SELECT *, list_filter(range(1, 8), lambda j: ox[j] IS NOT NULL AND px[j] IS NOT NULL AND NOT ({_keeps('o', 'o', limit)}) AND {_keeps('p', 'o', limit)} AND {_keeps('o', 'p', limit)})[1] AS k
        FROM turns WHERE t < 20 AND NOT (t % 2 = 0 AND idle >= 2))),
    exchanged AS (SELECT video_id, frame_id, arg_max(joints, t) AS joints FROM turns GROUP BY 1, 2)"""


SWAP_POINTS = """lp AS (SELECT video_id, frame_id, joint, CASE subject WHEN 's1' THEN 0 ELSE 1 END AS side, x AS px, y AS py FROM (SELECT *, row_number() OVER (
    PARTITION BY video_id, frame_id, subject, joint ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM kpts WHERE x IS NOT NULL AND y IS NOT NULL) WHERE rn = 1)"""


@query(
    "anatomical_swap",
    f"""WITH RECURSIVE {SWAP_POINTS}, {swaps_sql('lp')}
        SELECT subject AS subject_corrected, joint, CASE WHEN coalesce(list_contains(joints, joint), false) THEN 'anat_swap' ELSE 'exclusive_pair' END AS reason,
        count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame FROM kpts LEFT JOIN exchanged USING (video_id, frame_id) GROUP BY 1, 2, 3""",
    "kpts",
)
def anatomical_swap(spark, d):
    rows = V.keypoints(spark, d).repartition("video_id", "frame_id").withColumnRenamed("subject", "subject_corrected").withColumn("reason", F.lit("exclusive_pair"))
    order = ["joint", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = T.anatomical_swap(rows, ("s1", "s2"), JOINTS, CHAIN, order=order)
    return out.groupBy("subject_corrected", "joint", "reason").agg(F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"))


# ---------------------------------------------------------------- cleanup


def cleaned(spark, d):
    return T.mask_cleanup(evidence_of(spark, d), {"s1": 1, "s2": 2}, 1.0, protected=(1,), subject="subject")


CLEANED = f"""{EVIDENCE}, cl AS (SELECT *, CASE WHEN x IS NULL THEN 'not_checked' WHEN joint = 1 THEN 'kept_protected' WHEN oob THEN 'removed'
    WHEN CASE subject WHEN 's1' THEN in1 ELSE in2 END THEN 'kept' WHEN CASE subject WHEN 's1' THEN d1 ELSE d2 END <= 1 THEN 'kept' ELSE 'removed' END AS mask_status FROM ev)"""


@query(
    "mask_cleanup",
    f"""WITH {CLEANED} SELECT video_id, subject, joint, mask_status, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame,
        {R("sum(CASE WHEN mask_status <> 'removed' THEN u END)")} AS sum_x, {R('sum(u)')} AS sum_orig_x,
        {R("sum(CASE WHEN mask_status = 'removed' THEN 0 ELSE likelihood END)")} AS sum_lh FROM cl GROUP BY 1, 2, 3, 4""",
    "masks kpts",
)
def mask_cleanup(spark, d):
    return cleaned(spark, d).groupBy("video_id", "subject", "joint", "mask_status").agg(
        F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"), rd(F.sum("x")).alias("sum_x"), rd(F.sum("orig_x")).alias("sum_orig_x"),
        rd(F.sum("likelihood")).alias("sum_lh"),
    )


def _pct(cond: str) -> str:
    return (
        f"count(*) FILTER ({cond}) AS {{0}}_total, count(*) FILTER ({cond} AND mask_status = 'removed') AS {{0}}_removed, "
        f"coalesce(round(100.0 * count(*) FILTER ({cond} AND mask_status = 'removed') / nullif(count(*) FILTER ({cond}), 0), 2), 0) AS {{0}}_pct_removed"
    )


@query(
    "cleanup_summary",
    f"""WITH {CLEANED} SELECT coalesce(CAST(joint AS VARCHAR), 'TOTAL') AS joint, {_pct("subject = 's1'").format('s1')}, {_pct("subject = 's2'").format('s2')},
        count(*) AS total_all, count(*) FILTER (mask_status = 'removed') AS removed_all,
        round(100.0 * count(*) FILTER (mask_status = 'removed') / count(*), 2) AS pct_removed_all FROM cl WHERE mask_status <> 'not_checked' GROUP BY ROLLUP (cl.joint)""",
    "masks kpts",
)
def cleanup_summary(spark, d):
    return A.cleanup_summary(cleaned(spark, d), ("s1", "s2"))


@query(
    "removed_details",
    f"""WITH {CLEANED} SELECT video_id, frame_id, subject, joint, {R('u')} AS x_original, {R('v')} AS y_original, {R('likelihood')} AS likelihood_original
        FROM cl WHERE mask_status = 'removed'""",
    "masks kpts",
)
def removed_details(spark, d):
    out = T.removed_details(cleaned(spark, d), ["video_id", "frame_id"], subject="subject")
    return rounded(out, "x_original", "y_original", "likelihood_original")


REPAIRED = f"""{ASSIGNED},
    ow AS (SELECT *, CASE assigned WHEN 'obj1' THEN 's1' WHEN 'obj2' THEN 's2' ELSE subject END AS sc FROM given),
    lp AS (SELECT *, CASE sc WHEN 's1' THEN 0 ELSE 1 END AS side, u AS px, v AS py FROM ow WHERE NOT blank
      QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, sc, joint ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, subject DESC) = 1),
    {swaps_sql('lp', f'{CHAIN_LIMIT} / {CELL}')},
    hit AS (SELECT ow.*, len(list_filter(coalesce(joints, []), lambda i: i = joint)) AS n_swaps, CASE sc WHEN 's1' THEN 0 ELSE 1 END AS side
      FROM ow LEFT JOIN exchanged USING (video_id, frame_id)),
    mv AS (SELECT h.video_id, h.frame_id, h.joint, h.subject, h.sc, CASE WHEN n_swaps > 0 THEN 'anat_swap' ELSE h.reason END AS reason,
      {', '.join(f'CASE WHEN n_swaps > 0 THEN l.{c} ELSE h.{c} END AS {c}' for c in ('u', 'v', 'likelihood', 'oob', 'in1', 'in2', 'd1', 'd2'))}
      FROM hit h LEFT JOIN lp l ON n_swaps > 0 AND l.video_id = h.video_id AND l.frame_id = h.frame_id AND l.joint = h.joint
        AND l.side = CASE WHEN n_swaps % 2 = 1 THEN 1 - h.side ELSE h.side END),
    st AS (SELECT *, CASE WHEN u IS NULL THEN 'not_checked' WHEN joint = 1 THEN 'kept_protected' WHEN oob THEN 'removed'
      WHEN CASE sc WHEN 's1' THEN in1 ELSE in2 END THEN 'kept' WHEN CASE sc WHEN 's1' THEN d1 ELSE d2 END <= 1 THEN 'kept' ELSE 'removed' END AS mask_status FROM mv)"""


@query(
    "repair_tracks",
    f"""WITH {REPAIRED} SELECT video_id, frame_id, joint, subject, sc AS subject_corrected, CASE WHEN mask_status <> 'removed' THEN {R('u')} END AS x,
        CASE WHEN mask_status <> 'removed' THEN {R('v')} END AS y, CASE WHEN mask_status = 'removed' THEN 0.0 ELSE {R('likelihood')} END AS likelihood, reason, mask_status FROM st""",
    "masks kpts",
)
def repair(spark, d):
    return _repaired(spark, d, slots(spark, d), SIZE, SIZE)


def _repaired(spark, d, frames, h, w):
    out = repair_tracks(
        cell_points(spark, d), frames, ["slot"], h, w, ORDER, JOINTS, {"obj1": "s1", "obj2": "s2"},
        CELL_CHAIN, CELL_NEIGHBOURS, 1.0, protected=(1,),
    )
    out = out.select("video_id", "frame_id", "joint", "subject", "subject_corrected", "x", "y", "likelihood", "reason", "mask_status")
    return rounded(out, "x", "y").withColumn("likelihood", F.when(F.col("mask_status") == "removed", 0.0).otherwise(rd("likelihood")))


@query("repair_from_shards", f"WITH {REPAIRED} SELECT reason, mask_status, count(*) AS n, CAST(sum(frame_id) AS BIGINT) AS sum_frame FROM st GROUP BY 1, 2", "masks kpts")
def repair_from_shards(spark, d):
    """Masks written as packed shards to the shared folder, read again, and repaired with their own sizes."""
    folder = f"{shared_dir(spark)}/mask-shards-{uuid.uuid4().hex}"
    rows = V.masks(spark, d).select(
        (F.floor(F.col("vec_id") / 2) % 4).alias("animal"), F.floor(F.col("vec_id") / 2).cast("long").alias("frame_id"),
        (F.col("vec_id") % 2 + 1).alias("obj_id"), F.lit(SIZE).alias("h"), F.lit(SIZE).alias("w"), V.packed(F.col("words")).alias("packed"),
    )
    write_mask_shards(rows, folder)
    back = spark.read.parquet(folder).withColumnRenamed("frame_id", "slot")
    out = _repaired(spark, d, sized(T.mask_frames(back, ["slot"]), V.mask_slots(spark, d)), None, None)
    return out.groupBy("reason", "mask_status").agg(F.count("*").alias("n"), F.sum("frame_id").alias("sum_frame"))


DEDUPED = """dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, subject, joint
    ORDER BY CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END, l_partkey, l_suppkey, l_extendedprice) AS rn FROM kpts) WHERE rn = 1)"""
CELLS = ", ".join(
    f"max({c}) FILTER (subject = '{s}' AND joint = {j}) AS {s}_Joint_{j}_{c}" for s in ("s1", "s2") for j in JOINTS for c in ("x", "y", "likelihood")
)


@query("wide_keypoints", f"WITH {DEDUPED} SELECT video_id, frame_id, {CELLS} FROM dd GROUP BY 1, 2", "kpts")
def wide_keypoints(spark, d):
    from etholith.sources.keypoints import to_wide

    kept = W.dedupe_prefer_coords(
        V.keypoints(spark, d).withColumn("joint", F.concat(F.lit("joint_"), F.col("joint").cast("string"))),
        ["video_id", "frame_id", "subject", "joint"], ["l_partkey", "l_suppkey", "l_extendedprice"],
    )
    return to_wide(kept, ["video_id", "frame_id"], ("s1", "s2"), [f"joint_{j}" for j in JOINTS])


# ---------------------------------------------------------------- identity by brightness


def brightness_frames(spark, d):
    """Patch brightness under the centre joint (4) of both subjects, per frame."""
    centre = likelihood_gate(V.keypoints(spark, d).filter("joint = 4"), 0.75).dropna(subset=["x", "y"])
    pairs = J.pair_self_join(centre, ["video_id", "frame_id"], ("s1", "s2"), ["x", "y"])
    tiles = V.tiles(spark, d).select(F.col("z").alias("tile"), "pixels")
    number = max(1, V.table(spark, d, "embeddings").count())
    rows = pairs.withColumn("tile", F.col("frame_id") % number).join(tiles, "tile")
    for side, name in (("a", "light"), ("b", "dark")):
        patch = M.patch_mean(F.col("pixels"), SIZE, SIZE, F.col(f"{side}_x") / CELL, F.col(f"{side}_y") / CELL, 1)
        rows = rows.withColumn(name, F.when(F.col(f"{side}_x").isNotNull(), patch))
    return T.identity_flag(rows.select("video_id", "frame_id", "light", "dark"), "light", "dark", 5.0)


def _patch(side: str) -> str:
    return f"list_avg(list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN {side}u - 1 AND {side}u + 1 AND i // 8 BETWEEN {side}v - 1 AND {side}v + 1), lambda i: pixels[i + 1]))"


BRIGHT = f"""ce AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, subject ORDER BY x, y) AS rn FROM kpts WHERE joint = 4 AND x IS NOT NULL AND likelihood >= 0.75),
    fr AS (SELECT video_id, frame_id, max(x) FILTER (subject = 's1') AS ax, max(y) FILTER (subject = 's1') AS ay, max(x) FILTER (subject = 's2') AS bx, max(y) FILTER (subject = 's2') AS by_
      FROM ce WHERE rn = 1 GROUP BY 1, 2),
    pp AS (SELECT video_id, frame_id, pixels, CAST(round_even(ax / 72, 0) AS BIGINT) AS au, CAST(round_even(ay / 72, 0) AS BIGINT) AS av, CAST(round_even(bx / 72, 0) AS BIGINT) AS bu,
      CAST(round_even(by_ / 72, 0) AS BIGINT) AS bv FROM fr JOIN tiles ON z = frame_id % (SELECT count(*) FROM embeddings)),
    br AS (SELECT video_id, frame_id, {_patch('a')} AS light, {_patch('b')} AS dark FROM pp),
    fl AS (SELECT *, coalesce(dark - light > 5.0, false) AS flagged FROM br)"""


@query(
    "identity_flag",
    f"WITH {BRIGHT} SELECT video_id, frame_id, {R('light')} AS light, {R('dark')} AS dark, flagged FROM fl",
    "kpts tiles",
)
def identity_flag(spark, d):
    return rounded(brightness_frames(spark, d), "light", "dark")


ZONES = """zo AS (SELECT video_id, min(t) AS start, max(t) + 1 AS end_exclusive, count(*) AS n_frames FROM (SELECT video_id, t,
    t - row_number() OVER (PARTITION BY video_id ORDER BY t) AS g FROM (SELECT DISTINCT video_id, frame_id // 4 AS t FROM fl WHERE flagged))
    GROUP BY video_id, g HAVING count(*) >= 2)"""


def zones_of(spark, d):
    """Frames of one video are four apart in the view; the zone axis counts them one by one."""
    steps = brightness_frames(spark, d).withColumn("frame_id", F.floor(F.col("frame_id") / 4).cast("long"))
    return T.swap_zones(steps, ["video_id"])


@query("swap_zones", f"WITH {BRIGHT}, {ZONES} SELECT * FROM zo", "kpts tiles")
def swap_zones(spark, d):
    return zones_of(spark, d)


@query(
    "autofix",
    f"""WITH {BRIGHT}, {ZONES} SELECT video_id, CASE WHEN EXISTS (SELECT 1 FROM zo WHERE zo.video_id = k.video_id AND k.frame_id // 4 >= zo.start
        AND k.frame_id // 4 < zo.end_exclusive) THEN CASE subject WHEN 's1' THEN 's2' ELSE 's1' END ELSE subject END AS subject, joint, count(*) AS n,
        {R('sum(x)')} AS sum_x, {R('sum(likelihood)')} AS sum_lh FROM kpts k GROUP BY 1, 2, 3""",
    "kpts tiles",
)
def autofix(spark, d):
    rows = V.keypoints(spark, d).withColumn("frame_id", F.floor(F.col("frame_id") / 4).cast("long"))
    fixed = T.autofix(rows, zones_of(spark, d), ("s1", "s2"))
    return fixed.groupBy("video_id", "subject", "joint").agg(
        F.count("*").alias("n"), rd(F.sum("x")).alias("sum_x"), rd(F.sum("likelihood")).alias("sum_lh")
    )
