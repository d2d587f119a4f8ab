"""Queries for per-group order, run merging, gaps, islands and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions import ids
from etholith.operators import frames as R_
from etholith.operators import windows as W
from etholith.plans.register import R, query, rd, rounded
from etholith.plans.relational import FILE_IDS, SESSIONS, SOCIAL, VIEWS_SQL, in_sql, rows_sql, totals_of

PRIORITY = "CASE run_name WHEN 'output' THEN 0 WHEN 'resume' THEN 1 WHEN 'resume2' THEN 2 WHEN 'resume3' THEN 3 END"


@query(
    "rc_thirds",
    """SELECT image_id, animal_id, CASE WHEN n >= 3 THEN CASE tile WHEN 1 THEN 'Anterior' WHEN 2 THEN 'Middle' ELSE 'Posterior' END END AS rc_bin
        FROM (SELECT image_id, animal_id, ntile(3) OVER (PARTITION BY animal_id ORDER BY image_id) AS tile,
              count(*) OVER (PARTITION BY animal_id) AS n FROM counts)""",
    "counts",
)
def rc_thirds(spark, d):
    rows = V.counts(spark, d).select("image_id", "animal_id")
    return W.rc_thirds(rows, ["animal_id"], "image_id", "image_id")


@query(
    "cohort_order",
    """SELECT cohort, image_id, row_number() OVER (PARTITION BY cohort ORDER BY animal_id, image_id) AS cohort_order FROM counts""",
    "counts",
)
def cohort_order(spark, d):
    rows = V.counts(spark, d).select("cohort", "image_id", "animal_id")
    return W.cohort_order(rows, "cohort", ["animal_id", "image_id"]).drop("animal_id")


@query(
    "z_score",
    f"""WITH {VIEWS_SQL}, s AS (SELECT behavior, session_type, avg(total_duration_sec) AS m, stddev_samp(total_duration_sec) AS s FROM totals GROUP BY 1, 2)
        SELECT animal_id, behavior, session_type, {R('CASE WHEN s = 0 THEN 0 ELSE (total_duration_sec - m) / s END', 5)} AS z
        FROM totals JOIN s USING (behavior, session_type)""",
    "bouts",
)
def z_score(spark, d):
    out = W.z_score(totals_of(spark, d), ["behavior", "session_type"], "total_duration_sec")
    return out.select("animal_id", "behavior", "session_type", rd("z", 5).alias("z"))


@query(
    "min_max_norm",
    f"""WITH s AS (SELECT animal_id, min(both_n) AS lo, max(both_n) AS hi FROM counts GROUP BY 1)
        SELECT image_id, animal_id, {R('CASE WHEN hi = lo THEN 0.5 ELSE (both_n - lo) / nullif(hi - lo, 0) END')} AS value_norm FROM counts JOIN s USING (animal_id)""",
    "counts",
)
def min_max_norm(spark, d):
    out = W.min_max_norm(V.counts(spark, d), ["animal_id"], "both_n")
    return out.select("image_id", "animal_id", rd("value_norm").alias("value_norm"))


@query(
    "first_event",
    f"""SELECT animal_id, session_type, {R('start_sec')} AS latency_sec, behavior AS first_behavior, actor AS first_actor FROM (
        SELECT *, row_number() OVER (PARTITION BY animal_id, session_type ORDER BY start_sec, ord) AS rn FROM bouts
        WHERE behavior IN {in_sql(SOCIAL)}) WHERE rn = 1""",
    "bouts",
)
def first_event(spark, d):
    return rounded(W.first_event(V.bouts(spark, d).filter(F.col("behavior").isin(*SOCIAL))), "latency_sec")


LATENCY = f"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY animal_id, session_type ORDER BY start_sec, ord) AS rn FROM bouts
      WHERE behavior IN ('click_0', 'error_3')) WHERE rn = 1), len AS (SELECT session_type, max(end_sec) AS s FROM bouts GROUP BY 1),
    latency AS (SELECT animal_id, session_type, coalesce(start_sec, s) AS latency_sec, start_sec IS NULL AS censored, f.behavior AS first_behavior
      FROM (SELECT DISTINCT animal_id FROM bouts) CROSS JOIN {rows_sql('session_type', SESSIONS)}
      LEFT JOIN first f USING (animal_id, session_type) JOIN len USING (session_type))"""


def latency_of(spark, d):
    return W.censored_latency(V.bouts(spark, d), ("click_0", "error_3"), SESSIONS)


@query(
    "censored_latency",
    f"WITH {LATENCY} SELECT animal_id, session_type, {R('latency_sec')} AS latency_sec, censored, first_behavior FROM latency",
    "bouts",
)
def censored_latency(spark, d):
    out = latency_of(spark, d).select("animal_id", "session_type", "latency_sec", "censored", "first_behavior")
    return rounded(out, "latency_sec")


@query(
    "avg_rank",
    """SELECT image_id, cohort, CAST(rank() OVER (PARTITION BY cohort ORDER BY both_n) + (count(*) OVER (PARTITION BY cohort, both_n) - 1) / 2.0::DOUBLE AS DOUBLE)
        AS avg_rank FROM counts""",
    "counts",
)
def avg_rank(spark, d):
    return W.avg_rank(V.counts(spark, d), ["cohort"], "both_n").select("image_id", "cohort", "avg_rank")


@query(
    "dedupe_first",
    f"""SELECT image_id, arg_min(name, ord) AS name, min(ord) AS ord, count(*) AS n_rows FROM ({FILE_IDS}) WHERE image_id IS NOT NULL GROUP BY 1""",
    "files",
)
def dedupe_first(spark, d):
    named = V.files(spark, d).withColumn("image_id", ids.image_id(F.col("name"))).filter("image_id IS NOT NULL")
    firsts = W.dedupe_first(named, ["image_id"], ["ord"])
    sizes = named.groupBy("image_id").agg(F.count("*").alias("n_rows"))
    return firsts.join(sizes, "image_id")


@query(
    "dedupe_prefer_coords",
    """SELECT video_id, frame_id, subject, joint, x, y, round(likelihood, 6) AS likelihood FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, subject, joint
          ORDER BY CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END, l_partkey, l_suppkey, l_extendedprice) AS rn FROM kpts) WHERE rn = 1""",
    "kpts",
)
def dedupe_prefer_coords(spark, d):
    out = W.dedupe_prefer_coords(
        V.keypoints(spark, d), ["video_id", "frame_id", "subject", "joint"], ["l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return out.select("video_id", "frame_id", "subject", "joint", "x", "y", F.round("likelihood", 6).alias("likelihood"))


MERGED = f"""merged AS (SELECT r.* FROM runs r JOIN (SELECT animal_id, frame_id, max({PRIORITY}) AS best FROM runs GROUP BY 1, 2) b
    ON r.animal_id = b.animal_id AND r.frame_id = b.frame_id AND {PRIORITY} = best)"""


@query("priority_merge", f"WITH {MERGED} SELECT ord, animal_id, frame_id, obj_id, run_name FROM merged", "runs")
def priority_merge(spark, d):
    return W.priority_merge(V.runs(spark, d)).select("ord", "animal_id", "frame_id", "obj_id", "run_name")


@query(
    "run_usage",
    f"""WITH {MERGED} SELECT animal_id, run_name, first_frame, last_frame, n_covered, coalesce(n_used, 0) AS n_used FROM
        (SELECT animal_id, run_name, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(DISTINCT frame_id) AS n_covered FROM runs GROUP BY 1, 2)
        LEFT JOIN (SELECT animal_id, run_name, count(DISTINCT frame_id) AS n_used FROM merged GROUP BY 1, 2) USING (animal_id, run_name)""",
    "runs",
)
def run_usage(spark, d):
    return W.run_usage(V.runs(spark, d))


@query(
    "islands",
    """SELECT video_id, min(t) AS start, max(t) + 1 AS end_exclusive, count(*) AS n_frames FROM (
        SELECT video_id, t, t - row_number() OVER (PARTITION BY video_id ORDER BY t) AS g FROM (
        SELECT DISTINCT video_id, frame_id // 4 AS t FROM kpts WHERE likelihood < 0.75)) GROUP BY video_id, g HAVING count(*) >= 2""",
    "kpts",
)
def islands(spark, d):
    low = V.keypoints(spark, d).filter("likelihood < 0.75").select("video_id", F.floor(F.col("frame_id") / 4).cast("long").alias("t"))
    return R_.islands(low, ["video_id"], "t", min_len=2, chunk=512)


GAPS = """gaps AS (SELECT animal_id, frame_id + 1 AS start, nxt AS end_exclusive, nxt - frame_id - 1 AS n_frames FROM (
    SELECT animal_id, frame_id, lead(frame_id) OVER (PARTITION BY animal_id ORDER BY frame_id) AS nxt FROM (SELECT DISTINCT animal_id, frame_id FROM runs))
    WHERE nxt > frame_id + 1)"""


@query("gaps", f"WITH {GAPS} SELECT * FROM gaps", "runs")
def gaps(spark, d):
    return R_.gaps(V.runs(spark, d), ["animal_id"], chunk=128)


TRACK = f"""{MERGED}, track AS (SELECT animal_id, obj_id, frame_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY animal_id, obj_id, frame_id
    ORDER BY ord) AS rn FROM merged) WHERE rn = 1)"""


def track_of(spark, d):
    """One centroid per animal, object and frame of the merged runs."""
    merged = W.priority_merge(V.runs(spark, d))
    return W.dedupe_first(merged, ["animal_id", "obj_id", "frame_id"], ["ord"]).select("animal_id", "obj_id", "frame_id", "x", "y")


@query(
    "interpolate_gaps",
    f"""WITH {TRACK}, e AS (SELECT *, lead(frame_id) OVER w AS f1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM track
        WINDOW w AS (PARTITION BY animal_id, obj_id ORDER BY frame_id)), g AS (SELECT *, unnest(range(frame_id + 1, f1)) AS f FROM e WHERE f1 > frame_id + 1)
        SELECT animal_id, obj_id, f AS frame_id, {R('x + (x1 - x) * ((f - frame_id) / (f1 - frame_id))')} AS x,
        {R('y + (y1 - y) * ((f - frame_id) / (f1 - frame_id))')} AS y FROM g""",
    "runs",
)
def interpolate_gaps(spark, d):
    return rounded(R_.interpolate_gaps(track_of(spark, d), ["animal_id", "obj_id"], chunk=256), "x", "y")


@query(
    "gap_fill_flag",
    f"""WITH {GAPS} SELECT DISTINCT animal_id, frame_id, obj_id, false AS is_gap FROM runs UNION ALL
        SELECT g.animal_id, f, obj_id, true FROM (SELECT animal_id, unnest(range(start, end_exclusive)) AS f FROM gaps) g
        JOIN (SELECT DISTINCT animal_id, obj_id FROM runs) o USING (animal_id)""",
    "runs",
)
def gap_fill_flag(spark, d):
    return W.gap_fill_flag(V.runs(spark, d), ["animal_id"])


CLICKS = "clicks AS (SELECT a.animal_id, o.obj_id, a.animal_id * 10.0::DOUBLE AS x, o.obj_id * 5.0::DOUBLE AS y FROM (SELECT DISTINCT animal_id FROM runs) a CROSS JOIN range(1, 3) o(obj_id))"


@query(
    "carry_forward_seed",
    f"""WITH {TRACK}, {CLICKS}, b AS (SELECT animal_id, unnest(range(min(frame_id) // 100, max(frame_id) // 100 + 1)) AS block FROM track GROUP BY 1),
        k AS (SELECT b.animal_id, obj_id, block, arg_max(x, frame_id) AS x, arg_max(y, frame_id) AS y FROM b JOIN track t
          ON t.animal_id = b.animal_id AND t.frame_id < block * 100 GROUP BY 1, 2, 3)
        SELECT animal_id, obj_id, block, {R('x')} AS x, {R('y')} AS y, 'carried' AS source FROM k UNION ALL
        SELECT b.animal_id, c.obj_id, b.block, {R('c.x')}, {R('c.y')}, 'clicks' FROM b JOIN clicks c USING (animal_id)
        WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.animal_id = b.animal_id AND k.block = b.block)""",
    "runs",
)
def carry_forward_seed(spark, d):
    clicks = (
        V.runs(spark, d).select("animal_id").distinct()
        .withColumn("obj_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
        .withColumns({"x": F.col("animal_id") * 10.0, "y": F.col("obj_id") * 5.0})
    )
    return rounded(W.carry_forward_seed(track_of(spark, d), clicks, 100), "x", "y")


@query(
    "expand_bins",
    """SELECT animal_id, session_type, CAST(b * 3600.0 AS DOUBLE) AS bin_start FROM (SELECT animal_id, session_type,
        unnest(range(0, CAST(ceil(max(end_sec) / 3600) AS BIGINT) + 1)) AS b FROM bouts GROUP BY 1, 2)""",
    "bouts",
)
def expand_bins(spark, d):
    lengths = V.bouts(spark, d).groupBy("animal_id", "session_type").agg(F.max("end_sec").alias("session_sec"))
    return W.expand_bins(lengths, 3600.0).drop("session_sec")


@query(
    "shard_of",
    """SELECT animal_id, frame_id, p // 50 AS shard FROM (SELECT animal_id, frame_id, row_number() OVER (PARTITION BY animal_id ORDER BY frame_id) - 1 AS p
        FROM (SELECT DISTINCT animal_id, frame_id FROM runs))""",
    "runs",
)
def shard_of(spark, d):
    return W.shard_of(V.runs(spark, d), ["animal_id"], per_shard=50).drop("position")


SEGMENTS = """segs AS (SELECT animal_id, run_name AS segment, CASE run_name WHEN 'output' THEN 0 WHEN 'resume' THEN 200 + animal_id * 3
    WHEN 'resume2' THEN 380 + animal_id WHEN 'resume3' THEN 600 - animal_id END AS start_frame FROM (SELECT DISTINCT animal_id, run_name FROM runs))"""


def segments_of(spark, d):
    a, r = F.col("animal_id"), F.col("run_name")
    start = F.when(r == "output", 0).when(r == "resume", 200 + a * 3).when(r == "resume2", 380 + a).when(r == "resume3", 600 - a)
    return V.runs(spark, d).select("animal_id", "run_name").distinct().select("animal_id", r.alias("segment"), start.cast("long").alias("start_frame"))


@query(
    "segment_cut",
    f"""WITH {SEGMENTS}, c AS (SELECT *, lead(start_frame) OVER (PARTITION BY animal_id ORDER BY start_frame) AS stop FROM segs)
        SELECT animal_id, segment, count(*) AS n, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM runs
        JOIN c USING (animal_id) WHERE run_name = segment AND frame_id >= start_frame AND (stop IS NULL OR frame_id < stop) GROUP BY 1, 2""",
    "runs",
)
def segment_cut(spark, d):
    rows = V.runs(spark, d).withColumnRenamed("run_name", "segment")
    return (
        W.segment_cut(rows, segments_of(spark, d), ["animal_id"])
        .groupBy("animal_id", "segment")
        .agg(F.count("*").alias("n"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))
    )


@query(
    "segment_status",
    """WITH s AS (SELECT user_id AS video_id, CASE WHEN event_type = 'click' THEN 0 ELSE event_id END AS start_frame,
          CAST(json_extract_string(props, '$.k') AS INTEGER) = 99 AS merged FROM events),
        n AS (SELECT DISTINCT user_id AS video_id FROM events WHERE event_id % 23 = 0),
        t AS (SELECT video_id, count(*) AS n_segments, min(start_frame) AS first_start, CASE WHEN bool_or(merged) THEN 'merged'
          WHEN count(*) > 1 OR min(start_frame) > 0 THEN 'has_resume' ELSE 'done' END AS status FROM s GROUP BY 1)
        SELECT video_id, n_segments, first_start, status, CASE WHEN n.video_id IS NOT NULL THEN 'annotated' ELSE status END AS display
        FROM t LEFT JOIN n USING (video_id)""",
)
def segment_status(spark, d):
    from etholith.operators.tracking import segment_status as status_of

    events = V.table(spark, d, "events")
    segments = events.select(
        F.col("user_id").alias("video_id"),
        F.when(F.col("event_type") == "click", 0).otherwise(F.col("event_id")).alias("start_frame"),
        (F.get_json_object("props", "$.k").cast("int") == 99).alias("merged"),
    )
    noted = events.filter("event_id % 23 = 0").select(F.col("user_id").alias("video_id"))
    return status_of(segments, noted)
