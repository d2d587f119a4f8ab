"""Queries that write files to the shared folder, read them with the library's readers, and summarise."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from etholith import views as V
from etholith.plans.register import R, query, rd
from etholith.session import shared_dir
from etholith.sources import files
from etholith.sources.keypoints import read_keypoints_wide, write_keypoints_videos, write_keypoints_wide


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _clock(us: Column) -> Column:
    """``hh:mm:ss.ffffff`` of microseconds."""
    whole = F.floor(us / 1_000_000).cast("long")
    return F.concat_ws(
        ":",
        F.floor(whole / 3600).cast("string"),
        F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"),
        F.concat(F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")),
    )


@query(
    "read_bouts",
    f"""SELECT 'count_' || CAST(animal_id AS VARCHAR) AS animal_id, actor, split_part(behavior, '_', 1) AS behavior, count(*) AS n,
        {R('sum(start_sec)', 3)} AS start_sec, {R('sum(duration_sec)', 4)} AS duration_sec FROM bouts GROUP BY 1, 2, 3""",
    "bouts",
)
def read_bouts(spark, d):
    """Two sets of CSV files with columns in different order and a suffix on the animals, read as one session."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    actor = F.when(k % 3 == 0, "exp_").when(k % 3 == 1, "stim_").otherwise("")
    rows = V.table(spark, d, "events").select(
        F.concat(F.lit("count_"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "_BL6").otherwise("_CD1")).alias("Animal"),
        _clock(us).alias("Start"), _clock(us + F.round(F.col("value") * 1e6).cast("long")).alias("End"),
        F.concat(actor, "event_type").alias("Behavior"), F.col("value").alias("duration"), "event_id",
    )
    folder = _folder(spark, "bouts")
    rows.filter("event_id % 2 = 0").drop("event_id").write.option("header", True).mode("append").csv(folder)
    other = rows.filter("event_id % 2 = 1").select("Behavior", F.col("duration").alias("duration_s"), "End", "Start", F.col("Animal").alias("ANIMAL"))
    other.write.option("header", True).mode("append").csv(folder)
    return files.read_bouts(spark, folder, "S1").groupBy("animal_id", "actor", "behavior").agg(
        F.count("*").alias("n"), rd(F.sum("start_sec"), 3).alias("start_sec"), rd(F.sum("duration_sec"), 4).alias("duration_sec")
    )


@query(
    "read_keypoints",
    f"""WITH dd AS (SELECT * FROM kpts QUALIFY row_number() OVER (PARTITION BY frame_id, subject, joint
          ORDER BY CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END, l_partkey, l_suppkey, l_extendedprice) = 1),
        al AS (SELECT f.frame_id, s.subject, j.joint FROM (SELECT DISTINCT frame_id FROM dd) f, (SELECT DISTINCT subject FROM dd) s, range(1, 8) j(joint))
        SELECT subject, 'Joint_' || CAST(joint AS VARCHAR) AS joint, count(*) AS n, count(x) AS n_x, {R('sum(x)')} AS x, {R('sum(y)')} AS y, {R('sum(likelihood)')} AS likelihood
        FROM al LEFT JOIN dd USING (frame_id, subject, joint) GROUP BY 1, 2""",
    "kpts",
)
def read_keypoints(spark, d):
    """All frames as one wide table with four header rows, in as many parts as the writer makes, read back long."""
    points = V.keypoints(spark, d).withColumn("joint", F.concat(F.lit("joint_"), F.col("joint").cast("string")))
    folder = _folder(spark, "keypoints")
    write_keypoints_wide(points, folder, "view", ("s1", "s2"), [f"joint_{j}" for j in range(1, 8)], order=["l_partkey", "l_suppkey", "l_extendedprice"])
    return read_keypoints_wide(spark, folder).groupBy("subject", "joint").agg(
        F.count("*").alias("n"), F.count("x").alias("n_x"), *[rd(F.sum(c)).alias(c) for c in ("x", "y", "likelihood")]
    )


@query(
    "read_keypoints_videos",
    f"""WITH dd AS (SELECT * FROM kpts QUALIFY row_number() OVER (PARTITION BY video_id, frame_id, subject, joint
          ORDER BY CASE WHEN x IS NULL OR y IS NULL THEN 1 ELSE 0 END, l_partkey, l_suppkey, l_extendedprice) = 1),
        al AS (SELECT f.video_id, f.frame_id, s.subject, j.joint FROM (SELECT DISTINCT video_id, frame_id FROM dd) f, (SELECT DISTINCT subject FROM dd) s, range(1, 8) j(joint))
        SELECT video_id, subject, 'Joint_' || CAST(joint AS VARCHAR) AS joint, count(*) AS n, count(x) AS n_x, {R('sum(x)')} AS x, {R('sum(y)')} AS y, {R('sum(likelihood)')} AS likelihood
        FROM al LEFT JOIN dd USING (video_id, frame_id, subject, joint) GROUP BY 1, 2, 3""",
    "kpts",
)
def read_keypoints_videos(spark, d):
    """As ``read_keypoints``, every video in a folder of its own: one write and one read for all of them."""
    points = V.keypoints(spark, d).withColumn("joint", F.concat(F.lit("joint_"), F.col("joint").cast("string")))
    folder = _folder(spark, "keypoints")
    write_keypoints_videos(points, folder, "view", ("s1", "s2"), [f"joint_{j}" for j in range(1, 8)], order=["l_partkey", "l_suppkey", "l_extendedprice"])
    out = read_keypoints_wide(spark, folder, with_path=True).withColumn("video_id", F.element_at(F.split("path", "/"), -2).cast("long"))
    return out.groupBy("video_id", "subject", "joint").agg(
        F.count("*").alias("n"), F.count("x").alias("n_x"), *[rd(F.sum(c)).alias(c) for c in ("x", "y", "likelihood")]
    )


@query(
    "read_auto_counts",
    f"""SELECT lower('Count' || CAST(animal_id % 50 AS VARCHAR) || '_' || CAST(image_id AS VARCHAR)) AS image_id, cohort, {R('a_only')} AS auto_a_only,
        {R('b_only')} AS auto_b_only, {R('both_n')} AS auto_both FROM counts""",
    "counts",
)
def read_auto_counts(spark, d):
    name = F.concat(F.lit("Count"), (F.col("animal_id") % 50).cast("string"), F.lit("_"), F.col("image_id").cast("string"), F.lit("_GFPseg.tif"))
    rows = V.counts(spark, d).select(name.alias("Image"), F.col("a_only").alias("GFP_only"), F.col("b_only").alias("cFOS_only"), F.col("both_n").alias("Double_positive"), "cohort")
    out = None
    for cohort in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        folder = _folder(spark, "auto")
        rows.filter(F.col("cohort") == cohort).drop("cohort").write.option("header", True).csv(folder)
        part = files.read_auto_counts(spark, folder, cohort)
        out = part if out is None else out.unionByName(part)
    return out.withColumns({c: rd(c) for c in ("auto_a_only", "auto_b_only", "auto_both")})
