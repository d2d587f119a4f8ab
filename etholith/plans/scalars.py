"""Queries showing the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions import counts as C
from etholith.functions import geometry as G
from etholith.functions import ids
from etholith.functions import masks as M
from etholith.operators import aggregates as A
from etholith.operators import filters as L
from etholith.operators import rasters
from etholith.operators.ordered import with_group_stats
from etholith.plans.register import R, query, rd
from etholith.session import spread

# The cohorts and training images of the study.
COHORTS = {
    "Coh1": ("count_0", "count_3", "count_8", "count_10", "count_2"),
    "Coh2": ("count_4", "count_5", "count_6", "count_9"),
}
TRAINING_GFP = ("count3_1", "count8_2", "count8_4", "count10_4")
TRAINING_CFOS = ("count3_1", "count3_4", "count8_2", "count10_2")


def _in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "strip_suffix",
    """SELECT c_custkey AS ord, 'count_' || CAST(c_custkey % 50 AS VARCHAR) ||
        CASE WHEN c_custkey % 4 = 2 THEN '_CD1' ELSE '' END AS animal_id FROM customer""",
)
def strip_suffix(spark, d):
    key = F.col("c_custkey")
    suffix = F.when(key % 4 == 1, "_CD1").when(key % 4 == 2, "_CD1_BL6").when(key % 4 == 3, "_BL6").otherwise("")
    raw = F.concat(F.lit("count_"), (key % 50).cast("string"), suffix)
    return V.table(spark, d, "customer").select(key.alias("ord"), ids.strip_suffix(raw).alias("animal_id"))


@query(
    "parse_behaviour",
    """SELECT ord, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'exp' WHEN 2 THEN CASE WHEN cd1 THEN 'exp' END
             WHEN 3 THEN CASE WHEN cd1 THEN 'stim' END ELSE NULL END AS actor,
        CASE k % 5 WHEN 2 THEN CASE WHEN cd1 THEN 'stim' END WHEN 3 THEN 'exp' END AS target, behavior
        FROM (SELECT event_id AS ord, event_type AS behavior, event_id % 2 = 1 AS cd1,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def parse_behaviour(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    head = F.when(k == 0, "").when(k == 1, "exp_").when(k == 2, "BL6_CD1_").when(k == 3, "CD1_exp_").otherwise("fox_")
    session = F.when(F.col("event_id") % 2 == 1, "CD1").otherwise("BL6")
    parsed = ids.parse_behaviour(F.concat(head, F.col("event_type")), session)
    return V.table(spark, d, "events").select(F.col("event_id").alias("ord"), parsed.alias("p")).select("ord", "p.*")


@query("hms_to_sec", f"SELECT ord, {R('start_sec')} AS sec FROM bouts", "bouts")
def hms_to_sec(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    whole = F.floor(us / 1_000_000).cast("long")
    text = F.concat_ws(
        ":",
        F.floor(whole / 3600).cast("string"),
        F.lpad((F.floor(whole / 60) % 60).cast("string"), 2, "0"),
        F.concat(F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")),
    )
    return V.table(spark, d, "events").select(F.col("event_id").alias("ord"), rd(ids.hms_to_sec(text)).alias("sec"))


FILE_IDS = """SELECT ord, name, nullif(lower(regexp_extract(name, '(?i)count[0-9]+_[0-9]+')), '') AS image_id FROM files"""


@query("image_id", FILE_IDS, "files")
def image_id(spark, d):
    return V.files(spark, d).withColumn("image_id", ids.image_id(F.col("name")))


@query(
    "animal_and_section",
    f"""SELECT ord, nullif(regexp_extract(image_id, '^count[0-9]+'), '') AS animal_id,
        CAST(nullif(regexp_extract(image_id, '_([0-9]+)$', 1), '') AS INTEGER) AS section_num,
        CAST(nullif(regexp_extract(image_id, '[0-9]+'), '') AS INTEGER) AS animal_num FROM ({FILE_IDS})""",
    "files",
)
def animal_and_section(spark, d):
    image = ids.image_id(F.col("name"))
    animal = ids.animal_id(image)
    return V.files(spark, d).select(
        "ord", animal.alias("animal_id"), ids.section_num(image).alias("section_num"), ids.animal_num(animal).alias("animal_num")
    )


@query(
    "normalise_animal_id",
    f"""SELECT ord, regexp_replace(nullif(regexp_extract(image_id, '^count[0-9]+'), ''), '^count', 'count_') AS animal_id
        FROM ({FILE_IDS})""",
    "files",
)
def normalise_animal_id(spark, d):
    animal = ids.animal_id(ids.image_id(F.col("name")))
    return V.files(spark, d).select("ord", ids.normalise_animal_id(animal).alias("animal_id"))


@query(
    "base_name",
    """SELECT ord, split_part(split_part(split_part(split_part(name, '_GFPseg', 1), '_cFOSseg', 1), '_LVCC', 1), '.tif', 1) AS base,
        replace(replace(name, '.tif', ''), '_LVCC_RAW_final', '') AS export_name FROM files""",
    "files",
)
def base_name(spark, d):
    return V.files(spark, d).select(
        "ord", ids.base_name(F.col("name")).alias("base"), ids.roi_export_name(F.col("name")).alias("export_name")
    )


@query(
    "segmentation_name",
    """SELECT ord, CASE WHEN c_nationkey % 4 = 0 THEN split_part(name, '_LVCC', 1) || '_' ||
          CASE ord % 3 WHEN 0 THEN 'GFPseg' WHEN 1 THEN 'cFOSseg' ELSE 'seg' END || '.tif'
          ELSE replace(name, '.tif', '') || CASE ord % 3 WHEN 0 THEN '_ch00' WHEN 1 THEN '_ch01' ELSE '' END || '_seg.tif' END AS seg_name
        FROM files JOIN customer ON c_custkey = ord""",
    "files",
)
def segmentation_name(spark, d):
    ch = F.when(F.col("ord") % 3 == 0, "_ch00.tif").when(F.col("ord") % 3 == 1, "_ch01.tif").otherwise(".tif")
    name = F.concat(F.regexp_replace("name", r"\.tif$", ""), ch)
    return V.files(spark, d).select("ord", ids.segmentation_name(name).alias("seg_name"))


@query(
    "marker_class",
    """SELECT CASE l_linenumber WHEN 1 THEN 'GFP' WHEN 2 THEN 'GFP' WHEN 3 THEN 'cFOS' WHEN 4 THEN 'cFOS'
          WHEN 5 THEN 'both' WHEN 6 THEN 'both' END AS cls, l_suppkey AS image_id, count(*) AS n
        FROM lineitem WHERE l_linenumber < 7 GROUP BY 1, 2""",
)
def marker_class(spark, d):
    names = F.array(*[F.lit(n) for n in ("GFP+", "Type 1", "cFos", "TYPE 2", "Both", "type 3", "other")])
    name = F.element_at(names, F.col("l_linenumber"))
    return (
        V.table(spark, d, "lineitem")
        .select(ids.marker_class(name).alias("cls"), F.col("l_suppkey").alias("image_id"))
        .filter("cls IS NOT NULL")
        .groupBy("cls", "image_id")
        .agg(F.count("*").alias("n"))
    )


@query(
    "classifier_params",
    """SELECT ord, CASE c_nationkey % 4 WHEN 1 THEN 40.0::DOUBLE WHEN 2 THEN 15.0::DOUBLE END AS min_area
       FROM files JOIN customer ON c_custkey = ord""",
    "files",
)
def classifier_params(spark, d):
    return V.files(spark, d).select("ord", ids.classifier_params(F.col("name")).cast("double").alias("min_area"))


@query(
    "run_priority",
    """SELECT run_name, CASE run_name WHEN 'output' THEN 0 WHEN 'resume' THEN 1 WHEN 'resume2' THEN 2 WHEN 'resume3' THEN 3 END
       AS priority, count(*) AS n FROM runs GROUP BY ALL""",
    "runs",
)
def run_priority(spark, d):
    return (
        V.runs(spark, d)
        .groupBy("run_name", ids.run_priority(F.col("run_name")).alias("priority"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "frame_key",
    """SELECT c_custkey AS ord, c_custkey * 37 AS frame_id, CAST(1 + c_custkey % 3 AS INTEGER) AS obj_id,
        CASE WHEN c_custkey % 2 = 0 THEN 'packed' ELSE 'shape' END AS part FROM customer WHERE c_custkey % 5 <> 4
        UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 4""",
)
def frame_key(spark, d):
    k = F.col("c_custkey")
    key = F.concat(
        F.format_string("frame%07d", k * 37), F.lit("_obj"), (1 + k % 3).cast("string"),
        F.lit("_mask_"), F.when(k % 5 == 4, "gap").when(k % 2 == 0, "packed").otherwise("shape"),
    )
    return V.table(spark, d, "customer").select(k.alias("ord"), ids.frame_key(key).alias("f")).select("ord", "f.*")


@query(
    "natural_sort_key",
    r"""SELECT ord, array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'),
        lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(t, 20, '0') ELSE lower(t) END), '') AS sort_key FROM files""",
    "files",
)
def natural_sort_key(spark, d):
    return V.files(spark, d).select("ord", ids.natural_sort_key(F.col("name")).alias("sort_key"))


@query(
    "title_joint",
    """SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'Right_Fhip' WHEN 1 THEN 'Nose' ELSE 'Tail_Tip' END
        || '_' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS joint FROM customer""",
)
def title_joint(spark, d):
    k = F.col("c_custkey")
    raw = F.concat(
        F.when(k % 3 == 0, "right_fhip").when(k % 3 == 1, "nose").otherwise("tail_tip"), F.lit("_"), F.lower("c_mktsegment")
    )
    return V.table(spark, d, "customer").select(k.alias("ord"), ids.title_joint(raw).alias("joint"))


@query(
    "map_object_to_subject",
    """SELECT subject AS original, CASE joint % 3 WHEN 0 THEN 'stim' WHEN 1 THEN 'exp' ELSE subject END AS subject_corrected,
        count(*) AS n FROM kpts GROUP BY ALL""",
    "kpts",
)
def map_object_to_subject(spark, d):
    obj = F.when(F.col("joint") % 3 == 0, "obj1").when(F.col("joint") % 3 == 1, "obj2")
    return (
        V.keypoints(spark, d)
        .groupBy(F.col("subject").alias("original"), ids.object_to_subject(obj, F.col("subject")).alias("subject_corrected"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "cohort_of",
    f"""SELECT animal_id, CASE WHEN a IN {_in_list(COHORTS['Coh1'])} THEN 'Coh1' WHEN a IN {_in_list(COHORTS['Coh2'])} THEN 'Coh2' END
        AS cohort, CASE WHEN a IN {_in_list(COHORTS['Coh1'])} THEN 'Coh1' WHEN a IN {_in_list(COHORTS['Coh2'])} THEN 'Coh2'
        ELSE 'UNKNOWN' END AS expected_cohort, n FROM (SELECT animal_id, 'count_' || CAST(animal_id AS VARCHAR) AS a,
        count(*) AS n FROM bouts GROUP BY ALL)""",
    "bouts",
)
def cohort_of(spark, d):
    name = F.concat(F.lit("count_"), F.col("animal_id").cast("string"))
    return (
        V.bouts(spark, d)
        .groupBy("animal_id")
        .agg(F.count("*").alias("n"))
        .withColumns({"cohort": ids.cohort_of(name, COHORTS), "expected_cohort": ids.cohort_of(name, COHORTS, "UNKNOWN")})
    )


@query(
    "training_flags",
    f"""SELECT image_id, img IN {_in_list(TRAINING_GFP)} AS is_training_gfp, img IN {_in_list(TRAINING_CFOS)} AS is_training_cfos,
        img IN {_in_list(TRAINING_GFP + TRAINING_CFOS)} AS is_training_either
        FROM (SELECT image_id, 'count' || CAST(animal_id % 11 AS VARCHAR) || '_' || CAST(image_id % 5 AS VARCHAR) AS img FROM counts)""",
    "counts",
)
def training_flags(spark, d):
    img = F.concat(F.lit("count"), (F.col("animal_id") % 11).cast("string"), F.lit("_"), (F.col("image_id") % 5).cast("string"))
    gfp, cfos = img.isin(*TRAINING_GFP), img.isin(*TRAINING_CFOS)
    return V.counts(spark, d).select(
        "image_id", gfp.alias("is_training_gfp"), cfos.alias("is_training_cfos"), (gfp | cfos).alias("is_training_either")
    )


TRIPLE = """SELECT *, a_only + both_n AS a_total, b_only + both_n AS b_total, a_only + b_only + both_n AS n_cells FROM counts"""
CHANCE = "(a_total / nullif(n_cells, 0)) * (b_total / nullif(n_cells, 0)) * n_cells"
INDEX = f"(both_n - {CHANCE}) / nullif(least(a_total, b_total) - {CHANCE}, 0)"


def _triple():
    return F.col("a_only"), F.col("b_only"), F.col("both_n")


@query(
    "count_totals",
    f"""SELECT image_id, a_total, b_total, n_cells, {R(CHANCE)} AS chance_overlap,
        {R('100 * both_n / nullif(a_total, 0)')} AS overlap_pct_a, {R('100 * both_n / nullif(b_total, 0)')} AS overlap_pct_b,
        {R('100 * both_n / nullif(n_cells, 0)')} AS coloc_pct FROM ({TRIPLE})""",
    "counts",
)
def count_totals(spark, d):
    derived = C.derived_counts(*_triple())
    rounded = {k: (v if k in ("a_total", "b_total", "n_cells") else rd(v)) for k, v in derived.items() if k != "overlap_index"}
    return V.counts(spark, d).select("image_id", *[v.alias(k) for k, v in rounded.items()])


@query(
    "overlap_index",
    f"""SELECT animal_id, count(*) AS n_images, count(idx) AS n_index, {R('avg(idx)')} AS mean_index, {R('max(idx)')} AS max_index
        FROM (SELECT animal_id, CASE WHEN abs(least(a_total, b_total) - {CHANCE}) > 1e-9 THEN {INDEX} END AS idx FROM ({TRIPLE}))
        GROUP BY animal_id""",
    "counts",
)
def overlap_index(spark, d):
    t = C.count_totals(*_triple())
    chance = C.chance_overlap(t["a_total"], t["b_total"], t["n_cells"])
    idx = C.overlap_index(F.col("both_n"), chance, t["a_total"], t["b_total"])
    return (
        V.counts(spark, d)
        .withColumn("idx", idx)
        .groupBy("animal_id")
        .agg(
            F.count("*").alias("n_images"),
            F.count("idx").alias("n_index"),
            rd(F.avg("idx")).alias("mean_index"),
            rd(F.max("idx")).alias("max_index"),
        )
    )


@query(
    "density_mm2",
    f"""SELECT image_id, {R('a_total / (ref_total / 1e6)')} AS a_density, {R('b_total / (ref_total / 1e6)')} AS b_density,
        {R('both_n / (ref_total / 1e6)')} AS both_density FROM ({TRIPLE})""",
    "counts",
)
def density_mm2(spark, d):
    t = C.count_totals(*_triple())
    area = F.col("ref_total")
    return V.counts(spark, d).select(
        "image_id",
        rd(C.density_mm2(t["a_total"], area)).alias("a_density"),
        rd(C.density_mm2(t["b_total"], area)).alias("b_density"),
        rd(C.density_mm2(F.col("both_n"), area)).alias("both_density"),
    )


@query(
    "deltas_direction",
    f"""SELECT image_id, {R('auto_total - manual_total', 3)} AS delta,
        CASE WHEN both_n - c > 1e-9 THEN 'above' WHEN both_n - c < -1e-9 THEN 'below' WHEN c IS NOT NULL THEN 'equal' END AS direction
        FROM (SELECT *, {CHANCE} AS c FROM ({TRIPLE}))""",
    "counts",
)
def deltas_direction(spark, d):
    t = C.count_totals(*_triple())
    gap = F.col("both_n") - C.chance_overlap(t["a_total"], t["b_total"], t["n_cells"])
    return V.counts(spark, d).select(
        "image_id",
        rd(F.col("auto_total") - F.col("manual_total"), 3).alias("delta"),
        C.direction(F.when(F.abs(gap) > 1e-9, gap).otherwise(gap * 0)).alias("direction"),
    )


@query(
    "time_budget_pct",
    f"""WITH len AS (SELECT session_type, max(end_sec) AS s FROM bouts GROUP BY 1)
        SELECT animal_id, b.session_type, behavior, {R('100 * sum(duration_sec) / any_value(s)')} AS pct_time
        FROM bouts b JOIN len USING (session_type) GROUP BY 1, 2, 3""",
    "bouts",
)
def time_budget_pct(spark, d):
    bouts = V.bouts(spark, d)
    totals = bouts.groupBy("animal_id", "session_type", "behavior").agg(F.sum("duration_sec").alias("total_duration_sec"))
    return A.time_budget(totals, A.session_length(bouts)).select(
        "animal_id", "session_type", "behavior", rd("pct_time").alias("pct_time")
    )


@query(
    "sig_stars",
    """SELECT image_id, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS style_a,
        CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE '' END AS style_b
        FROM (SELECT image_id, CASE WHEN image_id % 97 <> 0 THEN (image_id % 2000) / 10000.0::DOUBLE END AS p FROM counts)""",
    "counts",
)
def sig_stars(spark, d):
    p = F.when(F.col("image_id") % 97 != 0, (F.col("image_id") % 2000) / F.lit(10000.0))
    return V.counts(spark, d).select("image_id", C.sig_stars(p, "A").alias("style_a"), C.sig_stars(p, "B").alias("style_b"))


@query(
    "bone_length",
    f"""SELECT video_id, subject, joint, count(dist) AS n, {R('sum(dist)')} AS total, {R('max(dist)')} AS longest
        FROM (SELECT *, sqrt((x - 256) * (x - 256) + (y - 256) * (y - 256)) AS dist FROM kpts) GROUP BY 1, 2, 3""",
    "kpts",
)
def bone_length(spark, d):
    dist = G.distance(F.col("x"), F.col("y"), F.lit(256.0), F.lit(256.0))
    return (
        V.keypoints(spark, d)
        .withColumn("dist", dist)
        .groupBy("video_id", "subject", "joint")
        .agg(F.count("dist").alias("n"), rd(F.sum("dist")).alias("total"), rd(F.max("dist")).alias("longest"))
    )


@query(
    "rotate_points",
    f"""SELECT image_id, count(*) AS n, {R('min(rx)')} AS min_x, {R('max(rx)')} AS max_x, {R('min(ry)')} AS min_y,
        {R('max(ry)')} AS max_y, {R('sum(rx * ry)', 2)} AS sum_xy FROM (
        SELECT p.image_id, cx + (x - cx) * cos(radians(a)) - (y - cy) * sin(radians(a)) AS rx,
               cy + (x - cx) * sin(radians(a)) + (y - cy) * cos(radians(a)) AS ry
        FROM points p JOIN (SELECT image_id, avg(x) AS cx, avg(y) AS cy, image_id % 360 AS a FROM points GROUP BY image_id) m
        USING (image_id)) GROUP BY image_id""",
    "points",
)
def rotate_points(spark, d):
    centred = with_group_stats(V.points(spark, d), ["image_id"], cx=F.avg("x"), cy=F.avg("y"))
    rx, ry = G.rotate(F.col("x"), F.col("y"), (F.col("image_id") % 360).cast("double"), F.col("cx"), F.col("cy"))
    return (
        centred.withColumns({"rx": rx, "ry": ry})
        .groupBy("image_id")
        .agg(
            F.count("*").alias("n"), rd(F.min("rx")).alias("min_x"), rd(F.max("rx")).alias("max_x"),
            rd(F.min("ry")).alias("min_y"), rd(F.max("ry")).alias("max_y"), rd(F.sum(F.col("rx") * F.col("ry")), 2).alias("sum_xy"),
        )
    )


@query(
    "mirror_x",
    f"""SELECT image_id, marker, {R('sum(mx)')} AS sum_x, {R('max(mx)')} AS max_x FROM (
        SELECT image_id, marker, CASE WHEN s_nationkey % 2 = 1 THEN 2 * mean_x - x ELSE x END AS mx
        FROM points JOIN (SELECT image_id, avg(x) AS mean_x FROM points GROUP BY 1) USING (image_id)
        LEFT JOIN supplier ON s_suppkey = image_id) GROUP BY 1, 2""",
    "points",
)
def mirror_x(spark, d):
    side = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_nationkey") % 2).alias("base_side"))
    centred = with_group_stats(V.points(spark, d), ["image_id"], mean_x=F.avg("x")).join(side, "image_id", "left")
    return (
        centred.withColumn("mx", G.mirror_x(F.col("x").cast("double"), F.col("mean_x"), F.col("base_side")))
        .groupBy("image_id", "marker")
        .agg(rd(F.sum("mx")).alias("sum_x"), rd(F.max("mx")).alias("max_x"))
    )


# An irregular quadrilateral at every point; its sides follow the point's area.
def _quad():
    x, y, a = F.col("x").cast("double"), F.col("y").cast("double"), F.col("area")
    corner = lambda u, v: F.array(u, v)
    return F.array(corner(x, y), corner(x + a, y + 1), corner(x + a + 2, y + a), corner(x - 1, y + 2 * a))


QUAD = """SELECT *, x + area AS x2, y + 1 AS y2, x + area + 2 AS x3, y + area AS y3, x - 1 AS x4, y + 2 * area AS y4 FROM points"""
CROSS = [("x", "y", "x2", "y2"), ("x2", "y2", "x3", "y3"), ("x3", "y3", "x4", "y4"), ("x4", "y4", "x", "y")]
TWICE = " + ".join(f"({a} * {e} - {c} * {b})" for a, b, c, e in CROSS)
SUM_X = " + ".join(f"({a} + {c}) * ({a} * {e} - {c} * {b})" for a, b, c, e in CROSS)
SUM_Y = " + ".join(f"({b} + {e}) * ({a} * {e} - {c} * {b})" for a, b, c, e in CROSS)


@query(
    "polygon_area",
    f"""SELECT image_id, {R('sum(s)', 4)} AS area_um2, {R('max(s)', 4)} AS largest FROM (SELECT image_id, abs({TWICE}) / 2 * 0.25 AS s
        FROM ({QUAD})) GROUP BY 1""",
    "points",
)
def polygon_area(spark, d):
    return (
        spread(V.points(spark, d))
        .withColumn("rings", F.array(_quad()))
        .withColumn("s", G.polygon_area(F.col("rings"), 0.5))
        .groupBy("image_id")
        .agg(rd(F.sum("s"), 4).alias("area_um2"), rd(F.max("s"), 4).alias("largest"))
    )


@query(
    "unpack_centroid",
    f"""SELECT image_id, {R('sum(cx)', 4)} AS sum_cx, {R('sum(cy)', 4)} AS sum_cy, {R('max(cx - x)', 5)} AS max_dx FROM (
        SELECT image_id, x, ({SUM_X}) / (3 * ({TWICE})) AS cx, ({SUM_Y}) / (3 * ({TWICE})) AS cy FROM ({QUAD})) GROUP BY 1""",
    "points",
)
def unpack_centroid(spark, d):
    return (
        spread(V.points(spark, d))
        .withColumn("ring", _quad())
        .withColumn("c", G.ring_centroid(F.col("ring")))
        .groupBy("image_id")
        .agg(
            rd(F.sum("c.x"), 4).alias("sum_cx"), rd(F.sum("c.y"), 4).alias("sum_cy"),
            rd(F.max(F.col("c.x") - F.col("x")), 5).alias("max_dx"),
        )
    )


@query(
    "mask_bit",
    """SELECT vec_id, px, py, CASE WHEN px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7 THEN embedding[py * 8 + px + 1] > 0 END AS is_set
        FROM (SELECT vec_id, embedding, unnest(range(-1, 9)) AS px FROM embeddings), range(-1, 9) t(py)""",
)
def mask_bit(spark, d):
    axis = F.sequence(F.lit(-1).cast("long"), F.lit(8).cast("long"))
    probes = (
        V.masks(spark, d).select("vec_id", V.packed(F.col("words")).alias("packed"))
        .withColumn("px", F.explode(axis)).withColumn("py", F.explode(axis))
    )
    return probes.select("vec_id", "px", "py", M.mask_bit(F.col("packed"), 8, 8, F.col("px"), F.col("py")).alias("is_set"))


@query(
    "rescale_invert",
    """SELECT z, array_to_string(list_transform(pixels, lambda v: CAST(255 - floor((v - lo) * 255 / (hi - lo) + 0.5) AS INTEGER)), ',') AS pixels
        FROM (SELECT *, list_min(pixels) AS lo, list_max(pixels) AS hi FROM tiles)""",
    "tiles",
)
def rescale_invert(spark, d):
    return V.tiles(spark, d).select("z", F.array_join(M.rescale_invert(F.col("pixels")), ",").alias("pixels"))


@query(
    "threshold",
    """SELECT z, array_to_string(list_transform(pixels, lambda v: CASE WHEN v > 130.0 THEN 1 ELSE 0 END), ',') AS class_map,
        CAST(list_sum(list_transform(pixels, lambda v: CASE WHEN v > 254.0 THEN 1 ELSE 0 END)) AS BIGINT) AS n_default FROM tiles""",
    "tiles",
)
def threshold(spark, d):
    on = M.threshold(F.col("pixels"))
    return V.tiles(spark, d).select(
        "z",
        F.array_join(M.threshold(F.col("pixels"), 130.0), ",").alias("class_map"),
        F.aggregate(on, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_default"),
    )


FRAMES_SQL = "(SELECT max(l_orderkey) + 1 FROM lineitem)"
SPECS = f"""SELECT n_nationkey AS spec_id, n_nationkey % 4 AS video_id, s * 1000 + n_nationkey * 300 AS start,
        least(s * 1000 + n_nationkey * 300 + 150, {FRAMES_SQL}) AS end_exclusive
        FROM nation, range(2) t(s) WHERE n_nationkey % 6 <> 5
        UNION ALL SELECT n_nationkey, n_nationkey % 4, 0, {FRAMES_SQL} FROM nation WHERE n_nationkey % 6 = 5"""


def segment_specs(spark, d):
    """A range text per nation, unfolded; every sixth has none and means the whole video."""
    k = F.col("n_nationkey").cast("long")
    frames = V.table(spark, d, "lineitem").agg((F.max("l_orderkey") + 1).alias("n"))

    def part(s: int):
        return F.concat((s * 1000 + k * 300).cast("string"), F.lit("-"), (s * 1000 + k * 300 + 150).cast("string"))

    spec = F.when(k % 6 != 5, F.concat_ws(",", part(0), part(1)))
    return (
        V.table(spark, d, "nation").withColumn("_frames", frames.scalar())
        .select(k.alias("spec_id"), (k % 4).alias("video_id"), F.inline(ids.segment_ranges(spec, F.col("_frames"))))
    )


@query("segment_ranges", SPECS)
def segment_ranges(spark, d):
    return segment_specs(spark, d)


@query(
    "frame_segments",
    f"""SELECT video_id, joint, count(*) AS n, count(DISTINCT frame_id) AS n_frames FROM kpts k
        WHERE EXISTS (SELECT 1 FROM ({SPECS}) s WHERE s.video_id = k.video_id AND k.frame_id >= s.start
        AND k.frame_id < s.end_exclusive) GROUP BY 1, 2""",
    "kpts",
)
def frame_segments(spark, d):
    return (
        L.frame_segments(V.keypoints(spark, d), segment_specs(spark, d))
        .groupBy("video_id", "joint")
        .agg(F.count("*").alias("n"), F.countDistinct("frame_id").alias("n_frames"))
    )


PATCH = """SELECT *, (z * 7) % 11 - 1.25 AS x, (z * 5) % 9 + 0.5 AS y FROM tiles"""


@query(
    "patch_brightness",
    f"""WITH p AS (SELECT *, CAST(round_even(x, 0) AS BIGINT) AS cx, CAST(round_even(y, 0) AS BIGINT) AS cy FROM ({PATCH}))
        SELECT z, {R('list_avg(list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN cx - 2 AND cx + 2 AND i // 8 BETWEEN cy - 2 AND cy + 2), lambda i: pixels[i + 1]))')}
        AS brightness FROM p""",
    "tiles",
)
def patch_brightness(spark, d):
    z = F.col("z")
    rows = V.tiles(spark, d).withColumns({"x": (z * 7) % 11 - F.lit(1.25), "y": (z * 5) % 9 + F.lit(0.5)})
    return rasters.patch_brightness(rows, 8, 8, 2).select("z", rd("brightness").alias("brightness"))
