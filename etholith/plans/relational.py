"""Queries for filters, joins, aggregations, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions import counts as C
from etholith.functions import ids
from etholith.operators import aggregates as A
from etholith.operators import filters as L
from etholith.operators import joins as J
from etholith.operators import windows as W
from etholith.plans.register import R, query, rd, rounded
from etholith.plans.scalars import FILE_IDS, TRIPLE

SESSIONS = ("S1", "S2")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BEHAVIORS = tuple(f"{e}_{i}" for e in EVENT_TYPES for i in range(4))
DIRECTIONAL = tuple(f"{e}_{i}" for e in ("click", "view") for i in range(4))
SOCIAL = tuple(f"{e}_0" for e in EVENT_TYPES)


def in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def rows_sql(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {name})"


# ---------------------------------------------------------------- filters


@query(
    "min_duration",
    f"""SELECT behavior, count(*) FILTER (duration_sec >= 0.5) AS n_kept, count(*) AS n_total,
        {R('sum(duration_sec) FILTER (duration_sec >= 0.5)')} AS kept_sec FROM bouts GROUP BY behavior""",
    "bouts",
)
def min_duration(spark, d):
    bouts = V.bouts(spark, d)
    kept = L.min_duration(bouts).groupBy("behavior").agg(rd(F.sum("duration_sec")).alias("kept_sec"))
    return L.min_duration_report(bouts, by=["behavior"]).join(kept, "behavior", "left")


@query(
    "drop_null_keys",
    f"""SELECT regexp_extract(name, '(_LVCC|_GFPseg|_cFOSseg)') AS source, count(*) FILTER (image_id IS NULL) AS n_dropped,
        count(image_id) AS n_kept FROM ({FILE_IDS}) GROUP BY 1""",
    "files",
)
def drop_null_keys(spark, d):
    named = V.files(spark, d).select(
        F.regexp_extract("name", "(_LVCC|_GFPseg|_cFOSseg)", 0).alias("source"), ids.image_id(F.col("name")).alias("image_id")
    )
    return L.null_key_report(named, "image_id", "source")


RATIOS = f"""SELECT *, 100 * both_n / nullif(a_total, 0) AS pct_a, 100 * both_n / nullif(b_total, 0) AS pct_b FROM ({TRIPLE})"""


def _ratios(spark, d, ieee=False):
    t = C.count_totals(F.col("a_only"), F.col("b_only"), F.col("both_n"))
    pct = {f"pct_{s}": 100 * C.ratio(F.col("both_n"), t[f"{s}_total"], ieee) for s in "ab"}
    return V.counts(spark, d).withColumns(pct)


@query(
    "complete_cases",
    f"""SELECT cohort, count(*) AS n, {R('avg(pct_a)')} AS mean_a, {R('avg(pct_b)')} AS mean_b FROM ({RATIOS})
        WHERE pct_a IS NOT NULL AND pct_b IS NOT NULL GROUP BY cohort""",
    "counts",
)
def complete_cases(spark, d):
    return (
        L.complete_cases(_ratios(spark, d), ["pct_a", "pct_b"])
        .groupBy("cohort")
        .agg(F.count("*").alias("n"), rd(F.avg("pct_a")).alias("mean_a"), rd(F.avg("pct_b")).alias("mean_b"))
    )


@query(
    "check_finite",
    f"""SELECT * FROM (SELECT 'pct_a' AS column_name, count(*) FILTER (a_total = 0) AS n_nonfinite FROM ({TRIPLE})
        UNION ALL SELECT 'pct_b', count(*) FILTER (b_total = 0) FROM ({TRIPLE})
        UNION ALL SELECT 'ref_total', 0) WHERE n_nonfinite > 0""",
    "counts",
)
def check_finite(spark, d):
    return L.check_finite(_ratios(spark, d, ieee=True), ["pct_a", "pct_b", "ref_total"])


@query(
    "finite_only",
    f"""SELECT animal_id, count(*) AS n, {R('max(pct_a)')} AS max_a FROM ({RATIOS}) WHERE pct_a IS NOT NULL GROUP BY 1""",
    "counts",
)
def finite_only(spark, d):
    return (
        L.finite_only(_ratios(spark, d, ieee=True), ["pct_a"])
        .groupBy("animal_id")
        .agg(F.count("*").alias("n"), rd(F.max("pct_a")).alias("max_a"))
    )


@query(
    "cutoff_frames",
    """SELECT animal_id, run_name, frame_id // 100 AS shard, min(frame_id) AS first_frame, max(frame_id) AS last_frame,
        CASE WHEN max(frame_id) <= 340 THEN 'unchanged' WHEN min(frame_id) > 340 THEN 'dropped' ELSE 'trimmed' END AS disposition,
        count(DISTINCT frame_id) FILTER (frame_id <= 340) AS n_kept FROM runs GROUP BY 1, 2, 3""",
    "runs",
)
def cutoff_frames(spark, d):
    runs = V.runs(spark, d).withColumn("shard", F.floor(F.col("frame_id") / 100).cast("long"))
    return L.cutoff_disposition(runs, ["animal_id", "run_name", "shard"], 340)


@query(
    "likelihood_gate",
    f"""SELECT video_id, subject, joint, count(x) AS n_known, count(x) FILTER (likelihood >= 0.8) AS n_open,
        {R('sum(x) FILTER (likelihood >= 0.8)')} AS sum_x FROM kpts GROUP BY 1, 2, 3""",
    "kpts",
)
def likelihood_gate(spark, d):
    before = V.keypoints(spark, d).withColumn("x0", F.col("x"))
    return (
        L.likelihood_gate(before, 0.8)
        .groupBy("video_id", "subject", "joint")
        .agg(F.count("x0").alias("n_known"), F.count("x").alias("n_open"), rd(F.sum("x")).alias("sum_x"))
    )


@query(
    "protect_joints",
    "SELECT video_id, joint, joint IN (1, 4) AS is_protected, count(*) AS n FROM kpts GROUP BY 1, 2, 3",
    "kpts",
)
def protect_joints(spark, d):
    return (
        V.keypoints(spark, d)
        .groupBy("video_id", "joint", L.is_protected(F.col("joint"), (1, 4)).alias("is_protected"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "min_area",
    """SELECT image_id, marker, count(*) AS n, min(area) AS smallest FROM points
        WHERE area >= CASE marker WHEN 'cFOS' THEN 15 WHEN 'GFP' THEN 40 ELSE 0 END GROUP BY 1, 2""",
    "points",
)
def min_area(spark, d):
    kept = L.min_area(V.points(spark, d), {"cFOS": 15.0, "GFP": 40.0})
    return kept.groupBy("image_id", "marker").agg(F.count("*").alias("n"), F.min("area").alias("smallest"))


@query(
    "views_by_actor",
    f"""SELECT 'total' AS view, session_type, count(*) AS n, {R('sum(duration_sec)')} AS sec FROM bouts GROUP BY 2
        UNION ALL SELECT actor, session_type, count(*), {R('sum(duration_sec)')} FROM bouts WHERE actor IS NOT NULL GROUP BY 1, 2""",
    "bouts",
)
def views_by_actor(spark, d):
    bouts = V.bouts(spark, d)
    parts = [L.view_rows(bouts, v).select(F.lit(v).alias("view"), "session_type", "duration_sec") for v in ("total", "exp", "stim")]
    return (
        parts[0].unionByName(parts[1]).unionByName(parts[2])
        .groupBy("view", "session_type")
        .agg(F.count("*").alias("n"), rd(F.sum("duration_sec")).alias("sec"))
    )


@query("behaviors_with_actor", "SELECT DISTINCT behavior FROM bouts WHERE actor IS NOT NULL", "bouts")
def behaviors_with_actor(spark, d):
    return L.behaviors_with_actor(V.bouts(spark, d))


@query(
    "tukey_fence",
    f"""SELECT cohort, {R('q1', 4)} AS q1, {R('q3', 4)} AS q3, {R('CASE WHEN clips THEN lower END', 4)} AS lower,
        {R('CASE WHEN clips THEN upper END', 4)} AS upper FROM (
        SELECT *, greatest(low, q1 - 1.5 * (q3 - q1)) AS lower, least(high, q3 + 1.5 * (q3 - q1)) AS upper,
          q3 <> q1 AND (q1 - 1.5 * (q3 - q1) > low OR q3 + 1.5 * (q3 - q1) < high) AS clips FROM (
        SELECT cohort, quantile_cont(manual_total, 0.25) AS q1, quantile_cont(manual_total, 0.75) AS q3, min(manual_total) AS low,
          max(manual_total) AS high FROM counts GROUP BY cohort))""",
    "counts",
)
def tukey_fence(spark, d):
    return rounded(L.tukey_fence(V.counts(spark, d), ["cohort"], "manual_total"), "q1", "q3", "lower", "upper", digits=4)


# ---------------------------------------------------------------- joins


SOURCES_SQL = f"""ids AS (SELECT * FROM ({FILE_IDS}) WHERE image_id IS NOT NULL),
    manual AS (SELECT image_id, min(ord) AS manual_ord FROM ids WHERE ord % 5 IN (0, 1) GROUP BY 1),
    areas AS (SELECT image_id, min(ord) AS area_ord FROM ids WHERE ord % 5 IN (1, 2) GROUP BY 1),
    auto AS (SELECT image_id, min(ord) AS auto_ord FROM ids WHERE ord % 5 IN (0, 2, 3, 4) GROUP BY 1)"""


def _sources(spark, d):
    named = V.files(spark, d).withColumn("image_id", ids.image_id(F.col("name"))).select("ord", "image_id")
    named = L.drop_null_keys(named, "image_id")

    def source(rests, out):
        rows = named.filter((F.col("ord") % 5).isin(*rests))
        return W.dedupe_first(rows, ["image_id"], ["ord"]).select("image_id", F.col("ord").alias(out))

    return source((0, 1), "manual_ord"), source((1, 2), "area_ord"), source((0, 2, 3, 4), "auto_ord")


@query(
    "build_image_table",
    f"""WITH {SOURCES_SQL} SELECT image_id, manual_ord, area_ord, auto_ord FROM manual FULL JOIN areas USING (image_id)
        FULL JOIN auto USING (image_id)""",
    "files",
)
def build_image_table(spark, d):
    return J.build_image_table(*_sources(spark, d))


@query(
    "mismatch_report",
    f"""WITH {SOURCES_SQL} SELECT 'manual_without_area' AS problem, image_id FROM manual ANTI JOIN areas USING (image_id)
        UNION ALL SELECT 'area_without_manual', image_id FROM areas ANTI JOIN manual USING (image_id)
        UNION ALL SELECT 'manual_without_auto', image_id FROM manual ANTI JOIN auto USING (image_id)""",
    "files",
)
def mismatch_report(spark, d):
    sources = dict(zip(("manual", "area", "auto"), _sources(spark, d)))
    pairs = [("manual", "area"), ("area", "manual"), ("manual", "auto")]
    return J.mismatch_report(sources, pairs, "image_id")


GRID = f"""grid AS (SELECT animal_id, session_type, behavior FROM (SELECT DISTINCT animal_id FROM bouts)
    CROSS JOIN {rows_sql('session_type', SESSIONS)} CROSS JOIN {rows_sql('behavior', BEHAVIORS)})"""


@query(
    "zero_fill_grid",
    f"""WITH {GRID} SELECT animal_id, session_type, behavior, coalesce(n, 0) AS n_bouts FROM grid
        LEFT JOIN (SELECT animal_id, session_type, behavior, count(*) AS n FROM bouts GROUP BY ALL)
        USING (animal_id, session_type, behavior)""",
    "bouts",
)
def zero_fill_grid(spark, d):
    bouts = V.bouts(spark, d)
    facts = bouts.groupBy("animal_id", "session_type", "behavior").agg(F.count("*").alias("n_bouts"))
    dims = {"session_type": SESSIONS, "behavior": BEHAVIORS}
    return J.zero_fill_grid(facts, bouts.select("animal_id"), dims, ["n_bouts"])


@query(
    "complete_null_fill",
    f"""SELECT animal_id, session_type, {R('longest')} AS longest FROM (SELECT DISTINCT animal_id FROM bouts)
        CROSS JOIN {rows_sql('session_type', ('S1', 'S2', 'S3'))} LEFT JOIN
        (SELECT animal_id, session_type, max(duration_sec) AS longest FROM bouts GROUP BY ALL) USING (animal_id, session_type)""",
    "bouts",
)
def complete_null_fill(spark, d):
    bouts = V.bouts(spark, d)
    facts = bouts.groupBy("animal_id", "session_type").agg(F.max("duration_sec").alias("longest"))
    return rounded(J.complete(facts, bouts.select("animal_id"), {"session_type": ("S1", "S2", "S3")}), "longest")


@query(
    "lookup_join",
    """SELECT c_mktsegment AS segment, cohort, count(*) AS n_images FROM counts LEFT JOIN customer ON c_custkey = animal_id GROUP BY 1, 2""",
    "counts",
)
def lookup_join(spark, d):
    dim = V.table(spark, d, "customer").select(F.col("c_custkey").alias("animal_id"), F.col("c_mktsegment").alias("segment"))
    return J.lookup_join(V.counts(spark, d), dim, "animal_id").groupBy("segment", "cohort").agg(F.count("*").alias("n_images"))


@query(
    "semi_join",
    f"""SELECT animal_id, count(*) AS n, {R('sum(manual_total)', 2)} AS total FROM counts
        WHERE animal_id IN (SELECT animal_id FROM bouts) GROUP BY 1""",
    "counts bouts",
)
def semi_join(spark, d):
    kept = J.keep_present(V.counts(spark, d), V.bouts(spark, d), "animal_id")
    return kept.groupBy("animal_id").agg(F.count("*").alias("n"), rd(F.sum("manual_total"), 2).alias("total"))


VIEWS_SQL = f"""{GRID}, facts AS (SELECT animal_id, session_type, behavior, sum(duration_sec) AS td, count(*) AS tf,
      sum(duration_sec) FILTER (actor = 'exp') AS ed, count(*) FILTER (actor = 'exp') AS ef,
      sum(duration_sec) FILTER (actor = 'stim') AS sd, count(*) FILTER (actor = 'stim') AS sf FROM bouts GROUP BY ALL),
    totals AS (SELECT animal_id, session_type, behavior, coalesce(td, 0) AS total_duration_sec, coalesce(tf, 0) AS total_frequency,
      coalesce(ed, 0) AS exp_duration_sec, coalesce(ef, 0) AS exp_frequency, coalesce(sd, 0) AS stim_duration_sec,
      coalesce(sf, 0) AS stim_frequency FROM grid LEFT JOIN facts USING (animal_id, session_type, behavior))"""
DURATIONS = ("total_duration_sec", "exp_duration_sec", "stim_duration_sec")


def totals_of(spark, d):
    return A.bout_totals(V.bouts(spark, d), SESSIONS, BEHAVIORS)


@query(
    "bout_totals",
    f"""WITH {VIEWS_SQL} SELECT animal_id, session_type, behavior, {', '.join(f'{R(c)} AS {c}' for c in DURATIONS)},
        total_frequency, exp_frequency, stim_frequency FROM totals""",
    "bouts",
)
def bout_totals(spark, d):
    return rounded(totals_of(spark, d), *DURATIONS)


ROUTED_SQL = f"""{VIEWS_SQL}, routed AS (SELECT animal_id, session_type, behavior,
    CASE WHEN behavior IN {in_sql(DIRECTIONAL)} THEN 'exp' ELSE 'total' END AS view,
    CASE WHEN behavior IN {in_sql(DIRECTIONAL)} THEN exp_duration_sec ELSE total_duration_sec END AS duration,
    CASE WHEN behavior IN {in_sql(DIRECTIONAL)} THEN exp_frequency ELSE total_frequency END AS n_bouts FROM totals)"""


@query(
    "view_router",
    f"""WITH {ROUTED_SQL} SELECT animal_id, session_type, behavior, view, {R('duration')} AS duration, n_bouts FROM routed""",
    "bouts",
)
def view_router(spark, d):
    routed = J.view_router(totals_of(spark, d), DIRECTIONAL)
    return rounded(routed.select("animal_id", "session_type", "behavior", "view", "duration", "n_bouts"), "duration")


BINS = """SELECT *, i * 30.0 AS bin_start, least(end_sec, (i + 1) * 30.0) - greatest(start_sec, i * 30.0) AS dur_in_bin FROM (
    SELECT *, unnest(range(CAST(floor(start_sec / 30) AS BIGINT), CAST(floor((end_sec - 1e-9) / 30) AS BIGINT) + 1)) AS i FROM bouts)"""


@query(
    "bout_bin_join",
    f"""SELECT ord, CAST(bin_start AS DOUBLE) AS bin_start, {R('dur_in_bin')} AS dur_in_bin FROM ({BINS}) WHERE dur_in_bin > 0""",
    "bouts",
)
def bout_bin_join(spark, d):
    return J.bout_bin_join(V.bouts(spark, d)).select("ord", "bin_start", rd("dur_in_bin").alias("dur_in_bin"))


@query(
    "roi_attach",
    """WITH im AS (SELECT ord, split_part(split_part(split_part(name, '_cFOSseg', 1), '_GFPseg', 1), '.tif', 1) AS prefix FROM files
          WHERE name LIKE '%cFOSseg%' OR name LIKE '%GFPseg%'),
        roi AS (SELECT prefix, 'roi_' || CAST(min(ord) AS VARCHAR) AS roi FROM (
          SELECT ord, replace(replace(name, '.tif', ''), '_LVCC_RAW_final', '') AS prefix FROM files WHERE name LIKE '%LVCC_RAW_final%') GROUP BY 1)
        SELECT ord, prefix, coalesce(roi, 'old_' || CAST(ord AS VARCHAR)) AS annotation, roi IS NOT NULL AS roi_attached
        FROM im LEFT JOIN roi USING (prefix)""",
    "files",
)
def roi_attach(spark, d):
    files = V.files(spark, d)
    images = files.filter(ids.is_segmentation(F.col("name"))).select(
        "ord", ids.roi_prefix(F.col("name")).alias("prefix"), F.concat(F.lit("old_"), F.col("ord").cast("string")).alias("annotation")
    )
    rois = (
        files.filter(ids.is_raw_image(F.col("name")))
        .groupBy(ids.roi_export_name(F.col("name")).alias("prefix"))
        .agg(F.concat(F.lit("roi_"), F.min("ord").cast("string")).alias("roi"))
    )
    return J.roi_attach(images, rois)


@query(
    "cross_check_starts",
    """WITH named AS (SELECT animal_id, run_name, min(frame_id) AS start_frame FROM runs GROUP BY 1, 2),
        listed AS (SELECT animal_id, run_name, max(frame_id) % 7 AS listed_start FROM runs GROUP BY 1, 2)
        SELECT animal_id, run_name, start_frame, listed_start FROM named JOIN listed USING (animal_id, run_name)
        WHERE start_frame <> listed_start""",
    "runs",
)
def cross_check_starts(spark, d):
    spans = V.runs(spark, d).groupBy("animal_id", "run_name")
    named = spans.agg(F.min("frame_id").alias("start_frame"))
    listed = spans.agg((F.max("frame_id") % 7).alias("listed_start"))
    return J.cross_check_starts(named, listed, ["animal_id", "run_name"])


# ---------------------------------------------------------------- sources bound to names


FOLDER = """SELECT ord, stem || CASE r WHEN 0 THEN '' WHEN 1 THEN '_resume' ELSE '_resume' || CAST(r AS VARCHAR) END AS l, r, stem,
    CASE WHEN r > 0 AND ord % 4 <> 3 THEN ord * 10 END AS start_frame FROM (
    SELECT ord, split_part(split_part(name, '.', 1), '_', 1) || '_' || CAST(ord // 8 AS VARCHAR) AS stem, (ord * 7) % 4 AS r FROM files)"""


def run_folders(spark, d):
    """Run folder names: four per animal in turn, some animals without a base run, some without a start."""
    r = (F.col("ord") * 7) % 4
    stem = F.concat(F.substring_index("name", "_", 1), F.lit("_"), F.floor(F.col("ord") / 8).cast("string"))
    left = F.concat(stem, F.when(r == 0, "").when(r == 1, "_resume").otherwise(F.concat(F.lit("_resume"), r.cast("string"))))
    right = F.when((r > 0) & (F.col("ord") % 4 != 3), F.concat(F.lit("_resume"), F.lpad((F.col("ord") * 10).cast("string"), 7, "0"))).otherwise("")
    return V.files(spark, d, spread_out=True).select("ord", F.concat(left, F.lit("_app_output"), right, F.lit(".mp4")).alias("path"))


@query(
    "discover_runs",
    f"""WITH f AS ({FOLDER}), p AS (SELECT stem AS animal, CASE r WHEN 0 THEN 'output' WHEN 1 THEN 'resume' ELSE 'resume' || CAST(r AS VARCHAR) END
          AS run_name, CASE WHEN r = 0 THEN 0 ELSE start_frame END AS start_frame, ord FROM f)
        SELECT animal, run_name, start_frame, count(*) AS n FROM p WHERE start_frame IS NOT NULL
        AND animal IN (SELECT animal FROM p WHERE run_name = 'output') GROUP BY 1, 2, 3""",
    "files",
)
def discover_runs(spark, d):
    from etholith.sources.runs import discover_runs as discover

    found = discover(run_folders(spark, d), "path", "_app_output")
    return found.groupBy("animal", "run_name", "start_frame").agg(F.count("*").alias("n"))


@query(
    "scan_images",
    """SELECT ord, name, name LIKE '%LVCC_RAW_final%' AS is_raw, name LIKE '%cFOSseg%' OR name LIKE '%GFPseg%' AS is_seg
        FROM files WHERE name LIKE '%LVCC_RAW_final%' OR name LIKE '%cFOSseg%' OR name LIKE '%GFPseg%'""",
    "files",
)
def scan_images(spark, d):
    raw, seg = ids.is_raw_image(F.col("name")), ids.is_segmentation(F.col("name"))
    return V.files(spark, d).filter(raw | seg).select("ord", "name", raw.alias("is_raw"), seg.alias("is_seg"))


# ---------------------------------------------------------------- aggregations


@query(
    "bout_direction_totals",
    f"""SELECT animal_id, session_type, behavior, initiated_by, {R('coalesce(d, 0)')} AS total_duration_sec, coalesce(n, 0) AS frequency
        FROM (SELECT DISTINCT animal_id FROM bouts) CROSS JOIN {rows_sql('session_type', SESSIONS)}
        CROSS JOIN {rows_sql('behavior', DIRECTIONAL)} CROSS JOIN {rows_sql('initiated_by', ('exp', 'stim'))}
        LEFT JOIN (SELECT animal_id, session_type, behavior, actor AS initiated_by, sum(duration_sec) AS d, count(*) AS n FROM bouts
          GROUP BY ALL) USING (animal_id, session_type, behavior, initiated_by)""",
    "bouts",
)
def bout_direction_totals(spark, d):
    return rounded(A.bout_direction_totals(V.bouts(spark, d), SESSIONS, DIRECTIONAL), "total_duration_sec")


@query(
    "balance_check",
    """SELECT behavior, animal_id, count(DISTINCT session_type) AS n_distinct FROM bouts GROUP BY 1, 2 HAVING n_distinct <> 2""",
    "bouts",
)
def balance_check(spark, d):
    return A.balance_check(V.bouts(spark, d), ["behavior", "animal_id"], "session_type")


@query(
    "bout_summary",
    f"""SELECT animal_id, session_type, behavior, count(*) AS n_bouts, {R('avg(duration_sec)')} AS mean_dur,
        {R('quantile_cont(duration_sec, 0.5)')} AS median_dur, {R('stddev_samp(duration_sec)')} AS sd_dur,
        {R('min(duration_sec)')} AS min_dur, {R('max(duration_sec)')} AS max_dur FROM bouts GROUP BY 1, 2, 3""",
    "bouts",
)
def bout_summary(spark, d):
    return rounded(A.bout_summary(V.bouts(spark, d)), "mean_dur", "median_dur", "sd_dur", "min_dur", "max_dur")


@query(
    "group_medians",
    f"""WITH {VIEWS_SQL} SELECT behavior, session_type, {R('quantile_cont(total_duration_sec, 0.5)')} AS median_value
        FROM totals GROUP BY 1, 2""",
    "bouts",
)
def group_medians(spark, d):
    return rounded(A.group_medians(totals_of(spark, d), ["behavior", "session_type"], "total_duration_sec"), "median_value")


@query("session_length", f"SELECT session_type, {R('max(end_sec)')} AS session_sec FROM bouts GROUP BY 1", "bouts")
def session_length(spark, d):
    return rounded(A.session_length(V.bouts(spark, d)), "session_sec")


@query(
    "marker_counts",
    """SELECT image_id, count(*) FILTER (marker = 'GFP') AS n_gfp, count(*) FILTER (marker = 'cFOS') AS n_cfos,
        count(*) FILTER (marker = 'both') AS n_both FROM points GROUP BY 1""",
    "points",
)
def marker_counts(spark, d):
    return A.marker_counts(V.points(spark, d))


ROLLUP = """SELECT animal_id, count(*) AS n_images, sum(a_only) AS a, sum(b_only) AS b, sum(both_n) AS o, sum(ref_total) AS area
    FROM counts GROUP BY 1"""
ROLLED = f"""SELECT *, a + o AS ta, b + o AS tb, a + b + o AS n, ((a + o) / nullif(a + b + o, 0)) * ((b + o) / nullif(a + b + o, 0)) * (a + b + o) AS chance
    FROM ({ROLLUP})"""


def rollup_of(spark, d, by=("animal_id",)):
    return A.animal_rollup(V.counts(spark, d), list(by), {"manual": ("a_only", "b_only", "both_n")}, "ref_total")


@query(
    "animal_rollup",
    f"""SELECT animal_id, n_images, n_images AS n_manual, a AS manual_a_only, b AS manual_b_only, o AS manual_both, {R('area', 2)} AS area_um2,
        ta AS manual_a_total, tb AS manual_b_total, n AS manual_n_cells, {R('chance')} AS manual_chance_overlap,
        {R('100 * o / nullif(ta, 0)')} AS manual_overlap_pct_a, {R('100 * o / nullif(tb, 0)')} AS manual_overlap_pct_b,
        CASE WHEN abs(least(ta, tb) - chance) > 1e-9 THEN {R('(o - chance) / (least(ta, tb) - chance)')} END AS manual_overlap_index,
        {R('100 * o / nullif(n, 0)')} AS manual_coloc_pct, {R('ta / nullif(area / 1e6, 0)')} AS manual_a_density,
        {R('tb / nullif(area / 1e6, 0)')} AS manual_b_density, {R('o / nullif(area / 1e6, 0)')} AS manual_both_density FROM ({ROLLED})""",
    "counts",
)
def animal_rollup(spark, d):
    out = rollup_of(spark, d)
    names = [c for c in out.columns if c.endswith(("_overlap", "_pct_a", "_pct_b", "_pct", "_density", "_index"))]
    return rounded(rounded(out, *names), "area_um2", digits=2)


@query(
    "descriptives",
    f"""SELECT cohort, count(*) AS n_values, {R('avg(both_n)')} AS mean_value, {R('quantile_cont(both_n, 0.5)')} AS median_value,
        {R('quantile_cont(both_n, 0.75) - quantile_cont(both_n, 0.25)')} AS iqr FROM counts GROUP BY 1""",
    "counts",
)
def descriptives(spark, d):
    return rounded(A.descriptives(V.counts(spark, d), ["cohort"], "both_n"), "mean_value", "median_value", "iqr")


@query(
    "mean_abs_error",
    f"""SELECT image_id % 9 = 0 AS is_training, {R('avg(abs(auto_total - manual_total))', 4)} AS mean_abs_error, count(*) AS n_images
        FROM counts GROUP BY 1""",
    "counts",
)
def mean_abs_error(spark, d):
    rows = V.counts(spark, d).withColumns(
        {"is_training": F.col("image_id") % 9 == 0, "delta": F.col("auto_total") - F.col("manual_total")}
    )
    return rounded(A.mean_abs_error(rows, "is_training", "delta"), "mean_abs_error", digits=4)


@query("value_counts", "SELECT subject || '_' || CAST(joint AS VARCHAR) AS tag, count(*) AS n_rows FROM kpts GROUP BY 1", "kpts")
def value_counts(spark, d):
    return A.value_counts(
        V.keypoints(spark, d).select(F.concat_ws("_", "subject", F.col("joint").cast("string")).alias("tag")), "tag"
    )


@query(
    "bins_total",
    f"""SELECT animal_id, session_type, behavior, CAST(bin_start AS DOUBLE) AS bin_start, {R('sum(dur_in_bin)')} AS dur_in_bin
        FROM ({BINS}) WHERE dur_in_bin > 0 GROUP BY 1, 2, 3, 4""",
    "bouts",
)
def bins_total(spark, d):
    return rounded(A.bins_total(V.bouts(spark, d)), "dur_in_bin")


@query(
    "duplicate_content",
    """SELECT image_id, cohort, a_only, b_only, both_n, n AS n_sharing FROM (SELECT *, count(*) OVER (PARTITION BY a_only, b_only, both_n) AS n
        FROM counts) WHERE n > 1""",
    "counts",
)
def duplicate_content(spark, d):
    out = A.duplicate_content(V.counts(spark, d), ["a_only", "b_only", "both_n"])
    return out.select("image_id", "cohort", "a_only", "b_only", "both_n", "n_sharing")


@query(
    "cohort_mismatch",
    """SELECT DISTINCT animal_id, cohort, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'UNKNOWN') AS expected_cohort
        FROM (SELECT animal_id, CASE WHEN animal_id % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS cohort FROM counts)
        LEFT JOIN customer ON c_custkey = animal_id WHERE cohort IS DISTINCT FROM
        coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'UNKNOWN')""",
    "counts",
)
def cohort_mismatch(spark, d):
    rows = V.counts(spark, d).select("animal_id", F.when(F.col("animal_id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("cohort"))
    expected = V.table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("animal_id"), F.col("c_mktsegment").alias("expected_cohort")
    )
    return A.cohort_mismatch(rows, expected)


@query("n_distinct_per_group", "SELECT behavior, session_type, count(DISTINCT animal_id) AS n_distinct FROM bouts GROUP BY 1, 2", "bouts")
def n_distinct_per_group(spark, d):
    return A.n_distinct_per_group(V.bouts(spark, d), ["behavior", "session_type"], "animal_id")


# ---------------------------------------------------------------- order, sets, reshape


@query("order_by", f"SELECT ord, animal_id, session_type, {R('start_sec')} AS start_sec FROM bouts ORDER BY animal_id, session_type, 4, ord", "bouts")
def order_by(spark, d):
    rows = V.bouts(spark, d).select("ord", "animal_id", "session_type", rd("start_sec").alias("start_sec"))
    return rows.orderBy("animal_id", "session_type", "start_sec", "ord")


@query(
    "top_k",
    f"""SELECT joint, {R('100.0 * count(*) FILTER (likelihood < 0.6) / count(*)')} AS pct_low FROM kpts GROUP BY 1
        ORDER BY pct_low DESC, joint LIMIT 6""",
    "kpts",
)
def top_k(spark, d):
    low = 100.0 * F.count(F.when(F.col("likelihood") < 0.6, 1)) / F.count("*")
    return (
        V.keypoints(spark, d).groupBy("joint").agg(rd(low).alias("pct_low")).orderBy(F.col("pct_low").desc(), "joint").limit(6)
    )


@query(
    "union_all",
    f"""SELECT 'bouts' AS block, session_type AS part, count(*) AS n, NULL AS cohort FROM bouts GROUP BY 2
        UNION ALL SELECT 'images', NULL, count(*), cohort FROM counts GROUP BY cohort""",
    "bouts counts",
)
def union_all(spark, d):
    a = V.bouts(spark, d).groupBy(F.col("session_type").alias("part")).agg(F.count("*").alias("n")).withColumn("block", F.lit("bouts"))
    b = V.counts(spark, d).groupBy("cohort").agg(F.count("*").alias("n")).withColumn("block", F.lit("images"))
    return a.unionByName(b, allowMissingColumns=True).select("block", "part", "n", "cohort")


@query(
    "except_behaviors",
    f"SELECT DISTINCT behavior FROM bouts WHERE behavior NOT IN {in_sql(SOCIAL)}",
    "bouts",
)
def except_behaviors(spark, d):
    behaviors = V.bouts(spark, d).select("behavior")
    return behaviors.subtract(behaviors.filter(F.col("behavior").isin(*SOCIAL)))


@query("distinct_animals", "SELECT DISTINCT animal_id, session_type FROM bouts", "bouts")
def distinct_animals(spark, d):
    return V.bouts(spark, d).select("animal_id", "session_type").distinct()


MEASURES = {"a_density": ("S1",), "b_density": ("S2",), "coloc_pct": ("S1", "S2"), "overlap_index": ("S1", "S2")}
SPECS_SQL = """(SELECT 'a_density' AS measure, 'S1' AS session_type UNION ALL SELECT 'b_density', 'S2' UNION ALL SELECT 'coloc_pct', 'S1'
    UNION ALL SELECT 'coloc_pct', 'S2' UNION ALL SELECT 'overlap_index', 'S1' UNION ALL SELECT 'overlap_index', 'S2')"""


@query(
    "cross_specs",
    f"""SELECT measure, s.session_type, behavior, count(animal_id) AS n_bouts FROM {SPECS_SQL} s CROSS JOIN {rows_sql('behavior', SOCIAL)}
        LEFT JOIN bouts USING (session_type, behavior) GROUP BY 1, 2, 3""",
    "bouts",
)
def cross_specs(spark, d):
    specs = J.cross_specs(MEASURES, SOCIAL, spark)
    counted = V.bouts(spark, d).groupBy("session_type", "behavior").agg(F.count("animal_id").alias("n_bouts"))
    return specs.join(counted, ["session_type", "behavior"], "left").fillna({"n_bouts": 0})


@query(
    "pivot_wide",
    f"""WITH {VIEWS_SQL} SELECT animal_id, behavior, {R("max(total_duration_sec) FILTER (session_type = 'S1')")} AS S1,
        {R("max(total_duration_sec) FILTER (session_type = 'S2')")} AS S2 FROM totals GROUP BY 1, 2""",
    "bouts",
)
def pivot_wide(spark, d):
    wide = W.pivot_wide(totals_of(spark, d), ["animal_id", "behavior"], "session_type", SESSIONS, "total_duration_sec")
    return rounded(wide, "S1", "S2")


@query(
    "unpivot_long",
    f"""SELECT image_id, 'manual_total' AS metric, 'Manual' AS source, 'price' AS channel, {R('manual_total', 2)} AS value FROM counts
        UNION ALL SELECT image_id, 'auto_total', 'Automatic', 'price', {R('auto_total', 2)} FROM counts
        UNION ALL SELECT image_id, 'both_n', 'Manual', 'Colocalized', {R('both_n', 2)} FROM counts""",
    "counts",
)
def unpivot_long(spark, d):
    columns = {"manual_total": ("Manual", "price"), "auto_total": ("Automatic", "price"), "both_n": ("Manual", "Colocalized")}
    return rounded(W.unpivot_long(V.counts(spark, d), ["image_id"], columns), "value", digits=2)


NESTED = """SELECT image_id, marker, x, y, (row_number() OVER (PARTITION BY image_id, marker ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_extendedprice, x, y) - 1) AS i FROM points"""


@query(
    "collect_coords",
    f"""SELECT image_id, marker, i // 100 AS part, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS xs,
        string_agg(CAST(y AS VARCHAR), ',' ORDER BY i) AS ys, count(*) AS n, {R('avg(x)')} AS mean_x FROM ({NESTED}) GROUP BY 1, 2, 3""",
    "points",
)
def collect_coords(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "x", "y"]
    nested = W.nest_points(V.points(spark, d), ["image_id", "marker"], order, ["x", "y"], per_list=100)
    total = F.aggregate("coords", F.lit(0).cast("long"), lambda a, c: a + c["x"])
    return nested.select(
        "image_id", "marker", "part",
        F.array_join(F.transform("coords", lambda c: c["x"]), ",").alias("xs"),
        F.array_join(F.transform("coords", lambda c: c["y"]), ",").alias("ys"),
        F.size("coords").cast("long").alias("n"),
        rd(total / F.size("coords")).alias("mean_x"),
    )


@query(
    "nest_unnest",
    "SELECT image_id, marker, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(x * y) AS BIGINT) AS sum_xy FROM points GROUP BY 1, 2",
    "points",
)
def nest_unnest(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "x", "y"]
    nested = W.nest_points(V.points(spark, d), ["image_id", "marker"], order, ["x", "y"])
    return (
        W.unnest_points(nested, ["image_id", "marker"])
        .groupBy("image_id", "marker")
        .agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum(F.col("x") * F.col("y")).alias("sum_xy"))
    )


