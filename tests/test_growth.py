"""Results and work that must hold as the tables grow."""

import numpy as np
from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions import masks as M
from etholith.operators import aggregates as A
from etholith.operators import joins as J
from etholith.operators import resample as B
from etholith.operators import spatial as P
from etholith.operators import tracking as T
from etholith.plans import catalog, study
from etholith.plans import trackqueries as TQ
from etholith.sources import files as S
from etholith.sources import keypoints as K2
from etholith.sources import sinks as K
from etholith.sources.runs import discover_runs


def test_frame_key_of_numbers_beyond_seven_digits(spark, monkeypatch):
    keys = [9, 270_270, 270_271, 898_999, 1_000_000_007]
    monkeypatch.setattr(V, "table", lambda *_: spark.createDataFrame([(k,) for k in keys], "c_custkey long"))
    got = {r["ord"]: r["frame_id"] for r in catalog.QUERIES["frame_key"](spark, "").collect()}
    assert got == {k: None if k % 5 == 4 else k * 37 for k in keys}


def test_centroid_distances_are_roots_of_squares(spark):
    """Comparisons of nearly equal distances come out as in the SQL, to the last bit."""
    rng = np.random.default_rng(5)
    xy = rng.integers(0, 612, (2000, 2)) / 72.0
    one = np.array([3.4814814814814814, 3.5555555555555554])
    side = F.struct(
        F.array(*[F.lit(0).cast("long")] * 2).alias("words"), F.lit(8).cast("long").alias("h"), F.lit(8).cast("long").alias("w"),
        F.array(F.lit(0.0)).alias("edge_x"), F.array(F.lit(0.0)).alias("edge_y"), F.lit(float(one[0])).alias("cx"), F.lit(float(one[1])).alias("cy"),
    )
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "i long, x double, y double")
    got = T.mask_evidence(rows.withColumns({"m1": side, "m2": side}), 8, 8).orderBy("i").collect()
    want = np.sqrt((xy[:, 0] - one[0]) ** 2 + (xy[:, 1] - one[1]) ** 2)
    assert [r["c1"] for r in got] == want.tolist()


def test_agreement_does_not_hang_on_the_order_of_sums(spark):
    """Totals that differ only by the order in which their lines were added give the same row, to the last bit."""
    rng = np.random.default_rng(9)
    lines = rng.integers(90_000, 10_000_000, (12, 7)) / 100.0
    factors = 1 + rng.integers(-10, 9, (12, 7)) / 100.0

    def row(order):
        totals = [(1, i, float(sum(lines[i, k] for k in order)), float(sum(lines[i, k] * factors[i, k] for k in order))) for i in range(12)]
        df = spark.createDataFrame(totals, "animal_id long, i long, manual double, auto double").coalesce(1)
        return [tuple(r) for r in study.agreement(df, ["animal_id"], "manual", "auto").collect()]

    assert len({tuple(row(o)) for o in ((0, 1, 2, 3, 4, 5, 6), (6, 5, 4, 3, 2, 1, 0), (3, 1, 6, 0, 5, 2, 4))}) == 1


def test_keypoint_rows_are_not_exchanged_to_meet_their_header(spark, tmp_path):
    """Rows stay where they are read, whatever their size; the few columns come to them."""
    points = [(f, s, "a", float(f), 1.0, 0.5, i) for f in range(40) for s in ("m", "n") for i in (2, 1)]
    df = spark.createDataFrame(points, "frame_id long, subject string, joint string, x double, y double, likelihood double, i long")
    df = df.withColumn("x", F.when(F.col("i") == 2, F.col("x")))  # the later row of a point is the one with coordinates
    K2.write_keypoints_wide(df, str(tmp_path / "w"), "s", ("m", "n"), ("a",), order=["i"])
    K2.write_keypoints_videos(df.withColumn("video_id", F.col("frame_id") % 2), str(tmp_path / "v"), "s", ("m", "n"), ("a",), frames_per_part=10, order=["i"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in "wv":
            back = K2.read_keypoints_wide(spark, str(tmp_path / name))
            plan = back._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
            got = {(r.frame_id, r.subject): (r.joint, r.x, r.y) for r in back.collect()}
            assert got == {(f, s): ("A", float(f), 1.0) for f in range(40) for s in ("m", "n")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_run_names_are_parsed_once_and_on_all_cores(spark):
    names = ["a_app_output.mp4", "a_resume2_app_output_resume0000960.mp4", "a_resume_app_output.mp4", "b_resume_app_output_resume7.mp4", "notes.txt", None]
    paths = spark.createDataFrame([(f"x/{n}/" if n else None,) for n in names], "path string")
    out = discover_runs(paths)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(tuple(r)[:3] for r in out.collect()) == [("a", "output", 0), ("a", "resume2", 960)]
    plan = catalog.QUERIES["discover_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and plan.count("FileScan") == 1


def test_summary_judges_every_point_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def status(i):
        seen.add(1)
        return ("kept", "removed", "not_checked")[i % 3]

    points = spark.range(300).select((F.col("id") % 5).cast("int").alias("joint"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("subject"), status("id").alias("mask_status"))
    got = {r.joint: (r.m_total, r.m_removed, r.total_all, r.removed_all, r.pct_removed_all) for r in A.cleanup_summary(points, ("m", "n")).collect()}
    assert got == {**{str(j): (20, 10, 40, 20, 50.0) for j in range(5)}, "TOTAL": (100, 50, 200, 100, 50.0)}
    assert seen.value == 300
    assert A.cleanup_summary(points.filter("mask_status = 'not_checked'"), ("m", "n")).count() == 0


def test_pairs_do_not_wait_for_the_masks(spark):
    plan = catalog.QUERIES["pair_self_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "edge_x" not in plan


def test_nearest_pixels_of_a_batch(spark):
    """Distances are roots of squares to the last bit, compared for all points of a batch at once."""
    rng = np.random.default_rng(8)
    data = [([float(a) for a in rng.integers(0, 8, n)], [float(a) for a in rng.integers(0, 8, n)], float(u), float(v)) for n, u, v in zip(rng.integers(1, 20, 300), rng.random(300) * 9, rng.random(300) * 9)]
    data += [(None, None, 1.0, 1.0), ([], [], 1.0, 1.0), ([1.0], [1.0], None, 1.0), ([1.0, 3.0], [1.0, 1.0], 3.0, 2.0)]
    df = spark.createDataFrame(data, "xs array<double>, ys array<double>, x double, y double").coalesce(1)
    out = df.select(M.nearest(F.col("xs"), F.col("ys"), F.col("x"), F.col("y")).alias("d"))
    want = [float(np.sqrt(min((a - x) * (a - x) + (b - y) * (b - y) for a, b in zip(xs, ys)))) if xs and x is not None else None for xs, ys, x, y in data]
    assert [r.d for r in out.collect()] == want
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_neighbouring_blocks_share_their_draws(spark, monkeypatch):
    """Several packed blocks go through one task, with the draws made once; sums of products come with them."""
    rng = np.random.default_rng(6)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(23, 2)))]
    df = spark.createDataFrame(data, "i long, v double, w double").repartition(3)
    for block, held in ((5, 2), (5, 64), (65_536, 64)):
        for name, size in (("VALUE_BLOCK", block), ("BLOCKS_HELD", held), ("REPS_PER_TASK", 3), ("DRAWS_AT_ONCE", 4)):
            monkeypatch.setattr(B, name, size)
        got = {r.rep: r for r in B.resampled_sums(df, [], ["v", "w"], ["i"], 10, 4, [("v", "v"), ("v", "w")]).collect()}
        assert sorted(got) == list(range(1, 11))
        for rep, r in got.items():
            at = B._counter_indexes(rep, 0, 23, 23, 4)
            v, w = np.array(data)[at, 1], np.array(data)[at, 2]
            assert np.allclose([r.sum_v, r.sum_w, r.sum_v_v, r.sum_v_w], [v.sum(), w.sum(), (v * v).sum(), (v * w).sum()], atol=1e-12)


def test_draws_by_folding_equal_the_counter_hash():
    for rep, first, n in ((1, 0, 1), (2000, 8_800_000, 9_000_000), (777, 2**31 - 1000, 2**31 - 1)):
        draw = np.arange(first, first + 500, dtype=object)
        h1 = (48_271 * rep + 16_807 * draw + 69_621 * 123 + 12_345) % B.P
        h2 = h1 * h1 % B.P
        h3 = (48_271 * h2 + 16_807 * h1 + 1_013_904_223) % B.P
        assert B._counter_indexes(rep, first, first + 500, n, 123).tolist() == ((h3 * h3 % B.P + 31 * h1) % B.P % n).tolist()


def test_many_small_files_are_few_bundles(spark, tmp_path, monkeypatch):
    """Members keep names, texts and line order; a member of several batches is read line by line."""
    monkeypatch.setattr(K, "MEMBERS_PER_BUNDLE", 50)
    data = [(f"a/f{i:03}.geojson", n, f"é{i}-{n}") for i in range(200) for n in range(1 + i % 3)] + [("b.txt", n, "x" * (n % 7)) for n in range(25_000)]
    lines = spark.createDataFrame(data, "archive string, n long, value string").repartition(5)
    K.write_bundled_lines(lines, str(tmp_path / "out"), ["n"])
    assert len(list((tmp_path / "out").glob("bundle-*.zip"))) <= 5
    whole = {r["path"].split(".zip/")[1]: r["value"] for r in S._whole_files(spark, str(tmp_path / "out"), "*.geojson", bundled=True).collect()}
    assert whole == {f"a/f{i:03}.geojson": "".join(f"é{i}-{n}\n" for n in range(1 + i % 3)) for i in range(200)}
    back = S.read_bundled_lines(spark, str(tmp_path / "out")).withColumn("path", F.substring_index("path", ".zip/", -1)).collect()
    assert sorted((r["path"], r["value"]) for r in back) == sorted((a, v) for a, _, v in data)
    assert [r["value"] for r in back if r["path"] == "b.txt"] == ["x" * (n % 7) for n in range(25_000)]


def exchanged(df):
    """Lines of the plan that exchange rows by hash to meet a need, without those a caller asked for."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" not in line]


def test_rows_partitioned_by_frame_stay_where_they_are(spark):
    points = spark.createDataFrame([(1, 1, "s1", 1, 0.0, 0.0), (1, 1, "s1", 2, 3.0, 4.0), (1, None, "s1", 1, 0.0, 0.0)], "video_id long, frame_id long, subject string, joint int, x double, y double")
    met = J.skeleton_join(points.repartition("video_id", "frame_id", "subject"), [(1, 2, 6.0), (2, 3, 1.0)], ["video_id", "frame_id", "subject"])
    assert not exchanged(met)
    assert sorted((r.joint, r.other, r.ox, r.oy, r.limit) for r in met.collect()) == [(1, 2, 3.0, 4.0, 6.0), (2, 1, 0.0, 0.0, 6.0)]
    rows = points.withColumnsRenamed({"subject": "subject_corrected"}).withColumns({"likelihood": F.lit(1.0), "reason": F.lit("r")}).repartition("video_id", "frame_id")
    swapped = T.anatomical_swap(rows, ("s1", "s2"), [1, 2], [(1, 2, 6.0)])
    assert not [line for line in exchanged(swapped) if "_side" in line]


def test_rotations_are_one_exchange_of_the_points(spark, monkeypatch):
    """Groups that a task can take are judged whole; larger ones by bands and grid cells, with the same counts."""
    rng = np.random.default_rng(11)
    data = [(int(g) if g < 9 else None, "GFP" if m else "cFOS", int(x), int(y)) for g, m, x, y in zip(rng.integers(0, 10, 600), rng.integers(0, 2, 600), rng.integers(0, 60, 600), rng.integers(0, 60, 600))]
    data += [(20, "GFP", 5, 5)] * 3 + [(20, "cFOS", 5, 5), (20, "cFOS", 9, 5), (21, "GFP", 1, 1), (21, "cFOS", 1, 1), (21, "cFOS", 2, 1), (22, "both", 1, 1)]
    points = spark.createDataFrame(data, "g long, marker string, x long, y long")

    def rows():
        null = B.overlaps_at(points, ["g"], [3.0, 7.0], B.angle_table(points, ["g"], 40))
        real = P.radius_count(points, ["g"], 7.0)
        plans = null._jdf.queryExecution().executedPlan().toString() + real._jdf.queryExecution().executedPlan().toString()
        tested = {(r.g, r.radius): (r.real_overlap, r.n_rotations, r.n_ge, r.n_le, r.p_value) for r in B.rotation_nulls(points, ["g"], [3.0, 7.0], 40).collect()}
        return plans, sorted(map(tuple, null.collect())), sorted(map(str, real.collect())), tested

    plans, null, real, tested = rows()
    assert "_band" not in plans and "_cell_x" not in plans
    assert len(null) == 10 * 2 * 40 and tested[(None, 3.0)] == (None,) * 5 == tested[(21, 7.0)]
    monkeypatch.setattr(P, "PAIRS_AT_ONCE", 7)
    assert rows()[1:] == (null, real, tested)
    monkeypatch.setattr(P, "GROUP_POINTS", 20)
    plans, *same = rows()
    assert "_band" in plans and "_cell_x" in plans and tuple(same) == (null, real, tested)


def test_replicates_share_their_draws():
    """Replicates are stretches of one cycle of draws; no more draws are made than the cycle has, whatever the rows."""
    for n, reps in ((1, 3), (700, 40), (9_000_000, 2000), (B.P - 1, 7), (B.P, 3), (B.P + 5, 3)):
        starts, lengths, first, last, whole = B._stretches(n, reps, 123)
        assert lengths.sum() <= min(B.P, n * reps)
        twice = np.append(lengths, lengths)
        assert [int(twice[a:b].sum()) + whole * B.P for a, b in zip(first, last)] == [n] * reps
    rng = np.random.default_rng(12)
    n, reps = 700, 40
    values = rng.normal(size=(n, 2))
    starts, lengths, first, last, _ = B._stretches(n, reps, 123)
    total = np.zeros((len(starts), 3))
    for row in range(0, n, 300):
        for lo in range(0, n * reps, 9_000):
            piece, sums = B._drawn_sums(values[row : row + 300], [(0, 1)], row, n, reps, 123, lo, lo + 9_000, 512)
            total[piece] += sums
    twice = np.concatenate([total, total])
    for rep in range(1, reps + 1):
        v = values[B._counter_indexes(rep, 0, n, n, 123)]
        assert np.allclose(twice[first[rep - 1] : last[rep - 1]].sum(axis=0), [*v.sum(axis=0), (v[:, 0] * v[:, 1]).sum()], atol=1e-10)


def test_many_mask_frames_are_not_broadcast(spark, monkeypatch):
    """Shards are small on disk, their outlines are not: the size of the files does not decide."""
    frames = spark.range(4).select(F.col("id").alias("slot"), F.array(F.lit(1.0)).alias("m1"))
    for least, joined in ((5, "BroadcastHashJoin"), (4, "SortMergeJoin")):
        monkeypatch.setattr(TQ, "EXCHANGED_SLOTS", least)
        met = J.frame_cogroup(spark.range(9).withColumnRenamed("id", "slot"), TQ.sized(frames, 4), ["slot"])
        assert joined in met._jdf.queryExecution().executedPlan().toString()
