"""Operators against hand-made answers and brute force on small tables."""

import itertools
import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from etholith.functions import masks as M
from etholith.functions import prob
from etholith.operators import filters as L
from etholith.operators import frames as R
from etholith.operators import joins as J
from etholith.operators import ordered as O
from etholith.operators import rasters as X
from etholith.operators import resample as B
from etholith.operators import spatial as P
from etholith.operators import stats as S
from etholith.operators import tracking as T
from etholith.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# ---------------------------------------------------------------- ordered helpers


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value most of that group."""
    rng = random.Random(3)
    data = [("hot", 5.0 if rng.random() < 0.4 else round(rng.gauss(0, 10), 1), i) for i in range(4000)]
    data += [(f"g{i % 7}", round(rng.random() * 9), i) for i in range(300)] + [(None, 1.5, 1), (None, 2.5, 2)]
    return data, spark.createDataFrame([(g, float(v), i) for g, v, i in data], "g string, v double, i long")


def test_tie_ranks_and_quantiles(skewed):
    data, df = skewed
    groups = defaultdict(list)
    for g, v, _ in data:
        groups[g].append(float(v))
    got = O.tie_ranks(df, ["g"], "v").collect()
    assert len(got) == sum(len(set(v)) for v in groups.values())
    for r in got:
        vals = groups[r["g"]]
        below, ties = sum(v < r["value"] for v in vals), vals.count(r["value"])
        assert (r["n_below"], r["n_ties"], r["n_group"]) == (below, ties, len(vals))
        assert r["avg_rank"] == below + (ties + 1) / 2
    q = {r["g"]: r for r in O.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.9}).collect()}
    for g, vals in groups.items():
        assert np.allclose([q[g]["a"], q[g]["m"], q[g]["z"]], np.quantile(vals, [0.1, 0.5, 0.9]))


def test_row_index_is_dense_per_group(skewed):
    data, df = skewed
    got = defaultdict(list)
    for r in O.row_index(df, ["g"], ["v", "i"]).collect():
        got[r["g"]].append((r["idx"], r["v"], r["i"], r["n_group"]))
    for g, items in got.items():
        items.sort()
        assert [x[0] for x in items] == list(range(len(items)))
        assert [x[1:3] for x in items] == sorted(x[1:3] for x in items)
        assert {x[3] for x in items} == {len(items)}


def test_answers_do_not_depend_on_partitions(skewed):
    _, df = skewed
    one = rows(S.p_adjust(df.withColumn("p", F.abs(F.sin("i"))).coalesce(1), ["g"], "p"))
    many = rows(S.p_adjust(df.withColumn("p", F.abs(F.sin("i"))).repartition(8), ["g"], "p"))
    assert one == many


# ---------------------------------------------------------------- frames


@pytest.mark.parametrize("chunk", [3, 16, 1000])
def test_frame_axis_operators(spark, chunk):
    rng = random.Random(chunk)
    frames = {v: sorted(rng.sample(range(200), 120)) for v in ("a", "b")}
    df = spark.createDataFrame([(v, f) for v, fs in frames.items() for f in fs for _ in range(2)], "v string, frame_id long")
    near = {(r["v"], r["frame_id"]): (r["prev_frame"], r["next_frame"]) for r in R.neighbours(df, ["v"], chunk=chunk).collect()}
    place = {(r["v"], r["frame_id"]): r["position"] for r in R.dense_index(df, ["v"], chunk=chunk).collect()}
    gaps = {(r["v"], r["start"], r["end_exclusive"], r["n_frames"]) for r in R.gaps(df, ["v"], chunk=chunk).collect()}
    runs = {(r["v"], r["start"], r["end_exclusive"]) for r in R.islands(df, ["v"], chunk=chunk, min_len=2).collect()}
    want_gaps, want_runs = set(), set()
    for v, fs in frames.items():
        for i, f in enumerate(fs):
            assert near[v, f] == (fs[i - 1] if i else None, fs[i + 1] if i + 1 < len(fs) else None)
            assert place[v, f] == i
            if i + 1 < len(fs) and fs[i + 1] > f + 1:
                want_gaps.add((v, f + 1, fs[i + 1], fs[i + 1] - f - 1))
        for _, part in itertools.groupby(enumerate(fs), lambda t: t[1] - t[0]):
            part = [f for _, f in part]
            if len(part) >= 2:
                want_runs.add((v, part[0], part[-1] + 1))
    assert gaps == want_gaps and runs == want_runs
    track = df.distinct().withColumns({"x": F.col("frame_id") * 2.0, "y": -F.col("frame_id") * 1.0})
    filled = R.interpolate_gaps(track, ["v"], chunk=chunk).collect()
    assert {(r["v"], r["frame_id"]) for r in filled} == {(v, f) for v, a, b, _ in want_gaps for f in range(a, b)}
    assert all(math.isclose(r["x"], 2 * r["frame_id"]) and math.isclose(r["y"], -r["frame_id"]) for r in filled)


def test_toggle_twice_is_identity(spark):
    rng = random.Random(1)
    pts = spark.createDataFrame([(0, f, s, f + i) for f in range(60) for i, s in enumerate(("a", "b"))], "video_id int, frame_id long, subject string, x int")
    spans = [(0, rng.randrange(50), 0) for _ in range(9)] + [(0, 5, 0), (0, 5, 0)]
    ranges = spark.createDataFrame([(v, a, a + rng.randrange(12)) for v, a, _ in spans], "video_id int, start long, end long")
    once = J.toggle_range_swap(pts, ranges, ("a", "b"))
    cover = [(r["start"], r["end"]) for r in ranges.collect()]
    for r in once.collect():
        odd = sum(a <= r["frame_id"] <= b for a, b in cover) % 2
        original = "ab"[r["x"] - r["frame_id"]]
        assert r["subject"] == ({"a": "b", "b": "a"}[original] if odd else original)
    assert rows(J.toggle_range_swap(once, ranges, ("a", "b"))) == rows(pts)


def test_priority_merge_is_idempotent(spark):
    data = [("m", 1, 1, "output"), ("m", 1, 2, "output"), ("m", 1, 1, "resume2"), ("m", 2, 1, "resume"), ("m", 2, 1, "odd"), ("m", 3, 1, "odd")]
    df = spark.createDataFrame(data, "animal_id string, frame_id long, obj_id int, run_name string")
    once = W.priority_merge(df)
    assert rows(once) == [("m", 1, 1, "resume2"), ("m", 2, 1, "resume")]
    assert rows(W.priority_merge(once)) == rows(once)


def test_thirds_and_censoring(spark):
    df = spark.createDataFrame([("a", i, i) for i in (4, 2, 9, 7)] + [("b", 1, 1), ("b", 2, 2)] + [("c", None, 1), ("c", 2, 2), ("c", 3, 3)], "animal string, section int, id int")
    got = {(r["animal"], r["id"]): r["rc_bin"] for r in W.rc_thirds(df, ["animal"], "section", "id").collect()}
    assert [got["a", i] for i in (2, 4, 7, 9)] == ["Anterior", "Anterior", "Middle", "Posterior"]
    assert {v for (a, _), v in got.items() if a != "a"} == {None}
    bouts = spark.createDataFrame([(0, "m", "S1", "x", "exp", 5.0, 6.0, 1.0), (1, "n", "S1", "y", None, 1.0, 9.0, 8.0)], "ord int, animal_id string, session_type string, behavior string, actor string, start_sec double, end_sec double, duration_sec double")
    late = {(r["animal_id"], r["session_type"]): (r["latency_sec"], r["censored"]) for r in W.censored_latency(bouts, ["x"], ["S1", "S2"]).collect()}
    assert late == {("m", "S1"): (5.0, False), ("n", "S1"): (9.0, True), ("m", "S2"): (None, True), ("n", "S2"): (None, True)}


def test_bins_add_up_to_durations(spark):
    bouts = spark.createDataFrame([(1, 0.0, 30.0), (2, 29.0, 95.5), (3, 60.0, 60.0)], "ord int, start_sec double, end_sec double")
    got = rows(J.bout_bin_join(bouts).select("ord", "bin_start", "dur_in_bin"))
    assert got == [(1, 0.0, 30.0), (2, 0.0, 1.0), (2, 30.0, 30.0), (2, 60.0, 30.0), (2, 90.0, 5.5)]


# ---------------------------------------------------------------- statistics


def enumerate_signed(diffs):
    """Pratt: rank with zeros, drop them, enumerate all signs."""
    order = sorted(abs(d) for d in diffs)
    rank = {v: np.mean([i + 1 for i, o in enumerate(order) if o == v]) for v in order}
    ranks = [rank[abs(d)] for d in diffs if d]
    seen = sum(rank[abs(d)] for d in diffs if d > 0)
    centre = sum(ranks) / 2
    far = [abs(sum(r for r, s in zip(ranks, signs) if s) - centre) >= abs(seen - centre) - 1e-9 for signs in itertools.product((0, 1), repeat=len(ranks))]
    return seen, sum(far) / len(far)


def test_signed_rank_exact(spark):
    cases = {"a": [1, -2, 3, 4, -1, 0, 5], "b": [2, 2, 2, -1], "c": [0, 0, 0], "d": [3]}
    data = [(k, i, c, float(v if c == "x" else 0)) for k, vs in cases.items() for i, v in enumerate(vs) for c in "xy"]
    df = spark.createDataFrame(data + [("a", 99, "x", 1.0)], "k string, u int, c string, v double")
    got = {r["k"]: r for r in S.paired_signed_rank(df, ["k"], "u", "c", ("x", "y"), "v").collect()}
    for k in "ab":
        stat, p = enumerate_signed(cases[k])
        assert got[k]["statistic"] == stat and math.isclose(got[k]["p_value"], p) and got[k]["method"] == "exact"
    assert got["a"]["n_pairs"] == 7 and got["a"]["n_zero"] == 1
    assert (got["c"]["note"], got["d"]["note"]) == ("all diffs zero", "too few pairs")
    assert got["c"]["p_value"] is None and got["d"]["effect_r"] is None
    dropped = {r["k"]: r for r in S.paired_signed_rank(df, ["k"], "u", "c", ("x", "y"), "v", zero_method="wilcox").collect()}
    stat, p = enumerate_signed([d for d in cases["a"] if d])
    assert dropped["a"]["statistic"] == stat and math.isclose(dropped["a"]["p_value"], p)


def test_rank_sum_exact(spark):
    x, y = [1, 2, 2, 7], [2, 3, 9, 9, 4]
    df = spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "g string, v double")
    r = S.rank_sum(df, [], "g", ("x", "y"), "v").first()
    pool = x + y
    rank = {v: np.mean([i + 1 for i, o in enumerate(sorted(pool)) if o == v]) for v in pool}
    w, centre = sum(rank[v] for v in x), len(x) * (len(pool) + 1) / 2
    sums = [sum(rank[pool[i]] for i in pick) for pick in itertools.combinations(range(len(pool)), len(x))]
    assert r["w"] == w
    assert math.isclose(r["p_value"], np.mean([abs(s - centre) >= abs(w - centre) - 1e-9 for s in sums]))


def test_tails():
    assert math.isclose(prob.t_two_sided_value(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(prob.t_two_sided_value(0.5, 1), 0.70483276, rel_tol=1e-6)
    angle = math.atan(12 / math.sqrt(3))  # closed form for three degrees of freedom
    closed = 1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle))
    assert math.isclose(prob.t_two_sided_value(12.0, 3), closed, rel_tol=1e-9)


def test_p_adjust(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.03, None]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    holm = {r["i"]: r["p_adj"] for r in S.p_adjust(df, [], "p", "holm").collect()}
    bh = {r["i"]: r["p_adj"] for r in S.p_adjust(df, [], "p", "bh").collect()}
    assert np.allclose([holm[i] for i in range(5)], [0.04, 0.09, 0.09, 0.025, 0.09])
    assert np.allclose([bh[i] for i in range(5)], [0.025, 0.04, 0.0375, 0.025, 0.0375])
    assert holm[5] is None and bh[5] is None
    with pytest.raises(ValueError):
        S.p_adjust(df, [], "p", "other")


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    x = rng.exponential(2, 40)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0), ("b", 1, 2.0)] + [("c", i, 3.0) for i in range(4)], "g string, i int, v double")
    got = {r["g"]: r for r in B.bca_ci_mean(df, ["g"], "v", ["i"]).collect()}
    assert got["b"]["ci_low"] is None and got["c"]["ci_low"] is None
    # Same rule in numpy with its own random numbers.
    boot = np.sort(rng.choice(x, (4000, 40)).mean(axis=1))
    d = x.mean() - x
    accel = -(d**3).sum() / (6 * (d**2).sum() ** 1.5)
    low, high = prob.bca_bounds(boot, x.mean(), accel, 0.95)
    assert abs(got["a"]["ci_low"] - low) < 0.15 and abs(got["a"]["ci_high"] - high) < 0.2
    assert got["a"]["ci_low"] < x.mean() < got["a"]["ci_high"]


def test_concordance_interval(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(100, 10, 30)
    y = x + rng.normal(1, 4, 30)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    got = B.bca_ci_ccc(df, [], "x", "y", ["i"]).first()

    def ccc(a, b):
        return 2 * np.cov(a, b)[0, 1] / (a.var(ddof=1) + b.var(ddof=1) + (a.mean() - b.mean()) ** 2)

    assert math.isclose(got["theta"], ccc(x, y), rel_tol=1e-9)
    picks = rng.integers(0, 30, (3000, 30))
    boot = np.sort([ccc(x[p], y[p]) for p in picks])
    loo = np.array([ccc(np.delete(x, i), np.delete(y, i)) for i in range(30)])
    d = loo.mean() - loo
    low, high = prob.bca_bounds(boot, ccc(x, y), (d**3).sum() / (6 * (d**2).sum() ** 1.5), 0.95)
    assert abs(got["ci_low"] - low) < 0.03 and abs(got["ci_high"] - high) < 0.03


def test_tukey_fence(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0)] * 4 + [("c", float(v)) for v in range(5)] + [("a", float("nan"))], "g string, v double")
    got = {r["g"]: (r["lower"], r["upper"]) for r in L.tukey_fence(df, ["g"], "v").collect()}
    assert got == {"a": (1.0, 7.0), "b": (None, None), "c": (None, None)}


# ---------------------------------------------------------------- space


def test_greedy_match_equals_sequential(spark):
    rng = random.Random(11)
    pts = {c: [(g, i, rng.randrange(40), rng.randrange(40)) for i in range(120) for g in ("hot", "cold") if g == "hot" or i < 25] for c in "ab"}
    want = {}
    for g in ("hot", "cold"):
        free = {i: (x, y) for gg, i, x, y in pts["b"] if gg == g}
        for _, i, x, y in sorted(p for p in pts["a"] if p[0] == g):
            near = [(math.hypot(x - u, y - v), j) for j, (u, v) in free.items() if math.hypot(x - u, y - v) <= 4]
            if near:
                want[g, i] = min(near)[1]
                del free[min(near)[1]]
    a, b = (spark.createDataFrame(pts[c], "g string, key int, x int, y int") for c in "ab")
    got = {(r["g"], r["a_key"]): r["b_key"] for r in P.greedy_nearest_match(a, b, ["g"], 4.0).collect()}
    assert got == want
    halved = {(r["g"], r["a_key"]): r["b_key"] for r in P.greedy_nearest_match(a, b, ["g"], 2.0, px_size=0.5).collect()}
    assert halved == want
    assert P.greedy_nearest_match(a.filter("x < 0"), b, ["g"], 4.0).count() == 0


def test_radius_count_and_rotation(spark):
    pts = [("m", "GFP", 0.0, 0.0), ("m", "GFP", 0.0, 0.0), ("m", "GFP", 30.0, 0.0), ("m", "cFOS", 3.0, 4.0), ("m", "cFOS", -3.0, 4.0), ("m", "GFP", None, 1.0), ("n", "GFP", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, marker string, x double, y double")
    assert rows(P.radius_count(df, ["g"], 5.0)) == [("m", 3, 2, 2), ("n", 1, 0, 0)]
    assert rows(P.radius_count(df, ["g"], 4.9)) == [("m", 3, 2, 0), ("n", 1, 0, 0)]
    null = {r["g"]: r for r in B.rotation_null(df, ["g"], 5.0, n_rotations=50).collect()}
    assert null["n"]["p_value"] is None and 0 < null["m"]["p_value"] <= 1 and null["m"]["n_rotations"] == 50


def test_full_rotation_queries(spark, monkeypatch):
    from etholith.plans import statistics as Q

    rng = np.random.default_rng(5)
    spots = rng.integers(0, 512, (30, 2))
    pts = [(1, m, int(x), int(y)) for m in ("GFP", "cFOS") for x, y in spots]
    pts += [(2, m, int(x), int(y)) for m in ("GFP", "cFOS") for x, y in rng.integers(0, 60, (12, 2))] + [(3, "GFP", 1, 1)]
    df = spark.createDataFrame(pts, "image_id long, marker string, x long, y long")
    monkeypatch.setattr(Q.V, "points", lambda spark, d: df)
    want = {}
    for r in B.angle_table(df, ["image_id"]).collect():
        if r.image_id < 3:
            a, b = (np.array([p[2:] for p in pts if p[:2] == (r.image_id, m)], float) for m in ("GFP", "cFOS"))
            c, t = a.mean(axis=0), np.radians(r.angle)
            a = (a - c) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + c
            near = np.hypot(*(a[:, None] - b).transpose(2, 0, 1)) <= 10
            want.setdefault(r.image_id, []).append((r.rotation, int(near.any(axis=1).sum())))
    assert all(len(v) == B.ROTATIONS == 1000 for v in want.values())
    hist = {(r.image_id, r.overlap): r.n_rotations for r in Q.null_distribution(spark, "").collect()}
    assert hist == Counter((i, n) for i, v in want.items() for _, n in v)
    got = {r.image_id: r for r in Q.rotation_null(spark, "").collect()}
    for i, v in want.items():
        real = got[i].real_overlap
        ge, le = sum(n >= real for _, n in v), sum(n <= real for _, n in v)
        assert (got[i].n_rotations, got[i].n_ge, got[i].n_le) == (1000, ge, le)
        assert abs(got[i].p_value - min(1, 2 * min(ge + 1, le + 1) / 1001)) < 1e-6
    assert got[1].real_overlap == 30 and got[1].p_value < 0.05 and got[3].p_value is None  # all of image 1 overlaps
    monkeypatch.setattr(Q, "rollup_of", lambda spark, d: spark.createDataFrame([(k, 2.0 + k, 1.0, 0.5) for k in range(4)], "animal_id long, manual_both double, manual_chance_overlap double, manual_overlap_index double"))
    out = Q.real_vs_chance(spark, "").first()
    assert (out.n_tested_5, out.n_tested_10) == (2, 2) and out.n_sig_5 >= 1 and out.n_sig_10 >= 1


def test_rotation_by_intervals(spark):
    """Ties at right angles, a point on the mean, dense and repeated points, uneven angles; two radii from one join."""
    rng = np.random.default_rng(9)
    pts = [("q", "GFP", x, y) for x, y in ((-10.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, -10.0), (0.0, 0.0), (0.0, 0.0))]
    pts += [("q", "cFOS", x, y) for x, y in ((15.0, 0.0), (3.0, 4.0), (0.0, -7.0))]
    pts += [("r", m, float(x), float(y)) for m in ("GFP", "cFOS") for x, y in rng.integers(0, 25, (60, 2))]
    pts += [("s", "GFP", 1.0, 2.0), ("s", "cFOS", 1.0, 2.0), ("r", "cFOS", None, 2.0)]
    turns = [(g, k, a) for g in "qrs" for k, a in enumerate([0.0, 90.0, 180.0, 270.0, 360.0, 0.0, 45.0, -90.0, 359.999, *rng.uniform(0, 360, 25).tolist()])]
    df = spark.createDataFrame(pts, "g string, marker string, x double, y double")
    angles = spark.createDataFrame(turns, "g string, rotation int, angle double")
    got = {(r.g, r.radius, r.rotation): r.overlap for r in B.overlaps_at(df, ["g"], [5.0, 2.0], angles).collect()}
    want = {}
    for g, k, angle in turns:
        a, b = (np.array([p[2:] for p in pts if p[:2] == (g, m) and p[2] is not None]) for m in ("GFP", "cFOS"))
        if len(a) > 1 and len(b) > 1:
            t, c = np.radians(angle), a.mean(axis=0)
            moved = (a - c) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + c
            far = np.hypot(*(moved[:, None] - b).transpose(2, 0, 1)).min(axis=1)
            for radius in (5.0, 2.0):
                want[g, radius, k] = int((far <= radius + 1e-9).sum())
    assert got == want and len(got) == 2 * 2 * 34


def test_whole_result_tables(spark):
    from etholith.plans import statistics as Q

    sf = "/root/testdata/sf0.001"
    got = {r.test: r for r in Q.key_stats_full(spark, sf).collect()}
    short = Q.key_stats(spark, sf).collect()
    assert {r.test for r in short} < set(got) and all(abs(got[r.test].statistic - r.statistic) < 2e-4 and got[r.test].n == r.n for r in short)
    one = Q.real_vs_chance(spark, sf).first()
    assert abs(got["Real vs chance overlap (signed rank)"].p_value - one.wilcoxon_p) < 2e-6
    assert abs(got["Real vs chance overlap (paired t)"].p_value - one.t_p) < 2e-6
    assert abs(got["Overlap index (mean across animals)"].statistic - one.mean_overlap_index) < 2e-4
    assert got["Bootstrap 95% CI, real-chance diff"].note == f"95% CI [{one.ci_low:.2f}, {one.ci_high:.2f}]"
    ccc = Q.bca_ci_ccc(spark, sf).first()
    assert got["Agreement CCC, per animal"].note.startswith(f"95% CI [{ccc.ci_low:.2f}, {ccc.ci_high:.2f}], rho=")
    family = sorted((r.p_value, r.p_fdr) for r in got.values() if r.test.startswith(("Overfitting", "Batch")))
    want, least = [], 1.0
    for i in range(len(family), 0, -1):
        least = min(least, family[i - 1][0] * len(family) / i)
        want.append(least)
    assert len(family) == 10 and np.allclose([f for _, f in family], want[::-1], atol=1e-5)
    for r in Q.overfit_check_with_p(spark, sf).collect():
        assert abs(got[f"Overfitting {r.cohort}"].p_value - r.p_value) < 2e-6
    assert all(r.note is not None for r in got.values()) and sum(r.p_fdr is not None for r in got.values()) == 10
    rows_ = Q.behaviour_report_ci(spark, sf).collect()
    assert len(rows_) == Q.behaviour_report(spark, sf).count()
    known = [r for r in rows_ if r.ci_low is not None]
    assert known and all(r.ci_low <= r.mean_diff <= r.ci_high for r in known)


# ---------------------------------------------------------------- masks


def test_mask_functions_equal_numpy(spark):
    rng = np.random.default_rng(2)
    on = rng.random((5, 7)) > 0.6
    flat = on.ravel()
    words = [int(sum(int(b) << i for i, b in enumerate(flat[s : s + 32]))) for s in (0, 32)]
    df = spark.createDataFrame([(words, bytearray(np.packbits(on).tobytes()))], "words array<long>, packed binary")
    probes = df.withColumn("x", F.explode(F.sequence(F.lit(-1), F.lit(7)))).withColumn("y", F.explode(F.sequence(F.lit(-1), F.lit(5))))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    got = probes.select("x", "y", M.mask_bit(F.col("packed"), 5, 7, x, y).alias("b")).collect()
    for r in got:
        inside = 0 <= r["x"] < 7 and 0 <= r["y"] < 5
        assert r["b"] == (bool(on[r["y"], r["x"]]) if inside else None)
    out = df.select(M.outline(F.col("words"), 5, 7).alias("w"), M.outline(F.col("packed"), 5, 7, packed=True).alias("p"), M.area(F.col("words")).alias("n")).first()
    assert out["w"] == out["p"] and out["n"] == flat.sum() == out["w"]["area"]
    ys, xs = np.nonzero(on)
    assert math.isclose(out["w"]["cx"], xs.mean()) and math.isclose(out["w"]["cy"], ys.mean())
    # Edge pixels are enough for points outside the mask.
    for px, py in ((-2.0, 1.2), (3.3, 9.0), (6.9, 0.1)):
        full = np.hypot(xs - px, ys - py).min()
        edge = np.hypot(np.array(out["w"]["edge_x"]) - px, np.array(out["w"]["edge_y"]) - py).min()
        if not (0 <= round(px) < 7 and 0 <= round(py) < 5 and on[round(py), round(px)]):
            assert math.isclose(full, edge)


def test_connected_objects(spark):
    art = ["##..#", ".#..#", ".####", ".....", "#..##"]
    grid = [1 if c == "#" else 0 for row in art for c in row]
    df = spark.createDataFrame([(1, grid), (2, [0] * 25)], "t int, class_map array<int>")
    got = rows(X.connected_objects(df, ["t"], 5, 5).select("t", "label", "area"))
    assert got == [(1, 0, 9), (1, 20, 1), (1, 23, 2)]
    assert rows(X.connected_objects(df, ["t"], 5, 5, min_area=2).select("label")) == [(0,), (23,)]


# ---------------------------------------------------------------- identity


NEIGH = {"a": (("b", 2.0),), "b": (("a", 2.0), ("c", 2.0)), "c": (("b", 2.0),)}


def test_assign_frames_by_hand(spark):
    """Costs are worked out in the comments; neighbours of one object may be 2 apart for free."""
    data = [
        # frame, ord, joint, x, y, d1, d2, c1, c2, expected
        (0, 0, "a", 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, ("obj1", "mask_nearest")),
        (0, 1, "b", 0.0, 1.0, 1.0, 2.0, 0.0, 0.0, ("obj1", "exclusive_pair")),  # straight 1 + 1; crossed 2 + 2 + 10.7
        (0, 2, "b", 9.0, 9.0, 2.0, 1.0, 0.0, 0.0, ("obj2", "exclusive_pair")),
        (0, 3, "b", 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, (None, "extra_detection")),
        (0, 4, "c", None, None, 0.0, 0.0, 0.0, 0.0, (None, "nan_coords")),
        (1, 0, "a", 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, ("obj1", "mask_nearest")),
        (1, 1, "b", 9.0, 9.0, 1.0, 1.5, 0.0, 0.0, ("obj2", "exclusive_pair")),  # straight 1 + 10.7 + 1; crossed 1.5 + 1.5
        (1, 2, "b", 0.0, 1.0, 1.5, 1.0, 0.0, 0.0, ("obj1", "exclusive_pair")),
        (1, 3, "c", 0.0, 2.0, 2.0, 2.0, 0.0, 0.0, ("obj1", "exclusive_pair")),  # straight 4; crossed 4 + two stretches
        (1, 4, "c", 9.0, 8.0, 2.0, 2.0, 0.0, 0.0, ("obj2", "exclusive_pair")),
        (2, 0, "a", 4.0, 4.0, 4.0, 5.0, 2.0, 1.0, ("obj2", "no_mask_centroid_fallback")),  # both masks over 3 away
        (2, 1, "c", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, ("obj1", "exclusive_pair")),  # a tie keeps the order
        (2, 2, "c", 2.0, 2.0, 1.0, 1.0, 0.0, 0.0, ("obj2", "exclusive_pair")),
    ]
    schema = "frame_id int, ord int, joint string, x double, y double, d1 double, d2 double, c1 double, c2 double"
    df = spark.createDataFrame([d[:-1] for d in data], schema).withColumns(
        {"subject": F.lit("s"), "oob": F.lit(False), "in1": F.lit(False), "in2": F.lit(False), "has1": F.lit(True), "has2": F.lit(True)}
    )
    got = {(r["frame_id"], r["ord"]): (r["assigned"], r["reason"]) for r in T.assign_frames(df, ["frame_id"], ["ord"], NEIGH, 3.0).collect()}
    assert got == {(d[0], d[1]): d[-1] for d in data}
    masked = df.withColumns({"has1": F.col("frame_id") > 0, "has2": F.col("frame_id") > 0})
    none = T.assign_frames(masked, ["frame_id"], ["ord"], NEIGH, 3.0).filter("frame_id = 0 AND x IS NOT NULL")
    assert {r["reason"] for r in none.collect()} == {"no_mask_frame"}


def test_anatomical_swap_by_hand(spark):
    """Five joints in a row; ``a`` belongs at y = 0 and ``b`` at y = 8, bones reach 3."""
    edges = [(1, 2, 3.0), (2, 3, 3.0), (3, 4, 3.0), (4, 5, 3.0)]
    frames = {
        # y of joints 1-5 of a and of b as seen; y wanted; joints that are exchanged
        0: ([0, 0, 0, 0, 0], [8, 8, 8, 8, 8], [0, 0, 0, 0, 0], [8, 8, 8, 8, 8], set()),
        1: ([0, 0, 8, 0, 0], [8, 8, 0, 8, 8], [0, 0, 0, 0, 0], [8, 8, 8, 8, 8], {3}),
        2: ([8, 0, 0, 0, 0], [0, 8, 8, 8, 8], [0, 0, 0, 0, 0], [8, 8, 8, 8, 8], {1}),
        3: ([0, 0, 0, 0, 8], [8, 8, 8, 8, 0], [0, 0, 0, 0, 0], [8, 8, 8, 8, 8], {5}),
        4: ([8, 0, 0, 0, 8], [0, 8, 8, 8, 0], [0, 0, 0, 0, 0], [8, 8, 8, 8, 8], {1, 5}),
        5: ([0, 0, 8, 0, 0], [8, 8, None, 8, 8], [0, 0, 8, 0, 0], [8, 8, None, 8, 8], set()),  # nothing to exchange with
        6: ([0, 0, 4, 0, 0], [8, 8, 4, 8, 8], [0, 0, 4, 0, 0], [8, 8, 4, 8, 8], set()),  # an exchange mends nothing
    }
    data = [
        (f, s, j + 1, None if y is None else float(j), None if y is None else float(y), 0.5 + s / 10)
        for f, sides in frames.items() for s in (0, 1) for j, y in enumerate(sides[s])
    ]
    data = [(f, "ab"[s], *rest) for f, s, *rest in data] + [(0, "other", 1, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(data, "frame_id int, subject_corrected string, joint int, x double, y double, likelihood double").withColumn("reason", F.lit("r"))
    got = T.anatomical_swap(df, ("a", "b"), [1, 2, 3, 4, 5], edges, ["frame_id"], ["joint"]).collect()
    assert len(got) == len(data)
    for r in got:
        if r["subject_corrected"] == "other":
            continue
        f, s, j = r["frame_id"], "ab".index(r["subject_corrected"]), r["joint"]
        assert r["y"] == frames[f][2 + s][j - 1]
        assert r["reason"] == ("anat_swap" if j in frames[f][4] else "r")
        if r["y"] is not None:  # the likelihood travels with its point
            assert r["likelihood"] == 0.5 + (1 - s if j in frames[f][4] else s) / 10


def test_normal_tail_and_quantile(spark):
    z = [0.0, 0.3, -1.96, 5.5, -8.0, 20.0, 38.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(prob.normal_two_sided("z").alias("p")).collect()]
    assert all(math.isclose(p, math.erfc(abs(v) / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-300) for p, v in zip(got, z) if abs(v) < 37)
    assert all(math.isclose(p, math.erfc(abs(v) / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15) for p, v in zip(got, z) if abs(v) < 7)
    ps = [1e-9, 0.01, 0.3, 0.5, 0.7, 0.999, 0.0, 1.0]
    df = prob.with_normal_quantile(spark.createDataFrame([(v,) for v in ps], "p double"), "p", "q")
    q = [r.q for r in df.collect()]
    assert q[-2:] == [None, None] and all(math.isclose(a, NormalDist().inv_cdf(b), rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(q[:-2], ps))


def test_cleanup_keeps_protected_and_unjudged(spark):
    data = [
        ("exp", "nose", 1.0, True, True, False, 99.0), ("exp", "center", 1.0, True, False, False, 14.0), ("exp", "center", 1.0, True, False, False, 16.0),
        ("exp", "center", 1.0, True, True, False, None), ("exp", "center", 1.0, False, False, None, None), ("exp", "center", None, True, False, None, None),
        ("exp", "center", 1.0, True, False, False, None), ("exp", "center", 1.0, True, False, True, 0.0), ("who", "center", 1.0, True, False, False, 99.0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, subject_corrected string, joint string, x double, has2 boolean, oob boolean, in2 boolean, d2 double")
    df = df.withColumns({"y": F.col("x"), "likelihood": F.lit(0.9), "has1": F.col("has2"), "in1": F.lit(False), "d1": F.lit(50.0)})
    got = [r for r in T.mask_cleanup(df, {"stim": 1, "exp": 2}).orderBy("i").collect()]
    assert [r["mask_status"] for r in got] == ["kept_protected", "kept", "removed", "removed", "not_checked", "not_checked", "not_checked", "kept", "not_checked"]
    assert [r["x"] for r in got] == [1.0, 1.0, None, None, 1.0, None, 1.0, 1.0, 1.0]
    assert [r["likelihood"] for r in got] == [0.9, 0.9, 0.0, 0.0, 0.9, 0.9, 0.9, 0.9, 0.9]
    assert got[2]["orig_x"] == 1.0 and got[2]["orig_likelihood"] == 0.9


def test_packed_masks_of_own_sizes_and_stored_tracks(spark):
    rng = np.random.default_rng(9)
    grids = {(1, 1): rng.random((5, 7)) > 0.4, (1, 2): rng.random((5, 7)) > 0.6, (2, 1): rng.random((9, 4)) > 0.5}
    masks = spark.createDataFrame(
        [(f, o, *g.shape, bytearray(np.packbits(g).tobytes())) for (f, o), g in grids.items()], "frame_id int, obj_id int, h int, w int, packed binary"
    )
    points = [(f, x, y) for f in (1, 2, 3) for x, y in ((0.0, 0.0), (3.2, 6.4), (6.0, 4.0), (-1.0, 2.0))]
    kp = spark.createDataFrame(points, "frame_id int, x double, y double")
    tracks = spark.createDataFrame([(1, 1, 10.0, 10.0), (3, 2, 0.0, 0.0)], "frame_id int, obj_id int, x double, y double")
    got = T.mask_evidence(J.frame_cogroup(kp, T.mask_frames(masks, ["frame_id"]), ["frame_id"], tracks)).collect()
    assert len(got) == len(points)
    for r in got:
        for o in (1, 2):
            g = grids.get((r["frame_id"], o))
            assert r[f"has{o}"] == (g is not None)
            if g is None:
                continue
            px, py = round(r["x"]), round(r["y"])
            inside = 0 <= px < g.shape[1] and 0 <= py < g.shape[0]
            assert r["oob"] != inside and r[f"in{o}"] == (bool(g[py, px]) if inside else None)
            ys, xs = np.nonzero(g)
            assert math.isclose(r[f"d{o}"], np.hypot(xs - r["x"], ys - r["y"]).min())
            cx, cy = (10.0, 10.0) if (r["frame_id"], o) == (1, 1) else (xs.mean(), ys.mean())
            assert math.isclose(r[f"c{o}"], math.hypot(r["x"] - cx, r["y"] - cy))
    three = [r for r in got if r["frame_id"] == 3]
    assert all(math.isclose(r["c2"], math.hypot(r["x"], r["y"])) and r["c1"] is None for r in three)


def test_objects_over_tile_borders(spark):
    """A ring, a snake and dots on a 20 x 15 image cut into tiles of 5 x 5, against labels of the whole image."""
    image = np.zeros((15, 20), dtype=int)
    image[2:9, 2] = image[2:9, 12] = 1
    image[2, 2:13] = image[8, 2:13] = 1
    image[11, 0:20] = image[12, 19] = image[13, 1:20] = image[14, 0] = 1
    image[5, 5] = image[0, 19] = image[4, 16] = image[5, 15] = 1
    tiles = [(7, c, r, image[r * 5 : r * 5 + 5, c * 5 : c * 5 + 5].ravel().tolist()) for c in range(4) for r in range(3)]
    df = spark.createDataFrame(tiles, "image int, col int, row int, class_map array<int>")
    got = X.connected_objects(df, ["image"], 5, 5, grid=("col", "row")).collect()
    labels = X._labels(image > 0)
    want = {}
    for k in np.unique(labels[labels >= 0]):
        ys, xs = np.nonzero(labels == k)
        want[len(xs), round(xs.mean(), 9), round(ys.mean(), 9)] = want.get((len(xs), round(xs.mean(), 9), round(ys.mean(), 9)), 0) + 1
    have = {}
    for r in got:
        key = (r["area"], round(r["cx"], 9), round(r["cy"], 9))
        have[key] = have.get(key, 0) + 1
    assert have == want and len(got) == 7


def test_greedy_match_along_a_line(spark):
    """A chain of 400 points, each competing with the next: rounds follow the tiles crossed, not the points."""
    n = 400
    a = spark.createDataFrame([(1, k, 6.0 * k, 0.0) for k in range(n)], "g int, key int, x double, y double")
    b = spark.createDataFrame([(1, k, 6.0 * k - 3.5, 0.0) for k in range(n + 1)], "g int, key int, x double, y double")
    got = {r["a_key"]: r["b_key"] for r in P.greedy_nearest_match(a, b, ["g"], 10.0).collect()}
    free, want = set(range(n + 1)), {}
    for k in range(n):
        near = [(abs(6.0 * j - 3.5 - 6.0 * k), j) for j in free if abs(6.0 * j - 3.5 - 6.0 * k) <= 10]
        if near:
            want[k] = min(near)[1]
            free.remove(want[k])
    assert got == want


def test_duration_counts_by_behaviour_in_one_pass(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.6), ("b", 0.6), ("b", 2.0), ("b", None), (None, 5.0)], "behavior string, duration_sec double")
    limits = {"b": 1.0}
    kept, seen = L.observed_min_duration(df, by_behavior=limits)
    assert sorted(kept.collect(), key=str) == sorted(L.min_duration(df, by_behavior=limits).collect(), key=str)
    assert seen.get == {"n_kept": 3, "n_total": 6}
    report = {r.behavior: (r.n_kept, r.n_total) for r in L.min_duration_report(df, by=["behavior"], by_behavior=limits).collect()}
    assert report == {"a": (1, 2), "b": (1, 3), None: (1, 1)}
    named, seen = L.observed_drop_null_keys(df, "behavior")
    assert named.count() == 5 and seen.get == {"n_kept": 5, "n_total": 6}


def test_replicates_by_counts_equal_draws(spark, monkeypatch):
    """Counts per block of rows add up to the draws of the counter hash, for one block and for several; the last replicates fill no task."""
    rng = np.random.default_rng(2)
    data = [(g, i, float(v)) for g, n in (("a", 23), (None, 7), ("c", 1)) for i, v in enumerate(rng.normal(size=n))] + [("c", 9, None)]
    df = spark.createDataFrame(data, "g string, i long, v double").repartition(3)

    def index(rep, draw, n, seed=4):
        h1 = (48271 * rep + 16807 * draw + 69621 * seed + 12345) % B.P
        h2 = h1 * h1 % B.P
        h3 = (48271 * h2 + 16807 * h1 + 1013904223) % B.P
        return (h3 * h3 % B.P + 31 * h1) % B.P % n

    for block, per_task, at_once in ((65536, 250, 1 << 20), (5, 3, 4)):
        monkeypatch.setattr(B, "VALUE_BLOCK", block)
        monkeypatch.setattr(B, "REPS_PER_TASK", per_task)
        monkeypatch.setattr(B, "DRAWS_AT_ONCE", at_once)
        got = {(r.g, r.rep): r["mean"] for r in B.replicate_means(df, ["g"], "v", ["i"], 10, 4).collect()}
        assert len(got) == 30
        for (g, rep), mean in got.items():
            v = [x for k, _, x in data if k == g and x is not None]
            assert abs(mean - np.mean([v[index(rep, k, len(v))] for k in range(len(v))])) < 1e-12
    assert B.replicate_means(df.limit(0), ["g"], "v", ["i"], 10).count() == 0
