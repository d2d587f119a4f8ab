"""Readers and writers on small files written here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from etholith.operators.joins import cross_check_starts
from etholith.operators.tracking import segment_status
from etholith.sources import archives as A
from etholith.sources import files as S
from etholith.sources import sinks as K
from etholith.sources.keypoints import read_keypoints_wide, write_keypoints_videos, write_keypoints_wide
from etholith.sources.runs import SHARDS_MARKER, discover_runs, read_start_frames


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_bouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Animal,Start,End,Behavior,Bout_Duration\ncount_0_CD1,00:00:01.5,00:01:00,BL6_CD1_nose2nose,58.5\ncount_0_CD1,00:02:00,00:02:01,moving,1\n")
    (tmp_path / "b.csv").write_text("behaviour,duration_s,ANIMAL,END,START\nexp_following,2,count_3,01:00:02,01:00:00\n")
    got = rows(S.read_bouts(spark, str(tmp_path), "CD1"), "animal_id", "start_sec")
    assert got == [
        ("count_0", "CD1", "nose2nose", "exp", "stim", 1.5, 60.0, 58.5),
        ("count_0", "CD1", "moving", None, None, 120.0, 121.0, 1.0),
        ("count_3", "CD1", "following", "exp", None, 3600.0, 3602.0, 2.0),
    ]


def test_bouts_missing_columns(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Animal,Start,Duration\nx,1,2\n")
    with pytest.raises(ValueError, match=r"bad.csv: .* does not settle end \(0 columns\), behavior \(0 columns\)"):
        S.read_bouts(spark, str(tmp_path), "BL6")


def test_bouts_two_durations(spark, tmp_path):
    (tmp_path / "two.csv").write_text("Animal,Start,End,Behavior,duration,duration2\n")
    with pytest.raises(ValueError, match=r"two.csv: .* does not settle duration \(2 columns\)"):
        S.read_bouts(spark, str(tmp_path), "BL6")


def test_bouts_strict_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Animal,Start,End,Behavior,duration\nx,0:0:0,0:0:1,a_b_c_d,1\n")
    with pytest.raises(Exception, match="unexpected behaviour label"):
        S.read_bouts(spark, str(tmp_path), "BL6").collect()
    assert S.read_bouts(spark, str(tmp_path), "BL6", strict=False).first()["behavior"] is None


def marker_xml(types):
    body = "".join(
        f"<Marker_Type><Type>{i}</Type><Name>{n}</Name>" + "".join(f"<Marker><MarkerX>{x}</MarkerX><MarkerY>{y}</MarkerY></Marker>" for x, y in pts) + "</Marker_Type>"
        for i, (n, pts) in enumerate(types)
    )
    return f"<?xml version='1.0'?><CellCounter_Marker_File><Image_Properties><X_Calibration>0.5</X_Calibration></Image_Properties><Marker_Data>{body}</Marker_Data></CellCounter_Marker_File>"


def test_markers_and_areas(spark, tmp_path):
    deep = tmp_path / "xml" / "animal"
    deep.mkdir(parents=True)
    (deep / "Count3_1_x.xml").write_text(marker_xml([("gfp", [(1, 2), (3, 4)]), ("cFos+", [(5, 6)]), ("Type 3", []), ("other", [(9, 9)])]))
    (deep / "count3_2.xml").write_text(marker_xml([("both", [(7, 8)])]))
    (tmp_path / "xml" / "count3_3.xml").write_text("<broken><a>")
    got = rows(S.read_marker_xml(spark, str(tmp_path / "xml")).select("image_id", "marker", "x", "y"))
    assert got == [("count3_1", "GFP", 1.0, 2.0), ("count3_1", "GFP", 3.0, 4.0), ("count3_1", "cFOS", 5.0, 6.0), ("count3_2", "both", 7.0, 8.0)]
    bad = [r[0].rsplit("/", 1)[1] for r in S.unreadable_markers(spark, str(tmp_path / "xml")).collect()]
    assert bad == ["count3_3.xml"]
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    hole = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]

    def collection(*geometries):
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in geometries]})

    roi = tmp_path / "roi"
    roi.mkdir()
    (roi / "Count3_1.geojson").write_text(collection({"type": "Polygon", "coordinates": square}, None, {"type": "Point", "coordinates": [1, 2]}))
    (roi / "count3_2.geojson").write_text(collection({"type": "MultiPolygon", "coordinates": [square, hole]}))
    (roi / "count9_9.geojson").write_text(collection({"type": "Polygon", "coordinates": square}))
    polygons = S.read_roi_geojson(spark, str(roi))
    assert polygons.count() == 4
    calibration = S.marker_calibration(spark, str(tmp_path / "xml"))
    assert rows(S.roi_areas(polygons, calibration)) == [("count3_1", 1.0), ("count3_2", 5.0), ("count9_9", None)]
    assert dict(rows(S.roi_areas(polygons, calibration, holes=True)))["count3_2"] == 4.75


def test_objects_round_trip(spark, tmp_path):
    ring = lambda x, y: [[x, y], [x + 2, y], [x + 2, y + 2], [x, y + 2]]
    folder = tmp_path / "obj"
    folder.mkdir()
    feature = lambda x, y: {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring(x, y)]}}
    (folder / "count3_1_GFPobjects.geojson").write_text(json.dumps([feature(0, 0), feature(10, 10)], indent=1))
    (folder / "count3_1_cFOSobjects.geojson").write_text("\n".join(json.dumps(feature(5, y)) for y in (1, 3)))
    (folder / "count3_2_GFPobjects.geojson").write_text(json.dumps([feature(0, 0)]))
    got = rows(S.read_object_geojson(spark, str(folder)))
    assert got == [("count3_1", "GFP", 0, 1.0, 1.0), ("count3_1", "GFP", 1, 11.0, 11.0), ("count3_1", "cFOS", 0, 6.0, 2.0), ("count3_1", "cFOS", 1, 6.0, 4.0)]
    df = spark.createDataFrame([("count3_1", "GFP", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])], "image_id string, marker string, ring array<array<double>>")
    K.write_objects_by_image(df, str(tmp_path / "out"))
    written = spark.read.text(str(tmp_path / "out"))
    row = written.first()
    assert row["class"] == "GFP" and row["image"] == "count3_1"
    assert json.loads(row["value"])["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]


def test_tables(spark, tmp_path):
    (tmp_path / "auto.csv").write_text("Image,GFP_only,cFOS_only,Double_positive,Total_GFP,Total_cFOS\nCount3_1,1,2,3,4,5\nstray,x,2,3,4,5\n")
    got = rows(S.read_auto_counts(spark, str(tmp_path / "auto.csv"), "Coh1"), F.col("image_id").asc_nulls_last())
    assert got == [("count3_1", "Coh1", 1.0, 2.0, 3.0), (None, "Coh1", None, 2.0, 3.0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        S.read_auto_counts(spark, str(tmp_path / "none.csv"), "Coh1")
    (tmp_path / "mirror.csv").write_text("image_id,base_side\ncount3_1,1\ncount3_2,x\n")
    assert rows(S.read_mirror_info(spark, str(tmp_path / "mirror.csv"))) == [("count3_1", 1), ("count3_2", None)]
    (tmp_path / "start_frames.txt").write_text("# note\nresume 960\nresume2, 17\nbroken\nresume3 x\n")
    listed = read_start_frames(spark, str(tmp_path / "start_frames.txt"))
    assert rows(listed) == [("resume", 960), ("resume2", 17)]
    named = spark.createDataFrame([("resume", 960), ("resume2", 18)], "run_name string, start_frame long")
    assert rows(cross_check_starts(named, listed, ["run_name"])) == [("resume2", 18, 17)]


def test_manifest(spark, tmp_path):
    state = {
        "a.mp4": {"status": "done", "segments": [{"start_frame": 0, "video": "v", "shards": "s"}]},
        "b.mp4": {"status": "has_resume", "segments": [{"start_frame": 0, "video": "v", "shards": "s"}, {"start_frame": 9, "video": "w", "shards": "t"}]},
        "c.mp4": {"status": "merged", "segments": [{"start_frame": 0, "video": "v", "shards": "s"}], "merged_video": "m"},
        "d.mp4": {"status": "pending", "segments": []},
    }
    (tmp_path / "m.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "ann.json").write_text(json.dumps({"a.mp4": {"start_frame": 5, "points": [[1, 2.5, 3.5]]}, "e.mp4": {"start_frame": 0, "points": []}}))
    segments = S.read_segment_manifest(spark, str(tmp_path / "m.json"))
    clicks = S.read_annotations(spark, str(tmp_path / "ann.json"))
    assert rows(clicks.filter("obj_id IS NOT NULL")) == [("a.mp4", 5, 1, 2.5, 3.5)]
    got = {r["video_id"]: (r["status"], r["display"]) for r in segment_status(segments, clicks).collect()}
    assert got == {
        "a.mp4": ("done", "annotated"), "b.mp4": ("has_resume", "has_resume"), "c.mp4": ("merged", "merged"),
        "d.mp4": ("pending", "pending"), "e.mp4": (None, "annotated"),
    }
    assert rows(segments.select("video_id", "status").distinct()) == [(k, v["status"]) for k, v in sorted(state.items())]


HEADER = "scorer,s,s,s,s,s,s\nindividuals,stim,stim,stim,exp,exp,exp\nbodyparts,Nose,Nose,Nose,nose,nose,nose\ncoords,x,y,likelihood,x,y,likelihood\n"


def test_keypoints(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(HEADER + "0,1,2,0.9,3,4,0.8\n1,,,,5,6,NaN\n")
    got = rows(read_keypoints_wide(spark, str(path), ("exp", "stim"), ("nose",)), "frame_id", "subject")
    assert got == [(0, "exp", "nose", 3.0, 4.0, 0.8), (0, "stim", "nose", 1.0, 2.0, 0.9), (1, "exp", "nose", 5.0, 6.0, None), (1, "stim", "nose", None, None, None)]
    with pytest.raises(ValueError, match="expected the individuals"):
        read_keypoints_wide(spark, str(path), ("a", "b"))
    long = read_keypoints_wide(spark, str(path), joints=("nose",))
    out = tmp_path / "out"
    write_keypoints_wide(long.repartition(3), str(out), "fixed", ("stim", "exp"), ("nose",))
    parts = sorted(p for p in out.iterdir() if p.name.startswith("part") and p.stat().st_size)
    assert parts[0].read_text().splitlines()[:4] == [
        "scorer,fixed,fixed,fixed,fixed,fixed,fixed", "individuals,exp,exp,exp,stim,stim,stim",
        "bodyparts,Nose,Nose,Nose,Nose,Nose,Nose", "coords,x,y,likelihood,x,y,likelihood",
    ]
    lines = [ln for p in parts for ln in p.read_text().splitlines() if ln[0].isdigit()]
    assert lines == ["0,3.0,4.0,0.8,1.0,2.0,0.9", "1,5.0,6.0,,,,"]


def test_keypoint_files_have_their_own_headers(spark, tmp_path):
    folder = tmp_path / "v"
    (folder / "b").mkdir(parents=True)
    (folder / "a.csv").write_text("scorer,s,s,s,s\nindividuals,m,m,m,m\nbodyparts,A,A,B,B\ncoords,x,y,x,y\n0,1,2,3,4\n")
    (folder / "b" / "b.csv").write_text('scorer,s,s,s,s,s\r\nindividuals,m,m,n,m,"m"\r\nbodyparts,B,B,"a, b",A,A\r\ncoords,y,x,likelihood,x,y\r\n7,40,30,0.5,10,\r\n')
    got = {(r.frame_id, r.subject, r.joint): (r.x, r.y, r.likelihood) for r in read_keypoints_wide(spark, str(folder)).collect()}
    assert got == {(0, "m", "A"): (1.0, 2.0, None), (0, "m", "B"): (3.0, 4.0, None), (7, "m", "A"): (10.0, None, None), (7, "m", "B"): (30.0, 40.0, None), (7, "n", "a, b"): (None, None, 0.5)}
    with pytest.raises(Exception, match="expected the individuals"):
        read_keypoints_wide(spark, str(folder), ("m",)).collect()
    (folder / "c.csv").write_text("3,1,2,3,4\n")
    with pytest.raises(Exception, match="without the header rows"):
        read_keypoints_wide(spark, [str(folder / "a.csv"), str(folder / "c.csv")]).collect()
    long = spark.createDataFrame([(v, f, "m", "a", float(f), 1.0, None) for v in (1, 2) for f in range(0, 25, v)], "video_id long, frame_id long, subject string, joint string, x double, y double, likelihood double")
    write_keypoints_videos(long, str(tmp_path / "w"), "s", ("m",), ("a",), frames_per_part=10)
    files = sorted(p.relative_to(tmp_path / "w").as_posix() for p in (tmp_path / "w").rglob("*.csv"))
    assert files == [f"{v}/part_00000{k}.csv" for v in (1, 2) for k in range(3)]
    lines = (tmp_path / "w" / "1" / "part_000001.csv").read_text().splitlines()
    assert lines[0] == "scorer,s,s,s" and lines[4:] == [f"{f},{float(f)},1.0," for f in range(10, 20)]


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    masks = {}
    for i, frames in enumerate(((0, 1, 2), (3, 5))):
        members = {}
        for f in frames:
            for o in (1, 2):
                m = rng.random((8, 8)) > 0.5
                masks[f, o] = m
                members[f"frame{f:07d}_obj{o}_mask_packed"] = np.packbits(m)
                members[f"frame{f:07d}_obj{o}_mask_shape"] = np.array(m.shape)
        if i:
            members["frame0000005_obj1_mask_gap"] = np.array([1], dtype=np.uint8)
            members["unrelated"] = np.zeros(3)
        np.savez(tmp_path / f"shard_{i:05d}.npz", **members)
    np.savez(tmp_path / "centroids.npz", centroids_obj1=np.array([[0, 1.5, 2.5], [4.9999, 3, 4]]), centroids_obj2=np.zeros((0, 3)))
    got = S.read_mask_shards(spark, str(tmp_path)).collect()
    assert {(r["frame_id"], r["obj_id"]) for r in got} == set(masks)
    for r in got:
        bits = np.unpackbits(np.frombuffer(r["packed"], np.uint8))[:64].reshape(r["h"], r["w"]).astype(bool)
        assert (bits == masks[r["frame_id"], r["obj_id"]]).all()
        assert r["is_gap"] == (r["frame_id"] == 5 and r["obj_id"] == 1)
    keys = S.read_mask_shards(spark, str(tmp_path), keys_only=True)
    assert {(r["frame_id"], r["obj_id"]) for r in keys.collect()} == set(masks)
    cents = S.latest_centroids(S.read_centroids(spark, str(tmp_path)))
    assert rows(cents) == [(1, 0, 1.5, 2.5), (1, 5, 3.0, 4.0)]
    out = tmp_path / "out"
    K.write_mask_shards(S.read_mask_shards(spark, str(tmp_path)).withColumn("animal", F.lit("a")), str(out), frames_per_shard=2)
    back = spark.read.parquet(str(out)).groupBy("shard").agg(F.sort_array(F.collect_set("frame_id")).alias("f"))
    assert rows(back) == [(0, [0, 1]), (1, [2, 3]), (2, [5])]


def test_runs_and_images(spark, tmp_path):
    names = ["count_0_app_output.mp4", "count_0_resume_app_output_resume0000960.mp4", "count_0_resume2_app_output.mp4", "count_1_resume_app_output_resume0000007.mp4", "other.mp4"]
    paths = spark.createDataFrame([(f"/data/{n}",) for n in names], "path string")
    assert rows(discover_runs(paths).drop("path")) == [("count_0", "output", 0), ("count_0", "resume", 960)]
    folders = spark.createDataFrame([("x/count_0_app_shards/",), ("x/count_0_resume_app_shards",)], "path string")
    assert rows(discover_runs(folders, marker=SHARDS_MARKER).drop("path")) == [("count_0", "output", 0), ("count_0", "resume", None)]
    for n in ("a_GFPseg.tif", "b_cFOSseg.tiff", "c.tif", "d.txt"):
        (tmp_path / n).write_text("x")
    assert [r["name"] for r in S.list_images(spark, str(tmp_path), ("cFOSseg", "GFPseg")).orderBy("name").collect()] == ["a_GFPseg.tif", "b_cFOSseg.tiff"]


def test_reports(spark, tmp_path):
    frames = spark.createDataFrame([("v", 1), ("v", 2), ("v", 5)], "video string, frame_id long")
    K.write_gap_report(frames, str(tmp_path / "gaps"), ["video"])
    assert rows(spark.read.json(str(tmp_path / "gaps")).select("video", "start", "end_exclusive", "n_frames")) == [("v", 3, 5, 2)]
    counts = spark.createDataFrame([("i", 1, 2, 3, 4, 5)], "image_id string, gfp_only int, cfos_only int, double_positive int, total_gfp int, total_cfos int")
    K.write_colocalisation(counts, str(tmp_path / "coloc"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "coloc"))) == [("i", "1", "2", "3", "4", "5")]
    cleaned = spark.createDataFrame(
        [("v", 1, "exp", "nose", "kept_protected", 1.0, 1.0, 0.5), ("v", 1, "exp", "center", "removed", 2.0, 3.0, 0.4), ("v", 1, "stim", "center", "kept", 2.0, 3.0, 0.4)],
        "video string, frame_id long, subject_corrected string, joint string, mask_status string, orig_x double, orig_y double, orig_likelihood double",
    )
    K.write_cleanup_report(cleaned, str(tmp_path / "rep"), ("exp", "stim"), ["video", "frame_id"])
    summary = spark.read.option("header", True).csv(str(tmp_path / "rep" / "summary"))
    assert {r["joint"]: (r["total_all"], r["removed_all"], r["pct_removed_all"]) for r in summary.collect()} == {
        "center": ("2", "1", "50.0"), "nose": ("1", "0", "0.0"), "TOTAL": ("3", "1", "33.33")
    }
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "removed_details")).count() == 1


def test_keypoints_of_every_video(spark):
    from etholith import views as V
    from etholith.plans.roundtrips import read_keypoints_videos

    sf = "/root/testdata/sf0.001"
    seen = V.keypoints(spark, sf).groupBy("video_id").agg(F.countDistinct("frame_id", "subject", "joint").alias("n")).collect()
    frames = {r.video_id: r.n for r in V.keypoints(spark, sf).groupBy("video_id").agg(F.countDistinct("frame_id").alias("n")).collect()}
    got = read_keypoints_videos(spark, sf).groupBy("video_id").agg(F.sum("n").alias("n"), F.sum("n_x").alias("n_x")).collect()
    assert {r.video_id: r.n for r in got} == {v: n * 2 * 7 for v, n in frames.items()} and len(got) == 4
    assert all(0 < r.n_x <= next(s.n for s in seen if s.video_id == r.video_id) for r in got)


def _masks(spark, frames, parts):
    rng = np.random.default_rng(1)
    data = [("a" if f % 3 else "b", f, o, 9, 11, rng.bytes(13), f % 4 == 0) for f in frames for o in (1, 2, 12)]
    schema = "animal string, frame_id long, obj_id int, h int, w int, packed binary, is_gap boolean"
    return spark.createDataFrame(data, schema).repartition(parts), {(d[0], d[1], d[2]): d[3:] for d in data}


def test_archive_source_splits_and_prunes(spark, tmp_path):
    masks, want = _masks(spark, range(0, 90, 2), 3)
    folder = str(tmp_path / "m")
    K.write_mask_archives(masks, folder, frames_per_shard=20)
    names = sorted(p.relative_to(folder).as_posix() for p in (tmp_path / "m").rglob("*.npz"))
    assert names == ["a_merged_shards/shard_00000.npz", "a_merged_shards/shard_00001.npz", "b_merged_shards/shard_00000.npz"]
    assert not list((tmp_path / "m").rglob("_temporary*"))
    with np.load(f"{folder}/{names[0]}") as npz:  # as other tools read it
        assert {int(k[5:12]) for k in npz.files} == set([f for f in range(0, 90, 2) if f % 3][:20])
    got = S.read_mask_shards(spark, folder)
    pieces = A.read_archives(spark, "mask_archive", folder, splitBytes=700)
    assert pieces.rdd.getNumPartitions() > 10
    for df in (got, pieces, S.read_mask_shards(spark, [f"file://{folder}/a_merged_shards", f"{folder}/b_merged_shards"])):
        assert {(r.path.split("/")[-2][0], r.frame_id, r.obj_id): (r.h, r.w, bytes(r.packed), r.is_gap) for r in df.collect()} == want
        assert df.count() == len(want)
    some = got.filter("frame_id >= 30 AND frame_id < 60 AND obj_id IN (2, 12) AND frame_id <> 44")
    assert {(r.frame_id, r.obj_id) for r in some.collect()} == {(f, o) for _, f, o in want if 30 <= f < 60 and o in (2, 12) and f != 44}
    reader = A.MaskReader({"path": folder})
    assert list(reader.pushFilters([A.GreaterThan(("frame_id",), 30), A.In(("obj_id",), (1, 2)), A.EqualTo(("path",), "x")])) == [A.EqualTo(("path",), "x")]
    assert reader.wanted("frame_id", 31) and not reader.wanted("frame_id", 30) and not reader.wanted("obj_id", 12)
    (tmp_path / "none").mkdir()
    assert S.read_mask_shards(spark, str(tmp_path / "none")).count() == 0


def test_archive_sink_is_all_or_nothing(spark, tmp_path):
    masks, _ = _masks(spark, range(8), 2)
    folder = str(tmp_path / "m")
    K.write_mask_archives(masks, folder)
    before = sorted(p.name for p in (tmp_path / "m").rglob("*"))
    bad = masks.withColumn("h", F.when(F.col("frame_id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("h")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        K.write_mask_archives(bad, folder)
    rows_apart = masks.selectExpr("'x/shard_00000.npz' AS archive", "frame_id", "obj_id", "h", "w", "packed").repartition(2, "frame_id")
    with pytest.raises(Exception, match="more than one task"):
        rows_apart.write.format("mask_archive").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "m").rglob("*")) == before
    K.write_mask_archives(masks.filter("animal = 'a'"), folder)  # overwrites
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["a_merged_shards"]


def test_centroid_archives(spark, tmp_path):
    tracks = [("a", o, f, float(f) / 3, -float(f)) for o in (1, 2) for f in range(0, 5000, o)]
    df = spark.createDataFrame(tracks, "animal string, obj_id int, frame_id long, x double, y double").repartition(4)
    K.write_centroid_archives(df, str(tmp_path / "c"))
    with np.load(tmp_path / "c" / "a_merged_shards" / "centroids.npz") as npz:
        assert npz["centroids_obj2"].shape == (2500, 3) and npz["centroids_obj2"][1].tolist() == [2.0, 2 / 3, -2.0]
    back = S.read_centroids(spark, str(tmp_path / "c"))
    assert sorted((r.obj_id, r.frame_id, r.x, r.y) for r in back.collect()) == sorted(t[1:] for t in tracks)
    assert back.filter("obj_id = 2 AND frame_id < 10").count() == 5
    np.savez(tmp_path / "centroids.npz", centroids_obj7=np.asfortranarray(np.arange(12.0).reshape(4, 3)))
    assert rows(S.read_centroids(spark, str(tmp_path / "centroids.npz")).select("obj_id", "frame_id", "x", "y"))[1] == (7, 3, 4.0, 5.0)
