"""File readers: bouts, markers, regions, objects, counts, manifests, masks, centroids."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.functions import ids
from etholith.functions.geometry import polygon_area, ring_centroid
from etholith.sources.archives import read_archives



def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _whole_files(spark: SparkSession, path: str | Sequence[str], glob: str, bundled: bool = False) -> DataFrame:
    """One row per file (path, value), folders searched recursively; with ``bundled`` per member of zip bundles."""
    if bundled:
        return read_archives(spark, "text_bundle", path, glob=glob)
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )


# ---------------------------------------------------------------- bouts


#: What a header cell must look like, by field; each field has one cell at least, the duration exactly one.
BOUT_FIELDS = {
    "animal": re.compile(r"animal"),
    "start": re.compile(r"start"),
    "end": re.compile(r"end"),
    "behavior": re.compile(r"behaviou?r"),
    "duration": re.compile(r".*duration.*"),
}


def _header_columns(file: str, header: str) -> dict[str, int]:
    """Positions of the fields in one header line, and its width."""
    names = [c.strip().strip('"').lower() for c in header.lstrip("\ufeff").split(",")]
    at = {field: [i for i, c in enumerate(names) if look.fullmatch(c)] for field, look in BOUT_FIELDS.items()}
    wrong = [f"{f} ({len(p)} columns)" for f, p in at.items() if not p or (f == "duration" and len(p) > 1)]
    if wrong:
        raise ValueError(f"{file}: the header {names} does not settle {', '.join(wrong)}")
    return {**{f: p[0] for f, p in at.items()}, "_width": len(names)}


def read_bouts(spark: SparkSession, path: str, session_type: str, strict: bool = True) -> DataFrame:
    """Bouts of every CSV file of one session folder.

    The first line of each file stays with its file; only the different headers come to the driver,
    where their column positions are worked out. All files are then read as one table of lines; a
    line equal to its file's header is no bout.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("at"),
    )
    heads = lines.filter("block = 0").groupBy("file").agg(F.min(F.struct("at", "value")).alias("h"))
    heads = heads.select("file", F.rtrim(F.col("h.value"), F.lit("\r")).alias("header"))
    different = heads.groupBy("header").agg(F.min("file").alias("file")).collect()
    if not different:
        raise FileNotFoundError(f"no CSV files in {path}")
    places = {r["header"]: _header_columns(os.path.basename(r["file"]), r["header"]) for r in different}
    width = max(p["_width"] for p in places.values())
    of_header = F.create_map(
        *[c for h, p in places.items() for c in (F.lit(h), F.struct(*[F.lit(p[f]).alias(f) for f in BOUT_FIELDS]))]
    )
    parsed = F.from_csv(F.rtrim(F.col("value"), F.lit("\r")), ", ".join(f"c{i} string" for i in range(width)))
    rows = (
        lines.join(heads, "file")
        .filter((F.rtrim(F.col("value"), F.lit("\r")) != F.col("header")) & (F.trim("value") != ""))
        .select(parsed.alias("_c"), F.element_at(of_header, F.col("header")).alias("_p"))
        .select(F.array(*[F.col(f"_c.c{i}") for i in range(width)]).alias("_c"), "_p")
    )
    col = {f: F.get(F.col("_c"), F.col(f"_p.{f}")) for f in BOUT_FIELDS}
    return rows.select(
        ids.strip_suffix(col["animal"]).alias("animal_id"),
        F.lit(session_type).alias("session_type"),
        ids.parse_behaviour(col["behavior"], F.lit(session_type), strict).alias("_b"),
        ids.hms_to_sec(col["start"]).alias("start_sec"),
        ids.hms_to_sec(col["end"]).alias("end_sec"),
        col["duration"].try_cast("double").alias("duration_sec"),
    ).select("animal_id", "session_type", "_b.behavior", "_b.actor", "_b.target", "start_sec", "end_sec", "duration_sec")


# ---------------------------------------------------------------- markers


_MARKERS = """
    Image_Properties STRUCT<X_Calibration: STRING>,
    Marker_Data STRUCT<Marker_Type: ARRAY<STRUCT<Name: STRING, Marker: ARRAY<STRUCT<MarkerX: STRING, MarkerY: STRING>>>>>,
    _corrupt_record STRING
"""


def _marker_files(spark: SparkSession, path: str) -> DataFrame:
    parsed = F.from_xml("value", _MARKERS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return _whole_files(spark, path, "*.xml").select("path", parsed.alias("d"))


def read_marker_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per marker of a known class: path, image_id, calibration, marker, x, y.

    Unreadable files and unknown classes give no rows; see :func:`unreadable_markers`.
    """
    return (
        _marker_files(spark, path)
        .select(
            "path",
            ids.image_id(_file_name(F.col("path"))).alias("image_id"),
            F.col("d.Image_Properties.X_Calibration").try_cast("double").alias("calibration_um_per_px"),
            F.explode("d.Marker_Data.Marker_Type").alias("t"),
        )
        .select("path", "image_id", "calibration_um_per_px", ids.marker_class(F.col("t.Name")).alias("marker"), F.explode("t.Marker").alias("m"))
        .filter(F.col("marker").isNotNull())
        .select(
            "path", "image_id", "calibration_um_per_px", "marker",
            F.col("m.MarkerX").try_cast("double").alias("x"), F.col("m.MarkerY").try_cast("double").alias("y"),
        )
    )


def marker_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration of every readable file, also of those without markers."""
    return (
        _marker_files(spark, path)
        .filter(F.col("d._corrupt_record").isNull() & F.col("d.Marker_Data.Marker_Type").isNotNull())
        .select(
            ids.image_id(_file_name(F.col("path"))).alias("image_id"),
            F.col("d.Image_Properties.X_Calibration").try_cast("double").alias("calibration_um_per_px"),
        )
    )


def unreadable_markers(spark: SparkSession, path: str) -> DataFrame:
    return _marker_files(spark, path).filter(
        F.col("d._corrupt_record").isNotNull() | F.col("d.Marker_Data.Marker_Type").isNull()
    ).select("path")


# ---------------------------------------------------------------- regions and objects


_FEATURE = "STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>>"


def _polygons(feature: Column) -> Column:
    """Array of polygons (each an array of rings) of one feature; other types give NULL."""
    kind, text = feature["geometry"]["type"], feature["geometry"]["coordinates"]
    one = "array<array<array<double>>>"
    return F.when(kind == "Polygon", F.array(F.from_json(text, one))).when(
        kind == "MultiPolygon", F.from_json(text, f"array<{one}>")
    )


def read_roi_geojson(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """One row per polygon (path, image_id, rings) of FeatureCollection files, also of those in zip bundles."""
    return (
        _whole_files(spark, path, "*.geojson", bundled)
        .select("path", F.from_json("value", f"STRUCT<features: ARRAY<{_FEATURE}>>").alias("d"))
        .select("path", F.explode("d.features").alias("f"))
        .select(
            "path", ids.image_id(_file_name(F.col("path"))).alias("image_id"), F.explode(_polygons(F.col("f"))).alias("rings")
        )
    )


def read_bundled_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines (path, value) of the members of zip bundles; a member of any size is read as a stream."""
    return read_archives(spark, "text_bundle", path, lines="true")


def roi_areas(polygons: DataFrame, calibration: DataFrame, holes: bool = False) -> DataFrame:
    """Area per image in square micrometres; NULL where the calibration is unknown."""
    return (
        polygons.withColumn("px2", polygon_area(F.col("rings"), 1.0, holes))
        .groupBy("image_id")
        .agg(F.sum("px2").alias("px2"))
        .join(calibration, "image_id", "left")
        .select("image_id", (F.col("px2") * F.pow(F.col("calibration_um_per_px"), F.lit(2.0))).alias("roi_area_um2"))
    )


def read_object_geojson(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Cell objects (prefix, marker, ord, x, y) of files ``<prefix>_<class>objects.geojson``.

    A file is a bare list of features, or one feature per line. Images lacking
    either channel are left out. Coordinates are object centroids in pixels.
    """
    name = _file_name(F.col("path"))
    pattern = r"^(.*)_(GFP|cFOS)objects\.geojson$"
    files = _whole_files(spark, path, "*objects.geojson", bundled).select(
        F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).alias("marker"), "value"
    ).filter(F.col("marker") != "")
    both = files.groupBy("prefix").agg(F.countDistinct("marker").alias("n")).filter("n = 2").select("prefix")
    whole = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = F.concat(F.lit("["), F.array_join(F.split(whole, r"\r?\n"), ","), F.lit("]"))
    text = F.when(whole.startswith("["), whole).otherwise(lines)
    return (
        files.join(both, "prefix", "left_semi")
        .select("prefix", "marker", F.posexplode(F.from_json(text, f"ARRAY<{_FEATURE}>")).alias("ord", "f"))
        .withColumn("ring", F.get(F.get(_polygons(F.col("f")), F.lit(0)), F.lit(0)))
        .withColumn("c", ring_centroid(F.col("ring")))
        .select("prefix", "marker", "ord", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    )


# ---------------------------------------------------------------- tables


def read_auto_counts(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """Automatic counts with their image_id and cohort. A missing file is an error."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        ids.image_id(F.col("Image")).alias("image_id"),
        F.lit(cohort).alias("cohort"),
        *[F.col(c).try_cast("double").alias(out) for c, out in (("GFP_only", "auto_a_only"), ("cFOS_only", "auto_b_only"), ("Double_positive", "auto_both"))],
    )


def read_mirror_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select("image_id", F.col("base_side").try_cast("int").alias("base_side"))


_MANIFEST = "MAP<STRING, STRUCT<status: STRING, segments: ARRAY<STRUCT<start_frame: BIGINT, video: STRING, shards: STRING>>>>"
_ANNOTATIONS = "MAP<STRING, STRUCT<start_frame: BIGINT, points: ARRAY<ARRAY<DOUBLE>>>>"


def read_segment_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment (video_id, status, start_frame, video, shards, merged); a video without any keeps one."""
    whole = spark.read.text(path, wholetext=True)
    return (
        whole.select(F.explode(F.from_json("value", _MANIFEST)).alias("video_id", "d"))
        .select("video_id", "d.status", (F.col("d.status") == "merged").alias("merged"), F.explode_outer("d.segments").alias("s"))
        .select("video_id", "status", "merged", "s.start_frame", "s.video", "s.shards")
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per click (video_id, start_frame, obj_id, x, y)."""
    whole = spark.read.text(path, wholetext=True)
    return (
        whole.select(F.explode(F.from_json("value", _ANNOTATIONS)).alias("video_id", "d"))
        .select("video_id", "d.start_frame", F.explode_outer("d.points").alias("p"))
        .select("video_id", "start_frame", F.get("p", F.lit(0)).cast("int").alias("obj_id"), F.get("p", F.lit(1)).alias("x"), F.get("p", F.lit(2)).alias("y"))
    )


def list_images(spark: SparkSession, path: str, contains: Sequence[str] = (), glob: str = "*.tif*") -> DataFrame:
    """Image paths and names holding any of the substrings; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        .select("path", _file_name(F.col("path")).alias("name"))
    )
    if not contains:
        return files
    cond = F.lit(False)
    for text in contains:
        cond = cond | F.col("name").contains(text)
    return files.filter(cond)


# ---------------------------------------------------------------- archives


def read_mask_shards(spark: SparkSession, path: str | Sequence[str], keys_only: bool = False) -> DataFrame:
    """Mask rows (path, frame_id, obj_id, h, w, packed, is_gap) of ``shard_*.npz`` archives.

    Filters on frame_id and obj_id reach the archives: other members are not read. With
    ``keys_only`` just (path, frame_id, obj_id) is made from the archives' directories, for
    censuses of large folders.
    """
    return read_archives(spark, "mask_archive", path, keysOnly=str(keys_only).lower())


def read_centroids(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Centroid rows (path, obj_id, frame_id, x, y); later paths win per object and frame in one run.

    Empty arrays give no rows and frame numbers are rounded to integers.
    """
    return read_archives(spark, "centroid_archive", path)


def latest_centroids(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """One centroid per object and frame: the one of the last path."""
    return (
        rows.groupBy(*key, "obj_id", "frame_id")
        .agg(F.max_by(F.struct("x", "y"), "path").alias("_p"))
        .select(*key, "obj_id", "frame_id", "_p.x", "_p.y")
    )
