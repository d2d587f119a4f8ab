"""Writers of result tables, masks, objects and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etholith.operators.aggregates import cleanup_summary
from etholith.operators.frames import gaps
from etholith.operators.ordered import null_safe_join
from etholith.operators.tracking import removed_details
from etholith.operators.windows import shard_of
from etholith.sources.archives import register

FRAMES_PER_SHARD = 500


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each named table below ``folder``."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")


def write_mask_shards(
    masks: DataFrame, folder: str, key: Sequence[str] = ("animal",), frames_per_shard: int = FRAMES_PER_SHARD
) -> None:
    """Masks as Parquet partitioned by key and shard of so many present frames.

    The shard column lets a frame cutoff prune whole folders.
    """
    key = list(key)
    shards = shard_of(masks, key, frames_per_shard).select(*key, "frame_id", "shard")
    (
        masks.join(shards, [*key, "frame_id"])
        .repartition(*key, "shard")
        .sortWithinPartitions(*key, "shard", "frame_id")
        .write.mode("overwrite")
        .partitionBy(*key, "shard")
        .parquet(folder)
    )


def write_mask_archives(
    masks: DataFrame, folder: str, key: Sequence[str] = ("animal",), frames_per_shard: int = FRAMES_PER_SHARD, run: Column | None = None
) -> None:
    """Masks (frame_id, obj_id, h, w, packed, optionally is_gap) as ``shard_*.npz`` of so many present frames.

    ``run`` names the folder of a row's key (default: the key's values joined by ``_``, and
    ``_merged_shards``). An archive is written by one task, row by row.
    """
    key = list(key)
    run = F.concat(F.concat_ws("_", *[F.col(c).cast("string") for c in key]), F.lit("_merged_shards")) if run is None else run
    shards = shard_of(masks, key, frames_per_shard).select(*key, "frame_id", "shard")
    name = F.concat(run, F.lit("/shard_"), F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit(".npz"))
    gap = [F.coalesce("is_gap", F.lit(False)).alias("is_gap")] if "is_gap" in masks.columns else []
    rows = null_safe_join(masks, shards, [*key, "frame_id"]).select(
        name.alias("archive"), F.col("frame_id").cast("long"), F.col("obj_id").cast("int"), F.col("h").cast("int"), F.col("w").cast("int"), "packed", *gap
    )
    register(masks.sparkSession)
    rows.repartition("archive").sortWithinPartitions("archive", "frame_id", "obj_id").write.format("mask_archive").mode("overwrite").save(folder)


def write_centroid_archives(centroids: DataFrame, folder: str, key: Sequence[str] = ("animal",), run: Column | None = None) -> None:
    """Centroids (obj_id, frame_id, x, y) as one ``centroids.npz`` per key, an array of (frame, x, y) per object."""
    key = list(key)
    run = F.concat(F.concat_ws("_", *[F.col(c).cast("string") for c in key]), F.lit("_merged_shards")) if run is None else run
    sizes = centroids.groupBy(*key, "obj_id").agg(F.count(F.lit(1)).alias("n"))
    rows = null_safe_join(centroids, sizes, [*key, "obj_id"]).select(
        F.concat(run, F.lit("/centroids.npz")).alias("archive"), F.col("obj_id").cast("int"), F.col("frame_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), "n"
    )
    register(centroids.sparkSession)
    rows.repartition("archive").sortWithinPartitions("archive", "obj_id", "frame_id").write.format("centroid_archive").mode("overwrite").save(folder)


#: Objects of one class and image that a file holds, about.
OBJECTS_PER_FILE = 50_000
#: Members and lines of a bundle, about.
MEMBERS_PER_BUNDLE = 5_000
LINES_PER_BUNDLE = 500_000


def _feature(marker: str) -> Column:
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"),
            F.struct(F.struct(F.col(marker).alias("name")).alias("classification")).alias("properties"),
        )
    )


def write_objects_by_image(objects: DataFrame, folder: str, image: str = "image_id", marker: str = "marker", bundled: bool = False) -> None:
    """Objects as GeoJSON features, one per line, in a folder per class and image.

    ``ring`` holds the outline. Lines, not one list per image, so that an image
    of any size is written by many tasks, as many as its number of objects asks for. Images without
    objects get no folder. ``bundled`` puts the folders, with their files, into zip archives
    (:func:`write_bundled_lines`), for so many images that making the folders would be most of the work.
    """
    lines = objects.select(F.col(marker).alias("class"), F.col(image).alias("image"), _feature(marker).alias("value"), F.xxhash64("ring").alias("_hash"))
    files = F.ceil(F.count(F.lit(1)) / OBJECTS_PER_FILE).alias("_files")
    sized = null_safe_join(lines, lines.groupBy("class", "image").agg(files), ["class", "image"])
    piece = F.pmod("_hash", "_files")  # the outline's hash: sizes are told without making any text
    if bundled:
        escaped = [F.concat(F.lit(f"{c}="), F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))) for c in ("class", "image")]
        member = F.concat_ws("/", *escaped, F.concat(F.lit("part-"), piece.cast("string"), F.lit(".txt")))
        write_bundled_lines(sized.select(member.alias("archive"), "value"), folder, [])
        return
    spread = sized.repartition("class", "image", piece).drop("_files", "_hash")
    spread.write.mode("overwrite").partitionBy("class", "image").text(folder)


def write_lines(lines: DataFrame, folder: str, order: Sequence[str]) -> None:
    """Text files named by the column ``archive``, each holding its ``value`` lines in this order.

    A file is written by one task, line by line; the number of files is not bounded.
    """
    register(lines.sparkSession)
    rows = lines.repartition("archive").sortWithinPartitions("archive", *order).select("archive", "value")
    rows.write.format("named_text").mode("overwrite").save(folder)


def write_bundled_lines(lines: DataFrame, folder: str, order: Sequence[str]) -> None:
    """As :func:`write_lines`, for very many small files: they become members of ``bundle-*.zip`` archives.

    ``archive`` is the name of a member. A bundle holds about ``MEMBERS_PER_BUNDLE`` members and ``LINES_PER_BUNDLE``
    lines and is written by one task; their number follows from both counts.
    """
    register(lines.sparkSession)
    sized = lines.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
    bundles = max(-(-sized["members"] // MEMBERS_PER_BUNDLE), -(-sized["lines"] // LINES_PER_BUNDLE), 1)
    place = F.pmod(F.xxhash64("archive"), F.lit(bundles))
    named = lines.withColumns({"member": F.col("archive"), "archive": F.concat(F.lit("bundle-"), F.lpad(place.cast("string"), 10, "0"), F.lit(".zip"))})
    rows = named.repartition("archive").sortWithinPartitions("archive", "member", *order).select("archive", "member", "value")
    rows.write.format("text_bundle").mode("overwrite").save(folder)


def write_object_files(objects: DataFrame, folder: str, image: str = "image_id", marker: str = "marker", bundled: bool = False) -> None:
    """One ``<image>_<class>objects.geojson`` per image and class that has objects, a feature per line.

    ``ring`` holds the outline. For images too large for one writing task there is
    :func:`write_objects_by_image`. ``bundled`` writes the files into zip archives (:func:`write_bundled_lines`).
    """
    name = F.concat(F.col(image), F.lit("_"), F.col(marker), F.lit("objects.geojson"))
    write = write_bundled_lines if bundled else write_lines
    write(objects.select(name.alias("archive"), _feature(marker).alias("value")), folder, ["value"])


def write_cleanup_report(cleaned: DataFrame, folder: str, subjects: Sequence[str], keys: Sequence[str], subject: str = "subject_corrected") -> None:
    """The two report tables: summary and removed details."""
    summary = cleanup_summary(cleaned, subjects, subject=subject).orderBy(
        (F.col("joint") == "TOTAL"), F.col("pct_removed_all").desc(), "joint"
    )
    details = removed_details(cleaned, keys, subject).orderBy(*keys, "subject", "joint")
    write_tables({"summary": summary, "removed_details": details}, folder, "csv")


def write_gap_report(frames: DataFrame, folder: str, key: Sequence[str]) -> None:
    """Gaps (start, end_exclusive, n_frames) as JSON lines."""
    gaps(frames, key).write.mode("overwrite").json(folder)


def write_colocalisation(counts: DataFrame, folder: str, image: str = "image_id") -> None:
    """The per-image colocalisation table with its header."""
    counts.select(
        F.col(image).alias("Image"), F.col("gfp_only").alias("GFP_only"), F.col("cfos_only").alias("cFOS_only"),
        F.col("double_positive").alias("Double_positive"), F.col("total_gfp").alias("Total_GFP"), F.col("total_cfos").alias("Total_cFOS"),
    ).write.mode("overwrite").option("header", True).csv(folder)
