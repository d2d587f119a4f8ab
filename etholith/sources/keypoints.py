"""Keypoint tables with four header rows (scorer, individuals, bodyparts, coords)."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.functions.ids import title_joint
from etholith.operators.windows import dedupe_prefer_coords
from etholith.session import broadcast_if_small, cut_lineage
from etholith.sources.archives import register

COORDS = ("x", "y", "likelihood")
FRAMES_PER_PART = 50_000


#: First cells of the header rows, in file order.
HEADER_ROWS = ("scorer", "individuals", "bodyparts", "coords")
#: A comma outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
#: What a header row begins with; the cells are compared exactly afterwards.
_HEADER_LINE = f"""^[\\s"]*({'|'.join(HEADER_ROWS)})"""
#: Files whose columns are broadcast to the tasks that read their rows, some kilobytes each.
BROADCAST_FILES = 20_000


def _unquoted(line: Column) -> Column:
    """Trimmed cells of a line, commas inside quotes kept."""
    return F.transform(F.split(line, _COMMA, -1), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))


def _header(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """The four header rows of the first file: an early look, so that a wrong table fails before any work."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).limit(4).collect()
    rows = [next(csv.reader(io.StringIO(r["value"].rstrip("\r")))) for r in text]
    if len(rows) < 4 or tuple(r[0] for r in rows) != HEADER_ROWS:
        raise ValueError(f"{path}: expected the header rows {', '.join(HEADER_ROWS)}")
    return rows


def _columns(lines: DataFrame, individuals: Sequence[str] | None, joints: Sequence[str] | None) -> DataFrame:
    """Per file, which column holds which coordinate of whom: (path, _columns array of subject, joint, x, y, likelihood places)."""
    first = F.get("_cells", F.lit(0))
    heads = lines.filter(F.col("value").rlike(_HEADER_LINE)).select("path", _unquoted(F.col("value")).alias("_cells"))
    heads = heads.filter(first.isin(*HEADER_ROWS)).groupBy("path").agg(
        *[F.max(F.when(first == name, F.col("_cells"))).alias(f"_{name}") for name in HEADER_ROWS[1:]]
    )
    people = F.array_sort(F.array_distinct(F.slice("_individuals", F.lit(2), F.size("_individuals"))))
    if individuals is not None:
        wanted = F.array_sort(F.array(*[F.lit(i) for i in individuals]))
        told = F.concat(F.col("path"), F.lit(f": expected the individuals {sorted(individuals)}, found "), F.array_join(people, ", "))
        heads = heads.withColumn("_individuals", F.when(people == wanted, F.col("_individuals")).otherwise(F.raise_error(told)))
    at = heads.select("path", "_individuals", "_bodyparts", F.posexplode("_coords").alias("_at", "coord")).filter("_at > 0")
    joint = F.get("_bodyparts", F.col("_at"))
    if joints is not None:
        spelling = F.create_map(*[F.lit(v) for j in joints for v in (j.lower(), j)])
        joint = F.try_element_at(spelling, F.lower(joint))
    named = at.select("path", F.get("_individuals", F.col("_at")).alias("subject"), joint.alias("joint"), "coord", "_at").filter("joint IS NOT NULL")
    each = named.groupBy("path", "subject", "joint").agg(*[F.max(F.when(F.col("coord") == c, F.col("_at"))).alias(c) for c in COORDS])
    return each.groupBy("path").agg(F.collect_list(F.struct("subject", "joint", *COORDS)).alias("_columns"))


def read_keypoints_wide(
    spark: SparkSession,
    path: str | Sequence[str],
    individuals: Sequence[str] | None = None,
    joints: Sequence[str] | None = None,
    with_path: bool = False,
) -> DataFrame:
    """Long keypoints (frame_id, subject, joint, x, y, likelihood) of any number of wide files, read at once.

    Every file has its own four header rows and columns in its own order; folders are searched
    recursively. With ``joints`` names are matched without regard to case and take the listed
    spelling; other joints are left out. With ``individuals`` any other set of names in a header is
    an error, as is a file with rows but without header. ``with_path`` adds the file's path.
    """
    _, people, *_ = _header(spark, path)
    if individuals is not None and set(people[1:]) != set(individuals):
        raise ValueError(f"{path}: expected the individuals {sorted(individuals)}, found {sorted(set(people[1:]))}")
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.rtrim("value", F.lit("\r")).alias("value"))
    line = F.col("value")
    cells = F.when(line.contains('"'), _unquoted(line)).otherwise(F.split(line, ",", -1))  # few lines need the costly split
    frame = F.get("_cells", F.lit(0)).try_cast("double").cast("long")
    body = lines.select("path", cells.alias("_cells")).select("path", frame.alias("frame_id"), "_cells").filter("frame_id IS NOT NULL")
    heads = broadcast_if_small(cut_lineage(_columns(lines, individuals, joints).withColumnRenamed("path", "_of")), BROADCAST_FILES)
    body = body.join(heads, F.col("path") == F.col("_of"), "left")
    headless = F.raise_error(F.concat("path", F.lit(": rows without the header rows scorer, individuals, bodyparts, coords")))
    points = F.when(F.col("_of").isNotNull(), F.col("_columns")).otherwise(headless)

    def value(at: str) -> Column:
        return F.nanvl(F.get("_cells", F.col(at)).try_cast("double"), F.lit(None).cast("double"))

    placed = body.select("path", "frame_id", "_cells", F.inline(points).alias("subject", "joint", *[f"_{c}" for c in COORDS]))
    return placed.select(*(["path"] if with_path else []), "frame_id", "subject", "joint", *[value(f"_{c}").alias(c) for c in COORDS])


def to_wide(
    df: DataFrame, key: Sequence[str], individuals: Sequence[str], joints: Sequence[str], subject: str = "subject"
) -> DataFrame:
    """One row per frame with columns ``<individual>_<Joint>_<coord>``, sorted by individual and joint.

    ``df`` has one row per frame, subject and joint (see ``dedupe_prefer_coords``),
    so x, y and likelihood of a cell come from the same row.
    """
    cell = F.struct(*COORDS)
    pairs = [(who, j) for who in sorted(individuals) for j in sorted(joints)]
    wide = df.groupBy(*key).agg(
        *[
            F.max(F.when((F.col(subject) == who) & (F.col("joint") == j), cell)).alias(f"_{i}")
            for i, (who, j) in enumerate(pairs)
        ]
    )

    def title(j: str) -> str:
        return "_".join(t[:1].upper() + t[1:].lower() for t in j.split("_"))

    return wide.select(
        *key,
        *[F.col(f"_{i}.{c}").alias(f"{who}_{title(j)}_{c}") for i, (who, j) in enumerate(pairs) for c in COORDS],
    )


def _titles(df: DataFrame, joints: Sequence[str]) -> dict[str, str]:
    return dict(df.sparkSession.createDataFrame([(j,) for j in joints], "j string").select("j", title_joint(F.col("j"))).collect())


def _header_text(df: DataFrame, scorer: str, individuals: Sequence[str], joints: Sequence[str]) -> str:
    pairs = [(who, j) for who in sorted(individuals) for j in sorted(joints)]
    titles = _titles(df, joints)
    return "\n".join(
        [
            ",".join(["scorer", *[scorer for _ in pairs for _ in COORDS]]),
            ",".join(["individuals", *[who for who, _ in pairs for _ in COORDS]]),
            ",".join(["bodyparts", *[titles[j] for _, j in pairs for _ in COORDS]]),
            ",".join(["coords", *[c for _ in pairs for c in COORDS]]),
        ]
    )


def _line(cells: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells])


def write_keypoints_videos(
    df: DataFrame,
    folder: str,
    scorer: str,
    individuals: Sequence[str],
    joints: Sequence[str],
    video: str = "video_id",
    frames_per_part: int = FRAMES_PER_PART,
    order: Sequence[str] = (),
) -> None:
    """Wide CSV of all videos in one write: ``<video>/part_<n>.csv``, each with the four header rows and frames in order.

    A part holds a fixed stretch of frame numbers, so a long video is written by many tasks. Rows are
    exchanged once, by part. With ``order`` a point that is there more than once is the one
    ``dedupe_prefer_coords`` takes.
    """
    key = [video, "_part", "frame_id"]
    placed = df.withColumn("_part", F.floor(F.col("frame_id") / frames_per_part)).repartition(video, "_part")
    if order:
        placed = dedupe_prefer_coords(placed, [*key, "subject", "joint"], order)
    wide = to_wide(placed, key, individuals, joints).sortWithinPartitions(*key)
    name = F.concat(F.col(video).cast("string"), F.lit("/part_"), F.lpad(F.col("_part").cast("string"), 6, "0"), F.lit(".csv"))
    lines = wide.select(name.alias("archive"), _line(wide.columns[2:]).alias("value"))
    register(df.sparkSession)
    header = _header_text(df, scorer, individuals, joints)
    lines.write.format("named_text").option("header", header).mode("overwrite").save(folder)


def write_keypoints_wide(
    df: DataFrame, path: str, scorer: str, individuals: Sequence[str], joints: Sequence[str], subject: str = "subject", order: Sequence[str] = ()
) -> None:
    """Wide CSV with the four header rows, frames in order.

    Every part file is a valid table of its own: rows are exchanged once, range-partitioned by
    frame, and the header is put before the first row of each part. With ``order`` a point that is
    there more than once is the one ``dedupe_prefer_coords`` takes.
    """
    placed = df.repartitionByRange("frame_id")
    if order:
        placed = dedupe_prefer_coords(placed, ["frame_id", subject, "joint"], order)
    wide = to_wide(placed, ["frame_id"], individuals, joints, subject).sortWithinPartitions("frame_id")
    header = F.lit(_header_text(df, scorer, individuals, joints) + "\n")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # a partition's rows are numbered from 0
    line = _line(wide.columns)
    wide.select(F.concat(F.when(first, header).otherwise(""), line).alias("value")).write.mode("overwrite").text(path)
