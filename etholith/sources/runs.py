"""Run discovery from folder and file names, and the start-frame side file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etholith.functions.ids import run_of_folder

VIDEO_MARKER = "_app_output"
SHARDS_MARKER = "_app_shards"


def discover_runs(paths: DataFrame, path: str = "path", marker: str = VIDEO_MARKER) -> DataFrame:
    """Rows (animal, run_name, start_frame, path) of the usable runs among ``paths``.

    The base run starts at 0. A resumed video without a start in its name is
    left out, and so is every run of an animal that has no base run. Shard
    folders carry their frames in the data and need no start. Names are parsed
    once, and the runs of an animal meet in one exchange.
    """
    name = F.element_at(F.split(F.regexp_replace(F.col(path), "/+$", ""), "/"), -1)
    parsed = (
        paths.select(F.col(path).alias("path"), F.inline(F.array(run_of_folder(name, marker))).alias("animal", "run_name", "start_frame"))
        .filter(F.col("animal").isNotNull())
        .withColumn("start_frame", F.when(F.col("run_name") == "output", F.lit(0).cast("long")).otherwise(F.col("start_frame")))
        .select("animal", "run_name", "start_frame", "path")
    )
    if marker == VIDEO_MARKER:
        parsed = parsed.filter(F.col("start_frame").isNotNull())
    based = F.max(F.col("run_name") == "output").over(Window.partitionBy("animal"))
    return parsed.withColumn("_based", based).filter("_based").drop("_based")


def read_start_frames(spark: SparkSession, path: str) -> DataFrame:
    """``run frame`` lines of a side file; comments and malformed lines are skipped."""
    parts = F.split(F.trim(F.regexp_replace("value", ",", " ")), r"\s+")
    return (
        spark.read.text(path)
        .withColumn("value", F.trim("value"))
        .filter(~F.col("value").startswith("#"))
        .select(parts.alias("p"))
        .filter(F.size("p") == 2)
        .select(F.col("p")[0].alias("run_name"), F.col("p")[1].try_cast("long").alias("listed_start"))
        .filter(F.col("listed_start").isNotNull())
    )
