"""Session construction and the shared-folder checkpoint."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side of a few narrow columns stays in the tens of megabytes below this.
BROADCAST_ROWS = 1_000_000


def get_spark(app: str = "etholith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here is written for.

    Adaptive execution does the sizing: it coalesces small shuffle partitions,
    splits skewed join partitions, and turns a shuffled join into a broadcast
    one only after it has measured the small side.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    A session in one process (``local[n]``) that names none gets a folder of its own, removed at
    its end. On a cluster a missing setting is an error: a machine-local folder would be lost on
    the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="etholith-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly per-row work, where the input came in fewer pieces.

    A no-op for inputs with many splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(stored: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast if counting shows few enough of them.

    For frames that are already written (see :func:`cut_lineage`), where a count
    is cheap. Above the limit the join is an ordinary shuffled one.
    """
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored
