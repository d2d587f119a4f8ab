"""Structured Streaming forms of four batch operators.

Each one equals its batch form on the rows the watermark lets through: rows that
arrive later than the watermark are dropped by the engine. A source that has come
to its end is closed by a marker event (:func:`run_to_close`).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from etholith.functions.ids import run_priority
from etholith.session import shared_dir


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a stream's output and checkpoint."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _run(stream: DataFrame, folder: str) -> None:
    """An append stream over what is there now, as Parquet."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """The output of an append stream over what is there now; windows still open at the end are not in it."""
    folder = run_folder(stream.sparkSession, name)
    _run(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_close(source: DataFrame, windows: Callable[[DataFrame], DataFrame], marker: DataFrame, name: str) -> DataFrame:
    """All windows of a source that has come to its end, each event read once.

    ``marker`` has the columns of ``source`` and one row whose time lies beyond every event by more
    than the watermark's delay. It arrives through a second source of the same query after the events:
    the watermark moves past them and the engine closes what is open. The marker's own window never
    closes, so it is in no output. The marker comes twice, as a watermark holds from the next batch on.
    """
    spark = source.sparkSession
    folder = run_folder(spark, name)
    marks = f"{folder}/marks"
    marker.limit(0).write.parquet(marks)
    stream = windows(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))
    _run(stream, folder)
    for _ in range(2):
        marker.write.mode("append").parquet(marks)
        _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def binned_time(bouts: DataFrame, ts: str, width: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """Time per behaviour and tumbling bin, each bout cut at the bin borders.

    ``bouts`` streams with the start time in column ``ts`` and ``duration_sec``.
    A bin is written once the watermark has passed its end.
    """
    start = F.col(ts)
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("duration_sec") * 1e6).cast("long"))
    step = F.expr(f"INTERVAL {width}")
    micros = F.lit(1e6)
    # Every bin the bout touches: whole steps from the bin of its start.
    first = F.window(start, width)["start"]
    pieces = bouts.withColumns({"_end": end, "_bin": F.explode(F.sequence(first, end, step))})
    from_us = F.greatest(F.unix_micros(start), F.unix_micros("_bin"))
    to_us = F.least(F.unix_micros("_end"), F.unix_micros(F.col("_bin") + step))
    overlap = (to_us - from_us) / micros
    return (
        pieces.withColumn("dur_in_bin", overlap)
        .filter(F.col("dur_in_bin") > 0)
        .withWatermark("_bin", delay)
        .groupBy(F.window("_bin", width).alias("_w"), "behavior")
        .agg(F.sum("dur_in_bin").alias("dur_in_bin"), F.count(F.lit(1)).alias("n_pieces"))
        .select(F.col("_w.start").alias("bin_start"), "behavior", "dur_in_bin", "n_pieces")
    )


def merge_runs(runs: DataFrame, folder: str, key: Sequence[str] = ("animal_id", "frame_id")) -> DataFrame:
    """Running priority merge: the table of winning runs after all available batches.

    The best run of each key is kept in the state of a streaming aggregate; a batch writes the keys it
    has touched, named by the batch, so a batch that is retried writes the same again and none reads or
    rewrites what earlier ones wrote. A late run of higher priority replaces a lower one.
    """
    key = list(key)
    ranked = runs.select(*key, F.struct(run_priority(F.col("run_name")).alias("p"), "run_name").alias("best"))
    best = ranked.filter(F.col("best.p").isNotNull()).groupBy(*key).agg(F.max("best").alias("best"))

    runs.sparkSession.createDataFrame([], best.schema).write.mode("overwrite").parquet(f"{folder}/table/batch=-1")  # so that there is a table

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = (
        best.writeStream.foreachBatch(append)
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return standing_runs(runs.sparkSession, folder, best.schema, key)


def standing_runs(spark: SparkSession, folder: str, schema: StructType, key: Sequence[str]) -> DataFrame:
    """The winning run per key from all changes of :func:`merge_runs`; a change is never worse than the one before."""
    changes = spark.read.schema(schema).parquet(f"{folder}/table")
    return changes.groupBy(*key).agg(F.max("best").alias("best")).select(*key, "best.run_name")


def swap_zones(flagged: DataFrame, ts: str, by: Sequence[str], gap: str, min_len: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Zones of flagged events: sessions closed by ``gap``, with ``min_len`` events or more."""
    return (
        flagged.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("_s"), *by)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .filter(F.col("n_events") >= min_len)
        .select(*by, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "n_events")
    )


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def column_family_store(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which stateful processors with several variables need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


LATENCY_OUT = StructType(
    [
        StructField("animal_id", LongType()),
        StructField("session_type", StringType()),
        StructField("first_us", LongType()),
        StructField("first_behavior", StringType()),
        StructField("censored", BooleanType()),
        StructField("at", TimestampType()),
    ]
)


class FirstContact(StatefulProcessor):
    """Earliest qualifying event per key; the timer at the session end fires once.

    Rows carry ``us``, ``ord`` and ``behavior`` where they qualify, else NULLs. State is one small row
    per key, whatever the number of events; it is read once and written at most once a batch.
    """

    def __init__(self, end_ms: int):
        self._end_ms = end_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        schema = StructType([StructField("us", LongType()), StructField("ord", LongType()), StructField("behavior", StringType())])
        self._first = handle.getValueState("first", schema)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803 - Spark API
        if timerValues.getCurrentWatermarkInMs() >= self._end_ms:  # the session is reported; late rows leave no state
            return
        known = self._first.get()
        best = (None, None, None) if known is None else tuple(known)
        for row in rows:
            if row["us"] is not None and (best[0] is None or (row["us"], row["ord"]) < best[:2]):
                best = (row["us"], row["ord"], row["behavior"])
        if known is None:
            self._handle.registerTimer(self._end_ms)
        if known is None or best != tuple(known):
            self._first.update(best)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803 - Spark API
        us, _, behavior = self._first.get()
        yield Row(animal_id=key[0], session_type=key[1], first_us=us, first_behavior=behavior, censored=us is None, at=datetime.fromtimestamp(self._end_ms / 1000, timezone.utc))
        self._first.clear()

    def close(self) -> None:
        pass


def first_contact(bouts: DataFrame, ts: str, end_ms: int, qualifying: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First qualifying bout up to the session end per animal and session, or a censored row.

    ``bouts`` streams animal_id, session_type, behavior, ``us`` (event micros)
    and ``ord``. Keys are only known once they have shown any bout. Run it inside
    :func:`column_family_store`.
    """
    hit = F.col("behavior").isin(*qualifying) & (F.col("us") <= end_ms * 1000)
    return (
        bouts.withWatermark(ts, delay)
        .select("animal_id", "session_type", ts, *[F.when(hit, F.col(c)).alias(c) for c in ("us", "ord", "behavior")])
        .groupBy("animal_id", "session_type")
        .transformWithState(
            statefulProcessor=FirstContact(end_ms),
            outputStructType=LATENCY_OUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
