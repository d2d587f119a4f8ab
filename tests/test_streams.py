"""Streams over small folders of files, several batches each."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from etholith.streaming import bouts as ST


def test_merge_keeps_the_best_run_and_writes_own_rows(spark, tmp_path):
    schema = "animal_id long, frame_id long, run_name string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert ST.merge_runs(stream(), folder).count() == 0
    batches = [
        [(1, 1, "resume2"), (1, 2, "output"), (2, 1, "resume"), (2, 2, "other"), (None, 3, "output")],
        [(1, 1, "output"), (2, 1, "resume1"), (2, 1, "output")],
        [(1, 2, "resume3")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        table = ST.merge_runs(stream(), folder)
    got = {(r.animal_id, r.frame_id): r.run_name for r in table.collect()}
    assert got == {(1, 1): "resume2", (1, 2): "resume3", (2, 1): "resume1", (None, 3): "output"}
    written = spark.read.parquet(f"{folder}/table").groupBy("batch").count().collect()
    assert max(r["count"] for r in written) <= 4 and sum(r["count"] for r in written) <= 7


def test_marker_closes_what_is_open(spark, tmp_path):
    source = str(tmp_path / "in")
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), a) for m, a in ((0, 1), (5, 1), (100, 1), (101, 1), (102, 2), (103, 2), (104, 2))]
    events = spark.createDataFrame(rows, "at timestamp, animal_id long")
    events.coalesce(1).write.parquet(source)
    windows = lambda e: ST.swap_zones(e, "at", ["animal_id"], "10 minutes", 2)
    marker = spark.createDataFrame([(dt.datetime(2100, 1, 1), 1)], "at timestamp, animal_id long")
    stream = spark.readStream.schema(events.schema).parquet(source)
    got = sorted((r.animal_id, r.start, r.n_events) for r in ST.run_to_close(stream, windows, marker, "zones").collect())
    assert got == [(1, base, 2), (1, base + dt.timedelta(minutes=100), 2), (2, base + dt.timedelta(minutes=102), 3)]
    assert sorted((r.animal_id, r.start, r.n_events) for r in windows(events).collect()) == got
    open_ones = ST.drain(windows(stream), "drained")  # without the end only the first is closed
    assert open_ones.select(F.min("start")).first()[0] == base and open_ones.count() == 1


def test_first_contact_reads_and_writes_its_state_once_a_batch():
    from collections import Counter

    calls, kept = Counter(), {}

    class State:
        def get(self):
            calls["get"] += 1
            return kept.get("row")

        def update(self, row):
            calls["update"] += 1
            kept["row"] = row

        def clear(self):
            kept.clear()

    class Handle:
        def getValueState(self, *_):  # noqa: N802 - Spark API
            calls["states"] += 1
            return State()

        def registerTimer(self, at):  # noqa: N802 - Spark API
            calls[f"timer {at}"] += 1

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802 - Spark API
            return self.ms

    processor = ST.FirstContact(1_000)
    processor.init(Handle())

    def batch(*rows, at=0):
        return list(processor.handleInputRows((1, "S1"), iter([Row(us=u, ord=o, behavior=b) for u, o, b in rows]), Now(at)))

    assert batch((None, None, None)) == [] and kept["row"] == (None, None, None)
    assert batch((7, 3, "b"), (7, 2, "a"), (9, 1, "c")) == [] and kept["row"] == (7, 2, "a")
    assert batch((8, 1, "c"), (None, None, None)) == [] and kept["row"] == (7, 2, "a")
    assert batch((1, 1, "late"), at=1_000) == []
    assert calls == {"states": 1, "get": 3, "update": 2, "timer 1000": 1}
    (out,) = processor.handleExpiredTimer((1, "S1"), Now(1_000), None)
    assert (out.animal_id, out.session_type, out.first_us, out.first_behavior, out.censored, out.at.timestamp()) == (1, "S1", 7, "a", False, 1.0)
    assert not kept
