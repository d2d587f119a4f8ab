"""Queries of the streaming forms, each drained over the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from etholith import views as V
from etholith.plans.register import R, query, rd
from etholith.streaming import bouts as ST


def event_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def last_event(spark, d):
    """An event far beyond all others, that closes the windows before it."""
    far = {"ts": F.lit("2200-01-01 00:00:00"), "value": F.lit(100.0), "event_type": F.lit("end"), "user_id": F.lit(0), "event_id": F.lit(-1)}
    schema = V.table(spark, d, "events").schema
    return spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@query(
    "stream_binned_time",
    f"""WITH b AS (SELECT event_type AS behavior, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1e6) AS BIGINT) AS e FROM events),
        p AS (SELECT behavior, s, e, unnest(range(s // 30000000, e // 30000000 + 1)) * 30000000 AS bin FROM b),
        o AS (SELECT behavior, bin, least(e, bin + 30000000) - greatest(s, bin) AS us FROM p)
        SELECT bin AS bin_us, behavior, {R('sum(us) / 1e6')} AS dur_in_bin, count(*) AS n_pieces FROM o WHERE us > 0 GROUP BY 1, 2""",
)
def stream_binned_time(spark, d):
    def binned(events):
        bouts = events.select(F.col("ts").cast("timestamp").alias("start"), F.col("event_type").alias("behavior"), F.col("value").alias("duration_sec"))
        return ST.binned_time(bouts, "start")

    out = ST.run_to_close(event_stream(spark, d), binned, last_event(spark, d), "binned-time")
    return out.select(F.unix_micros("bin_start").alias("bin_us"), "behavior", rd("dur_in_bin").alias("dur_in_bin"), "n_pieces")


@query(
    "stream_merge_runs",
    """SELECT animal_id, frame_id, arg_max(run_name, CASE run_name WHEN 'output' THEN 0 WHEN 'resume' THEN 1 WHEN 'resume2' THEN 2 ELSE 3 END) AS run_name
        FROM runs GROUP BY 1, 2""",
    "runs",
)
def stream_merge_runs(spark, d):
    runs = V.runs_from(event_stream(spark, d))
    return ST.merge_runs(runs, ST.run_folder(spark, "merge-runs"))


@query(
    "stream_swap_zones",
    """WITH f AS (SELECT user_id % 20 AS animal_id, epoch_us(ts) AS t FROM events WHERE value > 20),
        g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY animal_id ORDER BY t)),
        z AS (SELECT *, sum(fresh) OVER (PARTITION BY animal_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT animal_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n_events FROM z GROUP BY animal_id, k
        HAVING count(*) >= 2""",
)
def stream_swap_zones(spark, d):
    def zones(events):
        flagged = events.filter("value > 20").select(F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 20).alias("animal_id"))
        return ST.swap_zones(flagged, "at", ["animal_id"], "30 minutes")

    out = ST.run_to_close(event_stream(spark, d), zones, last_event(spark, d), "swap-zones")
    return out.select("animal_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


END_US = 1_704_067_200_000_000 + 10 * 86_400_000_000  # ten days after the first event
QUALIFYING = ("click_0", "error_3")


@query(
    "stream_first_contact",
    f"""WITH e AS (SELECT *, CAST(round(start_sec * 1e6) AS BIGINT) + 1704067200000000 AS us FROM bouts),
        k AS (SELECT animal_id, session_type, min(us) FILTER (behavior IN ('click_0', 'error_3') AND us <= {END_US}) AS first_us,
          arg_min(behavior, us) FILTER (behavior IN ('click_0', 'error_3') AND us <= {END_US}) AS first_behavior FROM e GROUP BY 1, 2)
        SELECT animal_id, session_type, first_us, first_behavior, first_us IS NULL AS censored FROM k""",
    "bouts",
)
def stream_first_contact(spark, d):
    events = event_stream(spark, d)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    bouts = events.select(
        F.col("user_id").alias("animal_id"),
        F.when(F.col("event_id") % 2 == 0, "S1").otherwise("S2").alias("session_type"),
        F.concat_ws("_", "event_type", (k % 4).cast("string")).alias("behavior"),
        us.alias("us"),
        F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    with ST.column_family_store(spark):
        out = ST.drain(ST.first_contact(bouts, "at", END_US // 1000, QUALIFYING), "first-contact")
    return out.select("animal_id", "session_type", "first_us", "first_behavior", "censored")
