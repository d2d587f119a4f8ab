"""Canonical inputs derived from the driver's tables (see FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.session import spread

ORDER_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def bouts_from(events: DataFrame) -> DataFrame:
    sec = _seconds()
    return events.select(
        F.col("event_id").alias("ord"),
        F.col("user_id").alias("animal_id"),
        F.when(F.col("event_id") % 2 == 0, "S1").otherwise("S2").alias("session_type"),
        F.concat_ws("_", "event_type", (_k() % 4).cast("string")).alias("behavior"),
        F.when(_k() % 3 == 0, "exp").when(_k() % 3 == 1, "stim").alias("actor"),
        sec.alias("start_sec"),
        (sec + F.col("value")).alias("end_sec"),
        F.col("value").alias("duration_sec"),
    )


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bouts_from(table(spark, sf_dir, "events"))


RUN_OF_EVENT = {
    "click": "output",
    "view": "resume",
    "signup": "resume2",
    "purchase": "resume3",
    "error": "output",
}


def runs_from(events: DataFrame) -> DataFrame:
    run = F.create_map(*[F.lit(v) for pair in RUN_OF_EVENT.items() for v in pair])
    return events.select(
        F.col("event_id").alias("ord"),
        (F.col("user_id") % 20).alias("animal_id"),
        F.floor(_seconds() / 3600).cast("long").alias("frame_id"),
        (1 + F.col("event_id") % 2).alias("obj_id"),
        F.try_element_at(run, F.col("event_type")).alias("run_name"),
        F.col("value").alias("x"),
        _k().cast("double").alias("y"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from(table(spark, sf_dir, "events"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        F.when(F.col("l_returnflag") == "A", "GFP")
        .when(F.col("l_returnflag") == "R", "cFOS")
        .otherwise("both")
        .alias("marker"),
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 512).alias("x"),
        ((F.col("l_partkey") * 104729 + F.col("l_linenumber") * 17) % 512).alias("y"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_quantity").alias("area"),
        *ORDER_KEY,
    )


def keypoints(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    if spread_out:
        line = spread(line)
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))

    def subject(name: str, dx: Column, dy: Column, lost: Column) -> Column:
        seen = F.col("l_quantity") >= 2
        return F.struct(
            F.lit(name).alias("subject"),
            F.when(seen, (ok * 37) % 512 + ln * 10 + dx).cast("double").alias("x"),
            F.when(seen, (ok * 53) % 512 + ln * 7 + dy).cast("double").alias("y"),
            (1 - 5 * lost).alias("likelihood"),
        )

    both = F.array(
        subject("s1", pk % 41 - 20, sk % 31 - 15, F.col("l_discount")),
        subject("s2", sk % 61 - 30 + 60, pk % 31 - 15, F.col("l_tax")),
    )
    return line.select(
        (ok % 4).alias("video_id"),
        ok.alias("frame_id"),
        ln.alias("joint"),
        F.inline(both),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")

    def of(flag: str) -> Column:
        return F.sum(F.when(F.col("l_returnflag") == flag, qty).otherwise(0.0))

    per_order = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("image_id"))
        .agg(
            F.sum(price).alias("manual_total"),
            F.sum(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("auto_total"),
            of("A").alias("a_only"),
            of("R").alias("b_only"),
            of("N").alias("both_n"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        F.col("o_custkey").alias("animal_id"),
        F.col("o_orderpriority").alias("cohort"),
        F.col("o_totalprice").alias("ref_total"),
    )
    return orders.join(per_order, "image_id")


FILE_SUFFIX = {0: "_LVCC_RAW_final.tif", 1: "_GFPseg.tif", 2: "_cFOSseg.tif", 3: ".tif"}


def files(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    if spread_out:
        customer = spread(customer)
    key = F.col("c_custkey")
    suffix = F.create_map(*[F.lit(v) for pair in FILE_SUFFIX.items() for v in pair])
    stem = F.when(key % 11 == 0, "stray").when(key % 3 == 0, "Count").otherwise("count")
    return customer.select(
        key.alias("ord"),
        F.concat(
            stem,
            (key % 50).cast("string"),
            F.lit("_"),
            (key % 7).cast("string"),
            F.element_at(suffix, (F.col("c_nationkey") % 4).cast("int")),
        ).alias("name"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("stack"),
        F.col("vec_id").alias("z"),
        F.transform(
            "embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int")
        ).alias("pixels"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask per embedding: 8x8, bit ``py*8+px`` in two 32-bit words."""

    def word(first: int) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.when(F.get(F.col("embedding"), i + first) > 0, F.pow(F.lit(2), i))
            .otherwise(0)
            .cast("long"),
        )
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)

    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", F.array(word(0), word(32)).alias("words"))
    )


def packed(words: Column) -> Column:
    """The 8x8 word mask as 8 bytes, one per row, most significant bit first."""
    from etholith.functions.masks import word_bit

    def byte(row: int) -> Column:
        bits = [F.when(word_bit(words, F.lit(row * 8 + c)), 1 << (7 - c)).otherwise(0) for c in range(8)]
        return F.lpad(F.hex(sum(bits[1:], bits[0])), 2, "0")

    return F.unhex(F.concat(*[byte(r) for r in range(8)]))


def mask_slots(spark: SparkSession, sf_dir: str) -> int:
    """Number of mask frames, two masks each; keypoint frames go round them, so their number grows with the table."""
    return max(1, table(spark, sf_dir, "embeddings").count() // 2)
