"""Operator 4: the SQL, targets by plain arithmetic, and edge cases."""

from collections import Counter

from pyspark.sql import functions as F

from etholith.llm.mixing import draw, emit, mix


def shares(sizes, cap=3):
    """Targets by moving the excess of full sources to the others, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_cases(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{k % 5}", 0) for k in range(400)]
    rows += [(1000, None, "s1", 0), (1001, "", None, 0), (1002, "a b", None, 0), (1003, "tiny", "é", 0), (1004, None, "zero", 0), (None, "x y z", "s2", 0), (7, rows[7][1], "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mix(df).collect()
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    want = shares(size)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3
    assert sorted(map(str, mix(df.repartition(3)).collect())) == sorted(map(str, got))
    out = emit(df)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    taken = Counter(r.doc_id for r in out.collect())
    assert taken == Counter({k: n for k, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and emit(df).count() == 0


def test_draw(spark):
    rows = spark.range(2000).select("id", F.md5(F.lit("")).alias("c"), F.lit(0).alias("n"))
    for u in ([r.u for r in df.select(draw("id", "c", "n").alias("u")).collect()] for df in (rows, rows.select(F.lit(None).alias("id"), "c", F.col("id").alias("n")))):
        assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03


def test_rows_without_or_with_equal_ids_hit_the_target(spark):
    rows = [(None, f"a b c {k % 2}", "s0") for k in range(1000)] + [(7, "x y z w", "s1")] * 1000 + [(None, f"v{k} u t s", "s2") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 3 and all(abs(r.taken - r.target) <= 0.05 * r.target for r in got)
    again = mix(df.repartition(2)).groupBy("source", "size", "copies").count().collect()
    assert sorted(again) == sorted(mix(df).groupBy("source", "size", "copies").count().collect())
    assert emit(df).count() == mix(df).agg(F.sum("copies")).first()[0]
