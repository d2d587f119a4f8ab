"""Bootstrap intervals and rotation nulls with replayable randomness.

Random indexes come from a counter hash in 64-bit integers, so a draw depends
only on (replicate, draw, seed) and never on how rows are partitioned or how
often a task is retried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etholith.functions import prob
from etholith.operators.ordered import null_safe_join, row_index, with_group_stats
from etholith.operators.spatial import by_size, marked_points, radius_count, repeated, split_sides, window_pairs
from etholith.session import cut_lineage

# Modulus and multipliers of the counter hash, study defaults.
P = 2_147_483_647
REPLICATES = 2_000
CONFIDENCE = 0.95
ROTATIONS = 1_000
#: Rows of a group packed into one, packed rows a task holds, draws it makes for each row held, and draws made at once.
VALUE_BLOCK = 65_536
BLOCKS_HELD = 64
REPS_PER_TASK = 64
DRAWS_AT_ONCE = 1 << 15


def counter_index(rep: Column, draw: Column, n: Column, seed: int) -> Column:
    """A draw from 0..n-1."""
    h1 = (48_271 * rep + 16_807 * draw + F.lit(69_621 * seed + 12_345).cast("long")) % P
    h2 = (h1 * h1) % P
    h3 = (48_271 * h2 + 16_807 * h1 + 1_013_904_223) % P
    h4 = (h3 * h3) % P
    return ((h4 + 31 * h1) % P) % n


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """``x`` in place to a smaller number of the same remainder by P, a power of two less one: high bits are added to the low ones."""
    np.right_shift(x, 31, out=high)
    np.bitwise_and(x, P, out=x)
    np.add(x, high, out=x)


def _mixed(h1: np.ndarray, n: int) -> np.ndarray:
    """Draws from 0..n-1 whose first state has these remainders by P; the array is used up."""
    high, h = np.empty_like(h1), np.empty_like(h1)
    _fold(h1, high)
    np.multiply(h1, h1, out=h)
    _fold(h, high)
    h *= 48_271
    np.multiply(h1, 16_807, out=high)
    h += high
    h += 1_013_904_223
    _fold(h, high)
    h *= h
    _fold(h, high)
    h1 *= 31
    h += h1
    _fold(h, high)
    _fold(h, high)
    np.subtract(h, P, out=h, where=h >= P)
    return (h.astype(np.uint32) % np.uint32(n)).astype(np.int64)


def _counter_indexes(rep: int, first: int, last: int, n: int, seed: int) -> np.ndarray:
    """:func:`counter_index` of the draws ``first .. last - 1`` of one replicate; there may be 2**40 of them."""
    h1 = np.arange(first, last, dtype=np.uint64)
    h1 *= 16_807
    h1 += (48_271 * rep + 69_621 * seed + 12_345) % P
    return _mixed(h1, n)


def _stretches(n: int, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Where replicates of ``n`` draws lie on the cycle of all draws: (starts, lengths) of its pieces, (first, last piece) by replicate, whole cycles.

    A draw depends on its first state alone, ``16807 t`` modulo P with ``t`` a constant of the replicate plus the number of
    the draw. So a replicate is a stretch of ``n`` neighbours on a cycle of P draws that all replicates share. The ends
    of the stretches cut the cycle into pieces; a replicate is all pieces from its first up to its last, round the cycle.
    """
    inverse = pow(16_807, -1, P)
    begin = np.array([(48_271 * rep + 69_621 * seed + 12_345) * inverse % P for rep in range(1, reps + 1)], np.int64)
    whole, part = divmod(n, P)
    end = (begin + part) % P
    cuts = np.unique(np.concatenate([begin, end, [0]]))
    lengths = np.diff(np.append(cuts, P))
    first, last = np.searchsorted(cuts, begin), np.searchsorted(cuts, end)
    last = last + len(cuts) * (end < begin)
    if not whole:  # pieces that no replicate has are not drawn
        used = np.zeros(2 * len(cuts) + 1, np.int64)
        np.add.at(used, first, 1)
        np.add.at(used, last, -1)
        used = np.cumsum(used)[:-1].reshape(2, -1).sum(axis=0) > 0
        lengths = np.where(used, lengths, 0)
    return cuts, lengths, first, last, whole


def _drawn_sums(values: np.ndarray, products: Sequence[tuple[int, int]], first: int, n: int, reps: int, seed: int, lo: int, hi: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, sums) over the draws ``lo .. hi - 1`` of the pieces of :func:`_stretches`, of the group's rows ``first ..`` in ``values``."""
    starts, lengths, *_ = _stretches(n, reps, seed)
    end = np.cumsum(lengths)
    hi = min(hi, int(end[-1]))
    size, width = values.shape
    sums, seen = np.zeros((len(starts), width + len(products))), np.zeros(len(starts), bool)
    for a in range(lo, hi, at_once):
        b = min(a + at_once, hi)
        own = np.arange(np.searchsorted(end, a, side="right"), np.searchsorted(end, b, side="left") + 1)
        own = own[lengths[own] > 0]
        edge = np.maximum(end[own] - lengths[own] - a, 0)
        h1 = np.arange(a, b) + np.repeat(starts[own] - (end[own] - lengths[own]), np.diff(np.append(edge, b - a)))
        h1 = h1.view(np.uint64)
        h1 *= 16_807
        at = _mixed(h1, n)
        if size < n:
            at -= first
            mine = np.flatnonzero(at.view(np.uint64) < size)
            at, edge = at[mine], np.searchsorted(mine, edge)
        held = np.diff(np.append(edge, len(at))) > 0
        if held.any():
            own, edge = own[held], edge[held]
            drawn = values.take(at, axis=0).T
            if len(own) == 1:
                sums[own[0]] += [*[v.sum() for v in drawn], *[drawn[i] @ drawn[j] for i, j in products]]
            else:
                parts = [*drawn, *[drawn[i] * drawn[j] for i, j in products]]
                sums[own] += np.column_stack([np.add.reduceat(v, edge) for v in parts])
            seen[own] = True
    return np.flatnonzero(seen), sums[seen]


def resampled_sums(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    order: Sequence[str],
    reps: int,
    seed: int,
    products: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Rows (group, rep, n, one sum per value): every replicate draws as many rows as its group has, with replacement.

    ``products`` adds sums ``sum_<a>_<b>`` of products of two values. A draw is never a row of Spark.
    Replicates overlap on one cycle of draws (:func:`_stretches`), so a draw that many of them share is made
    once: at most P draws for all of them. The numbered rows of a group are packed into blocks of
    ``VALUE_BLOCK``; a task takes ``BLOCKS_HELD`` neighbouring blocks and ``REPS_PER_TASK`` draws for each row
    it can hold, and returns sums by piece of the cycle. What is exchanged is a copy of the values for each
    stretch of draws, and at most two rows of sums per replicate and task. A group of over four million rows
    has its draws made again for every four million rows.
    """
    by, values = list(by), list(values)
    kept = df.dropna(subset=values).select(*by, *dict.fromkeys([*values, *order]))
    rows = cut_lineage(row_index(kept, by, order).select(*by, "idx", *values))
    block = F.floor(F.col("idx") / VALUE_BLOCK).alias("_block")
    packed = rows.groupBy(*by, block).agg(F.sort_array(F.collect_list(F.struct("idx", *values))).alias("_rows"))
    packed = packed.select(*by, "_block", F.transform("_rows", lambda r: F.struct(*[r[v].cast("double").alias(v) for v in values])).alias("_rows"))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    key = [*by, "_one"]  # also without groups there is something to join by
    packed = null_safe_join(packed.withColumn("_one", F.lit(1)), groups.withColumn("_one", F.lit(1)), key)
    held, at_once = VALUE_BLOCK * BLOCKS_HELD, DRAWS_AT_ONCE
    per_task = held * REPS_PER_TASK
    chunks = F.ceil(F.least(F.lit(P).cast("long"), F.col("n") * reps) / F.lit(per_task).cast("long"))
    dealt = packed.withColumn("_held", F.floor(F.col("_block") / BLOCKS_HELD)).withColumn("_chunk", F.explode(F.sequence(F.lit(1).cast("long"), chunks)))
    sums = [*[f"sum_{v}" for v in values], *[f"sum_{a}_{b}" for a, b in products]]
    pairs = [(values.index(a), values.index(b)) for a, b in products]

    def drawn(table: pa.Table) -> pa.Table:
        listed = table.sort_by("_block")["_rows"]
        columns = [np.concatenate([c.flatten().field(v).to_numpy(zero_copy_only=False) for c in listed.chunks]) for v in values]
        n, unit, chunk = (table[c][0].as_py() for c in ("n", "_held", "_chunk"))
        piece, out = _drawn_sums(np.column_stack(columns), pairs, unit * held, n, reps, seed, (chunk - 1) * per_task, chunk * per_task, at_once)
        same = repeated(table, [*key, "_held", "_chunk", "n"], len(piece))
        return pa.Table.from_arrays([*same, pa.array(piece), *[pa.array(c) for c in out.T]], names=[*key, "_held", "_chunk", "n", "_piece", *sums])

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_piece", "_held", "_chunk")])
        n = table["n"][0].as_py()
        starts, _, first, last, whole = _stretches(n, reps, seed)
        piece = np.zeros((len(starts), len(sums)))
        np.add.at(piece, table["_piece"].to_numpy(), np.column_stack([table[c].to_numpy() for c in sums]))
        round_twice = np.concatenate([piece, piece])
        out = np.array([round_twice[a:b].sum(axis=0) for a, b in zip(first, last)]) + whole * piece.sum(axis=0)
        return pa.Table.from_arrays([*repeated(table, by, reps), pa.array(np.arange(1, reps + 1)), *repeated(table, ["n"], reps), *[pa.array(c) for c in out.T]], names=[*by, "rep", "n", *sums])

    kinds = dict(rows.dtypes)
    grouped = "".join(f"`{c}` {kinds[c]}, " for c in by)
    numbers = "".join(f", `{c}` double" for c in sums)
    parts = dealt.select(*key, "_held", "_chunk", "_block", "n", "_rows").groupBy(*key, "_held", "_chunk").applyInArrow(drawn, f"{grouped}_one int, _held long, _chunk long, n long, _piece long{numbers}")
    return parts.groupBy(*key).applyInArrow(summed, f"{grouped}rep long, n long{numbers}")


def replicate_means(
    df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], reps: int = REPLICATES, seed: int = 1
) -> DataFrame:
    """Bootstrap replicates of a mean: (group, rep, mean). ``order`` fixes the row numbering."""
    sums = resampled_sums(df, by, [value], order, reps, seed)
    return sums.select(*by, "rep", (F.col(f"sum_{value}") / F.col("n")).alias("mean"))


def _interval(reps: DataFrame, stats: DataFrame, by: Sequence[str], stat: str, conf: float) -> DataFrame:
    lists = cut_lineage(reps.groupBy(*by).agg(F.collect_list(stat).alias("_reps")))  # read once, as a join or a subquery
    joined = (
        null_safe_join(stats, lists, by, "left")
        if by
        else stats.withColumn("_reps", lists.select("_reps").scalar())
    )
    ci = prob.bca_interval("_reps", "theta", "_accel", F.lit(float(conf)))
    usable = (F.col("n") >= 3) & ~F.col("_constant")
    return joined.withColumn("_ci", ci).select(
        *by,
        "n",
        "theta",
        F.when(usable, F.col("_ci.ci_low")).alias("ci_low"),
        F.when(usable, F.col("_ci.ci_high")).alias("ci_high"),
    )


def bca_ci_mean(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    order: Sequence[str],
    reps: int = REPLICATES,
    conf: float = CONFIDENCE,
    seed: int = 1,
) -> DataFrame:
    """Bias-corrected accelerated interval of a mean; NULL under three rows or for a constant."""
    by = list(by)
    v = F.col(value)
    centred = with_group_stats(df.filter(v.isNotNull()), by, _m=F.avg(value))
    d = F.col("_m") - v
    stats = centred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_m").alias("theta"),
        (F.min(value) == F.max(value)).alias("_constant"),
        # Leaving one row out moves the mean by d/(n-1); the factor cancels.
        F.try_divide(-F.sum(d * d * d), 6 * F.pow(F.sum(d * d), F.lit(1.5))).alias("_accel"),
    )
    return _interval(replicate_means(df, by, value, order, reps, seed), stats, by, "mean", conf)


def _ccc_of(n, sx, sy, sxx, syy, sxy) -> Column:
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    gap = (sx - sy) / n
    return F.try_divide(2 * (sxy - sx * sy / n), vx + vy + gap * gap * (n - 1))


def bca_ci_ccc(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    order: Sequence[str],
    reps: int = REPLICATES,
    conf: float = CONFIDENCE,
    seed: int = 1,
) -> DataFrame:
    """Bias-corrected accelerated interval of the concordance coefficient (pairs resampled)."""
    by = list(by)
    pairs = df.dropna(subset=[x, y])
    # Moments are taken about the group means to keep them well scaled.
    centred = with_group_stats(pairs, by, _mx=F.avg(x), _my=F.avg(y))
    base = centred.withColumns(
        {"_x": F.col(x) - F.col("_mx"), "_y": F.col(y) - F.col("_mx")}
    )

    def sums(prefix: str) -> list[Column]:
        a, b = F.col("_x"), F.col("_y")
        parts = {"n": F.count(F.lit(1)).cast("double"), "sx": F.sum(a), "sy": F.sum(b),
                 "sxx": F.sum(a * a), "syy": F.sum(b * b), "sxy": F.sum(a * b)}
        return [c.alias(f"{prefix}{k}") for k, c in parts.items()]

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    drawn = resampled_sums(base, by, ["_x", "_y"], order, reps, seed, [("_x", "_x"), ("_y", "_y"), ("_x", "_y")])
    drawn_sums = [F.col(f"sum_{k}") for k in ("_x", "_y", "_x__x", "_y__y", "_x__y")]
    replicates = drawn.select(
        *by, "rep", _ccc_of(F.col("n").cast("double"), *drawn_sums).alias("ccc")
    ).filter(F.col("ccc").isNotNull())
    whole = with_group_stats(base, by, **{f"_t_{k}": c for k, c in zip(names, sums(""))})
    a, b = F.col("_x"), F.col("_y")
    own = dict(zip(names, (F.lit(1.0), a, b, a * a, b * b, a * b)))
    loo = _ccc_of(*[F.col(f"_t_{k}") - own[k] for k in names])
    left_out = whole.withColumns({"_loo": loo, "_all": _ccc_of(*[F.col(f"_t_{k}") for k in names])})
    meaned = with_group_stats(left_out, by, _lm=F.avg("_loo"))
    d = F.col("_lm") - F.col("_loo")
    stats = meaned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_all").alias("theta"),
        ((F.min(x) == F.max(x)) & (F.min(y) == F.max(y))).alias("_constant"),
        F.try_divide(F.sum(d * d * d), 6 * F.pow(F.sum(d * d), F.lit(1.5))).alias("_accel"),
    )
    return _interval(replicates, stats, by, "ccc", conf)


def angle_table(groups: DataFrame, by: Sequence[str], n_rotations: int = ROTATIONS, seed: int = 123) -> DataFrame:
    """Uniform angles (group, rotation, angle in degrees) from the counter hash.

    A single whole-number column is its own key, so that other engines can replay the angles;
    other keys go through a hash.
    """
    by = list(by)
    rot = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_rotations).cast("long")))
    whole = len(by) == 1 and dict(groups.dtypes)[by[0]] in ("tinyint", "smallint", "int", "bigint")
    key = F.pmod(F.col(by[0]).cast("long") if whole else F.xxhash64(*by), F.lit(1_000_003))
    return groups.select(*by).distinct().withColumn("rotation", rot).withColumn(
        "angle",
        counter_index(F.col("rotation"), key, F.lit(3_600_000).cast("long"), seed) / F.lit(10_000.0),
    )


#: Degrees by which an interval of angles is widened, so that a distance of exactly the radius counts.
_EDGE = 1e-8


def overlap_intervals(points: DataFrame, by: Sequence[str], radii: Sequence[float], moving: str, fixed: str) -> DataFrame:
    """Rows (group, x, y, weight, radius, lo, hi): angles in degrees at which a moving point is within the radius of a fixed one.

    The moving class turns about its own mean. In polar coordinates about it a moving point meets a
    fixed one at an interval of angles, if their distances from the mean differ by the radius at most:
    one equi-join on bands of that distance, for all radii. Intervals of a point are disjoint: they are
    merged in order by running maxima. Groups with under two points of a class have none.
    """
    by = list(by)
    known = points.dropna(subset=["x", "y"])
    enough = (
        known.groupBy(*by)
        .agg(
            F.count(F.when(F.col("marker") == moving, 1)).alias("_na"),
            F.count(F.when(F.col("marker") == fixed, 1)).alias("_nb"),
            F.avg(F.when(F.col("marker") == moving, F.col("x"))).alias("_cx"),
            F.avg(F.when(F.col("marker") == moving, F.col("y"))).alias("_cy"),
        )
        .filter("_na >= 2 AND _nb >= 2")
        .select(*by, "_cx", "_cy")
    )

    def polar(marker: str, tag: str) -> DataFrame:
        places = known.filter(F.col("marker") == marker).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("weight")).join(enough, by)
        dx, dy = F.col("x").cast("double") - F.col("_cx"), F.col("y").cast("double") - F.col("_cy")
        return places.select(*by, "x", "y", "weight", F.hypot(dx, dy).alias(f"_r{tag}"), F.degrees(F.atan2(dy, dx)).alias(f"_at{tag}"))

    widest = float(max(radii))
    a = polar(moving, "a").withColumn("_band", F.floor(F.col("_ra") / widest))
    near = F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)]))
    b = polar(fixed, "b").select(*by, "_rb", "_atb", near.alias("_shift")).withColumn("_band", F.floor(F.col("_rb") / widest) + F.col("_shift"))
    ra, rb, r = F.col("_ra"), F.col("_rb"), F.col("radius")
    pairs = a.join(b.drop("_shift"), [*by, "_band"]).filter(F.abs(ra - rb) <= widest + 1e-9)
    pairs = pairs.withColumn("radius", F.explode(F.array(*[F.lit(float(x)) for x in radii]))).filter(F.abs(ra - rb) <= r + 1e-9)
    cosine = 1 + ((ra - rb) * (ra - rb) - r * r) / (2 * ra * rb)
    half = F.when(ra + rb <= r + 1e-9, 180.0).otherwise(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))) + _EDGE
    lo = F.pmod(F.col("_atb") - F.col("_ata") - F.col("_half"), F.lit(360.0))
    turned = pairs.withColumn("_half", half).withColumn("lo", lo).withColumn("hi", F.col("lo") + 2 * F.col("_half"))
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.array(span(F.lit(0.0), F.lit(360.0)))
    lo, hi = F.col("lo"), F.col("hi")
    cut = F.when(F.col("_half") >= 180, whole).when(hi >= 360, F.array(span(lo, F.lit(360.0)), span(F.lit(0.0), hi - 360))).otherwise(F.array(span(lo, hi)))
    point = [*by, "x", "y", "weight", "radius"]
    parts = turned.select(*point, F.explode(cut).alias("_s")).select(*point, "_s.lo", "_s.hi")
    order = Window.partitionBy(*point).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("_new", F.when(before.isNull() | (lo > before), 1).otherwise(0))
    islands = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*point, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def _turned_overlaps(own: np.ndarray, others: np.ndarray, radii: Sequence[float], angles: np.ndarray) -> list[np.ndarray]:
    """Per radius the overlap counts at the sorted ``angles``, of ``own`` places turned about their mean beside ``others``.

    As :func:`overlap_intervals` and :func:`overlaps_at` have it, but an interval is told by the ranks of the angles in it.
    """
    cx, cy = own.mean(axis=0)

    def polar(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = places[:, 0] - cx, places[:, 1] - cy
        return np.hypot(dx, dy), np.degrees(np.arctan2(dy, dx))

    own, weight = np.unique(own[:, 0] + 1j * own[:, 1], return_counts=True)
    others = np.unique(others[:, 0] + 1j * others[:, 1])
    (r_own, at_own), (r_other, at_other) = polar(np.column_stack([own.real, own.imag])), polar(np.column_stack([others.real, others.imag]))
    by_r = np.argsort(r_other)
    r_other, at_other = r_other[by_r], at_other[by_r]
    widest, places = float(max(radii)) + 1e-9, len(angles) + 1
    change = np.zeros((len(radii), places), np.int64)
    for i, j in window_pairs(np.searchsorted(r_other, r_own - widest, side="left"), np.searchsorted(r_other, r_own + widest, side="right")):
        gap = r_own[i] - r_other[j]
        for k, r in enumerate(radii):
            near = np.abs(gap) <= r + 1e-9
            a, b, d = i[near], j[near], gap[near]
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = 1 + (d * d - r * r) / (2 * r_own[a] * r_other[b])
            half = np.where(r_own[a] + r_other[b] <= r + 1e-9, 180.0, np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))) + _EDGE
            lo = np.mod(at_other[b] - at_own[a] - half, 360.0)
            hi = lo + 2 * half
            full, over = half >= 180, (half < 180) & (hi >= 360)
            # An interval across 360 degrees is two.
            starts = [np.where(full, 0.0, lo), np.zeros(over.sum())]
            ends = [np.where(full | over, 360.0, hi), hi[over] - 360]
            point = np.concatenate([a, a[over]]) * places
            first = point + np.searchsorted(angles, np.concatenate(starts), side="left")
            last = point + np.searchsorted(angles, np.concatenate(ends), side="right")
            order = np.argsort(first)
            first, last = first[order], np.maximum.accumulate(last[order])
            fresh = np.append(True, first[1:] > last[:-1]) if len(first) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            opened, closed = first[at], last[np.append(at[1:], len(last)) - 1] if len(at) else last
            w = weight[opened // places]
            change[k] += np.bincount(opened % places, w, places).astype(np.int64)
            change[k] -= np.bincount(closed - opened // places * places, w, places).astype(np.int64)
    return list(np.cumsum(change, axis=1)[:, :-1])


def _overlaps_of_groups(points: DataFrame, by: list[str], radii: list[float], angles: DataFrame, moving: str, fixed: str) -> DataFrame:
    """:func:`overlaps_at` with one group, its points and angles, in one task."""
    marked = marked_points(points, by, moving, fixed)
    own_by = [f"_t_{c}" for c in by]  # a name of its own: both sides may come from one frame
    turns = angles.dropna(subset=by).select(*[F.col(c).alias(t) for c, t in zip(by, own_by)], "rotation", F.pmod(F.col("angle").cast("double"), F.lit(360.0)).alias("angle"))
    kinds = dict(turns.dtypes) | dict(marked.dtypes)
    names = [*by, "radius", "rotation", "overlap"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"radius double, rotation {kinds['rotation']}, overlap long"])

    def turned(table: pa.Table, plan: pa.Table) -> pa.Table:
        own, others = split_sides(table)
        if min(len(own), len(others)) < 2:
            plan = plan.slice(0, 0)
        plan = plan.sort_by([("angle", "ascending"), ("rotation", "ascending")])
        n = len(plan)
        counts = _turned_overlaps(own, others, radii, plan["angle"].to_numpy()) if n else [np.zeros(0, np.int64)] * len(radii)
        rotation = plan["rotation"].combine_chunks()
        parts = [[*repeated(plan, own_by, n), pa.array(np.full(n, r)), rotation, pa.array(c)] for r, c in zip(radii, counts)]
        return pa.concat_tables([pa.Table.from_arrays(p, names=names) for p in parts])

    return marked.groupBy(*by).cogroup(turns.groupBy(*own_by)).applyInArrow(turned, schema)


def overlaps_at(points: DataFrame, by: Sequence[str], radii: Sequence[float], angles: DataFrame, moving: str = "GFP", fixed: str = "cFOS") -> DataFrame:
    """Overlap count (group, radius, rotation, overlap) of every rotation of the moving class about its own mean.

    For groups with two points or more of each class; rotations without any overlap are there. A group
    with its angles is one task's work, so a point is exchanged once and its meetings never; groups of
    more than ``GROUP_POINTS`` points are dealt out by bands (:func:`_overlaps_by_band`).
    """
    by, radii = list(by), [float(r) for r in radii]
    whole, large = by_size(points, by, moving, fixed)
    out = _overlaps_of_groups(whole, by, radii, angles, moving, fixed)
    return out if large is None else out.union(_overlaps_by_band(large, by, radii, angles, moving, fixed))


def _overlaps_by_band(points: DataFrame, by: list[str], radii: list[float], angles: DataFrame, moving: str, fixed: str) -> DataFrame:
    """:func:`overlaps_at` for groups of any size.

    Angles are ranked per group once and looked up by whole degree; an interval of :func:`overlap_intervals`
    covers a stretch of them, so it adds its weight at one rank and takes it away at another, and running
    sums over the ranks are the counts. No row per point and rotation is made.
    """
    known = points.dropna(subset=["x", "y"])
    both = [F.count(F.when(F.col("marker") == m, 1)) >= 2 for m in (moving, fixed)]
    enough = known.groupBy(*by).agg((both[0] & both[1]).alias("_enough")).filter("_enough").select(*by)
    turns = angles.join(enough, by).select(*by, "rotation", F.pmod(F.col("angle").cast("double"), F.lit(360.0)).alias("angle"))
    ranked = turns.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("angle", "rotation")) - 1)
    ranked = cut_lineage(ranked)
    # Sorted angles by whole degree, with the number of angles before: every degree of every group is there.
    degree = F.floor("angle").cast("int").alias("_degree")
    held = ranked.groupBy(*by, degree).agg(F.collect_list("angle").alias("_angles"))
    grid = ranked.select(*by).distinct().withColumn("_degree", F.explode(F.sequence(F.lit(0), F.lit(360))))
    size = F.coalesce(F.size("_angles"), F.lit(0))
    earlier = F.sum(size).over(Window.partitionBy(*by).orderBy("_degree").rowsBetween(Window.unboundedPreceding, 0)) - size
    degrees = grid.join(held, [*by, "_degree"], "left").withColumn("_before", earlier)
    ends = F.array(
        F.struct(F.col("lo").alias("_at"), F.lit(True).alias("_opens"), F.col("weight").alias("_w")),
        F.struct(F.col("hi").alias("_at"), F.lit(False).alias("_opens"), (-F.col("weight")).alias("_w")),
    )
    spans = overlap_intervals(points, by, radii, moving, fixed).select(*by, "radius", F.inline(ends)).withColumn("_degree", F.floor("_at").cast("int"))
    at = F.col("_at")
    passed = F.size(F.filter("_angles", lambda a: F.when(F.col("_opens"), a < at).otherwise(a <= at)))
    rank = (F.col("_before") + F.when(F.col("_angles").isNotNull(), passed).otherwise(0)).cast("int")
    events = spans.join(degrees, [*by, "_degree"]).select(*by, "radius", rank.alias("_k"), "_w").groupBy(*by, "radius", "_k").agg(F.sum("_w").alias("_w"))
    # Rotations and events meet in one sorted run per group and radius; at a rank the events come first.
    plan = ranked.withColumn("radius", F.explode(F.array(*[F.lit(float(x)) for x in radii]))).select(*by, "radius", F.col("_k").cast("int").alias("_k"), "rotation", F.lit(0).cast("long").alias("_w"))
    both = plan.union(events.select(*by, "radius", "_k", F.lit(None).cast("long").alias("rotation"), F.col("_w").cast("long")))
    running = Window.partitionBy(*by, "radius").orderBy("_k", F.col("rotation").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("overlap", F.sum("_w").over(running)).filter("rotation IS NOT NULL").select(*by, "radius", "rotation", "overlap")


def rotated_overlaps(
    points: DataFrame,
    by: Sequence[str],
    radius: float,
    angles: DataFrame,
    moving: str = "GFP",
    fixed: str = "cFOS",
) -> DataFrame:
    """:func:`overlaps_at` for one radius: rows (group, rotation, overlap)."""
    return overlaps_at(points, by, [radius], angles, moving, fixed).drop("radius")


def rotation_nulls(
    points: DataFrame,
    by: Sequence[str],
    radii: Sequence[float] = (5.0, 10.0),
    n_rotations: int = ROTATIONS,
    seed: int = 123,
    angles: DataFrame | None = None,
) -> DataFrame:
    """Two-sided rotation p of the observed overlap per group and radius; NULL with under two points of a class."""
    by = list(by)
    groups = points.select(*by).distinct()
    turns = angles if angles is not None else angle_table(groups, by, n_rotations, seed)
    null = overlaps_at(points, by, radii, turns)
    real = None
    for radius in radii:
        one = radius_count(points, by, radius).select(*by, F.lit(float(radius)).alias("radius"), F.col("n_overlap").alias("real_overlap"))
        real = one if real is None else real.union(one)
    # Equal counts of a group are one row before they are exchanged.
    compared = null.groupBy(*by, "radius", "overlap").agg(F.count(F.lit(1)).alias("_n")).join(real, [*by, "radius"])
    some = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    tails = compared.groupBy(*by, "radius").agg(
        F.max("real_overlap").alias("real_overlap"),
        F.sum("_n").alias("n_rotations"),
        some(F.col("overlap") >= F.col("real_overlap")).alias("n_ge"),
        some(F.col("overlap") <= F.col("real_overlap")).alias("n_le"),
    )
    smaller = F.least((F.col("n_ge") + 1) / (F.col("n_rotations") + 1), (F.col("n_le") + 1) / (F.col("n_rotations") + 1))
    p = F.when(F.col("n_rotations").isNotNull(), F.least(F.lit(1.0), 2 * smaller))
    every = groups.withColumn("radius", F.explode(F.array(*[F.lit(float(x)) for x in radii])))
    return every.join(tails, [*by, "radius"], "left").withColumn("p_value", p)


def rotation_null(
    points: DataFrame,
    by: Sequence[str],
    radius: float = 5.0,
    n_rotations: int = ROTATIONS,
    seed: int = 123,
    angles: DataFrame | None = None,
) -> DataFrame:
    """:func:`rotation_nulls` for one radius."""
    return rotation_nulls(points, by, [radius], n_rotations, seed, angles).drop("radius")


def null_distribution(overlaps: DataFrame, real: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histogram of rotation overlaps beside the observed one."""
    return (
        overlaps.groupBy(*by, "overlap")
        .agg(F.count(F.lit(1)).alias("n_rotations"))
        .join(real, list(by))
    )
