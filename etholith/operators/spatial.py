"""Spatial matching by grid cells.

Points meet through an equi-join on grid cells of the search radius; the side
that is repeated into its nine surrounding cells is the deduplicated target
side, once, whatever the number of probes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from etholith.session import cut_lineage

MATCH_RADIUS_UM = 10.0
# Side of a tile of the greedy match, in radii.
TILE = 32
#: Points of a group that one task takes whole, and pairs it looks at at once; larger groups are dealt out by place.
GROUP_POINTS = 1 << 17
PAIRS_AT_ONCE = 1 << 20


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def _around(targets: DataFrame, size: float) -> DataFrame:
    """Each target once per cell of its 3x3 surroundings."""
    shifts = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    return (
        targets.withColumn("_dx", F.explode(shifts))
        .withColumn("_dy", F.explode(shifts))
        .withColumn("_cell_x", _cell(F.col("_tx"), size) + F.col("_dx"))
        .withColumn("_cell_y", _cell(F.col("_ty"), size) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def overlapping(
    probes: DataFrame, targets: DataFrame, by: Sequence[str], radius: float, px_size: float = 1.0
) -> DataFrame:
    """Probe rows with at least one target within ``radius`` (a semi-join: no pairs appear)."""
    by = list(by)
    size = radius / px_size
    spots = targets.dropna(subset=["x", "y"]).select(
        *[F.col(k).alias(f"_t_{k}") for k in by], F.col("x").alias("_tx"), F.col("y").alias("_ty")
    ).distinct()
    near = _around(spots, size)
    cond = (_cell(F.col("x"), size) == F.col("_cell_x")) & (_cell(F.col("y"), size) == F.col("_cell_y"))
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_t_{k}"))
    cond = cond & (F.hypot(F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty")) * px_size <= radius)
    return probes.join(near, cond, "left_semi")


def marked_points(points: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Rows (group, is_first, x, y) of the points of two classes in groups without NULL keys.

    One plan for all that look at whole groups, so that these share one exchange.
    """
    known = points.dropna(subset=[*by, "x", "y"]).filter(F.col("marker").isin(first, second))
    return known.select(*by, (F.col("marker") == first).alias("is_first"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def by_size(points: DataFrame, by: Sequence[str], first: str, second: str) -> tuple[DataFrame, DataFrame | None]:
    """Points of groups that a task can take whole, and those of larger groups (None if there are none).

    The keys of large groups are at most the points by ``GROUP_POINTS``: few enough for a broadcast.
    """
    by = list(by)
    large = marked_points(points, by, first, second).groupBy(*by).count().filter(F.col("count") > GROUP_POINTS).select(*by)
    large = cut_lineage(large)
    if large.isEmpty():
        return points, None
    return points.join(F.broadcast(large), by, "left_anti"), points.join(F.broadcast(large), by, "left_semi")


def window_pairs(lo: np.ndarray, hi: np.ndarray, at_once: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) with ``lo[i] <= j < hi[i]`` in blocks of about ``at_once``; a block holds all pairs of its i."""
    size = hi - lo
    end = np.cumsum(size)
    a = 0
    while a < len(size):
        before = end[a] - size[a]
        b = max(a + 1, int(np.searchsorted(end, before + (at_once or PAIRS_AT_ONCE), side="right")))
        i = np.repeat(np.arange(a, b), size[a:b])
        yield i, np.arange(len(i)) + np.repeat(lo[a:b] - (end[a:b] - size[a:b] - before), size[a:b])
        a = b


def split_sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The :func:`marked_points` of one group as two arrays of places (x, y)."""
    first = table["is_first"].to_numpy()
    xy = np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()])
    return xy[first], xy[~first]


def repeated(table: pa.Table, names: Sequence[str], n: int) -> list[pa.Array]:
    """The first row's values of these columns, ``n`` times."""
    return [table[c].combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in names]


def _group_hits(points: DataFrame, by: list[str], radius: float, px_size: float, probe: str, target: str) -> DataFrame:
    """(group, n_overlap) with one group in one task: probes look along x for targets."""
    marked = marked_points(points, by, probe, target)
    kinds = dict(marked.dtypes)
    reach = radius / px_size * (1 + 1e-12)

    def hits(table: pa.Table) -> pa.Table:
        own, others = split_sides(table)
        own, weight = np.unique(own, axis=0, return_counts=True) if len(own) > 1 else (own, np.ones(len(own), np.int64))
        others = others[np.argsort(others[:, 0], kind="stable")]
        met = np.zeros(len(own), bool)
        lo, hi = (np.searchsorted(others[:, 0], own[:, 0] + s * reach, side=e) for s, e in ((-1, "left"), (1, "right")))
        for i, j in window_pairs(lo, hi):
            met[i[np.hypot(own[i, 0] - others[j, 0], own[i, 1] - others[j, 1]) * px_size <= radius]] = True
        return pa.Table.from_arrays([*repeated(table, by, 1), pa.array([int(weight[met].sum())])], names=[*by, "n_overlap"])

    return marked.groupBy(*by).applyInArrow(hits, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n_overlap long"]))


def radius_count(
    points: DataFrame,
    by: Sequence[str],
    radius: float,
    px_size: float = 1.0,
    probe: str = "GFP",
    target: str = "cFOS",
) -> DataFrame:
    """Per group: probe points, and those with a target point within the radius.

    Probes at one position are counted once with their number. A group is judged inside one task,
    so a point is exchanged once; groups of over ``GROUP_POINTS`` points meet by grid cells.
    """
    by = list(by)
    known = points.dropna(subset=["x", "y"])
    whole, large = by_size(points, by, probe, target)
    hits = _group_hits(whole, by, radius, px_size, probe, target)
    if large is not None:
        spread = large.dropna(subset=["x", "y"])
        places = spread.filter(F.col("marker") == probe).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("weight"))
        met = overlapping(places, spread.filter(F.col("marker") == target), by, radius, px_size)
        hits = hits.union(met.groupBy(*by).agg(F.sum("weight").alias("n_overlap")))
    totals = known.groupBy(*by).agg(
        F.count(F.when(F.col("marker") == probe, 1)).alias("n_probe"),
        F.count(F.when(F.col("marker") == target, 1)).alias("n_target"),
    )
    return totals.join(hits, by, "left").fillna({"n_overlap": 0})


def candidate_pairs(
    a: DataFrame, b: DataFrame, by: Sequence[str], radius: float, px_size: float = 1.0, cells: bool = False
) -> DataFrame:
    """Pairs within the radius: (group, a_key, b_key, dist). Both sides bring key, x, y.

    With ``cells`` also the grid cell of a.
    """
    by = list(by)
    size = radius / px_size
    spots = b.dropna(subset=["x", "y"]).select(
        *by, F.col("key").alias("b_key"), F.col("x").alias("_tx"), F.col("y").alias("_ty")
    )
    near = _around(spots, size)
    probing = (
        a.dropna(subset=["x", "y"])
        .select(*by, F.col("key").alias("a_key"), "x", "y")
        .withColumn("_cell_x", _cell(F.col("x"), size))
        .withColumn("_cell_y", _cell(F.col("y"), size))
    )
    # A plain root: equal squares of pixel distances give equal distances, so that ties are ties.
    dx, dy = F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty")
    dist = F.sqrt((dx * dx + dy * dy).cast("double")) * px_size
    return (
        probing.join(near, [*by, "_cell_x", "_cell_y"])
        .withColumn("dist", dist)
        .filter(F.col("dist") <= radius)
        .select(*by, "a_key", "b_key", "dist", *(["_cell_x", "_cell_y"] if cells else []))
    )


def _settle(pairs):
    """Arrow step for one tile: the nearest free b of each a in turn, where no earlier a can still ask for it.

    ``_rank`` says how many earlier points reach b at all; as many must be settled in this tile. Rows
    of settled points come back as ``won`` or not at all, those of others as open.
    """
    ai, bi, dist, rank = (pairs[c].to_numpy() for c in ("_ai", "_bi", "dist", "_rank"))
    order = np.lexsort((bi, dist, ai))
    edge = np.append(np.flatnonzero(np.append(True, np.diff(ai[order]))), len(order))
    taken, reached, keep, won = set(), Counter(), [], []
    for lo, hi in zip(edge, edge[1:]):
        rows = order[lo:hi]
        free = next((r for r in rows if bi[r] not in taken), None)
        if free is not None and reached[bi[free]] != rank[free]:
            keep.append(rows)
            won.append(np.zeros(len(rows), bool))
            continue
        reached.update(bi[rows].tolist())
        if free is not None:
            taken.add(bi[free])
            keep.append(np.array([free]))
            won.append(np.array([True]))
    at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    kept = pairs.drop_columns(["_ai", "_bi", "_rank", "_tile_x", "_tile_y"]).take(at)
    return kept.append_column("won", [np.concatenate(won) if won else np.zeros(0, bool)])


def greedy_nearest_match(
    a: DataFrame, b: DataFrame, by: Sequence[str], radius: float = MATCH_RADIUS_UM, px_size: float = 1.0
) -> DataFrame:
    """One-to-one matches (group, a_key, b_key, dist) of the first-come nearest rule.

    In order of ``a.key`` each a takes the nearest free b within the radius, the first b on ties. The
    order is honoured without a pass over a whole group: each round cuts the plane into tiles of
    ``TILE`` radii, and inside a tile every a is settled whose nearest free b no earlier unsettled a can
    reach (see :func:`_settle`). What depends on points beyond the border waits for the next round,
    whose tiles are shifted. A round settles at least the first open a of every group, and any chain
    of competing points inside one tile at once.
    """
    by = list(by)
    edges = cut_lineage(candidate_pairs(a, b, by, radius, px_size, cells=True))
    settled: list[DataFrame] = []
    number = 0
    while True:
        shift = F.lit(number % 2 * (TILE // 2))
        tiled = edges.withColumns({f"_tile_{c}": F.floor((F.col(f"_cell_{c}") + shift) / TILE) for c in "xy"})
        tile = [*by, "_tile_x", "_tile_y"]
        ranked = tiled.withColumns(
            {
                "_rank": F.row_number().over(Window.partitionBy(*by, "b_key").orderBy("a_key")) - 1,
                "_ai": F.dense_rank().over(Window.partitionBy(*tile).orderBy("a_key")),
                "_bi": F.dense_rank().over(Window.partitionBy(*tile).orderBy("b_key")),
            }
        )
        schema = StructType([*edges.schema.fields, StructField("won", BooleanType())])
        done = cut_lineage(ranked.groupBy(*tile).applyInArrow(_settle, schema))
        won = done.filter("won").select(*by, "a_key", "b_key", "dist")
        if not number or not won.isEmpty():
            settled.append(won)
        edges = done.filter("NOT won").drop("won").join(won.select(*by, "b_key"), [*by, "b_key"], "left_anti").select(*edges.columns)
        number += 1
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        edges = cut_lineage(edges)


def coloc_counts(points: DataFrame, matches: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per image: matched pairs, singles and totals of both classes."""
    by = list(by)
    totals = points.groupBy(*by).agg(
        F.count(F.when(F.col("marker") == "GFP", 1)).alias("total_gfp"),
        F.count(F.when(F.col("marker") == "cFOS", 1)).alias("total_cfos"),
    )
    pairs = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("double_positive"))
    out = totals.join(pairs, by, "left").fillna({"double_positive": 0})
    return out.withColumns(
        {
            "gfp_only": F.col("total_gfp") - F.col("double_positive"),
            "cfos_only": F.col("total_cfos") - F.col("double_positive"),
        }
    )
