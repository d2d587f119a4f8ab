"""Operators on pixel tiles and masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from etholith.functions import masks as M
from etholith.session import cut_lineage

# Channel order of a merged image, alert level of overlapping masks.
CHANNEL_ORDER = {"ch01": "c1", "ch00": "c2", "ch02": "c3"}
IOU_ALERT = 0.3


def z_max_projection(tiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Element-wise maximum over z per stack, one row per pixel position."""
    return (
        tiles.select(*by, F.posexplode("pixels").alias("pos", "value"))
        .groupBy(*by, "pos")
        .agg(F.max("value").alias("value"))
    )


def merge_channels(projected: DataFrame, by: Sequence[str], channel: str = "channel") -> DataFrame:
    """Channels side by side in the fixed order; a missing third channel stays NULL."""
    return projected.groupBy(*by, "pos").agg(
        *[F.max(F.when(F.col(channel) == c, F.col("value"))).alias(out) for c, out in CHANNEL_ORDER.items()]
    )


def mask_stats(masks: DataFrame, h: int, w: int) -> DataFrame:
    """Area and centroid of each mask; an empty mask has no centroid."""
    return masks.withColumn("_o", M.outline(F.col("words"), h, w)).withColumns(
        {"area": F.col("_o.area"), "cx": F.col("_o.cx"), "cy": F.col("_o.cy")}
    ).drop("_o")


def mask_iou(pairs: DataFrame, a: str = "words1", b: str = "words2") -> DataFrame:
    """Intersection, union and IoU of two masks per row, with the alert flag."""
    u, v = F.col(a), F.col(b)
    shared = M.area(M.both(u, v))
    return pairs.withColumns(
        {
            "n_both": shared,
            "n_union": M.area(u) + M.area(v) - shared,
            "iou": M.iou(u, v),
        }
    ).withColumn("alert", F.coalesce(F.col("iou") > IOU_ALERT, F.lit(False)))


def overlap_resolution(pairs: DataFrame, score_a: str | None = None, score_b: str | None = None) -> DataFrame:
    """Shared pixels stay with the higher score (the area if there is none); equal keeps the first."""
    a, b = F.col("words1"), F.col("words2")
    own_a, own_b = M.area(a).cast("double"), M.area(b).cast("double")
    sa = F.coalesce(F.col(score_a), own_a) if score_a else own_a
    sb = F.coalesce(F.col(score_b), own_b) if score_b else own_b
    first_keeps = sa >= sb
    return pairs.withColumns(
        {
            "words1": F.when(first_keeps, a).otherwise(M.minus(a, b)),
            "words2": F.when(first_keeps, M.minus(b, a)).otherwise(b),
        }
    )


def patch_brightness(rows: DataFrame, h: int, w: int, radius: int, out: str = "brightness") -> DataFrame:
    """Mean of the patch around (x, y) in the tile of the same row."""
    return rows.withColumn(
        out, M.patch_mean(F.col("pixels"), h, w, F.col("x"), F.col("y"), radius)
    )


def _labels(on: np.ndarray) -> np.ndarray:
    """4-connected labels of one 2-D boolean tile: the smallest pixel index of each object, -1 off."""
    h, w = on.shape
    big = h * w
    lab = np.where(on, np.arange(big).reshape(h, w), big)
    while True:
        grown = lab.copy()
        grown[1:] = np.minimum(grown[1:], lab[:-1])
        grown[:-1] = np.minimum(grown[:-1], lab[1:])
        grown[:, 1:] = np.minimum(grown[:, 1:], lab[:, :-1])
        grown[:, :-1] = np.minimum(grown[:, :-1], lab[:, 1:])
        grown = np.where(on, grown, big)
        # Jump to the label of the label, so long shapes need few sweeps.
        flat = np.append(grown.ravel(), big)
        grown = np.where(on, flat[flat[grown.ravel()]].reshape(h, w), big)
        if np.array_equal(grown, lab):
            return np.where(on, lab, -1)
        lab = grown


OBJECTS = "array<struct<label:int,area:long,sx:long,sy:long>>"
BORDERS = "array<struct<side:string,offset:int,label:int>>"


def _objects(labels: np.ndarray) -> list[dict]:
    """Number and coordinate sums of each label's pixels."""
    ys, xs = np.nonzero(labels >= 0)
    found, at = np.unique(labels[ys, xs], return_inverse=True)
    sums = [np.bincount(at, v, len(found)).astype(int) for v in (np.ones(len(at)), xs, ys)]
    return [dict(zip(("label", "area", "sx", "sy"), map(int, o), strict=True)) for o in zip(found, *sums, strict=True)]


def _borders(labels: np.ndarray) -> list[dict]:
    sides = {"left": labels[:, 0], "right": labels[:, -1], "top": labels[0], "bottom": labels[-1]}
    return [{"side": s, "offset": int(k), "label": int(v[k])} for s, v in sides.items() for k in np.flatnonzero(v >= 0)]


def connected_objects(
    tiles: DataFrame,
    by: Sequence[str],
    h: int,
    w: int,
    on: str = "class_map",
    min_area: float = 0.0,
    grid: tuple[str, str] | None = None,
) -> DataFrame:
    """Objects of a class map: (tile key, label, area, cx, cy), the label being its first pixel.

    A tile is one bounded raster row; labelling runs in tasks on Arrow batches and one row per object
    leaves them. With ``grid``, the tiles of an image (``by``) lie side by side at these two whole
    numbers (column, row); an object over several tiles is one row with the first tile (by row, then
    column) it touches, its label there, and a centroid in image pixels.
    """

    @pandas_udf(f"struct<objects:{OBJECTS},borders:{BORDERS}>")
    def label(pixels: pd.Series) -> pd.DataFrame:
        found = [_labels(np.asarray(p).reshape(h, w) > 0) for p in pixels]
        return pd.DataFrame({"objects": [_objects(v) for v in found], "borders": [_borders(v) if grid else [] for v in found]})

    place = [*by, *(grid or ())]
    labelled = tiles.select(*place, label(F.col(on)).alias("_l"))
    if not grid:
        objects = labelled.select(*by, F.inline("_l.objects"))
        out = objects.select(*by, "label", "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))
        return out.filter(F.col("area") >= min_area)
    col, row = grid
    labelled = cut_lineage(labelled)
    objects = labelled.select(*place, F.inline("_l.objects"))
    edge = labelled.select(*place, F.inline("_l.borders"))
    # A tile's border meets the next tile's; only labels on borders take part in the merging.
    spot = lambda c, r: F.struct(F.col(r).alias("r"), F.col(c).alias("c"), F.col("label").alias("l"))
    links = None
    for own, other, dc, dr in (("right", "left", 1, 0), ("bottom", "top", 0, 1)):
        a = edge.filter(F.col("side") == own).select(*by, (F.col(col) + dc).alias("_c"), (F.col(row) + dr).alias("_r"), "offset", spot(col, row).alias("a"))
        b = edge.filter(F.col("side") == other).select(*by, F.col(col).alias("_c"), F.col(row).alias("_r"), "offset", spot(col, row).alias("b"))
        met = a.join(b, [*by, "_c", "_r", "offset"]).select(*by, "a", "b").distinct()
        links = met if links is None else links.union(met)
    root = _least_linked(links, by)
    placed = objects.withColumn("a", spot(col, row)).join(root, [*by, "a"], "left").withColumn("_root", F.coalesce("root", "a"))
    merged = placed.groupBy(*by, "_root").agg(
        F.sum("area").alias("area"),
        (F.sum(F.col("sx") + F.col("area") * F.col(col) * w) / F.sum("area")).alias("cx"),
        (F.sum(F.col("sy") + F.col("area") * F.col(row) * h) / F.sum("area")).alias("cy"),
    )
    out = merged.select(*by, F.col("_root.c").alias(col), F.col("_root.r").alias(row), F.col("_root.l").alias("label"), "area", "cx", "cy")
    return out.filter(F.col("area") >= min_area)


def _least_linked(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, a, root): for every linked node the least one it reaches. Labels move along links and, by
    jumping to the label's own label, twice as far in each round; each round is written once."""
    both = cut_lineage(links.union(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut_lineage(both.groupBy(*by, "a").agg(F.min("b").alias("root")).withColumn("root", F.least("a", "root")))
    while True:
        near = both.join(state.select(*by, F.col("a").alias("b"), "root"), [*by, "b"]).groupBy(*by, "a").agg(F.min("root").alias("_n"))
        moved = state.join(near, [*by, "a"]).select(*by, "a", F.least("root", "_n").alias("_t"), F.col("root").alias("_old"))
        ahead = state.select(*by, F.col("a").alias("_t"), F.col("root").alias("_far"))
        new = moved.join(ahead, [*by, "_t"]).select(*by, "a", F.least("_t", "_far").alias("root"), "_old")
        new = cut_lineage(new)
        state = new.drop("_old")
        if new.filter("root <> _old").isEmpty():
            return state
