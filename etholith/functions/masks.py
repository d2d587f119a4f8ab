"""Bit masks and pixel rasters held in columns.

A mask comes in two forms: ``packed`` BINARY (row-major, most significant bit
first, as written by a bit packer) for storage, and ``words`` ARRAY<BIGINT> of
``word_bits`` pixels each (least significant bit first) for set algebra.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

WORD_BITS = 32  # keeps clear of the sign bit


def pixel_of(x: Column) -> Column:
    """Pixel index of a coordinate; half-way values go to the even pixel."""
    return F.rint(x).cast("long")


def mask_bit(packed: Column, h: Column | int, w: Column | int, px: Column, py: Column) -> Column:
    """Whether pixel (px, py) is set; NULL outside the image."""
    h = h if isinstance(h, Column) else F.lit(h)
    w = w if isinstance(w, Column) else F.lit(w)
    index = py * w + px
    byte = F.conv(F.hex(F.substring(packed, (F.floor(index / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    shifted = F.floor(byte.cast("int") / F.pow(F.lit(2), 7 - index % 8)).cast("long") % 2
    inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
    return F.when(inside, shifted == 1)


def word_bit(words: Column, index: Column) -> Column:
    """Whether pixel ``index`` of a word mask is set (index inside the mask)."""
    word = F.get(words, F.floor(index / WORD_BITS).cast("int"))
    return F.floor(word / F.pow(F.lit(2), index % WORD_BITS)).cast("long") % 2 == 1


def set_pixels(words: Column, n_pixels: int) -> Column:
    """Ascending pixel indexes of the set bits."""
    return F.filter(
        F.sequence(F.lit(0), F.lit(n_pixels - 1)), lambda i: word_bit(words, i)
    )


def area(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u.bitwiseAND(v))


def minus(a: Column, b: Column) -> Column:
    """Pixels of ``a`` that are not in ``b``."""
    return F.zip_with(a, b, lambda u, v: u.bitwiseAND(F.bitwise_not(v)))


def iou(a: Column, b: Column) -> Column:
    shared = area(both(a, b))
    return F.try_divide(
        shared.cast("double"), (area(a) + area(b) - shared).cast("double")
    )


@arrow_udf(DoubleType())
def _nearest(xs: pa.Array, ys: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False)
    listed = np.flatnonzero(size)
    out = np.full(len(size), np.nan)
    if len(listed):
        px, py = (np.repeat(v.cast(pa.float64()).to_numpy(zero_copy_only=False), size) for v in (x, y))
        dx, dy = (v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) - p for v, p in ((xs, px), (ys, py)))
        out[listed] = np.sqrt(np.minimum.reduceat(dx * dx + dy * dy, (np.cumsum(size) - size)[listed]))
    none = (size == 0) | x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
    return pa.array(out, pa.float64(), mask=none)


def nearest(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Distance from (x, y) to the nearest of the listed pixels; NULL for none.

    The pixels of all points of an Arrow batch are compared at once.
    """
    return _nearest(xs, F.when(xs.isNotNull(), ys), x, y)


def pixel_mean(pixels: Column, w: int) -> Column:
    """Struct (x, y): mean coordinates of the listed pixels; NULL for none."""
    n = F.size(pixels)

    def mean(of) -> Column:
        total = F.aggregate(F.transform(pixels, of), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.try_divide(total.cast("double"), n.cast("double"))

    return F.when(
        n > 0,
        F.struct(
            mean(lambda i: (i % w).cast("long")).alias("x"),
            mean(lambda i: F.floor(i / w).cast("long")).alias("y"),
        ),
    )


def rescale_invert(pixels: Column) -> Column:
    """Stretch to 0..255 by the tile's own range, then invert; a flat tile becomes 255."""
    low, high = F.array_min(pixels), F.array_max(pixels)
    return F.transform(
        pixels,
        lambda v: (
            255 - F.coalesce(F.floor(F.try_divide((v - low) * 255, high - low) + 0.5), F.lit(0))
        ).cast("int"),
    )


def threshold(pixels: Column, limit: float = 254.0) -> Column:
    """Class map: 1 above the limit, 0 for background."""
    return F.transform(pixels, lambda v: F.when(v > limit, 1).otherwise(0))


def patch_mean(pixels: Column, h: int, w: int, x: Column, y: Column, radius: int) -> Column:
    """Mean value of the square patch around a point, clipped to the image; NULL if empty."""
    cx, cy = pixel_of(x), pixel_of(y)
    x0, x1 = F.greatest(F.lit(0), cx - radius), F.least(F.lit(w), cx + radius + 1)
    y0, y1 = F.greatest(F.lit(0), cy - radius), F.least(F.lit(h), cy + radius + 1)
    rows = F.transform(
        F.sequence(y0, y1 - 1),
        lambda r: F.aggregate(
            F.slice(pixels, (r * w + x0 + 1).cast("int"), (x1 - x0).cast("int")),
            F.lit(0).cast("long"),
            lambda a, v: a + v,
        ),
    )
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when((x1 > x0) & (y1 > y0), total / ((x1 - x0) * (y1 - y0)).cast("double"))


OUTLINE = StructType(
    [
        StructField("edge_x", ArrayType(DoubleType())),
        StructField("edge_y", ArrayType(DoubleType())),
        StructField("area", LongType()),
        StructField("cx", DoubleType()),
        StructField("cy", DoubleType()),
    ]
)


def _outline(on: np.ndarray) -> tuple:
    """Edge pixels (with an unset or missing 4-neighbour), area and pixel mean of one mask."""
    padded = np.pad(on, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    ys, xs = np.nonzero(on)
    if not len(xs):
        return [], [], 0, None, None
    ey, ex = np.nonzero(on & ~inner)
    return ex.astype("float64"), ey.astype("float64"), len(xs), float(xs.mean()), float(ys.mean())


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


@pandas_udf(ArrayType(LongType()))
def _words(packed: pd.Series, n: pd.Series) -> pd.Series:
    def of(value, size: int) -> np.ndarray:
        bits = np.zeros(-(-size // WORD_BITS) * WORD_BITS, np.uint8)
        flat = np.unpackbits(np.frombuffer(value, dtype=np.uint8))[:size]
        bits[: len(flat)] = flat
        return np.packbits(bits, bitorder="little").view("<u4").astype("int64")

    return pd.Series([None if v is None else of(v, int(k)) for v, k in zip(packed, n)])


def to_words(packed: Column, h: Column | int, w: Column | int) -> Column:
    """The word form of a packed mask; height and width may differ by row."""
    return _words(packed, (_column(h) * _column(w)).cast("long"))


def outline(mask: Column, h: Column | int, w: Column | int, packed: bool = False) -> Column:
    """Struct (edge_x, edge_y, area, cx, cy) of a word mask, or of a packed one.

    One mask per row, decoded in tasks from Arrow batches. The nearest set pixel
    of a point outside the mask is always one of the edge pixels, which are a
    small part of a large mask.
    """

    def bits(value, rows: int, columns: int) -> np.ndarray:
        if packed:
            flat = np.unpackbits(np.frombuffer(value, dtype=np.uint8))
        else:
            flat = np.unpackbits(np.asarray(value).astype("<u4").view(np.uint8), bitorder="little")
        return flat[: rows * columns].reshape(rows, columns).astype(bool)

    @pandas_udf(OUTLINE)
    def of(values: pd.Series, hs: pd.Series, ws: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if v is None else _outline(bits(v, int(a), int(b))) for v, a, b in zip(values, hs, ws)]
        return pd.DataFrame(rows, columns=OUTLINE.fieldNames())

    return of(mask, _column(h).cast("long"), _column(w).cast("long"))
