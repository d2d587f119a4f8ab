"""Plane geometry on columns and rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def rotate(x: Column, y: Column, angle_deg: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    rad = F.radians(angle_deg)
    dx, dy = x - cx, y - cy
    return (
        cx + dx * F.cos(rad) - dy * F.sin(rad),
        cy + dx * F.sin(rad) + dy * F.cos(rad),
    )


def mirror_x(x: Column, mean_x: Column, base_side: Column) -> Column:
    """Reflection about the mean of the image where the base side is 1."""
    return F.when(base_side == 1, 2 * mean_x - x).otherwise(x)


def _edges(ring: Column) -> Column:
    """Per edge: cross product of its ends and their coordinate sums. Each point is read once."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        x1, y1, x2, y2 = p[0], p[1], q[0], q[1]
        return F.struct((x1 * y2 - x2 * y1).alias("cross"), (x1 + x2).alias("sx"), (y1 + y2).alias("sy"))

    return F.zip_with(ring, following, edge)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def ring_area(ring: Column) -> Column:
    """Shoelace area of ``array<array<double>>``, open or closed."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + e["cross"])) / 2


def polygon_area(rings: Column, px_size: Column | float = 1.0, holes: bool = False) -> Column:
    """Area of a polygon's exterior ring times px_size squared; NULL for unknown calibration.

    With ``holes`` the inner rings are taken off.
    """
    size = px_size if isinstance(px_size, Column) else F.lit(float(px_size))
    outer = ring_area(F.get(rings, F.lit(0)))
    if holes:
        inner = F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1)))
        outer = outer - _sum(F.transform(inner, ring_area))
    return outer * size * size


def ring_centroid(ring: Column) -> Column:
    """Area centroid as struct (x, y); the vertex mean for a ring of no area.

    Pass the ring as a stored column: it is used in several places.
    """
    n = F.size(ring).cast("double")

    def mean(place: int) -> Column:
        return F.try_divide(_sum(F.transform(ring, lambda p: p[place])), n)

    def add(acc: Column, e: Column) -> Column:
        return F.struct(
            (acc["a"] + e["cross"]).alias("a"),
            (acc["x"] + e["sx"] * e["cross"]).alias("x"),
            (acc["y"] + e["sy"] * e["cross"]).alias("y"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.try_divide(acc["x"], 3 * acc["a"]).alias("x"), F.try_divide(acc["y"], 3 * acc["a"]).alias("y")
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    found = F.aggregate(_edges(ring), zero, add, finish)
    flat = F.struct(mean(0).alias("x"), mean(1).alias("y"))
    return F.coalesce(F.when(ring_area(ring) > 0, found), flat)
