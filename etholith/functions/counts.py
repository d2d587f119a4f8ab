"""Cell-count arithmetic: totals, chance overlap, percentages, densities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, ieee: bool = False) -> Column:
    """``num/den``; a zero denominator gives NULL, or Inf/NaN when ``ieee``."""
    if not ieee:
        return F.try_divide(num.cast("double"), den.cast("double"))
    inf = F.lit(float("inf"))
    return (
        F.when(den != 0, F.try_divide(num.cast("double"), den.cast("double")))
        .when(den.isNull() | num.isNull(), F.lit(None).cast("double"))
        .when(num > 0, inf)
        .when(num < 0, -inf)
        .otherwise(F.lit(float("nan")))
    )


def count_totals(a_only: Column, b_only: Column, both: Column) -> dict[str, Column]:
    return {"a_total": a_only + both, "b_total": b_only + both, "n_cells": a_only + b_only + both}


def chance_overlap(a_total: Column, b_total: Column, n: Column) -> Column:
    return ratio(a_total, n) * ratio(b_total, n) * n


def overlap_percentages(
    both: Column, a_total: Column, b_total: Column, n: Column
) -> dict[str, Column]:
    return {
        "overlap_pct_a": 100 * ratio(both, a_total),
        "overlap_pct_b": 100 * ratio(both, b_total),
        "coloc_pct": 100 * ratio(both, n),
    }


def density_mm2(count: Column, area_um2: Column) -> Column:
    return ratio(count, area_um2 / F.lit(1e6))


def overlap_index(both: Column, chance: Column, a_total: Column, b_total: Column, noise: float = 1e-9) -> Column:
    """0 at chance level, 1 at the largest possible overlap; NULL where ``noise`` or less is left between them."""
    room = F.least(a_total, b_total) - chance
    return F.when(F.abs(room) > noise, ratio(both - chance, room))


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "above").when(delta < 0, "below").when(delta == 0, "equal")


def sig_stars(p: Column, style: str = "A") -> Column:
    """Significance marks; style A writes ``ns``, style B marks p < 0.1 with a dot."""
    tail = (
        F.lit("ns") if style == "A" else F.when(p < 0.1, ".").otherwise("")
    )
    return (
        F.when(p.isNull(), "")
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise(tail)
    )


def derived_counts(a_only: Column, b_only: Column, both: Column) -> dict[str, Column]:
    """Totals, chance overlap, percentages and index of one count triple."""
    t = count_totals(a_only, b_only, both)
    chance = chance_overlap(t["a_total"], t["b_total"], t["n_cells"])
    return {
        **t,
        "chance_overlap": chance,
        **overlap_percentages(both, t["a_total"], t["b_total"], t["n_cells"]),
        "overlap_index": overlap_index(both, chance, t["a_total"], t["b_total"]),
    }
