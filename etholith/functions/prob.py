"""Tail probabilities: normal ones as expressions, others over result rows (one row per test)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

_NORMAL = NormalDist()


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


# Coefficients of the rational approximations of the normal tail (Hart) and of the
# normal quantile (Acklam), lowest power first.
TAIL_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
TAIL_BOTTOM = (
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184,
)
CENTRE_TOP = (2.506628277459239, -30.66479806614716, 138.3577518672690, -275.9285104469687, 220.9460984245205, -39.69683028665376)
CENTRE_BOTTOM = (1.0, -13.28068155288572, 66.80131188771972, -155.6989798598866, 161.5858368580409, -54.47609879822406)
EDGE_TOP = (2.938163982698783, 4.374664141464968, -2.549732539343734, -2.400758277161838, -0.3223964580411365, -0.007784894002430293)
EDGE_BOTTOM = (1.0, 3.754408661907416, 2.445134137142996, 0.3224671290700398, 0.007784695709041462)


def _poly(coefficients: tuple, x: str) -> str:
    """The polynomial as SQL text, by Horner's rule."""
    out = f"{coefficients[-1]:.16g}e0" if "e" not in f"{coefficients[-1]:.16g}" else f"{coefficients[-1]:.16g}"
    for c in reversed(coefficients[:-1]):
        term = f"{c:.16g}" if "e" in f"{c:.16g}" else f"{c:.16g}e0"
        out = f"({out} * {x} + {term})"
    return out


def upper_tail_sql(x: str) -> str:
    """P(Z > x) for x >= 0 as SQL text; the same text runs in Spark and elsewhere."""
    far = f"({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 0.65e0)))))"
    return (
        f"(CASE WHEN {x} > 37 THEN 0e0 WHEN {x} < 7.07106781186547e0 THEN exp(-{x} * {x} / 2e0) * {_poly(TAIL_TOP, x)} / {_poly(TAIL_BOTTOM, x)} "
        f"ELSE exp(-{x} * {x} / 2e0) / {far} / 2.506628274631e0 END)"
    )


def normal_two_sided_sql(z: str) -> str:
    return f"(2e0 * {upper_tail_sql(f'abs({z})')})"


def normal_start_sql(p: str) -> str:
    """The standard normal quantile to nine digits as SQL text; null outside (0, 1)."""
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - {p}))"
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425e0 THEN {_poly(EDGE_TOP, low)} / {_poly(EDGE_BOTTOM, low)} "
        f"WHEN {p} > 0.97575e0 THEN -{_poly(EDGE_TOP, high)} / {_poly(EDGE_BOTTOM, high)} ELSE {q} * {_poly(CENTRE_TOP, r)} / {_poly(CENTRE_BOTTOM, r)} END)"
    )


def normal_step_sql(p: str, x: str) -> str:
    """How far ``x`` is from the quantile, by the tail; the quantile is x - step / (1 + x * step / 2)."""
    below = f"(CASE WHEN {x} < 0 THEN {upper_tail_sql(f'abs({x})')} ELSE 1e0 - {upper_tail_sql(f'abs({x})')} END)"
    return f"(({below} - {p}) * 2.5066282746310002e0 * exp({x} * {x} / 2e0))"


def normal_two_sided(z: str) -> Column:
    """Two-sided normal p of the column named ``z``."""
    return F.expr(normal_two_sided_sql(z))


def with_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the normal quantile of the column named ``p``; null outside (0, 1)."""
    staged = df.withColumn("_x", F.expr(normal_start_sql(p))).withColumn("_step", F.expr(normal_step_sql(p, "_x")))
    return staged.withColumn(out, F.expr("_x - _step / (1e0 + _x * _step / 2e0)")).drop("_x", "_step")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    frac = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            frac *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * frac / a


def t_two_sided_value(t: float, dof: float) -> float:
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t * t))


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided_value(float(a), float(b))
            for a, b in zip(t, dof)
        ],
        dtype="float64",
    )


def _unfold(pairs) -> np.ndarray:
    return np.repeat([p["r"] for p in pairs], [p["n"] for p in pairs])


def signed_rank_tail(doubled: np.ndarray, positive: float) -> float:
    """Exact two-sided p of a signed-rank sum; ranks and sum are doubled to integers."""
    total = int(doubled.sum())
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for r in doubled:
        shifted = np.zeros_like(ways)
        shifted[int(r):] = ways[: total + 1 - int(r)]
        ways = (ways + shifted) / 2.0
    distance = np.abs(2 * np.arange(total + 1) - total)
    return float(min(1.0, ways[distance >= abs(2 * positive - total) - 1e-9].sum()))


@pandas_udf(DoubleType())
def signed_rank_p(ranks: pd.Series, positive: pd.Series) -> pd.Series:
    """Exact p from (doubled rank, rows) pairs. Cost: rows times the doubled rank sum, so rows cubed."""
    return pd.Series(
        [
            None if r is None or len(r) == 0 or pd.isna(v) else signed_rank_tail(_unfold(r), float(v))
            for r, v in zip(ranks, positive)
        ],
        dtype="float64",
    )


def rank_sum_tail(doubled: np.ndarray, n1: int, observed: float) -> float:
    """Exact two-sided permutation p of a doubled rank sum of ``n1`` rows."""
    total = int(doubled.sum())
    ways = np.zeros((n1 + 1, total + 1))
    ways[0, 0] = 1.0
    for r in doubled.astype(int):
        ways[1:, r:] += ways[:-1, : total + 1 - r].copy()
    share = ways[n1] / ways[n1].sum()
    centre = n1 * total / len(doubled)
    far = np.abs(np.arange(total + 1) - centre) >= abs(observed - centre) - 1e-9
    return float(min(1.0, share[far].sum()))


@pandas_udf(DoubleType())
def rank_sum_p(ranks: pd.Series, n1: pd.Series, observed: pd.Series) -> pd.Series:
    """Exact p from (doubled rank, rows) pairs. Cost: rows times ``n1`` times the doubled rank sum."""
    return pd.Series(
        [
            None if r is None or len(r) == 0 or pd.isna(v) else rank_sum_tail(_unfold(r), int(k), float(v))
            for r, k, v in zip(ranks, n1, observed)
        ],
        dtype="float64",
    )


#: Relative difference under which a replicate equals the estimate.
TIE = 1e-9


def bca_bounds(replicates: np.ndarray, theta: float, accel: float, conf: float) -> tuple | None:
    """Bias-corrected accelerated bounds from sorted replicates (type-7 quantiles)."""
    below = float(np.mean(replicates < theta - TIE * max(1.0, abs(theta))))  # a replicate equal but for rounding is not below
    if not 0.0 < below < 1.0:
        return None
    z0 = _NORMAL.inv_cdf(below)
    out = []
    for tail in ((1 - conf) / 2, (1 + conf) / 2):
        z = z0 + _NORMAL.inv_cdf(tail)
        out.append(float(np.quantile(replicates, _phi(z0 + z / (1 - accel * z)))))
    return out[0], out[1]


@pandas_udf(StructType([StructField("ci_low", DoubleType()), StructField("ci_high", DoubleType())]))
def bca_interval(replicates: pd.Series, theta: pd.Series, accel: pd.Series, conf: pd.Series) -> pd.DataFrame:
    rows = []
    for r, t, a, c in zip(replicates, theta, accel, conf):
        usable = r is not None and len(r) > 0 and not pd.isna(t) and not pd.isna(a)
        bounds = bca_bounds(np.sort(np.asarray(r)), float(t), float(a), float(c)) if usable else None
        rows.append(bounds or (None, None))
    return pd.DataFrame(rows, columns=["ci_low", "ci_high"], dtype="float64")
