"""Grouped tests and agreement measures.

Each takes ``by`` so that any number of tests is one job. Ranks come from value
ranges (:mod:`etholith.operators.ordered`); everything else is a partial sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etholith.functions import prob
from etholith.operators.ordered import (
    null_safe_join,
    quantiles,
    row_index,
    running,
    tie_ranks,
)
from etholith.session import cut_lineage

# Fixed values of the study.
METHODS = ("exact", "normal")
LOA_Z = 1.96
FAN_ALPHA = 0.05


def paired(
    df: DataFrame, by: Sequence[str], unit: str, cond: str, levels: tuple, value: str
) -> DataFrame:
    """One row per unit with both conditions as ``x`` and ``y``; incomplete units are left out."""
    x, y = levels
    return (
        df.groupBy(*by, unit)
        .agg(
            F.max(F.when(F.col(cond) == x, F.col(value))).alias("x"),
            F.max(F.when(F.col(cond) == y, F.col(value))).alias("y"),
        )
        .dropna(subset=["x", "y"])
    )


def effect_size(z: Column, n: Column, signed: bool = True) -> Column:
    r = F.try_divide(z, F.sqrt(n.cast("double")))
    return r if signed else F.abs(r)


def _method(name: str) -> bool:
    """Whether the exact distribution is asked for."""
    if name not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {name!r}")
    return name == "exact"


def _rank_pairs(exact: bool, kept: Column) -> Column:
    """Distinct doubled ranks with their numbers of rows, for the exact distribution only."""
    if not exact:
        return F.array().cast("array<struct<r:int,n:int>>")
    pair = F.struct((F.col("avg_rank") * 2).cast("int").alias("r"), F.col("n_ties").cast("int").alias("n"))
    return F.sort_array(F.collect_list(F.when(kept, pair)))


def signed_rank(
    pairs: DataFrame, by: Sequence[str], zero_method: str = "pratt", digits: int = 9, method: str = "normal"
) -> DataFrame:
    """Signed-rank statistic of ``x - y`` per group, without p values.

    Ties and zeros are judged after rounding differences to ``digits``. Pratt
    ranks the zeros and then leaves them out; ``wilcox`` leaves them out first.
    Effect r is Z/sqrt(n) with n counting zero pairs.
    """
    by = list(by)
    diff = F.round(F.col("x") - F.col("y"), digits)
    ranks = tie_ranks(
        pairs.withColumn("_d", diff), by, F.abs(F.col("_d")), {"n_pos": F.count(F.when(F.col("_d") > 0, 1))}
    )
    nonzero = F.col("value") > 0
    sums = ranks.groupBy(*by).agg(
        F.max("n_group").alias("n_pairs"),
        F.coalesce(F.sum(F.when(~nonzero, F.col("n_ties"))), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum(F.when(nonzero, F.col("n_ties"))), F.lit(0)).alias("_m"),
        F.sum("n_pos").alias("n_pos"),
        F.sum(F.col("n_pos") * F.col("avg_rank")).alias("_v"),
        F.coalesce(F.sum(F.when(nonzero, F.col("n_ties") * F.col("avg_rank"))), F.lit(0.0)).alias("_s1"),
        F.coalesce(
            F.sum(F.when(nonzero, F.col("n_ties") * F.col("avg_rank") * F.col("avg_rank"))), F.lit(0.0)
        ).alias("_s2"),
        _rank_pairs(_method(method), nonzero).alias("_exact"),
    )
    drop = F.col("n_zero") if zero_method == "wilcox" else F.lit(0)
    v = F.col("_v") - F.col("n_pos") * drop
    s1 = F.col("_s1") - F.col("_m") * drop
    s2 = F.col("_s2") - 2 * drop * F.col("_s1") + F.col("_m") * drop * drop
    z = F.try_divide(v - s1 / 2, F.sqrt(s2 / 4))
    shifted = F.transform("_exact", lambda e: F.struct((e["r"] - (2 * drop).cast("int")).alias("r"), e["n"].alias("n")))
    note = (
        F.when(F.col("n_pairs") < 2, "too few pairs").when(F.col("_m") == 0, "all diffs zero").otherwise("")
    )
    usable = note == ""
    return sums.select(
        *by,
        "n_pairs",
        "n_zero",
        F.when(usable, v).alias("statistic"),
        F.when(usable, z).alias("z"),
        F.when(usable, effect_size(z, F.col("n_pairs"))).alias("effect_r"),
        note.alias("note"),
        F.when(usable, shifted).alias("_ranks"),
    )


def with_signed_rank_p(tested: DataFrame, method: str) -> DataFrame:
    """Adds p by ``method`` to :func:`signed_rank` rows made with the same method."""
    p = prob.signed_rank_p(F.col("_ranks"), F.col("statistic") * 2) if _method(method) else prob.normal_two_sided("z")
    return tested.select(
        *[c for c in tested.columns if c != "_ranks"],
        F.when(F.col("note") == "", p).alias("p_value"),
        F.when(F.col("note") == "", method).alias("method"),
    )


def paired_signed_rank(
    df: DataFrame,
    by: Sequence[str],
    unit: str,
    cond: str,
    levels: tuple,
    value: str,
    zero_method: str = "pratt",
    digits: int = 9,
    method: str = "exact",
) -> DataFrame:
    """Signed-rank test with p by ``method`` at every size: ``exact`` or the ``normal`` tail.

    The exact distribution of n pairs takes about n cubed steps in one task per test.
    """
    tested = signed_rank(paired(df, by, unit, cond, levels, value), by, zero_method, digits, method)
    return with_signed_rank_p(tested, method)


def rank_sum_statistic(
    df: DataFrame, by: Sequence[str], group: str, levels: tuple, value: str, method: str = "normal"
) -> DataFrame:
    """Rank sum of the first level, and its tie-corrected Z, per group of tests."""
    by = list(by)
    first, second = levels
    rows = df.filter(F.col(group).isin(first, second))
    ranks = tie_ranks(rows, by, value, {"n_first": F.count(F.when(F.col(group) == first, 1))})
    t = F.col("n_ties").cast("double")
    sums = ranks.groupBy(*by).agg(
        F.max("n_group").alias("n"),
        F.sum("n_first").alias("n1"),
        F.sum(F.col("n_first") * F.col("avg_rank")).alias("w"),
        F.sum(t * t * t - t).alias("_ties"),
        _rank_pairs(_method(method), F.lit(True)).alias("_ranks"),
    )
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.col("w") - n1 * (n + 1) / 2, F.sqrt(var))
    return sums.select(
        *by,
        "n1",
        (F.col("n") - F.col("n1")).alias("n2"),
        "w",
        z.alias("z"),
        "_ranks",
    )


def with_rank_sum_p(s: DataFrame, method: str) -> DataFrame:
    """Adds p by ``method`` to :func:`rank_sum_statistic` rows made with the same method."""
    usable = (F.col("n1") > 0) & (F.col("n2") > 0)
    p = prob.rank_sum_p(F.col("_ranks"), F.col("n1"), F.col("w") * 2) if _method(method) else prob.normal_two_sided("z")
    return s.select(*[c for c in s.columns if c != "_ranks"], F.when(usable, p).alias("p_value"), F.lit(method).alias("method"))


def rank_sum(df: DataFrame, by: Sequence[str], group: str, levels: tuple, value: str, method: str = "exact") -> DataFrame:
    """Two-sample rank-sum test, tie-corrected, with p by ``method`` at every size."""
    return with_rank_sum_p(rank_sum_statistic(df, by, group, levels, value, method), method)


def paired_t_statistic(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    d = F.col("x") - F.col("y")
    sums = pairs.groupBy(*by).agg(
        F.count(d).alias("n_pairs"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    return sums.select(
        *by,
        "n_pairs",
        "mean_diff",
        F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n_pairs").cast("double"))).alias("t"),
        (F.col("n_pairs") - 1).alias("dof"),
    )


def paired_t(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return paired_t_statistic(pairs, by).withColumn(
        "p_value", prob.t_two_sided(F.col("t"), F.col("dof").cast("double"))
    )


def spearman(df: DataFrame, by: Sequence[str], x: str | Column, y: str | Column) -> DataFrame:
    """Rank correlation of complete pairs per group, with n.

    Equal pairs are counted once with a weight; the mid-ranks are joined back to
    the distinct pairs.
    """
    by = list(by)
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    cells = (
        df.select(*by, x.alias("_x"), y.alias("_y"))
        .dropna(subset=["_x", "_y"])
        .groupBy(*by, "_x", "_y")
        .agg(F.count(F.lit(1)).alias("_w"))
    )

    def ranks_of(col: str, out: str) -> DataFrame:
        weighted = cells.groupBy(*by, col).agg(F.sum("_w").alias("_n"))
        placed = running(weighted, by, col, {"_cum": ("sum", F.col("_n"))})
        rank = F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)
        return placed.select(*by, col, rank.alias(out))

    ranked = null_safe_join(
        null_safe_join(cells, ranks_of("_x", "_rx"), [*by, "_x"]), ranks_of("_y", "_ry"), [*by, "_y"]
    )
    # The mean rank is (n+1)/2; centring needs n, so plain sums are combined afterwards.
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(w * rx * rx).alias("_xx"),
        F.sum(w * ry * ry).alias("_yy"),
        F.sum(w * rx * ry).alias("_xy"),
    )
    n = F.col("n").cast("double")
    mid = n * (n + 1) * (n + 1) / 4
    rho = F.try_divide(F.col("_xy") - mid, F.sqrt((F.col("_xx") - mid) * (F.col("_yy") - mid)))
    return sums.select(*by, "n", rho.alias("rho"))


def spearman_p(table: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Asymptotic p of rank correlations from the t distribution."""
    dof = F.col(n).cast("double") - 2
    t = F.col(rho) * F.sqrt(F.try_divide(dof, 1 - F.col(rho) * F.col(rho)))
    return table.withColumn("p_value", prob.t_two_sided(t, dof))


def spearman_table(
    specs: DataFrame, behaviors: DataFrame, measures: DataFrame, min_pairs: int = 3
) -> DataFrame:
    """rho and n per (measure, session, behaviour) of ``specs``.

    ``behaviors``: animal_id, session_type, behavior, value; ``measures``:
    animal_id, measure, score (long). At least ``min_pairs`` pairs are needed.
    """
    wanted = specs.join(behaviors, ["session_type", "behavior"]).join(measures, ["animal_id", "measure"])
    return spearman(wanted, ["measure", "session_type", "behavior"], "value", "score").filter(
        F.col("n") >= min_pairs
    )


def ccc(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Concordance correlation from sample moments of complete pairs."""
    both = df.dropna(subset=[x, y])
    m = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp(x, y).alias("_c"),
        F.var_samp(x).alias("_vx"),
        F.var_samp(y).alias("_vy"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
    )
    gap = F.col("_mx") - F.col("_my")
    value = F.try_divide(2 * F.col("_c"), F.col("_vx") + F.col("_vy") + gap * gap)
    return m.select(*by, "n", F.when(F.col("n") >= min_n, value).alias("ccc"))


def bland_altman(df: DataFrame, by: Sequence[str], manual: str, auto: str) -> DataFrame:
    d = F.col(auto) - F.col(manual)
    s = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd_diff"))
    return s.withColumns(
        {
            "loa_lower": F.col("bias") - LOA_Z * F.col("sd_diff"),
            "loa_upper": F.col("bias") + LOA_Z * F.col("sd_diff"),
        }
    )


def loa_ci(df: DataFrame, by: Sequence[str], manual: str, auto: str, z: float = 1.959963984540054) -> DataFrame:
    """Confidence bounds of the bias and of both limits of agreement (z of the level)."""
    ba = bland_altman(df, by, manual, auto)
    n = F.col("n").cast("double")
    bias = z * F.try_divide(F.col("sd_diff"), F.sqrt(n))
    limit = z * F.sqrt(F.try_divide(3 * F.col("sd_diff") * F.col("sd_diff"), n))
    return ba.withColumns(
        {
            "bias_low": F.col("bias") - bias,
            "bias_high": F.col("bias") + bias,
            "loa_lower_low": F.col("loa_lower") - limit,
            "loa_lower_high": F.col("loa_lower") + limit,
            "loa_upper_low": F.col("loa_upper") - limit,
            "loa_upper_high": F.col("loa_upper") + limit,
        }
    )


def proportional_bias_fit(df: DataFrame, by: Sequence[str], manual: str, auto: str) -> DataFrame:
    """|difference| against the mean: slope, intercept, R2 and rank correlation, without p."""
    by = list(by)
    rows = df.dropna(subset=[manual, auto]).select(
        *by,
        ((F.col(manual) + F.col(auto)) / 2).alias("_avg"),
        F.abs(F.col(auto) - F.col(manual)).alias("_abs"),
    )
    fit = rows.groupBy(*by).agg(
        F.regr_slope("_abs", "_avg").alias("slope"),
        F.regr_intercept("_abs", "_avg").alias("intercept"),
        F.regr_r2("_abs", "_avg").alias("r_squared"),
    )
    rho = spearman(rows, by, F.round("_avg", 9), F.round("_abs", 9))
    if not by:
        return rho.withColumns({c: fit.select(c).scalar() for c in fit.columns})
    return null_safe_join(rho, fit, by)


def proportional_bias(df: DataFrame, by: Sequence[str], manual: str, auto: str) -> DataFrame:
    """Fan-shape check with p values; a fan is flagged when the rank correlation has p < 0.05."""
    fit = spearman_p(proportional_bias_fit(df, by, manual, auto))
    dof = F.col("n").cast("double") - 2
    t = F.sqrt(F.try_divide(F.col("r_squared") * dof, 1 - F.col("r_squared")))
    return fit.withColumnRenamed("p_value", "rho_p").withColumns(
        {"slope_p": prob.t_two_sided(t, dof), "fan_shape": F.col("rho_p") < FAN_ALPHA}
    )


def trend_by_group(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def p_adjust(df: DataFrame, by: Sequence[str], p: str, method: str = "holm", out: str = "p_adj") -> DataFrame:
    """Family-wise (``holm``) or false-discovery (``bh``) adjusted p; NULLs are not in the family.

    Tied p values share one adjusted value, so the running extreme goes over
    distinct values and is joined back to the rows.
    """
    by = list(by)
    ranks = tie_ranks(df, by, p, keep_range=True)
    m = F.col("n_group")
    if method == "holm":
        step = ranks.withColumn("_a", F.least(F.lit(1.0), (m - F.col("n_below")) * F.col("value")))
        adjusted = running(step, by, "value", {out: ("max", F.col("_a"))})
    elif method == "bh":
        step = ranks.withColumn(
            "_a", F.least(F.lit(1.0), F.col("value") * m / (F.col("n_below") + F.col("n_ties")))
        )
        adjusted = running(step, by, "value", {out: ("min", F.col("_a"))}, reverse=True)
    else:
        raise ValueError(f"unknown method: {method}")
    table = adjusted.select(*by, F.col("value").alias(p), out)
    known = null_safe_join(df.filter(F.col(p).isNotNull()), table, [*by, p])
    return known.unionByName(df.filter(F.col(p).isNull()), allowMissingColumns=True)


def delta_check_statistic(df: DataFrame, by: Sequence[str], flag: str, levels: tuple, delta: str, method: str = "normal") -> DataFrame:
    """Difference distribution by flag: sizes, medians, rank sum and Z (no p)."""
    by = list(by)
    first, second = levels
    med = quantiles(df.filter(F.col(flag).isin(first, second)), [*by, flag], delta, {"m": 0.5})
    wide = med.groupBy(*by).agg(
        F.max(F.when(F.col(flag) == first, F.col("m"))).alias("median_first"),
        F.max(F.when(F.col(flag) == second, F.col("m"))).alias("median_second"),
    )
    return null_safe_join(rank_sum_statistic(df, by, flag, levels, delta, method), wide, by)


def delta_check(df: DataFrame, by: Sequence[str], flag: str, levels: tuple, delta: str, method: str = "exact") -> DataFrame:
    """The over-fit and batch checks: rank-sum p per block, BH-adjusted over all blocks.

    The block table is one row per test; it is written once before the
    adjustment looks at it several times.
    """
    tested = cut_lineage(with_rank_sum_p(delta_check_statistic(df, by, flag, levels, delta, method), method))
    return p_adjust(tested, [], "p_value", "bh", "p_fdr")


def qq_points(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Ordered sample beside normal quantiles at (i - a)/(n + 1 - 2a), a = 3/8 up to 10 rows, else 1/2."""
    placed = row_index(df.filter(F.col(value).isNotNull()), by, [value, *order], "_i")
    a = F.when(F.col("n_group") <= 10, 3.0 / 8).otherwise(0.5)
    prob_point = (F.col("_i") + 1 - a) / (F.col("n_group") + 1 - 2 * a)
    points = placed.select(
        *by,
        (F.col("_i") + 1).alias("place"),
        F.col(value).alias("sample"),
        prob_point.alias("probability"),
    )
    return prob.with_normal_quantile(points, "probability", "theoretical")


