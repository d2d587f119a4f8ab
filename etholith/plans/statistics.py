"""Queries for tests, agreement, resampling and adjustment."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from etholith import views as V
from etholith.functions.prob import normal_start_sql, normal_step_sql, normal_two_sided_sql, upper_tail_sql
from etholith.operators import joins as J
from etholith.operators import resample as B
from etholith.operators import spatial as P
from etholith.operators import stats as S
from etholith.operators import windows as W
from etholith.plans import study
from etholith.plans.frames import LATENCY, latency_of
from etholith.plans.register import R, query, rd, rounded
from etholith.plans.relational import (
    BEHAVIORS, DIRECTIONAL, MEASURES, ROLLED, ROUTED_SQL, SESSIONS, SOCIAL, SPECS_SQL, in_sql, rollup_of, totals_of,
)


def _signed_rank_sql(pairs: str, by: str = "") -> str:
    """Signed-rank sums over ``pairs`` (by.., x, y)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {keys}abs(d)"
    group = f"GROUP BY {by}" if by else ""
    return f"""d AS (SELECT {keys}round(x - y, 9) AS d FROM ({pairs}) WHERE x IS NOT NULL AND y IS NOT NULL),
      r AS (SELECT {keys}d, rank() OVER ({part}ORDER BY abs(d)) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS k FROM d),
      s AS (SELECT {keys}count(*) AS n_pairs, count(*) FILTER (d = 0) AS n_zero, coalesce(sum(k) FILTER (d > 0), 0) AS v,
        sum(k) FILTER (d <> 0) AS s1, sum(k * k) FILTER (d <> 0) AS s2 FROM r {group}),
      t AS (SELECT *, (v - s1 / 2) / sqrt(s2 / 4) AS z FROM s)"""


@query(
    "paired_signed_rank",
    f"""WITH {ROUTED_SQL}, {_signed_rank_sql("SELECT behavior, view, animal_id, max(duration) FILTER (session_type = 'S1') AS x, max(duration) FILTER (session_type = 'S2') AS y FROM routed GROUP BY 1, 2, 3", "behavior, view")}
        SELECT behavior, view, n_pairs, n_zero, {R('v')} AS statistic, {R('z')} AS z, {R('z / sqrt(n_pairs)')} AS effect_r,
        CASE WHEN n_pairs < 2 THEN 'too few pairs' WHEN n_zero = n_pairs THEN 'all diffs zero' ELSE '' END AS note FROM t""",
    "bouts",
)
def paired_signed_rank(spark, d):
    routed = J.view_router(totals_of(spark, d), DIRECTIONAL)
    pairs = S.paired(routed, ["behavior", "view"], "animal_id", "session_type", SESSIONS, "duration")
    return rounded(S.signed_rank(pairs, ["behavior", "view"]).drop("_ranks"), "statistic", "z", "effect_r")


@query(
    "latency_signed_rank",
    f"""WITH {LATENCY}, {_signed_rank_sql("SELECT animal_id, max(latency_sec) FILTER (session_type = 'S1') AS x, max(latency_sec) FILTER (session_type = 'S2') AS y FROM latency GROUP BY 1")}
        SELECT n_pairs, n_zero, {R('v')} AS statistic, {R('z')} AS z FROM t""",
    "bouts",
)
def latency_signed_rank(spark, d):
    pairs = S.paired(latency_of(spark, d), [], "animal_id", "session_type", SESSIONS, "latency_sec")
    return rounded(S.signed_rank(pairs, []).select("n_pairs", "n_zero", "statistic", "z"), "statistic", "z")


LONG_ROUTED = ROUTED_SQL.replace("FROM bouts", "FROM (SELECT * FROM bouts WHERE duration_sec >= 0.5)")


def _holm(by: str, order: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"least(1.0, max((m - i + 1) * p) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING))"


BEHAVIOUR_SQL = f"""WITH {LONG_ROUTED}, {_signed_rank_sql("SELECT behavior, view, animal_id, max(duration) FILTER (session_type = 'S1') AS x, max(duration) FILTER (session_type = 'S2') AS y FROM routed GROUP BY 1, 2, 3", "behavior, view")},
        tn AS (SELECT *, CASE WHEN n_pairs < 2 THEN 'too few pairs' WHEN n_zero = n_pairs THEN 'all diffs zero' ELSE '' END AS note FROM t),
        tp AS (SELECT *, CASE WHEN note = '' THEN {normal_two_sided_sql('z')} END AS p FROM tn),
        ad AS (SELECT behavior, view, {_holm('', 'i')} AS h FROM (SELECT *, row_number() OVER (ORDER BY p, behavior, view) AS i, count(*) OVER () AS m FROM tp WHERE p IS NOT NULL)),
        md AS (SELECT behavior, quantile_cont(duration, 0.5) FILTER (session_type = 'S1') AS m1, quantile_cont(duration, 0.5) FILTER (session_type = 'S2') AS m2 FROM routed GROUP BY 1)
        SELECT behavior, view, n_pairs, n_zero, CASE WHEN note = '' THEN {R('v')} END AS statistic, CASE WHEN note = '' THEN {R('z')} END AS z,
        CASE WHEN note = '' THEN {R('z / sqrt(n_pairs)')} END AS effect_r, note, {R('p')} AS p_value, CASE WHEN note = '' THEN 'normal' END AS method,
        {R('h')} AS p_holm, {R('m1')} AS "median_S1", {R('m2')} AS "median_S2" FROM tp LEFT JOIN ad USING (behavior, view) JOIN md USING (behavior)"""


@query("behaviour_report", BEHAVIOUR_SQL, "bouts")
def behaviour_report(spark, d):
    """The normal tail, since the number of animals grows with the tables; the exact one is an argument away."""
    out = study.behaviour_report(V.bouts(spark, d), SESSIONS, BEHAVIORS, DIRECTIONAL, method="normal")
    return rounded(out, "statistic", "z", "effect_r", "p_value", "p_holm", "median_S1", "median_S2")


def _tested_sql(by: str, from_: str = "t") -> str:
    """Columns of a signed-rank test with the normal tail."""
    keys = f"{by}, " if by else ""
    return f"""tn AS (SELECT *, CASE WHEN n_pairs < 2 THEN 'too few pairs' WHEN n_zero = n_pairs THEN 'all diffs zero' ELSE '' END AS note FROM {from_}),
        tp AS (SELECT {keys}n_pairs, n_zero, note, CASE WHEN note = '' THEN v END AS v, CASE WHEN note = '' THEN z END AS z, CASE WHEN note = '' THEN {normal_two_sided_sql('z')} END AS p FROM tn)"""


TESTED = f"n_pairs, n_zero, {R('v')} AS statistic, {R('z')} AS z, {R('z / sqrt(n_pairs)')} AS effect_r, note, {R('p')} AS p_value, CASE WHEN note = '' THEN 'normal' END AS method"


@query(
    "latency_test",
    f"""WITH {LATENCY}, {_signed_rank_sql("SELECT animal_id, max(latency_sec) FILTER (session_type = 'S1') AS x, max(latency_sec) FILTER (session_type = 'S2') AS y FROM latency GROUP BY 1")},
        {_tested_sql('')} SELECT {TESTED} FROM tp""",
    "bouts",
)
def latency_test(spark, d):
    return rounded(study.latency_test(latency_of(spark, d), SESSIONS, method="normal"), "statistic", "z", "effect_r", "p_value")


@query(
    "initiator_test",
    f"""WITH {LONG_ROUTED}, {_signed_rank_sql(f"SELECT behavior, session_type, animal_id, exp_duration_sec AS x, stim_duration_sec AS y FROM totals WHERE behavior IN {in_sql(DIRECTIONAL)}", "behavior, session_type")},
        {_tested_sql('behavior, session_type')},
        ad AS (SELECT behavior, session_type, {_holm('', 'i')} AS h FROM (SELECT *, row_number() OVER (ORDER BY p, behavior, session_type) AS i, count(*) OVER () AS m FROM tp WHERE p IS NOT NULL))
        SELECT behavior, session_type, {TESTED}, {R('h')} AS p_holm FROM tp LEFT JOIN ad USING (behavior, session_type)""",
    "bouts",
)
def initiator_test(spark, d):
    out = study.initiator_test(V.bouts(spark, d), SESSIONS, BEHAVIORS, DIRECTIONAL, method="normal")
    return rounded(out, "statistic", "z", "effect_r", "p_value", "p_holm")


OVER_ANIMALS = """an AS (SELECT animal_id, 'lines' AS channel, sum(manual_total) AS x, sum(auto_total) AS y FROM counts GROUP BY 1
      UNION ALL SELECT animal_id, 'reference', sum(manual_total), sum(ref_total) FROM counts GROUP BY 1)"""


@query(
    "agreement_over_animals",
    f"""WITH {OVER_ANIMALS}, k AS (SELECT channel, x, y, rank() OVER (PARTITION BY channel ORDER BY round(x, 6)) + (count(*) OVER (PARTITION BY channel, round(x, 6)) - 1) / 2.0::DOUBLE AS rx,
          rank() OVER (PARTITION BY channel ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY channel, round(y, 6)) - 1) / 2.0::DOUBLE AS ry FROM an)
        SELECT channel, count(*) AS n, {R('corr(rx, ry)')} AS rho, {R('2 * covar_samp(x, y) / (var_samp(x) + var_samp(y) + (avg(x) - avg(y)) ** 2)')} AS ccc FROM k GROUP BY 1""",
    "counts",
)
def agreement_over_animals(spark, d):
    channels = {"lines": ("manual_total", "auto_total"), "reference": ("manual_total", "ref_total")}
    return rounded(study.agreement_over_animals(V.counts(spark, d), channels), "rho", "ccc")


DELTA = "SELECT *, round(auto_total - manual_total, 6) AS delta, CASE WHEN image_id % 9 = 0 THEN 'Training' ELSE 'Held-out' END AS status FROM counts"


def deltas(spark, d):
    status = F.when(F.col("image_id") % 9 == 0, "Training").otherwise("Held-out")
    return V.counts(spark, d).withColumns(
        {"delta": F.round(F.col("auto_total") - F.col("manual_total"), 6), "status": status}
    )


# The cohorts of the view (order priorities).
COHORTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

RANK_SUM = f"""r AS (SELECT cohort, status, delta, count(*) OVER (PARTITION BY cohort, delta) AS t,
      rank() OVER (PARTITION BY cohort ORDER BY delta) + (count(*) OVER (PARTITION BY cohort, delta) - 1) / 2.0::DOUBLE AS k FROM ({DELTA})),
    s AS (SELECT cohort, count(*) FILTER (status = 'Held-out') AS n1, count(*) FILTER (status = 'Training') AS n2, count(*)::DOUBLE AS n,
      sum(k) FILTER (status = 'Held-out') AS w, sum((t * t - 1)::DOUBLE) AS ties,
      quantile_cont(delta, 0.5) FILTER (status = 'Held-out') AS m1, quantile_cont(delta, 0.5) FILTER (status = 'Training') AS m2 FROM r GROUP BY 1),
    z AS (SELECT *, (w - n1 * (n + 1) / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM s)"""


@query("rank_sum", f"WITH {RANK_SUM} SELECT cohort, n1, n2, {R('w')} AS w, {R('z')} AS z FROM z", "counts")
def rank_sum(spark, d):
    out = S.rank_sum_statistic(deltas(spark, d), ["cohort"], "status", ("Held-out", "Training"), "delta")
    return rounded(out.drop("_ranks"), "w", "z")


@query(
    "overfit_check",
    f"WITH {RANK_SUM} SELECT cohort, n1, n2, {R('w')} AS w, {R('z')} AS z, {R('m1', 4)} AS median_first, {R('m2', 4)} AS median_second FROM z",
    "counts",
)
def overfit_check(spark, d):
    out = S.delta_check_statistic(deltas(spark, d), ["cohort"], "status", ("Held-out", "Training"), "delta")
    return rounded(rounded(out.drop("_ranks"), "w", "z"), "median_first", "median_second", digits=4)


def _adjusted_check(part: str) -> str:
    """Sums ``z`` with p, and Benjamini-Hochberg over all blocks."""
    return f"""zp AS (SELECT *, {normal_two_sided_sql('z')} AS p FROM z),
        bh AS (SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS f
          FROM (SELECT *, row_number() OVER (ORDER BY p, {part}) AS i, count(*) OVER () AS m FROM zp WHERE p IS NOT NULL))
        SELECT {part}, n1, n2, {R('w')} AS w, {R('z')} AS z, {R('m1', 4)} AS median_first, {R('m2', 4)} AS median_second, {R('p')} AS p_value,
        'normal' AS method, {R('f')} AS p_fdr FROM bh"""


def _rounded_check(out):
    return rounded(rounded(out, "w", "z", "p_value", "p_fdr"), "median_first", "median_second", digits=4)


@query("overfit_check_with_p", f"WITH {RANK_SUM}, {_adjusted_check('cohort')}", "counts")
def overfit_check_with_p(spark, d):
    return _rounded_check(S.delta_check(deltas(spark, d), ["cohort"], "status", ("Held-out", "Training"), "delta", method="normal"))


EACH_REST = f"""co AS (SELECT DISTINCT cohort AS batch FROM counts),
    q AS (SELECT status, batch, delta, CASE WHEN cohort = batch THEN 'batch' ELSE 'rest' END AS side FROM ({DELTA}), co),
    r AS (SELECT status, batch, side, delta, count(*) OVER (PARTITION BY status, batch, delta) AS t,
      rank() OVER (PARTITION BY status, batch ORDER BY delta) + (count(*) OVER (PARTITION BY status, batch, delta) - 1) / 2.0::DOUBLE AS k FROM q),
    s AS (SELECT status, batch, count(*) FILTER (side = 'batch') AS n1, count(*) FILTER (side = 'rest') AS n2, count(*)::DOUBLE AS n,
      sum(k) FILTER (side = 'batch') AS w, sum((t * t - 1)::DOUBLE) AS ties,
      quantile_cont(delta, 0.5) FILTER (side = 'batch') AS m1, quantile_cont(delta, 0.5) FILTER (side = 'rest') AS m2 FROM r GROUP BY 1, 2),
    z AS (SELECT *, (w - n1 * (n + 1) / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM s)"""


@query("batch_check_with_p", f"WITH {EACH_REST}, {_adjusted_check('status, batch')}", "counts")
def batch_check_with_p(spark, d):
    """Each of the five cohorts against the rest, among training and among held-out images."""
    sides = [
        F.struct(F.lit(c).alias("batch"), F.when(F.col("cohort") == c, "batch").otherwise("rest").alias("side")) for c in COHORTS
    ]
    rows = deltas(spark, d).select("status", "delta", F.inline(F.array(*sides)))
    return _rounded_check(S.delta_check(rows, ["status", "batch"], "side", ("batch", "rest"), "delta", method="normal"))


@query(
    "paired_t",
    f"""SELECT count(*) AS n_pairs, {R('avg(d)')} AS mean_diff, {R('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t, count(*) - 1 AS dof
        FROM (SELECT o - coalesce(chance, 0) AS d FROM ({ROLLED}))""",
    "counts",
)
def paired_t(spark, d):
    pairs = study.real_chance_pairs(rollup_of(spark, d), "manual_both", "manual_chance_overlap")
    return rounded(S.paired_t_statistic(pairs, []), "mean_diff", "t")


@query(
    "effect_size",
    f"""WITH {_signed_rank_sql(f"SELECT o AS x, coalesce(chance, 0) AS y FROM ({ROLLED})")}
        SELECT n_pairs, {R('z / sqrt(n_pairs)')} AS signed_r, {R('abs(z / sqrt(n_pairs))')} AS absolute_r FROM t""",
    "counts",
)
def effect_size(spark, d):
    tested = S.signed_rank(study.real_chance_pairs(rollup_of(spark, d), "manual_both", "manual_chance_overlap"), [])
    z, n = F.col("z"), F.col("n_pairs")
    return tested.select("n_pairs", rd(S.effect_size(z, n)).alias("signed_r"), rd(S.effect_size(z, n, signed=False)).alias("absolute_r"))


def _mid_rank(col: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0::DOUBLE"


@query(
    "spearman",
    f"""SELECT cohort, count(*) AS n, {R('corr(rx, ry)')} AS rho FROM (SELECT cohort, {_mid_rank('a_only', 'cohort')} AS rx,
        {_mid_rank('n_lines', 'cohort')} AS ry FROM counts) GROUP BY 1""",
    "counts",
)
def spearman(spark, d):
    return rounded(S.spearman(V.counts(spark, d), ["cohort"], "a_only", "n_lines"), "rho")


@query(
    "spearman_sources",
    f"""SELECT cohort, count(*) AS n, {R('corr(rx, ry)')} AS rho FROM (SELECT cohort, {_mid_rank('ref_total', 'cohort')} AS rx,
        {_mid_rank('m', 'cohort')} AS ry FROM (SELECT *, round(manual_total, 4) AS m FROM counts)) GROUP BY 1""",
    "counts",
)
def spearman_sources(spark, d):
    out = S.spearman(V.counts(spark, d), ["cohort"], F.col("ref_total"), F.round("manual_total", 4))
    return rounded(out, "rho")


@query(
    "spearman_table",
    f"""WITH {ROUTED_SQL}, m AS (SELECT animal_id, 'a_density' AS measure, round(ta / (area / 1e6), 6) AS score FROM ({ROLLED})
          UNION ALL SELECT animal_id, 'b_density', round(tb / (area / 1e6), 6) FROM ({ROLLED})
          UNION ALL SELECT animal_id, 'coloc_pct', round(100 * o / nullif(n, 0), 6) FROM ({ROLLED})
          UNION ALL SELECT animal_id, 'overlap_index', CASE WHEN abs(least(ta, tb) - chance) > 1e-9 THEN round((o - chance) / (least(ta, tb) - chance), 6) END FROM ({ROLLED})),
        j AS (SELECT measure, session_type, behavior, round(duration, 6) AS v, score FROM {SPECS_SQL} s JOIN routed USING (session_type) JOIN m USING (animal_id, measure)
          WHERE behavior IN {in_sql(SOCIAL)} AND score IS NOT NULL)
        SELECT measure, session_type, behavior, count(*) AS n, {R('corr(rx, ry)')} AS rho FROM (SELECT measure, session_type, behavior,
          {_mid_rank('v', 'measure, session_type, behavior')} AS rx, {_mid_rank('score', 'measure, session_type, behavior')} AS ry FROM j)
        GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "bouts counts",
)
def spearman_table(spark, d):
    routed = J.view_router(totals_of(spark, d), DIRECTIONAL)
    behaviors = routed.select("animal_id", "session_type", "behavior", F.round("duration", 6).alias("value"))
    r = rollup_of(spark, d)
    room = F.least("manual_a_total", "manual_b_total") - F.col("manual_chance_overlap")
    scores = r.select(
        "animal_id", F.round("manual_a_density", 6).alias("a_density"), F.round("manual_b_density", 6).alias("b_density"),
        F.round("manual_coloc_pct", 6).alias("coloc_pct"),
        F.when(F.abs(room) > 1e-9, F.round("manual_overlap_index", 6)).alias("overlap_index"),
    ).unpivot(["animal_id"], list(MEASURES), "measure", "score")
    return rounded(S.spearman_table(J.cross_specs(MEASURES, SOCIAL, spark), behaviors, scores), "rho")


@query(
    "ccc",
    f"""SELECT cohort, count(*) AS n, {R('2 * covar_samp(manual_total, auto_total) / (var_samp(manual_total) + var_samp(auto_total) + (avg(manual_total) - avg(auto_total)) ** 2)')}
        AS ccc FROM counts GROUP BY 1""",
    "counts",
)
def ccc(spark, d):
    return rounded(S.ccc(V.counts(spark, d), ["cohort"], "manual_total", "auto_total"), "ccc")


BA = """SELECT cohort, count(*) AS n, avg(auto_total - manual_total) AS b, stddev_samp(auto_total - manual_total) AS s FROM counts GROUP BY 1"""


@query(
    "bland_altman",
    f"""SELECT cohort, n, {R('b', 4)} AS bias, {R('s', 4)} AS sd_diff, {R('b - 1.96 * s', 4)} AS loa_lower, {R('b + 1.96 * s', 4)} AS loa_upper FROM ({BA})""",
    "counts",
)
def bland_altman(spark, d):
    return rounded(S.bland_altman(V.counts(spark, d), ["cohort"], "manual_total", "auto_total"), "bias", "sd_diff", "loa_lower", "loa_upper", digits=4)


Z = "1.959963984540054"


@query(
    "loa_ci",
    f"""SELECT cohort, n, {R(f'b - {Z} * s / sqrt(n)', 4)} AS bias_low, {R(f'b + {Z} * s / sqrt(n)', 4)} AS bias_high,
        {R(f'b - 1.96 * s - {Z} * sqrt(3 * s * s / n)', 4)} AS loa_lower_low, {R(f'b - 1.96 * s + {Z} * sqrt(3 * s * s / n)', 4)} AS loa_lower_high,
        {R(f'b + 1.96 * s - {Z} * sqrt(3 * s * s / n)', 4)} AS loa_upper_low, {R(f'b + 1.96 * s + {Z} * sqrt(3 * s * s / n)', 4)} AS loa_upper_high FROM ({BA})""",
    "counts",
)
def loa_ci(spark, d):
    out = S.loa_ci(V.counts(spark, d), ["cohort"], "manual_total", "auto_total").drop("bias", "sd_diff", "loa_lower", "loa_upper")
    return rounded(out, *[c for c in out.columns if c not in ("cohort", "n")], digits=4)


@query(
    "proportional_bias",
    f"""WITH a AS (SELECT cohort, (manual_total + auto_total) / 2 AS m, abs(auto_total - manual_total) AS e FROM counts),
        f AS (SELECT cohort, regr_slope(e, m) AS s, regr_intercept(e, m) AS i, regr_r2(e, m) AS r2 FROM a GROUP BY 1),
        k AS (SELECT cohort, {_mid_rank('round(m, 9)', 'cohort')} AS rx, {_mid_rank('round(e, 9)', 'cohort')} AS ry FROM a)
        SELECT cohort, n, {R('rho')} AS rho, {R('s')} AS slope, {R('i', 4)} AS intercept, {R('r2')} AS r_squared FROM f
        JOIN (SELECT cohort, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1) USING (cohort)""",
    "counts",
)
def proportional_bias(spark, d):
    out = S.proportional_bias_fit(V.counts(spark, d), ["cohort"], "manual_total", "auto_total")
    return rounded(rounded(out, "rho", "slope", "r_squared"), "intercept", digits=4)


def t_two_sided_sql(t: str, dof: str) -> str:
    """Two-sided t tail for whole degrees of freedom by its finite series."""
    c2 = f"({dof} / ({dof} + {t} * {t}))"
    angle = f"atan(abs({t}) / sqrt({dof}))"

    def series(last: str, ratio: str) -> str:
        return f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({last}, 0, -1), lambda k: k::DOUBLE)), lambda a, k: 1 + {ratio} * {c2} * a)"

    even = f"sin({angle}) * {series(f'({dof})::BIGINT // 2 - 1', '((2 * k - 1) / (2 * k))')}"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {series(f'(({dof})::BIGINT - 3) // 2', '(2 * k / (2 * k + 1))')})"
    return f"(1 - CASE WHEN ({dof})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END)"


@query(
    "proportional_bias_with_p",
    f"""WITH a AS (SELECT cohort, (manual_total + auto_total) / 2 AS m, abs(auto_total - manual_total) AS e FROM counts),
        f AS (SELECT cohort, regr_slope(e, m) AS s, regr_intercept(e, m) AS i, regr_r2(e, m) AS r2 FROM a GROUP BY 1),
        k AS (SELECT cohort, {_mid_rank('round(m, 9)', 'cohort')} AS rx, {_mid_rank('round(e, 9)', 'cohort')} AS ry FROM a),
        g AS (SELECT cohort, n, rho, s, i, r2, (n - 2)::DOUBLE AS dof, rho * sqrt((n - 2) / (1 - rho * rho)) AS t1, sqrt(r2 * (n - 2) / (1 - r2)) AS t2
          FROM f JOIN (SELECT cohort, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1) USING (cohort)),
        h AS (SELECT *, {t_two_sided_sql('t1', 'dof')} AS p1, {t_two_sided_sql('t2', 'dof')} AS p2 FROM g)
        SELECT cohort, n, {R('rho')} AS rho, {R('p1')} AS rho_p, {R('s')} AS slope, {R('i', 4)} AS intercept, {R('r2')} AS r_squared, {R('p2')} AS slope_p,
        p1 < 0.05 AS fan_shape FROM h""",
    "counts",
)
def proportional_bias_with_p(spark, d):
    out = S.proportional_bias(V.counts(spark, d), ["cohort"], "manual_total", "auto_total")
    return rounded(rounded(out, "rho", "rho_p", "slope", "r_squared", "slope_p"), "intercept", digits=4)


@query(
    "trend_by_group",
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY animal_id, image_id) AS k FROM counts),
        l AS (SELECT cohort, k, 'GFP' AS channel, a_only + both_n AS v FROM o UNION ALL SELECT cohort, k, 'cFos', b_only + both_n FROM o)
        SELECT channel, cohort, count(*) AS n, {R('regr_slope(v, k)', 8)} AS slope, {R('regr_intercept(v, k)')} AS intercept FROM l GROUP BY 1, 2""",
    "counts",
)
def trend_by_group(spark, d):
    ordered = W.cohort_order(V.counts(spark, d), "cohort", ["animal_id", "image_id"])
    long = (
        ordered.select("cohort", "cohort_order", (F.col("a_only") + F.col("both_n")).alias("GFP"), (F.col("b_only") + F.col("both_n")).alias("cFos"))
        .unpivot(["cohort", "cohort_order"], ["GFP", "cFos"], "channel", "value")
    )
    return rounded(rounded(S.trend_by_group(long, ["channel", "cohort"], "cohort_order", "value"), "intercept"), "slope", digits=8)


PVALS = "SELECT image_id, cohort, CASE WHEN image_id % 97 <> 0 THEN ((image_id * 7919) % 10007) / 10007.0::DOUBLE END AS p FROM counts"


def p_values(spark, d):
    return V.counts(spark, d).select(
        "image_id", "cohort", F.when(F.col("image_id") % 97 != 0, (F.col("image_id") * 7919) % 10007 / F.lit(10007.0)).alias("p")
    )


@query(
    "p_adjust_holm",
    f"""WITH v AS ({PVALS}), o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cohort) AS m FROM v WHERE p IS NOT NULL
          WINDOW w AS (PARTITION BY cohort ORDER BY p, image_id))
        SELECT image_id, {R('least(1.0, max((m - i + 1) * p) OVER (PARTITION BY cohort ORDER BY p, image_id ROWS UNBOUNDED PRECEDING))')} AS p_adj FROM o
        UNION ALL SELECT image_id, NULL FROM v WHERE p IS NULL""",
    "counts",
)
def p_adjust_holm(spark, d):
    return rounded(S.p_adjust(p_values(spark, d), ["cohort"], "p", "holm").select("image_id", "p_adj"), "p_adj")


@query(
    "p_adjust_bh",
    f"""WITH v AS ({PVALS}), o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY cohort) AS m FROM v WHERE p IS NOT NULL
          WINDOW w AS (PARTITION BY cohort ORDER BY p, image_id))
        SELECT image_id, {R('least(1.0, min(p * m / i) OVER (PARTITION BY cohort ORDER BY i DESC ROWS UNBOUNDED PRECEDING))')} AS p_adj FROM o
        UNION ALL SELECT image_id, NULL FROM v WHERE p IS NULL""",
    "counts",
)
def p_adjust_bh(spark, d):
    return rounded(S.p_adjust(p_values(spark, d), ["cohort"], "p", "bh").select("image_id", "p_adj"), "p_adj")


@query(
    "qq_points",
    f"""SELECT place, {R('v')} AS sample, {R('(place - 0.5) / n')} AS probability FROM (SELECT o - chance AS v, row_number() OVER (ORDER BY round(o - chance, 9), animal_id) AS place,
        count(*) OVER () AS n FROM ({ROLLED}) WHERE chance IS NOT NULL)""",
    "counts",
)
def qq_points(spark, d):
    diff = rollup_of(spark, d).select("animal_id", F.round(F.col("manual_both") - F.col("manual_chance_overlap"), 9).alias("diff"))
    return rounded(S.qq_points(diff, [], "diff", ["animal_id"]).drop("theoretical"), "sample", "probability")


QQ_BLOCKS = "SELECT animal_id % 8 AS block, animal_id, round(o - chance, 9) AS v FROM (" + ROLLED + ") WHERE chance IS NOT NULL"


@query(
    "qq_points_with_quantiles",
    f"""WITH b AS ({QQ_BLOCKS}), o AS (SELECT block, v, row_number() OVER (PARTITION BY block ORDER BY v, animal_id) AS place, count(*) OVER (PARTITION BY block) AS n FROM b),
        q AS (SELECT *, CASE WHEN n <= 10 THEN (place - 0.375) / (n + 0.25) ELSE (place - 0.5) / n END::DOUBLE AS pr FROM o),
        q0 AS (SELECT *, {normal_start_sql('pr')} AS x0 FROM q), q1 AS (SELECT *, {normal_step_sql('pr', 'x0')} AS e FROM q0)
        SELECT block, place, {R('v')} AS sample, {R('pr')} AS probability, {R('x0 - e / (1 + x0 * e / 2)')} AS theoretical FROM q1""",
    "counts",
)
def qq_points_with_quantiles(spark, d):
    diff = rollup_of(spark, d).select(
        (F.col("animal_id") % 8).alias("block"), "animal_id", F.round(F.col("manual_both") - F.col("manual_chance_overlap"), 9).alias("diff")
    )
    return rounded(S.qq_points(diff, ["block"], "diff", ["animal_id"]), "sample", "probability", "theoretical")


KEY_TESTS = f"ro AS ({ROLLED}), " + ", ".join(
    _signed_rank_sql(f"SELECT {x}::DOUBLE AS x, coalesce({y}, 0)::DOUBLE AS y FROM ro")
    .replace("d AS (", f"d{i} AS (", 1).replace("r AS (SELECT", f"r{i} AS (SELECT", 1).replace("FROM d)", f"FROM d{i})")
    .replace("s AS (SELECT", f"s{i} AS (SELECT", 1).replace("FROM r )", f"FROM r{i})").replace("t AS (SELECT", f"t{i} AS (SELECT", 1).replace("FROM s)", f"FROM s{i})")
    for i, (x, y) in enumerate((("ta", "tb"), ("o", "chance")))
)


def _median_iqr(name: str, col: str) -> str:
    return (
        f"SELECT 'A' AS block, '{name} (median, IQR)' AS test, quantile_cont({col}, 0.5) AS statistic, "
        f"quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) AS effect_size, count({col}) AS n FROM ro"
    )


@query(
    "key_stats",
    f"""WITH {KEY_TESTS}, u AS (
        SELECT 'A' AS block, 'GFP vs cFos (signed rank)' AS test, z AS statistic, abs(z / sqrt(n_pairs)) AS effect_size, n_pairs AS n FROM t0
        UNION ALL SELECT 'A', 'Real vs chance overlap (signed rank)', z, abs(z / sqrt(n_pairs)), n_pairs FROM t1
        UNION ALL SELECT 'A', 'Real vs chance overlap (paired t)', avg(o - coalesce(chance, 0)) / (stddev_samp(o - coalesce(chance, 0)) / sqrt(count(*))), NULL, count(*) FROM ro
        UNION ALL {_median_iqr('GFP counts', 'ta')} UNION ALL {_median_iqr('cFOS counts', 'tb')} UNION ALL {_median_iqr('Colocalized', 'o')}
        UNION ALL {_median_iqr('Chance overlap', 'chance')}
        UNION ALL SELECT 'B', 'Agreement CCC ' || cohort, 2 * covar_samp(manual_total, auto_total) / (var_samp(manual_total) + var_samp(auto_total) + (avg(manual_total) - avg(auto_total)) ** 2), NULL, count(*) FROM counts GROUP BY cohort
        UNION ALL SELECT 'B', 'Bias ' || cohort, b, s, n FROM ({BA}))
        SELECT block, test, {R('statistic', 4)} AS statistic, {R('effect_size', 4)} AS effect_size, n FROM u""",
    "counts",
)
def key_stats(spark, d):
    out = study.key_stats(V.counts(spark, d), rollup_of(spark, d), "manual_total", "auto_total")
    return rounded(out, "statistic", "effect_size", digits=4)


@query(
    "agreement_per_animal",
    f"""SELECT animal_id, count(*) AS n, {R('CASE WHEN count(*) >= 3 THEN 2 * covar_samp(manual_total, auto_total) / (var_samp(manual_total) + var_samp(auto_total) + (avg(manual_total) - avg(auto_total)) ** 2) END')} AS ccc,
        {R('avg(auto_total - manual_total)', 4)} AS bias, {R('stddev_samp(auto_total - manual_total)', 4)} AS sd_diff FROM counts GROUP BY 1""",
    "counts",
)
def agreement_per_animal(spark, d):
    out = study.agreement(V.counts(spark, d), ["animal_id"], "manual_total", "auto_total")
    return rounded(rounded(out.select("animal_id", "n", "ccc", "bias", "sd_diff"), "ccc"), "bias", "sd_diff", digits=4)


# ---------------------------------------------------------------- resampling


@query(
    "bootstrap_replicates",
    f"""WITH v AS (SELECT row_number() OVER (ORDER BY animal_id) - 1 AS idx, o - coalesce(chance, 0) AS x, count(*) OVER () AS n FROM ({ROLLED})),
        a AS (SELECT rep, draw, n, (48271 * rep + 16807 * draw + 69621 + 12345) % 2147483647 AS h1 FROM (SELECT max(n) AS n FROM v), range(1, 2001) r(rep), range(0, n) q(draw)),
        b AS (SELECT *, (h1 * h1) % 2147483647 AS h2 FROM a), c AS (SELECT *, (48271 * h2 + 16807 * h1 + 1013904223) % 2147483647 AS h3 FROM b),
        e AS (SELECT rep, (((h3 * h3) % 2147483647 + 31 * h1) % 2147483647) % n AS idx FROM c)
        SELECT rep, {R('avg(x)')} AS mean FROM e JOIN v USING (idx) GROUP BY rep""",
    "counts",
)
def bootstrap_replicates(spark, d):
    pairs = study.real_chance_pairs(rollup_of(spark, d), "manual_both", "manual_chance_overlap")
    diffs = pairs.select("animal_id", (F.col("x") - F.col("y")).alias("diff"))
    return rounded(B.replicate_means(diffs, [], "diff", ["animal_id"]), "mean")


def _below_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {upper_tail_sql(f'abs({x})')} ELSE 1e0 - {upper_tail_sql(f'abs({x})')} END)"


# Row numbers drawn by replicate ``rep`` out of ``n`` rows, as the counter hash draws them.
DRAWS = """a AS (SELECT rep, draw, n, (48271 * rep + 16807 * draw + 69621 + 12345) % 2147483647 AS h1 FROM (SELECT max(n) AS n FROM v), range(1, 2001) r(rep), range(0, n) q(draw)),
        b AS (SELECT *, (h1 * h1) % 2147483647 AS h2 FROM a), c AS (SELECT *, (48271 * h2 + 16807 * h1 + 1013904223) % 2147483647 AS h3 FROM b),
        e AS (SELECT rep, (((h3 * h3) % 2147483647 + 31 * h1) % 2147483647) % n AS idx FROM c)"""


def _bca_sql(digits: int) -> str:
    """Bounds from ``m`` (rep, stat) and ``j`` (n, theta, flat, accel)."""
    at = "reps[floor({0})::INTEGER + 1] + ({0} - floor({0})) * (reps[ceil({0})::INTEGER + 1] - reps[floor({0})::INTEGER + 1])"
    return f"""p0 AS (SELECT j.*, (SELECT count(*) FILTER (stat < theta - 1e-9 * greatest(1, abs(theta))) / count(*)::DOUBLE FROM m) AS below, (SELECT list(stat ORDER BY stat) FROM m) AS reps FROM j),
        p1 AS (SELECT *, {normal_start_sql('below')} AS x0 FROM p0), p2 AS (SELECT *, {normal_step_sql('below', 'x0')} AS e0 FROM p1),
        p3 AS (SELECT *, x0 - e0 / (1 + x0 * e0 / 2) AS z0 FROM p2),
        p4 AS (SELECT *, z0 - 1.9599639845400545 AS zl, z0 + 1.9599639845400545 AS zh FROM p3),
        p5 AS (SELECT *, z0 + zl / (1 - accel * zl) AS ul, z0 + zh / (1 - accel * zh) AS uh FROM p4),
        p6 AS (SELECT *, (len(reps) - 1) * {_below_sql('ul')} AS il, (len(reps) - 1) * {_below_sql('uh')} AS ih FROM p5),
        p7 AS (SELECT *, {at.format('il')} AS lo, {at.format('ih')} AS hi FROM p6)
        SELECT n, {R('theta', digits)} AS theta, CASE WHEN n >= 3 AND NOT flat THEN {R('lo', digits)} END AS ci_low,
        CASE WHEN n >= 3 AND NOT flat THEN {R('hi', digits)} END AS ci_high FROM p7"""


def _draws_by(by: str) -> str:
    return DRAWS.replace("SELECT rep,", f"SELECT {by}, rep,").replace("(SELECT max(n) AS n FROM v)", f"(SELECT {by}, max(n) AS n FROM v GROUP BY {by})")


def _bounds_by_sql(by: str, digits: int) -> str:
    """From ``m`` (by, rep, stat) and ``j`` (by, n, theta, flat, accel) to ``ci`` (by, n, theta, ci_low, ci_high)."""
    one = _bca_sql(digits)
    steps = one[one.index("p1 AS"):one.index("SELECT n, ")].rstrip()
    final = one[one.index("SELECT n, "):].replace("SELECT n, ", f"SELECT {by}, n, ", 1)
    return f"""rl AS (SELECT {by}, list(stat ORDER BY stat) AS reps FROM m GROUP BY {by}),
        pr AS (SELECT *, len(list_filter(reps, lambda s: s < theta - 1e-9 * greatest(1, abs(theta)))) / len(reps)::DOUBLE AS b FROM j JOIN rl USING ({by})),
        p0 AS (SELECT * EXCLUDE (b), CASE WHEN b > 0 AND b < 1 THEN b END AS below FROM pr), {steps}, ci AS ({final})"""


def _bca_by_sql(by: str, digits: int) -> str:
    """Intervals of the mean of ``v`` (by, idx, x, n) per group."""
    return f"""{_draws_by(by)}, m AS (SELECT {by}, rep, avg(x) AS stat FROM e JOIN v USING ({by}, idx) GROUP BY {by}, rep),
        th AS (SELECT {by}, count(*) AS n, avg(x) AS theta, min(x) = max(x) AS flat FROM v GROUP BY {by}),
        j AS (SELECT {by}, any_value(th.n) AS n, any_value(theta) AS theta, any_value(flat) AS flat,
          -sum((theta - x) ** 3) / (6 * nullif(sum((theta - x) ** 2) ** 1.5, 0)) AS accel FROM v JOIN th USING ({by}) GROUP BY {by}),
        {_bounds_by_sql(by, digits)}"""


@query(
    "bca_ci_mean",
    f"""WITH v AS (SELECT row_number() OVER (ORDER BY animal_id) - 1 AS idx, (o - coalesce(chance, 0))::DOUBLE AS x, count(*) OVER () AS n FROM ({ROLLED})),
        {DRAWS}, m AS (SELECT rep, avg(x) AS stat FROM e JOIN v USING (idx) GROUP BY rep),
        s AS (SELECT count(*) AS n, avg(x) AS theta, min(x) = max(x) AS flat FROM v),
        j AS (SELECT any_value(s.n) AS n, any_value(theta) AS theta, any_value(flat) AS flat, -sum((theta - x) ** 3) / (6 * sum((theta - x) ** 2) ** 1.5) AS accel FROM v, s),
        {_bca_sql(5)}""",
    "counts",
)
def bca_ci_mean(spark, d):
    pairs = study.real_chance_pairs(rollup_of(spark, d), "manual_both", "manual_chance_overlap")
    out = B.bca_ci_mean(pairs.select("animal_id", (F.col("x") - F.col("y")).alias("diff")), [], "diff", ["animal_id"])
    return rounded(out, "theta", "ci_low", "ci_high", digits=5)


def _ccc_sql(n: str, sx: str, sy: str, sxx: str, syy: str, sxy: str) -> str:
    return f"2 * ({sxy} - {sx} * {sy} / {n}) / ({sxx} - {sx} * {sx} / {n} + {syy} - {sy} * {sy} / {n} + (({sx} - {sy}) / {n}) ** 2 * ({n} - 1))"


@query(
    "bca_ci_ccc",
    f"""WITH an AS (SELECT animal_id, sum(manual_total) AS p, sum(auto_total) AS q FROM counts GROUP BY 1),
        v AS (SELECT row_number() OVER (ORDER BY animal_id) - 1 AS idx, p - avg(p) OVER () AS x, q - avg(p) OVER () AS y, count(*) OVER () AS n FROM an),
        {DRAWS}, k AS (SELECT rep, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM e JOIN v USING (idx) GROUP BY rep),
        m AS (SELECT rep, {_ccc_sql('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS stat FROM k),
        w AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy,
          min(x) = max(x) AND min(y) = max(y) AS flat FROM v),
        l AS (SELECT w.n, flat, {_ccc_sql('w.n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS theta,
          {_ccc_sql('(w.n - 1)', '(sx - x)', '(sy - y)', '(sxx - x * x)', '(syy - y * y)', '(sxy - x * y)')} AS loo FROM v, w),
        g AS (SELECT *, avg(loo) OVER () - loo AS d FROM l),
        j AS (SELECT any_value(n)::BIGINT AS n, any_value(theta) AS theta, any_value(flat) AS flat, sum(d ** 3) / (6 * sum(d ** 2) ** 1.5) AS accel FROM g),
        {_bca_sql(6)}""",
    "counts",
)
def bca_ci_ccc(spark, d):
    animals = V.counts(spark, d).groupBy("animal_id").agg(F.sum("manual_total").alias("m"), F.sum("auto_total").alias("a"))
    return rounded(B.bca_ci_ccc(animals, [], "m", "a", ["animal_id"]), "theta", "ci_low", "ci_high")


# ---------------------------------------------------------------- spatial


@query(
    "radius_count",
    """SELECT image_id, count(*) FILTER (marker = 'GFP') AS n_probe, count(*) FILTER (marker = 'cFOS') AS n_target,
        count(*) FILTER (marker = 'GFP' AND EXISTS (SELECT 1 FROM points b WHERE b.image_id = p.image_id AND b.marker = 'cFOS'
          AND sqrt(((p.x - b.x) ** 2 + (p.y - b.y) ** 2)::DOUBLE) <= 10)) AS n_overlap FROM points p GROUP BY 1""",
    "points",
)
def radius_count(spark, d):
    return P.radius_count(V.points(spark, d), ["image_id"], 10.0)


def keyed_points(spark, d, marker: str):
    return V.points(spark, d).filter(F.col("marker") == marker).select("image_id", F.struct(*V.ORDER_KEY).alias("key"), "x", "y")


@query(
    "match_candidates",
    f"""SELECT a.image_id, count(*) AS n_pairs, {R('sum(sqrt(((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::DOUBLE))')} AS total_dist FROM points a
        JOIN points b ON a.image_id = b.image_id AND a.marker = 'GFP' AND b.marker = 'cFOS' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 GROUP BY 1""",
    "points",
)
def match_candidates(spark, d):
    pairs = P.candidate_pairs(keyed_points(spark, d, "GFP"), keyed_points(spark, d, "cFOS"), ["image_id"], 10.0)
    return pairs.groupBy("image_id").agg(F.count("*").alias("n_pairs"), rd(F.sum("dist")).alias("total_dist"))


GREEDY = f"""RECURSIVE ga AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {', '.join(V.ORDER_KEY)}) AS k FROM points WHERE marker = 'GFP'),
    gb AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {', '.join(V.ORDER_KEY)}) AS k FROM points WHERE marker = 'cFOS'),
    near AS (SELECT a.image_id, a.k, any_value(a.l_orderkey) AS a_order, list(struct_pack(d := (a.x - b.x) ** 2 + (a.y - b.y) ** 2, k := b.k, o := b.l_orderkey)
        ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.k) AS spots
      FROM ga a JOIN gb b ON a.image_id = b.image_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100 GROUP BY 1, 2),
    turn AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) AS i FROM near),
    walk AS (SELECT DISTINCT image_id, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS a_order, NULL::BIGINT AS b_order, NULL::DOUBLE AS d FROM turn
      UNION ALL SELECT image_id, i, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit.k) END, a_order, hit.o, hit.d FROM (
        SELECT w.image_id, t.i, w.taken, t.a_order, list_filter(t.spots, lambda s: NOT list_contains(w.taken, s.k))[1] AS hit
        FROM walk w JOIN turn t ON t.image_id = w.image_id AND t.i = w.i + 1)),
    matched AS (SELECT image_id, a_order, b_order, sqrt(d) AS dist FROM walk WHERE b_order IS NOT NULL)"""


@query("greedy_nearest_match", f"WITH {GREEDY} SELECT image_id, a_order, b_order, {R('dist')} AS dist FROM matched", "points")
def greedy_nearest_match(spark, d):
    m = P.greedy_nearest_match(keyed_points(spark, d, "GFP"), keyed_points(spark, d, "cFOS"), ["image_id"])
    return m.select("image_id", F.col("a_key.l_orderkey").alias("a_order"), F.col("b_key.l_orderkey").alias("b_order"), rd("dist").alias("dist"))


@query(
    "colocalisation_counts",
    f"""WITH {GREEDY}, n AS (SELECT image_id, count(*) FILTER (marker = 'GFP') AS g, count(*) FILTER (marker = 'cFOS') AS c FROM points GROUP BY 1),
        q AS (SELECT image_id, g, c, coalesce(p, 0) AS p FROM n LEFT JOIN (SELECT image_id, count(*) AS p FROM matched GROUP BY 1) USING (image_id))
        SELECT image_id, g AS total_gfp, c AS total_cfos, p AS double_positive, g - p AS gfp_only, c - p AS cfos_only FROM q""",
    "points",
)
def colocalisation_counts(spark, d):
    m = P.greedy_nearest_match(keyed_points(spark, d, "GFP"), keyed_points(spark, d, "cFOS"), ["image_id"])
    return P.coloc_counts(V.points(spark, d), m)


def rotated_sql(radius: int, tag: str = "") -> str:
    """Rotation counts ``o`` and observed counts ``re`` at ``radius``, by the angles at which two points meet; names end in ``tag``."""
    return f"""g{tag} AS (SELECT image_id, avg(x) FILTER (marker = 'GFP') AS cx, avg(y) FILTER (marker = 'GFP') AS cy FROM points GROUP BY 1
      HAVING count(*) FILTER (marker = 'GFP') >= 2 AND count(*) FILTER (marker = 'cFOS') >= 2),
    h1{tag} AS (SELECT image_id, rotation, (48271 * rotation + 16807 * (image_id % 1000003) + {69_621 * 123 + 12_345}) % {B.P} AS h FROM g{tag}, range(1, {B.ROTATIONS + 1}) r(rotation)),
    h3{tag} AS (SELECT *, (48271 * ((h * h) % {B.P}) + 16807 * h + 1013904223) % {B.P} AS k FROM h1{tag}),
    t{tag} AS (SELECT image_id, rotation, (((k * k) % {B.P} + 31 * h) % {B.P}) % 3600000 / 10000.0::DOUBLE AS a FROM h3{tag}),
    p{tag} AS (SELECT image_id, marker, row_number() OVER () AS pid, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, degrees(atan2(y - cy, x - cx)) AS at FROM points JOIN g{tag} USING (image_id)),
    w{tag} AS (SELECT i.image_id, i.pid, j.at - i.at AS mid, CASE WHEN i.r + j.r <= {radius} + 1e-9 THEN 180
        ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 1 + ((i.r - j.r) ** 2 - {radius * radius}) / (2 * i.r * j.r))))) END + 1e-8 AS half
      FROM p{tag} i JOIN p{tag} j ON i.image_id = j.image_id AND i.marker = 'GFP' AND j.marker = 'cFOS' AND abs(i.r - j.r) <= {radius} + 1e-9),
    h{tag} AS (SELECT image_id, rotation, count(DISTINCT pid) AS overlap FROM w{tag} JOIN t{tag} USING (image_id)
      WHERE abs(a - mid - 360 * round((a - mid) / 360)) <= half GROUP BY 1, 2),
    o{tag} AS (SELECT t{tag}.image_id, t{tag}.rotation, coalesce(overlap, 0) AS overlap FROM t{tag} LEFT JOIN h{tag} USING (image_id, rotation)),
    re{tag} AS (SELECT image_id, count(*) AS real_overlap FROM points p WHERE marker = 'GFP' AND EXISTS (SELECT 1 FROM points b WHERE b.image_id = p.image_id
      AND b.marker = 'cFOS' AND (p.x - b.x) ** 2 + (p.y - b.y) ** 2 <= {radius * radius}) GROUP BY 1)"""


ROTATED = rotated_sql(10)
P_SQL = "least(1.0, 2 * least((count(*) FILTER (overlap >= r) + 1) / (count(*) + 1), (count(*) FILTER (overlap <= r) + 1) / (count(*) + 1)))"
NULL_SQL = f"""WITH {ROTATED}, c AS (SELECT image_id, overlap, coalesce(real_overlap, 0) AS r FROM o LEFT JOIN re USING (image_id))
    SELECT image_id, max(r) AS real_overlap, count(*) AS n_rotations, count(*) FILTER (overlap >= r) AS n_ge, count(*) FILTER (overlap <= r) AS n_le, {R(P_SQL)} AS p_value
    FROM c GROUP BY 1 UNION ALL SELECT DISTINCT image_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
    FROM points WHERE image_id NOT IN (SELECT image_id FROM c)"""
HISTOGRAM_SQL = f"""WITH {ROTATED} SELECT image_id, overlap, count(*) AS n_rotations, coalesce(any_value(real_overlap), 0) AS real_overlap FROM o
    LEFT JOIN re USING (image_id) GROUP BY 1, 2"""


@query("rotation_null", NULL_SQL, "points")
def rotation_null(spark, d):
    return rounded(B.rotation_null(V.points(spark, d), ["image_id"], 10.0), "p_value")


@query("null_distribution", HISTOGRAM_SQL, "points")
def null_distribution(spark, d):
    points = V.points(spark, d)
    return null_histogram(points, "image_id", B.angle_table(points, ["image_id"]))


def null_histogram(points, group: str, angles):
    turned = B.rotated_overlaps(points, [group], 10.0, angles)
    real = P.radius_count(points, [group], 10.0).select(group, F.col("n_overlap").alias("real_overlap"))
    return B.null_distribution(turned, real, [group])


def _tested(radius: int) -> str:
    tag = f"_{radius}"
    return f"""{rotated_sql(radius, tag)}, pt{tag} AS (SELECT count(*) AS n_tested, count(*) FILTER (p < 0.05) AS n_sig FROM (SELECT image_id, {P_SQL} AS p
        FROM (SELECT o.image_id, overlap, coalesce(real_overlap, 0) AS r FROM o{tag} o LEFT JOIN re{tag} w USING (image_id)) GROUP BY 1))"""


CHANCE_SQL = f"""WITH ro AS ({ROLLED}), {_signed_rank_sql("SELECT o::DOUBLE AS x, coalesce(chance, 0)::DOUBLE AS y FROM ro").replace("t AS (SELECT", "sr AS (SELECT")},
        v AS (SELECT row_number() OVER (ORDER BY animal_id) - 1 AS idx, (o - coalesce(chance, 0))::DOUBLE AS x, count(*) OVER () AS n FROM ro),
        {DRAWS}, m AS (SELECT rep, avg(x) AS stat FROM e JOIN v USING (idx) GROUP BY rep),
        w0 AS (SELECT count(*) AS n, avg(x) AS theta, min(x) = max(x) AS flat, stddev_samp(x) AS sd FROM v),
        j AS (SELECT any_value(w0.n) AS n, any_value(theta) AS theta, any_value(flat) AS flat, -sum((theta - x) ** 3) / (6 * sum((theta - x) ** 2) ** 1.5) AS accel FROM v, w0),
        bca AS (WITH {_bca_sql(5)}), tt AS (SELECT theta / (sd / sqrt(n)) AS t, (n - 1)::DOUBLE AS dof FROM w0),
        {_tested(5)}, {_tested(10)}
        SELECT n_pairs, {R('z')} AS wilcoxon_z, {R('abs(z / sqrt(n_pairs))')} AS effect_r, {R(normal_two_sided_sql('z'))} AS wilcoxon_p, 'normal' AS method,
        {R('tt.t')} AS t, dof::BIGINT AS dof, {R(t_two_sided_sql('tt.t', 'dof'))} AS t_p, bca.theta AS mean_diff, ci_low, ci_high,
        (SELECT {R('avg(CASE WHEN abs(least(ta, tb) - chance) > 1e-9 THEN (o - chance) / (least(ta, tb) - chance) END)', 5)} FROM ro) AS mean_overlap_index,
        pt_5.n_tested AS n_tested_5, pt_5.n_sig AS n_sig_5, pt_10.n_tested AS n_tested_10, pt_10.n_sig AS n_sig_10 FROM sr, tt, bca, pt_5, pt_10"""


@query("real_vs_chance", CHANCE_SQL, "points counts")
def real_vs_chance(spark, d):
    out = study.real_vs_chance(rollup_of(spark, d), V.points(spark, d), "image_id", method="normal")
    out = rounded(out, "wilcoxon_z", "effect_r", "wilcoxon_p", "t", "t_p")
    return rounded(out, "mean_diff", "ci_low", "ci_high", "mean_overlap_index", digits=5)


# Names of an earlier round, when the three above made 20 rotations: the same rows.
query("rotation_null_full", NULL_SQL, "points")(rotation_null)
query("null_distribution_full", HISTOGRAM_SQL, "points")(null_distribution)
query("real_vs_chance_full", CHANCE_SQL, "points counts")(real_vs_chance)


DIFFS = """v AS (SELECT behavior, view, row_number() OVER (PARTITION BY behavior, view ORDER BY animal_id) - 1 AS idx, x, count(*) OVER (PARTITION BY behavior, view) AS n
        FROM (SELECT behavior, view, animal_id, (max(duration) FILTER (session_type = 'S1') - max(duration) FILTER (session_type = 'S2'))::DOUBLE AS x FROM routed GROUP BY 1, 2, 3) WHERE x IS NOT NULL)"""
REPORT_CI_SQL = (
    f"WITH {LONG_ROUTED}, {DIFFS}, {_bca_by_sql('behavior, view', 6)}, report AS (" + BEHAVIOUR_SQL.replace(f"{LONG_ROUTED}, ", "")
    + ") SELECT report.*, theta AS mean_diff, ci_low, ci_high FROM report LEFT JOIN ci USING (behavior, view)"
)


@query("behaviour_report_ci", REPORT_CI_SQL, "bouts")
def behaviour_report_ci(spark, d):
    out = study.behaviour_report(V.bouts(spark, d), SESSIONS, BEHAVIORS, DIRECTIONAL, method="normal", intervals=True)
    return rounded(out, "statistic", "z", "effect_r", "p_value", "p_holm", "median_S1", "median_S2", "mean_diff", "ci_low", "ci_high")


@query("key_stats_full")
def key_stats_full(spark, d):
    out = study.key_stats_full(deltas(spark, d), rollup_of(spark, d), "manual_total", "auto_total", "cohort", COHORTS, method="normal")
    return rounded(rounded(out, "statistic", "effect_size", digits=4), "p_value", "p_fdr")


CHANNELS = {"GFP": ("manual_total", "auto_total"), "cFOS": ("manual_total", "ref_total"), "both": ("auto_total", "ref_total")}


def _ccc_by_sql(by: str, digits: int) -> str:
    """Concordance and its interval per group of ``v`` (by, idx, x, y, n), x and y about the mean of x."""
    sums = "sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy"
    return f"""{_draws_by(by)}, kk AS (SELECT {by}, rep, count(*)::DOUBLE AS n, {sums} FROM e JOIN v USING ({by}, idx) GROUP BY {by}, rep),
        m AS (SELECT {by}, rep, {_ccc_sql('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS stat FROM kk),
        w AS (SELECT {by}, count(*)::DOUBLE AS nn, {sums}, min(x) = max(x) AND min(y) = max(y) AS flat FROM v GROUP BY {by}),
        l AS (SELECT {by}, nn, flat, {_ccc_sql('nn', 'sx', 'sy', 'sxx', 'syy', 'sxy')} AS theta,
          {_ccc_sql('(nn - 1)', '(sx - x)', '(sy - y)', '(sxx - x * x)', '(syy - y * y)', '(sxy - x * y)')} AS loo FROM v JOIN w USING ({by})),
        gg AS (SELECT *, avg(loo) OVER (PARTITION BY {by}) - loo AS dd FROM l),
        j AS (SELECT {by}, any_value(nn)::BIGINT AS n, any_value(theta) AS theta, any_value(flat) AS flat, sum(dd ** 3) / (6 * sum(dd ** 2) ** 1.5) AS accel FROM gg GROUP BY {by}),
        {_bounds_by_sql(by, digits)}"""


LONG_CHANNELS = "lo AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, image_id, animal_id, cohort, status, {x}::DOUBLE AS x, {y}::DOUBLE AS y, round({y} - {x}, 6) AS delta FROM ({DELTA})" for c, (x, y) in CHANNELS.items()
) + ")"
CHANNEL_TESTS = EACH_REST[EACH_REST.index("r AS (SELECT"):].replace("status, batch", "channel, kind").replace("'batch'", "'first'").replace("'rest'", "'second'").replace("z AS (SELECT", "zz AS (SELECT")


@query(
    "key_stats_channels",
    f"""WITH {LONG_CHANNELS}, un AS (SELECT channel, 'images' AS level, image_id AS unit, x, y FROM lo
          UNION ALL SELECT channel, 'animals', animal_id, sum(x), sum(y) FROM lo GROUP BY channel, animal_id),
        v AS (SELECT channel, level, row_number() OVER (PARTITION BY channel, level ORDER BY unit) - 1 AS idx, x - avg(x) OVER (PARTITION BY channel, level) AS x,
          y - avg(x) OVER (PARTITION BY channel, level) AS y, count(*) OVER (PARTITION BY channel, level) AS n FROM un),
        {_ccc_by_sql('channel, level', 6)},
        rk AS (SELECT channel, {_mid_rank('round(x, 6)', 'channel')} AS rx, {_mid_rank('round(y, 6)', 'channel')} AS ry FROM un WHERE level = 'animals'),
        rh AS (SELECT channel, 'animals' AS level, corr(rx, ry) AS rho FROM rk GROUP BY 1),
        ba AS (SELECT channel, count(*) AS n, avg(y - x) AS bi, stddev_samp(y - x) AS sd FROM lo GROUP BY 1),
        q AS (SELECT channel, 'overfit' AS kind, delta, CASE status WHEN 'Held-out' THEN 'first' ELSE 'second' END AS side FROM lo
          UNION ALL SELECT channel, 'batch', delta, CASE cohort WHEN '{COHORTS[0]}' THEN 'first' ELSE 'second' END FROM lo),
        {CHANNEL_TESTS}, zp AS (SELECT *, {normal_two_sided_sql('z')} AS p FROM zz),
        fa AS (SELECT channel, kind, least(1.0, min(p * mm / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS f
          FROM (SELECT *, row_number() OVER (ORDER BY p, channel, kind) AS i, count(*) OVER () AS mm FROM zp WHERE channel IN ('GFP', 'cFOS') AND p IS NOT NULL)),
        er AS (SELECT channel, status, avg(abs(delta)) AS er, count(*) AS n FROM lo GROUP BY 1, 2)
        SELECT channel, 'ccc_' || level AS test, {R('theta')} AS statistic, CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS DOUBLE) AS p_fdr, {R('rho')} AS effect_size, n, ci_low AS low, ci_high AS high
          FROM ci LEFT JOIN rh USING (channel, level)
        UNION ALL SELECT channel, 'bias', {R('bi', 4)}, NULL, NULL, {R('sd', 4)}, n, {R('bi - 1.96 * sd', 4)}, {R('bi + 1.96 * sd', 4)} FROM ba
        UNION ALL SELECT channel, kind, {R('z')}, {R('p')}, {R('f')}, NULL, n1 + n2, {R('m1', 4)}, {R('m2', 4)} FROM zp LEFT JOIN fa USING (channel, kind)
        UNION ALL SELECT channel, 'error_' || CASE status WHEN 'Held-out' THEN 'held_out' ELSE 'training' END, {R('er', 4)}, NULL, NULL, NULL, n, NULL, NULL FROM er""",
    "counts",
)
def key_stats_channels(spark, d):
    """The validation part of the result table for three channels; one family of four adjusted tests."""
    out = study.channel_stats(deltas(spark, d), CHANNELS, COHORTS[0], method="normal")
    fine, five = F.col("test").isin("overfit", "batch"), F.col("test").startswith("ccc_")
    digits = lambda c, a, b: F.when(a, rd(c, b[0])).otherwise(rd(c, b[1]))
    return out.withColumns(
        {
            **{c: digits(c, five | fine, (6, 4)) for c in ("statistic", "effect_size")},
            **{c: digits(c, five, (6, 4)) for c in ("low", "high")},
            "p_value": rd("p_value"), "p_fdr": rd("p_fdr"),
        }
    )
