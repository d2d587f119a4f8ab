"""Whole study analyses composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from etholith.operators import aggregates as A
from etholith.operators import filters as L
from etholith.operators import joins as J
from etholith.operators import resample as B
from etholith.operators import stats as S
from etholith.operators.ordered import null_safe_join, quantiles
from etholith.session import cut_lineage


def routed_durations(
    bouts: DataFrame, sessions: Sequence[str], behaviors: Sequence[str], directional: Sequence[str]
) -> DataFrame:
    """Time per animal, session and behaviour after the duration filter, in the view that is tested."""
    totals = A.bout_totals(L.min_duration(bouts), sessions, behaviors)
    return J.view_router(totals, directional).select(
        "animal_id", "session_type", "behavior", "view", "duration", "n_bouts"
    )


def behaviour_report(
    bouts: DataFrame, sessions: tuple[str, str], behaviors: Sequence[str], directional: Sequence[str], method: str = "exact",
    intervals: bool = False,
) -> DataFrame:
    """Per behaviour: medians of both sessions, signed-rank test, effect size and Holm p.

    With ``intervals`` also the mean difference of the sessions and its BCa bounds.
    The routed totals (one row per animal, session and behaviour) and the tests
    (one row per behaviour) are written once; each is read by several branches.
    """
    routed = cut_lineage(routed_durations(bouts, sessions, behaviors, directional))
    tests = cut_lineage(S.paired_signed_rank(routed, ["behavior", "view"], "animal_id", "session_type", sessions, "duration", method=method))
    med = quantiles(routed, ["behavior", "session_type"], "duration", {"m": 0.5})
    wide = med.groupBy("behavior").agg(
        *[F.max(F.when(F.col("session_type") == s, F.col("m"))).alias(f"median_{s}") for s in sessions]
    )
    out = S.p_adjust(tests, [], "p_value", "holm", "p_holm").join(wide, "behavior")
    if not intervals:
        return out
    sides = [F.max(F.when(F.col("session_type") == s, F.col("duration"))) for s in sessions]
    diff = routed.groupBy("behavior", "view", "animal_id").agg((sides[0] - sides[1]).alias("diff"))
    ci = B.bca_ci_mean(diff, ["behavior", "view"], "diff", ["animal_id"]).withColumnRenamed("theta", "mean_diff").drop("n")
    return null_safe_join(out, ci, ["behavior", "view"], "left")


def latency_test(latency: DataFrame, sessions: tuple[str, str], method: str = "exact") -> DataFrame:
    """Signed-rank test of the first-contact latency between the sessions."""
    return S.paired_signed_rank(latency, [], "animal_id", "session_type", sessions, "latency_sec", method=method)


def initiator_test(
    bouts: DataFrame, sessions: Sequence[str], behaviors: Sequence[str], directional: Sequence[str], method: str = "exact"
) -> DataFrame:
    """Time started by the subject against time started by the partner, per directional behaviour and session."""
    totals = A.bout_totals(L.min_duration(bouts), sessions, behaviors).filter(F.col("behavior").isin(list(directional)))
    pairs = totals.select("behavior", "session_type", "animal_id", F.col("exp_duration_sec").alias("x"), F.col("stim_duration_sec").alias("y"))
    by = ["behavior", "session_type"]
    tests = cut_lineage(S.with_signed_rank_p(S.signed_rank(pairs, by, method=method), method))
    return S.p_adjust(tests, [], "p_value", "holm", "p_holm")


def agreement_over_animals(images: DataFrame, channels: Mapping[str, tuple[str, str]], animal: str = "animal_id", digits: int = 6) -> DataFrame:
    """Sums per animal and channel, then rank correlation and concordance across animals."""
    sums = images.groupBy(animal).agg(*[F.sum(c).alias(c) for c in dict.fromkeys(c for pair in channels.values() for c in pair)])
    sides = [F.struct(F.lit(name).alias("channel"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for name, (x, y) in channels.items()]
    long = sums.select(animal, F.inline(F.array(*sides)))
    rho = S.spearman(long, ["channel"], F.round("x", digits), F.round("y", digits))
    return null_safe_join(rho, S.ccc(long, ["channel"], "x", "y").drop("n"), ["channel"])


def real_chance_pairs(animals: DataFrame, real: str, chance: str) -> DataFrame:
    """Observed beside chance overlap per animal; a missing value counts 0."""
    return animals.select(
        F.coalesce(F.col(real), F.lit(0.0)).cast("double").alias("x"),
        F.coalesce(F.col(chance), F.lit(0.0)).cast("double").alias("y"),
        "animal_id",
    )


def real_vs_chance(
    animals: DataFrame,
    points: DataFrame,
    group: str,
    radii: Sequence[float] = (5.0, 10.0),
    n_rotations: int = B.ROTATIONS,
    reps: int = B.REPLICATES,
    method: str = "exact",
    angles: DataFrame | None = None,
) -> DataFrame:
    """One row: paired tests, bootstrap interval, overlap index and rotation-null summary."""
    pairs = real_chance_pairs(animals, "manual_both", "manual_chance_overlap")
    ranked = S.with_signed_rank_p(S.signed_rank(pairs, [], method=method), method)
    wilcoxon = ranked.select(
        "n_pairs", F.col("z").alias("wilcoxon_z"), F.abs("effect_r").alias("effect_r"), F.col("p_value").alias("wilcoxon_p"), "method"
    )
    t = S.paired_t(pairs, []).select("t", "dof", F.col("p_value").alias("t_p"))
    ci = B.bca_ci_mean(
        pairs.select("animal_id", (F.col("x") - F.col("y")).alias("diff")), [], "diff", ["animal_id"], reps
    ).select(F.col("theta").alias("mean_diff"), "ci_low", "ci_high")
    index = animals.agg(F.avg("manual_overlap_index").alias("mean_overlap_index"))
    out = wilcoxon
    extra = [t, ci, index]
    tested = cut_lineage(B.rotation_nulls(points, [group], radii, n_rotations, angles=angles))
    for r in radii:
        p = tested.filter(F.col("radius") == float(r))
        extra.append(
            p.agg(
                F.count("p_value").alias(f"n_tested_{int(r)}"),
                F.count(F.when(F.col("p_value") < 0.05, 1)).alias(f"n_sig_{int(r)}"),
            )
        )
    for part in extra:
        out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    return out


def agreement(images: DataFrame, by: Sequence[str], manual: str, auto: str, digits: int = 9) -> DataFrame:
    """Rank correlation, concordance and limits of agreement side by side.

    Totals count to ``digits``: what the order of their summation leaves in the last bits, it may not leave in a result.
    """
    by = list(by)
    images = images.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in dict.fromkeys((manual, auto))})
    joined = null_safe_join(
        S.spearman(images, by, manual, auto), S.ccc(images, by, manual, auto).drop("n"), by
    )
    return null_safe_join(joined, S.bland_altman(images, by, manual, auto).drop("n"), by)


def _row(df: DataFrame, block: str, test: Column | str, statistic: Column, effect: Column, n: Column) -> DataFrame:
    name = F.lit(test) if isinstance(test, str) else test
    return df.select(
        F.lit(block).alias("block"), name.alias("test"), statistic.cast("double").alias("statistic"),
        effect.cast("double").alias("effect_size"), n.cast("long").alias("n"),
    )


def key_stats(images: DataFrame, animals: DataFrame, manual: str, auto: str, by: str = "cohort") -> DataFrame:
    """Every test and descriptive as tidy rows (block, test, statistic, effect_size, n).

    Block A holds the animal-level tests, block B the agreement of the sources.
    p values are added where wanted from the tests' own functions.
    """
    none = F.lit(None).cast("double")
    tests = [
        ("GFP vs cFos (signed rank)", "manual_a_total", "manual_b_total"),
        ("Real vs chance overlap (signed rank)", "manual_both", "manual_chance_overlap"),
    ]
    parts = []
    for name, x, y in tests:
        r = S.signed_rank(real_chance_pairs(animals, x, y), [])
        parts.append(_row(r, "A", name, F.col("z"), F.abs("effect_r"), F.col("n_pairs")))
    t = S.paired_t_statistic(real_chance_pairs(animals, "manual_both", "manual_chance_overlap"), [])
    parts.append(_row(t, "A", "Real vs chance overlap (paired t)", F.col("t"), none, F.col("n_pairs")))
    for name, col in (("GFP counts", "manual_a_total"), ("cFOS counts", "manual_b_total"), ("Colocalized", "manual_both"), ("Chance overlap", "manual_chance_overlap")):
        m = A.descriptives(animals, [], col)
        parts.append(_row(m, "A", f"{name} (median, IQR)", F.col("median_value"), F.col("iqr"), F.col("n_values")))
    c = S.ccc(images, [by], manual, auto)
    parts.append(_row(c, "B", F.concat(F.lit("Agreement CCC "), F.col(by)), F.col("ccc"), none, F.col("n")))
    b = S.bland_altman(images, [by], manual, auto)
    parts.append(_row(b, "B", F.concat(F.lit("Bias "), F.col(by)), F.col("bias"), F.col("sd_diff"), F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _result(df: DataFrame, block: str, test: Column | str, note: Column, **values: Column) -> DataFrame:
    name = F.lit(test) if isinstance(test, str) else test
    numbers = [values.get(c, F.lit(None)).cast("double").alias(c) for c in ("statistic", "p_value", "effect_size")]
    return df.select(F.lit(block).alias("block"), name.alias("test"), *numbers, values.get("n", F.lit(None)).cast("long").alias("n"), note.alias("note"))


# The labels and notes below are fixed values: names of rows in the study's result table.


def key_stats_full(
    images: DataFrame, animals: DataFrame, manual: str, auto: str, by: str, batches: Sequence[str],
    flag: str = "status", levels: tuple[str, str] = ("Held-out", "Training"), method: str = "exact",
) -> DataFrame:
    """The whole result table: block, test, statistic, p_value, effect_size, n, note, p_fdr.

    :func:`key_stats` with p values, overlap index, bootstrap and concordance intervals, agreement over
    animals, and the over-fit and batch checks of ``auto - manual``, whose p values are one family (``p_fdr``).
    """
    text = F.format_string
    pairs = real_chance_pairs(animals, "manual_both", "manual_chance_overlap")
    parts = []
    for name, p in (("GFP vs cFos", real_chance_pairs(animals, "manual_a_total", "manual_b_total")), ("Real vs chance overlap", pairs)):
        r = S.with_signed_rank_p(S.signed_rank(p, [], method=method), method)
        parts.append(_result(r, "A", f"{name} (signed rank)", F.col("note"), statistic=F.col("z"), p_value=F.col("p_value"), effect_size=F.abs("effect_r"), n=F.col("n_pairs")))
    parts.append(_result(S.paired_t(pairs, []), "A", "Real vs chance overlap (paired t)", F.lit(""), statistic=F.col("t"), p_value=F.col("p_value"), n=F.col("n_pairs")))
    for name, col in (("GFP counts", "manual_a_total"), ("cFOS counts", "manual_b_total"), ("Colocalized", "manual_both"), ("Chance overlap", "manual_chance_overlap")):
        m = null_safe_join(A.descriptives(animals, [], col).withColumn("_k", F.lit(1)), animals.agg(F.avg(col).alias("_mean")).withColumn("_k", F.lit(1)), ["_k"])
        parts.append(_result(m, "A", f"{name} (median, IQR)", text("mean=%.1f", "_mean"), statistic=F.col("median_value"), effect_size=F.col("iqr"), n=F.col("n_values")))
    index = animals.agg(F.avg("manual_overlap_index").alias("m"), F.count("manual_overlap_index").alias("n"))
    parts.append(_result(index, "A", "Overlap index (mean across animals)", F.lit("0=chance level, 1=theoretical max"), statistic=F.col("m"), n=F.col("n")))
    span = text("95%% CI [%.2f, %.2f]", "ci_low", "ci_high")
    boot = B.bca_ci_mean(pairs.select("animal_id", (F.col("x") - F.col("y")).alias("diff")), [], "diff", ["animal_id"])
    parts.append(_result(boot, "A", "Bootstrap 95% CI, real-chance diff", span, statistic=F.col("theta"), n=F.col("n")))

    image_ci = B.bca_ci_ccc(images, [by], manual, auto, ["image_id"])
    parts.append(_result(image_ci, "B", F.concat(F.lit("Agreement CCC "), F.col(by)), span, statistic=F.col("theta"), n=F.col("n")))
    sums = images.groupBy("animal_id").agg(F.sum(manual).alias("m"), F.sum(auto).alias("a"))
    rho = agreement_over_animals(images, {"all": (manual, auto)}).select("channel", "rho")
    own = B.bca_ci_ccc(sums, [], "m", "a", ["animal_id"]).withColumn("channel", F.lit("all"))
    parts.append(_result(null_safe_join(own, rho, ["channel"]), "B", "Agreement CCC, per animal", F.concat(span, text(", rho=%.2f", "rho")), statistic=F.col("theta"), n=F.col("n")))
    b = S.bland_altman(images, [by], manual, auto)
    limits = text("95%% LoA [%.2f, %.2f]", F.col("bias") - 1.96 * F.col("sd_diff"), F.col("bias") + 1.96 * F.col("sd_diff"))
    parts.append(_result(b, "B", F.concat(F.lit("Bias "), F.col(by)), limits, statistic=F.col("bias"), effect_size=F.col("sd_diff"), n=F.col("n")))

    gap = images.withColumn("delta", F.round(F.col(auto) - F.col(manual), 6))
    sides = [F.struct(F.lit(c).alias("batch"), F.when(F.col(by) == c, "batch").otherwise("rest").alias("side")) for c in batches]
    split = gap.select("delta", F.inline(F.array(*sides)))
    for name, df, key, column, pair in (("Overfitting ", gap, by, flag, levels), ("Batch ", split, "batch", "side", ("batch", "rest"))):
        r = S.with_rank_sum_p(S.delta_check_statistic(df, [key], column, pair, "delta", method), method)
        note = text(f"exploratory, FDR; median {pair[0]}=%.1f, {pair[1]}=%.1f", "median_first", "median_second")
        parts.append(_result(r, "B", F.concat(F.lit(name), F.col(key)), note, statistic=F.col("z"), p_value=F.col("p_value"), n=F.col("n1") + F.col("n2")))
    error = gap.groupBy(by, flag).agg(F.avg(F.abs("delta")).alias("e"), F.count("delta").alias("n"))
    parts.append(_result(error, "B", F.concat_ws(" ", F.lit("Mean |error|"), by, flag), F.lit(""), statistic=F.col("e"), n=F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = cut_lineage(out)
    family = F.col("note").startswith("exploratory, FDR")
    return S.p_adjust(out.filter(family), [], "p_value", "bh", "p_fdr").unionByName(out.filter(~F.coalesce(family, F.lit(False))), allowMissingColumns=True)


def channel_stats(
    images: DataFrame,
    channels: Mapping[str, tuple[str, str]],
    batch: str,
    by: str = "cohort",
    family: Sequence[str] = ("GFP", "cFOS"),
    flag: str = "status",
    levels: tuple[str, str] = ("Held-out", "Training"),
    method: str = "exact",
) -> DataFrame:
    """Validation of the automatic counts per channel, as rows (channel, test, statistic, p_value, p_fdr, effect_size, n, low, high).

    ``channels`` names the manual and the automatic column of each. ``ccc_images`` and ``ccc_animals`` are
    concordances over images and over animals' sums with their bootstrap interval (``low``, ``high``), the
    second with the rank correlation as ``effect_size``; ``bias`` has the spread of the differences and the
    limits of agreement; ``overfit`` (by ``flag``) and ``batch`` (the one against the rest) are rank-sum
    tests of ``auto - manual`` with both medians, and those of the ``family`` channels are adjusted
    together; ``error_*`` is the mean absolute difference per level of ``flag``.
    """
    sides = [F.struct(F.lit(c).alias("channel"), F.col(m).cast("double").alias("x"), F.col(a).cast("double").alias("y")) for c, (m, a) in channels.items()]
    long = cut_lineage(images.select("image_id", "animal_id", by, flag, F.inline(F.array(*sides))))
    animals = long.groupBy("channel", "animal_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    def unit(df: DataFrame, level: str, key: str) -> DataFrame:
        return df.select("channel", F.lit(level).alias("level"), F.col(key).cast("long").alias("unit"), "x", "y")

    def row(df: DataFrame, test: Column, **values: Column) -> DataFrame:
        numbers = [values.get(c, F.lit(None)).cast("double").alias(c) for c in ("statistic", "p_value", "p_fdr", "effect_size")]
        ends = [values.get(c, F.lit(None)).cast("double").alias(c) for c in ("low", "high")]
        return df.select("channel", test.alias("test"), *numbers, values["n"].cast("long").alias("n"), *ends)

    both = cut_lineage(unit(long, "images", "image_id").union(unit(animals, "animals", "animal_id")))
    rho = S.spearman(animals, ["channel"], F.round("x", 6), F.round("y", 6)).select("channel", F.lit("animals").alias("level"), "rho")
    ccc = null_safe_join(B.bca_ci_ccc(both, ["channel", "level"], "x", "y", ["unit"]), rho, ["channel", "level"], "left")
    parts = [row(ccc, F.concat(F.lit("ccc_"), "level"), statistic=F.col("theta"), effect_size=F.col("rho"), n=F.col("n"), low=F.col("ci_low"), high=F.col("ci_high"))]
    b = S.bland_altman(long, ["channel"], "x", "y")
    parts.append(row(b, F.lit("bias"), statistic=F.col("bias"), effect_size=F.col("sd_diff"), n=F.col("n"), low=F.col("loa_lower"), high=F.col("loa_upper")))
    gap = long.withColumn("delta", F.round(F.col("y") - F.col("x"), 6))
    checks = F.array(
        F.struct(F.lit("overfit").alias("check"), F.when(F.col(flag) == levels[0], "first").when(F.col(flag) == levels[1], "second").alias("side")),
        F.struct(F.lit("batch").alias("check"), F.when(F.col(by) == batch, "first").otherwise("second").alias("side")),
    )
    split = gap.select("channel", "delta", F.inline(checks))
    tested = cut_lineage(S.with_rank_sum_p(S.delta_check_statistic(split, ["channel", "check"], "side", ("first", "second"), "delta", method), method))
    own = F.coalesce(F.col("channel").isin(list(family)), F.lit(False))
    adjusted = S.p_adjust(tested.filter(own), [], "p_value", "bh", "p_fdr").unionByName(tested.filter(~own), allowMissingColumns=True)
    parts.append(
        row(adjusted, F.col("check"), statistic=F.col("z"), p_value=F.col("p_value"), p_fdr=F.col("p_fdr"), n=F.col("n1") + F.col("n2"), low=F.col("median_first"), high=F.col("median_second"))
    )
    errors = gap.filter(F.col(flag).isin(*levels)).groupBy("channel", flag).agg(F.avg(F.abs("delta")).alias("e"), F.count("delta").alias("n"))
    parts.append(row(errors, F.concat(F.lit("error_"), F.lower(F.regexp_replace(flag, "[^A-Za-z]", "_"))), statistic=F.col("e"), n=F.col("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
