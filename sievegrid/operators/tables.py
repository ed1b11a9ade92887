"""Extension, diagnostic and report tables: contrasts of arms, doses, stability, reliability, responses and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import all_of, any_of, n_unique, null_safe_join, safe_sum

ARM = ["learner", "condition", "dose", "parameter", "tuning_value"]


def arm_is(condition: str, dose: int | None = None, tuning: float | None = None) -> Column:
    """One arm of a learner; without a tuning value, the one that is not tuned."""
    same_dose = F.col("dose").isNull() if dose is None else F.col("dose") == dose
    same_tuning = F.col("parameter").isNull() if tuning is None else F.col("tuning_value") == tuning
    return (F.col("condition") == condition) & same_dose & same_tuning


def seed_recalls(families: DataFrame, minima: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, seed, arm, population, alpha, recall, families): macro recall; minima: (experiment, min_trials); scopes: (scope, experiment).

    Each row counts once a scope that its experiment is in, so pooled and single scopes are one grouped pass.
    """
    least = F.when(F.col("population") == "federation-wide", 1).otherwise(F.col("min_trials"))
    usable = families.where(F.col("population").isin("federation-wide", "own-domain")).join(minima, "experiment").where(F.col("trials") >= least)
    scoped = usable.join(scopes, "experiment").withColumn("recall", F.col("hits") / F.col("trials"))
    return scoped.groupBy("scope", "seed", *ARM, "population", "alpha").agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("families"))


def arm_difference(recalls: DataFrame, learner: str, first: Column, second: Column) -> DataFrame:
    """(scope, population, alpha, seed, difference) of two arms, where both are."""
    keys = ["scope", "population", "alpha", "seed"]
    wide = recalls.where(F.col("learner") == learner).groupBy(*keys).agg(F.max(F.when(first, F.col("recall"))).alias("a"), F.max(F.when(second, F.col("recall"))).alias("b"))
    return wide.select(*keys, (F.col("a") - F.col("b")).alias("difference")).where("difference is not null")


def double_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    keys = ["scope", "population", "alpha", "seed"]
    both = first.join(second.withColumnRenamed("difference", "other"), keys)
    return both.select(*keys, (F.col("difference") - F.col("other")).alias("difference"))


def dose_consistency(exposure: DataFrame, targets: DataFrame) -> DataFrame:
    """(experiment, measure, level, checked, mismatched, rows): realised dose at peers, none at targets."""
    keys = ["experiment", "seed", "salt", "family"]
    own = exposure.join(targets.select(*keys, F.col("client").alias("target")).distinct(), keys).where("dose is not null")
    peer = F.col("client") != F.col("target")
    per = own.groupBy(*keys, "dose").agg(safe_sum(F.when(peer, F.col("rows"))).alias("peer_rows"), safe_sum(F.when(~peer, F.col("rows"))).alias("target_rows"))
    cells = F.array(
        F.struct(F.lit("realised-dose").alias("measure"), (F.col("peer_rows") != F.col("dose")).alias("bad"), F.col("peer_rows").alias("n")),
        F.struct(F.lit("target-zero").alias("measure"), (F.col("target_rows") != 0).alias("bad"), F.col("target_rows").alias("n")),
    )
    long = per.select("experiment", F.col("dose").alias("level"), F.explode(cells).alias("c")).select("experiment", "level", "c.*")
    return long.groupBy("experiment", "measure", "level").agg(F.count(F.lit(1)).alias("checked"), F.count_if("bad").alias("mismatched"), F.sum("n").alias("rows"))


def dose_family_curves(families: DataFrame) -> DataFrame:
    """(experiment, population, alpha, learner, family, dose, gain, seeds): mean gain over dose 0 of the same run and client."""
    rows = families.where("condition = 'peer-present' and trials > 0 and parameter is null").withColumn("recall", F.col("hits") / F.col("trials"))
    run = Window.partitionBy("experiment", "seed", "salt", "population", "alpha", "learner", "client", "family")
    gains = rows.withColumn("gain", F.col("recall") - F.max(F.when(F.col("dose") == 0, F.col("recall"))).over(run)).where("gain is not null")
    return gains.groupBy("experiment", "population", "alpha", "learner", "family", "dose").agg(F.avg("gain").alias("gain"), F.count_distinct("seed").alias("seeds"))


def dose_increments(curves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high, step): gain from each level to the next, for each 10 rows of dose."""
    up = Window.partitionBy(*keys).orderBy("dose")
    steps = curves.where("dose is not null").withColumns({"low": F.lag("dose").over(up), "before": F.lag("gain").over(up)}).where("low is not null")
    return steps.select(*keys, "low", F.col("dose").alias("high"), ((F.col("gain") - F.col("before")) / (F.col("dose") - F.col("low")) * 10).alias("step"))


def response_classes(curves: DataFrame, keys: list[str], onset: float, early: int) -> DataFrame:
    """(keys, top_gain, natural_gain, onset_dose, response): first level whose mean reaches the onset; early, late or none."""
    top = F.max_by("gain", "dose")
    first = F.min(F.when((F.col("gain") >= onset) & F.col("dose").isNotNull(), F.col("dose")))
    out = curves.groupBy(*keys).agg(top.alias("top_gain"), F.max(F.when(F.col("dose").isNull(), F.col("gain"))).alias("natural_gain"), first.alias("onset_dose"))
    response = F.when(~(F.col("top_gain") >= onset) | F.col("top_gain").isNull(), F.lit("nonresponsive")).when(F.col("onset_dose") <= early, F.lit("early")).otherwise(F.lit("late"))
    return out.withColumn("response", response)


def stability_grid(pairs: DataFrame, selection: DataFrame) -> DataFrame:
    """(family, seed, eligible_pairs, eligible_test_rows, eligible) for every selected family and seed; pairs: with seed."""
    grid = selection.select("family").crossJoin(pairs.select("seed").distinct())
    support = pairs.where("eligible").groupBy("family", "seed").agg(F.count(F.lit(1)).alias("eligible_pairs"), F.sum("target_test_rows").alias("eligible_test_rows"))
    filled = grid.join(support, ["family", "seed"], "left").na.fill(0, ["eligible_pairs", "eligible_test_rows"])
    return filled.withColumn("eligible", F.col("eligible_pairs") > 0)


def large_family_table(effects: DataFrame, novelty: DataFrame | None, least_trials: int) -> DataFrame:
    """(learner, family, gain, gain_sd, seeds, min_trials, enough, novelty): one row a family."""
    seeds = effects.groupBy("learner", "family", "seed").agg(F.avg("knowledge_gain").alias("gain"), F.min("trials").alias("trials"))
    table = seeds.groupBy("learner", "family").agg(F.avg("gain").alias("gain"), F.stddev_samp("gain").alias("gain_sd"), F.count(F.lit(1)).alias("seeds"), F.min("trials").alias("min_trials"))
    table = table.withColumn("enough", F.col("min_trials") >= least_trials)
    return table if novelty is None else table.join(novelty.select("family", F.col("score").alias("novelty")), "family", "left")


def reliability(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, value): spread between families, noise of their means, and the part that is signal."""
    sums = table.groupBy(*keys).agg(F.avg("gain").alias("mean"), F.coalesce(F.var_samp("gain"), F.lit(0.0)).alias("between"), F.coalesce(F.avg(F.col("gain_sd") * F.col("gain_sd") / F.col("seeds")), F.lit(0.0)).alias("noise"))
    signal = F.greatest(F.col("between") - F.col("noise"), F.lit(0.0))
    values = {"gain_mean": F.col("mean"), "gain_sd": F.sqrt("between"), "noise_sd": F.sqrt("noise"), "signal_sd": F.sqrt(signal), "reliability": F.coalesce(F.try_divide(signal, F.col("between")), F.lit(0.0))}
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])).alias("c")
    return sums.select(*keys, cell).select(*keys, "c.*")


def support_levels(cells: DataFrame, keys: list[str], single: float, dominant: float) -> DataFrame:
    """(keys, stratum, cells, gain): cells by how much of the peers' rows the largest peer holds."""
    stratum = F.when(F.col("top_share") >= single, F.lit("single")).when(F.col("top_share") >= dominant, F.lit("dominant")).otherwise(F.lit("spread"))
    return cells.withColumn("stratum", stratum).groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("cells"), F.avg("gain").alias("gain"))


def peer_concentration(exposure: DataFrame, targets: DataFrame) -> DataFrame:
    """(experiment, seed, salt, family, peer_rows, peers, top_share) of clients other than the target."""
    keys = ["experiment", "seed", "salt", "family"]
    peers = exposure.join(targets.select(*keys, F.col("client").alias("target")).distinct(), keys).where("client <> target and dose is null")
    return peers.groupBy(*keys).agg(F.sum("rows").alias("peer_rows"), F.count_if(F.col("rows") > 0).alias("peers"), F.try_divide(F.max("rows"), F.sum("rows")).alias("top_share"))


def score_health(scores: DataFrame, keys: list[str], large: float, extreme: float) -> DataFrame:
    s = F.col("score").cast("double")
    fine = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    return scores.groupBy(*keys).agg(
        F.count(s).alias("scores"), F.count_if(~fine).alias("nonfinite"), F.min(F.when(~F.isnan(s), s)).alias("minimum"), F.max(F.when(~F.isnan(s), s)).alias("maximum"), F.count_if(~F.isnan(s) & (F.abs(s) > large)).alias("above_large"), F.count_if(~F.isnan(s) & (F.abs(s) > extreme)).alias("above_extreme")
    )


def taxonomy(means: DataFrame, margin: float, poor: float, poor_columns: list[str]) -> DataFrame:
    """Adds poor_classes and labels, a text of all rules that hold: low_headroom, exposure_limited, poor_full, pooling_sufficient, negative_transfer."""
    worse = sum((F.coalesce((F.col(c) < poor).cast("int"), F.lit(0)) for c in poor_columns), F.lit(0))
    rules = {
        "low_headroom": F.col("headroom") < margin,
        "exposure_limited": (F.col("headroom") >= margin) & (F.col("full_recall") >= poor) & (F.col("gain") >= margin),
        "poor_full": F.col("full_recall") < poor,
        "pooling_sufficient": (F.col("pooling") >= margin) & (F.abs(F.col("gain")) < margin),
        "negative_transfer": F.col("gain") <= -margin,
    }
    names = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in rules.items()]))
    return means.withColumn("poor_classes", worse).withColumn("labels", F.array_join(names, " "))


def operating_calibration(clients: DataFrame, thresholds: DataFrame, tolerance: float) -> DataFrame:
    """(client, alpha, calibration_benign, benign_test, realised_fpr, deviation, breach)."""
    both = clients.where("population = 'benign'").join(thresholds, ["client", "alpha"])
    out = both.select("client", "alpha", "calibration_benign", F.col("trials").alias("benign_test"), F.try_divide("hits", "trials").alias("realised_fpr"), "operating_status")
    return out.withColumn("deviation", F.col("realised_fpr") - F.col("alpha")).withColumn("breach", F.coalesce(F.abs("deviation") > tolerance, F.lit(False)))


def fpr_summary(calibration: DataFrame) -> DataFrame:
    return calibration.groupBy("client").agg(F.count(F.lit(1)).alias("rows"), F.avg("realised_fpr").alias("realised_fpr"), F.avg("deviation").alias("deviation"), F.max(F.abs("deviation")).alias("max_deviation"), F.count_if("breach").alias("breaches"))


def fidelity(summary: DataFrame) -> DataFrame:
    """(experiment, learner, condition, alpha, mean_fpr, worst_fpr, runs, valid_runs, deviation) of untreated arms."""
    rows = summary.where(F.col("dose").isNull() & F.col("metric").isin("realised-fpr", "worst-client-fpr"))
    mine = F.col("metric") == "realised-fpr"
    out = rows.groupBy("experiment", "learner", "condition", "alpha").agg(
        F.avg(F.when(mine, F.col("value"))).alias("mean_fpr"), F.avg(F.when(~mine, F.col("value"))).alias("worst_fpr"), n_unique(F.col("seed")).alias("runs"), F.count_if(mine & (F.col("operating_status") == "valid")).alias("valid_runs")
    )
    return out.withColumn("deviation", F.col("mean_fpr") - F.col("alpha"))


def convergence(training: DataFrame, auroc: DataFrame, keys: list[str]) -> DataFrame:
    """First and last known loss of each trace, by (round, epoch), finite flags, and its arm's calibration AUROC; null arm keys join themselves."""
    step = F.struct("round", "epoch")
    known = F.when(F.col("loss").isNotNull(), step)
    trace = training.groupBy(*keys, *ARM).agg(
        F.count(F.lit(1)).alias("records"), F.min_by("loss", known).alias("first_loss"), F.max_by("loss", known).alias("final_loss"), safe_sum(F.col("nonfinite_batches")).alias("nonfinite_batches"), all_of(F.col("parameters_finite")).alias("parameters_finite"), any_of(F.col("status") != "completed").alias("flagged")
    )
    return null_safe_join(trace, auroc, ARM, "left")


def masking(summary: DataFrame, aggregate: str, recall: str, material: float) -> DataFrame:
    """(experiment, learner, alpha, seeds, disagree, missed, reassured): what an aggregate metric hides of a recall's change by peers."""
    keys = ["experiment", "seed", "salt", "learner", "alpha"]
    part = lambda metric, condition: F.max(F.when((F.col("metric") == metric) & (F.col("condition") == condition), F.col("value")))
    wide = summary.where("dose is null and parameter is null").groupBy(*keys).agg((part(aggregate, "peer-present") - part(aggregate, "family-absent")).alias("a"), (part(recall, "peer-present") - part(recall, "family-absent")).alias("r")).where("a is not null and r is not null")
    return wide.groupBy("experiment", "learner", "alpha").agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if(F.signum("a") * F.signum("r") < 0).alias("disagree"), F.count_if((F.col("r") >= material) & (F.col("a") <= 0)).alias("missed"), F.count_if((F.col("r") <= -material) & (F.col("a") >= 0)).alias("reassured")
    )


def band_outcome(low: Column, high: Column, band: float) -> Column:
    return F.when(low.isNull() | high.isNull(), F.lit("unresolved")).when((low >= -band) & (high <= band), F.lit("equivalent")).when((low > band) | (high < -band), F.lit("exceeds-band")).otherwise(F.lit("unresolved"))


def campaign_status(runs: DataFrame, planned: DataFrame, states: list[str]) -> DataFrame:
    """(experiment, planned, a column a state): planned runs without a record are missing."""
    both = planned.join(runs, ["experiment", "seed", "salt"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return both.groupBy("experiment").agg(F.count(F.lit(1)).alias("planned"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def contrast_effects(differences: DataFrame, keys: list[str], group: list[str], resamples: int = 9999) -> DataFrame:
    """Paired effects of each key with p values adjusted by Holm inside each group of keys."""
    from sievegrid.operators.statistics import holm_adjusted, paired_effects

    effects = paired_effects(differences, keys, "difference", resamples=resamples)
    return holm_adjusted(effects, group, "p", keys[-1], "holm_p")


def dose_contrasts(recalls: DataFrame, learner: str, levels: list[int]) -> DataFrame:
    """Paired differences with their contrast: each dose and all peers over dose 0, each dose over the one below, dose 0 over none."""
    zero = arm_is("peer-present", 0)
    pairs = {f"onset-{d}": (arm_is("peer-present", d), zero) for d in levels} | {"natural": (arm_is("peer-present"), zero)}
    pairs |= {f"increment-{a}-{b}": (arm_is("peer-present", b), arm_is("peer-present", a)) for a, b in zip(levels, levels[1:], strict=False)}
    pairs["zero-less-absent"] = (zero, arm_is("family-absent"))
    keys = ["scope", "population", "alpha", "seed"]
    value = lambda arm: F.max(F.when(arm, F.col("recall")))
    wide = recalls.where(F.col("learner") == learner).groupBy(*keys).agg(*[(value(a) - value(b)).alias(name) for name, (a, b) in pairs.items()])
    cell = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(n).alias("difference")) for n in pairs])).alias("c")
    return wide.select(*keys, cell).select(*keys, "c.*").where("difference is not null")


def tradeoff(summary: DataFrame, baseline: Column, tolerance: float) -> DataFrame:
    """(metric, alpha, learner, condition, dose, parameter, tuning_value, mean_difference, worst_difference, within): arms less the baseline arm, seed by seed."""
    keys = ["experiment", "seed", "salt", "alpha", "metric"]
    base = F.max(F.when(baseline, F.col("value"))).over(Window.partitionBy(*keys))
    rows = summary.withColumn("difference", F.col("value") - base).where(~baseline & F.col("difference").isNotNull())
    out = rows.groupBy("metric", "alpha", *ARM).agg(F.avg("difference").alias("mean_difference"), F.min("difference").alias("worst_difference"))
    return out.withColumn("within", F.col("mean_difference") >= -tolerance)


def headroom(summary: DataFrame, learner: str, gate: float) -> DataFrame:
    """(metric, alpha, seeds, mean_gap, worst_gap, gated): full exposure less peers present."""
    keys = ["experiment", "seed", "salt", "alpha", "metric"]
    full = F.max(F.when((F.col("condition") == "full-exposure") & F.col("dose").isNull(), F.col("value")))
    peer = F.max(F.when((F.col("learner") == learner) & arm_is("peer-present"), F.col("value")))
    gaps = summary.groupBy(*keys).agg((full - peer).alias("gap")).where("gap is not null")
    return gaps.groupBy("metric", "alpha").agg(F.count(F.lit(1)).alias("seeds"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("worst_gap")).withColumn("gated", F.col("mean_gap") >= gate)


def seed_concordance(gains: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, second, rho): rank correlation of families' gains between every two seeds; seeds are few."""
    from sievegrid.operators.statistics import spearman_table

    a = gains.select(*keys, "family", F.col("seed").alias("first"), F.col("gain").alias("x"))
    b = gains.select(*keys, "family", F.col("seed").alias("second"), F.col("gain").alias("y"))
    both = a.join(b, [*keys, "family"]).where("first < second")
    return spearman_table(both, [*keys, "first", "second"], "x", "y").drop("n")


def influence(means: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(left_out, rho, change): how much each item moves the rank correlation."""
    from sievegrid.operators.statistics import leave_one_out_table, spearman_table

    whole = spearman_table(means, [], a, b).select(F.col("rho").alias("all"))
    return leave_one_out_table(means, item, a, b).crossJoin(F.broadcast(whole)).select("left_out", "rho", (F.col("all") - F.col("rho")).alias("change"))  # one row


def associations(table: DataFrame, keys: list[str], outcome: str, predictors: list[str]) -> DataFrame:
    """(keys, predictor, rho, n): rank correlation of an outcome with each predictor, in one pass over long rows."""
    from sievegrid.operators.statistics import spearman_table

    long = table.select(*keys, outcome, F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors])).alias("c")).select(*keys, outcome, "c.*")
    return spearman_table(long, [*keys, "predictor"], outcome, "x")
