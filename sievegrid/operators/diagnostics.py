"""Diagnostic and synthesis tables: cells of arm contrasts, strata, dose codes, representations, score checks, large families.

Cells are made by conditional aggregation; a vector that goes to a reducer has a value a seed or a family, never a row a sample.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import arm_values, n_unique, safe_sum
from sievegrid.operators import statistics as stat
from sievegrid.operators.evaluation import fpr_crossings

RUN = ["experiment", "seed", "salt"]
CELL = [*RUN, "population", "alpha", "client", "family"]
NATURAL = -1


def usable_recalls(families: DataFrame, own_min: int) -> DataFrame:
    """Rows with enough trials for their population, and their recall."""
    least = F.when(F.col("population") == "own-domain", own_min).otherwise(1)
    return families.where(F.col("trials") >= least).withColumn("recall", F.col("hits") / F.col("trials"))


# Contrasts of arms by cell.


def control_cells(families: DataFrame, arms: dict[str, Column], contrasts: dict[str, tuple[str, str]], own_min: int) -> DataFrame:
    """(CELL, a recall an arm, a difference a contrast): contrasts name two columns, earlier contrasts among them."""
    wide = arm_values(usable_recalls(families, own_min), CELL, "recall", arms)
    for name, (a, b) in contrasts.items():
        wide = wide.withColumn(name, F.col(a) - F.col(b))
    return wide


def with_cell_facts(cells: DataFrame, pairs: DataFrame, peers: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Placebo facts, the peers' concentration and descriptors beside each cell; cells without them stay.

    pairs: (experiment, seed, client, family, need, reallocated, hidden_fit, placebo_fit); descriptors: (client, family, descriptor, value).
    """
    keys = ["experiment", "seed", "client", "family"]
    facts = pairs.withColumns({"reallocated_share": F.try_divide("reallocated", "need"), "is_reallocated": F.col("reallocated") > 0, "fit_ratio": F.try_divide("placebo_fit", "hidden_fit")})
    names = sorted(r[0] for r in descriptors.select("descriptor").distinct().collect())  # a row a descriptor
    wide = descriptors.groupBy("client", "family").pivot("descriptor", names).agg(F.avg("value"))
    return cells.join(facts, keys, "left").join(peers, [*RUN, "family"], "left").join(wide, ["client", "family"], "left")


def seed_means(cells: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, seed, measure, value) of known values."""
    means = cells.groupBy(*keys, "seed").agg(*[F.avg(m).alias(m) for m in measures])
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("c")
    return means.select(*keys, "seed", cell).select(*keys, "seed", "c.*").where("value is not null")


def gate(kind: Column, low: Column, high: Column, margin: float) -> Column:
    """Equivalence: inside the margin; noninferior: not below it; superior: above it. Without an interval: false."""
    inside = (low >= -margin) & (high <= margin)
    passed = F.when(kind == "equivalence", inside).when(kind == "noninferior", low > -margin).otherwise(low > margin)
    return F.coalesce(passed, F.lit(False))


def strata_effects(cells: DataFrame, keys: list[str], kinds: dict[str, str], margin: float, resamples: int = 9999) -> DataFrame:
    """Paired effects over seeds of each contrast in each stratum, and whether its gate holds; kinds: contrast -> gate."""
    effects = stat.paired_effects(seed_means(cells, keys, list(kinds)), [*keys, "measure"], "value", resamples=resamples)
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("measure")]
    return effects.withColumn("gate", gate(kind, F.col("low"), F.col("high"), margin))


def client_effects(cells: DataFrame, keys: list[str], measures: list[str], least_seeds: int, resamples: int = 9999) -> DataFrame:
    """Effects by client, where it has at least so many seeds."""
    effects = stat.paired_effects(seed_means(cells, [*keys, "client"], measures), [*keys, "client", "measure"], "value", resamples=resamples)
    return effects.where(F.col("seeds") >= least_seeds)


def split_effects(cells: DataFrame, keys: list[str], measure: str, stratum: Column, first: str, second: str, margin: float, resamples: int = 9999) -> DataFrame:
    """Effects of a measure in two strata and of their difference seed by seed, with the equivalence flag."""
    marked = cells.withColumn("stratum", stratum).where("stratum is not null")
    means = marked.groupBy(*keys, "stratum", "seed").agg(F.avg(measure).alias("value")).where("value is not null")
    pick = lambda name: F.max(F.when(F.col("stratum") == name, F.col("value")))
    gap = means.groupBy(*keys, "seed").agg((pick(first) - pick(second)).alias("value")).where("value is not null").withColumn("stratum", F.lit("difference"))
    effects = stat.paired_effects(means.unionByName(gap), [*keys, "stratum"], "value", resamples=resamples)
    return effects.withColumn("equivalent", gate(F.lit("equivalence"), F.col("low"), F.col("high"), margin))


def slopes(cells: DataFrame, keys: list[str], x: str, y: str, draws: int = 2000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(keys, n, slope, intercept, low, high): least squares of y on x; the interval draws whole seeds, by their sums."""
    known = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, "seed", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = known.groupBy(*keys, "seed").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(k) for k, c in {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}.items()])
    types = dict(sums.dtypes)

    def line(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, sxy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = n * sxx - sx * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(spread > 1e-12, (n * sxy - sx * sy) / spread, np.nan)
        return slope, (sy - slope * sx) / n

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("seed")[["n", "sx", "sy", "sxx", "sxy"]].to_numpy(float)
        slope, intercept = line(*v.sum(0))
        drawn = np.random.default_rng(seed).integers(0, len(v), (draws, len(v)))
        found = line(*v[drawn].sum(1).T)[0]
        found = found[~np.isnan(found)]
        low, high = np.quantile(found, [(1 - level) / 2, (1 + level) / 2]) if len(found) else (None, None)
        known = not np.isnan(slope)
        row = {k: group[k].iloc[0] for k in keys} | {"n": int(v[:, 0].sum()), "slope": float(slope) if known else None, "intercept": float(intercept) if known else None, "low": low, "high": high}
        return pd.DataFrame([row])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n long, slope double, intercept double, low double, high double"
    return sums.groupBy(*keys).applyInPandas(reduce, schema)


def grouped_means(cells: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(m).alias(m) for m in measures])


def rank_associations(table: DataFrame, keys: list[str], outcome: str, predictors: list[str], least: int, draws: int = 0, seed: int = 1) -> DataFrame:
    """(keys, predictor, rho, n, low, high) of at least ``least`` known pairs; the interval resamples items, of which there are few."""
    cell = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("x")) for p in predictors])).alias("c")
    long = table.select(*keys, F.col(outcome).cast("double").alias("y"), cell).select(*keys, "y", "c.*").where("x is not null and y is not null")
    types = dict(long.dtypes)

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["x", "y"])
        a, b = g["x"].to_numpy(float), g["y"].to_numpy(float)
        rho = stat.spearman(a, b)
        low, high = (stat.bootstrap_rho(a, b, draws, seed) or (None, None)) if draws else (None, None)
        row = {k: group[k].iloc[0] for k in [*keys, "predictor"]} | {"rho": None if math.isnan(rho) else rho, "n": len(g), "low": low, "high": high}
        return pd.DataFrame([row])

    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "predictor"]) + ", rho double, n long, low double, high double"
    return long.groupBy(*keys, "predictor").applyInPandas(reduce, schema).where(F.col("n") >= least)


# Doses.


def pair_gains(families: DataFrame, own_min: int) -> DataFrame:
    """Gain over dose 0 of the same cell; dose_code is the dose, or NATURAL where all that is available counts."""
    rows = usable_recalls(families, own_min).where("condition = 'peer-present' and parameter is null")
    own = Window.partitionBy(*CELL, "learner")
    base = F.max(F.when(F.col("dose") == 0, F.col("recall"))).over(own)
    return rows.select(*CELL, "learner", F.coalesce("dose", F.lit(NATURAL)).alias("dose_code"), (F.col("recall") - base).alias("gain")).where("gain is not null")


def level_means(gains: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed, dose_code, gain): a value a seed."""
    return gains.groupBy(*keys, "seed", "dose_code").agg(F.avg("gain").alias("gain"))


def wide_by_dose(levels: DataFrame, keys: list[str], doses: list[int]) -> DataFrame:
    """(keys, seed, a column a dose); the doses are given, so no pass looks for them."""
    names = {d: "natural" if d == NATURAL else f"dose_{d}" for d in doses}
    return levels.groupBy(*keys, "seed").agg(*[F.max(F.when(F.col("dose_code") == d, F.col("gain"))).alias(n) for d, n in names.items()])


def dose_effects(levels: DataFrame, keys: list[str], resamples: int = 9999, least_seeds: int = 1) -> DataFrame:
    """Mean gain of each dose over seeds, with its interval: of all, of families or of clients, as the keys say."""
    effects = stat.paired_effects(levels, [*keys, "dose_code"], "gain", resamples=resamples)
    return effects.where(F.col("seeds") >= least_seeds)


def dose_onsets(curves: DataFrame, keys: list[str], onset: float, early: int) -> DataFrame:
    """(keys, top_gain, top_low, natural_gain, onset_mean, onset_interval, response) of dose_effects' rows.

    Responsive: the highest dose's mean reaches the onset and its interval is above 0.
    """
    dose = F.when(F.col("dose_code") > 0, F.col("dose_code"))
    known = F.when(F.col("dose_code") >= 0, F.col("dose_code"))
    out = curves.groupBy(*keys).agg(
        F.max_by("mean", known).alias("top_gain"), F.max_by("low", known).alias("top_low"), F.max(F.when(F.col("dose_code") == NATURAL, F.col("mean"))).alias("natural_gain"),
        F.min(F.when(F.col("mean") >= onset, dose)).alias("onset_mean"), F.min(F.when(F.col("low") > 0, dose)).alias("onset_interval"),
    )
    responsive = F.coalesce((F.col("top_gain") >= onset) & (F.col("top_low") > 0), F.lit(False))
    response = F.when(~responsive, F.lit("nonresponsive")).when(F.col("onset_mean") <= early, F.lit("early")).otherwise(F.lit("late"))
    return out.withColumn("response", response)


def with_family_context(summary: DataFrame, effects: DataFrame, novelty: DataFrame) -> DataFrame:
    """A family's recalls and gain of the main study and its mean novelty beside its dose summary."""
    main = effects.select("family", "local_recall", "full_recall", F.col("knowledge_gain").alias("main_gain"))
    score = novelty.groupBy("family").agg(F.avg("value").alias("novelty"))
    return summary.join(main, "family", "left").join(score, "family", "left")


def heterogeneity(gains: DataFrame, keys: list[str], draws: int = 999, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(keys, families, units, between, within, icc, low, high, eta, p): one-way components of families' seed values.

    Families come as their counts, means and inner squares; the interval draws families.
    """
    mean = F.avg("gain").over(Window.partitionBy(*keys, "family"))
    cells = gains.withColumn("_m", mean)
    per = cells.groupBy(*keys, "family").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("gain").alias("mean"), F.sum(F.pow(F.col("gain") - F.col("_m"), 2)).alias("inner"))
    types = dict(per.dtypes)

    def parts(v: np.ndarray) -> tuple[float, float, float, float, float]:
        n, m, inner = v.T
        total, k = n.sum(), len(n)
        between = (n * (m - (n * m).sum() / total) ** 2).sum()
        size = (total - (n * n).sum() / total) / (k - 1)
        return between, inner.sum(), between / (k - 1), inner.sum() / (total - k), size

    def icc(v: np.ndarray) -> float:
        _, _, between, within, size = parts(v)
        part = max((between - within) / size, 0.0)
        return part / (part + within) if part + within > 0 else math.nan

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("family")[["n", "mean", "inner"]].to_numpy(float)
        k, total = len(v), v[:, 0].sum()
        row = {x: group[x].iloc[0] for x in keys} | {"families": k, "units": int(total)} | dict.fromkeys(("between", "within", "icc", "low", "high", "eta", "p"))
        if k > 1 and total > k:
            outer, inner, between, within, size = parts(v)
            found = np.array([icc(v[d]) for d in np.random.default_rng(seed).integers(0, k, (draws, k))])
            found = found[~np.isnan(found)]
            low, high = np.quantile(found, [(1 - level) / 2, (1 + level) / 2]) if len(found) else (None, None)
            own = icc(v)
            row |= {"between": max((between - within) / size, 0.0), "within": within, "icc": None if math.isnan(own) else own, "low": low, "high": high, "eta": outer / (outer + inner) if outer + inner > 0 else None, "p": stat.f_tail(between / within, k - 1, int(total) - k) if within > 0 else None}
        return pd.DataFrame([row])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", families long, units long, between double, within double, icc double, low double, high double, eta double, p double"
    return per.groupBy(*keys).applyInPandas(reduce, schema)


# Representations and readings of the operating point.


def paired_to_reference(values: DataFrame, keys: list[str], name: str, reference: str) -> DataFrame:
    """(name, keys, value, baseline, difference) of all but the reference, where the reference has the same keys."""
    base = F.max(F.when(F.col(name) == reference, F.col("value"))).over(Window.partitionBy(*keys))
    rows = values.withColumn("baseline", base).where((F.col(name) != reference) & F.col("baseline").isNotNull())
    return rows.select(name, *keys, "value", "baseline", (F.col("value") - F.col("baseline")).alias("difference"))


def with_macro_groups(values: DataFrame, keys: list[str], macros: dict[str, list[str]], singles: list[str], columns: list[str]) -> DataFrame:
    """(keys, group, columns): each listed family by itself, and the mean of the families of each macro group."""
    named = [F.when(F.col("family").isin(singles), F.col("family"))] + [F.when(F.col("family").isin(members), F.lit(g)) for g, members in macros.items()]
    return values.withColumn("group", F.explode(F.array_compact(F.array(*named)))).groupBy(*keys, "group").agg(*[F.avg(c).alias(c) for c in columns])


def scored_targets(rows: DataFrame, targets: DataFrame, thresholds: DataFrame, stored: DataFrame, alpha: float) -> DataFrame:
    """A row a target: recall and false positives at its client's threshold, recall at equal test FPR, and the stored recall.

    Negatives are the client's benign test rows, positives the family's test rows anywhere. stored: (client, family, hits, trials).
    Negatives are counted once a client, not once a target: where their rate passes ``alpha`` does not depend on the positives.
    Without positives recalls are null, without negatives rates and equal_fpr_recall; a target without either is left out.
    """
    test, pairs = rows.where("role = 'test'"), targets.select("client", "family").distinct()
    at = thresholds.where(F.col("alpha") == alpha).select("client", "threshold")
    above, n = F.col("score") > F.col("threshold"), F.count(F.lit(1))
    benign = test.where("label = 0").select("client", "score")
    rates = benign.join(at, "client").groupBy("client").agg(n.alias("benign_test"), F.count_if(above).alias("false_positives"))
    facts = at.join(rates, "client", "left").join(fpr_crossings(benign, ["client"], alpha), "client", "left")  # a row a client
    wanted = pairs.join(facts, "client")
    seen = test.where("label = 1").select("family", "score").join(wanted.select("client", "family", "threshold", "crossing"), "family")
    counts = seen.groupBy("client", "family").agg(
        n.alias("positives"), F.count("score").alias("scored"), F.count_if(above).alias("hits"), F.count_if(F.col("score") > F.col("crossing")).alias("over"), F.count_if(F.col("score") >= F.col("crossing")).alias("with")
    )
    slope = (F.lit(alpha) - F.col("crossing_below")) / (F.col("crossing_at") - F.col("crossing_below"))
    equal = F.when(F.col("crossing").isNotNull(), F.try_divide(F.col("over") + (F.col("with") - F.col("over")) * slope, F.col("scored").cast("double")))
    known = stored.select("client", "family", F.try_divide("hits", "trials").alias("stored_recall"), F.col("trials").alias("stored_trials"))
    told = wanted.join(counts, ["client", "family"], "left").na.fill(0, ["benign_test", "positives"]).where("benign_test + positives > 0")
    told = told.select(
        "client", "family", "threshold", "benign_test", F.col("positives").alias("positive_test"), F.try_divide("hits", "positives").alias("calibrated_recall"), F.try_divide("false_positives", "benign_test").alias("calibrated_fpr"), equal.alias("equal_fpr_recall")
    )
    return told.join(known, ["client", "family"], "left")


def sensitivity_scenarios(paired: DataFrame, keys: list[str], value: str, valid: Column, resamples: int = 9999) -> DataFrame:
    """Effects over all seeds, valid ones, and without each seed in turn; a group has few seeds, so a row meets few scenarios."""
    own = Window.partitionBy(*keys)
    rows = paired.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumns({"_all": F.collect_set("seed").over(own), "_valid": F.collect_set(F.when(F.col("_ok"), F.col("seed"))).over(own)})
    none = F.lit(None).cast("long")
    case = lambda name, omitted: F.struct(F.lit(name).alias("scenario"), omitted.cast("long").alias("omitted"))
    others = lambda seeds, name: F.transform(F.filter(seeds, lambda s: s != F.col("seed")), lambda s: case(name, s))
    always = F.concat(F.array(case("all-seeds", none)), others(F.col("_all"), "leave-one-out"))
    only_valid = F.concat(F.array(case("valid-only", none)), others(F.col("_valid"), "valid-leave-one-out"))
    cases = F.explode(F.when(F.col("_ok"), F.concat(always, only_valid)).otherwise(always)).alias("c")
    long = rows.select(*keys, "seed", F.col(value).alias("value"), cases).select(*keys, "seed", "value", "c.*")
    return stat.paired_effects(long, [*keys, "scenario", "omitted"], "value", resamples=resamples)


def fpr_exceptions(failed: DataFrame, summary: DataFrame, clients: DataFrame, alpha: float) -> DataFrame:
    """For runs that failed their operating-point check: the arm farthest from alpha, and each client's arm of most false positives."""
    arms = summary.where((F.col("metric") == "realised-fpr") & (F.col("alpha") == alpha) & (F.col("operating_status") == "valid")).join(failed, RUN)
    arms = arms.withColumn("macro_deviation", F.abs(F.col("value") - alpha))
    far = Window.partitionBy(*RUN).orderBy(F.desc("macro_deviation"), "learner", "condition")
    macro = arms.withColumn("_r", F.row_number().over(far)).where("_r = 1").select(*RUN, F.col("learner").alias("max_learner"), F.col("condition").alias("max_condition"), F.col("value").alias("macro_fpr"), "macro_deviation")
    own = clients.where((F.col("population") == "benign") & (F.col("alpha") == alpha) & (F.col("trials") > 0)).withColumn("client_fpr", F.col("hits") / F.col("trials"))
    worst = Window.partitionBy(*RUN, "client").orderBy(F.desc("client_fpr"), "learner", "condition")
    top = own.withColumn("_r", F.row_number().over(worst)).where("_r = 1").select(*RUN, "client", F.col("learner").alias("client_learner"), F.col("condition").alias("client_condition"), "client_fpr", "hits", "trials")
    return macro.join(top, RUN)


# Confirmatory tables by client and family.


def client_recalls(clients: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, client, learner, local, peer, absent, full): a learner's arms beside the local baseline, by client."""
    rows = clients.where("trials > 0 and dose is null and parameter is null").withColumn("recall", F.col("hits") / F.col("trials"))
    every = [*keys, "client"]
    local = F.max(F.when((F.col("learner") == "local") & (F.col("condition") == "peer-present"), F.col("recall"))).over(Window.partitionBy(*every))
    part = lambda c: F.max(F.when(F.col("condition") == c, F.col("recall")))
    wide = rows.withColumn("local", local).where("learner <> 'local'").groupBy(*every, "learner", "local").agg(part("peer-present").alias("peer"), part("family-absent").alias("absent"), part("full-exposure").alias("full"))
    return wide.where("local is not null and peer is not null and absent is not null")


def anchored_worst(clients: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, client, learner, estimand, difference): each run's client of least local recall, followed through the arms."""
    least = F.min(F.struct("local", "client")).over(Window.partitionBy(*keys))
    worst = client_recalls(clients, keys).withColumn("_w", least).where(F.col("_w.client") == F.col("client"))
    cells = {"total_gain": F.col("peer") - F.col("local"), "pooling_gain": F.col("absent") - F.col("local"), "knowledge_gain": F.col("peer") - F.col("absent"), "local_deficit": F.when(F.col("learner") == "central", F.col("full") - F.col("local"))}
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("estimand"), v.alias("difference")) for k, v in cells.items()])).alias("c")
    return worst.select(*keys, "client", "learner", cell).select(*keys, "client", "learner", "c.*").where("difference is not null")


def client_gains(clients: DataFrame, keys: list[str]) -> DataFrame:
    """(keys without seed, client, learner, recalls, gains, seeds, positive): means over seeds."""
    wide = client_recalls(clients, keys).withColumn("gain", F.col("peer") - F.col("absent"))
    names = {"local_recall": "local", "absent_recall": "absent", "peer_recall": "peer", "full_recall": "full"}
    return wide.groupBy(*[k for k in keys if k != "seed"], "client", "learner").agg(*[F.avg(c).alias(n) for n, c in names.items()], (F.avg("peer") - F.avg("local")).alias("total_gain"), (F.avg("absent") - F.avg("local")).alias("pooling_gain"), F.avg("gain").alias("knowledge_gain"), F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("gain") > 0).alias("positive"))


def mechanism_patterns(effects: DataFrame, learner: str, others: list[str]) -> DataFrame:
    """A learner's family recalls and gains beside the full-exposure recall that each other learner reaches."""
    ceiling = [F.max(F.when(F.col("learner") == o, F.col("full_recall"))).over(Window.partitionBy("experiment", "family")).alias(f"{o}_full_recall") for o in others]
    rows = effects.select("*", *ceiling).where(F.col("learner") == learner)
    return rows.select("experiment", "family", "trials", "seeds", "local_recall", "absent_recall", "peer_recall", "knowledge_gain", (F.col("absent_recall") - F.col("local_recall")).alias("pooling_gain"), (F.col("peer_recall") - F.col("local_recall")).alias("total_gain"), *[f"{o}_full_recall" for o in others])


def coverage(effects: DataFrame, seed_effects: DataFrame) -> DataFrame:
    """Effects with the numbers of families and clients that their experiment covers."""
    counts = seed_effects.groupBy("experiment").agg(n_unique(F.col("family")).alias("families"), n_unique(F.col("client")).alias("clients"))
    return effects.join(counts, "experiment", "left")


def frozen_drift(selection: DataFrame, configured: DataFrame) -> DataFrame:
    """Parameters whose selected value is not the configured one; both: (parameter, tuning_value)."""
    both = selection.select("parameter", F.col("tuning_value").alias("found")).join(configured.select("parameter", F.col("tuning_value").alias("frozen")), "parameter")
    return both.where(~F.col("found").eqNullSafe(F.col("frozen")))


def family_client_gains(cells: DataFrame) -> DataFrame:
    """(client, family, recalls, trials, gain, seeds, positive) of own-domain hidden cells."""
    own = cells.where("population = 'own-domain'")
    means = {"local_recall": "local_recall", "absent_recall": "absent_recall", "peer_recall": "peer_recall", "hidden_trials": "trials", "gain": "knowledge_gain"}
    return own.groupBy("client", "family").agg(*[F.avg(c).alias(n) for n, c in means.items()], F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("knowledge_gain") > 0).alias("positive"))


def evidence_synthesis(effects: DataFrame, micro: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Paired and micro-pooled evidence as one table, labelled by scope; a variant without a scope stays out."""
    scope = F.create_map(*[F.lit(x) for pair in scopes.items() for x in pair])
    columns = ["source", "scope", "mean", "low", "high", "positive", "seeds"]
    paired = effects.withColumn("source", F.lit("paired")).withColumn("scope", scope[F.col("metric")])
    pooled = micro.withColumn("source", F.lit("micro-pooled")).withColumn("scope", scope[F.col("variant")])
    return paired.select(*columns).unionByName(pooled.select(*columns)).where("scope is not null")


# Large families and synthesis.


def eligibility_grid(seeds: DataFrame, members: DataFrame, planned: DataFrame) -> DataFrame:
    """(seed, family, eligible, client): every seed and member, with the client planned for it."""
    chosen = planned.select("seed", "family", "client").distinct()
    return seeds.crossJoin(F.broadcast(members)).join(chosen, ["seed", "family"], "left").withColumn("eligible", F.col("client").isNotNull())  # a row a member


def stability_table(grid: DataFrame, measured: DataFrame) -> DataFrame:
    """(family, seed_count, eligible seeds, their share, pairs and rows, stable, measured_seeds)."""
    seen = measured.groupBy("family").agg(F.count_distinct("seed").alias("measured_seeds"))
    pairs, rows = F.col("eligible_pairs"), F.col("eligible_test_rows")
    out = grid.groupBy("family").agg(F.count_distinct("seed").alias("seed_count"), F.count_if("eligible").alias("eligible_seeds"), F.min(pairs).alias("min_pairs"), F.avg(pairs).alias("mean_pairs"), F.max(pairs).alias("max_pairs"), F.min(rows).alias("min_rows"), F.avg(rows).alias("mean_rows"))
    out = out.withColumns({"eligible_share": F.col("eligible_seeds") / F.col("seed_count"), "stable": F.col("eligible_seeds") == F.col("seed_count")})
    return out.join(seen, "family", "left").na.fill(0, ["measured_seeds"])


def long_measures(table: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(keys, measure, value): aggregates as rows."""
    names = list(measures)
    sums = table.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in measures.items()])
    cell = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])).alias("c")
    return sums.select(*keys, cell).select(*keys, "c.*").where("value is not null")


def large_summary(table: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, support and spread of large families."""
    gain = F.col("gain")
    return long_measures(table, keys, {"families": F.count(F.lit(1)), "families_enough": F.count_if("enough"), "min_support": F.min("min_trials"), "mean_support": F.avg("min_trials"), "gain_mean": F.avg(gain), "gain_median": F.median(gain), "gain_min": F.min(gain), "gain_max": F.max(gain), "gain_positive": F.count_if(gain > 0)})


def seed_rho_summary(seed_gains: DataFrame, keys: list[str], score: str, least: int) -> DataFrame:
    """Least, median and greatest rank correlation by seed, of seeds with more than ``least`` families."""
    rho = stat.spearman_table(seed_gains, [*keys, "seed"], "gain", score).where(F.col("n") > least)
    return long_measures(rho, keys, {"seeds_with_rho": F.count("rho"), "rho_min": F.min("rho"), "rho_median": F.median("rho"), "rho_max": F.max("rho"), "rho_positive": F.count_if(F.col("rho") > 0)})


def stability_summary(stability: DataFrame, keys: list[str]) -> DataFrame:
    share = F.col("eligible_share")
    return long_measures(stability, keys, {"families": F.count(F.lit(1)), "seeds": F.max("seed_count"), "stable_families": F.count_if("stable"), "mean_share": F.avg(share), "min_share": F.min(share)})


def synthesis_cells(families: DataFrame, learners: list[str], alpha: float) -> DataFrame:
    """(RUN, population, client, family, learner, recalls, gain, pooling, total, headroom, residual): one pass for all learners."""
    keys = [*RUN, "population", "client", "family"]
    rows = families.where((F.col("alpha") == alpha) & F.col("dose").isNull() & F.col("parameter").isNull() & (F.col("trials") > 0)).withColumn("recall", F.col("hits") / F.col("trials"))
    arm = lambda x, c: (F.col("learner") == x) & (F.col("condition") == c)
    names = {"peer": "peer-present", "absent": "family-absent", "full": "full-exposure"}
    wide = arm_values(rows, keys, "recall", {"local_recall": arm("local", "peer-present")} | {f"{x}_{n}": arm(x, c) for x in learners for n, c in names.items()})
    support = arm_values(rows, keys, "trials", {"trials": F.col("learner") == "local"})
    cell = F.explode(F.array(*[F.struct(F.lit(x).alias("learner"), *[F.col(f"{x}_{n}").alias(f"{n}_recall") for n in names]) for x in learners])).alias("c")
    out = wide.join(support, keys).select(*keys, "trials", "local_recall", cell).select(*keys, "trials", "local_recall", "c.*").where("peer_recall is not null")
    peer, absent, local, full = (F.col(f"{n}_recall") for n in ("peer", "absent", "local", "full"))
    return out.withColumns({"gain": peer - absent, "pooling": absent - local, "total": peer - local, "headroom": full - local, "residual": full - peer})


def support_facts(exposure: DataFrame, targets: DataFrame) -> DataFrame:
    """(RUN, family, client, peer_support, target_support): rows at the target's peers and at the target."""
    hidden = targets.select(*RUN, "family", F.col("client").alias("target")).distinct()
    rows = exposure.where("dose is null").join(hidden, [*RUN, "family"])
    peer = F.col("client") != F.col("target")
    return rows.groupBy(*RUN, "family", F.col("target").alias("client")).agg(safe_sum(F.when(peer, F.col("rows"))).alias("peer_support"), safe_sum(F.when(~peer, F.col("rows"))).alias("target_support"))


def large_facts(seed_effects: DataFrame, selection: DataFrame) -> DataFrame:
    """Family means with headroom, pooling and the log of the family's rows; selection: (family, rows)."""
    names = ["local_recall", "full_recall", "absent_recall", "peer_recall", "trials"]
    means = seed_effects.groupBy("family").agg(F.avg("knowledge_gain").alias("gain"), *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("cells"), F.count_distinct("seed").alias("seeds"))
    both = means.join(selection, "family", "left")
    return both.withColumns({"headroom": F.col("full_recall") - F.col("local_recall"), "pooling": F.col("absent_recall") - F.col("local_recall"), "log_rows": F.log(F.col("rows").cast("double"))})


def large_taxonomy(table: DataFrame, margin: float, poor: float) -> DataFrame:
    """Adds label_count and labels: all the rules that hold, in a fixed order."""
    gain, pooling, headroom, full = (F.col(c) for c in ("gain", "pooling", "headroom", "full_recall"))
    rules = {
        "exposure_limited": (headroom >= margin) & (full >= poor) & (gain >= margin),
        "poor_full": full < poor,
        "low_headroom": headroom < margin,
        "pooling_responsive": pooling >= margin,
        "negative_transfer": (pooling <= -margin) & (gain >= margin),
    }
    held = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in rules.items()]))
    return table.withColumn("label_count", F.size(held)).withColumn("labels", F.array_join(held, " "))


def rank_concordance(cells: DataFrame, large: DataFrame, keys: list[str], draws: int, seed: int = 1) -> DataFrame:
    """(keys, rho, n, low, high): do two studies rank the families' gains alike?"""
    means = cells.groupBy(*keys, "family").agg(F.avg("gain").alias("gain"))
    both = means.join(large.select("family", F.col("gain").alias("other")), "family")
    return rank_associations(both, keys, "gain", ["other"], 2, draws, seed).drop("predictor")


# Reports.


def client_audit(support: DataFrame, families: DataFrame) -> DataFrame:
    """Support of each client and its number of distinct families."""
    return support.join(families.groupBy("client").agg(n_unique(F.col("family")).alias("families")), "client", "left")


def ordered_selection(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows whose value is listed, with its place in the list."""
    place = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    return table.withColumn("place", place[F.col(column)]).where("place is not null")


def promotion_blocks(runs: DataFrame, planned: DataFrame, revision: str) -> DataFrame:
    """(experiment, seed, salt, block): what keeps results from being published: runs that are missing, not completed or of another revision."""
    both = planned.select(*RUN).join(runs, RUN, "left")
    missing, wrong, stale = F.col("status").isNull(), F.col("status") != "completed", F.col("revision") != revision
    block = F.when(missing, F.lit("missing")).when(wrong, F.col("status")).when(stale, F.lit("stale"))
    return both.withColumn("block", block).where("block is not null").select(*RUN, "block")


def manifest_check(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): files that are missing, changed or stray against a manifest; both: (path, digest)."""
    both = manifest.select("path", F.col("digest").alias("want")).join(found.select("path", F.col("digest").alias("got")), "path", "full")
    state = F.when(F.col("got").isNull(), F.lit("missing")).when(F.col("want").isNull(), F.lit("stray")).when(F.col("want") != F.col("got"), F.lit("changed"))
    return both.withColumn("state", state).where("state is not null").select("path", "state")
