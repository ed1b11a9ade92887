"""Validations of a design and of its evaluation: tables (name, passed, ...) from one pass of aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.primitives import all_of, any_of, n_unique

#: (learner, condition, dose, parameter, tuning_value): keys of an arm, all but the first two nullable.
ARM_TYPES = {"learner": "string", "condition": "string", "dose": "long", "parameter": "string", "tuning_value": "double"}


def _named(df: DataFrame, checks: dict[str, Column], *more: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return df.select(F.explode(cells).alias("c"), *more).select("c.name", "c.passed", *more)


def normalise_arms(df: DataFrame) -> DataFrame:
    """Arm columns that are missing come as typed nulls; others are cast."""
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in ARM_TYPES.items()})


def same_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(name, passed): two namespaces have as many rows, unique keys, and the same ones."""
    side = lambda df, n: df.select(F.col(key).alias("_k"), F.lit(n).alias("_side"))
    by = side(left, 0).unionByName(side(right, 1)).groupBy("_k").agg(F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"))
    whole = by.agg((F.sum("a") == F.sum("b")).alias("rows"), all_of((F.col("a") <= 1) & (F.col("b") <= 1)).alias("unique"), all_of((F.col("a") > 0) == (F.col("b") > 0)).alias("keys"))
    return _named(whole, {"row_counts": F.col("rows"), "unique_keys": F.col("unique"), "same_keys": F.col("keys")})


def exposure_spec(arms: DataFrame, targets: DataFrame) -> DataFrame:
    """(arm columns, client, family, cap): rows of the family that the client may train on under the arm; null is no limit.

    ``family-absent`` allows none anywhere, ``peer-present`` none at the target; a dose caps the peers'.
    """
    hidden = targets.select("family", F.col("client").alias("target")).distinct()
    clients = targets.select("client").distinct()
    grid = arms.crossJoin(hidden).crossJoin(F.broadcast(clients))  # arms are a literal table, clients the holders
    none = (F.col("condition") == "family-absent") | ((F.col("condition") == "peer-present") & (F.col("client") == F.col("target")))
    cap = F.when(none, F.lit(0).cast("long")).when(F.col("condition") == "peer-present", F.col("dose"))
    return grid.select(*[c for c in ARM_TYPES if c in arms.columns], "client", "family", cap.alias("cap"))


def exposure_checks(training: DataFrame, targets: DataFrame, peer_min: int) -> DataFrame:
    """(name, passed) over training rows (condition, client, family, label, role) of all conditions.

    Hidden families are absent at their target where peers have them and everywhere in ``family-absent``; peers have at least
    ``peer_min`` rows of each; clients have as many rows in every condition; only fit rows are used.
    """
    hidden = targets.select("family", F.col("client").alias("target")).distinct()
    marked = training.join(hidden, "family", "left")
    bad = F.col("target").isNotNull() & (F.col("label") == 1)
    at = bad & (F.col("client") == F.col("target"))
    flags = marked.agg(
        (~any_of(at & (F.col("condition") == "peer-present"))).alias("target"),
        (~any_of(bad & (F.col("condition") == "family-absent"))).alias("absent"),
        all_of(F.col("role") == "fit").alias("fit"),
    )
    peers = hidden.join(marked.where(bad & ~at & (F.col("condition") == "peer-present")).groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family", "left")
    enough = peers.agg(all_of(F.coalesce("n", F.lit(0)) >= peer_min).alias("peers"))
    sizes = training.groupBy("client", "condition").agg(F.count(F.lit(1)).alias("n")).groupBy("client").agg((F.min("n") == F.max("n")).alias("same"))
    one = flags.crossJoin(F.broadcast(enough)).crossJoin(F.broadcast(sizes.agg(all_of(F.col("same")).alias("sizes"))))  # a row each
    return _named(one, {"hidden_at_target": F.col("target"), "absent_everywhere": F.col("absent"), "peers_present": F.col("peers"), "equal_sizes": F.col("sizes"), "fit_rows_only": F.col("fit")})


def dose_checks(levels: DataFrame, targets: DataFrame, row: str) -> DataFrame:
    """(dose, passed, rows) over training rows (dose, client, row, family, label): no family has more than its dose, none at its target."""
    hidden = targets.select("family", F.col("client").alias("target")).distinct()
    of = levels.where("label = 1").join(hidden, "family").groupBy("dose", "family").agg(F.count_if(F.col("client") == F.col("target")).alias("own"), F.count(F.lit(1)).alias("n"))
    fine = all_of((F.col("own") == 0) & (F.col("n") <= F.col("dose")))
    found = of.groupBy("dose").agg(fine.alias("passed"), F.sum("n").alias("rows"))
    every = levels.groupBy("dose").agg(n_unique(F.col(row)).alias("distinct_rows"), F.count(F.lit(1)).alias("all_rows"))
    joined = every.join(found, "dose", "left")
    return joined.select("dose", (F.coalesce("passed", F.lit(True)) & (F.col("distinct_rows") == F.col("all_rows"))).alias("passed"), F.coalesce("rows", F.lit(0)).alias("rows"))


def placebo_checks(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """(name, passed): choices (client, family, placebo, need) are met by rows (client, family), unique, and not hidden themselves."""
    drawn = rows.groupBy(F.col("family").alias("placebo")).agg(F.count(F.lit(1)).alias("n"))
    met = choices.join(drawn, "placebo", "left").agg(all_of(F.coalesce("n", F.lit(0)) == F.col("need")).alias("met"), (F.count_distinct("placebo") == F.count(F.lit(1))).alias("unique"))
    clash = choices.select("placebo").join(choices.select(F.col("family").alias("placebo")), "placebo").agg((F.count(F.lit(1)) == 0).alias("free"))
    return _named(met.crossJoin(F.broadcast(clash)), {"counts_matched": F.col("met"), "placebos_unique": F.col("unique"), "placebos_unhidden": F.col("free")})


def operating_check(summary: DataFrame, tolerance: float) -> DataFrame:
    """(name, passed, gap): the greatest distance of a valid realised false-positive rate from its alpha."""
    valid = summary.where("metric = 'realised-fpr' and operating_status = 'valid'")
    gap = valid.agg(F.coalesce(F.max(F.abs(F.col("value") - F.col("alpha"))), F.lit(0.0)).alias("gap"))
    return _named(gap, {"operating_points": F.col("gap") <= tolerance}, "gap")


def pool_checks(pool: DataFrame) -> DataFrame:
    """(name, passed): calibration rows are a client's own, and rows away are test rows of hidden families."""
    calibration, away = F.col("role") == "calibration", ~F.col("own")
    whole = pool.agg(all_of(~calibration | (F.col("own") & (F.col("client") == F.col("pool")))).alias("own"), all_of(~away | ((F.col("role") == "test") & F.col("unseen") & (F.col("label") == 1))).alias("test"))
    return _named(whole, {"calibration_own_only": F.col("own"), "hidden_test_only": F.col("test")})


def sampling_noise(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, noise): mean binomial variance of a cell's difference of two rates over the same trials."""
    spread = lambda p: F.col(p) * (1 - F.col(p))
    return cells.where("trials > 0").groupBy(*groups).agg(F.avg((spread("peer") + spread("absent")) / F.col("trials")).alias("noise"))


def intraclass(rows: DataFrame, scopes: list[str], group: str, value: str) -> DataFrame:
    """(scopes, icc): the share of variance between groups, by variance components, at least 0; null for fewer than two groups."""
    by = rows.groupBy(*scopes, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value) * F.count(F.lit(1)), F.lit(0.0)).alias("ss"))
    all_ = by.groupBy(*scopes).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("ss").alias("inside"), F.sum(F.col("n") * F.col("mean")).alias("s1"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("s2"))
    between = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")) / (F.col("k") - 1)
    within = F.col("inside") / (F.col("total") - F.col("k"))
    size = (F.col("total") - F.col("n2") / F.col("total")) / (F.col("k") - 1)
    tau = F.greatest((between - within) / size, F.lit(0.0))
    return all_.select(*scopes, F.when((F.col("k") > 1) & (F.col("total") > F.col("k")), F.try_divide(tau, tau + within)).alias("icc"))


def seed_correlation(rows: DataFrame, groups: list[str], left: str, right: str, least: int = 3) -> DataFrame:
    """(groups, r): Pearson's correlation across seeds; null for fewer than ``least`` of them or without spread."""
    fine = (F.count(F.lit(1)) >= least) & (F.stddev_pop(left) > 1e-12) & (F.stddev_pop(right) > 1e-12)
    return rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*groups).agg(F.when(fine, F.corr(left, right)).alias("r"))


def contrast_label(alpha: Column, metric: Column, estimand: Column, primary_alpha: float) -> Column:
    """The primary contrast, those at other alphas or metrics of the same estimand, and the rest."""
    main = estimand == "knowledge_gain"
    return F.when(main & (alpha == primary_alpha) & (metric == "federation-wide-recall"), F.lit("primary")).when(main, F.lit("reference")).otherwise(F.lit("exploratory"))


def band_outcome(low: Column, high: Column, band: float) -> Column:
    """Where an interval lies about a band around 0."""
    return (
        F.when(low.isNull() | high.isNull(), F.lit("not-estimable"))
        .when((low >= -band) & (high <= band), F.lit("within-band"))
        .when((low > band) | (high < -band), F.lit("outside-band"))
        .otherwise(F.lit("inconclusive"))
    )


def arm_label(learner: Column, condition: Column, dose: Column) -> Column:
    return (
        F.when(learner == "local", F.lit("local"))
        .when(condition == "full-exposure", F.lit("full exposure"))
        .when(condition == "family-absent", F.concat(learner, F.lit(" without the family")))
        .when(dose.isNotNull(), F.concat(learner, F.lit(" at "), dose.cast("string"), F.lit(" rows")))
        .otherwise(F.concat(learner, F.lit(" with peers")))
    )
