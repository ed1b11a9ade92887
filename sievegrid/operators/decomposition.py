"""Arm differences: pooling, complementary knowledge, dose curves and hidden cells. An arm is picked by conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import arm_values, longer, null_safe_join, safe_sum

LEARNERS = ["central", "fedavg", "fedprox"]
KEYS = ["experiment", "seed", "salt", "alpha", "metric"]


def _is(learner: str, condition: str) -> Column:
    return (F.col("learner") == learner) & (F.col("condition") == condition) & F.col("dose").isNull()


def _arms(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, learner, local, full, peer, absent): the baseline arms beside each learner's own."""
    arms = {"local": _is("local", "peer-present"), "central_full": _is("central", "full-exposure")}
    for x in LEARNERS:
        arms |= {f"{x}_peer": _is(x, "peer-present"), f"{x}_absent": _is(x, "family-absent"), f"{x}_own_full": _is(x, "full-exposure")}
    wide = arm_values(rows, keys, value, arms)
    cells = F.array(*[F.struct(F.lit(x).alias("learner"), F.col(f"{x}_peer").alias("peer"), F.col(f"{x}_absent").alias("absent"), F.col(f"{x}_own_full").alias("own_full")) for x in LEARNERS])
    out = wide.withColumn("c", F.explode(cells)).select(*keys, "local", F.col("central_full").alias("full"), "c.*")
    return out.where("peer is not null and absent is not null and local is not null")


def decompose(summary: DataFrame) -> DataFrame:
    """(keys, learner, estimand, value): total gain = pooling gain + knowledge gain, gap recovery, and the local deficit."""
    wide = _arms(summary, KEYS, "value")
    gap = F.col("full") - F.col("local")
    values = {
        "total_gain": F.col("peer") - F.col("local"),
        "pooling_gain": F.col("absent") - F.col("local"),
        "knowledge_gain": F.col("peer") - F.col("absent"),
        "oracle_gap_recovery": F.when(F.abs(gap) > 0, F.try_divide(F.col("peer") - F.col("local"), gap)),
        "local_deficit": gap,
    }
    return longer(wide, [*KEYS, "learner"], values, "estimand").where("estimand <> 'local_deficit' or learner = 'central'")


def family_seed_effects(families: DataFrame, alpha: float) -> DataFrame:
    keys = ["experiment", "seed", "salt", "client", "family"]
    rows = families.where((F.col("alpha") == alpha) & (F.col("population") == "federation-wide") & F.col("dose").isNull() & (F.col("trials") > 0))
    recalls = rows.withColumn("recall", F.col("hits") / F.col("trials"))
    trials = arm_values(recalls, keys, "trials", {f"t_{x}": _is(x, "peer-present") for x in LEARNERS})
    wide = _arms(recalls, keys, "recall").join(trials, keys)
    own = F.coalesce(*[F.when(F.col("learner") == x, F.col(f"t_{x}")) for x in LEARNERS])
    return wide.select(*keys, "learner", F.col("peer").alias("peer_recall"), F.col("absent").alias("absent_recall"), F.col("own_full").alias("full_recall"), F.col("local").alias("local_recall"), own.alias("trials"), (F.col("peer") - F.col("absent")).alias("knowledge_gain"))


def family_effects(seed_effects: DataFrame) -> DataFrame:
    names = ["local_recall", "absent_recall", "peer_recall", "full_recall", "knowledge_gain", "trials"]
    return seed_effects.groupBy("experiment", "family", "learner").agg(*[F.avg(n).alias(n) for n in names], F.count_distinct("seed").alias("seeds"))


DOSE_KEYS = ["experiment", "seed", "salt", "learner", "dose", "family"]


def dose_recall(families: DataFrame, alpha: float) -> DataFrame:
    rows = families.where((F.col("alpha") == alpha) & (F.col("population") == "federation-wide") & (F.col("condition") == "peer-present") & (F.col("trials") > 0))
    return rows.select(*DOSE_KEYS, "client", (F.col("hits") / F.col("trials")).alias("recall"))


def effective_peer_dose(exposure: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of a family that clients other than its target train on."""
    keys = ["experiment", "seed", "salt", "family"]
    hidden = targets.select(*keys, F.col("client").alias("target")).distinct()
    rows = exposure.where("condition = 'peer-present'").join(hidden, keys).where("client <> target")
    return rows.groupBy(*DOSE_KEYS).agg(F.sum("rows").alias("effective_dose"))


def dose_curve(recalls: DataFrame, effective: DataFrame) -> DataFrame:
    """Gain over dose 0 of the same family and run; a null dose is all that is available, and joins as itself."""
    zero = F.max(F.when(F.col("dose") == 0, F.col("recall"))).over(Window.partitionBy("experiment", "seed", "salt", "learner", "family"))
    joined = null_safe_join(recalls, effective, DOSE_KEYS, "left").withColumn("absent_recall", zero)
    return joined.where("absent_recall is not null").withColumn("knowledge_gain", F.col("recall") - F.col("absent_recall"))


def dose_levels(curve: DataFrame, minimum_peers: int) -> DataFrame:
    levels = curve.groupBy("learner", "dose").agg(
        F.avg("effective_dose").alias("effective_dose"),
        F.avg("recall").alias("recall"),
        F.stddev_samp("recall").alias("recall_std"),
        F.avg("knowledge_gain").alias("knowledge_gain"),
        F.count_if(F.col("effective_dose") >= minimum_peers).alias("observations_met"),
        F.count(F.lit(1)).alias("observations"),
    )
    return levels.withColumn("dose_level", F.coalesce(F.col("dose").cast("string"), F.lit("all-available"))).withColumn("meets_dose_criterion", F.col("effective_dose") >= minimum_peers)


def hidden_cells(families: DataFrame, alpha: float, learner: str = "fedavg") -> DataFrame:
    """Gains of each hidden cell; knowledge gain is split into repair of pooling loss, new capability, and harm."""
    keys = ["experiment", "seed", "salt", "population", "client", "family"]
    rows = families.where((F.col("alpha") == alpha) & F.col("dose").isNull() & (F.col("trials") > 0) & F.col("learner").isin("local", learner)).withColumn("recall", F.col("hits") / F.col("trials"))
    arms = {"peer_recall": _is(learner, "peer-present"), "absent_recall": _is(learner, "family-absent"), "local_recall": _is("local", "peer-present")}
    wide = arm_values(rows, keys, "recall", arms).join(arm_values(rows, keys, "trials", {"trials": _is(learner, "peer-present")}), keys).dropna(subset=list(arms))
    zero = F.lit(0.0)
    wide = wide.withColumns({"pooling_gain": F.col("absent_recall") - F.col("local_recall"), "total_gain": F.col("peer_recall") - F.col("local_recall"), "knowledge_gain": F.col("peer_recall") - F.col("absent_recall")})
    gain = F.greatest(F.col("knowledge_gain"), zero)
    repair = F.least(gain, F.greatest(-F.col("pooling_gain"), zero))
    return wide.withColumns({"repair": repair, "new_capability": gain - repair, "harm": F.least(F.col("knowledge_gain"), zero)})


def transfer_scopes(cells: DataFrame) -> DataFrame:
    """Means over cells, families, clients and all, by grouping sets; a null client or family means all of them."""
    cells.createOrReplaceTempView("_transfer_cells")
    return cells.sparkSession.sql(
        """SELECT population, client, family, avg(pooling_gain) AS pooling_gain, avg(knowledge_gain) AS knowledge_gain, avg(repair) AS repair,
        avg(new_capability) AS new_capability, avg(harm) AS harm, count_if(knowledge_gain < 0) AS hurt, count(*) AS observations
        FROM _transfer_cells GROUP BY GROUPING SETS ((population, client, family), (population, family), (population, client), (population))"""
    )


def micro_gain(families: DataFrame, alpha: float, excluded: DataFrame | None, hits: str = "hits", trials: str = "trials", learner: str = "fedavg") -> DataFrame:
    """(experiment, seed, salt, gain): ratio of sums, peers present less family absent."""
    rows = families.where((F.col("alpha") == alpha) & (F.col("population") == "federation-wide"))
    rows = rows if excluded is None else rows.join(excluded.select("family"), "family", "left_anti")
    part = lambda c, condition: safe_sum(F.when(_is(learner, condition), F.col(c)))
    rate = lambda condition: F.try_divide(part(hits, condition), part(trials, condition))
    out = rows.groupBy("experiment", "seed", "salt").agg((rate("peer-present") - rate("family-absent")).alias("gain"))
    return out.where("gain is not null")


def top_families(families: DataFrame, count: int) -> DataFrame:
    mean = families.where("population = 'federation-wide'").groupBy("family").agg(F.avg("trials").alias("trials"))
    return mean.orderBy(F.desc("trials"), "family").limit(count)


def select_tuning(summary: DataFrame, alpha: float) -> DataFrame:
    """(parameter, tuning_value, score): best mean calibration AUROC of each parameter, ties to the smaller value."""
    rows = summary.where((F.col("alpha") == alpha) & (F.col("metric") == "calibration-auroc") & F.col("parameter").isNotNull())
    mean = rows.groupBy("parameter", "tuning_value").agg(F.avg("value").alias("score"))
    best = Window.partitionBy("parameter").orderBy(F.col("score").desc_nulls_last(), "tuning_value")
    return mean.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def worst_clients(clients: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, client, recall): the client of least recall, ties by name."""
    rows = clients.where("trials > 0").withColumn("recall", F.col("hits") / F.col("trials"))
    first = Window.partitionBy(*keys).orderBy("recall", "client")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*keys, "client", "recall")


def classify_rescue(effects: DataFrame, poor: float) -> DataFrame:
    """Adds level: whether full exposure brings a family's recall to ``poor`` at least; without that arm it can't be told."""
    full = F.col("full_recall")
    level = F.when(full.isNull(), F.lit("not-classifiable")).when(full < F.lit(poor), F.lit("poorly-rescued")).otherwise(F.lit("rescued"))
    return effects.withColumn("level", level)
