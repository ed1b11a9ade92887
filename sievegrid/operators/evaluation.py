"""Thresholds at a false-positive target, hit counts by population, discrimination and long summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import any_of, higher_quantile, is_finite, null_safe_join, quantile_of, safe_sum
from sievegrid.operators.ordering import prefix_by_value, prefix_of, sums_by_value
from sievegrid.session import stage, unstage

ARM = ["learner", "condition", "dose", "parameter", "tuning_value"]
#: Bins of a group's scores.
BINS = 4096
POPULATIONS = ["benign", "known-family", "own-domain", "federation-wide"]


def blend(local: Column, shared: Column, weight: float) -> Column:
    """Weighted mean of the two scores' logistic values."""
    logistic = lambda z: 1 / (1 + F.exp(-z))
    return weight * logistic(local) + (1 - weight) * logistic(shared)


def pools(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(pool, own, unseen, ...rows): each client's calibration and test rows, and test rows anywhere of families hidden from it."""
    hidden = targets.select(F.col("client").alias("pool"), "family").distinct()
    own = rows.where("role in ('calibration', 'test')").withColumn("pool", F.col("client"))
    marked = own.join(hidden.withColumn("_h", F.lit(True)), ["pool", "family"], "left")
    marked = marked.withColumn("unseen", F.coalesce("_h", F.lit(False)) & (F.col("label") == 1)).drop("_h").withColumn("own", F.lit(True))
    away = rows.where("role = 'test' and label = 1").join(hidden, "family").where("client <> pool").withColumn("unseen", F.lit(True)).withColumn("own", F.lit(False))
    return marked.unionByName(away)


def calibrate(benign: DataFrame, alphas: list[float], min_exceedances: int, groups: list[str]) -> DataFrame:
    """(groups, alpha, threshold, calibration_benign, operating_status) from (groups, score) of benign calibration rows."""
    return _operating(higher_quantile(benign, groups, "score", 1 - F.col("alpha"), "threshold", F.array(*[F.lit(a) for a in alphas]), "alpha"), groups, min_exceedances)


def _operating(found: DataFrame, groups: list[str], min_exceedances: int) -> DataFrame:
    status = F.when(F.col("n") * F.col("alpha") >= min_exceedances, F.lit("valid")).otherwise(F.lit("insufficient-evidence"))
    return found.select(*groups, "alpha", "threshold", F.col("n").alias("calibration_benign"), status.alias("operating_status"))


def with_missing_thresholds(thresholds: DataFrame, clients: DataFrame, alphas: list[float], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """A client (of each of ``keys``) without benign calibration rows gets threshold 0 and insufficient evidence."""
    grid = clients.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    filled = grid.join(thresholds, [*keys, "client", "alpha"], "left")
    return filled.select(*keys, "client", "alpha", F.coalesce("threshold", F.lit(0.0)).alias("threshold"), F.coalesce("calibration_benign", F.lit(0)).alias("calibration_benign"), F.coalesce("operating_status", F.lit("insufficient-evidence")).alias("operating_status"))


def population_of() -> Column:
    """The populations that a test row of a pool belongs to."""
    own, bad, unseen = F.col("own"), F.col("label") == 1, F.col("unseen")
    cases = {"benign": own & ~bad, "known-family": own & bad & ~unseen, "own-domain": own & bad & unseen, "federation-wide": bad & unseen}
    return F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in cases.items()]))


def client_counts(pool: DataFrame, thresholds: DataFrame, alphas: list[float]) -> DataFrame:
    """(client, alpha, population, hits, trials), zeros included."""
    test = pool.where("role = 'test'").withColumn("population", F.explode(population_of())).select(F.col("pool").alias("client"), "population", "score")
    counts = count_hits(test, thresholds, ["client"], ["population"])
    grid = thresholds.select("client", "alpha").withColumn("population", F.explode(F.array(*[F.lit(p) for p in POPULATIONS])))
    return grid.join(counts, ["client", "alpha", "population"], "left").na.fill(0, ["hits", "trials"])


def count_hits(rows: DataFrame, thresholds: DataFrame, keys: list[str], groups: list[str], first: Column | None = None) -> DataFrame:
    """(keys, alpha, groups, hits, trials) of (keys, groups, score), and with ``first`` the counts of the rows that it marks."""
    hit = F.col("score") > F.col("threshold")
    counts = [F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("trials")]
    if first is not None:
        counts += [F.count_if(hit & first).alias("unique_hits"), F.count_if(first).alias("unique_trials")]
    return rows.join(thresholds.select(*keys, "alpha", "threshold"), keys).groupBy(*keys, "alpha", *groups).agg(*counts)


def hidden_first(pool: DataFrame, row: str, feature: str) -> DataFrame:
    """Hidden families' test rows, once a population, with ``first``: the first row of its vector there."""
    both = F.array(F.lit("own-domain"), F.lit("federation-wide"))
    hidden = pool.where("role = 'test' and unseen").withColumn("population", F.explode(F.when(F.col("own"), both).otherwise(F.array(F.lit("federation-wide")))))
    return hidden.withColumn("first", F.row_number().over(Window.partitionBy("pool", "population", "family", feature).orderBy(row)) == 1)


def family_counts(pool: DataFrame, thresholds: DataFrame, row: str, feature: str) -> DataFrame:
    """(client, alpha, population, family, hits, trials, unique_hits, unique_trials) of hidden families; unique: first row of a vector."""
    rows = hidden_first(pool, row, feature).select(F.col("pool").alias("client"), "population", "family", "first", "score")
    return count_hits(rows, thresholds, ["client"], ["population", "family"], F.col("first"))


def class_curve(rows: DataFrame, groups: list[str], label: str, score: str, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(groups, score, p, q and their sums below and in all): positives and negatives by score, in the stretches that ``near`` wants."""
    return prefix_by_value(rows, groups, score, _classes(label), near)


def _classes(label: str) -> dict[str, Column]:
    return {"p": F.count_if(F.col(label) == 1), "q": F.count_if(F.col(label) == 0)}


def _passing(fpr: float) -> Callable[[DataFrame], DataFrame]:
    """The stretches in which the negatives' rate, from the top, passes ``fpr``."""
    rate = lambda c: F.try_divide(F.col("q_all") - F.col(c), F.col("q_all"))
    return lambda s: s.where((rate("q_end") <= fpr) & (rate("q_start") > fpr))


def discrimination(rows: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(groups, auroc, auprc) from one curve; groups of one class are left out.

    auroc: the part of pairs in which the positive scores higher, ties half. auprc: the sum over distinct scores, from the top, of precision
    times the recall gained.
    """
    return _areas(class_curve(rows, groups, label, score), groups)


def calibrated_discrimination(rows: DataFrame, groups: list[str], alphas: list[float], min_exceedances: int) -> tuple[DataFrame, DataFrame]:
    """(calibrate() of the benign rows of the split "calibration", discrimination()) of (groups, split, label, score): scores are put in order once for both."""
    keys, names = [*groups, "split"], ["p", "q"]
    by, stretches = sums_by_value(rows, keys, "score", _classes("label"))
    stretches = stage(stretches, "all-stretches")
    of = F.col("split") == "calibration"
    found = quantile_of(by.where(of), stretches.where(F.col(f"_g{len(groups)}")["split"] == "calibration"), keys, "score", names, "q", 1 - F.col("alpha"), "threshold", F.array(*[F.lit(a) for a in alphas]), "alpha")
    return _operating(found, groups, min_exceedances), _areas(prefix_of(by, stretches, keys, "score", names), keys)


def _areas(curve: DataFrame, groups: list[str]) -> DataFrame:
    wins = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2))
    tp, fp = F.col("p_all") - F.col("p_before"), F.col("q_all") - F.col("q_before")
    area = F.sum(F.col("p") * F.try_divide(tp, tp + fp))
    sums = curve.groupBy(*groups).agg(wins.alias("wins"), area.alias("area"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.where("p > 0 and q > 0").select(*groups, (F.col("wins") / (F.col("p") * F.col("q"))).alias("auroc"), (F.col("area") / F.col("p")).alias("auprc"))


def auroc(rows: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    return discrimination(rows, groups, label, score).drop("auprc")


def average_precision(rows: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    return discrimination(rows, groups, label, score).drop("auroc")


def recall_at_fpr(rows: DataFrame, groups: list[str], fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    """(groups, recall): the ROC curve at exactly ``fpr``, interpolated between distinct scores.

    Classes are counted by bins of the score; scores are put in order only in a group's one bin in which the negatives' rate passes ``fpr``.
    """
    kept = stage(rows.where(F.col(score).isNotNull()).select(*groups, label, score), "scores")  # read for the bounds, the bins and one bin's scores
    binned = kept.withColumn("_bin", _bin(kept, score))
    own = Window.partitionBy(*groups)
    above = own.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*groups, "_bin").agg(*[m.alias(n) for n, m in _classes(label).items()])
    bins = bins.withColumns({f"_{n}_above": F.coalesce(F.sum(n).over(above), F.lit(0)) for n in "pq"} | {f"_{n}_all": F.sum(n).over(own) for n in "pq"})
    rate = lambda c: F.try_divide(c, F.col("_q_all"))
    passed = bins.where((rate(F.col("_q_above")) <= fpr) & (rate(F.col("_q_above") + F.col("q")) > fpr))
    passed = stage(passed.drop("p", "q"), "passed-bins")  # a row a group; so that Spark knows how few they are
    curve = class_curve(null_safe_join(binned, passed, [*groups, "_bin"]), groups, label, score)
    unstage(kept)
    curve = null_safe_join(curve, passed, groups)
    over = lambda n: F.col(f"_{n}_above") + F.col(f"{n}_all") - F.col(f"{n}_before")
    curve = curve.withColumns({
        "y": F.try_divide(over("p"), F.col("_p_all")), "x": F.try_divide(over("q"), F.col("_q_all")),
        "y0": F.try_divide(over("p") - F.col("p"), F.col("_p_all")), "x0": F.try_divide(over("q") - F.col("q"), F.col("_q_all")),
    })
    inside = curve.where((F.col("x0") <= fpr) & (F.col("x") > fpr))
    at = F.col("y0") + (F.col("y") - F.col("y0")) * (fpr - F.col("x0")) / (F.col("x") - F.col("x0"))
    return inside.select(*groups, at.alias("recall"))


def _bin(rows: DataFrame, score: str) -> Column:
    """A whole number that does not fall as the score grows: BINS of one width between the least and the largest finite score."""
    value = F.col(score).cast("double")
    finite = is_finite(value)
    low, high = rows.agg(F.min(F.when(finite, value)), F.max(F.when(finite, value))).first()
    width = high - low if low is not None else 0.0
    place = F.least(F.floor((value - low) / width * BINS), F.lit(BINS - 1)) if 0 < width < float("inf") else F.lit(0)
    return F.when(finite, place.cast("long")).when(value == float("-inf"), F.lit(-1)).otherwise(F.lit(BINS))


def fpr_crossings(negatives: DataFrame, groups: list[str], fpr: float, score: str = "score") -> DataFrame:
    """(groups, crossing, crossing_below, crossing_at): the score at which the negatives' rate, from the top, passes ``fpr``, and the rates above and with it.

    ROC curves of many sets of positives against the same negatives pass ``fpr`` at this score, whatever the positives are.
    """
    curve = prefix_by_value(negatives, groups, score, {"q": F.count(F.lit(1))}, _passing(fpr))
    above = F.col("q_all") - F.col("q_before") - F.col("q")
    rates = curve.select(*groups, F.col(score).alias("crossing"), (above / F.col("q_all")).alias("crossing_below"), ((above + F.col("q")) / F.col("q_all")).alias("crossing_at"))
    return rates.where((F.col("crossing_below") <= fpr) & (F.col("crossing_at") > fpr))


def summarise(clients: DataFrame, families: DataFrame, discrimination: DataFrame, thresholds: DataFrame, own_min: int, keys: list[str]) -> DataFrame:
    """(keys, alpha, metric, value, operating_status) in long form; keys may hold null."""
    groups = [*keys, "alpha"]
    rate = F.col("hits") / F.col("trials")
    recall = lambda population, least=1: F.when((F.col("population") == population) & (F.col("trials") >= least), rate)
    own, fed, known, benign = recall("own-domain", max(own_min, 1)), recall("federation-wide"), recall("known-family"), recall("benign")
    wide = clients.groupBy(*groups).agg(
        F.avg(own).alias("own-domain-unseen-recall"),
        F.avg(fed).alias("federation-unseen-recall"),
        F.min(fed).alias("worst-client-unseen-recall"),
        F.max(1 - fed).alias("worst-client-fnr"),
        F.stddev_pop(fed).alias("client-recall-dispersion"),
        F.avg(known).alias("known-family-recall"),
        F.avg(benign).alias("realised-fpr"),
        F.max(benign).alias("worst-client-fpr"),
        F.stddev_pop(benign).alias("fpr-dispersion"),
    )
    of_families = families.groupBy(*groups).agg(
        F.avg(fed).alias("family-macro-unseen-recall"),
        F.stddev_pop(fed).alias("family-recall-dispersion"),
        F.try_divide(safe_sum(F.when(F.col("population") == "federation-wide", F.col("hits"))), safe_sum(F.when(F.col("population") == "federation-wide", F.col("trials")))).alias("micro-unseen-recall"),
    )
    macro = discrimination.groupBy(*keys).agg(
        F.avg(F.when(F.col("split") == "test", F.col("auroc"))).alias("auroc"),
        F.avg(F.when(F.col("split") == "test", F.col("auprc"))).alias("auprc"),
        F.avg(F.when(F.col("split") == "calibration", F.col("auroc"))).alias("calibration-auroc"),
    )
    status = thresholds.groupBy(*groups).agg(F.when(any_of(F.col("operating_status") == "insufficient-evidence"), F.lit("insufficient-evidence")).otherwise(F.lit("valid")).alias("operating_status"))
    wide = null_safe_join(wide, of_families, groups, "left")
    wide = null_safe_join(wide, macro, keys, "left") if keys else wide.crossJoin(F.broadcast(macro))  # one row
    metrics = [c for c in wide.columns if c not in groups]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics])).alias("c")
    long = wide.select(*groups, cells).select(*groups, "c.metric", "c.value").where("value is not null")
    return null_safe_join(long, status, groups, "left")
