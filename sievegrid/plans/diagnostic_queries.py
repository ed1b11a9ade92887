"""Queries of the diagnostic, synthesis and report tables, and their SQL. Importing this module adds them to the registry.

Where a table has intervals by resampling, its query with SQL leaves them out; a query of the same operator without SQL has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import decomposition as D
from sievegrid.operators import diagnostics as G
from sievegrid.operators import dosefits
from sievegrid.operators import preparation as prep
from sievegrid.operators import statistics as stat
from sievegrid.operators import tables as X
from sievegrid.plans import queries as Q
from sievegrid.plans import study as T
from sievegrid.plans.queries import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

OWN_MIN = 3
_RANK = "rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0"


def nine(c: str | Column) -> Column:
    """Values that are ranked or compared are rounded first, so that engines agree on ties."""
    return F.round(c, 9)


def seed_effects(spark: SparkSession, sf: str) -> DataFrame:
    return D.family_seed_effects(T.families(spark, sf), 0.05)


# Confirmatory tables.

RUN_ARM = ["experiment", "seed", "salt", "learner", "condition", "dose", "parameter", "tuning_value"]


def clients(spark: SparkSession, sf: str) -> DataFrame:
    return T.families(spark, sf).groupBy(*RUN_ARM, "client", "alpha", "population").agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))


_CLIENTS = f"{T.FAMILIES}, clients AS (SELECT experiment, seed, salt, learner, condition, dose, parameter, tuning_value, client, alpha, population, sum(hits)::BIGINT AS hits, sum(trials)::BIGINT AS trials FROM families GROUP BY ALL)"
_CLIENT_RECALLS = f"""{_CLIENTS}, cr AS (SELECT *, hits::DOUBLE / trials AS r FROM clients WHERE dose IS NULL AND parameter IS NULL),
 lr AS (SELECT seed, alpha, population, client, max(r) AS l FROM cr WHERE learner = 'local' GROUP BY ALL),
 wide AS (SELECT cr.seed, cr.alpha, cr.population, cr.client, learner, l, max(r) FILTER (WHERE condition = 'peer-present') AS p, max(r) FILTER (WHERE condition = 'family-absent') AS a, max(r) FILTER (WHERE condition = 'full-exposure') AS f
 FROM cr JOIN lr ON lr.seed = cr.seed AND lr.alpha = cr.alpha AND lr.population = cr.population AND lr.client = cr.client WHERE learner <> 'local' GROUP BY ALL)"""
_CLIENT_KEYS = ["seed", "alpha", "population"]


@query(
    "c01_anchored_worst",
    f"""WITH {_CLIENT_RECALLS}, w AS (SELECT seed, alpha, population, client FROM lr QUALIFY row_number() OVER (PARTITION BY seed, alpha, population ORDER BY l, client) = 1),
 d AS (SELECT * FROM wide JOIN w USING (seed, alpha, population, client)),
 long AS (SELECT seed, alpha, population, client, learner, estimand, CASE estimand WHEN 'total_gain' THEN p - l WHEN 'pooling_gain' THEN a - l WHEN 'knowledge_gain' THEN p - a ELSE CASE WHEN learner = 'central' THEN f - l END END AS x FROM d, (VALUES ('total_gain'), ('pooling_gain'), ('knowledge_gain'), ('local_deficit')) e(estimand))
 SELECT seed, alpha, population, client, learner, estimand, round(x, 6) AS difference FROM long WHERE x IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.anchored_worst(clients(spark, sf), _CLIENT_KEYS)


@query("c01_anchored_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.paired_effects(G.anchored_worst(clients(spark, sf), _CLIENT_KEYS), ["alpha", "population", "learner", "estimand"], "difference")


@query("c04_synthesis")
def _(spark: SparkSession, sf: str) -> DataFrame:
    knowledge = D.decompose(T.summary(spark, sf)).where("estimand = 'knowledge_gain' and learner = 'fedavg' and alpha = 0.05")
    effects = stat.paired_effects(knowledge, ["metric"], "value")
    rows = T.families(spark, sf)
    micro = D.micro_gain(rows, 0.05, None).withColumn("variant", F.lit("all")).unionByName(D.micro_gain(rows, 0.05, D.top_families(rows, 3)).withColumn("variant", F.lit("top-removed")))
    pooled = stat.paired_effects(micro, ["variant"], "gain")
    return G.evidence_synthesis(effects, pooled, {"own-domain-recall": "own domain", "federation-wide-recall": "federation", "all": "federation, micro", "top-removed": "federation, micro, top removed"})


_FAMILY_EFFECTS = f"{Q._SEED_EFFECTS}, fe AS (SELECT experiment, family, learner, avg(local_recall) AS local_recall, avg(absent_recall) AS absent_recall, avg(peer_recall) AS peer_recall, avg(full_recall) AS full_recall, avg(knowledge_gain) AS knowledge_gain, avg(trials) AS trials, count(DISTINCT seed) AS seeds FROM effects GROUP BY ALL)"


@query(
    "c08_patterns",
    f"""WITH {_FAMILY_EFFECTS} SELECT e.experiment, e.family, round(e.trials, 6) AS trials, e.seeds, round(e.local_recall, 6) AS local_recall, round(e.absent_recall, 6) AS absent_recall, round(e.peer_recall, 6) AS peer_recall, round(e.knowledge_gain, 6) AS knowledge_gain,
 round(e.absent_recall - e.local_recall, 6) AS pooling_gain, round(e.peer_recall - e.local_recall, 6) AS total_gain, round(c.full_recall, 6) AS central_full_recall, round(x.full_recall, 6) AS fedprox_full_recall
 FROM fe e LEFT JOIN fe c ON c.family = e.family AND c.learner = 'central' LEFT JOIN fe x ON x.family = e.family AND x.learner = 'fedprox' WHERE e.learner = 'fedavg'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.mechanism_patterns(D.family_effects(seed_effects(spark, sf)), "fedavg", ["central", "fedprox"])


@query("c09_coverage", f"WITH {_FAMILY_EFFECTS} SELECT experiment, family, learner, round(knowledge_gain, 6) AS knowledge_gain, (SELECT count(DISTINCT family) FROM effects) AS families, (SELECT count(DISTINCT client) FROM effects) AS clients FROM fe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    by_seed = seed_effects(spark, sf)
    return G.coverage(D.family_effects(by_seed).select("experiment", "family", "learner", "knowledge_gain"), by_seed)


@query(
    "c11_client_gains",
    f"""WITH {_CLIENT_RECALLS} SELECT alpha, population, client, learner, round(avg(l), 6) AS local_recall, round(avg(a), 6) AS absent_recall, round(avg(p), 6) AS peer_recall, round(avg(f), 6) AS full_recall, round(avg(p) - avg(l), 6) AS total_gain, round(avg(a) - avg(l), 6) AS pooling_gain,
 round(avg(p - a), 6) AS knowledge_gain, count(*) AS seeds, count(*) FILTER (WHERE p - a > 0) AS positive FROM wide GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.client_gains(clients(spark, sf), _CLIENT_KEYS)


@query(
    "c16_drift",
    f"""WITH {T.SUMMARY}, m AS (SELECT parameter, tuning_value, round(avg(value), 9) AS s FROM summary WHERE alpha = 0.05 AND metric = 'own-domain-recall' AND parameter IS NOT NULL GROUP BY ALL), b AS (SELECT parameter, tuning_value FROM m QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY s DESC, tuning_value) = 1)
 SELECT parameter, tuning_value AS found, 0.5::DOUBLE AS frozen FROM b WHERE tuning_value <> 0.5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    chosen = D.select_tuning(T.summary(spark, sf).withColumn("metric", F.regexp_replace("metric", "^own-domain-recall$", "calibration-auroc")), 0.05)
    return G.frozen_drift(chosen, spark.createDataFrame([("mu", 0.5)], "parameter string, tuning_value double"))


@query("c19_family_client", f"WITH {Q._CELLS} SELECT client, family, round(avg(local_recall), 6) AS local_recall, round(avg(absent_recall), 6) AS absent_recall, round(avg(peer_recall), 6) AS peer_recall, round(avg(trials), 6) AS hidden_trials, round(avg(knowledge_gain), 6) AS gain, count(*) AS seeds, count(*) FILTER (WHERE knowledge_gain > 0) AS positive FROM hcells WHERE population = 'own-domain' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.family_client_gains(D.hidden_cells(T.families(spark, sf), 0.05))


# Contrasts of doses and of representations.

_ARM_VALUES = "SELECT scope, population, alpha, seed, max(recall) FILTER (WHERE condition = 'family-absent') AS none, max(recall) FILTER (WHERE condition = 'peer-present' AND dose IS NULL) AS d_all, max(recall) FILTER (WHERE dose = 0) AS d0, max(recall) FILTER (WHERE dose = 10) AS d10, max(recall) FILTER (WHERE dose = 100) AS d100 FROM recalls WHERE learner = 'fedavg' AND parameter IS NULL GROUP BY ALL"
_DOSE_CONTRASTS = f"""{Q._SCOPED}, av AS ({_ARM_VALUES}), dc AS (SELECT scope, population, alpha, seed, c.contrast, CASE c.contrast WHEN 'onset-10' THEN d10 - d0 WHEN 'onset-100' THEN d100 - d0 WHEN 'natural' THEN d_all - d0 WHEN 'increment-10-100' THEN d100 - d10 ELSE d0 - none END AS difference
 FROM av, (VALUES ('onset-10'), ('onset-100'), ('natural'), ('increment-10-100'), ('zero-less-absent')) c(contrast))"""


def dose_differences(spark: SparkSession, sf: str) -> DataFrame:
    return X.dose_contrasts(Q._recalls(spark, sf), "fedavg", [10, 100])


@query("x06_dose_contrasts", f"WITH {_DOSE_CONTRASTS} SELECT scope, population, alpha, contrast, round(avg(difference), 6) AS mean, round(median(difference), 6) AS median, count(*) FILTER (WHERE difference > 0) AS positive, count(*) AS seeds FROM dc WHERE difference IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.contrast_effects(dose_differences(spark, sf), ["scope", "population", "alpha", "contrast"], ["scope", "population", "alpha"]).select("scope", "population", "alpha", "contrast", "mean", "median", "positive", "seeds")


_PRIORITY, _CONTRAST, _SINGLE = ["Brand#11", "Brand#12", "Brand#13"], ["Brand#21", "Brand#22"], ["Brand#11", "Brand#12", "Brand#31"]
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_REPRESENTED = f"{T.FAMILIES}, rv AS (SELECT learner AS representation, seed, family, population, avg(hits::DOUBLE / trials) AS value FROM families WHERE alpha = 0.05 AND condition = 'peer-present' AND dose IS NULL AND parameter IS NULL AND trials >= CASE population WHEN 'own-domain' THEN {OWN_MIN} ELSE 1 END GROUP BY ALL), pr AS (SELECT v.*, b.value AS baseline, v.value - b.value AS difference FROM rv v JOIN rv b ON b.representation = 'local' AND b.seed = v.seed AND b.family = v.family AND b.population = v.population WHERE v.representation <> 'local')"
_MACROS = f"""{_REPRESENTED}, gr AS (SELECT * FROM (SELECT *, family AS "group" FROM pr WHERE family IN ({_LIST(_SINGLE)}) UNION ALL SELECT *, 'priority' FROM pr WHERE family IN ({_LIST(_PRIORITY)}) UNION ALL SELECT *, 'contrast' FROM pr WHERE family IN ({_LIST(_CONTRAST)}))), mg AS (SELECT representation, population, seed, "group", avg(value) AS value, avg(baseline) AS baseline, avg(difference) AS difference FROM gr GROUP BY ALL)"""


def represented(spark: SparkSession, sf: str) -> DataFrame:
    """Learners stand for representations; the local one is the reference."""
    rows = G.usable_recalls(T.families(spark, sf), OWN_MIN).where("alpha = 0.05 and condition = 'peer-present' and dose is null and parameter is null")
    return rows.groupBy(F.col("learner").alias("representation"), "seed", "family", "population").agg(F.avg("recall").alias("value"))


def representation_groups(spark: SparkSession, sf: str) -> DataFrame:
    paired = G.paired_to_reference(represented(spark, sf), ["seed", "family", "population"], "representation", "local")
    return G.with_macro_groups(paired, ["representation", "population", "seed"], {"priority": _PRIORITY, "contrast": _CONTRAST}, _SINGLE, ["value", "baseline", "difference"])


@query("x10_paired", f"WITH {_REPRESENTED} SELECT representation, seed, family, population, round(value, 6) AS value, round(baseline, 6) AS baseline, round(difference, 6) AS difference FROM pr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.paired_to_reference(represented(spark, sf), ["seed", "family", "population"], "representation", "local")


@query("x11_macro_groups", f'WITH {_MACROS} SELECT representation, population, seed, "group", round(value, 6) AS value, round(baseline, 6) AS baseline, round(difference, 6) AS difference FROM mg')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return representation_groups(spark, sf)


@query("x12_representation_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    effects = stat.paired_effects(representation_groups(spark, sf), ["representation", "population", "group"], "difference")
    return stat.holm_adjusted(effects, ["representation", "population"], "p", "group", "holm_p")


@query(
    "g29_sensitivity",
    f"""WITH {_MACROS}, k AS (SELECT representation, population, "group", seed, difference AS x, seed % 2 = 0 AS ok FROM mg),
 s AS (SELECT *, 'all-seeds' AS scenario, NULL::BIGINT AS omitted FROM k UNION ALL SELECT *, 'valid-only', NULL FROM k WHERE ok
 UNION ALL SELECT k.*, 'leave-one-out', o.seed FROM k JOIN (SELECT representation AS r, population AS p, "group" AS g, seed FROM k) o ON o.r = k.representation AND o.p = k.population AND o.g = k."group" AND o.seed <> k.seed
 UNION ALL SELECT k.*, 'valid-leave-one-out', o.seed FROM k JOIN (SELECT representation AS r, population AS p, "group" AS g, seed FROM k WHERE ok) o ON o.r = k.representation AND o.p = k.population AND o.g = k."group" AND o.seed <> k.seed WHERE k.ok)
 SELECT representation, population, "group", scenario, omitted, round(avg(x), 6) AS mean, round(median(x), 6) AS median, count(*) FILTER (WHERE x > 0) AS positive, count(*) AS seeds FROM s GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = G.sensitivity_scenarios(representation_groups(spark, sf), ["representation", "population", "group"], "difference", F.col("seed") % 2 == 0)
    return found.select("representation", "population", "group", "scenario", "omitted", "mean", "median", "positive", "seeds")


# Cells of contrasts.

def _arms() -> dict[str, Column]:
    fedavg, fedprox = F.col("learner") == "fedavg", F.col("learner") == "fedprox"
    return {"with_peers": fedavg & X.arm_is("peer-present"), "without": fedavg & X.arm_is("family-absent"), "dose_zero": fedavg & X.arm_is("peer-present", 0), "prox": fedprox & X.arm_is("peer-present")}


_CONTRASTS = {"gain": ("with_peers", "without"), "placebo_effect": ("dose_zero", "without"), "gain_less_placebo": ("gain", "placebo_effect"), "prox_gain": ("prox", "without"), "prox_less_mean": ("prox_gain", "gain")}
_KINDS = {"gain": "superior", "placebo_effect": "equivalence", "gain_less_placebo": "superior", "prox_less_mean": "noninferior"}
_STRATUM = ["population", "alpha"]
_CONTROL = f"""{T.FAMILIES}, cw AS (SELECT experiment, seed, salt, population, alpha, client, family, max(r) FILTER (WHERE learner = 'fedavg' AND condition = 'peer-present' AND dose IS NULL) AS with_peers, max(r) FILTER (WHERE learner = 'fedavg' AND condition = 'family-absent') AS without, max(r) FILTER (WHERE learner = 'fedavg' AND dose = 0) AS dose_zero, max(r) FILTER (WHERE learner = 'fedprox' AND condition = 'peer-present' AND parameter IS NULL) AS prox
 FROM (SELECT *, hits::DOUBLE / trials AS r FROM families WHERE trials >= CASE population WHEN 'own-domain' THEN {OWN_MIN} ELSE 1 END) GROUP BY ALL),
 cc AS (SELECT *, with_peers - without AS gain, dose_zero - without AS placebo_effect, prox - without AS prox_gain, (with_peers - without) - (dose_zero - without) AS gain_less_placebo, (prox - without) - (with_peers - without) AS prox_less_mean FROM cw)"""


def control(spark: SparkSession, sf: str) -> DataFrame:
    return G.control_cells(T.families(spark, sf), _arms(), _CONTRASTS, OWN_MIN)


@query("g01_control_cells", f"WITH {_CONTROL} SELECT seed, population, alpha, client, family, round(with_peers, 6) AS with_peers, round(without, 6) AS without, round(gain, 6) AS gain, round(placebo_effect, 6) AS placebo_effect, round(gain_less_placebo, 6) AS gain_less_placebo, round(prox_less_mean, 6) AS prox_less_mean FROM cc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return control(spark, sf).select("seed", *_STRATUM, "client", "family", "with_peers", "without", "gain", "placebo_effect", "gain_less_placebo", "prox_less_mean")


@query("g03_seed_means", f"WITH {_CONTROL}, m AS (SELECT population, alpha, seed, avg(gain) AS gain, avg(placebo_effect) AS placebo_effect FROM cc GROUP BY ALL) SELECT population, alpha, seed, 'gain' AS measure, round(gain, 6) AS value FROM m UNION ALL SELECT population, alpha, seed, 'placebo_effect', round(placebo_effect, 6) FROM m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.seed_means(control(spark, sf), _STRATUM, ["gain", "placebo_effect"])


@query("g03_strata_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.strata_effects(control(spark, sf), _STRATUM, _KINDS, 0.05)


@query("g04_client_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.client_effects(control(spark, sf), _STRATUM, ["placebo_effect", "gain_less_placebo"], 5)


@query("g05_reallocation_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    stratum = F.when(F.substring("family", 7, 1) == "1", F.lit("reallocated")).otherwise(F.lit("not-reallocated"))
    return G.split_effects(control(spark, sf), _STRATUM, "placebo_effect", stratum, "reallocated", "not-reallocated", 0.05)


@query("g06_slopes", f"WITH {_CONTROL} SELECT population, alpha, count(*) AS n, round(regr_slope(gain, without), 6) AS slope, round(regr_intercept(gain, without), 6) AS intercept FROM cc WHERE gain IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.slopes(control(spark, sf), _STRATUM, "without", "gain").select(*_STRATUM, "n", "slope", "intercept")


_LONG_RANKS = "l AS (SELECT population, alpha, predictor, y, CASE predictor WHEN 'without' THEN x1 ELSE x2 END AS x FROM v, (VALUES ('without'), ('dose_zero')) p(predictor)), r AS (SELECT population, alpha, predictor, {a} AS a, {b} AS b FROM l) SELECT population, alpha, predictor, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY ALL".format(a=_RANK.format(keys="population, alpha, predictor", value="x"), b=_RANK.format(keys="population, alpha, predictor", value="y"))


@query("g07_associations", f"WITH {_CONTROL}, v AS (SELECT population, alpha, round(gain, 9) AS y, round(without, 9) AS x1, round(dose_zero, 9) AS x2 FROM cc WHERE gain IS NOT NULL AND dose_zero IS NOT NULL), {_LONG_RANKS}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cells = control(spark, sf).withColumns({c: nine(c) for c in ("gain", "without", "dose_zero")})
    return G.rank_associations(cells, _STRATUM, "gain", ["without", "dose_zero"], 4).select(*_STRATUM, "predictor", "rho", "n")


@query("g09_family_means", f"WITH {_CONTROL} SELECT population, alpha, family, count(*) AS cells, round(avg(gain), 6) AS gain, round(avg(placebo_effect), 6) AS placebo_effect FROM cc GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.grouped_means(control(spark, sf), [*_STRATUM, "family"], ["gain", "placebo_effect"])


# Doses.

_PAIRS = f"""{T.FAMILIES}, pg AS (SELECT seed, population, alpha, client, family, learner, coalesce(dose, -1) AS dose_code, hits::DOUBLE / trials - max(hits::DOUBLE / trials) FILTER (WHERE dose = 0) OVER (PARTITION BY seed, population, alpha, client, family, learner) AS gain
 FROM families WHERE condition = 'peer-present' AND parameter IS NULL AND trials >= CASE population WHEN 'own-domain' THEN {OWN_MIN} ELSE 1 END QUALIFY gain IS NOT NULL), lv AS (SELECT population, alpha, seed, dose_code, avg(gain) AS gain FROM pg GROUP BY ALL)"""


def gains(spark: SparkSession, sf: str) -> DataFrame:
    return G.pair_gains(T.families(spark, sf), OWN_MIN)


@query("g12_pair_gains", f"WITH {_PAIRS} SELECT seed, population, alpha, client, family, learner, dose_code, round(gain, 6) AS gain FROM pg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gains(spark, sf).select("seed", *_STRATUM, "client", "family", "learner", "dose_code", "gain")


@query("g15_wide_by_dose", f"WITH {_PAIRS} SELECT population, alpha, seed, round(max(gain) FILTER (WHERE dose_code = 0), 6) AS dose_0, round(max(gain) FILTER (WHERE dose_code = 10), 6) AS dose_10, round(max(gain) FILTER (WHERE dose_code = 100), 6) AS dose_100, round(max(gain) FILTER (WHERE dose_code = -1), 6) AS \"natural\" FROM lv GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.wide_by_dose(G.level_means(gains(spark, sf), _STRATUM), _STRATUM, [0, 10, 100, G.NATURAL])


_EFFECTS = "round(avg(gain), 6) AS mean, round(median(gain), 6) AS median, count(*) FILTER (WHERE gain > 0) AS positive, count(*) AS seeds"


@query("g16_dose_effects", f"WITH {_PAIRS} SELECT population, alpha, dose_code, {_EFFECTS} FROM lv GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.dose_effects(G.level_means(gains(spark, sf), _STRATUM), _STRATUM).select(*_STRATUM, "dose_code", "mean", "median", "positive", "seeds")


@query("g18_family_onsets")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = [*_STRATUM, "family"]
    return G.dose_onsets(G.dose_effects(G.level_means(gains(spark, sf), keys), keys), keys, 0.1, 10)


_GROUP = "population, alpha, family"
_POINT_FITS = f"""{_PAIRS}, gl AS (SELECT population, alpha, coalesce(family, '') AS family, seed, dose_code, avg(gain) AS gain FROM pg WHERE learner = 'fedavg' GROUP BY GROUPING SETS ((population, alpha, seed, dose_code), (population, alpha, family, seed, dose_code))),
 un AS (SELECT {_GROUP}, count(DISTINCT seed) AS units, avg(gain) FILTER (WHERE dose_code = -1) AS nat FROM gl GROUP BY ALL),
 kn AS (SELECT *, ln(1 + dose_code) AS z FROM gl WHERE dose_code <> -1),
 ls AS (SELECT {_GROUP}, sum(gain * z) AS xy, sum(z * z) AS xx, count(*) AS n, sum(gain * gain) AS sq, count(DISTINCT seed) AS measured FROM kn GROUP BY ALL),
 us AS (SELECT {_GROUP}, seed, sum(gain * z) AS uxy, sum(z * z) AS uxx FROM kn GROUP BY ALL),
 er AS (SELECT {_GROUP}, seed, avg((gain - (xy - uxy) / (xx - uxx) * z) ** 2) AS e FROM kn JOIN ls USING ({_GROUP}) JOIN us USING ({_GROUP}, seed) GROUP BY ALL),
 cv AS (SELECT {_GROUP}, avg(e) AS cv FROM er GROUP BY ALL),
 ll AS (SELECT {_GROUP}, sum((gain - xy / xx * z) ** 2) AS rss FROM kn JOIN ls USING ({_GROUP}) GROUP BY ALL),
 ds AS (SELECT {_GROUP}, dose_code, count(*) AS n, sum(gain) AS t FROM kn GROUP BY ALL),
 st AS (SELECT a.population, a.alpha, a.family, a.dose_code AS j, c.dose_code AS k, sum(m.t) / sum(m.n) AS mean FROM ds a JOIN ds c USING ({_GROUP}) JOIN ds m USING ({_GROUP}) WHERE a.dose_code <= c.dose_code AND m.dose_code BETWEEN a.dose_code AND c.dose_code GROUP BY ALL),
 lo AS (SELECT {_GROUP}, ds.dose_code, j, min(mean) AS m FROM st JOIN ds USING ({_GROUP}) WHERE ds.dose_code BETWEEN j AND k GROUP BY ALL),
 iso AS (SELECT {_GROUP}, dose_code, max(m) AS f FROM lo GROUP BY ALL),
 il AS (SELECT {_GROUP}, sum((gain - f) ** 2) AS irss, count(DISTINCT round(f, 10)) AS steps FROM kn JOIN iso USING ({_GROUP}, dose_code) GROUP BY ALL),
 mm AS (SELECT {_GROUP}, dose_code, t / n AS m, lag(t / n) OVER w AS pm, lag(dose_code) OVER w AS pd FROM ds WINDOW w AS (PARTITION BY {_GROUP} ORDER BY dose_code)),
 eq AS (SELECT {_GROUP}, arg_max(m, dose_code) AS top, arg_min(m, dose_code) AS bottom, arg_min(pd + (nat - pm) / (m - pm) * (dose_code - pd), dose_code) FILTER (WHERE m >= nat AND pd IS NOT NULL) AS crossing FROM mm JOIN un USING ({_GROUP}) GROUP BY ALL),
 pf AS (SELECT *, CASE WHEN rss > 1e-12 * sq THEN n * ln(rss / n) + 4 END AS a, CASE WHEN irss > 1e-12 * sq THEN n * ln(irss / n) + 2 * (steps + 1) END AS b FROM un JOIN ls USING ({_GROUP}) JOIN cv USING ({_GROUP}) JOIN ll USING ({_GROUP}) JOIN il USING ({_GROUP}) JOIN eq USING ({_GROUP}) WHERE measured >= 4)"""


def dose_models(spark: SparkSession, sf: str, draws: int) -> DataFrame:
    """Of all families together, family null, and of each."""
    keys = [*_STRATUM, "seed", "dose_code"]
    rows = gains(spark, sf).where("learner = 'fedavg'").select(*keys, "family", "gain")
    both = rows.groupingSets([keys, [*keys, "family"]], *keys, "family").agg(F.avg("gain").alias("gain"))
    return dosefits.dose_model_table(both, [*_STRATUM, "family"], draws, least=4)


@query("g24_model_block")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return dose_models(spark, sf, 2000)


@query(
    "g24_point_fits",
    f"""WITH {_POINT_FITS} SELECT population, alpha, nullif(family, '') AS family, units, round(xy / xx, 6) AS log_slope, round(a, 6) AS aic_log_linear, round(b, 6) AS aic_isotonic, round(a - b, 6) AS isotonic_gain, round(cv, 6) AS cv_log_linear, round(nat, 6) AS natural_gain, round(top, 6) AS top_dose_gain,
 CASE WHEN nat IS NULL THEN NULL WHEN nat <= bottom THEN 0.0 ELSE coalesce(round(crossing, 6), 'Infinity'::DOUBLE) END AS equivalent_dose FROM pf""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["units", "log_slope", "aic_log_linear", "aic_isotonic", "isotonic_gain", "cv_log_linear", "natural_gain", "top_dose_gain", "equivalent_dose"]
    return dose_models(spark, sf, 0).select(*_STRATUM, "family", *columns)


_RESPONSES = f"{Q._FAMILY_CURVES}, rs AS (SELECT population, alpha, family, arg_max(gain, dose) FILTER (WHERE dose IS NOT NULL) AS top_gain FROM curves WHERE learner = 'fedavg' GROUP BY ALL)"


@query(
    "g20_context",
    f"""WITH {_RESPONSES}, {_FAMILY_EFFECTS.removeprefix(T.FAMILIES + ', ').replace('q AS (', 'q2 AS (', 1).replace('FROM q WHERE', 'FROM q2 WHERE').replace('FROM q JOIN', 'FROM q2 q JOIN')}
 SELECT rs.population, rs.alpha, rs.family, round(top_gain, 6) AS top_gain, round(local_recall, 6) AS local_recall, round(full_recall, 6) AS full_recall, round(knowledge_gain, 6) AS main_gain, round(trials, 6) AS novelty FROM rs LEFT JOIN fe ON fe.family = rs.family AND fe.learner = 'fedavg'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    curves = X.dose_family_curves(T.families(spark, sf)).where("learner = 'fedavg'")
    summary = X.response_classes(curves, [*_STRATUM, "family"], 0.1, 10).select(*_STRATUM, "family", "top_gain")
    effects = D.family_effects(seed_effects(spark, sf)).where("learner = 'fedavg'")
    return G.with_family_context(summary, effects, effects.select("family", F.col("trials").alias("value")))


@query("g22_client_curves", f"WITH {_PAIRS}, cl AS (SELECT population, alpha, client, seed, dose_code, avg(gain) AS gain FROM pg WHERE dose_code > 0 GROUP BY ALL) SELECT population, alpha, client, dose_code, {_EFFECTS} FROM cl GROUP BY ALL HAVING count(*) >= 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = [*_STRATUM, "client"]
    levels = G.level_means(gains(spark, sf).where("dose_code > 0"), keys)
    return G.dose_effects(levels, keys, least_seeds=5).select(*keys, "dose_code", "mean", "median", "positive", "seeds")


@query(
    "g25_heterogeneity",
    f"""WITH {_PAIRS}, h AS (SELECT population, alpha, family, seed, avg(gain) AS gain FROM pg WHERE dose_code = 100 GROUP BY ALL), c AS (SELECT population, alpha, family, gain, avg(gain) OVER (PARTITION BY population, alpha) AS g, avg(gain) OVER (PARTITION BY population, alpha, family) AS u FROM h),
 p AS (SELECT population, alpha, family, count(*) AS n, sum((u - g) ** 2) AS b, sum((gain - u) ** 2) AS w FROM c GROUP BY ALL), t AS (SELECT population, alpha, count(*) AS k, sum(n) AS units, sum(b) AS b, sum(w) AS w, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS size FROM p GROUP BY ALL),
 v AS (SELECT *, greatest((b / (k - 1) - w / (units - k)) / size, 0) AS part, w / (units - k) AS inside FROM t)
 SELECT population, alpha, k AS families, units::BIGINT AS units, round(part, 6) AS between, round(inside, 6) AS within, round(part / (part + inside), 6) AS icc, round(b / (b + w), 6) AS eta FROM v""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.level_means(gains(spark, sf).where("dose_code = 100"), [*_STRATUM, "family"])
    return G.heterogeneity(rows, _STRATUM).select(*_STRATUM, "families", "units", "between", "within", "icc", "eta")


# Scores.


_SCORED = f"{Q._POOLS}, pairs AS (SELECT DISTINCT client, family FROM targets), both_ AS (SELECT p.client, p.family, 0 AS y, s.score FROM study s JOIN pairs p ON p.client = s.client WHERE s.role = 'test' AND s.label = 0 UNION ALL SELECT p.client, p.family, 1, s.score FROM study s JOIN pairs p ON p.family = s.family WHERE s.role = 'test' AND s.label = 1)"
_EQUAL = f"""{_SCORED}, k AS (SELECT client, family, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM both_ GROUP BY ALL),
 c AS (SELECT client, family, score, sum(p) OVER w / sum(p) OVER (PARTITION BY client, family) AS y, sum(q) OVER w / sum(q) OVER (PARTITION BY client, family) AS x FROM k WINDOW w AS (PARTITION BY client, family ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 d AS (SELECT *, coalesce(lag(y) OVER v, 0) AS y0, coalesce(lag(x) OVER v, 0) AS x0 FROM c WINDOW v AS (PARTITION BY client, family ORDER BY score DESC)),
 e AS (SELECT client, family, y0 + (y - y0) * (0.05 - x0) / (x - x0) AS r FROM d WHERE x0 <= 0.05 AND x > 0.05)"""


@query(
    "g26_scored_targets",
    f"""WITH {_EQUAL},
 st AS (SELECT family, count(*) FILTER (WHERE score > 0.5) AS hits, count(*) AS trials FROM study WHERE role = 'test' AND label = 1 GROUP BY 1)
 SELECT b.client, b.family, round(threshold, 6) AS threshold, count(*) FILTER (WHERE y = 0) AS benign_test, count(*) FILTER (WHERE y = 1) AS positive_test, round(count(*) FILTER (WHERE y = 1 AND b.score > threshold) / count(*) FILTER (WHERE y = 1), 6) AS calibrated_recall, round(count(*) FILTER (WHERE y = 0 AND b.score > threshold) / count(*) FILTER (WHERE y = 0), 6) AS calibrated_fpr,
 round(any_value(e.r), 6) AS equal_fpr_recall, round(any_value(st.hits) / any_value(st.trials), 6) AS stored_recall, any_value(st.trials) AS stored_trials FROM both_ b JOIN thresholds t ON t.client = b.client AND t.alpha = 0.05 LEFT JOIN st ON st.family = b.family LEFT JOIN e ON e.client = b.client AND e.family = b.family GROUP BY b.client, b.family, threshold""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, thresholds = Q._evaluated(spark, sf)
    targets = T.targets(spark, sf)
    counts = rows.where("role = 'test' and label = 1").groupBy("family").agg(F.count_if(F.col("score") > 0.5).alias("hits"), F.count(F.lit(1)).alias("trials"))
    stored = targets.select("client", "family").distinct().join(counts, "family")
    return G.scored_targets(rows, targets, thresholds, stored, 0.05)


@query(
    "g28_equal_fpr",
    f"""WITH {_EQUAL}
 SELECT b.client, b.family, round(count(*) FILTER (WHERE y = 1 AND b.score > threshold) / count(*) FILTER (WHERE y = 1), 6) AS calibrated_recall, round(any_value(e.r), 6) AS equal_fpr_recall FROM both_ b JOIN thresholds t ON t.client = b.client AND t.alpha = 0.05 LEFT JOIN e ON e.client = b.client AND e.family = b.family GROUP BY b.client, b.family""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, thresholds = Q._evaluated(spark, sf)
    targets = T.targets(spark, sf)
    stored = targets.select("client", "family").distinct().withColumns({"hits": F.lit(0), "trials": F.lit(0)})
    return G.scored_targets(rows, targets, thresholds, stored, 0.05).select("client", "family", "calibrated_recall", "equal_fpr_recall")


# Large families and synthesis.


@query("x13_eligibility", f"WITH {T.LINES}, {T.TARGETS}, m AS (SELECT DISTINCT p_brand AS family FROM part), s AS (SELECT unnest(range(1, 9)) AS seed) SELECT s.seed, m.family, t.client IS NOT NULL AS eligible, t.client FROM s CROSS JOIN m LEFT JOIN targets t ON t.seed = s.seed AND t.family = m.family")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.session import table

    members = table(spark, sf, "part").select(F.col("p_brand").alias("family")).distinct()
    return G.eligibility_grid(spark.range(1, 9).toDF("seed"), members, T.targets(spark, sf)).select("seed", "family", "eligible", "client")


@query(
    "x15_large_summary",
    f"""WITH {Q._LARGE}, t AS (SELECT learner, count(*)::DOUBLE AS families, (count(*) FILTER (WHERE enough))::DOUBLE AS families_enough, min(min_trials)::DOUBLE AS min_support, avg(min_trials) AS mean_support, avg(gain) AS gain_mean, median(gain) AS gain_median, min(gain) AS gain_min, max(gain) AS gain_max, (count(*) FILTER (WHERE gain > 0))::DOUBLE AS gain_positive FROM large GROUP BY 1)
 SELECT learner, measure, round(value, 6) AS value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE (learner)) INTO NAME measure VALUE value)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.large_summary(Q._large(spark, sf), ["learner"])


_SEED_RHO = f"""{Q._GAINS}, v AS (SELECT learner, seed, round(gain, 9) AS y, round(peer, 9) AS x FROM gains), r AS (SELECT learner, seed, {_RANK.format(keys="learner, seed", value="y")} AS a, {_RANK.format(keys="learner, seed", value="x")} AS b FROM v), c AS (SELECT learner, seed, corr(a, b) AS rho FROM r GROUP BY ALL HAVING count(*) > 3)"""


@query("x17_seed_rho", f"WITH {_SEED_RHO}, t AS (SELECT learner, count(rho)::DOUBLE AS seeds_with_rho, min(rho) AS rho_min, median(rho) AS rho_median, max(rho) AS rho_max, (count(*) FILTER (WHERE rho > 0))::DOUBLE AS rho_positive FROM c GROUP BY 1) SELECT learner, measure, round(value, 6) AS value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE (learner)) INTO NAME measure VALUE value)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q._gains(spark, sf).withColumns({"gain": nine("gain"), "peer": nine("peer")})
    return G.seed_rho_summary(rows, ["learner"], "peer", 3)


_STABLE_GRID = "g AS (SELECT DISTINCT seed, family FROM targets), b AS (SELECT family, seed, seed % 3 AS pairs, seed * 10 AS rows FROM g)"


def stability(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up grid: a third of the seeds has no eligible pair."""
    seeds = T.targets(spark, sf).select("seed", "family").distinct()
    grid = seeds.select("family", "seed", (F.col("seed") % 3).alias("eligible_pairs"), (F.col("seed") * 10).alias("eligible_test_rows")).withColumn("eligible", F.col("eligible_pairs") > 0)
    return G.stability_table(grid, seed_effects(spark, sf))


@query("x19_stability_table", f"WITH {Q._SEED_EFFECTS}, {T.TARGETS}, {_STABLE_GRID} SELECT b.family, count(DISTINCT b.seed) AS seed_count, count(*) FILTER (WHERE pairs > 0) AS eligible_seeds, min(pairs) AS min_pairs, round(avg(pairs), 6) AS mean_pairs, max(pairs) AS max_pairs, min(rows) AS min_rows, round(avg(rows), 6) AS mean_rows, round(count(*) FILTER (WHERE pairs > 0) / count(DISTINCT b.seed), 6) AS eligible_share, count(*) FILTER (WHERE pairs > 0) = count(DISTINCT b.seed) AS stable, coalesce(any_value(m.n), 0) AS measured_seeds FROM b LEFT JOIN (SELECT family, count(DISTINCT seed) AS n FROM effects GROUP BY 1) m ON m.family = b.family GROUP BY b.family")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stability(spark, sf)


@query("x20_stability_summary", f"WITH {T.LINES}, {T.TARGETS}, {_STABLE_GRID}, f AS (SELECT family, count(*) AS n, count(*) FILTER (WHERE pairs > 0) / count(*) AS share FROM b GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS families, max(n)::DOUBLE AS seeds, (count(*) FILTER (WHERE share = 1))::DOUBLE AS stable_families, avg(share) AS mean_share, min(share) AS min_share FROM f) SELECT measure, round(value, 6) AS value FROM (UNPIVOT t ON COLUMNS(*) INTO NAME measure VALUE value)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.stability_summary(stability(spark, sf), [])


@query("y03_support_facts", f"WITH {T.EXPOSURE}, {T.TARGETS} SELECT e.experiment, e.seed, e.salt, e.family, t.client, coalesce(sum(rows) FILTER (WHERE e.client <> t.client), 0)::BIGINT AS peer_support, coalesce(sum(rows) FILTER (WHERE e.client = t.client), 0)::BIGINT AS target_support FROM exposure e JOIN targets t ON t.seed = e.seed AND t.family = e.family WHERE dose IS NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return G.support_facts(T.exposure(spark, sf), T.targets(spark, sf))


_SYNTHESIS = f"""{T.FAMILIES}, sq AS (SELECT *, hits::DOUBLE / trials AS r FROM families WHERE alpha = 0.05 AND dose IS NULL AND parameter IS NULL AND trials > 0), sl AS (SELECT seed, population, client, family, max(r) AS local_recall, max(trials) AS trials FROM sq WHERE learner = 'local' GROUP BY ALL),
 sc AS (SELECT sq.seed, sq.population, sq.client, sq.family, learner, sl.trials, local_recall, max(r) FILTER (WHERE condition = 'peer-present') AS peer, max(r) FILTER (WHERE condition = 'family-absent') AS absent, max(r) FILTER (WHERE condition = 'full-exposure') AS full_ FROM sq JOIN sl ON sl.seed = sq.seed AND sl.population = sq.population AND sl.client = sq.client AND sl.family = sq.family WHERE learner <> 'local' GROUP BY ALL)"""


def synthesis(spark: SparkSession, sf: str) -> DataFrame:
    return G.synthesis_cells(T.families(spark, sf), ["fedavg", "central", "fedprox"], 0.05)


@query("y05_synthesis_cells", f"WITH {_SYNTHESIS} SELECT seed, population, client, family, learner, trials, round(local_recall, 6) AS local_recall, round(peer, 6) AS peer_recall, round(absent, 6) AS absent_recall, round(full_, 6) AS full_recall, round(peer - absent, 6) AS gain, round(absent - local_recall, 6) AS pooling, round(peer - local_recall, 6) AS total, round(full_ - local_recall, 6) AS headroom, round(full_ - peer, 6) AS residual FROM sc WHERE peer IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis(spark, sf).drop("experiment", "salt")


_LARGE_FACTS = f"{Q._SEED_EFFECTS}, lf AS (SELECT e.family, avg(knowledge_gain) AS gain, avg(local_recall) AS local_recall, avg(full_recall) AS full_recall, avg(absent_recall) AS absent_recall, avg(peer_recall) AS peer_recall, avg(trials) AS trials, count(*) AS cells, count(DISTINCT seed) AS seeds, any_value(n) AS rows FROM effects e LEFT JOIN (SELECT family, count(*) AS n FROM lines GROUP BY 1) s ON s.family = e.family WHERE learner = 'central' GROUP BY e.family), ft AS (SELECT *, full_recall - local_recall AS headroom, absent_recall - local_recall AS pooling, ln(rows) AS log_rows FROM lf)"


def large(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.lines(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    return G.large_facts(seed_effects(spark, sf).where("learner = 'central'"), rows)


@query("y07_large_facts", f"WITH {_LARGE_FACTS} SELECT family, cells, seeds, rows, {', '.join(f'round({c}, 6) AS {c}' for c in ('gain', 'local_recall', 'full_recall', 'absent_recall', 'peer_recall', 'trials', 'headroom', 'pooling', 'log_rows'))} FROM ft")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return large(spark, sf)


@query(
    "y08_large_taxonomy",
    f"""WITH {_LARGE_FACTS}, z AS (SELECT family, round(gain, 9) AS gain, round(pooling, 9) AS pooling, round(headroom, 9) AS headroom, round(full_recall, 9) AS full_recall FROM ft), l AS (SELECT family, list_filter([CASE WHEN headroom >= 0.12 AND full_recall >= 0.7 AND gain >= 0.12 THEN 'exposure_limited' END, CASE WHEN full_recall < 0.7 THEN 'poor_full' END, CASE WHEN headroom < 0.12 THEN 'low_headroom' END, CASE WHEN pooling >= 0.12 THEN 'pooling_responsive' END, CASE WHEN pooling <= -0.12 AND gain >= 0.12 THEN 'negative_transfer' END], lambda x: x IS NOT NULL) AS held FROM z)
 SELECT family, len(held) AS label_count, array_to_string(held, ' ') AS labels FROM l""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = large(spark, sf).withColumns({c: nine(c) for c in ("gain", "pooling", "headroom", "full_recall")})
    return G.large_taxonomy(table, 0.12, 0.7).select("family", "label_count", "labels")


@query(
    "y09_rank_concordance",
    f"""WITH {_LARGE_FACTS}, {_SYNTHESIS.removeprefix(T.FAMILIES + ', ')}, m AS (SELECT population, sc.family, round(avg(peer - absent), 9) AS x, round(any_value(ft.gain), 9) AS y FROM sc JOIN ft ON ft.family = sc.family WHERE learner = 'fedavg' GROUP BY ALL), r AS (SELECT population, {_RANK.format(keys="population", value="x")} AS a, {_RANK.format(keys="population", value="y")} AS b FROM m) SELECT population, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cells = synthesis(spark, sf).where("learner = 'fedavg'")
    means = cells.groupBy("population", "family").agg(nine(F.avg("gain")).alias("gain"))
    return G.rank_concordance(means, large(spark, sf).withColumn("gain", nine("gain")), ["population"], 999).select("population", "rho", "n")


@query(
    "y10_large_associations",
    f"""WITH {_LARGE_FACTS}, l AS (SELECT predictor, round(gain, 9) AS y, round(CASE predictor WHEN 'local_recall' THEN local_recall WHEN 'headroom' THEN headroom WHEN 'log_rows' THEN log_rows ELSE trials END, 9) AS x FROM ft, (VALUES ('local_recall'), ('headroom'), ('log_rows'), ('trials')) p(predictor)), r AS (SELECT predictor, {_RANK.format(keys="predictor", value="x")} AS a, {_RANK.format(keys="predictor", value="y")} AS b FROM l) SELECT predictor, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    names = ["local_recall", "headroom", "log_rows", "trials"]
    table = large(spark, sf).withColumns({c: nine(c) for c in [*names, "gain"]})
    return G.rank_associations(table, [], "gain", names, 4, 999).select("predictor", "rho", "n")


# Reports.


@query("r04_manifest_check", "SELECT 'part-' || p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 'missing' WHEN p_size % 3 = 1 AND p_size > 20 THEN 'changed' ELSE 'stray' END AS state FROM part WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size > 20) OR p_size % 5 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.session import table

    size, path = F.col("p_size"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("path")
    files, changed = table(spark, sf, "part"), (size % 3 == 1) & (size > 20)
    manifest = files.where(~((size % 3 != 0) & ~changed & (size % 5 == 0))).select(path, F.col("p_name").alias("digest"))
    found = files.where(size % 3 != 0).select(path, F.when(changed, F.lit("other")).otherwise(F.col("p_name")).alias("digest"))
    return G.manifest_check(manifest, found)


_ARM_COLUMNS = "learner, condition, dose, parameter, tuning_value"


@query(
    "r08_convergence",
    f"""WITH {T.SUMMARY}, t AS (SELECT learner, condition, dose, parameter, tuning_value, seed, CASE WHEN seed = 1 THEN NULL ELSE value END AS loss FROM summary WHERE alpha = 0.05 AND metric = 'own-domain-recall'), m AS (SELECT {_ARM_COLUMNS}, avg(value) AS auroc FROM summary GROUP BY ALL),
 c AS (SELECT {_ARM_COLUMNS}, count(*) AS records, arg_min(loss, seed) AS first_loss, arg_max(loss, seed) AS final_loss FROM t GROUP BY ALL)
 SELECT c.learner, c.condition, c.dose, c.parameter, c.tuning_value, records, round(first_loss, 6) AS first_loss, round(final_loss, 6) AS final_loss, 0::BIGINT AS nonfinite_batches, true AS parameters_finite, c.learner = 'central' AS flagged, round(m.auroc, 6) AS auroc
 FROM c JOIN m ON m.learner = c.learner AND m.condition = c.condition AND m.dose IS NOT DISTINCT FROM c.dose AND m.parameter IS NOT DISTINCT FROM c.parameter AND m.tuning_value IS NOT DISTINCT FROM c.tuning_value""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.summary(spark, sf)
    loss = F.when(F.col("seed") > 1, F.col("value"))
    status = F.when(F.col("learner") == "central", F.lit("diverged")).otherwise(F.lit("completed"))
    trace = rows.where("alpha = 0.05 and metric = 'own-domain-recall'").select(*X.ARM, F.col("seed").alias("round"), F.lit(1).alias("epoch"), loss.alias("loss"), F.lit(0).alias("nonfinite_batches"), F.lit(True).alias("parameters_finite"), status.alias("status"))
    return X.convergence(trace, rows.groupBy(*X.ARM).agg(F.avg("value").alias("auroc")), [])


@query("r09_client_audit", f"WITH {T.LINES} SELECT client, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS malware_rows, count(*) FILTER (WHERE label = 0) AS benign_rows, count(DISTINCT package) AS packages, count(DISTINCT family) AS families FROM lines GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.lines(spark, sf)
    return G.client_audit(prep.client_support(rows), rows)


@query("r11_collaboration")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.decompose(T.summary(spark, sf)).where("estimand in ('total_gain', 'pooling_gain', 'knowledge_gain')")
    return stat.paired_effects(rows, ["alpha", "learner", "metric", "estimand"], "value")


@query(
    "r16_fpr_exceptions",
    f"""WITH {_CLIENTS}, b AS (SELECT * FROM clients WHERE population = 'own-domain' AND alpha = 0.05 AND dose IS NULL AND parameter IS NULL AND trials > 0 AND seed % 2 = 0), s AS (SELECT seed, learner, condition, avg(hits::DOUBLE / trials) AS v FROM b GROUP BY ALL),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(abs(v - 0.05), 9) DESC, learner, condition) = 1), w AS (SELECT *, hits::DOUBLE / trials AS f FROM b QUALIFY row_number() OVER (PARTITION BY seed, client ORDER BY hits::DOUBLE / trials DESC, learner, condition) = 1)
 SELECT m.seed, m.learner AS max_learner, m.condition AS max_condition, round(m.v, 6) AS macro_fpr, w.client, w.learner AS client_learner, w.condition AS client_condition, round(w.f, 6) AS client_fpr, w.hits, w.trials FROM m JOIN w ON w.seed = m.seed""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden families stand for benign rows here; runs of even seed stand for those that failed their check."""
    rows = clients(spark, sf).where("population = 'own-domain' and alpha = 0.05 and dose is null and parameter is null").withColumn("population", F.lit("benign"))
    summary = rows.where("trials > 0").groupBy(*G.RUN, "learner", "condition", "alpha").agg(nine(F.avg(F.col("hits") / F.col("trials"))).alias("value")).withColumns({"metric": F.lit("realised-fpr"), "operating_status": F.lit("valid")})
    failed = rows.where("seed % 2 = 0").select(*G.RUN).distinct()
    return G.fpr_exceptions(failed, summary, rows, 0.05).drop("experiment", "salt", "macro_deviation")


@query("r18_selection", f"WITH {_FAMILY_EFFECTS} SELECT family, learner, round(knowledge_gain, 6) AS knowledge_gain, CASE learner WHEN 'fedprox' THEN 0 ELSE 1 END::BIGINT AS place FROM fe WHERE learner IN ('fedprox', 'central')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.family_effects(seed_effects(spark, sf)).select("family", "learner", "knowledge_gain")
    return G.ordered_selection(rows, "learner", ["fedprox", "central"])
