"""Queries of campaigns - planned runs, their arms and states - and of the report's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import decomposition as D
from sievegrid.operators import diagnostics as G
from sievegrid.operators import planning as P
from sievegrid.operators import preparation as prep
from sievegrid.operators import tables as X
from sievegrid.plans import reports as R
from sievegrid.plans import runs
from sievegrid.plans import study as T
from sievegrid.plans.queries import query
from sievegrid.plans.run_queries import ORACLE, QUERIES  # noqa: F401
from sievegrid.session import new_path

SEEDS = tuple(range(1, T.SEEDS + 1))
#: Least counts that some pairs meet at every size of the driver's tables; "strict" needs clients with many rows.
_LEAST = {"target_min_fit": 5, "peer_min_fit": 20, "federation_min_test": 5}
EXPERIMENTS = [
    P.Experiment("controlled", "hide", _LEAST | {"target_min_remaining_fit": 500}, SEEDS, learners=("local", "central", "fedavg"), conditions=("peer-present", "family-absent", "full-exposure")),
    P.Experiment("doses", "hide", _LEAST | {"target_min_remaining_fit": 600}, SEEDS, learners=("fedavg", "fedprox"), doses=(0, 10, 100, None)),
    P.Experiment("strict", "hide", _LEAST | {"target_min_remaining_fit": 7000}, SEEDS[:3], learners=("central",)),
    P.Experiment("natural", "natural", {"max_share": 0.18, "peer_min_fit": 20, "own_test_min": 2}, SEEDS[:4], families=("Brand#12", "Brand#34", "Brand#55"), learners=("local", "fedavg")),
]

_HIDE = ", ".join(f"('{e.name}', {len(e.seeds)}, {e.rule['target_min_remaining_fit']})" for e in EXPERIMENTS if e.exposure == "hide")
_PLAN = f"""{T.LINES}, seeds AS (SELECT unnest(range(1, {T.SEEDS + 1})) AS seed), sized AS (SELECT seed, package, count(*) AS n, {T.draw_sql("seed", "0", "0", "package")} AS d FROM lines, seeds GROUP BY ALL),
 placed AS (SELECT seed, package, coalesce(sum(n) OVER (PARTITION BY seed ORDER BY d, package ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n) OVER (PARTITION BY seed) AS part FROM sized),
 split AS (SELECT seed, client, family, label, CASE WHEN part < 0.6 THEN 'fit' WHEN part < 0.8 THEN 'calibration' ELSE 'test' END AS role FROM lines JOIN placed USING (package)),
 fitted AS (SELECT seed, client, count(*) AS fit_rows FROM split WHERE role = 'fit' GROUP BY ALL),
 cell AS (SELECT seed, client, family, count(*) FILTER (WHERE role = 'fit') AS f, count(*) FILTER (WHERE role = 'test') AS t FROM split WHERE label = 1 GROUP BY ALL),
 both_ AS (SELECT *, sum(f) OVER (PARTITION BY seed, family) AS all_f, sum(t) OVER (PARTITION BY seed, family) AS all_t FROM cell),
 hide(experiment, seeds, least) AS (VALUES {_HIDE}),
 pairs AS (SELECT experiment, b.seed, b.client, family, fit_rows, f, least, f >= 5 AND all_f - f >= 20 AND all_t >= 5 AND fit_rows - f >= least AS eligible, {T.draw_sql("b.seed", "family", "b.client")} AS d FROM both_ b JOIN fitted USING (seed, client) JOIN hide ON b.seed <= seeds WHERE f > 0),
 offers AS (SELECT experiment, seed, family, list({{'client': client, 'f': f, 'least': least}} ORDER BY d, client) AS c FROM pairs WHERE eligible GROUP BY ALL),
 turns AS (SELECT *, row_number() OVER (PARTITION BY experiment, seed ORDER BY family) AS k FROM offers),
 dealt AS (SELECT experiment, seed, 0::BIGINT AS k, list(DISTINCT {{'client': client, 'n': fit_rows}}) AS state, NULL::VARCHAR AS client, NULL::VARCHAR AS family FROM pairs GROUP BY ALL
 UNION ALL SELECT experiment, seed, k, list_transform(state, lambda s: CASE WHEN s.client = pick.client THEN {{'client': s.client, 'n': s.n - pick.f}} ELSE s END), pick.client, family
 FROM (SELECT t.experiment, t.seed, t.k, t.family, d.state, list_filter(t.c, lambda x: list_filter(d.state, lambda s: s.client = x.client)[1].n - x.f >= x.least)[1] AS pick FROM dealt d JOIN turns t ON t.experiment = d.experiment AND t.seed = d.seed AND t.k = d.k + 1)),
 open_ AS (SELECT 'natural' AS experiment, g.seed, g.client, g.family FROM (SELECT c.seed, c.client, a.family, a.total FROM fitted c JOIN (SELECT seed, family, sum(f) AS total FROM cell GROUP BY ALL HAVING sum(f) > 0) a ON a.seed = c.seed) g LEFT JOIN cell b ON b.seed = g.seed AND b.client = g.client AND b.family = g.family
 WHERE g.seed <= 4 AND g.family IN ('Brand#12', 'Brand#34', 'Brand#55') AND coalesce(f, 0)::DOUBLE / total <= 0.18 AND total - coalesce(f, 0) >= 20 AND coalesce(t, 0) >= 2),
 assigned AS (SELECT experiment, seed, client, family FROM dealt WHERE client IS NOT NULL UNION ALL SELECT * FROM open_),
 run(experiment, seed) AS (SELECT experiment, seed FROM hide JOIN seeds ON seed <= hide.seeds UNION ALL SELECT 'natural', seed FROM seeds WHERE seed <= 4),
 matrix AS (SELECT r.experiment, r.seed, 0::BIGINT AS salt, count(family) AS targets, CASE WHEN count(family) > 0 THEN 'completed' ELSE 'infeasible' END AS status, CASE WHEN count(family) = 0 THEN '{P.INFEASIBLE}' END AS reason FROM run r LEFT JOIN assigned a ON a.experiment = r.experiment AND a.seed = r.seed GROUP BY ALL)"""


def plan(spark: SparkSession, sf: str) -> P.Plan:
    rows = T.lines(spark, sf).withColumn("reason", F.when(F.col("label") == 1, F.lit("eligible")))
    return P.plan_runs(rows, "package", EXPERIMENTS)


@query("e01_assignments", f"WITH RECURSIVE {_PLAN} SELECT experiment, seed, 0::BIGINT AS salt, client, family FROM assigned")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of 19 runs of four experiments: families dealt to clients, or all eligible pairs."""
    return plan(spark, sf).assignments


@query("e04_run_matrix", f"WITH RECURSIVE {_PLAN} SELECT * FROM matrix")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf).matrix


@query("e02_planned_targets", f"WITH RECURSIVE {_PLAN} SELECT m.status, client, family FROM assigned a JOIN matrix m USING (experiment, seed) WHERE experiment = 'doses' AND seed = 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    status, targets = P.planned_targets(plan(spark, sf), "doses", 2)
    return targets.select(F.lit(status).alias("status"), "client", "family")


@query("e03_campaign_status", f"WITH RECURSIVE {_PLAN}, s AS (SELECT experiment, CASE WHEN status = 'infeasible' THEN 'infeasible' WHEN seed % 5 = 0 THEN 'missing' WHEN seed % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM matrix) SELECT experiment, count(*) AS planned, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("completed", "failed", "infeasible", "missing")) + " FROM s GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The planned runs; those of every fifth seed have not run, those of every fourth failed."""
    matrix = plan(spark, sf).matrix
    ran = matrix.where("status = 'infeasible' or seed % 5 <> 0").withColumn("status", F.when((F.col("status") == "completed") & (F.col("seed") % 4 == 0), F.lit("failed")).otherwise(F.col("status")))
    return X.campaign_status(ran.select(*P.RUN, "status"), matrix.select(*P.RUN), ["completed", "failed", "infeasible", "missing"])


@query("r03_promotion_blocks", f"WITH RECURSIVE {_PLAN}, b AS (SELECT experiment, seed, salt, CASE WHEN seed % 5 = 0 THEN 'missing' WHEN seed % 4 = 0 THEN 'failed' WHEN targets % 2 = 1 THEN 'stale' END AS block FROM matrix WHERE status = 'completed') SELECT * FROM b WHERE block IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps a plan's feasible runs from being published; runs with an odd number of targets are of an older revision."""
    planned = plan(spark, sf).matrix.where("status = 'completed'")
    status = F.when(F.col("seed") % 4 == 0, F.lit("failed")).otherwise(F.lit("completed"))
    ran = planned.where("seed % 5 <> 0").select(*P.RUN, status.alias("status"), F.when(F.col("targets") % 2 == 1, F.lit("old")).otherwise(F.lit("new")).alias("revision"))
    return G.promotion_blocks(ran, planned, "new")


_CONDITIONS = "(VALUES ('controlled', 'local', 'peer-present', NULL), " + ", ".join(f"('controlled', '{x}', '{c}', NULL)" for x in ("central", "fedavg") for c in ("peer-present", "family-absent", "full-exposure")) + ", " + ", ".join(f"('doses', '{x}', 'peer-present', {d})" for x in ("fedavg", "fedprox") for d in ("0", "10", "100", "NULL")) + ", ('strict', 'central', 'peer-present', NULL), ('natural', 'local', 'peer-present', NULL), ('natural', 'fedavg', 'peer-present', NULL)) c(experiment, learner, condition, dose)"


@query("e24_settings", f"WITH RECURSIVE {_PLAN} SELECT experiment, condition, dose::BIGINT AS dose, count(*) AS arms, sum(targets)::BIGINT AS targets FROM matrix JOIN {_CONDITIONS} USING (experiment) WHERE status = 'completed' AND learner <> 'local' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Shared arms and their targets by experiment and setting."""
    found = plan(spark, sf)
    arms = P.planned_arms(found, EXPERIMENTS).where("learner <> 'local'").join(found.matrix.select(*P.RUN, "targets"), P.RUN)
    return arms.groupBy("experiment", "condition", "dose").agg(F.count(F.lit(1)).alias("arms"), F.sum("targets").alias("targets"))


@query("e25_planned_arms", f"WITH RECURSIVE {_PLAN} SELECT experiment, seed, 0::BIGINT AS salt, count(*) AS arms FROM matrix JOIN {_CONDITIONS} USING (experiment) WHERE status = 'completed' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.planned_arms(plan(spark, sf), EXPERIMENTS).groupBy(*P.RUN).agg(F.count(F.lit(1)).alias("arms"))


# The report's tables.

PRIMARY = 0.05


def _arm_comparison(summary: DataFrame) -> DataFrame:
    rows = summary.where(f"alpha = {PRIMARY} and dose is null and parameter is null")
    return rows.groupBy("learner", "condition").pivot("metric", ["own-domain-recall", "federation-wide-recall"]).agg(F.avg("value"))


def _dose_response(families: DataFrame, exposure: DataFrame, targets: DataFrame) -> DataFrame:
    at_target = families.where("learner = 'fedavg'").join(targets.select("family", "client").distinct(), ["family", "client"])
    return D.dose_levels(D.dose_curve(D.dose_recall(at_target, PRIMARY), D.effective_peer_dose(exposure, targets)), 50).drop("dose")


def _summary(families: DataFrame) -> DataFrame:
    keys = ["experiment", "seed", "salt", "learner", "condition", "dose", "parameter", "tuning_value", "alpha", "metric"]
    return families.withColumn("metric", F.concat("population", F.lit("-recall"))).groupBy(*keys).agg(F.avg(F.col("hits") / F.col("trials")).alias("value"))


def _client_counts(families: DataFrame) -> DataFrame:
    arm = ["experiment", "seed", "salt", "learner", "condition", "dose", "parameter", "tuning_value"]
    return families.groupBy(*arm, "client", "alpha", "population").agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))


_CLIENT_RUN = ["seed", "alpha", "population"]
#: The report: its steps, and beside each table its key columns and the query whose SQL it has.
STEPS = [
    R.Step("summary", ("families",), _summary, table=False),
    R.Step("client-counts", ("families",), _client_counts, table=False),
    R.Step("seed-effects", ("families",), lambda f: D.family_seed_effects(f, PRIMARY), table=False, settings={"alpha": PRIMARY}),
    R.Step("family-effects", ("seed-effects",), D.family_effects, table=False),
    R.Step("hidden-cells", ("families",), lambda f: D.hidden_cells(f, PRIMARY), table=False, settings={"alpha": PRIMARY}),
    R.Step("client-audit", ("lines",), lambda rows: G.client_audit(prep.client_support(rows), rows)),
    R.Step("arm-comparison", ("summary",), _arm_comparison, settings={"alpha": PRIMARY}),
    R.Step("decomposition", ("summary",), D.decompose),
    R.Step("dose-response", ("families", "exposure", "targets"), _dose_response, settings={"alpha": PRIMARY, "peers": 50}),
    R.Step("family-effects-table", ("family-effects",), lambda e: e),
    R.Step("patterns", ("family-effects",), lambda e: G.mechanism_patterns(e, "fedavg", ["central", "fedprox"])),
    R.Step("family-client", ("hidden-cells",), G.family_client_gains),
    R.Step("transfer", ("hidden-cells",), D.transfer_scopes),
    R.Step("client-gains", ("client-counts",), lambda c: G.client_gains(c, _CLIENT_RUN)),
    R.Step("anchored-worst", ("client-counts",), lambda c: G.anchored_worst(c, _CLIENT_RUN)),
]
TABLES = {
    "client-audit": ("r09_client_audit", ["client"]),
    "arm-comparison": ("r10_arm_comparison", ["learner", "condition"]),
    "decomposition": ("a2_decompose", ["experiment", "seed", "salt", "alpha", "metric", "learner", "estimand"]),
    "dose-response": ("a9_levels", ["learner", "dose_level"]),
    "family-effects-table": ("a4_family_effects", ["experiment", "family", "learner"]),
    "patterns": ("c08_patterns", ["experiment", "family"]),
    "family-client": ("c19_family_client", ["client", "family"]),
    "transfer": ("c23_transfer", ["population", "client", "family"]),
    "client-gains": ("c11_client_gains", ["alpha", "population", "client", "learner"]),
    "anchored-worst": ("c01_anchored_worst", ["seed", "alpha", "population", "client", "learner", "estimand"]),
}
#: Columns that a table's query has beside its keys.
_MEASURES = {
    "client-audit": ["rows", "malware_rows", "benign_rows", "packages", "families"],
    "arm-comparison": ["own-domain-recall", "federation-wide-recall"],
    "decomposition": ["value"],
    "dose-response": ["effective_dose", "recall", "recall_std", "knowledge_gain", "observations_met", "observations", "meets_dose_criterion"],
    "family-effects-table": ["local_recall", "absent_recall", "peer_recall", "full_recall", "knowledge_gain", "trials", "seeds"],
    "patterns": ["trials", "seeds", "local_recall", "absent_recall", "peer_recall", "knowledge_gain", "pooling_gain", "total_gain", "central_full_recall", "fedprox_full_recall"],
    "family-client": ["local_recall", "absent_recall", "peer_recall", "hidden_trials", "gain", "seeds", "positive"],
    "transfer": ["pooling_gain", "knowledge_gain", "repair", "new_capability", "harm", "hurt", "observations"],
    "client-gains": ["local_recall", "absent_recall", "peer_recall", "full_recall", "total_gain", "pooling_gain", "knowledge_gain", "seeds", "positive"],
    "anchored-worst": ["difference"],
}


def _long_sql(name: str) -> str:
    of, keys = TABLES[name]
    entity = ", ".join(f"coalesce({k}::VARCHAR, '-')" for k in keys)
    measures = _MEASURES[name]
    return f"SELECT '{name}' AS name, concat_ws('|', {entity}) AS entity, unnest({measures}) AS measure, unnest([" + ", ".join(f'"{m}"::DOUBLE' for m in measures) + f"]) AS value FROM ({ORACLE[of]})"


def report(spark: SparkSession, sf: str, root: str, wanted: list[str] | None = None) -> R.Made:
    """The report over the driver's tables, all of which have one digest: the folder they are read from."""
    sources = {"lines": T.lines(spark, sf), "families": T.families(spark, sf), "exposure": T.exposure(spark, sf), "targets": T.targets(spark, sf)}
    return R.build_tables(spark, root, STEPS, sources, {n: f"{sf}/{n}" for n in sources}, wanted)


@query("r14_report_tables", " UNION ALL ".join(_long_sql(n) for n in TABLES))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Ten tables of the report, all cells of all of them."""
    made = report(spark, sf, new_path(spark, "report"))
    out = None
    for name, (_, keys) in TABLES.items():
        cells = R.long_cells(name, made.tables[name].select(*keys, *_MEASURES[name]), keys)
        out = cells if out is None else out.unionByName(cells)
    return out


@query("r02_campaign_evidence", f"WITH RECURSIVE {_PLAN}, n AS (SELECT experiment, seed, count(*) AS rows FROM assigned GROUP BY ALL) SELECT experiment, seed, 0::BIGINT AS salt, CASE WHEN status = 'infeasible' THEN 'infeasible' WHEN seed % 5 = 0 THEN 'missing' WHEN seed % 3 = 0 THEN 'stale' ELSE 'completed' END AS status, CASE WHEN seed % 5 <> 0 AND seed % 3 <> 0 THEN rows END AS rows FROM matrix LEFT JOIN n USING (experiment, seed)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A plan's runs recorded and collected again: every fifth seed has not run, every third ran under other settings."""
    found = plan(spark, sf)
    digest = P.settings_digest("main", EXPERIMENTS)
    matrix = found.matrix.withColumn("mode", F.lit("main"))
    root = new_path(spark, "campaign")
    ran = matrix.where("status = 'infeasible' or seed % 5 <> 0")
    stale = (F.col("seed") % 3 == 0) & (F.col("status") == "completed")
    statuses = ran.select(*runs.KEY, "status", "reason", F.when(stale, F.lit("older")).otherwise(F.lit(digest)).alias("digest"))
    kept = found.assignments.where("seed % 5 <> 0").withColumn("mode", F.lit("main"))
    runs.write_runs(root, {"targets": kept}, statuses)
    evidence = runs.collect_evidence(spark, root, matrix.select(*runs.KEY, F.lit(digest).alias("digest")), ["targets"])
    counted = evidence.tables["targets"].groupBy(*P.RUN).agg(F.count(F.lit(1)).alias("rows"))
    return evidence.index.select(*P.RUN, "status").join(counted, P.RUN, "left")
