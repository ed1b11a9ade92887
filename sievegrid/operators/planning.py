"""Planning of whole runs: which targets each experiment has under each seed, all splits and runs in one plan.

A run is (experiment, seed, salt). Its partition is a split of all groups by (seed, salt, attempt), shared by the experiments that use
it: groups are placed once for all partitions, and rows are counted by group before they meet the partitions. Hiding experiments deal
families to clients greedily, a task a run; natural ones take every eligible pair. A run without a target is infeasible.

Nulls: rows without a group are placed as a group of their own, rows without a client or family are in no pair. A family that an
experiment names twice has its first place. An experiment without seeds has no run; of empty tables all runs are infeasible.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions.primitives import draw, null_safe_join
from sievegrid.operators import splits
from sievegrid.session import stage, unstage

RUN = ["experiment", "seed", "salt"]
PARTITION = ["seed", "salt", "attempt"]
INFEASIBLE = "no-eligible-targets"


@dataclass(frozen=True)
class Experiment:
    """exposure: "hide" (rule of ``controlled_pairs``) or "natural" (max_share, peer_min_fit, own_test_min).

    families: in the order in which they are dealt; None takes all, by name. doses: a sweep in place of conditions, None in it is all
    that is available. attempts: the attempt of each seed's split, 0 where not given.
    """

    name: str
    exposure: str
    rule: dict[str, float]
    seeds: tuple[int, ...]
    salts: tuple[int, ...] = (0,)
    families: tuple[str, ...] | None = None
    learners: tuple[str, ...] = ("local",)
    conditions: tuple[str, ...] = ("peer-present",)
    doses: tuple[int | None, ...] | None = None
    attempts: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        if self.exposure not in ("hide", "natural"):
            raise ValueError(f"{self.name}: no exposure {self.exposure}")

    def runs(self) -> list[tuple]:
        tried = dict(self.attempts)
        return [(self.name, seed, salt, tried.get(seed, 0)) for seed in dict.fromkeys(self.seeds) for salt in dict.fromkeys(self.salts)]


@dataclass(frozen=True)
class Plan:
    matrix: DataFrame
    assignments: DataFrame


def partition_roles(rows: DataFrame, group: str, partitions: DataFrame, fit: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """(PARTITION, group, role) of every partition; ``partitions`` has a row a partition."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    tried = sizes.crossJoin(F.broadcast(partitions))
    order = draw(*[F.col(k) for k in PARTITION], F.col(group))
    placed = splits.running_before(tried, order, group, F.col("n"), "before", PARTITION).crossJoin(F.broadcast(total))  # one row
    part = F.col("before") / F.col("total")
    role = F.when(part < fit, F.lit("fit")).when(part < fit + calibration, F.lit("calibration")).otherwise(F.lit("test"))
    return placed.select(*PARTITION, group, role.alias("role"))


def partition_counts(rows: DataFrame, group: str, partitions: DataFrame) -> DataFrame:
    """(PARTITION, client, family, role, rows, all_rows): eligible and all rows; rows: (group, client, family, reason)."""
    cells = rows.groupBy(group, "client", "family").agg(F.count_if(F.col("reason") == "eligible").alias("rows"), F.count(F.lit(1)).alias("all_rows"))
    split = null_safe_join(cells, partition_roles(rows, group, partitions), [group])
    return split.groupBy(*PARTITION, "client", "family", "role").agg(F.sum("rows").alias("rows"), F.sum("all_rows").alias("all_rows"))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """One run's targets: each family in turn goes to its first eligible client that keeps enough fit rows."""
    remaining = dict(zip(rows["client"], rows["fit_rows"], strict=True))
    chosen = []
    for _, offers in rows[rows["eligible"]].sort_values(["place", "family", "order", "client"]).groupby(["place", "family"], sort=False):
        for offer in offers.itertuples():
            if remaining[offer.client] - offer.target_fit_rows >= offer.least:
                remaining[offer.client] -= offer.target_fit_rows
                chosen.append((offer.experiment, offer.seed, offer.salt, offer.client, offer.family))
                break
    return pd.DataFrame(chosen, columns=[*RUN, "client", "family"])


def _members(pairs: DataFrame, families: tuple[str, ...] | None) -> DataFrame:
    """Pairs of the experiment's families, with the place in which each is dealt."""
    if families is None:
        return pairs.withColumn("place", F.lit(0))
    listed = [(f, i) for i, f in enumerate(dict.fromkeys(families))]
    return pairs.join(F.broadcast(pairs.sparkSession.createDataFrame(listed, "family string, place int")), "family")  # a row a listed family


def _run_rows(spark: SparkSession, experiments: list[Experiment]) -> DataFrame:
    return spark.createDataFrame([r for e in experiments for r in e.runs()], "experiment string, seed long, salt long, attempt long")


def plan_runs(rows: DataFrame, group: str, experiments: list[Experiment]) -> Plan:
    """The run matrix (RUN, targets, status, reason) and the assignments (RUN, client, family) of all experiments.

    rows: (group, client, family, reason).
    """
    spark = rows.sparkSession
    names = [e.name for e in experiments]
    if len(set(names)) < len(names):
        raise ValueError(f"experiments named twice: {sorted({n for n in names if names.count(n) > 1})}")
    runs = _run_rows(spark, experiments)
    counts = stage(partition_counts(rows, group, runs.select(*PARTITION).distinct()), "partition-counts")
    fit_rows = counts.where("role = 'fit' and client is not null").groupBy(*PARTITION, "client").agg(F.sum("all_rows").alias("fit_rows"))
    eligible = counts.where("rows > 0 and client is not null and family is not null")
    hidden, natural = [], []
    for e in experiments:
        own = F.broadcast(runs.where(F.col("experiment") == e.name))  # a row a run
        if e.exposure == "hide":
            pairs = _members(splits.controlled_pairs(eligible, fit_rows, e.rule, tuple(PARTITION)), e.families).join(own, PARTITION)
            hidden.append(pairs.select(*RUN, "client", "family", "place", "fit_rows", "target_fit_rows", "eligible", F.lit(e.rule["target_min_remaining_fit"]).cast("long").alias("least"), draw(F.col("seed"), F.col("family"), F.col("client")).alias("order")))
        else:
            pairs = splits.natural_pairs(eligible, fit_rows, keys=tuple(PARTITION), **e.rule).where("eligible")
            natural.append(_members(pairs, e.families).join(own, PARTITION).select(*RUN, "client", "family"))
    kind = "experiment string, seed long, salt long, client string, family string"
    dealt = [reduce(DataFrame.unionByName, hidden).groupBy(*RUN).applyInPandas(_greedy, kind)] if hidden else []
    none = spark.createDataFrame([], kind)
    assignments = stage(reduce(DataFrame.unionByName, [*dealt, *natural], none), "assignments")
    unstage(counts)
    targets = assignments.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    matrix = runs.join(targets, RUN, "left").select(*RUN, n.alias("targets"), F.when(n > 0, F.lit("completed")).otherwise(F.lit("infeasible")).alias("status"), F.when(n == 0, F.lit(INFEASIBLE)).alias("reason"))
    return Plan(matrix, assignments)


def settings(experiment: Experiment) -> list[tuple[str, int | None]]:
    """(condition, dose) of an experiment's shared learners: the dose sweep if it has one, its conditions otherwise."""
    if experiment.doses is not None:
        return [("peer-present", dose) for dose in dict.fromkeys(experiment.doses)]
    return [(c, None) for c in dict.fromkeys(experiment.conditions)]


def planned_arms(plan: Plan, experiments: list[Experiment]) -> DataFrame:
    """(RUN, learner, condition, dose) of the feasible runs: the local learner once, every other in each setting."""
    arms = []
    for e in experiments:
        for learner in dict.fromkeys(e.learners):
            arms += [(e.name, learner, "peer-present", None)] if learner == "local" else [(e.name, learner, c, d) for c, d in settings(e)]
    table = plan.matrix.sparkSession.createDataFrame(arms, "experiment string, learner string, condition string, dose long")
    return plan.matrix.where("status = 'completed'").select(*RUN).join(F.broadcast(table), "experiment")  # a row an arm


def planned_targets(plan: Plan, experiment: str, seed: int, salt: int = 0) -> tuple[str, DataFrame]:
    """(status, (client, family)) of one run, which the matrix must hold exactly once."""
    this = (F.col("experiment") == experiment) & (F.col("seed") == seed) & (F.col("salt") == salt)
    found = plan.matrix.where(this).select("status").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{experiment}, seed {seed}, salt {salt}: {'planned twice' if found else 'not planned'}")
    return found[0]["status"], plan.assignments.where(this).select("client", "family")


def settings_digest(mode: str, experiments: list[Experiment]) -> str:
    """What a plan is kept under: the mode and the experiments, in any order."""
    told = sorted((asdict(e) for e in experiments), key=lambda e: e["name"])
    return hashlib.sha256(json.dumps([mode, told], sort_keys=True).encode()).hexdigest()
