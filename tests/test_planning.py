"""Plans of whole runs against the single-run operators, and their defined cases."""

import random

import pytest

from sievegrid.operators import planning as P
from sievegrid.operators import splits as S

RULE = {"target_min_fit": 2, "peer_min_fit": 4, "federation_min_test": 2, "target_min_remaining_fit": 60}
NATURAL = {"max_share": 0.3, "peer_min_fit": 4, "own_test_min": 1}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for package in range(160):
        client, family = rng.choice("abcd"), rng.choice(["x", "y", "z", "w"])
        made += [(f"p{package}", client, family, rng.choice(["eligible", "eligible", "other", None])) for _ in range(rng.randint(1, 6))]
    return spark.createDataFrame(made, "package string, client string, family string, reason string")


def single(rows, seed, salt, attempt):
    split = rows.join(S.assign_roles(rows, "package", seed, salt, attempt), "package")
    return S.role_counts(split), S.client_fit_rows(split)


def found(df):
    return {(r.experiment, r.seed, r.salt, r.client, r.family) for r in df.collect()}


def test_runs_of_one_plan_are_those_of_single_splits(spark, rows):
    order = ("z", "x", "w", "y")
    experiments = [
        P.Experiment("hide", "hide", RULE, (1, 2, 3), (0, 5), families=order, attempts=((2, 7),)),
        P.Experiment("open", "natural", NATURAL, (1, 3), families=("x", "w", "x", "absent")),
    ]
    plan = P.plan_runs(rows, "package", experiments)
    want = set()
    for name, seed, salt, attempt in experiments[0].runs():
        pairs = S.controlled_pairs(*single(rows, seed, salt, attempt), RULE)
        want |= {(name, seed, salt, c, f) for c, f in S.assign_targets(pairs, list(order), seed, 60)}
    for name, seed, salt, attempt in experiments[1].runs():
        pairs = S.natural_pairs(*single(rows, seed, salt, attempt), **NATURAL).where("eligible and family in ('x', 'w')")
        want |= {(name, seed, salt, r.client, r.family) for r in pairs.collect()}
    got = found(plan.assignments)
    assert got == want and len(got) == plan.assignments.count()
    assert {w[0] for w in want} == {"hide", "open"}
    assert {a for _, s, _, a in experiments[0].runs() if s == 2} == {7}
    matrix = {(r.experiment, r.seed, r.salt): (r.targets, r.status, r.reason) for r in plan.matrix.collect()}
    assert set(matrix) == {r[:3] for e in experiments for r in e.runs()}
    for run, (n, status, reason) in matrix.items():
        assert n == sum(w[:3] == run for w in want)
        assert (status, reason) == (("completed", None) if n else ("infeasible", P.INFEASIBLE))


def test_a_client_is_left_enough_rows(spark):
    made = [(f"{c}{f}{i}", c, f, "eligible") for c in "ab" for f in "uvxyz" for i in range(60)]
    rows = spark.createDataFrame(made, "package string, client string, family string, reason string")
    least = RULE | {"target_min_remaining_fit": 100}
    plan = P.plan_runs(rows, "package", [P.Experiment("e", "hide", least, (1,))])
    pairs = {(r.client, r.family): r for r in S.controlled_pairs(*single(rows, 1, 0, 0), least).collect()}
    taken = {}
    for r in plan.assignments.collect():
        taken[r.client] = taken.get(r.client, 0) + pairs[r.client, r.family].target_fit_rows
    fit = {c: pairs[c, "u"].fit_rows for c in "ab"}
    assert taken and all(fit[c] - n >= 100 for c, n in taken.items())
    given = {r.family for r in plan.assignments.collect()}
    assert len(given) == plan.assignments.count() < 5


def test_nulls_extra_columns_and_empty_tables(spark, rows):
    none = spark.createDataFrame([(None, None, None, None), ("q", None, "x", "eligible"), (None, "a", None, "eligible")], rows.schema)
    experiments = [P.Experiment("hide", "hide", RULE, (1,)), P.Experiment("open", "natural", NATURAL, (1,)), P.Experiment("never", "natural", NATURAL, ())]
    plan = P.plan_runs(rows.unionByName(none).selectExpr("*", "1 as n", "2 as place", "3 as order", "4 as seed", "5 as rows"), "package", experiments)
    assert all(x is not None for r in found(plan.assignments) for x in r)
    assert {r.experiment for r in plan.matrix.collect()} == {"hide", "open"}
    empty = P.plan_runs(rows.limit(0), "package", experiments)
    assert empty.assignments.count() == 0
    assert {r.status for r in empty.matrix.collect()} == {"infeasible"}
    assert P.planned_arms(empty, experiments).count() == 0


def test_arms_and_settings(spark, rows):
    swept = P.Experiment("swept", "hide", RULE, (1,), learners=("local", "fed", "fed"), doses=(0, 5, None, 5))
    plain = P.Experiment("plain", "hide", RULE, (1,), learners=("local", "fed", "mix"), conditions=("peer-present", "family-absent"))
    assert P.settings(swept) == [("peer-present", 0), ("peer-present", 5), ("peer-present", None)]
    arms = P.planned_arms(P.plan_runs(rows, "package", [swept, plain]), [swept, plain]).collect()
    assert sorted((r.experiment, r.learner) for r in arms) == [("plain", "fed")] * 2 + [("plain", "local")] + [("plain", "mix")] * 2 + [("swept", "fed")] * 3 + [("swept", "local")]


def test_errors_and_lookups(spark, rows):
    with pytest.raises(ValueError, match="no exposure"):
        P.Experiment("e", "shown", RULE, (1,))
    e = P.Experiment("e", "hide", RULE, (1, 1), (0, 0))
    with pytest.raises(ValueError, match="named twice"):
        P.plan_runs(rows, "package", [e, e])
    plan = P.plan_runs(rows, "package", [e])
    assert plan.matrix.count() == 1
    status, targets = P.planned_targets(plan, "e", 1)
    assert status == "completed" and targets.count() == plan.assignments.count() > 0
    with pytest.raises(ValueError, match="not planned"):
        P.planned_targets(plan, "e", 2)
    with pytest.raises(ValueError, match="planned twice"):
        P.planned_targets(P.Plan(plan.matrix.union(plan.matrix), plan.assignments), "e", 1)


def test_digest_goes_by_settings_not_order():
    a, b = P.Experiment("a", "hide", RULE, (1,)), P.Experiment("b", "hide", RULE, (2,))
    assert P.settings_digest("main", [a, b]) == P.settings_digest("main", [b, a])
    assert len({P.settings_digest("main", [a]), P.settings_digest("main", [b]), P.settings_digest("smoke", [a]), P.settings_digest("main", [a, b])}) == 4


def test_conditions_of_exposure_checks_read_rows_staged_once(spark, sf):
    from sievegrid.plans import surface_queries as Q

    plan = Q._conditions(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "lineitem" not in plan and "l_orderkey" not in plan
