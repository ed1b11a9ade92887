"""Runs: fits with stops, rounds that resume, scoring of all arms in one scan, counts - each against a plain version."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import evaluation as E
from sievegrid.operators import execution as R
from sievegrid.operators import learners as L
from sievegrid.session import new_path

CLIENTS = ["a", "b", "c"]
T = L.Training(width=3, hidden=(4,), epochs=2, batch=16, rate=0.02, seed=5)


def study(n=900, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.normal(0, 1, 3)
        label = int(x[0] + 0.7 * rng.normal() > 0)
        family = f"f{rng.integers(4)}" if label else None
        out.append((i, CLIENTS[i % 3], str(rng.choice(["fit", "calibration", "test"], p=[0.5, 0.25, 0.25])), label, family, str(int(x[1] * 2)), [float(v) for v in x]))
    return out


SCHEMA = "row long, client string, role string, label long, family string, feature string, features array<double>"
TARGETS = [("a", "f0"), ("b", "f1"), ("b", "f0")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(study(), SCHEMA)


@pytest.fixture(scope="module")
def hidden(spark):
    return spark.createDataFrame(TARGETS, "client string, family string")


def plain_parts(rows, data="d"):
    """(features, labels) by client in the order that a fit meets them."""
    out = {}
    for c in CLIENTS:
        own = sorted((float(r[3]), r[6]) for r in rows if r[1] == c and r[2] == "fit")
        out[c] = np.array([x for _, x in own]), np.array([y for y, _ in own])
    return out


def test_stops_of_a_fit_are_fits_of_fewer_epochs(spark, rows):
    fit = rows.where("role = 'fit'").select("client", "features", "label")
    parts = L.parts_of(fit, ["client"], T).withColumns({"start": F.lit(None).cast("array<double>"), "at": F.array(F.lit(1), F.lit(3)), "proximal": F.lit(0.1), "seed": F.lit(9)})
    got = {(r.client, r.epochs): r for r in L.fit_many(parts, ["client"], T).collect()}
    assert set(got) == {(c, e) for c in CLIENTS for e in (1, 3)}
    for c, (x, y) in plain_parts(study()).items():
        for epochs in (1, 3):
            state, loss = L.fit(L.initial(T), x, y, replace(T, epochs=epochs, proximal=0.1, seed=9))
            assert np.allclose(got[c, epochs].weights, L.flat(state)) and got[c, epochs].rows == len(y) and np.isclose(got[c, epochs].loss, loss)


def test_a_standard_holder_is_one_plain_fit_and_parts_come_near(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (6000, 6))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 6000) > 0).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(b), "h") for a, b in zip(x, y, strict=True)], "features array<double>, label long, client string")
    t = L.Training(width=6, hidden=(16,), epochs=4, seed=2)
    order = sorted(range(6000), key=lambda i: (y[i], list(x[i])))
    state, _ = L.fit(L.initial(t), x[order], y[order].astype(float), t)
    assert np.allclose(L.fit_by(rows, ["client"], t).first()["weights"], L.flat(state))
    fresh = rng.normal(0, 1, (4000, 6))
    truth = fresh[:, 0] - fresh[:, 1] > 0

    def area(weights):
        z = L.logits(L.unflat(np.array(weights), t), fresh)
        rank = np.argsort(np.argsort(z)) + 1
        return (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())

    parts = L.fit_by(rows, ["client"], replace(t, part=1500)).first()["weights"]
    assert area(L.flat(state)) > 0.99 and area(parts) > 0.97  # averaging four parts once costs some 0.02


@pytest.mark.parametrize("values,trimmed,median", [([3.0], 3.0, 3.0), ([1.0, 4.0], 2.5, 1.0), ([1.0, 2.0, 9.0], 2.0, 2.0)])
def test_robust_states_of_few_holders(spark, values, trimmed, median):
    states = spark.createDataFrame([(i, 1, 0, v) for i, v in enumerate(values)], "holder int, rows long, pos int, weight double")
    assert L.robust_states(states, [], "trimmed").first()["weight"] == trimmed
    assert L.robust_states(states, [], "median").first()["weight"] == median


ARMS = [
    R.Arm("local", "local", "d"),
    R.Arm("local5", "local", "d", epochs=5),
    R.Arm("central", "central", "d"),
    R.Arm("fed", "federated", "d"),
    R.Arm("prox", "federated", "d", proximal=1.0),
    R.Arm("median", "federated", "d", rule="median"),
    R.Arm("tuned", "finetune", "d", epochs=1, base="fed"),
    R.Arm("mixed", "blend", base="local", other="fed", weight=0.25),
]


def plain_federated(parts, rounds, proximal=0.0, rule="mean"):
    shared = L.flat(L.initial(T))
    for r in range(rounds):
        t = replace(T, seed=L.derive_seed(T.seed, r), proximal=proximal)
        states = [(len(y), L.flat(L.fit(L.unflat(shared, T), x, y, t)[0])) for x, y in parts.values()]
        if rule == "mean":
            shared = sum(n * s for n, s in states) / sum(n for n, _ in states)
        else:
            shared = np.sort(np.array([s for _, s in states]), axis=0)[(len(states) - 1) // 2]
    return shared


def test_arms_are_plain_fits(spark, rows):
    path = new_path(spark, "arms")
    fit = rows.where("role = 'fit'")
    models = {(r.arm, r.client): np.array(r.weights) for r in R.train_arms({"d": fit}, ARMS, T, 3, path, 1000).collect()}
    assert set(models) == {(a, c) for a in ("local", "local5", "tuned") for c in CLIENTS} | {(a, None) for a in ("central", "fed", "prox", "median")}
    parts = plain_parts(study())
    assert np.allclose(models["fed", None], plain_federated(parts, 3))
    assert np.allclose(models["prox", None], plain_federated(parts, 3, proximal=1.0))
    assert np.allclose(models["median", None], plain_federated(parts, 3, rule="median"))
    pooled = sorted((float(r[3]), r[6]) for r in study() if r[2] == "fit")
    state, _ = L.fit(L.initial(T), np.array([x for _, x in pooled]), np.array([y for y, _ in pooled]), T)
    assert np.allclose(models["central", None], L.flat(state))
    records = R.round_records(spark, f"{path}/rounds").collect()
    assert sorted((r.round, r.arm) for r in records) == sorted((k, a) for k in (1, 2, 3) for a in ("fed", "prox", "median")) and all(r.finite for r in records)
    local = {c: [r for r in study() if r[1] == c and r[2] == "fit"] for c in CLIENTS}
    assert {r.rows for r in records} == {sum(map(len, local.values()))}


def test_a_stopped_run_goes_on_from_its_last_complete_round(spark, rows):
    local, _ = R.shared_parts({"d": rows.where("role = 'fit'")}, T, 1000)
    arms = [a for a in ARMS if a.learner == "federated"]
    whole = {r.arm: r.weights for r in R.federate(local, arms, T, 5, new_path(spark, "whole")).collect()}
    path = new_path(spark, "stopped")
    R.federate(local, arms, T, 3, path)
    assert R.rounds_done(spark, path) == 3
    folder = path.removeprefix("file://")
    os.rename(f"{folder}/round=3/_SUCCESS", f"{folder}/round=3/_partial")  # as if the third round had been cut off
    assert R.rounds_done(spark, path) == 2
    kept = os.stat(f"{folder}/round=2/_SUCCESS").st_mtime_ns
    assert {r.arm: r.weights for r in R.federate(local, arms, T, 5, path).collect()} == whole
    assert os.stat(f"{folder}/round=2/_SUCCESS").st_mtime_ns == kept


def plain_pools(data):
    """(pool, row, own, unseen)."""
    out = []
    for r in data:
        if r[2] != "fit":
            out.append((r[1], r, True, r[3] == 1 and (r[1], r[4]) in TARGETS))
        if r[2] == "test" and r[3] == 1:
            out += [(c, r, False, True) for c, f in TARGETS if f == r[4] and c != r[1]]
    return out


def test_scores_are_those_of_each_model_by_itself(spark, rows, hidden):
    rng = np.random.default_rng(1)
    size = len(L.flat(L.initial(T)))
    known = [("shared", None), ("own", "a"), ("own", "b")]
    models = {k: rng.normal(0, 1, size) for k in known}
    table = spark.createDataFrame([(a, c, [float(v) for v in w]) for (a, c), w in models.items()], "arm string, client string, weights array<double>")
    names = ["own", "absent", "shared"]
    for limit in (1 << 28, size * 8):
        got = R.score_arms(E.pools(rows, hidden), names, table, T, limit).collect()
        assert len(got) == len(plain_pools(study()))
        for r in got:
            for at, arm in enumerate(names):
                w = models.get((arm, None), models.get((arm, r.pool)))
                if w is None:
                    assert r.scores[at] is None
                else:
                    assert np.isclose(r.scores[at], L.logits(L.unflat(w, T), np.array([r.features]))[0])


def test_a_run_counts_what_its_models_flag(spark, rows, hidden):
    path = new_path(spark, "run")
    told = R.execute_run(rows, hidden, {"d": rows.where("role = 'fit'")}, ARMS, T, 2, path, 1000, [0.05, 0.2])
    models = {(r.arm, r.client): L.unflat(np.array(r.weights), T) for r in spark.read.parquet(f"{path}/models").collect()}
    clients = {(r.arm, r.client, r.alpha, r.population): (r.hits, r.trials) for r in told.clients.collect()}
    families = {(r.arm, r.client, r.alpha, r.population, r.family): (r.hits, r.trials, r.unique_hits, r.unique_trials) for r in told.families.collect()}
    thresholds = {(r.arm, r.client, r.alpha): r for r in told.thresholds.collect()}
    assert len(clients) == len(ARMS) * 3 * 2 * 4 and len(thresholds) == len(ARMS) * 3 * 2
    pools = plain_pools(study())
    plain = lambda arm, pool, r: L.logits(models.get((arm, pool), models.get((arm, None))), np.array([r[6]]))[0]
    logistic = lambda z: 1 / (1 + np.exp(-z))
    expected = {}
    for arm in ARMS:
        for pool, r, own, unseen in pools:
            z = 0.25 * logistic(plain("local", pool, r)) + 0.75 * logistic(plain("fed", pool, r)) if arm.name == "mixed" else plain(arm.name, pool, r)
            expected.setdefault((arm.name, pool), []).append((r, own, unseen, z))
    for (arm, pool), scored in expected.items():
        for alpha in (0.05, 0.2):
            benign = sorted(z for r, own, _, z in scored if own and r[2] == "calibration" and r[3] == 0)
            cut = benign[int(np.ceil((1 - alpha) * (len(benign) - 1) - 1e-9))]
            assert np.isclose(thresholds[arm, pool, alpha].threshold, cut) and thresholds[arm, pool, alpha].calibration_benign == len(benign)
            member = {"benign": lambda r, own, unseen: own and r[3] == 0, "known-family": lambda r, own, unseen: own and r[3] == 1 and not unseen, "own-domain": lambda r, own, unseen: own and unseen, "federation-wide": lambda r, own, unseen: unseen}
            for population, inside in member.items():
                some = [(r, z > cut + 1e-9) for r, own, unseen, z in scored if r[2] == "test" and inside(r, own, unseen)]
                assert clients[arm, pool, alpha, population] == (sum(h for _, h in some), len(some))
                if population in ("own-domain", "federation-wide"):
                    for family in {r[4] for r, _ in some}:
                        of = sorted((r[0], r[5], h) for r, h in some if r[4] == family)
                        first = {}
                        for _, feature, h in of:
                            first.setdefault(feature, h)
                        assert families[arm, pool, alpha, population, family] == (sum(h for *_, h in of), len(of), sum(first.values()), len(first))
    metrics = {(r.arm, r.alpha, r.metric): r.value for r in told.summary.collect()}
    for arm in ARMS:
        rate = [clients[arm.name, c, 0.05, "benign"] for c in CLIENTS]
        assert np.isclose(metrics[arm.name, 0.05, "realised-fpr"], np.mean([h / n for h, n in rate]))
        assert 0.5 < metrics[arm.name, 0.05, "auroc"] < 1 and 0.5 < metrics[arm.name, 0.05, "calibration-auroc"] < 1


def test_the_grid_names_its_points_and_its_base_comes_first(spark):
    arms, points = R.grid_arms([1, 2], [0.1], [3])
    assert [a.name for a in arms] == ["fedavg", "local-epochs=1", "local-epochs=2", "proximal=0.1", "finetune-epochs=3"]
    assert [p[1:] for p in points] == [("local-epochs", 1.0), ("local-epochs", 2.0), ("proximal", 0.1), ("finetune-epochs", 3.0)]
    assert arms[-1].base == "fedavg" and len({a.name for a in arms}) == len(arms)


def test_fine_tuning_without_its_base_is_refused(spark, rows):
    with pytest.raises(ValueError, match="federated"):
        R.train_arms({"d": rows.where("role = 'fit'")}, [ARMS[0], ARMS[6]], T, 1, new_path(spark, "bad"), 1000)


def test_trainings_of_conditions_are_their_first_rows(spark):
    from sievegrid.operators import selection as sel

    rng = np.random.default_rng(8)
    made = [(i, [None, "a", "b"][i % 3], "fit" if i % 5 else "test", int(i % 2), f"f{rng.integers(3)}") for i in range(3000)]
    rows = spark.createDataFrame(made, "row long, client string, role string, label long, family string")
    targets = spark.createDataFrame([("a", "f0"), ("b", "f1")], "client string, family string")
    orders = sel.training_orders(rows, "row", 3, 0)
    for budget in (7, 400, 5000):
        got = sel.trainings(orders, targets, ["peer-present", "family-absent", "full-exposure"], "row", budget)
        for condition, own in got.items():
            want = sel.within_budget(sel.hidden_rows(orders, targets, condition), "row", budget)
            assert {tuple(r) for r in own.select("client", "row").collect()} == {tuple(r) for r in want.select("client", "row").collect()}


def test_a_run_puts_its_scores_in_order_once_and_deals_none_by_arm(spark, monkeypatch):
    from sievegrid.operators import ordering

    made = [("a", r, i % 2, True, bool(i % 4), "f", i, "v", [float(i), None if i % 3 else -float(i)]) for i, r in enumerate(["calibration", "test"] * 30)]
    scored = spark.createDataFrame(made, "pool string, role string, label long, own boolean, unseen boolean, family string, row long, feature string, scores array<double>")
    staged, plans = [], []
    keep = ordering.stage

    def told(df, name):
        staged.append(name)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(ordering, "stage", told)
    R.evaluate_arms(scored, ["x", "y"], [0.1], 1, 1, "row", "feature").summary.collect()
    assert staged.count("by-value") == 1 and "Join" not in plans[staged.index("by-value")]
