"""Diagnostic tables on small fixtures: gates, slopes, responses, components, scenarios, publication checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import diagnostics as G


def test_strata_gates(spark):
    rows = [("a", s, 0.2 + s / 1000, 0.01 * (-1) ** s) for s in range(10)]
    cells = spark.createDataFrame(rows, "set string, seed long, gain double, placebo double")
    got = {r.measure: r for r in G.strata_effects(cells, ["set"], {"gain": "superior", "placebo": "equivalence"}, 0.05, 499).collect()}
    assert got["gain"].gate and got["placebo"].gate and got["gain"].seeds == 10
    few = G.strata_effects(cells.where("seed < 2"), ["set"], {"gain": "superior"}, 0.05, 99).first()
    assert few.low is None and not few.gate


def test_split_effects_pair_seeds(spark):
    rows = [(s, f, 0.1 * s + (0.5 if f == "x" else 0.0)) for s in range(6) for f in ("x", "y")]
    cells = spark.createDataFrame(rows, "seed long, family string, effect double").withColumn("set", F.lit("all"))
    got = {r.stratum: r for r in G.split_effects(cells, ["set"], "effect", F.col("family"), "x", "y", 0.05, 99).collect()}
    assert got["difference"].mean == pytest.approx(0.5) and got["x"].seeds == 6 and not got["difference"].equivalent


def test_slopes(spark):
    rng = np.random.default_rng(0)
    rows = [(s, float(x), float(1 + 2 * x + rng.normal(0, 0.1))) for s in range(8) for x in rng.random(20)]
    row = G.slopes(spark.createDataFrame(rows, "seed long, x double, y double").withColumn("set", F.lit("a")), ["set"], "x", "y").first()
    x, y = np.array([r[1:] for r in rows]).T
    assert (row.slope, row.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1))) and row.low < 2 < row.high and row.n == 160
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "seed long, x double, y double").withColumn("set", F.lit("a"))
    assert G.slopes(flat, ["set"], "x", "y").first().slope is None


def test_dose_onsets(spark):
    rows = [("early", 0, 0.0, 0.0), ("early", 10, 0.3, 0.1), ("early", 100, 0.4, 0.2), ("early", -1, 0.5, 0.3), ("late", 10, 0.0, -0.1), ("late", 100, 0.4, 0.2), ("none", 10, 0.0, -0.1), ("none", 100, 0.4, None)]
    got = {r.family: r for r in G.dose_onsets(spark.createDataFrame(rows, "family string, dose_code long, mean double, low double"), ["family"], 0.1, 10).collect()}
    assert [got[f].response for f in ("early", "late", "none")] == ["early", "late", "nonresponsive"]
    assert (got["early"].onset_mean, got["early"].natural_gain, got["late"].onset_interval) == (10, 0.5, 100)


def test_heterogeneity(spark):
    rng = np.random.default_rng(1)
    rows = [("a", f"f{f}", s, float(f + rng.normal(0, 0.1))) for f in range(6) for s in range(5)]
    row = G.heterogeneity(spark.createDataFrame(rows, "set string, family string, seed long, gain double"), ["set"], 199).first()
    assert row.icc > 0.95 and row.low <= row.icc and row.p < 1e-6 and (row.families, row.units) == (6, 30)
    one = G.heterogeneity(spark.createDataFrame(rows[:5], "set string, family string, seed long, gain double"), ["set"], 9).first()
    assert one.families == 1 and one.icc is None


def test_sensitivity_scenarios(spark):
    rows = spark.createDataFrame([("g", s, float(s)) for s in range(4)], "group string, seed long, difference double")
    got = G.sensitivity_scenarios(rows, ["group"], "difference", F.col("seed") < 2, 99).collect()
    by = {(r.scenario, r.omitted): (r.mean, r.seeds) for r in got}
    assert by[("all-seeds", None)] == (1.5, 4) and by[("valid-only", None)] == (0.5, 2) and by[("leave-one-out", 3)] == (1.0, 3) and by[("valid-leave-one-out", 1)] == (0.0, 1)
    assert len(got) == 1 + 1 + 4 + 2


def test_publication_checks(spark):
    planned = spark.createDataFrame([("e", s, 0) for s in range(4)], "experiment string, seed long, salt long")
    runs = spark.createDataFrame([("e", 0, 0, "completed", "r"), ("e", 1, 0, "failed", "r"), ("e", 2, 0, "completed", "old")], "experiment string, seed long, salt long, status string, revision string")
    assert sorted((r.seed, r.block) for r in G.promotion_blocks(runs, planned, "r").collect()) == [(1, "failed"), (2, "stale"), (3, "missing")]
    files = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    got = G.manifest_check(files([("a", "1"), ("b", "2"), ("c", "3")]), files([("a", "1"), ("b", "9"), ("d", "4")])).collect()
    assert sorted((r.path, r.state) for r in got) == [("b", "changed"), ("c", "missing"), ("d", "stray")]


def test_rank_associations(spark):
    rows = spark.createDataFrame([(float(i), float(i * i), float(-i), None if i else 1.0) for i in range(8)], "y double, up double, down double, rare double")
    got = {r.predictor: r for r in G.rank_associations(rows, [], "y", ["up", "down", "rare"], 4, 199).collect()}
    assert got["up"].rho == pytest.approx(1) and got["down"].rho == pytest.approx(-1) and "rare" not in got and got["up"].low == pytest.approx(1)


def test_cell_facts(spark):
    cells = spark.createDataFrame([("e", 1, 0, "own-domain", 0.05, "c", "f", 0.1), ("e", 1, 0, "own-domain", 0.05, "c", "g", 0.2)], "experiment string, seed long, salt long, population string, alpha double, client string, family string, gain double")
    pairs = spark.createDataFrame([("e", 1, "c", "f", 10, 4, 20, 10)], "experiment string, seed long, client string, family string, need long, reallocated long, hidden_fit long, placebo_fit long")
    peers = spark.createDataFrame([("e", 1, 0, "f", 7)], "experiment string, seed long, salt long, family string, peer_rows long")
    descriptors = spark.createDataFrame([("c", "f", "distance", 0.5), ("c", "f", "overlap", 0.25)], "client string, family string, descriptor string, value double")
    got = {r.family: r for r in G.with_cell_facts(cells, pairs, peers, descriptors).collect()}
    assert (got["f"].reallocated_share, got["f"].fit_ratio, got["f"].is_reallocated, got["f"].distance, got["f"].overlap, got["f"].peer_rows) == (0.4, 0.5, True, 0.5, 0.25, 7)
    assert got["g"].need is None and got["g"].distance is None


def test_prefix_by_value_is_exact_with_a_hot_group_and_ties(spark):
    from sievegrid.operators.ordering import prefix_by_value

    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else None, float(rng.integers(0, 500)), int(rng.integers(0, 5))) for i in range(4000)] + [("one", 1.0, 7), ("hot", None, 9)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = prefix_by_value(df, ["g"], "v", {"s": F.sum("n"), "c": F.count(F.lit(1))}).collect()
    known = [r for r in rows if r[1] is not None]
    assert len(got) == len({(g, v) for g, v, _ in known})
    for r in got:
        mine = [x for x in known if x[0] == r.g]
        assert (r.s, r.c) == (sum(x[2] for x in mine if x[1] == r.v), sum(x[1] == r.v for x in mine))
        assert (r.s_before, r.s_all, r.c_all) == (sum(x[2] for x in mine if x[1] < r.v), sum(x[2] for x in mine), len(mine))
    whole = prefix_by_value(df, [], "v", {"c": F.count(F.lit(1))}).collect()
    assert max(r.c_before + r.c for r in whole) == len(known)


def test_sums_by_value_cut_in_short_stretches_carry_no_cuts_and_read_only_those_wanted(spark, monkeypatch):
    from sievegrid.functions.primitives import higher_quantile
    from sievegrid.operators import evaluation, ordering
    from sievegrid.session import recording

    monkeypatch.setattr(ordering, "STRETCH_BITS", 5)
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None, float(v), int(y)) for i, (v, y) in enumerate(zip(rng.integers(0, 900, 3000), rng.integers(0, 2, 3000)))]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    with recording() as staged:
        got = ordering.prefix_by_value(df, ["g"], "v", {"c": F.count(F.lit(1))})
        told = {(r.g, r.v): (r.c, r.c_before, r.c_all) for r in got.collect()}
    assert not [p for p in staged if p.rpartition("/")[2].startswith("cuts")]  # a row meets no array of its group's cuts
    for (g, v), n in told.items():
        mine = [x for h, x, _ in rows if h == g]
        assert n == (mine.count(v), sum(x < v for x in mine), len(mine))
    seen = []
    part = ordering.prefix_by_value(df, ["g"], "v", {"c": F.count(F.lit(1))}, lambda s: seen.append(s) or s.where("c_start <= 500 and 500 < c_end"))
    assert seen[0].count() > 20 and {r.g for r in part.collect()} == {"hot", None} and part.count() <= 2 * 32
    quantiles = {r.g: r.t for r in higher_quantile(df, ["g"], "v", F.lit(0.9), "t").collect()}
    recalls = {r.g: r.recall for r in evaluation.recall_at_fpr(df, ["g"], 0.1, "y", "v").collect()}
    for g in ("hot", None):
        mine = sorted(v for h, v, _ in rows if h == g)
        assert quantiles[g] == mine[int(np.ceil(0.9 * (len(mine) - 1)))]
        curve = [(0.0, 0.0)] + [tuple(np.mean([v >= cut for h, v, k in rows if h == g and k == y]) for y in (0, 1)) for cut in sorted(set(mine), reverse=True)]
        (x0, y0), (x, y) = next((a, b) for a, b in zip(curve, curve[1:]) if a[0] <= 0.1 < b[0])
        assert abs(recalls[g] - (y0 + (y - y0) * (0.1 - x0) / (x - x0))) < 1e-9


def test_first_rows_are_those_of_a_plain_window(spark):
    from sievegrid.operators.ordering import first_rows

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("o"))
    got = {(r.g, r.id) for r in first_rows(df, ["g"], ["o", "id"], 25).collect()}
    rows = sorted((r.g, r.o, r.id) for r in df.collect())
    want = {(g, i) for name in ("hot", "cold") for g, _, i in [r for r in rows if r[0] == name][:25]}
    assert got == want


def test_scored_targets_are_those_of_curves_of_their_own(spark):
    """Negatives counted once a client give what a curve of each target gives, with ties, nulls and missing sides."""
    import random

    from sievegrid.operators.diagnostics import scored_targets
    from sievegrid.operators.evaluation import recall_at_fpr

    rng = random.Random(8)
    made = [(rng.choice("ab"), rng.choice(["x", "y"]), rng.choice([0, 0, 1]), "test", rng.randint(0, 25) / 25) for _ in range(900)]
    made += [("c", "z", 1, "test", 0.5), ("d", "x", 1, "test", 0.4), ("a", "x", 0, "fit", 9.0), ("a", "x", 1, "test", None), (None, "x", 0, "test", 0.1)]
    kind = "client string, family string, label long, role string, score double"
    rows = spark.createDataFrame(made, kind)
    pairs = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "none"), ("c", "x"), ("d", "none"), ("gone", "x")]
    targets = spark.createDataFrame([(*p, 1) for p in pairs] + [(*pairs[0], 2)], "client string, family string, seed long")
    thresholds = spark.createDataFrame([(c, a, t) for c, t in (("a", 0.8), ("b", 0.5), ("c", 0.1), ("d", 0.2)) for a in (0.05, 0.2)], "client string, alpha double, threshold double")
    stored = spark.createDataFrame([("a", "x", 1, 4), ("b", "y", 0, 0)], "client string, family string, hits long, trials long")
    for alpha in (0.05, 0.2):
        got = {(r.client, r.family): r for r in scored_targets(rows, targets, thresholds, stored, alpha).collect()}
        assert set(got) == {("a", "x"), ("a", "y"), ("b", "y"), ("b", "none"), ("c", "x")}
        cut = {"a": 0.8, "b": 0.5, "c": 0.1}
        for (client, family), r in got.items():
            negative = [s for c, _, y, role, s in made if c == client and y == 0 and role == "test"]
            positive = [s for _, f, y, role, s in made if f == family and y == 1 and role == "test"]
            assert (r.benign_test, r.positive_test) == (len(negative), len(positive))
            over = lambda scores: sum(s is not None and s > cut[client] for s in scores)
            assert r.calibrated_recall == (over(positive) / len(positive) if positive else None)
            assert r.calibrated_fpr == (over(negative) / len(negative) if negative else None)
            both = spark.createDataFrame([("g", 0, s) for s in negative] + [("g", 1, s) for s in positive], "g string, label long, score double")
            want = [x.recall for x in recall_at_fpr(both, ["g"], alpha).collect()]
            assert (r.equal_fpr_recall is None and want in ([], [None])) or abs(r.equal_fpr_recall - want[0]) < 1e-12
        assert got["a", "x"].stored_recall == 0.25 and got["b", "y"].stored_recall is None


def test_rescue_levels(spark):
    from sievegrid.operators.decomposition import classify_rescue

    effects = spark.createDataFrame([("a", 0.9, 0.4), ("b", 0.1, 0.5), ("c", 0.9, None)], "family string, peer_recall double, full_recall double")
    assert {r.family: r.level for r in classify_rescue(effects, 0.5).collect()} == {"a": "poorly-rescued", "b": "rescued", "c": "not-classifiable"}


def test_lines_meet_their_dimensions_by_size_without_a_shuffle(spark):
    from sievegrid.plans import study

    for columns in (["client", "family"], ["line", "client", "family", "score"]):  # planned, not run
        plan = study.lines(spark, "/root/testdata/sf0.1").select(*columns)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BuildLeft" not in plan  # lines are neither shuffled nor broadcast


def test_components_leave_the_edges_of_hubs_in_their_tasks(spark, monkeypatch):
    from sievegrid.operators import graph

    rng = np.random.default_rng(4)
    edges = [(0, i) for i in range(5, 60)] + [(1, i) for i in range(61, 120)] + [(i, i + 1) for i in range(200, 230)] + [(130, int(i)) for i in rng.integers(131, 190, 40)] + [(59, 61), (7, 7), (9, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    monkeypatch.setattr(graph, "HUB", 8)
    met, told = graph._with_least(spark.createDataFrame([(9, i) for i in range(12)] + [(8, 3), (8, 5)], "u long, v long"))
    assert {tuple(r) for r in met.collect()} == {(9, i, 0) for i in range(12)} | {(8, 3, 3), (8, 5, 3)} and told.count() == 2
    assert "LeftAnti" in met._jdf.queryExecution().optimizedPlan().toString()  # the hub goes another way than the node of two edges
    got = {r.node: r.component for r in graph.connected_components(df, "a", "b").collect()}
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}


def test_thresholds_of_the_study_are_staged(spark, sf):
    from sievegrid.plans import queries as Q

    _, _, thresholds = Q._evaluated(spark, sf)
    plan = thresholds._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and thresholds.count() == 15
