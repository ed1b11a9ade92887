"""Closed-form cases and invariants of the study's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import primitives as P
from sievegrid.operators import decomposition as D
from sievegrid.operators import learners as L
from sievegrid.operators import preparation as prep
from sievegrid.operators import selection as sel
from sievegrid.operators import splits as S
from sievegrid.operators import statistics as stat
from sievegrid.operators.evaluation import calibrate, recall_at_fpr
from sievegrid.operators.graph import connected_components
from sievegrid.operators.ordering import shuffled_prefix
from sievegrid.plans.stages import Stage, run_stages
from sievegrid.session import new_path, stage
from sievegrid.sources import readers


def test_release_is_checked_and_binarised(spark):
    rows = spark.createDataFrame([("B", 1, "f", 9, "2019-01", 2, -1), ("a", 0, "", 0, "2019-01", 0, 1)], "hash string, label int, family string, vt_count int, year_month string, feat_0 int, feat_1 int")
    found = {r.name: r for r in prep.check_release(rows, ["feat_0", "feat_1"], 2, 4, 0).collect()}
    assert not found["contract"].passed and found["unique_hashes"].passed and found["label_rule"].passed
    assert found["contract"].negative == 1 and found["contract"].non_binary == 2
    assert {r.sha256: list(r.features) for r in prep.binarised(rows, ["feat_0", "feat_1"]).collect()} == {"a": [0, 1], "b": [1, 0]}
    with pytest.raises(ValueError, match="features"):
        prep.check_release(rows.drop("feat_1"), ["feat_0", "feat_1"], 2, 4, 0)


def test_components_are_transitive_and_named_by_their_least(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long"), "u", "v").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    rows = spark.createDataFrame([(0, "p", "x"), (1, "p", "y"), (2, "q", "y"), (3, "r", "z")], "row long, package string, feature string")
    parts = {r.row: r.component for r in prep.identities(rows, "row", "package", "feature").collect()}
    assert parts[0] == parts[1] == parts[2] != parts[3]


def test_roles_keep_groups_whole_and_shares(spark):
    rows = spark.range(6000).select((F.col("id") % 400).alias("group"))
    roles = S.assign_roles(rows, "group", 1, 0, 0)
    both = rows.join(roles, "group")
    share = {r.role: r.n / 6000 for r in both.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert abs(share["fit"] - 0.6) < 0.05 and abs(share["calibration"] - 0.2) < 0.05 and abs(share["test"] - 0.2) < 0.05
    assert roles.count() == 400
    assert sorted(map(tuple, roles.collect())) == sorted(map(tuple, S.assign_roles(rows, "group", 1, 0, 0).collect()))
    assert sorted(map(tuple, roles.collect())) != sorted(map(tuple, S.assign_roles(rows, "group", 2, 0, 0).collect()))


def test_shuffled_prefix_is_a_running_sum(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"), (F.col("id") % 7).alias("s"))
    out = shuffled_prefix(rows, ["g"], F.col("s"), F.xxhash64("id"), "before", rows_per_bucket=100).toPandas()
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values(["before", "s"])
        assert part["before"].iloc[-1] + part["s"].iloc[-1] == part["s"].sum()
        assert (part["before"].to_numpy()[1:] == np.cumsum(part["s"].to_numpy())[:-1]).all()


def test_null_keys_join_themselves(spark):
    a = spark.createDataFrame([("x", None, 1), ("x", 5, 2)], "k string, dose long, v long")
    b = spark.createDataFrame([("x", None, 10)], "k string, dose long, w long")
    assert [tuple(r) for r in P.null_safe_join(a, b, ["k", "dose"]).collect()] == [("x", None, 1, 10)]
    assert P.null_safe_join(a, b, ["k", "dose"], "left").count() == 2


def test_higher_quantile_like_its_definition(spark):
    for n in (1, 2, 20, 21, 101):
        rows = spark.range(n).select(F.lit("c").alias("client"), F.col("id").cast("double").alias("score"))
        got = calibrate(rows, [0.05], 10, ["client"]).first()
        assert got.threshold == math.ceil((1 - 0.05) * (n - 1)) and got.operating_status == ("valid" if n * 0.05 >= 10 else "insufficient-evidence")


def test_recall_at_fpr(spark):
    separated = [("s", 0, float(i)) for i in range(50)] + [("s", 1, 100.0 + i) for i in range(50)]
    same = [("e", y, float(i)) for i in range(200) for y in (0, 1)]
    got = {r.g: r.recall for r in recall_at_fpr(spark.createDataFrame(separated + same, "g string, label int, score double"), ["g"], 0.05).collect()}
    assert got["s"] == 1.0 and got["e"] == pytest.approx(0.05, abs=0.01)


def test_recall_puts_one_bin_in_order(spark, monkeypatch):
    """Recalls are those of the whole curve, whatever the scores are; few scores are put in order."""
    from sievegrid.operators import ordering

    ordered = []

    def counted(df, name):
        out = stage(df, name)
        ordered.append(out.count())
        return out

    monkeypatch.setattr(ordering, "stage", counted)
    rng = np.random.default_rng(3)
    even = [("even", int(rng.random() < 0.5), float(rng.random())) for _ in range(8000)]
    odd = [(None, int(i % 3 == 0), x) for i, x in enumerate([float("-inf"), -1e308, -1e-300, -0.0, 0.0, 0.5, 0.5, 1e300, 1e308, float("inf"), float("inf"), float("nan"), float("nan"), None] * 20)]
    flat = [("flat", i % 2, 0.25) for i in range(40)] + [("no negatives", 1, 0.5), ("no positives", 0, 0.5)]

    def wanted(cells, fpr):
        key = lambda x: (1, 0.0) if math.isnan(x) else (0, x)
        cells = [(y, key(x)) for _, y, x in cells if x is not None]
        p, q = sum(y for y, _ in cells), sum(1 - y for y, _ in cells)
        y0 = x0 = 0
        for value in sorted({v for _, v in cells}, reverse=True) if q else ():
            y1, x1 = y0 + sum(y for y, v in cells if v == value), x0 + sum(1 - y for y, v in cells if v == value)
            if x0 / q <= fpr < x1 / q:
                return (y0 / p + (y1 / p - y0 / p) * (fpr - x0 / q) / (x1 / q - x0 / q)) if p else None
            y0, x0 = y1, x1
        return "none"

    for rows, fpr in [(even, 0.05), (even + odd + flat, 0.05), (even + odd + flat, 0.4), (odd, 0.7)]:
        ordered.clear()
        got = {r.g: r.recall for r in recall_at_fpr(spark.createDataFrame(rows, "g string, label int, score double"), ["g"], fpr).collect()}
        by = {g: wanted([r for r in rows if r[0] == g], fpr) for g in {r[0] for r in rows}}
        assert got == {g: r if r is None else pytest.approx(r, abs=1e-12) for g, r in by.items() if r != "none"}
        assert rows is not even or sum(ordered) < 100


def summary(spark, rows):
    return spark.createDataFrame([("e", 1, 0, learner, condition, dose, 0.05, "m", value) for learner, condition, dose, value in rows], "experiment string, seed long, salt long, learner string, condition string, dose long, alpha double, metric string, value double")


def test_gains_add_up(spark):
    rows = [("local", "peer-present", None, 0.1), ("central", "peer-present", None, 0.6), ("central", "family-absent", None, 0.35), ("central", "full-exposure", None, 0.7), ("fedavg", "peer-present", None, 0.5), ("fedavg", "family-absent", None, 0.3), ("fedavg", "peer-present", 0, 0.9)]
    got = {(r.learner, r.estimand): r.value for r in D.decompose(summary(spark, rows)).collect()}
    assert got["central", "total_gain"] == pytest.approx(0.5) and got["central", "pooling_gain"] == pytest.approx(0.25)
    assert got["fedavg", "knowledge_gain"] == pytest.approx(0.2) and got["fedavg", "oracle_gap_recovery"] == pytest.approx(0.4 / 0.6)
    assert got["central", "local_deficit"] == pytest.approx(0.6) and ("fedavg", "local_deficit") not in got
    for x in ("central", "fedavg"):
        assert got[x, "total_gain"] == pytest.approx(got[x, "pooling_gain"] + got[x, "knowledge_gain"])


@pytest.mark.parametrize(("local", "absent", "peer", "want"), [(50, 30, 70, (0.2, 0.2, 0)), (50, 60, 80, (0, 0.2, 0)), (50, 60, 40, (0, 0, -0.2)), (50, 30, 40, (0.1, 0, 0))])
def test_cells_split_into_repair_new_and_harm(spark, local, absent, peer, want):
    rows = [("e", 1, 0, x, c, None, "c", "f", 0.05, "own-domain", h, 100) for x, c, h in (("local", "peer-present", local), ("fedavg", "family-absent", absent), ("fedavg", "peer-present", peer))]
    df = spark.createDataFrame(rows, "experiment string, seed long, salt long, learner string, condition string, dose long, client string, family string, alpha double, population string, hits long, trials long")
    r = D.hidden_cells(df, 0.05).first()
    assert (r.repair, r.new_capability, r.harm) == pytest.approx(want) and r.repair + r.new_capability + r.harm == pytest.approx(r.knowledge_gain)


def study_rows(spark):
    rows = spark.range(2400).select(F.col("id").alias("row"), F.concat(F.lit("c"), F.col("id") % 4).alias("client"), F.concat(F.lit("f"), F.floor(F.col("id") / 4) % 6).alias("family"), (F.floor(F.col("id") / 24) % 2).alias("label"), F.lit("fit").alias("role"), F.lit("eligible").alias("reason"))
    targets = spark.createDataFrame([("c0", "f0"), ("c1", "f1")], "client string, family string")
    return sel.training_orders(rows, "row", 1, 0), targets


def test_doses_are_exact_nested_and_keep_volume(spark):
    orders, targets = study_rows(spark)
    base = sel.within_budget(sel.hidden_rows(orders, targets, "family-absent"), "row", 200)
    assert base.where("label = 1 and family in ('f0', 'f1')").count() == 0
    before = set()
    for dose in (0, 5, 20):
        extras = sel.dose_extras(orders, targets, "row", dose, 3)
        rows = {r["row"] for r in extras.collect()}
        assert before <= rows and len(rows) == 2 * dose
        before = rows
        made = sel.substitute(base, extras, "row", 3)
        assert made.where("label = 1 and family = 'f0'").count() == dose and made.where("client = 'c0' and label = 1 and family = 'f0'").count() == 0
        assert {r.client: r.n for r in made.groupBy("client").agg(F.count_distinct("row").alias("n")).collect()} == dict.fromkeys(("c0", "c1", "c2", "c3"), 200)


def test_placebos_are_unused_and_nearest():
    fit = [("h", "b", 50), ("h", "c", 10), ("p", "b", 40), ("p", "c", 25), ("q", "b", 500), ("q", "c", 0)]
    free = {("p", "b"): 40, ("p", "c"): 5, ("q", "b"): 500, ("q", "c"): 0}
    chosen = sel.choose_placebos(fit, free, {("a", "h"): {"b": 20, "c": 10}}, 10)
    assert chosen[0]["placebo"] == "p" and chosen[0]["allocated"] == {"b": 25, "c": 5} and chosen[0]["reallocated"] == 5
    with pytest.raises(ValueError, match="no placebo"):
        sel.choose_placebos(fit, {}, {("a", "h"): {"b": 20}}, 10)


def test_statistics_in_closed_form():
    v = np.arange(1, 11.0)
    assert stat.exact_wilcoxon(v) == pytest.approx(2 / 2**10) and stat.exact_wilcoxon(np.zeros(5)) == 1.0
    assert stat.exact_wilcoxon(np.array([1.0, 1.0, -1.0])) == pytest.approx(1.0)
    assert stat.holm(np.array([0.01, 0.04, 0.03])) == pytest.approx([0.03, 0.06, 0.06])
    low, high = stat.bca_interval(v)
    assert low < v.mean() < high and stat.bca_interval(v[:2]) is None and stat.bca_interval(np.ones(5)) is None
    assert stat.spearman(v, v**3) == pytest.approx(1) and math.isnan(stat.spearman(v, np.ones(10)))
    assert stat.weighted_spearman(v, v[::-1], np.ones(10)) == pytest.approx(-1)
    assert stat.kendall_w(np.tile(v[:, None], 3)) == pytest.approx(1) and len(stat.leave_one_out(v, v)) == 10
    assert stat.f_tail(3.0, 2, 10) == pytest.approx(0.0954, abs=1e-4) and stat.f_tail(1.0, 5, 5) == pytest.approx(0.5)
    assert stat.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and stat.chi2_tail(20, 10) == pytest.approx(0.029253, abs=1e-6)
    assert 0 < stat.expected_ci_width(0.3, 30) < 1 and 0 < stat.detectable_rho(30) < 1


def test_dose_curves():
    d = np.array([0, 10, 25, 50, 100, 250.0])
    emax = np.array([0.3 * d / (d + 40)] * 3)
    assert stat.fit_curve(emax, d, "emax")[0] == pytest.approx((0.3, 40), rel=1e-3)
    assert stat.fit_curve(np.array([0.02 * np.log1p(d)] * 2), d, "log-linear")[0][0] == pytest.approx(0.02)
    assert stat.fit_curve(emax, d, "isotonic")[1] == pytest.approx(emax[0]) and stat.isotonic(np.array([1, 3, 2.0]), np.ones(3)) == pytest.approx([1, 2.5, 2.5])
    curve, doses = np.array([0, 0.1, 0.2, 0.3]), np.array([0, 25, 50, 100.0])
    assert [stat.equivalent_dose(curve, x, doses) for x in (0.25, -1, 9)] == [75.0, 0.0, math.inf]


def test_exposure_keeps_every_target_family(spark):
    from sievegrid.operators import selection

    training = spark.createDataFrame([("a", "f1", 1), ("a", "f1", 1), ("b", "f2", 0)], "client string, family string, label long")
    targets = spark.range(1200).select(F.concat(F.lit("f"), F.col("id")).alias("family"))
    got = selection.exposure_counts(training, targets)
    assert got.columns == ["client", "family", "train_rows", "rows"] and got.count() == 2400
    assert [tuple(r) for r in got.where("rows > 0").collect()] == [("a", "f1", 2, 2)]


def test_variance_components_find_the_effect():
    rng = np.random.default_rng(0)
    c, f, s = np.repeat(np.arange(6), 27), np.tile(np.repeat(np.arange(9), 3), 6), np.tile(np.arange(3), 54)
    shares = stat.reml_shares(c + rng.normal(0, 0.1, len(c)), [c, f, s])
    assert shares[0] > 0.9 and shares.sum() == pytest.approx(1)


def test_variance_components_are_stationary_for_the_whole_covariance():
    rng = np.random.default_rng(3)
    c, f, s = (rng.integers(0, k, 150) for k in (5, 8, 6))
    y = rng.normal(0, 0.5, 5)[c] + rng.normal(0, 0.3, 6)[s] + rng.normal(0, 0.4, 150)
    v = stat.reml(y, [c, f, s])
    grams = [(x[:, None] == x[None]).astype(float) for x in (c, f, s)] + [np.eye(150)]
    inverse = np.linalg.inv(sum(a * g for a, g in zip(v, grams, strict=True)))
    p = inverse - np.outer(inverse.sum(1), inverse.sum(1)) / inverse.sum()
    for a, g in zip(v, grams, strict=True):
        slope = ((p @ y) @ g @ (p @ y) - (p * g).sum()) * a
        assert abs(slope) < 1e-4 and (a > 1e-6 or (p @ y) @ g @ (p @ y) < (p * g).sum())


def test_resampled_sums_are_those_of_the_resampled_rows():
    rng = np.random.default_rng(4)
    c, f, s = (rng.integers(0, k, 90) for k in (3, 4, 5))
    y = rng.normal(0, 1, 5)[s] + rng.normal(0, 1, 90)
    draw = np.array([0, 3, 3, 1, 4])
    rows = [np.flatnonzero(s == d) for d in draw]
    chosen, new = np.concatenate(rows), np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    got = stat.reml_sums(stat.crossed_sums(np.ones(90), y, y * y, [c, f, s], draw[None]))[0]
    assert got == pytest.approx(stat.reml(y[chosen], [c[chosen], f[chosen], new]), abs=1e-6)


def dense_slopes(y, v, codes):
    """(slope of the restricted likelihood by log variance, whether the variance may be 0) of each component, from the whole covariance."""
    grams = [(x[:, None] == x[None]).astype(float) for x in codes] + [np.eye(len(y))]
    inverse = np.linalg.inv(sum(a * g for a, g in zip(v, grams, strict=True)))
    p = inverse - np.outer(inverse.sum(1), inverse.sum(1)) / inverse.sum()
    each = [(p @ y) @ g @ (p @ y) - (p * g).sum() for g in grams]
    return [(slope * a, a > 1e-6 or slope < 0) for a, slope in zip(v, each, strict=True)]


@pytest.mark.parametrize("case", ["balanced", "holes", "no pair effect"])
def test_pairs_of_levels_are_a_component_of_the_whole_covariance(case):
    rng = np.random.default_rng(11)
    c, f, s = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(8), np.arange(6), indexing="ij"))
    if case == "holes":
        stay = (rng.random(len(c)) < 0.6) & ((c + f) % 4 > 0)
        c, f, s = np.repeat(c[stay], 1 + s[stay] % 2), np.repeat(f[stay], 1 + s[stay] % 2), np.repeat(s[stay], 1 + s[stay] % 2)
    together = c * 8 + f
    pair = 0 if case == "no pair effect" else rng.normal(0, 0.6, 40)[together]
    y = rng.normal(0, 0.5, 5)[c] + rng.normal(0, 0.3, 8)[f] + rng.normal(0, 0.3, 6)[s] + pair + rng.normal(0, 0.4, len(c))
    v = stat.reml(y, [c, f, s], pair=(0, 1))
    # in the order of the components: client, family, seed, both together, residual
    for slope, may in dense_slopes(y, v, [c, f, s, together]):
        assert abs(slope) < 1e-4 and may
    assert (v[3] > 0.1) == (case != "no pair effect")


def test_resampled_pairs_are_those_of_the_resampled_rows():
    rng = np.random.default_rng(4)
    c, f, s = (rng.integers(0, k, 120) for k in (3, 4, 5))
    y = rng.normal(0, 1, 12)[c * 4 + f] + rng.normal(0, 1, 5)[s] + rng.normal(0, 1, 120)
    draws = np.array([[0, 3, 3, 1, 4], [3, 0, 1, 4, 3], [2, 2, 2, 2, 0]])
    got = stat._pair_fits([np.ones(120), y, y * y], [c, f, s], draws, stat.reml(y, [c, f, s], pair=(0, 1))[None], (0, 1))
    for d, v in zip(draws, got, strict=True):
        rows = [np.flatnonzero(s == x) for x in d]
        chosen, new = np.concatenate(rows), np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
        assert v == pytest.approx(stat.reml(y[chosen], [c[chosen], f[chosen], new], pair=(0, 1)), abs=1e-5)


def test_pair_shares_of_the_query_are_those_of_the_dense_likelihood(spark, sf):
    from sievegrid.operators import decomposition
    from sievegrid.plans import queries, study

    cells = decomposition.hidden_cells(study.families(spark, sf), 0.05).toPandas()
    got = queries.QUERIES["s19_pair_shares"](spark, sf).toPandas().set_index(["population", "source"])
    assert set(got.index.get_level_values(1)) == {"client", "family", "seed", "client-family", "residual"}
    for population, g in cells.groupby("population"):
        codes = [g[x].astype("category").cat.codes.to_numpy().astype(int) for x in ("client", "family", "seed")]
        y = g["knowledge_gain"].to_numpy(float)
        v = stat.reml(y, codes, pair=(0, 1))
        shares = [got.loc[(population, x), "share"] for x in ("client", "family", "seed", "client-family", "residual")]
        assert shares == pytest.approx(list(v / v.sum()), abs=1e-6) and sum(shares) == pytest.approx(1)
        codes.append(codes[0] * 1000 + codes[1])
        y = (y - y.mean()) / y.std()
        for slope, may in dense_slopes(y, v / g["knowledge_gain"].to_numpy(float).var(), codes):
            assert abs(slope) < 1e-2 and may
    assert (got["low"] <= got["high"]).all() and (got["high"] > got["low"]).any()


def test_pairs_take_factors_that_stay(spark):
    cells = spark.createDataFrame([("a", 1, 2, 3, 0.5)], "g string, c long, f long, s long, y double")
    for pair in (("c", "s"), ("c", "other")):
        with pytest.raises(ValueError, match="other than the last"):
            stat.reml_share_table(cells, "g", ["c", "f", "s"], "y", pair=pair)
    one = stat.reml_share_table(cells, "g", ["c", "f", "s"], "y", draws=3, pair=("c", "f")).collect()
    assert {r["source"] for r in one} == {"c", "f", "s", "c-f", "residual"} and all(r["share"] == 0 for r in one)
    assert stat.reml_share_table(cells.limit(0), "g", ["c", "f", "s"], "y", draws=3, pair=("c", "f")).count() == 0


def test_variance_shares_of_the_query_use_every_seed(spark, sf):
    from sievegrid.operators import decomposition
    from sievegrid.plans import queries, study

    cells = decomposition.hidden_cells(study.families(spark, sf), 0.05).toPandas()
    got = queries.QUERIES["c21_reml_shares"](spark, sf).toPandas().set_index(["population", "source"])
    for population, g in cells.groupby("population"):
        codes = [g[x].astype("category").cat.codes.to_numpy() for x in ("client", "family", "seed")]
        assert len(set(codes[2])) == 6
        want = stat.reml_shares(g["knowledge_gain"].to_numpy(float), codes)
        assert [got.loc[(population, x), "share"] for x in ("client", "family", "seed", "residual")] == pytest.approx(list(want), abs=1e-6)
    assert (got["low"] <= got["high"]).all() and (got["high"] > got["low"]).any()


def test_cluster_bootstrap_tells_difference(spark):
    rows = spark.range(1000).select((F.col("id") % 200).alias("g"), (F.rand(3) < 0.9).alias("a"), (F.rand(4) < 0.4).alias("b"))
    r = stat.cluster_bootstrap(rows, "g", F.col("a"), F.col("b"), 300, 1).first()
    assert 0 < r.low < 0.5 < r.high or 0.4 < r.low < r.high < 0.6
    r = stat.cluster_bootstrap(rows, "g", F.col("a"), F.col("a"), 100, 1).first()
    assert r.low == r.high == 0


def test_states_average_and_robust_rules(spark):
    rows = spark.createDataFrame([(0, h, 1, p, w) for p, sign in ((0, 1), (1, -1)) for h, w in enumerate((sign * x for x in (1.0, 2.0, 4.0, 100.0)))], "arm int, holder int, rows long, pos int, weight double")
    value = lambda df: [r.weight for r in df.orderBy("pos").collect()]
    assert value(L.robust_states(rows, ["arm"], "trimmed")) == [3, -3] and value(L.robust_states(rows, ["arm"], "median")) == [2, -4]
    assert value(L.average_states(rows, ["arm"])) == [26.75, -26.75]


def test_learners_separate_and_federate(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 6)).astype(float)
    rows = spark.createDataFrame([(int(i % 4), [float(v) for v in x[i]], int(x[i, 0])) for i in range(400)], "holder long, features array<double>, label long")
    t = L.Training(width=6, hidden=(8,), epochs=4, batch=32, rate=0.02)
    weights, trace = L.train_federated(rows, "holder", t, 4)
    scored = L.score(rows, weights, t).toPandas()
    assert ((scored["score"] > 0) == (scored["label"] == 1)).mean() > 0.95 and trace[-1]["loss"] < trace[0]["loss"] and trace[-1]["finite"]
    free = np.array(L.finetune(rows, "holder", t, weights).first()["weights"])
    from dataclasses import replace

    near = np.array(L.finetune(rows, "holder", replace(t, proximal=5.0), weights).first()["weights"])
    assert np.abs(near - weights).sum() < np.abs(free - weights).sum()


def test_a_large_holder_is_fitted_in_bounded_parts_that_keep_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1000, 3))
    rows = spark.createDataFrame([(i, 0 if i % 10 else None, [float(v) for v in x[i]], int(x[i, 0] > 0)) for i in range(1000)], "id long, holder long, features array<double>, label long")
    t = L.Training(width=3, hidden=(), epochs=2, batch=32, rate=0.05, part=64)
    parts = L.parts_of(rows, ["holder"], t).toPandas()
    assert parts["labels"].map(len).sum() == 1000 and parts["labels"].map(len).max() < 128 and len(parts) > 10
    assert sorted(round(v, 9) for f in parts["features"] for v in f) == sorted(np.round(x.ravel(), 9))
    assert {r.rows for r in L.fit_by(rows, ["holder"], t).collect()} == {100, 900}
    for rule in ("mean", "median"):
        weights, trace = L.train_federated(rows, "holder", t, 3, rule)
        assert trace[-1]["loss"] < trace[0]["loss"] and weights[0] > 3 * np.abs(weights[1:3]).max()


def test_roles_stage_few_rows_of_many_groups(spark, monkeypatch):
    """Groups are told apart near the cuts only, and roles are as by a join, where cuts lie elsewhere too."""
    staged = []

    def counted(df, name, keep=False):
        out = stage(df, name, keep)
        staged.append(out.count())
        return out

    monkeypatch.setattr(S, "stage", counted)
    many = spark.range(40_000).select(F.col("id").alias("group"), F.lit(1).alias("n"))
    hot = many.where("group < 300").withColumn("n", F.when(F.col("group") == 7, 900).otherwise(F.col("n"))).unionByName(spark.createDataFrame([(None, 5)], "group long, n int"))
    for groups, cuts, least in [(many, (0.6, 0.2), True), (many, (0.001, 0.998), True), (hot, (0.6, 0.2), False), (hot, (0.1, 0.1), False)]:
        rows = groups.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
        staged.clear()
        told = S.with_roles(rows, "group", 4, 0, 1, *cuts).groupBy("group", "role").count()
        joined = rows.join(S.assign_roles(rows, "group", 4, 0, 1, *cuts), "group").groupBy("group", "role").count()
        assert sum(staged) < 10_000 or not least
        assert told.exceptAll(joined).count() == 0 and joined.exceptAll(told).count() == 0


def test_sources_and_stages(spark, tmp_path):
    import gzip

    path = f"{tmp_path}/latest.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("sha256,pkg_name,vt_detection,markets,other\nA1,first,12,play,9\nB2,second,3,anzhi,9\n")
    wanted = spark.createDataFrame([("a1",)], "sha256 string")
    assert [tuple(r) for r in readers.read_market_index(spark, path, wanted).collect()] == [("a1", "first", "play", 12.0)]
    digests = readers.file_digests(spark, str(tmp_path))
    assert len(readers.dataset_digest(digests)) == 64
    assert readers.dataset_digest(readers.file_digests(spark, str(tmp_path), known=digests)) == readers.dataset_digest(digests)
    dense = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 3.0])], "row long, features array<double>")
    back = readers.dense_rows(readers.sparse_rows(dense, "row", "features"), "row", 3)
    assert {r["row"]: list(r.features) for r in back.collect()} == {1: [0, 2, 0], 2: [1, 0, 3]}
    root = new_path(spark, "stages")
    graph = [Stage("one", lambda t: spark.range(3).toDF("x")), Stage("two", lambda t: t["one"].where("x > 0"), ("one",), {"k": 1}, lambda d: {"rows": d.count() == 2})]
    assert run_stages(spark, root, graph, {"s": "1"}) == {"one": "built", "two": "built"}
    assert run_stages(spark, root, graph, {"s": "1"}) == {"one": "reused", "two": "reused"}
    graph[1].settings = {"k": 2}
    assert run_stages(spark, root, graph, {"s": "1"}) == {"one": "reused", "two": "built"}
    evidence = spark.range(4).select(F.lit("m").alias("mode"), F.lit("e").alias("experiment"), F.col("id").alias("seed"), F.lit(0).alias("salt"), "id")
    readers.write_evidence(evidence, f"{root}/evidence")
    assert readers.read_evidence(spark, f"{root}/evidence", "m").count() == 4


def test_roles_by_cuts_are_those_of_the_join(spark):
    rows = spark.createDataFrame([(i % 211 if i % 50 else None, i) for i in range(3000)], "group long, i long")
    for attempt in range(3):
        wanted = rows.join(S.assign_roles(rows, "group", 4, 0, attempt), "group").select("i", "role").collect()
        told = S.with_roles(rows, "group", 4, 0, attempt).select("i", "role")
        assert sorted(map(tuple, told.collect())) == sorted(map(tuple, wanted))
        assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()  # rows stay where they lie
    assert S.with_roles(rows.where("i < 0"), "group", 4, 0, 0).count() == 0
    one = rows.where("group = 7")
    assert {r.role for r in S.with_roles(one, "group", 4, 0, 0).collect()} == {"fit"}


def test_best_attempt_reads_rows_once_and_finds_what_the_splits_have(spark):
    rows = spark.createDataFrame([(i % 97, f"c{i % 5}", f"f{i % 3}", "eligible" if i % 2 else "not") for i in range(2000)], "group long, client string, family string, reason string")
    rule = {"target_min_fit": 36, "peer_min_fit": 150, "federation_min_test": 60, "target_min_remaining_fit": 150}
    wanted = []
    for attempt in range(4):
        split = rows.join(S.assign_roles(rows, "group", 4, 0, attempt), "group")
        wanted.append((-S.controlled_pairs(S.role_counts(split), S.client_fit_rows(split), rule).where("eligible").count(), attempt))
    told = S.best_attempt(rows, "group", 4, 0, 4, rule)
    assert [(-r.eligible, r.attempt) for r in told.collect()] == [min(wanted)]
    assert min(wanted) < max(wanted)


def test_calibration_ranks_scores_once_for_all_levels(spark):
    from sievegrid.functions.primitives import higher_quantile

    rows = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 1.0)], "client string, score double")
    found = higher_quantile(rows, ["client"], "score", 1 - F.col("alpha"), "t", F.array(F.lit(0.01), F.lit(0.1)), "alpha")
    assert {(r.client, r.alpha): (r.t, r.n) for r in found.collect()} == {("a", 0.01): (99.0, 101), ("a", 0.1): (90.0, 101), ("b", 0.01): (1.0, 1), ("b", 0.1): (1.0, 1)}


def test_sketches_of_orders_are_not_kept_for_each_order(spark, sf):
    from sievegrid.plans.surface_queries import QUERIES

    plan = QUERIES["p42_approximate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and "count(distinct" in line]


def test_permuting_labels_reads_its_rows_twice_only(spark):
    from sievegrid.operators.preparation import permuted_labels
    from sievegrid.session import stage

    rows = stage(spark.range(500).selectExpr("concat('r', id) AS row", "concat('f', id % 7) AS family", "if(id % 3 = 0, 'eligible', 'other') AS reason"), "whole")
    out = permuted_labels(rows, "row", 1, 7)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reason") and out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("/whole-") == 1
    old, new = ({r.row: r.family for r in x.collect()} for x in (rows, out))
    moved = [k for k in old if int(k[1:]) % 3 == 0]
    assert sorted(old[k] for k in moved) == sorted(new[k] for k in moved) and all(old[k] == new[k] for k in old if k not in moved)
