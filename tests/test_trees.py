"""Boosted trees against a brute-force search of every cut of every node."""

import numpy as np
import pytest

from sievegrid.operators import trees as B


def data(n=700, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 4)), 1)
    y = (np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + 0.5 * rng.normal(0, 1, n) > 0.2).astype(int)
    holder = rng.choice(["p", "q", None], n, p=[0.6, 0.3, 0.1])
    return x, y, holder


SCHEMA = "holder string, features array<double>, label long"


def frame(spark, x, y, holder):
    return spark.createDataFrame([(h, [float(v) for v in a], int(b)) for h, a, b in zip(holder, x, y, strict=True)], SCHEMA)


def plain_tree(x, g, h, edges, c, k, level, out):
    """Fills out[node] = (feature, edge, gain, rows) or value, by trying every edge of every feature."""
    best = None
    if level < c.depth:
        for f, cuts in enumerate(edges):
            for e in cuts:
                left = x[:, f] <= e
                if min(left.sum(), (~left).sum()) < c.least_rows or min(h[left].sum(), h[~left].sum()) < c.least_weight:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + c.l2) + g[~left].sum() ** 2 / (h[~left].sum() + c.l2) - g.sum() ** 2 / (h.sum() + c.l2)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, e, left
    if best is None:
        value = -c.rate * g.sum() / (h.sum() + c.l2)
        out[k] = value
        return np.full(len(x), value)
    gain, f, e, left = best
    out[k] = (f, e, gain, len(x))
    raw = np.zeros(len(x))
    raw[left] = plain_tree(x[left], g[left], h[left], edges, c, 2 * k + 1, level + 1, out)
    raw[~left] = plain_tree(x[~left], g[~left], h[~left], edges, c, 2 * k + 2, level + 1, out)
    return raw


def plain_forest(x, y, edges, c):
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    raw, found = np.full(len(y), np.log(p / (1 - p))), []
    for _ in range(c.rounds):
        q = 1 / (1 + np.exp(-raw))
        out = {}
        raw = raw + plain_tree(x, q - y, q * (1 - q), edges, c, 0, 0, out)
        found.append(out)
    return raw, found


@pytest.mark.parametrize("l2,stride", [(0.0, 8), (1.5, 2)])
def test_trees_are_those_of_a_brute_force_search(spark, monkeypatch, l2, stride):
    monkeypatch.setattr(B, "STRIDE", stride)
    x, y, holder = data()
    rows = frame(spark, x, y, holder)
    c = B.Boosting(rounds=5, depth=3, least_rows=15, l2=l2, rate=0.3)
    edges = [np.unique(np.round(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9)), 1)) + 0.05 for f in range(4)]
    forest = B.fit_trees(rows, c, "holder", edges)
    nodes = {(r.holder, r.tree, r.node): r for r in forest.table(spark).collect()}
    scored = B.score_trees(rows, forest, "holder").collect()
    for name in ("p", "q", None):
        own = np.array([h == name for h in holder])
        raw, found = plain_forest(x[own], y[own].astype(float), edges, c)
        for number, out in enumerate(found):
            assert {k for h, t, k in nodes if h == name and t == number} == set(out)
            for k, want in out.items():
                r = nodes[name, number, k]
                if isinstance(want, tuple):
                    assert (r.feature, r.threshold, r.rows) == (want[0], want[1], want[3]) and np.isclose(r.gain, want[2])
                else:
                    assert r.feature is None and np.isclose(r.value, want)
        assert np.allclose(sorted(r.score for r in scored if r.holder == name), sorted(raw))


def test_edges_are_quantiles_and_leave_no_empty_last_bin(spark):
    x, y, holder = data(2000, 1)
    edges = B.bin_edges(frame(spark, x, y, holder), 16)
    assert len(edges) == 4
    for f, e in enumerate(edges):
        assert len(e) <= 15 and (np.diff(e) > 0).all() and e[-1] < x[:, f].max()
        share = (x[:, f][:, None] <= e).mean(axis=0)
        assert np.abs(np.diff(np.concatenate([[0], share, [1]])) - 1 / 16).max() < 0.05
    few = B.bin_edges(frame(spark, np.zeros((50, 2)) + [[1.0, 0.0]], np.arange(50) % 2, ["p"] * 50), 16)
    assert [len(e) for e in few] == [0, 0]


def test_held_out_rows_are_told_apart(spark):
    x, y, holder = data(4000, 2)
    forest = B.fit_trees(frame(spark, x[:3000], y[:3000], holder[:3000]), B.Boosting(rounds=6, depth=4, rate=0.3), None)
    got = B.score_trees(frame(spark, x[3000:], y[3000:], holder[3000:]), forest).toPandas()
    assert ((got["score"] > 0) == (got["label"] == 1)).mean() > 0.75 > ((y == 1).mean() if y.mean() > 0.5 else (y == 0).mean())


def test_odd_trees(spark):
    empty = spark.createDataFrame([], SCHEMA)
    forest = B.fit_trees(empty, B.Boosting(rounds=2, depth=2), "holder")
    assert forest.base == {} and forest.table(spark).count() == 0 and B.score_trees(empty, forest, "holder").count() == 0
    rows = spark.createDataFrame([("one", [1.0, None], 1)] * 30 + [("two", [float(i), float("nan") if i % 2 else 1.0], i // 20) for i in range(40)], SCHEMA)
    forest = B.fit_trees(rows, B.Boosting(rounds=2, depth=2, least_rows=5), "holder")
    nodes = forest.table(spark).toPandas()
    assert set(nodes.loc[nodes["holder"] == "one", "node"]) == {0}
    assert list(nodes[(nodes["holder"] == "two") & (nodes["node"] == 0) & (nodes["tree"] == 0)]["feature"]) == [0]
    other = spark.createDataFrame([("new", [1.0, 1.0], 1), ("two", [39.0, None], 1)], SCHEMA)
    got = {r.holder: r.score for r in B.score_trees(other, forest, "holder").collect()}
    assert (got["new"] is None or np.isnan(got["new"])) and got["two"] > forest.base["two"]


def test_a_level_scores_with_few_trees_anew(spark, monkeypatch):
    from sievegrid.operators import trees as B

    rows = spark.createDataFrame([("h", [float(i % 17), float(i % 5)], i * 7 % 13 % 2) for i in range(400)], "client string, features array<double>, label int")
    fresh, keep = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda known, trees, *more: fresh.append(len(trees)) or keep(known, trees, *more))
    B.fit_trees(rows, B.Boosting(rounds=5, depth=1, least_rows=5), "client")
    assert len(fresh) == 5 and max(fresh) <= 1
