"""Neighbours by inner product whatever the norms, grades' probabilities whatever the number of labels, hosts under shared suffixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import url_filters, vptree
from sievegrid.llm.ordinal import fit_toxicity, score_toxicity

N, D = 3000, 12


def clustered(seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, D))
    x = centres[rng.integers(40, size=N)] + 0.5 * rng.normal(size=(N, D))
    return x / np.linalg.norm(x, axis=1)[:, None], rng


def norms(name):
    x, rng = clustered()
    if name == "one":
        x[7] *= 10
    elif name == "log-normal":
        x *= np.exp(0.4 * rng.normal(size=N))[:, None]
    elif name == "wide":
        x *= np.exp(1.5 * rng.normal(size=N))[:, None]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.query_id), r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("name", ["unit", "one", "log-normal", "wide"])
def test_recall_on_any_norms_and_exactness_at_factor_one(spark, name):
    x = norms(name)
    queries = np.arange(0, N, 20)
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    want = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(queries, scores, strict=True)}
    df = frame(spark, x)
    share = lambda got: np.mean([len(set(got[q]) & w) / 20 for q, w in want.items()])
    assert share(found(vptree.search(df, shard_rows=400).collect())) >= 0.9
    assert share(found(vptree.search(df, shard_rows=400, factor=1.0).collect())) == 1.0


def test_one_tree_prunes_and_keeps_recall_on_skewed_norms(spark):
    x = norms("log-normal")
    bands = [type("R", (dict,), {})(band=0, n=N, norm=float(np.linalg.norm(x, axis=1).max()), vector=x[0].tolist())]
    pivots = vptree._Pivots(bands, [], 1.0, N, 100)
    tree = vptree.VantageTree(vptree._lift(x / pivots.norm[0]), leaf=32)
    rows, _ = tree.search(vptree._aim(x[:100]), 5, np.full(100, np.inf), 1.0)
    want = np.sort(x[:100] @ x.T, axis=1)[:, -5:]
    assert np.allclose(np.sort(np.take_along_axis(x[:100] @ x.T, rows, 1), axis=1), want)


def test_large_and_tiny_components_are_scaled(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    plain = found(vptree.search(frame(spark, x), factor=1.0).collect())
    for scale in (1e200, 1e-200):
        got = vptree.search(frame(spark, x * scale), factor=1.0)
        rows = got.collect()
        assert len(rows) == 3 * 20
        if scale < 1:  # products underflow to nothing, so all but the ids is a tie
            assert {r.score for r in rows} <= {0.0, -0.0}
        else:
            assert all(np.isinf(r.score) for r in rows)
    mild = found(vptree.search(frame(spark, x * 2.0**40), factor=1.0).collect())
    assert mild == plain


def test_ids_may_be_strings(spark):
    x, _ = clustered(3)
    x = x[:200]
    df = frame(spark, x).select(F.format_string("id-%05d", "vec_id").alias("vec_id"), "embedding")
    got = found(vptree.search(df, factor=1.0, asked=F.col("id").isin("id-00003", "id-00100")).collect())
    assert set(got) == {"id-00003", "id-00100"}
    for q, near in got.items():
        i = int(q[3:])
        s = x @ x[i]
        s[i] = -np.inf
        assert near == [f"id-{j:05d}" for j in np.argsort(-s)[:20]]


def test_probabilities_do_not_depend_on_the_sample(spark):
    rng = np.random.default_rng(2)
    docs, labels, truth = [], [], {}
    for i in range(4000):
        grade = int(rng.choice([0, 1, 2], p=[0.88, 0.09, 0.03]))
        words = [f"w{rng.integers(300)}" for _ in range(40)]
        if grade and rng.random() < 0.9:
            words[:3] = [f"bad{rng.integers(6)}" for _ in range(3)]
        docs.append((i, " ".join(words)))
        labels.append((i, grade))
        truth[i] = grade > 0
    docs += [(5000, ""), (5001, None), (5002, " \n ")]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    rate = np.mean(list(truth.values()))
    for sample in (12_000, 1200, 450):
        model = fit_toxicity(docs, labels, F.col("grade"), 3, sample=sample)
        got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
        assert all(abs(got[i].p_toxic - rate) < 0.005 for i in (5000, 5001, 5002))
        assert abs(np.mean([got[i].p_toxic for i in truth]) - rate) < 0.03
        flagged = np.array([got[i].toxic for i in truth])
        assert flagged[[not t for t in truth.values()]].mean() < 0.03 and flagged[list(truth.values())].mean() > 0.7


def test_suffixes_carry_no_distrust(spark):
    pages = [(1, "http://bad.co.uk/x", ""), (2, "http://shop.co.uk/", ""), (3, "http://news.co.uk/a", ""), (4, "http://blog.bad.co.uk/", ""), (5, "http://a.host.example/", ""), (6, "http://b.host.example/", "")]
    rules = [("block", "bad.co.uk", "/x"), ("block", "a.host.example", "/")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust) for r in url_filters.url_filter(docs, rules, tolerance=1e-3).collect()}
    assert got[2] == got[3] == ("allow", 0.0)
    assert [got[i][0] for i in (1, 4, 5, 6)] == ["block"] * 4
    own = {r.page_id: r.verdict for r in url_filters.url_filter(docs, rules, tolerance=1e-3, suffixes=("host.example",)).collect()}
    assert own[6] == "allow" and own[2] == "block"
