"""Boosted trees of many holders at once, from histograms of gradients.

Features are cut at shared edges into bins. A level of all holders' trees is one job: a task adds its rows' gradients, second derivatives
and counts by (holder, node, feature, bin); only these sums are shuffled, by (holder, node, feature), where each feature's
best cut is found; the best of a node's features (a row a node) goes to the driver. Rows stay where they lie: their node follows from their bins
and the tree so far. Their raw scores are staged every few trees.

A node is cut where g_l^2 / (h_l + l2) + g_r^2 / (h_r + l2) - g^2 / (h + l2) is largest and above 0, ties to the lowest feature, then edge, with
``least_rows`` rows and ``least_weight`` second derivatives on both sides. Children of node i are 2i + 1 and 2i + 2.

Defined cases: values that are null or not numbers go to the last bin; a holder of one class has its clipped base rate and no trees that cut;
a null holder is a holder; an empty table has no holders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.session import stage, unstage

#: Trees after which raw scores are staged. Each level of a tree scores anew with those that are not, so the work of a tree grows with this number.
STRIDE = 2
#: Bytes of sums that a task holds before it hands them on.
HELD = 1 << 26
NODE = "holder string, tree int, node int, feature int, threshold double, gain double, rows long, value double"


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    bins: int = 255
    least_rows: int = 20
    least_weight: float = 1e-3
    l2: float = 0.0


@dataclass
class Tree:
    """Arrays by node; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            some, node = rows[inner], at[inner]
            at[inner] = 2 * node + 1 + (bins[some, self.feature[node]] > self.cut[node])


@dataclass
class Forest:
    edges: list[np.ndarray]
    base: dict[str | None, float]
    trees: list[dict[str | None, Tree]] = field(default_factory=list)
    nodes: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """(holder, tree, node, feature, threshold, gain, rows, value): a row a node; leaves have a value, others a feature."""
        return spark.createDataFrame(self.nodes, NODE)


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Each feature's approximate quantiles, bins - 1 at most, each once; a value lies in the bin of the first edge at or above it."""
    shares = [i / bins for i in range(1, bins)]
    long = rows.select(F.posexplode("features").alias("feature", "x")).where("x is not null and not isnan(x)")
    found = long.groupBy("feature").agg(F.percentile_approx("x", shares, 50 * bins).alias("edges"), F.max("x").alias("most")).collect()  # a row a feature
    width = max((r["feature"] for r in found), default=-1) + 1
    out = [np.zeros(0)] * width
    for r in found:
        edges = np.unique(np.array(r["edges"], float))
        out[r["feature"]] = edges[edges < r["most"]]
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.int16) if edges else np.zeros((len(x), 0), np.int16)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in values], float) if len(values) else np.zeros((0, 0))


def _with_bins(rows: DataFrame, forest: Forest) -> DataFrame:
    """(holder, label, bins, raw), staged: the rows at the holder's base rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                bins = _binned(_matrix(b["features"]), forest.edges)
                yield pd.DataFrame({"holder": b["holder"], "label": b["label"].astype(float), "bins": [r.tobytes() for r in bins], "raw": [forest.base[None if h is None or h != h else h] for h in b["holder"]]})

    return stage(rows.mapInPandas(run, "holder string, label double, bins binary, raw double"), "binned")


def _groups(b: pd.DataFrame) -> Iterator[tuple[str | None, np.ndarray]]:
    for holder, at in b.groupby("holder", dropna=False).indices.items():
        yield (None if holder is None or holder != holder else holder), at


def _raw(b: pd.DataFrame, bins: np.ndarray, trees: list[dict[str | None, Tree]]) -> np.ndarray:
    raw = b["raw"].to_numpy(float).copy()
    for holder, at in _groups(b):
        for t in trees:
            if holder in t:
                raw[at] += t[holder].value[t[holder].places(bins[at])]
    return raw


def _unpacked(b: pd.DataFrame, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["bins"]), np.int16).reshape(len(b), width)


def _histograms(rows: DataFrame, trees: list[dict[str | None, Tree]], growing: dict[str | None, Tree], level: int, sizes: list[int]) -> DataFrame:
    """(holder, node, feature, sums): gradients, second derivatives and counts by bin of the nodes of a level, added by task."""
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            bins = _unpacked(b, len(sizes))
            p = 1 / (1 + np.exp(-_raw(b, bins, trees)))
            parts = np.stack([p - b["label"].to_numpy(), p * (1 - p), np.ones(len(b))])
            for holder, at in _groups(b):
                if holder not in growing:
                    continue
                node = growing[holder].places(bins[at])
                for k in np.unique(node[node >= 2**level - 1]).tolist():
                    some = at[node == k]
                    cell = bins[some] + starts[:-1]
                    sums = np.stack([np.bincount(cell.ravel(), np.repeat(w[some], len(sizes)), minlength=starts[-1]) for w in parts])
                    held[holder, k] = held.get((holder, k), 0.0) + sums
            if sum(v.nbytes for v in held.values()) > HELD:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    def told(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        cells = [(h, k, f, s[:, starts[f] : starts[f + 1]].ravel()) for (h, k), s in held.items() for f in range(len(sizes))]
        return pd.DataFrame(cells, columns=["holder", "node", "feature", "sums"])

    return rows.mapInPandas(run, "holder string, node int, feature int, sums array<double>")


def best_cut(sums: np.ndarray, c: Boosting) -> tuple[float, int, float, float, float, float]:
    """(gain, bin, g and h left of the cut, g and h in all) of (3, bins); gain 0 and bin -1 where nothing may be cut."""
    left = np.cumsum(sums, axis=1)
    g, h, n = left[:, -1]
    gl, hl, nl = left[:, :-1]
    fine = (np.minimum(nl, n - nl) >= c.least_rows) & (np.minimum(hl, h - hl) >= c.least_weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, gl**2 / (hl + c.l2) + (g - gl) ** 2 / (h - hl + c.l2) - g**2 / (h + c.l2), 0.0)
    if not len(gain) or not gain.max() > 1e-12:
        return 0.0, -1, 0.0, 0.0, g, h
    at = int(gain.argmax())
    return float(gain[at]), at, gl[at], hl[at], g, h


def _best_cuts(histograms: DataFrame, c: Boosting) -> list:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["sums"].to_numpy())
        sums = x[np.lexsort(x[:, : min(4, x.shape[1])].T)].sum(axis=0).reshape(3, -1)
        gain, at, gl, hl, g, h = best_cut(sums, c)
        return b.head(1)[["holder", "node", "feature"]].assign(gain=gain, cut=at, gl=gl, hl=hl, g=g, h=h, n=int(round(sums[2].sum())))

    kinds = "holder string, node int, feature int, gain double, cut int, gl double, hl double, g double, h double, n long"
    cuts = histograms.groupBy("holder", "node", "feature").applyInPandas(run, kinds)
    first = F.min_by(F.struct("feature", "gain", "cut", "gl", "hl", "g", "h", "n"), F.struct(-F.col("gain"), "feature"))
    return cuts.groupBy("holder", "node").agg(first.alias("best")).select("holder", "node", "best.*").orderBy("holder", "node").collect()  # a row a node


def fit_trees(training: DataFrame, c: Boosting, holder: str | None = None, edges: list[np.ndarray] | None = None) -> Forest:
    """Trees of (holder, features, label) for each value of the column ``holder``, or of all rows together."""
    rows = training.select((F.lit("") if holder is None else F.col(f"`{holder}`")).cast("string").alias("holder"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))
    edges = bin_edges(rows, c.bins) if edges is None else edges
    shares = rows.groupBy("holder").agg(F.avg("label").alias("p")).collect()  # a row a holder
    odds = lambda p: float(np.log(p / (1 - p)))
    forest = Forest(edges, {r["holder"]: odds(min(max(r["p"], 1e-6), 1 - 1e-6)) for r in shares})
    sizes, width = [len(e) + 1 for e in edges], 2 ** (c.depth + 1) - 1
    known, fresh = _with_bins(rows, forest), []
    for number in range(c.rounds):
        growing = {h: Tree(np.full(width, -1), np.zeros(width, int), np.zeros(width)) for h in forest.base}
        open_ = dict(growing)
        for level in range(c.depth):
            still: dict[str | None, Tree] = {}
            for r in _best_cuts(_histograms(known, fresh, open_, level, sizes), c):
                tree, k = growing[r["holder"]], r["node"]
                if level == 0:
                    tree.value[0] = -c.rate * r["g"] / (r["h"] + c.l2) if r["h"] + c.l2 > 0 else 0.0
                if r["cut"] >= 0:
                    tree.feature[k], tree.cut[k] = r["feature"], r["cut"]
                    for side, (g, h) in enumerate(((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"]))):
                        tree.value[2 * k + 1 + side] = -c.rate * g / (h + c.l2)
                    still[r["holder"]] = tree
                    forest.nodes.append((r["holder"], number, k, r["feature"], float(edges[r["feature"]][r["cut"]]), float(r["gain"]), r["n"], None))
            open_ = still
            if not open_:
                break
        for h, tree in growing.items():
            reached = [0] + [2 * k + 1 + s for k in np.flatnonzero(tree.feature >= 0).tolist() for s in (0, 1)]
            forest.nodes += [(h, number, k, None, None, None, None, float(tree.value[k])) for k in reached if tree.feature[k] < 0]
        forest.trees.append(growing)
        fresh.append(growing)
        if len(fresh) == STRIDE and number + 1 < c.rounds:
            before, known = known, stage(_with_raw(known, fresh, len(sizes)), "binned")
            unstage(before)
            fresh = []
    unstage(known)
    return forest


def _with_raw(rows: DataFrame, trees: list[dict[str | None, Tree]], width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(raw=_raw(b, _unpacked(b, width), trees))

    return rows.mapInPandas(run, rows.schema)


def score_trees(rows: DataFrame, forest: Forest, holder: str | None = None, out: str = "score") -> DataFrame:
    """The same rows with their logits; null for holders without a forest."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            own = b[[holder]].rename(columns={holder: "holder"}).reset_index(drop=True) if holder is not None else pd.DataFrame({"holder": [""] * len(b)})
            own["raw"] = [forest.base.get(None if h is None or h != h else str(h), np.nan) for h in own["holder"]]
            own["holder"] = [None if h is None or h != h else str(h) for h in own["holder"]]
            yield b.assign(**{out: _raw(own, _binned(_matrix(b["features"]), forest.edges), forest.trees)})

    return rows.mapInPandas(run, schema)
