"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on a text's words and form gives each document log odds of being good. Documents of one site are alike,
so the other documents of its site count too, as far as they show it. Levels are nested - all, host, path. A level's share
of good documents is shrunk towards its parent's, share = (sum + k * parent's share) / (n + k), and the document itself is
left out of both sums. The strength k of a level is the ratio of the variance inside sites to that between them, by the method of moments:
the less sites differ beyond the noise of their documents, the more they are pulled to the parent. By Bayes' rule the
posterior log odds are the text's, plus the log odds of the path's share, less those of all documents' share. All sums are
grouped aggregates over every document, map-side combined, so a hot host is a few partial sums; sites' rows are joined back salted.

Defined cases: a null or empty text has the form of an empty one and no words; null hosts and paths are levels of their own; a null id is
scored like others; repeated rows get repeated results and count as often in the levels; without labels of both kinds
the classifier says 0.5 of every text and all is kept; an empty table gives an empty one; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.textvec import _SPACE, U, chunks, mix, word_hashes, words
from sievegrid.session import stage

#: Marks of a text's form: shares of symbols, capitals, digits and bars among characters, number and length of words, and
#: shares of repeated words, 3-word windows and lines.
SHAPES = 9
STEPS = 24
BITS = 18


def _repeated(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The share of each row's values that equal an earlier one of the row."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    again = np.zeros(len(r), bool)
    again[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return np.bincount(r, again, minlength=rows) / np.maximum(np.bincount(r, minlength=rows), 1)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, steps of the shapes, row, word feature) by chunk; a word counts once a text."""
    kinds = np.zeros((4, 256))
    kinds[0, [ord(c) for c in "#*$%&<>!"]] = 1
    kinds[1, 65:91] = 1
    kinds[2, 48:58] = 1
    kinds[3, ord("|")] = 1
    for first, last, data, offsets in chunks(texts):
        starts, ends, row = words(data, offsets)
        rows = last - first
        solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        total = np.maximum(solid[offsets[1:]] - solid[offsets[:-1]], 1)
        out = np.zeros((rows, SHAPES))
        for k in range(4):
            sums = np.concatenate([[0], np.cumsum(kinds[k][data])])
            out[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / total
        n = np.bincount(row, minlength=rows)
        out[:, 4] = np.log1p(n) / np.log(1 + 1e6)
        out[:, 5] = np.minimum(total / np.maximum(n, 1) / 20, 1)
        hashes = word_hashes(data, starts, ends)
        out[:, 6] = _repeated(row, hashes, rows)
        if len(row) > 2:
            whole = row[2:] == row[:-2]
            windows = mix(mix(hashes[:-2] + U(1)) + mix(hashes[1:-1] + U(2)) * U(3) + hashes[2:])
            out[:, 7] = _repeated(row[2:][whole], windows[whole], rows)
        if len(row):
            line = np.cumsum(data == 10)[starts]
            begins = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
            at = np.flatnonzero(begins)
            place = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
            lines = np.add.reduceat(mix(hashes + mix(place.astype(U) + U(11))), at)
            out[:, 8] = _repeated(row[at], lines, rows)
        key = np.unique((row.astype(np.int64) << BITS) | (hashes >> U(64 - BITS)).astype(np.int64))
        yield first, last, np.minimum((np.sqrt(np.clip(out, 0, 1)) * STEPS).astype(int), STEPS - 1), key >> BITS, key & ((1 << BITS) - 1)


class Logistic:
    """Logistic regression on words and on steps of the shapes.

    A word's value is how far the share of good sample documents that hold it is from the base rate, in standard deviations.
    Each step of a shape has a weight, pulled to its neighbours.
    """

    def __init__(self, table: np.ndarray, base: float, weights: np.ndarray) -> None:
        self.table, self.base, self.weights = table, base, weights

    def log_odds(self, steps: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return self.base + self.table[np.arange(SHAPES)[None], steps].sum(1) + np.bincount(row, self.weights[feature], minlength=len(steps))

    @classmethod
    def fit(cls, steps: np.ndarray, row: np.ndarray, feature: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.05, penalty: float = 2e-3, least_rows: int = 5) -> Logistic:
        n, size, share = len(y), 1 << BITS, np.clip(y.mean(), 1e-3, 1 - 1e-3)
        seen, good = np.bincount(feature, minlength=size).astype(float), np.bincount(feature, y[row], minlength=size)
        scale = np.where(seen >= least_rows, (good - seen * share) / np.sqrt(seen * share * (1 - share) + 3) / 3, 0.0)
        telling = scale[feature] != 0
        row, value = row[telling], scale[feature[telling]]
        used, feature = np.unique(feature[telling], return_inverse=True)
        cells = SHAPES * STEPS
        w, base = np.zeros(cells + len(used)), float(np.log(share / (1 - share)))
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        columns = np.arange(SHAPES)[None] * STEPS + steps
        for step in range(1, rounds + 1):
            z = base + w[columns].sum(1) + np.bincount(row, w[cells + feature] * value, minlength=n)
            off = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
            table = w[:cells].reshape(SHAPES, STEPS)
            near = np.zeros_like(table)
            near[:, 1:] += table[:, 1:] - table[:, :-1]
            near[:, :-1] += table[:, :-1] - table[:, 1:]
            g = np.concatenate([np.bincount(columns.ravel(), np.repeat(off, SHAPES), minlength=cells) + penalty * (table * 0.1 + near).ravel(), np.bincount(feature, off[row] * value, minlength=len(used)) + penalty * w[cells:]])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(size)
        weights[used] = w[cells:] * scale[used]
        return cls(w[:cells].reshape(SHAPES, STEPS), base, weights)


def fit_classifier(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 8000) -> Logistic | None:
    """Fit on at most ``sample`` labelled rows, chosen by the id's hash. None if one class alone occurs."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), label.cast("int").alias("y")).where("id is not null and y is not null").distinct()
    chosen = known.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, steps, row, feature in features(batch.column(1)):
                per = np.split(feature.astype(np.int32), np.cumsum(np.bincount(row, minlength=last - first))[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(list(steps.astype(np.int32)), pa.list_(pa.int32())), pa.array(per, pa.list_(pa.int32()))], names=["id", "y", "steps", "feature"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y int, steps array<int>, feature array<int>").orderBy(F.xxhash64("id", F.lit(31)), "id", "y", F.hash("feature", "steps")).limit(sample).toPandas()
    if got["y"].nunique() < 2:
        return None
    row = np.repeat(np.arange(len(got)), got["feature"].map(len).to_numpy())
    return Logistic.fit(np.stack(got["steps"].to_numpy()), row, np.concatenate(got["feature"].to_list()).astype(np.int64), got["y"].to_numpy().astype(float))


def _strength(levels: DataFrame, parent: str) -> float:
    """k of a level by moments, from (n, sum, squares, parent's share): within-site over between-site variance."""
    row = levels.where("n >= 2").agg(
        F.sum(F.col("squares") - F.col("sum") * F.col("sum") / F.col("n")).alias("inside"),
        F.sum(F.col("n") - 1).alias("free"),
        F.sum(F.col("n") * F.pow(F.col("sum") / F.col("n") - F.col(parent), 2)).alias("between"),
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not row["sites"] or not row["free"]:
        return 1e6
    within = max(row["inside"] / row["free"], 1e-9)
    tau = (row["between"] - row["sites"] * within) / row["rows"]
    return float(min(within / tau, 1e6)) if tau > 0 else 1e6


def site_quality(
    docs: DataFrame,
    model: Logistic | None,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: float = 0.5,
) -> DataFrame:
    """(id, p_text, host_share, path_share, p_good, kept), a row a document; the shares are of the other documents, shrunk."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(host.cast("string").alias("name")).alias("host"), F.struct(path.cast("string").alias("name")).alias("path"))
    id_kind, site = base.schema["id"].dataType.simpleString(), "struct<name:string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, steps, row, feature in features(batch.column(1)):
                z = np.clip(model.log_odds(steps, row, feature), -12, 12) if model else np.zeros(len(steps))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, last - first) for i in (0, 2, 3)] + [pa.array(z), pa.array(1 / (1 + np.exp(-z)))], names=["id", "host", "path", "z", "p"])

    scored = stage(base.mapInArrow(run, f"id {id_kind}, host {site}, path {site}, z double, p double"), "text-scores")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = stage(scored.groupBy("host", "path").agg(*sums), "path-sums")
    share = paths.agg(F.sum("sum") / F.sum("n")).first()[0]
    share = 0.5 if share is None else float(share)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares")).withColumn("all_share", F.lit(share))
    k_host = _strength(hosts, "all_share")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("sum").alias("host_sum"), ((F.col("sum") + k_host * F.col("all_share")) / (F.col("n") + k_host)).alias("host_all"))
    paths = stage(paths.join(hosts, "host"), "path-levels")
    k_path = _strength(paths, "host_all")
    salted = paths.select("host", "path", "n", "sum", "host_n", "host_sum").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    joined = scored.withColumn("salt", F.pmod(F.hash("id", "z"), F.lit(32))).join(salted, ["host", "path", "salt"])
    joined = joined.withColumn("host_share", (F.col("host_sum") - F.col("p") + k_host * share) / (F.col("host_n") - 1 + k_host))
    joined = joined.withColumn("path_share", (F.col("sum") - F.col("p") + k_path * F.col("host_share")) / (F.col("n") - 1 + k_path))
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    log_odds = lambda x: F.log(inside(x) / (1 - inside(x)))
    good = 1 / (1 + F.exp(-(F.col("z") + log_odds(F.col("path_share")) - log_odds(F.lit(share)))))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("p_text"), "host_share", "path_share", good.alias("p_good"), (good >= cut).alias("kept"))
