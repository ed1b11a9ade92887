"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) is the logistic function of (threshold_k - w . x): one weight vector for all grades, thresholds in
order. x holds hashed words: a word that occurs counts by how far its share of toxic sample documents is from the base rate,
in standard deviations, so the many words of one or two documents don't drown the few that tell. The fit takes a bounded sample of labelled rows,
spread over documents by hash, at most a part of it of each grade. Grades that it cuts short weigh more in the likelihood, in the base rates
and in a word's share, each as its part of all labelled rows is to its part of the sample, so probabilities are those of
the labels at every number of labels; every document is scored, whole, where its text lies.

Defined cases: a null or empty text, or one without words, gets the labels' base rates; a null id is scored like others; labelled rows
that are null in a label are left out of the fit; repeated rows get repeated results; without labels of both kinds every
severity is null; an empty table gives an empty one; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.textvec import chunks, mix, word_hashes, words

BITS = 18


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row, feature), each once, by chunk; a word's trailing marks don't tell it apart."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, row = words(data, offsets)
        for _ in range(2):
            mark = (data[ends - 1] < 48) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
            ends = ends - mark
        feature = (mix(word_hashes(data, starts, ends)) >> np.uint64(64 - bits)).astype(np.int64)
        key = np.unique((row.astype(np.int64) << bits) | feature)
        yield first, last, key >> bits, key & ((1 << bits) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class CumulativeLink:
    """Grades 0 to K - 1 with shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, base: np.ndarray) -> None:
        self.weights, self.thresholds, self.base = weights, thresholds, base

    @classmethod
    def fit(cls, row: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 300, penalty: float = 1e-3, rate: float = 0.05, least_rows: int = 3, weight: np.ndarray | None = None) -> CumulativeLink:
        """Adam on the mean log-likelihood, of rows of ``weight``. The thresholds are the first one and the exponentials of their gaps."""
        n, size = len(grade), 1 << BITS
        weight = np.ones(n) if weight is None else weight * n / weight.sum()
        rows = np.bincount(feature, minlength=size)
        seen = np.bincount(feature, weight[row], minlength=size)
        toxic = np.bincount(feature, ((grade > 0) * weight)[row], minlength=size)
        share = ((grade > 0) * weight).mean()
        scale = np.where(rows >= least_rows, (toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 3) / 3, 0.0)
        telling = scale[feature] != 0
        row, value = row[telling], scale[feature[telling]]
        used, feature = np.unique(feature[telling], return_inverse=True)
        w = np.zeros(len(used))
        below = np.array([np.clip(((grade <= k) * weight).mean(), 1e-3, 1 - 1e-3) for k in range(grades - 1)])
        base = np.log(below / (1 - below))
        t = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
        m1, m2 = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
        for step in range(1, rounds + 1):
            cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
            z = np.bincount(row, w[feature] * value, minlength=n)
            upper = np.where(grade < grades - 1, _sigmoid(cuts[np.minimum(grade, grades - 2)] - z), 1.0)
            lower = np.where(grade > 0, _sigmoid(cuts[np.maximum(grade - 1, 0)] - z), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
            gz = (du - dl) / n
            gw = np.bincount(feature, gz[row] * value, minlength=len(w)) + penalty * w
            gcuts = -(np.bincount(np.minimum(grade, grades - 2), np.where(grade < grades - 1, du, 0), minlength=grades - 1) - np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dl, 0), minlength=grades - 1)) / n
            tail = np.cumsum(gcuts[::-1])[::-1]
            g = np.concatenate([gw, tail[:1], tail[1:] * np.exp(t[1:])])
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w, t = w - move[: len(w)], t - move[len(w) :] * 0.2
        weights = np.zeros(size)
        weights[used] = w * scale[used]
        return cls(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), np.bincount(grade, weight, minlength=grades) / n)

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        below = _sigmoid(self.thresholds[None] - z[:, None])
        return np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1), axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str, text_col: str, sample: int, grades: int) -> DataFrame:
    """Rows (id, text, grade, weight) of at most ``sample`` labelled ids, each grade's share at most its part of it; chosen by the id's hash.

    weight: labelled ids of the grade for each that is taken.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null").distinct()
    counts = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a grade
    share = lambda g: max(counts.get(g, 0) / (sample // grades), 1.0)
    parts = [known.where(F.col("grade") == g).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample // grades).withColumn("weight", F.lit(share(g))) for g in range(grades)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "grade", "weight")


def fit_toxicity(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> CumulativeLink | None:
    """Fit on features of at most ``sample`` labelled rows, made on the executors. None if one grade alone occurs."""
    rows = labelled_sample(docs, labels, grade, id_col, text_col, sample, grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, feature in features(batch.column(1)):
                per = np.split(feature.astype(np.int32), np.cumsum(np.bincount(row, minlength=last - first))[:-1])
                known = [batch.column(c).slice(first, last - first) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*known, pa.array(per, pa.list_(pa.int32()))], names=["id", "grade", "weight", "feature"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, grade int, weight double, feature array<int>").orderBy(F.xxhash64("id", F.lit(11)), "id", "grade", F.hash("feature")).limit(sample).toPandas()
    if got["grade"].nunique() < 2:
        return None
    size = got["feature"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), size)
    feature = np.concatenate(got["feature"].to_list()).astype(np.int64)
    return CumulativeLink.fit(row, feature, got["grade"].to_numpy(), grades, weight=got["weight"].to_numpy())


def score_toxicity(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, severity, p_toxic, grade, toxic): expected grade, P(grade >= 1), likeliest grade, p_toxic >= cut."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        nothing = {"severity": "double", "p_toxic": "double", "grade": "int", "toxic": "boolean"}
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, feature in features(batch.column(1)):
                p = model.probabilities(np.bincount(row, model.weights[feature], minlength=last - first))
                p[np.bincount(row, minlength=last - first) == 0] = model.base
                toxic = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(p @ np.arange(p.shape[1])), pa.array(toxic), pa.array(p.argmax(1).astype(np.int32)), pa.array(toxic >= cut)],
                    names=["id", "severity", "p_toxic", "grade", "toxic"],
                )

    return rows.mapInArrow(run, f"id {kind}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)
