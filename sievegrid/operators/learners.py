"""Detectors by holder: local, pooled, federated, fine-tuned and blended fits, and scoring.

A group's training rows are dealt by hash into parts of about ``Training.part`` rows; all rows are kept, and no worker holds more than
a few parts. Parts fit in parallel, and a group's weights are their mean by rows, so a group of one part is one plain fit: a study's
holders, whose rows a budget bounds, are. A federated round is one job: every part starts from the shared weights; parts are averaged
within holders, then holders by the rule. Weights are summed as arrays inside tasks, then in two steps across them. Only the
shared weights come to the driver. Rows that are equal in every column, whatever their number, share a part: give rows an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ordering import SALTS
from sievegrid.session import stage


@dataclass(frozen=True)
class Training:
    """hidden: sizes of ReLU layers; none for a linear model. proximal: pull to the weights a fit starts from. part: rows fitted at once."""

    width: int
    hidden: tuple[int, ...] = (32,)
    epochs: int = 2
    batch: int = 256
    rate: float = 0.01
    proximal: float = 0.0
    seed: int = 1
    part: int = 8192


def derive_seed(*parts: int | str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big") >> 1


def initial(t: Training) -> list[np.ndarray]:
    rng = np.random.default_rng(t.seed)
    sizes = (t.width, *t.hidden, 1)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
    return out


def _forward(state: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    layers = [x]
    for k in range(0, len(state), 2):
        z = layers[-1] @ state[k] + state[k + 1]
        layers.append(np.maximum(z, 0) if k + 2 < len(state) else z)
    return layers


def logits(state: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return _forward(state, x)[-1][:, 0]


def fit(state: list[np.ndarray], x: np.ndarray, y: np.ndarray, t: Training) -> tuple[list[np.ndarray], float]:
    """(state, mean loss of the last epoch): mini-batch Adam on the logistic loss."""
    if len(np.unique(y)) < 2:
        raise ValueError("a fit needs both classes")
    return _fit_part(state, x, y, t)


def _fit_part(state: list[np.ndarray], x: np.ndarray, y: np.ndarray, t: Training) -> tuple[list[np.ndarray], float]:
    """As fit(); a part may be of one class where its group has both."""
    loss = 0.0
    for _, state, loss in epochs_of(state, x, y, t):  # noqa: B007
        pass
    return state, loss


def epochs_of(state: list[np.ndarray], x: np.ndarray, y: np.ndarray, t: Training) -> Iterator[tuple[int, list[np.ndarray], float]]:
    """(epoch, state, mean loss) after each epoch: what a fit of so many epochs gives."""
    rng = np.random.default_rng(t.seed)
    anchor = [w.copy() for w in state]
    state = [w.copy() for w in state]
    m1, m2 = [np.zeros_like(w) for w in state], [np.zeros_like(w) for w in state]
    step = 0
    for epoch in range(1, t.epochs + 1):
        losses = []
        order = rng.permutation(len(x))
        for a in range(0, len(x), t.batch):
            rows = order[a : a + t.batch]
            layers = _forward(state, x[rows])
            z = layers[-1][:, 0]
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            losses.append(float(np.mean(np.logaddexp(0, z) - y[rows] * z)))
            g = ((p - y[rows]) / len(rows))[:, None]
            grads: list[np.ndarray] = [np.zeros(0)] * len(state)
            for k in range(len(state) - 2, -1, -2):
                grads[k], grads[k + 1] = layers[k // 2].T @ g, g.sum(0)
                g = (g @ state[k].T) * (layers[k // 2] > 0)
            step += 1
            for k in range(len(state)):
                d = grads[k] + t.proximal * (state[k] - anchor[k])
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * d, 0.999 * m2[k] + 0.001 * d * d
                state[k] = state[k] - t.rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        yield epoch, state, float(np.mean(losses))


def flat(state: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in state])


def unflat(vector: np.ndarray, t: Training) -> list[np.ndarray]:
    out, at = [], 0
    for w in initial(t):
        out.append(np.asarray(vector[at : at + w.size]).reshape(w.shape))
        at += w.size
    return out


def average_states(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, weight): means by rows trained on, of (key, holder, rows, pos, weight)."""
    return states.groupBy(*key, "pos").agg((F.sum(F.col("weight") * F.col("rows")) / F.sum("rows")).alias("weight"))


def robust_states(states: DataFrame, key: list[str], rule: str) -> DataFrame:
    """As average_states, by "trimmed" (without the least and the greatest) or "median" (the lower one); a value a holder."""
    w = F.sort_array(F.collect_list("weight"))
    if rule == "median":
        value = F.element_at(w, F.floor((F.size(w) + 1) / 2).cast("int"))
    else:  # the lone value or the mean of two where nothing is left between the least and the greatest
        cut = F.when(F.size(w) > 2, F.lit(1)).otherwise(F.lit(0))
        inner = F.slice(w, 1 + cut, F.size(w) - 2 * cut)
        value = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.size(inner)
    return states.groupBy(*key, "pos").agg(value.alias("weight"))


def parts_of(training: DataFrame, keys: list[str], t: Training) -> DataFrame:
    """(keys, labels, features): a row a part, its features one after another; groups of one class are left out.

    The hash is of all columns. Within a part, rows are in order of label and features, so a fit does not depend on the input's order.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    rows = training.withColumns({n: F.struct(F.col(f"`{k}`").alias("v")) for n, k in zip(names, keys, strict=True)} | {"_hash": F.xxhash64(*[F.col(f"`{c}`") for c in training.columns])})
    sizes = rows.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / F.lit(t.part)).alias("_parts"), F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least < _most")
    salted = sizes.select(*names, "_parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS)).cast("int")).join(salted, [*names, "_salt"])
    row = F.struct(F.col("label").cast("double").alias("y"), F.col("features").cast("array<double>").alias("x"))
    parts = placed.groupBy(*names, F.pmod("_hash", "_parts").alias("_part")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return parts.select(*[F.col(n)["v"].alias(k) for n, k in zip(names, keys, strict=True)], F.col("_rows.y").alias("labels"), F.flatten("_rows.x").alias("features"))


#: Bytes of sums that a task holds before it hands them on.
HELD = 1 << 26


def fit_many(parts: DataFrame, keys: list[str], t: Training) -> DataFrame:
    """(keys, epochs, rows, loss, weights): means by rows over the parts of the same keys; a row a key and number of epochs.

    A row of parts is a fit: (keys, labels, features, start, at, proximal, seed), where ``start`` are the weights to go on from, null for
    t's own first ones, and ``at`` the numbers of epochs, ascending, at which weights are wanted: fewer epochs are a stop on the way to more.
    """
    kinds = dict(parts.dtypes)
    first = flat(initial(t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                y, x = np.asarray(r.labels, float), np.asarray(r.features, float).reshape(len(r.labels), t.width)
                start = first if r.start is None else np.asarray(r.start, float)
                own = replace(t, epochs=int(max(r.at)), proximal=float(r.proximal), seed=int(r.seed))
                for epoch, state, loss in epochs_of(unflat(start, t), x, y, own):
                    if epoch in r.at:
                        key = (*(getattr(r, k) for k in keys), epoch)
                        sums[key] = sums.get(key, 0.0) + len(y) * np.concatenate([[1.0, loss], flat(state)])
            if sum(v.nbytes for v in sums.values()) > HELD:
                yield _sums(sums, keys)
                sums = {}
        if sums:
            yield _sums(sums, keys)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", epochs int, sums array<double>, salt int"
    out = parts.select(*keys, "labels", "features", "start", "at", "proximal", "seed").mapInPandas(run, schema)
    for group in ([*keys, "epochs", "salt"], [*keys, "epochs"]):
        out = out.groupBy(*group).applyInPandas(_added, out.schema)
    n = F.get("sums", F.lit(0))
    mean = F.transform(F.slice("sums", 3, len(first)), lambda w: w / n)
    return out.select(*keys, "epochs", F.round(n).cast("long").alias("rows"), (F.get("sums", F.lit(1)) / n).alias("loss"), mean.alias("weights"))


def _sums(sums: dict[tuple, np.ndarray], keys: list[str]) -> pd.DataFrame:
    from pyspark import TaskContext

    context = TaskContext.get()
    out = pd.DataFrame([dict(zip([*keys, "epochs"], k, strict=True)) for k in sums])
    return out.assign(sums=list(sums.values()), salt=(context.partitionId() if context else 0) % 32)


def _added(b: pd.DataFrame) -> pd.DataFrame:
    """One row, the sums added in an order of their own, so that reruns agree."""
    x = np.stack(b["sums"].to_numpy())
    return b.head(1).assign(sums=[x[np.lexsort(x[:, :3].T)].sum(axis=0)])


def as_fits(parts: DataFrame, t: Training, start: np.ndarray | None = None) -> DataFrame:
    """Each part as a fit of t."""
    begin = F.lit(None).cast("array<double>") if start is None else F.lit(start)
    return parts.withColumns({"start": begin, "at": F.array(F.lit(t.epochs)), "proximal": F.lit(float(t.proximal)), "seed": F.lit(t.seed)})


def fit_by(training: DataFrame, keys: list[str], t: Training, start: np.ndarray | None = None) -> DataFrame:
    """(keys, rows, loss, weights): one fit a group of (keys, features, label); groups of one class are left out."""
    return fit_many(as_fits(parts_of(training, keys, t), t, start), keys, t).drop("epochs")


def train_federated(training: DataFrame, holder: str, t: Training, rounds: int, rule: str = "mean") -> tuple[np.ndarray, list[dict]]:
    """(weights, trace): every round each holder fits from the shared weights, which are then averaged or made robustly."""
    shared, trace = flat(initial(t)), []
    parts = stage(parts_of(training, [holder], t).withColumn("all", F.lit(0)), "holder-parts")
    for r in range(rounds):
        fits = as_fits(parts, replace(t, seed=derive_seed(t.seed, r)), shared)
        if rule == "mean":
            got = fit_many(fits, ["all"], t).first()
            loss, shared = got["loss"], np.array(got["weights"])
        else:
            fitted = stage(fit_many(fits, [holder], t), "holder-states")
            loss = fitted.agg(F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).first()[0]
            states = robust_states(fitted.select(holder, "rows", F.posexplode("weights").alias("pos", "weight")), [], rule)
            shared = np.array([x["weight"] for x in states.orderBy("pos").collect()])  # a row a weight
        trace.append({"round": r, "loss": float(loss), "finite": bool(np.isfinite(shared).all())})
    return shared, trace


def finetune(training: DataFrame, holder: str, t: Training, shared: np.ndarray) -> DataFrame:
    """Each holder goes on from the shared weights on its own rows."""
    return fit_by(training, [holder], t, shared)


def score(rows: DataFrame, weights: np.ndarray, t: Training, out: str = "score") -> DataFrame:
    """The same rows with their logits, by Arrow batches."""
    columns = [f for f in rows.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = unflat(weights, t)
        for b in batches:
            yield b.assign(**{out: logits(state, np.stack(b["features"].to_numpy()).astype(float)) if len(b) else np.zeros(0)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + f", `{out}` double"
    return rows.mapInPandas(run, schema)
