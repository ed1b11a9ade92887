"""A run: all arms fitted together over shared parts, federated rounds that resume, every arm scored in one scan and counted.

Training rows are staged once as parts by data set (what an exposure condition leaves) and holder. A grid point, an arm and a
seed are rows joined to the parts, so a job fits many at once: one for all local fits, one a federated round for all federated arms.
Along a grid of epochs the smaller ones are stops of the largest fit. The state after each federated round is a table of its
own under the run's path, complete or absent; a run that was stopped goes on from the last complete one.

Scoring reads features once: the first layers of all arms are one matrix, scores an array with a place an arm. Thresholds, hits and
curves are then made of scores only, by partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import evaluation as E
from sievegrid.operators.learners import Training, derive_seed, fit_many, parts_of, robust_states, unflat
from sievegrid.session import stage

#: Bytes of all models that a pass of scoring gives its workers.
MODEL_BYTES = 1 << 28
#: Copies of a round's states, so that parts of one data set don't meet them in one task.
SALTS = 16


@dataclass(frozen=True)
class Arm:
    """learner: local, central, federated, finetune or blend. data: its training rows. base, other: arms that it goes on from or blends."""

    name: str
    learner: str
    data: str = "peer-present"
    epochs: int = 2
    proximal: float = 0.0
    rule: str = "mean"
    base: str | None = None
    other: str | None = None
    weight: float = 0.5


def shared_parts(trainings: dict[str, DataFrame], t: Training, bound: int) -> tuple[DataFrame, DataFrame]:
    """(parts by data and client, parts by data), staged: of (client, label, features) a data set.

    ``bound`` is the most rows that a data set may have for all its holders by its budget: within it every fit is one plain fit.
    """
    whole = None
    for name, rows in trainings.items():
        named = rows.select(F.lit(name).alias("data"), "client", "label", "features")
        whole = named if whole is None else whole.unionByName(named)
    whole = stage(whole, "trainings")
    wide = replace(t, part=max(bound, t.part))
    return stage(parts_of(whole, ["data", "client"], wide), "parts"), stage(parts_of(whole.drop("client"), ["data"], wide), "pooled-parts")


def _fits(parts: DataFrame, arms: list[Arm], t: Training) -> DataFrame:
    """Fits from t's own first weights: one a part, with a stop at each number of epochs that an arm of its data wants."""
    stops: dict[str, set[int]] = {}
    for a in arms:
        stops.setdefault(a.data, set()).add(a.epochs)
    at = parts.sparkSession.createDataFrame([(d, sorted(e)) for d, e in stops.items()], "data string, at array<int>")
    return parts.join(at, "data").withColumns({"start": F.lit(None).cast("array<double>"), "proximal": F.lit(0.0)})


def _named(fitted: DataFrame, arms: list[Arm], keys: list[str]) -> DataFrame:
    names = fitted.sparkSession.createDataFrame([(a.name, a.base or a.data, a.epochs) for a in arms], f"arm string, {keys[0]} string, epochs int")
    rows = fitted if "client" in keys else fitted.withColumn("client", F.lit(None).cast("string"))
    return rows.join(names, [keys[0], "epochs"]).select("arm", "client", "rows", "loss", "weights")


def rounds_done(spark: SparkSession, path: str) -> int:
    """The last round whose table is complete."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    whole = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("round=")]
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return max((int(p.getName().partition("=")[2]) for p in whole if fs.exists(marks(p, "_SUCCESS"))), default=0)


def federate(parts: DataFrame, arms: list[Arm], t: Training, rounds: int, path: str) -> DataFrame:
    """(arm, rows, loss, finite, weights) after ``rounds`` rounds; ``path`` keeps every round's table and is gone on from."""
    spark = parts.sparkSession
    known = spark.createDataFrame([(a.name, a.data, float(a.proximal), a.rule) for a in arms], "arm string, data string, proximal double, rule string")
    kind = "arm string, rows long, loss double, finite boolean, weights array<double>"
    dealt = parts.withColumn("salt", F.pmod(F.xxhash64("client", "labels"), F.lit(SALTS)).cast("int"))
    for r in range(rounds_done(spark, path), rounds):
        if r == 0:
            state = known.withColumn("start", F.lit(None).cast("array<double>"))
        else:
            state = known.join(spark.read.schema(kind).parquet(f"{path}/round={r}").select("arm", F.col("weights").alias("start")), "arm")
        state = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fits = dealt.join(state, ["data", "salt"]).withColumns({"at": F.array(F.lit(t.epochs)), "seed": F.lit(derive_seed(t.seed, r))})
        mean = fit_many(fits.where("rule = 'mean'"), ["arm"], t).select("arm", "rows", "loss", "weights")
        for rule in sorted({a.rule for a in arms} - {"mean"}):
            mean = mean.unionByName(_robust_round(fit_many(fits.where(F.col("rule") == rule), ["arm", "client"], t), rule))
        finite = F.forall("weights", lambda w: F.abs(w) < float("inf"))
        mean.select("arm", "rows", "loss", F.coalesce(finite, F.lit(False)).alias("finite"), "weights").write.mode("overwrite").parquet(f"{path}/round={r + 1}")
    return spark.read.schema(kind).parquet(f"{path}/round={rounds}")


def _robust_round(fitted: DataFrame, rule: str) -> DataFrame:
    fitted = stage(fitted, "holder-states")
    told = fitted.groupBy("arm").agg(F.sum("rows").alias("rows"), (F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss"))
    states = robust_states(fitted.select("arm", "client", "rows", F.posexplode("weights").alias("pos", "weight")), ["arm"], rule)
    weights = states.groupBy("arm").agg(F.sort_array(F.collect_list(F.struct("pos", "weight")))["weight"].alias("weights"))
    return told.join(weights, "arm")


def round_records(spark: SparkSession, path: str) -> DataFrame:
    """(round, arm, rows, loss, finite) of every complete round."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/round={r}" for r in range(1, rounds_done(spark, path) + 1)]).select("round", "arm", "rows", "loss", "finite")


def train_arms(trainings: dict[str, DataFrame], arms: list[Arm], t: Training, rounds: int, path: str, bound: int) -> DataFrame:
    """(arm, client, rows, loss, weights) of all arms but blends, kept under ``path``; client is null where clients share a model."""
    spark = next(iter(trainings.values())).sparkSession
    local, pooled = shared_parts(trainings, t, bound)
    of = {k: [a for a in arms if a.learner == k] for k in ("local", "central", "federated", "finetune")}
    own_seed = F.xxhash64(F.lit(t.seed), "client").bitwiseAND(F.lit((1 << 63) - 1))
    found = []
    if of["local"]:
        found.append(_named(fit_many(_fits(local, of["local"], t).withColumn("seed", own_seed), ["data", "client"], t), of["local"], ["data", "client"]))
    if of["central"]:
        found.append(_named(fit_many(_fits(pooled, of["central"], t).withColumn("seed", F.lit(t.seed)), ["data"], t), of["central"], ["data"]))
    bases = {a.base for a in of["finetune"]}
    if of["federated"]:
        shared = federate(local, of["federated"], t, rounds, f"{path}/rounds")
        found.append(shared.select("arm", F.lit(None).cast("string").alias("client"), "rows", "loss", "weights"))
        if bases:
            data = {a.name: a.data for a in of["federated"]}
            stops = {b: sorted({a.epochs for a in of["finetune"] if a.base == b}) for b in bases}
            at = spark.createDataFrame([(b, data[b], stops[b]) for b in sorted(bases)], "base string, data string, at array<int>")
            begin = at.join(shared.select(F.col("arm").alias("base"), F.col("weights").alias("start")), "base")
            fits = local.join(begin, "data").withColumns({"proximal": F.lit(0.0), "seed": own_seed})
            found.append(_named(fit_many(fits, ["base", "client"], t), of["finetune"], ["base", "client"]))
    elif bases:
        raise ValueError("fine-tuned arms need the federated arms that they go on from")
    models = found[0]
    for more in found[1:]:
        models = models.unionByName(more)
    models.write.mode("overwrite").parquet(f"{path}/models")
    return spark.read.schema(models.schema).parquet(f"{path}/models")


def score_arms(pools: DataFrame, names: list[str], models: DataFrame, t: Training, limit: int = MODEL_BYTES) -> DataFrame:
    """The rows of pools with ``scores``: a logit an arm, null where the arm has no model for the row's pool.

    Models are given to workers in blocks of at most ``limit`` bytes; blocks follow each other within one scan.
    """
    blocks: list[list[tuple[int, str | None, np.ndarray]]] = [[]]
    size = 0
    for r in models.select("arm", "client", "weights").orderBy("arm", "client").toLocalIterator():  # a row an arm and client
        weights = np.asarray(r["weights"], float)
        if r["arm"] in names:
            if blocks[-1] and size + weights.nbytes > limit:
                blocks.append([])
                size = 0
            blocks[-1].append((names.index(r["arm"]), r["client"], weights))
            size += weights.nbytes
    out = pools.withColumn("scores", F.array_repeat(F.lit(None).cast("double"), len(names)))
    for block in blocks:
        out = out.mapInArrow(_scorer(block, t, len(names)), out.schema)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` numbers a list, null as not a number."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), width)


def _scorer(models: list[tuple[int, str | None, np.ndarray]], t: Training, arms: int):  # noqa: ANN202
    def heads(pool: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[np.ndarray]]]]:
        states = [(at, unflat(w, t)) for at, client, w in models if client is None or client == pool]
        if not states:
            return np.zeros((t.width, 0)), np.zeros(0), []
        return np.concatenate([s[0] for _, s in states], axis=1), np.concatenate([s[1] for _, s in states]), [(at, s[2:]) for at, s in states]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            scores, x = _matrix(b.column("scores"), arms).copy(), _matrix(b.column("features"), t.width)
            pools = b.column("pool").dictionary_encode()
            codes = pools.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code, pool in enumerate(pools.dictionary.to_pylist()):
                rows = np.flatnonzero(codes == code)
                if pool not in made:
                    made[pool] = heads(pool)
                matrix, bias, rest = made[pool]
                z, a = x[rows] @ matrix + bias, 0
                for at, layers in rest:
                    width = layers[0].shape[0] if layers else 1
                    h = z[:, a : a + width]
                    a += width
                    for k in range(0, len(layers), 2):
                        h = np.maximum(h, 0) @ layers[k] + layers[k + 1]
                    scores[rows, at] = h[:, 0]
            place, kind = b.schema.get_field_index("scores"), b.schema.field("scores").type
            flat = pa.array(scores.ravel(), mask=np.isnan(scores).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * arms), flat)
            yield pa.RecordBatch.from_arrays([lists.cast(kind) if i == place else c for i, c in enumerate(b.columns)], b.schema.names)

    return run


def blended(scored: DataFrame, names: list[str], arms: list[Arm]) -> DataFrame:
    """With the scores of blends in their places."""
    place = {n: i for i, n in enumerate(names)}
    mixed = {place[a.name]: E.blend(F.get("scores", F.lit(place[a.base])), F.get("scores", F.lit(place[a.other])), a.weight) for a in arms if a.learner == "blend"}
    return scored.withColumn("scores", F.array(*[mixed.get(i, F.get("scores", F.lit(i))) for i in range(len(names))])) if mixed else scored


@dataclass(frozen=True)
class RunTables:
    thresholds: DataFrame
    clients: DataFrame
    families: DataFrame
    discrimination: DataFrame
    summary: DataFrame


def evaluate_arms(scored: DataFrame, names: list[str], alphas: list[float], min_exceedances: int, own_min: int, row: str, feature: str) -> RunTables:
    """The tables of all arms from (pool, role, label, own, unseen, family, row, feature, scores).

    ``scored`` is read several times and has no features: stage it. An arm without scores at a pool has no rows there.
    """
    arms = F.array(*[F.lit(n) for n in names])
    each = lambda rows, *columns: rows.select(F.col("pool").alias("client"), *columns, F.posexplode("scores").alias("_at", "score")).where("score is not null").withColumn("arm", arms[F.col("_at")]).drop("_at")
    both = each(scored.where("own and role in ('calibration', 'test')"), "label", F.col("role").alias("split"))
    found, discrimination = E.calibrated_discrimination(both, ["arm", "client"], alphas, min_exceedances)
    told = scored.where("own").select(F.col("pool").alias("client"), F.transform("scores", lambda s: s.isNotNull()).alias("told")).distinct()  # a row a client and set of arms
    pairs = told.select("client", F.posexplode("told").alias("_at", "_told")).where("_told").select(arms[F.col("_at")].alias("arm"), "client").distinct()
    thresholds = stage(E.with_missing_thresholds(found, pairs, alphas, ["arm"]), "thresholds")

    test = scored.where("role = 'test'")
    populations = each(test, F.explode(E.population_of()).alias("population"))
    clients = E.count_hits(populations, thresholds, ["arm", "client"], ["population"])
    grid = thresholds.select("arm", "client", "alpha").withColumn("population", F.explode(F.array(*[F.lit(p) for p in E.POPULATIONS])))
    clients = grid.join(clients, ["arm", "client", "alpha", "population"], "left").na.fill(0, ["hits", "trials"])
    families = E.count_hits(each(E.hidden_first(test, row, feature), "population", "family", "first"), thresholds, ["arm", "client"], ["population", "family"], F.col("first"))

    clients, families, discrimination = (stage(x, n) for x, n in ((clients, "client-counts"), (families, "family-counts"), (discrimination, "discrimination")))
    return RunTables(thresholds, clients, families, discrimination, E.summarise(clients, families, discrimination, thresholds, own_min, ["arm"]))


def execute_run(
    rows: DataFrame, targets: DataFrame, trainings: dict[str, DataFrame], arms: list[Arm], t: Training, rounds: int, path: str, bound: int, alphas: list[float], min_exceedances: int = 10, own_min: int = 5, row: str = "row", feature: str = "feature"
) -> RunTables:
    """From prepared rows (row, client, role, label, family, feature, features) to the tables of every arm.

    What was fitted before under ``path`` is fitted again but for federated rounds; fits are the same each time.
    """
    models = train_arms(trainings, arms, t, rounds, path, bound)
    names = [a.name for a in arms]
    pools = E.pools(rows.select(row, "client", "role", "label", "family", feature, "features"), targets)
    scored = blended(score_arms(pools, names, models, t), names, arms)
    return evaluate_arms(stage(scored.drop("features"), "scored"), names, alphas, min_exceedances, own_min, row, feature)


def grid_arms(local_epochs: list[int], proximal: list[float], finetune_epochs: list[int], data: str = "peer-present") -> tuple[list[Arm], list[tuple[str, str, float]]]:
    """(arms, points): the tuning grid's arms and (arm, parameter, tuning_value); the federated arm that fine-tuning goes on from comes first."""
    arms, points = [Arm("fedavg", "federated", data)], []
    for parameter, values, arm in (
        ("local-epochs", local_epochs, lambda n, v: Arm(n, "local", data, epochs=v)),
        ("proximal", proximal, lambda n, v: Arm(n, "federated", data, proximal=v)),
        ("finetune-epochs", finetune_epochs, lambda n, v: Arm(n, "finetune", data, epochs=v, base="fedavg")),
    ):
        for v in values:
            name = f"{parameter}={v}"
            arms.append(arm(name, v))
            points.append((name, parameter, float(v)))
    return arms, points
