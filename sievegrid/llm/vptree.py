"""Approximate nearest neighbours by vantage-point trees, one a shard, with relaxed pruning.

Vectors are dealt to bands of like norm (within ``RATIO``). In a band largest inner product becomes least distance by one more component:
vectors x, divided by the band's largest norm M, get sqrt(1 - |x|^2), and queries, made units, get 0; then the square of their distance
is 2 - 2 (q . x) / (|q| M). Were all norms in one band, long vectors would push the others together, far from every query, and
relaxed pruning would cut them all. A band's vectors are dealt to the nearest of a few pivots (from a bounded sample; every vector is
indexed), cells to shards of at most about ``shard_rows``.

A query's cells are ordered by the greatest inner product that the triangle inequality and the planes between pivots allow. It
searches the first cell, then the next 3, 12, 48 and so on, each round with the bound that the rounds before left, and
keeps its k + 1 best classes after each. A cell or branch is passed over if it lies beyond the bound, which is the kth score as a distance
in its band, times ``factor``: 1 is exact, less prunes more.
Only what beats the bound leaves a shard, so a query has a bounded number of candidates a round, whatever the table's size.

Equal vectors are one class, indexed and asked once; a class takes at most k + 1 of its smallest ids into a result, which is all a query
can use. Shards give the inner product of the original vectors in double precision, so vectors are not joined again.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or hold null or non-finite components
take no part, nor do rows without an id; rows that repeat an id and vector count once; an empty table gives an empty result; inner
products too large for a double are infinite and compare as those of scaled vectors; ids may have any type, but must be whole
numbers unless ``asked`` says which rows are queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.session import stage, unstage

LEAF = 256
#: Components of all vectors of a shard, at most.
SHARD_CELLS = 1 << 22
#: Greatest over least norm of a band; norms below 2^-LOW of the largest share one.
RATIO = 1.1
LOW = 300
#: What rounding may take from a distance between unit vectors.
SLACK = 1e-7


class VantageTree:
    """A vantage-point tree over rows of ``points``; queries go down it together."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1) -> None:
        self.points, self.leaf = points, leaf
        self.squares = (points * points).sum(1)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return ("leaf", rows)
        vantage = rows[self.rng.integers(len(rows))]
        rest = rows[rows != vantage]
        away = np.sqrt(np.maximum(((self.points[rest] - self.points[vantage]) ** 2).sum(1), 0.0))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        near, far = order[:half], order[half:]
        bounds = (away[near].min(), away[near].max(), away[far].min(), away[far].max())
        return ("node", vantage, bounds, self._build(rest[near]), self._build(rest[far]))

    def search(self, queries: np.ndarray, k: int, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k nearest within bound, -1 and inf where there are fewer."""
        self.best = np.full((len(queries), k), np.inf)
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.bound, self.factor, self.queries = bound.astype(float).copy(), factor, queries
        self.lengths = (queries * queries).sum(1)
        self.visited = 0
        if len(self.points):
            self._visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def _offer(self, q: np.ndarray, rows: np.ndarray, away: np.ndarray) -> None:
        self.visited += away.size
        near = away <= self.bound[q][:, None]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        q, away = q[some], np.where(near[some], away[some], np.inf)
        k = self.best.shape[1]
        both = np.concatenate([self.best[q], away], axis=1)
        names = np.concatenate([self.rows[q], np.where(np.isfinite(away), rows, -1)], axis=1)
        take = np.argpartition(both, k - 1, axis=1)[:, :k]
        self.best[q] = np.take_along_axis(both, take, 1)
        self.rows[q] = np.take_along_axis(names, take, 1)
        self.bound[q] = np.minimum(self.bound[q], self.best[q].max(axis=1))

    def _distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.lengths[q][:, None] + self.squares[rows][None] - 2 * self.queries[q] @ self.points[rows].T, 0.0))

    def _visit(self, node: tuple, q: np.ndarray) -> None:
        if not len(q):
            return
        if node[0] == "leaf":
            if len(node[1]):
                self._offer(q, node[1], self._distances(q, node[1]))
            return
        _, vantage, (near_low, near_high, far_low, far_high), near, far = node
        away = self._distances(q, np.array([vantage]))
        self._offer(q, np.array([vantage]), away)
        d = away[:, 0]
        first = d <= (near_high + far_low) / 2

        def alive(rows: np.ndarray, low: float, high: float) -> np.ndarray:
            reach = self.bound[q[rows]] * self.factor + SLACK
            return rows[(d[rows] - reach <= high) & (d[rows] + reach >= low)]

        inner, outer = np.flatnonzero(first), np.flatnonzero(~first)
        self._visit(near, q[alive(inner, near_low, near_high)])
        self._visit(far, q[alive(outer, far_low, far_high)])
        self._visit(far, q[alive(inner, far_low, far_high)])
        self._visit(near, q[alive(outer, near_low, near_high)])


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("vector"))
    return base.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    factor: float = 0.4,
    sample: int = 4096,
    shard_rows: int = 8192,
    query_block: int = 1024,
    asked: Column | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row whose id is divisible by ``every``, or for which ``asked``, of id, holds.

    ``sample`` bounds the rows that choose the pivots: one for each ``shard_rows`` vectors of a band, at most sample / 4 beside one a band.
    A shard meets its queries in blocks of about ``query_block``, as many as it has queries for.
    """
    sound = stage(_sound(vectors, id_col, vector_col).distinct(), "sound-vectors")
    spark = vectors.sparkSession
    kind = sound.schema["id"].dataType.simpleString()
    sizes = sound.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    dim, scale = sizes[0]["d"], float(2.0 ** (np.frexp(sizes[0]["most"])[1] - 1))
    shard_rows = max(min(shard_rows, SHARD_CELLS // dim), 1)
    digest = F.struct(F.xxhash64("vector"), F.hash("vector"), F.element_at("vector", 1).alias("x"))
    sound = sound.where(F.size("vector") == dim).withColumn("class", digest)

    smallest = Window.partitionBy("class").orderBy("id")
    ranked = sound.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    classes = ranked.groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vector").alias("vector"))
    asking = sound.where((F.pmod("id", F.lit(every)) == 0) if asked is None else asked).select("class", "id")
    classes = classes.join(asking.select("class").distinct().withColumn("asked", F.lit(True)), "class", "left")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))
    band = F.floor(F.log(F.greatest(norm, F.lit(2.0**-LOW))) / float(np.log(RATIO)))
    classes = stage(classes.select("class", F.col("ids")[0].alias("rep"), "ids", "vector", F.col("asked").isNotNull().alias("asked"), norm.alias("norm"), band.cast("int").alias("band")), "vector-classes")

    order = F.xxhash64("rep", F.lit(5))
    bands = classes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.min_by("vector", order).alias("vector")).orderBy("band").collect()  # norms are within 2^LOW
    drawn = classes.orderBy(order).limit(sample).select("band", "vector").collect()
    pivots = _Pivots(bands, drawn, scale, shard_rows, sample // 4)

    kept = stage(classes.select("rep", "vector", "band").mapInArrow(pivots.place, f"rep {kind}, vector array<double>, cell long, away double"), "cells")
    cells = kept.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("away").alias("inner")).withColumn("shards", F.ceil(F.col("n") / F.lit(shard_rows)))
    layout = cells.orderBy("cell").collect()  # a row a pivot: bounded by the sample
    index = kept.join(F.broadcast(cells.select("cell", "shards")), "cell").select("cell", F.pmod(F.xxhash64("rep", F.lit(9)), "shards").alias("shard"), "rep", "vector")

    plan = _Cells(pivots, layout)
    asks = classes.where("asked").select("rep", "vector")
    best, first, width = None, 0, 1
    while first < len(layout):
        bounds = None if best is None else best.where(F.col("at") == k + 1).select(F.col("query").alias("rep"), F.col("near").alias("kth"))
        queries = asks.withColumn("kth", F.lit(None).cast("double")) if bounds is None else asks.join(bounds, "rep", "left").select("rep", "vector", "kth")
        routed = stage(queries.mapInArrow(plan.route(first, first + width, factor), f"cell long, shard long, bound double, rep {kind}, vector array<double>"), "routed")
        found = _searched(index, routed, pivots, k, factor, query_block, kind)
        if found is not None:
            found = found if best is None else found.unionByName(best.select("query", "rep", "score", "near"))
            found = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("near"), "rep"))).where(F.col("at") <= k + 1)
            before, best = best, stage(found, "nearest")
            if before is not None:
                unstage(before)
        unstage(routed)
        first, width = first + width, 3 * (first + width)

    if best is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    pairs = best.join(classes.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("id"), (-F.col("score")).alias("less"))
    lists = pairs.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("less", "id"))), 1, k + 1).alias("near"))
    answers = classes.where("asked").select("class", F.col("rep").alias("query")).join(lists, "query").select("class", "near")
    told = asking.join(answers, "class").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return told.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.id", (-F.col("x.less")).alias("score"))


class _Pivots:
    """Bands and their pivots, as points on the unit sphere of one more dimension."""

    def __init__(self, bands: list, drawn: list, scale: float, shard_rows: int, most: int) -> None:
        self.scale = scale
        self.reach = {r["band"]: max(r["norm"], 2.0**-1000) for r in bands}
        wanted = {r["band"]: -(-r["n"] // shard_rows) for r in bands}
        share = min(1.0, most / sum(wanted.values()))
        points, owner = [], []
        for r in bands:
            own = [r["vector"]] + [d["vector"] for d in drawn if d["band"] == r["band"] and d["vector"] != r["vector"]]
            own = own[: max(1, int(wanted[r["band"]] * share))]
            points.append(_lift(np.array(own, float) / scale / self.reach[r["band"]]))
            owner += [r["band"]] * len(own)
        self.points, self.band = np.concatenate(points), np.array(owner)
        self.norm = np.array([self.reach[b] for b in owner])

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, band = _matrix(batch.column(1)) / self.scale, batch.column(2).to_numpy(zero_copy_only=False)
            cell, least = np.zeros(len(x), np.int64), np.zeros(len(x))
            for b in np.unique(band):
                rows, own = np.flatnonzero(band == b), np.flatnonzero(self.band == b)
                away = _away(_lift(x[rows] / self.reach[b]), self.points[own])
                cell[rows], least[rows] = own[away.argmin(1)], away.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(least)], names=["rep", "vector", "cell", "away"])


class _Cells:
    """Where queries go: their cells by the greatest inner product that points in them can have."""

    def __init__(self, pivots: _Pivots, layout: list) -> None:
        self.names, self.shards, self.radius, self.inner = (np.array([r[c] for r in layout]) for c in ("cell", "shards", "radius", "inner"))
        self.points, self.norm, self.scale = pivots.points[self.names], pivots.norm[self.names], pivots.scale
        band = pivots.band[self.names]
        self.bands = [np.flatnonzero(band == b) for b in np.unique(band)]
        self.apart = [np.maximum(_away(self.points[own], self.points[own]), 1e-12) for own in self.bands]

    def least(self, away: np.ndarray) -> np.ndarray:
        """The greatest of three lower bounds: cells are within balls and rings about their pivots, and beyond the planes between a band's pivots."""
        out = np.maximum(np.maximum(away - self.radius, self.inner - away), 0.0)
        for own, apart in zip(self.bands, self.apart, strict=True):
            near = away[:, own]
            home = near.argmin(1)
            plane = (near**2 - near.min(1)[:, None] ** 2) / (2 * apart[home])
            plane[np.arange(len(near)), home] = 0.0
            out[:, own] = np.maximum(out[:, own], plane)
            out[np.arange(len(near)), own[home]] = 0.0
        return out

    def route(self, first: int, last: int, factor: float) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    x = _matrix(part.column(1)) / self.scale
                    kth = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                    length = np.sqrt((x * x).sum(1))
                    known = np.isfinite(kth) & (length > 0)
                    score = np.where(known, kth, 0.0) / np.where(known, length, 1.0)
                    square = np.where(known[:, None], 2 - 2 * score[:, None] / self.norm, np.inf)
                    bound = np.sqrt(np.maximum(square, 0.0)) + SLACK
                    least = self.least(_away(_aim(x), self.points))
                    cell = np.argsort(-self.norm * (1 - least * least / 2), axis=1, kind="stable")[:, first:last]
                    alive = (least <= bound * factor + SLACK) & (square >= -SLACK)
                    who, at = np.nonzero(np.take_along_axis(alive, cell, 1))
                    cell = cell[who, at]
                    times = self.shards[cell]
                    who, cell = np.repeat(who, times), np.repeat(cell, times)
                    shard = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                    names = part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(self.names[cell]), pa.array(shard), pa.array(bound[who, cell]), *names], names=["cell", "shard", "bound", "rep", "vector"])

        return run


def _searched(index: DataFrame, routed: DataFrame, pivots: _Pivots, k: int, factor: float, query_block: int, kind: str) -> DataFrame | None:
    """(query, rep, score, near) of the k + 1 best of each shard that are within the query's bound; None if nothing is routed.

    ``near`` is the inner product of the scaled vectors, finite where the score is not.
    """
    load = routed.where("shard = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).alias("blocks")).collect()  # a row a pivot
    if not load:
        return None
    blocks = F.create_map(*[F.lit(x) for r in load for x in (r["cell"], r["blocks"])])
    left = index.withColumn("blocks", blocks[F.col("cell")]).where("blocks is not null")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    right = routed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), blocks[F.col("cell")]))
    norms, scale = pivots.norm, pivots.scale

    def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for d in range(q.shape[1]):
            out += q[:, d] * x[:, d]
        return out

    def both(key: tuple, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query": [], "rep": [], "score": [], "near": []})
        x, q = np.stack(points["vector"].to_numpy()), np.stack(queries["vector"].to_numpy())
        rows, _ = VantageTree(_lift(x / scale / norms[key[0]])).search(_aim(q / scale), k + 1, queries["bound"].to_numpy(), factor)
        who, at = np.nonzero(rows >= 0)
        row = rows[who, at]
        with np.errstate(over="ignore", invalid="ignore"):
            score = products(q[who], x[row])
            near = score / scale / scale
            wide = ~np.isfinite(score)
            near[wide] = products(q[who[wide]] / scale, x[row[wide]] / scale)
            score[wide] = near[wide] * scale * scale
        return pd.DataFrame({"query": queries["rep"].to_numpy()[who], "rep": points["rep"].to_numpy()[row], "score": score, "near": near})

    keys = ["cell", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(both, f"query {kind}, rep {kind}, score double, near double")


def _lift(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0.0))[:, None]], axis=1)


def _aim(q: np.ndarray) -> np.ndarray:
    """Units in the direction of q, whose length may be too small to square."""
    q = q / np.maximum(np.abs(q).max(1, initial=0.0), 2.0**-1000)[:, None]
    return np.concatenate([q / np.maximum(np.sqrt((q * q).sum(1)), 2.0**-1000)[:, None], np.zeros((len(q), 1))], axis=1)


def _away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0))
