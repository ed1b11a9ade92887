"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's words, its documents in a seeded order, are cut into blocks of equal size. Slot t of the mix has the
golden-ratio point frac((t + 1) / golden ratio), as a 64-bit fixed-point number; the point falls into one source's
share of the unit interval. The r-th slot of a source takes its block r mod blocks. So any stretch of the schedule
has each source near its share, and a source is gone through evenly.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are
returned with taken 0; repeated rows and null ids are separate documents (rows have a key of their own); an empty
table gives an empty one; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.native import size_of
from sievegrid.operators.ordering import shuffled_prefix
from sievegrid.session import stage

GOLDEN = 0x9E3779B97F4A7C15
CHUNK = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """(place, source, source_size, weight, target) of (source, source_size), a row a source.

    Weights repeat in the order of sources, null last. Targets share budget * total by weight, at most
    ``most`` * source_size each; what is above is shared again. Sorted by cap / weight, a source is capped iff its cap is no
    more than its part of what those before it leave.
    """
    every = Window.partitionBy(F.lit(1))
    placed = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod("place", F.lit(len(weights)))]
    placed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(every) * F.lit(float(budget)))
    order = every.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = placed.withColumn("level", left / weight_left)
    level = level.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    first_level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(every)
    level = level.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", first_level * F.col("weight"))))
    return level.select("place", "source", "source_size", "weight", "target")


def schedule(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """(slot, place, rank) for the whole mix; plan: (place, blocks, wanted slots) in the order of sources."""
    wanted = np.array([max(p[2], 0.0) for p in plan])
    slots = int(round(wanted.sum()))
    bounds = np.cumsum(wanted) / max(wanted.sum(), 1e-300)
    places = np.array([p[0] for p in plan], np.int64)
    bounds[-1:] = 1.0

    def points(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, slots), dtype=np.uint64)
        u = ((t + np.uint64(1)) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
        return t.astype(np.int64), np.minimum(np.searchsorted(bounds, u, side="right"), len(bounds) - 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                found, n = np.unique(points(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(places[found]), pa.array(n)], names=["chunk", "place", "n"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                t, source = points(chunk)
                order = np.argsort(source, kind="stable")
                n = np.bincount(source, minlength=len(places))
                inside = np.empty(len(t), np.int64)
                inside[order] = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), chunk)), pa.array(t), pa.array(places[source]), pa.array(inside)], names=["chunk", "slot", "place", "inside"])

    chunks = spark.range(-(-slots // CHUNK))
    counts = chunks.mapInArrow(counted, "chunk long, place long, n long")
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = chunks.mapInArrow(dealt, "chunk long, slot long, place long, inside long")
    # Spark takes the slots for as few as the chunks they come from, and would broadcast them.
    return rows.hint("merge").join(offsets, ["chunk", "place"]).select("slot", "place", (F.col("offset") + F.col("inside")).alias("rank"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    block_words: int = 256,
    least_blocks: int = 256,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents: (id, size, source, source_size, target, taken), a row a document; taken counts its words in the mix.
    slots: (slot, source, block, epoch) in the order of training. Blocks have ``block_words`` words, fewer in a source
    that would have under ``least_blocks`` of them. A source's slots are at most ``most`` times its blocks: whole epochs, and
    the first blocks once more where ``most`` is no whole number. The sources' table, a row a source, passes through the driver.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(text), F.lit(seed)).alias("draw"))
    sized = stage(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    width = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / least_blocks))).cast("long")
    plan = stage(plan.withColumn("width", width).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width"))), "mix-plan")
    rows = plan.selectExpr("place", "blocks", "target / width as wanted").orderBy("place").collect()

    slots = schedule(spark, [tuple(r) for r in rows]).join(plan.select("place", "source", "blocks"), "place")
    slots = slots.where(F.col("rank") < F.floor(F.col("blocks") * F.lit(float(most)))).select("slot", "place", "source", F.pmod("rank", "blocks").alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))
    times = slots.groupBy("place", "block").agg(F.count(F.lit(1)).alias("times"))

    keyed = sized.withColumn("key", F.struct("source")).join(plan.select(F.struct("source").alias("key"), "place", "source_size", "target", "width"), "key").drop("key")
    begun = shuffled_prefix(keyed, ["place"], F.col("size"), F.col("draw"), "begin")
    end = F.col("begin") + F.col("size")
    pieces = begun.where("size > 0").select(
        "row", "place", "width", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / F.col("width")), F.floor((end - 1) / F.col("width")))).alias("block")
    )
    inside = F.least("end", (F.col("block") + 1) * F.col("width")) - F.greatest("begin", F.col("block") * F.col("width"))
    taken = pieces.join(times.hint("merge"), ["place", "block"]).groupBy("row").agg(F.sum(inside * F.col("times")).alias("taken"))
    out = keyed.join(taken, "row", "left").select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, slots.select("slot", F.col("source").alias(source_col), "block", "epoch")
