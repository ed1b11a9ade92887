"""How far hidden groups are from known ones in feature space: centroids, distances, overlap of active features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centroids(rows: DataFrame, group: str, features: str, least_rows: int = 1) -> DataFrame:
    """(group, pos, mean, active, n): mean of each feature by group, in long form; groups below ``least_rows`` are left out.

    Partial sums by (group, pos) are combined before the shuffle, so a large group is no large task.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    long = rows.select(group, F.posexplode(features).alias("pos", "x"))
    sums = long.groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.join(sizes, group).select(group, "pos", (F.col("s") / F.col("n")).alias("mean"), (F.col("s") > 0).alias("active"), "n")


def distances(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, distance, jaccard) between every centroid of left and of right; groups are few, features many."""
    x = left.select(F.col(a), "pos", F.col("mean").alias("x"), F.col("active").alias("ax"))
    y = right.select(F.col(b), "pos", F.col("mean").alias("y"), F.col("active").alias("ay"))
    both = x.join(y, "pos")
    shared, either = F.count_if(F.col("ax") & F.col("ay")), F.count_if(F.col("ax") | F.col("ay"))
    return both.groupBy(a, b).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("distance"), F.coalesce(F.try_divide(shared, either), F.lit(1.0)).alias("jaccard"))


def relatedness(pairs: DataFrame, target: str, other: str) -> DataFrame:
    """Adds rank: place of ``other`` among all by distance to the target, ties by name."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(target).orderBy("distance", other)))


def novelty(hidden: DataFrame, known: DataFrame, benign: DataFrame) -> DataFrame:
    """(family, descriptor, value) in long form: nearest known family, nearest overlap, distance to benign, part of active features known."""
    near = distances(hidden, known, "family", "known").where("family <> known").groupBy("family").agg(F.min("distance").alias("nearest_family"), F.max("jaccard").alias("max_jaccard"))
    away = distances(hidden, benign, "family", "benign").groupBy("family").agg(F.min("distance").alias("benign_distance"))
    active = known.where("active").select(F.col("known").alias("_k"), "pos")
    mine = hidden.where("active").select("family", "pos").join(active, "pos", "left").groupBy("family", "pos").agg(F.coalesce(F.bool_or(F.col("_k") != F.col("family")), F.lit(False)).alias("seen"))
    share = mine.groupBy("family").agg(F.avg(F.col("seen").cast("double")).alias("known_active_share"))
    wide = near.join(away, "family", "left").join(share, "family", "left")
    return wide.unpivot("family", ["nearest_family", "max_jaccard", "benign_distance", "known_active_share"], "descriptor", "value")


def descriptor_by_family(novelty_rows: DataFrame, descriptor: str) -> DataFrame:
    return novelty_rows.where(F.col("descriptor") == descriptor).groupBy("family").agg(F.avg("value").alias("score"))


def prevalence_transform(rows: DataFrame, features: str, least: float, most: float) -> DataFrame:
    """(pos, mean, spread) of features whose share of non-zero rows is within bounds; spread is the population's plus 1e-6."""
    long = rows.select(F.posexplode(features).alias("pos", "x"))
    stats = long.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"), F.avg((F.col("x") != 0).cast("double")).alias("share"))
    return stats.where(F.col("share").between(least, most)).select("pos", "mean", (F.col("spread") + 1e-6).alias("spread"))
