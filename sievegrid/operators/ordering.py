"""Ranks, running sums and the first rows of a group, without gathering a hot group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.session import stage


#: Parts that a group is cut in where its number of buckets is joined to its rows.
SALTS = 64
#: Bits of the number of rows that a running sum's window takes.
STRETCH_BITS = 16


def shuffled_prefix(
    df: DataFrame,
    groups: list[str],
    size: Column,
    seed: Column,
    out: str,
    rows_per_bucket: int = 4096,
) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the same group that come before, in a seeded order.

    A row's place is its hash: first the hash's bucket, then the hash within it. A group of n rows has about
    n / rows_per_bucket buckets of like size, so windows stay small whatever a group holds; only the
    buckets' totals (one row a bucket) are summed across buckets. Group keys may be null. ``df`` is read twice.
    The join with the groups' counts is salted: were it by the keys alone, the windows would keep its partitioning,
    with a group's buckets all in one task.
    Rows that are equal in all that ``seed`` is made of may swap places.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    with_keys = df.withColumns(
        {k: F.struct(F.col(f"`{g}`")) for k, g in zip(keys, groups, strict=True)} | {"_size": size.cast("long"), "_hash": seed}
    )
    counts = with_keys.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_bucket)).alias("_buckets"))
    counts = stage(counts, "group-buckets")  # so that Spark knows their size before it plans the join
    if keys:
        salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = with_keys.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")
    else:
        placed = with_keys.withColumn("_buckets", F.lit(counts.first()[0]))
    placed = placed.withColumn("_bucket", F.pmod("_hash", F.greatest("_buckets", F.lit(1))))
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop(*keys, "_size", "_hash", "_buckets", "_bucket", "_offset", "_inside")
    )


def sums_by_value(df: DataFrame, groups: list[str], value: str, measures: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(by, stretches): the measures' sums at each value, staged, for prefix_of(), which may read them more than once.

    Rows are summed by value first, map-side combined, then sorted by ranges of (groups, value) and cut into stretches of 2^STRETCH_BITS rows at most. The
    stretches (groups, and for each m, m_start and m_end, the sums before and with it, m_all) are summed over one another; values are not. Null values are left out.
    """
    names = list(measures)
    keys = _keys(groups)
    v = F.col(f"`{value}`")
    named = [F.col(f"`{g}`") for g in groups]
    by = df.where(v.isNotNull()).groupBy(*named, v).agg(*[m.alias(n) for n, m in measures.items()])
    by = by.repartitionByRange(*named, v).sortWithinPartitions(*named, v).withColumn("_bucket", F.shiftright(F.monotonically_increasing_id(), STRETCH_BITS))
    by = stage(by, "by-value")  # read for the totals and the sums; ids are of one run
    by = by.withColumns({k: F.struct(F.col(f"`{g}`")) for k, g in zip(keys, groups, strict=True)})
    totals = by.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    own = Window.partitionBy(*keys)
    before = own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[f"_t_{n}" for n in names], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"{n}_start") for n in names], *[F.sum(f"_t_{n}").over(own).alias(f"{n}_all") for n in names])
    return by, offsets.withColumns({f"{n}_end": F.col(f"{n}_start") + F.col(f"_t_{n}") for n in names}).drop(*[f"_t_{n}" for n in names])


def prefix_of(by: DataFrame, offsets: DataFrame, groups: list[str], value: str, names: list[str], near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(groups, value, and for each measure m, m_before, m_all) of sums_by_value(), in the stretches that ``near`` picks of theirs, else in all.

    Windows stay inside a stretch, and only the stretches' totals are summed across them. The result is exact wherever the ranges lie.
    """
    keys = _keys(groups)
    if near is not None:
        wanted = near(offsets.withColumns({g: F.col(k).getField(g) for k, g in zip(keys, groups, strict=True)})).select(*offsets.columns).distinct()
        offsets = stage(wanted, "stretches")  # so that Spark knows how few they are before it plans the join
        by = by.join(offsets, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(f"`{value}`")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumns({f"_i_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    if near is None:
        ranked = ranked.join(offsets, [*keys, "_bucket"])
    return ranked.select(*groups, value, *names, *[(F.col(f"{n}_start") + F.col(f"_i_{n}")).alias(f"{n}_before") for n in names], *[f"{n}_all" for n in names])


def _keys(groups: list[str]) -> list[str]:
    return [f"_g{i}" for i in range(len(groups))]


def prefix_by_value(df: DataFrame, groups: list[str], value: str, measures: dict[str, Column], near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(groups, value, and for each measure m, m_before, m_all): its sum at a value, over smaller values, over the group."""
    return prefix_of(*sums_by_value(df, groups, value, measures), groups, value, list(measures), near)


def rank_by_value(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... by (value, tie), a number and a key; rows of null value are left out.

    Values are ranked in ranges, their rows inside each value, so no task takes all rows.
    """
    before = prefix_by_value(df, [], value, {"_c": F.count(F.lit(1))}).select(F.col(value).alias("_v"), "_c_before")
    inside = F.row_number().over(Window.partitionBy(value).orderBy(tie)) - 1
    return df.withColumn("_inside", inside).join(before, F.col(value) == F.col("_v")).withColumn(out, F.col("_c_before") + F.col("_inside")).drop("_inside", "_v", "_c_before")


def first_rows(df: DataFrame, groups: list[str], order: list[Column | str], most: Column | int, ceiling: int | None = None) -> DataFrame:
    """The first ``most`` rows of each group. ``ceiling``: a bound of ``most`` where that is a column.

    Each of a group's parts, cut by hash, keeps its first rows; the group's own are among them, so the last window sees
    at most SALTS times as many rows as are wanted.
    """
    bound = most if isinstance(most, int) else ceiling
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    part = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    rows = df
    if bound is not None:
        near = Window.partitionBy(*groups, "_part").orderBy(*order)
        rows = rows.withColumn("_part", part).withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= bound).drop("_part", "_place")
    last = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("_place", last).where(F.col("_place") <= (F.lit(most) if isinstance(most, int) else most)).drop("_place")
