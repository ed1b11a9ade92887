"""Column and table helpers with defined null, NaN and empty-group behaviour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.operators.ordering import prefix_of, sums_by_value


def draw(*parts: Column | str | int) -> Column:
    """A pseudo-random whole number below 2^32, fixed by its parts; other engines can compute it too."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def fraction(*parts: Column | str | int) -> Column:
    return draw(*parts) / F.lit(4294967296.0)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; keys come from the left side."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def safe_sum(c: Column) -> Column:
    """Sum that is 0 of no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def n_unique(c: Column) -> Column:
    """Number of distinct values; null counts as one."""
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def any_of(p: Column) -> Column:
    return F.coalesce(F.bool_or(p), F.lit(False))


def all_of(p: Column) -> Column:
    return F.coalesce(F.bool_and(p), F.lit(True))


def micro_rate(hits: str, trials: str) -> Column:
    return F.try_divide(F.sum(hits), F.sum(trials))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def replace_strict(c: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; a value without one fails the job."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c]
    return F.when(c.isNull(), F.lit(None)).when(c.isin(list(mapping)), found).otherwise(F.raise_error(F.concat(F.lit("no replacement for "), c)).cast("string"))


def sorted_tokens(c: Column, mark: str = "|") -> Column:
    return F.array_join(F.array_sort(F.split(c, f"[{mark}]")), mark)


def dense_rank_null_last(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense rank in which null stays null."""
    rank = F.dense_rank().over(Window.orderBy(F.col(column).asc_nulls_last()))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), rank))


def average_rank(value: str, *groups: str) -> Column:
    """Rank from 1 in a group, the mean of the places that equal values take."""
    own = Window.partitionBy(*groups)
    ties = Window.partitionBy(*groups, value)
    return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def higher_quantile(df: DataFrame, groups: list[str], value: str, p: Column, out: str, spread: Column | None = None, name: str = "p") -> DataFrame:
    """The value at place ceil(p * (n - 1)) of each group, from 0, and the group's n. p: of the groups' columns.

    ``spread``: an array of values that ``name``, of which p may be made, takes in turn; values are ranked once for all.
    """
    return quantile_of(*sums_by_value(df, groups, value, {"_c": F.count(F.lit(1))}), groups, value, ["_c"], "_c", p, out, spread, name)


def quantile_of(by: DataFrame, stretches: DataFrame, groups: list[str], value: str, names: list[str], of: str, p: Column, out: str, spread: Column | None = None, name: str = "p") -> DataFrame:
    """As higher_quantile(), of sums_by_value() whose measure ``of`` counts the rows meant; groups without such rows are left out."""
    at = F.ceil(p * (F.col(f"{of}_all") - 1))
    dealt = lambda rows: rows if spread is None else rows.withColumn(name, F.explode(spread))
    ranked = prefix_of(by, stretches, groups, value, names, lambda s: dealt(s).where((F.col(f"{of}_start") <= at) & (at < F.col(f"{of}_end"))))
    here = (F.col(f"{of}_before") <= at) & (at < F.col(f"{of}_before") + F.col(of))
    more = [] if spread is None else [name]
    return dealt(ranked).where(here).select(*groups, *more, F.col(value).alias(out), F.col(f"{of}_all").alias("n"))


def arm_values(df: DataFrame, keys: list[str], value: str, arms: dict[str, Column]) -> DataFrame:
    """One row a key with a column for each arm, by conditional aggregation: one shuffle in place of a self-join an arm."""
    return df.groupBy(*keys).agg(*[F.max(F.when(p, F.col(value))).alias(name) for name, p in arms.items()])


def longer(df: DataFrame, keys: list[str], values: dict[str, Column], name: str, value: str = "value") -> DataFrame:
    """A row for each of ``values``, their names in ``name``."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in values.items()])
    return df.withColumn("_cell", F.explode(cells)).select(*keys, F.col("_cell.k").alias(name), F.col("_cell.v").alias(value))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same table; its job fails where a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1)).where(F.col("_ok").isNull()).drop("_n", "_ok")
