"""Leakage-free splits of groups, and dense ids, by running sums over ranges of a draw."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import draw
from sievegrid.session import stage, unstage

#: The draw's range, 2^32, is cut into 2^RANGE_BITS ranges of like size.
RANGE_BITS = 10
#: Ranges on both sides of where a cut is looked for first; sizes of groups that lie there are kept.
AROUND = 16
#: role_by_cuts() looks a draw's role up by so many of its bits.
ROLE_BITS = 6


def running_before(df: DataFrame, order: Column, tie: str, size: Column, out: str, groups: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of size over rows before, by (order, tie); order is a draw below 2^32.

    Sums inside ranges of the draw, then over the ranges' totals: no task takes all rows.
    """
    keys = groups or []
    ranged = df.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 32 - RANGE_BITS)).withColumn("_size", size)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_range").orderBy("_order", tie).rowsBetween(Window.unboundedPreceding, -1)
    with_inside = ranged.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return with_inside.join(starts, [*keys, "_range"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_order", "_range", "_size", "_start", "_inside")


def dense_ids(df: DataFrame, order: Column, tie: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... by (order, tie)."""
    return running_before(df, order, tie, F.lit(1).cast("long"), out)


def assign_roles(rows: DataFrame, group: str, seed: int, salt: int, attempt: int, fit: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """(group, role): groups in seeded order; a group's role goes by the part of all rows that come before it."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    placed = running_before(sizes, draw(seed, salt, attempt, F.col(group)), group, F.col("n"), "before").crossJoin(F.broadcast(total))  # one row
    part = F.col("before") / F.col("total")
    return placed.select(group, F.when(part < fit, F.lit("fit")).when(part < fit + calibration, F.lit("calibration")).otherwise(F.lit("test")).alias("role"))


def sized_draws(rows: DataFrame, group: str, seed: int, salt: int, attempts: Iterable[int]) -> DataFrame:
    """(_group, _size, _orders): each group's rows and its draws of all attempts, staged."""
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    return stage(sizes.withColumn("_orders", F.array(*[draw(seed, salt, i, F.col("_group")) for i in attempts])), "group-sizes")


def role_cuts(sizes: DataFrame, attempts: Iterable[int], fit: float = 0.6, calibration: float = 0.2) -> dict[int, list[tuple]]:
    """Each attempt's two cuts (draw, group) of sized_draws(): a group before the first one is fit, one before the second calibration, others test.

    Totals by range of the draw tell the range in which a cut lies; only such ranges' groups are put in order. The cuts, two an
    attempt, go to the driver.
    """
    attempts = list(attempts)
    tried = sizes.select("_group", "_size", F.posexplode("_orders").alias("_at", "_order")).withColumn("_attempt", F.array(*[F.lit(i) for i in attempts])[F.col("_at")]).drop("_at")
    tried = tried.withColumn("_range", _range_of("_order"))
    last = _cut_ranges(tried, fit, calibration)
    out = _cuts(tried, last, attempts)
    unstage(last)
    return out


def split_cuts(rows: DataFrame, group: str, seed: int, salt: int, attempt: int, fit: float = 0.6, calibration: float = 0.2) -> list[tuple]:
    """The cuts of one attempt, as of role_cuts(), with no row a group.

    Rows are counted by range of the draw; groups of their own are told apart only where the cuts are awaited, since draws are even.
    Rows are read again where a cut lies elsewhere, as few or very unlike groups may have it.
    """
    near = [int(end * (1 << RANGE_BITS)) for end in (fit, fit + calibration)]
    awaited = sorted({r for at in near for r in range(at - AROUND, at + AROUND + 1)})
    drawn = rows.select(draw(seed, salt, attempt, F.col(group)).alias("_order"), F.col(group).alias("_group")).withColumn("_range", _range_of("_order"))
    own = F.when(F.col("_range").isin(awaited), F.struct("_order", "_group")).alias("_own")
    counts = stage(drawn.groupBy("_range", own).agg(F.count(F.lit(1)).alias("_size")).withColumn("_attempt", F.lit(attempt)), "range-sizes")
    last = _cut_ranges(counts, fit, calibration)
    found = [r["_range"] for r in last.select("_range").distinct().collect()]  # two at most
    tried = counts.where(F.col("_own").isNotNull()).select("_attempt", "_range", "_own.*", "_size")
    if not set(found) <= set(awaited):
        tried = drawn.where(F.col("_range").isin(found)).groupBy("_range", "_order", "_group").agg(F.count(F.lit(1)).alias("_size")).withColumn("_attempt", F.lit(attempt))
    cuts = _cuts(tried, last, [attempt])[attempt]
    unstage(last)
    unstage(counts)
    return cuts


def _range_of(order: str) -> Column:
    return F.shiftright(order, 32 - RANGE_BITS)


def _cut_ranges(tried: DataFrame, fit: float, calibration: float) -> DataFrame:
    """(_attempt, _cut, _end, _total, _range, _start): the range in which each cut lies, staged."""
    per = Window.partitionBy("_attempt")
    totals = tried.groupBy("_attempt", "_range").agg(F.sum("_size").alias("_n"))  # at most 2^RANGE_BITS rows an attempt
    starts = totals.select("_attempt", "_range", F.coalesce(F.sum("_n").over(per.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(per).alias("_total"))
    ends = tried.sparkSession.createDataFrame([(0, fit), (1, fit + calibration)], "_cut int, _end double")
    last = starts.crossJoin(ends).where(F.col("_start") / F.col("_total") < F.col("_end")).groupBy("_attempt", "_cut", "_end", "_total").agg(F.max_by(F.struct("_range", "_start"), "_range").alias("_at")).select("_attempt", "_cut", "_end", "_total", "_at.*")
    return stage(last, "cut-ranges")


def _cuts(tried: DataFrame, last: DataFrame, attempts: list[int]) -> dict[int, list[tuple]]:
    inside = Window.partitionBy("_attempt", "_cut").orderBy("_order", "_group").rowsBetween(Window.unboundedPreceding, -1)
    near = tried.join(F.broadcast(last), ["_attempt", "_range"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))  # last: two rows an attempt
    found = near.where(F.col("_before") / F.col("_total") >= F.col("_end")).groupBy("_attempt", "_cut").agg(F.min(F.struct("_order", "_group")).alias("_key"))
    out: dict[int, list[tuple]] = {i: [(0, None), (0, None)] for i in attempts}
    for r in last.join(found, ["_attempt", "_cut"], "left").collect():
        key = r["_key"]
        out[r["_attempt"]][r["_cut"]] = (key["_order"], key["_group"]) if key is not None else ((r["_range"] + 1) << (32 - RANGE_BITS), None)
    return out


def role_by_cuts(order: Column, own: Column, cuts: list[tuple]) -> Column:
    """The role of a group by its draw and the attempt's cuts. A draw's first bits tell it but for those of a cut; so the draw is made once for nearly all."""
    before = [(order < at) if key is None else (order < at) | ((order == at) & F.coalesce(own < F.lit(key), own.isNull())) for at, key in cuts]
    exact = F.when(before[0], F.lit("fit")).when(before[1], F.lit("calibration")).otherwise(F.lit("test"))
    shift = 32 - ROLE_BITS

    def role(low: int, high: int) -> str | None:
        """Of draws from low to high, if they have one; key or not, no cut's own draw is among them."""
        (first, _), (second, _) = cuts
        if high < first:
            return "fit"
        if low > first:
            return "calibration" if high < second else "test" if low > second else None
        return None

    known = F.array(*[F.lit(role(i << shift, ((i + 1) << shift) - 1)).cast("string") for i in range(1 << ROLE_BITS)])
    return F.coalesce(F.get(known, F.shiftright(order, shift).cast("int")), exact)


def with_roles(rows: DataFrame, group: str, seed: int, salt: int, attempt: int, fit: float = 0.6, calibration: float = 0.2) -> DataFrame:
    """Rows with their group's role, as by a join with assign_roles(), without one; rows of no group are left out."""
    cuts = split_cuts(rows, group, seed, salt, attempt, fit, calibration)
    return rows.where(F.col(group).isNotNull()).withColumn("role", role_by_cuts(draw(seed, salt, attempt, F.col(group)), F.col(group), cuts))


def leakage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, leaking): how many values of each key have rows in more than one role."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("c")
    per = rows.select(cells, "role").groupBy("c.key", "c.value").agg(F.count_distinct("role").alias("roles"))
    return per.groupBy("key").agg(F.count_if(F.col("roles") > 1).alias("leaking"))


def role_counts(labelled: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Rows by client, family and role of eligible labels, of ``families`` if given."""
    rows = labelled.where("reason = 'eligible'")
    rows = rows if families is None else rows.join(families.select("family"), "family", "left_semi")
    return rows.groupBy("client", "family", "role").agg(F.count(F.lit(1)).alias("rows"))


def client_fit_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where("role = 'fit'").groupBy("client").agg(F.count(F.lit(1)).alias("fit_rows"))


def _by_role(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    part = lambda role: F.sum(F.when(F.col("role") == role, F.col("rows")))
    return counts.groupBy(*keys, "client", "family").agg(part("fit").alias("target_fit_rows"), F.coalesce(part("test"), F.lit(0)).alias("target_test_rows"))


def controlled_pairs(counts: DataFrame, fit_rows: DataFrame, rule: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row a (client, family) with fit rows, and whether hiding it leaves enough on every side. rule: least counts; keys: of several splits."""
    family = Window.partitionBy(*keys, "family")
    pairs = (
        _by_role(counts, keys)
        .withColumn("total_fit_rows", F.sum("target_fit_rows").over(family))
        .withColumn("federation_test_rows", F.sum("target_test_rows").over(family))
        .where("target_fit_rows is not null")
        .join(fit_rows, [*keys, "client"])
        .withColumn("peer_fit_rows", F.col("total_fit_rows") - F.col("target_fit_rows"))
    )
    eligible = (
        (F.col("target_fit_rows") >= rule["target_min_fit"])
        & (F.col("peer_fit_rows") >= rule["peer_min_fit"])
        & (F.col("federation_test_rows") >= rule["federation_min_test"])
        & (F.col("fit_rows") - F.col("target_fit_rows") >= rule["target_min_remaining_fit"])
    )
    return pairs.withColumn("eligible", eligible)


def natural_pairs(counts: DataFrame, fit_rows: DataFrame, max_share: float, peer_min_fit: int, own_test_min: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every client with every family that has fit rows anywhere; eligible where the client has few and its peers many."""
    known = _by_role(counts, keys)
    total = known.groupBy(*keys, "family").agg(F.sum("target_fit_rows").alias("total_fit_rows")).where("total_fit_rows is not null")
    clients = fit_rows.select(*keys, "client")
    grid = clients.join(total, list(keys)) if keys else clients.crossJoin(total)
    pairs = grid.join(known, [*keys, "client", "family"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("target_fit_rows", "target_test_rows")})
    pairs = pairs.withColumn("target_share", F.try_divide(F.col("target_fit_rows"), F.col("total_fit_rows"))).withColumn("peer_fit_rows", F.col("total_fit_rows") - F.col("target_fit_rows"))
    return pairs.withColumn("eligible", (F.col("target_share") <= max_share) & (F.col("peer_fit_rows") >= peer_min_fit) & (F.col("target_test_rows") >= own_test_min))


def best_attempt(rows: DataFrame, group: str, seed: int, salt: int, attempts: int, rule: dict[str, int]) -> DataFrame:
    """(attempt, eligible): the attempt whose split has most eligible controlled pairs, the first of equals.

    Rows are read once and counted under all attempts' roles side by side, not once an attempt.
    """
    sizes = sized_draws(rows, group, seed, salt, range(attempts))
    roles = F.concat(*[F.substring(role_by_cuts(F.col("_orders")[i], F.col("_group"), c), 1, 1) for i, c in role_cuts(sizes, range(attempts)).items()])
    split = rows.join(sizes.select(F.col("_group").alias(group), roles.alias("_roles")), group)
    counts = [F.count_if(F.substring("_roles", i + 1, 1) == role[0]).alias(f"{role}_{i}") for i in range(attempts) for role in ("fit", "test")]
    by = split.withColumn("_eligible", F.coalesce(F.col("reason") == "eligible", F.lit(False))).groupBy("client", "family", "_eligible").agg(*counts)
    cells = F.array(*[F.struct(F.lit(i).alias("attempt"), F.col(f"fit_{i}").alias("fit"), F.col(f"test_{i}").alias("test")) for i in range(attempts)])
    by = stage(by.select("client", "family", "_eligible", F.explode(cells).alias("c")).select("client", "family", "_eligible", "c.*"), "attempts")  # a row a client, family and attempt
    fit_rows = by.groupBy("attempt", "client").agg(F.sum("fit").alias("fit_rows"))
    family = Window.partitionBy("attempt", "family")
    pairs = by.where("_eligible").withColumn("all_fit", F.sum("fit").over(family)).withColumn("all_test", F.sum("test").over(family)).where("fit > 0").join(fit_rows, ["attempt", "client"])
    eligible = (F.col("fit") >= rule["target_min_fit"]) & (F.col("all_fit") - F.col("fit") >= rule["peer_min_fit"]) & (F.col("all_test") >= rule["federation_min_test"]) & (F.col("fit_rows") - F.col("fit") >= rule["target_min_remaining_fit"])
    return pairs.groupBy("attempt").agg(F.count_if(eligible).alias("eligible")).orderBy(F.desc("eligible"), "attempt").limit(1)


def assign_targets(pairs: DataFrame, families: list[str], seed: int, least_remaining: int) -> list[tuple[str, str]]:
    """Greedy: each family in turn goes to its first eligible client, in seeded order, that keeps enough fit rows.

    Sequential by nature; reads one row a (client, family).
    """
    wanted = pairs.where(F.col("family").isin(families)).select("client", "family", "fit_rows", "target_fit_rows", "eligible", draw(seed, F.col("family"), F.col("client")).alias("order"))
    rows = sorted((r.asDict() for r in wanted.collect()), key=lambda r: (r["order"], r["client"]))
    remaining = {r["client"]: r["fit_rows"] for r in rows}
    chosen = []
    for family in families:
        for r in rows:
            if r["family"] == family and r["eligible"] and remaining[r["client"]] - r["target_fit_rows"] >= least_remaining:
                remaining[r["client"]] -= r["target_fit_rows"]
                chosen.append((r["client"], family))
                break
    return chosen
