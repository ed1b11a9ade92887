"""Linking, holders, labels, identities and family sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.primitives import all_of, draw, n_unique, sorted_tokens, strip
from sievegrid.operators.graph import connected_components


def check_release(df: DataFrame, features: list[str], expected_rows: int, malware_min: int, benign: int) -> DataFrame:
    """(name, passed): feature columns complete, rows as expected, no negatives, hashes unique, labels as counted. One pass."""
    present = [c for c in df.columns if c.startswith("feat_")]
    if sorted(present) != sorted(features):
        raise ValueError(f"features missing or unknown: {sorted(set(present) ^ set(features))}")
    values = F.array(*features)
    negative = F.size(F.filter(values, lambda x: x < 0))
    odd = F.size(F.filter(values, lambda x: (x != 0) & (x != 1)))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(negative), F.lit(0)).alias("negative"),
        F.coalesce(F.sum(odd), F.lit(0)).alias("non_binary"),
        n_unique(F.lower("hash")).alias("hashes"),
        all_of(F.when(F.col("label") == 1, F.col("vt_count") >= malware_min).otherwise(F.col("vt_count") == benign)).alias("labels"),
    )
    checks = {"contract": (F.col("rows") == expected_rows) & (F.col("negative") == 0), "unique_hashes": F.col("hashes") == F.col("rows"), "label_rule": F.col("labels")}
    cells = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("passed")) for k, v in checks.items()])
    return row.select(F.explode(cells).alias("c"), "negative", "non_binary").select("c.name", "c.passed", "negative", "non_binary")


def binarised(df: DataFrame, features: list[str]) -> DataFrame:
    """Hash in lower case, features as one array of 0 and 1."""
    one = F.transform(F.array(*features), lambda x: (x > 0).cast("tinyint"))
    return df.select(F.lower("hash").alias("sha256"), *[c for c in df.columns if c not in ("hash", *features)], one.alias("features"))


def link_sources(metadata: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, unmatched): rows with a package, markets sorted and counted; rows without one."""
    both = metadata.join(index.select("sha256", "package", "markets", F.col("vt_count").alias("linked_vt")), "sha256", "left")
    linked = both.where("package is not null").withColumns({"market_count": F.size(F.split("markets", "[|]")), "markets": sorted_tokens(F.col("markets"))})
    return linked, both.where("package is null").drop("package", "markets", "linked_vt")


def link_checks(linked: DataFrame) -> DataFrame:
    return linked.agg((F.count_distinct("sha256") == F.count(F.lit(1))).alias("unique_hashes"), all_of(F.col("vt_count") == F.col("linked_vt")).alias("counts_agree"))


def assign_clients(linked: DataFrame, markets: dict[str, str], era_market: str, boundary: str, era_clients: tuple[str, str]) -> DataFrame:
    """Rows of one market get its client; those of ``era_market`` by month before or from ``boundary``; others go."""
    client = F.when((F.col("markets") == era_market) & (F.col("year_month") < boundary), F.lit(era_clients[0])).when(F.col("markets") == era_market, F.lit(era_clients[1]))
    for market, name in markets.items():
        client = client.when(F.col("markets") == market, F.lit(name))
    return linked.where("market_count = 1").withColumn("client", client).where("client is not null")


def client_support(rows: DataFrame) -> DataFrame:
    return rows.groupBy("client").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("malware_rows"), F.count_if(F.col("label") == 0).alias("benign_rows"), F.count_distinct("package").alias("packages"))


def identities(rows: DataFrame, row: str, package: str, feature: str) -> DataFrame:
    """(row, package, feature, component): rows that share a package or a feature vector, directly or by others.

    The graph is contracted to packages and features; rows are not nodes. A component is named by its least node.
    """
    p, f = F.concat(F.lit("p:"), F.col(package).cast("string")), F.concat(F.lit("f:"), F.col(feature).cast("string"))
    labels = connected_components(rows.select(p.alias("a"), f.alias("b")).distinct(), "a", "b")
    return rows.withColumn("_node", p).join(labels, F.col("_node") == F.col("node")).select(F.col(row), F.col(package), F.col(feature), "component")


def component_summary(members: DataFrame, rows: DataFrame, row: str, package: str) -> DataFrame:
    both = members.select(row, "component").join(rows, row)
    return both.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("malware_rows"), F.count_distinct(package).alias("packages"))


def classify_labels(rows: DataFrame, unknown: list[str], singleton_prefix: str) -> DataFrame:
    family = F.col("family")
    reason = (
        F.when(F.col("label") == 0, F.lit("not-in-family-set"))
        .when(strip(family) == "", F.lit("empty-label"))
        .when(family.isin(unknown), F.lit("unknown-label"))
        .when(family.startswith(singleton_prefix), F.lit("singleton-label"))
        .otherwise(F.lit("eligible"))
    )
    return rows.withColumn("reason", reason)


def corpus_support(labelled: DataFrame) -> DataFrame:
    return labelled.where("reason = 'eligible'").groupBy("client", "family").agg(F.count(F.lit(1)).alias("rows"))


def label_eligibility(labelled: DataFrame) -> DataFrame:
    """Rows and distinct families of each reason; the count of families goes by the name packages."""
    return labelled.where("label = 1").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), n_unique(F.col("family")).alias("packages"))


def family_sets(support: DataFrame, least_rows: int, least_clients: int, set_size: int) -> DataFrame:
    """(family_set, place, family, rows): ranked families, even places primary, odd ones replication, the first of each."""
    totals = support.groupBy("family").agg(F.sum("rows").alias("rows"), F.count_distinct("client").alias("clients")).where((F.col("rows") >= least_rows) & (F.col("clients") >= least_clients))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), "family")) - 1)
    named = ranked.withColumn("family_set", F.when(F.col("rank") % 2 == 0, F.lit("primary")).otherwise(F.lit("replication"))).withColumn("place", F.floor(F.col("rank") / 2))
    return named.where(F.col("place") < set_size).select("family_set", "place", "family", "rows")


def large_family_sets(support: DataFrame, pairs: DataFrame, own_test_min: int, batches: int) -> DataFrame:
    """(rank, family, rows, eligible_pairs, own_domain_pairs, batch): families with an eligible pair, dealt in turn."""
    totals = support.groupBy("family").agg(F.sum("rows").alias("rows"))
    eligible = pairs.where("eligible").groupBy("family").agg(F.count(F.lit(1)).alias("eligible_pairs"), F.count_if(F.col("target_test_rows") >= own_test_min).alias("own_domain_pairs"))
    ranked = totals.join(eligible, "family").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rows"), "family")) - 1)
    return ranked.withColumn("batch", F.col("rank") % batches + 1)


def permuted_labels(labelled: DataFrame, row: str, seed: int, offset: int) -> DataFrame:
    """Families dealt anew among eligible rows, by a seeded order; other rows keep theirs.

    Both orders are ranked by range and offset (dense_ids), so no task takes all rows. Eligible rows are staged: the two orders read them twice each.
    """
    from sievegrid.operators.splits import dense_ids
    from sievegrid.session import stage

    eligible = stage(labelled.where("reason = 'eligible'").select(F.col(row).alias("_row"), F.col("family").alias("_family")), "eligible")
    here = dense_ids(eligible.select("_row"), draw("place", F.col("_row")), "_row", "_id").select("_row", "_id")
    there = dense_ids(eligible, draw(seed, offset, F.col("_row")), "_row", "_id").select("_id", F.col("_family").alias("_new"))
    moved = here.join(there, "_id").select("_row", "_new")
    return labelled.join(moved, F.col(row) == F.col("_row"), "left").withColumn("family", F.coalesce("_new", "family")).drop("_row", "_new")


def overlap(rows: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """Rows whose key is in every source."""
    for source in sources:
        rows = rows.join(source.select(key), key, "left_semi")
    return rows


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))
