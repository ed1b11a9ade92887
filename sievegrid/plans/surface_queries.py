"""Queries over single operators of the surface: reading and writing, projections, text, designs and their validations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.functions import primitives as P
from sievegrid.operators import checks as K
from sievegrid.operators import evaluation as E
from sievegrid.operators import preparation as prep
from sievegrid.operators import selection as sel
from sievegrid.operators.ordering import rank_by_value
from sievegrid.plans import diagnostic_queries
from sievegrid.plans import study as T
from sievegrid.plans.queries import _ALPHAS, _CLIENTS, _ORDERS, _POOLS, _evaluated, _orders, query
from sievegrid.session import new_path, stage, table
from sievegrid.sources import readers

QUERIES, ORACLE = diagnostic_queries.QUERIES, diagnostic_queries.ORACLE


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


# Sources and sinks: what was written is read again.


@query("p01_whole_table", "SELECT r_regionkey, r_name FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema("r_regionkey long, r_name string").parquet(f"{sf}/region.parquet")


@query("p02_release", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "release")
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment").withColumn("part", F.pmod("c_custkey", F.lit(3))).write.partitionBy("part").parquet(path)
    rows = readers.read_release(spark, path).select("c_custkey", "c_mktsegment")
    return rank_by_value(rows, "c_custkey", "c_mktsegment", "place").select("c_custkey", "c_mktsegment", "place")


_MARKET = "SELECT lower(md5(c_custkey::VARCHAR)) AS sha256, c_name AS package, c_mktsegment AS markets, c_nationkey::DOUBLE AS vt_count FROM customer"


def _market(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    path = new_path(spark, "market-index")
    rows = table(spark, sf, "customer").select(F.upper(F.md5(F.col("c_custkey").cast("string"))).alias("sha256"), F.col("c_name").alias("pkg_name"), F.col("c_mktsegment").alias("markets"), F.col("c_nationkey").alias("vt_detection"))
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return rows, path


@query("p03_gz_csv", _MARKET)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = _market(spark, sf)
    return readers.read_market_index(spark, path, rows)


@query("d04_market_index", f"{_MARKET} WHERE c_custkey % 3 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, path = _market(spark, sf)
    wanted = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.md5(F.col("c_custkey").cast("string")).alias("sha256"))
    return readers.read_market_index(spark, path, wanted)


@query("p04_typed_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "typed")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("p05_sinks", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "sinks")
    readers.write_report(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), path, ["s_suppkey"])
    return readers.read_csv(spark, path, "s_suppkey long, s_nationkey long")


@query("p07_documents", "SELECT count(*) AS suppliers, count(DISTINCT s_nationkey) AS nations FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "document")
    row = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("suppliers"), F.count_distinct("s_nationkey").alias("nations")).first()
    readers.write_document(spark, path, row.asDict())
    found = readers.read_document(spark, path)
    return spark.createDataFrame([(found["suppliers"], found["nations"])], "suppliers long, nations long")


@query("d01_fingerprints")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return readers.file_digests(spark, sf, "*.parquet").select("name", "digest")


# Projections and predicates.


@query("p10_project", "SELECT c_custkey AS customer, c_acctbal * 2 AS twice, c_mktsegment FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").withColumns({"twice": F.col("c_acctbal") * 2, "gone": F.lit(1)}).withColumnRenamed("c_custkey", "customer").drop("gone").select("customer", "twice", "c_mktsegment")


@query("p11_filter", "SELECT count(*) AS n FROM lineitem WHERE (l_quantity > 20 OR l_discount < 0.02) AND NOT (l_returnflag = 'A')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(((F.col("l_quantity") > 20) | (F.col("l_discount") < 0.02)) & ~(F.col("l_returnflag") == "A")).agg(_n())


_WITH_ORDERS = "c AS (SELECT c_custkey, c_mktsegment, total FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_totalprice > 250000 GROUP BY 1) ON o_custkey = c_custkey)"


def _with_orders(spark: SparkSession, sf: str) -> DataFrame:
    most = table(spark, sf, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("total"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(most, "c_custkey", "left")


@query("p13_finite", f"WITH {_WITH_ORDERS} SELECT count(*) FILTER (WHERE total IS NULL) AS missing, count(*) FILTER (WHERE total IS NOT NULL AND total < 'inf'::DOUBLE) AS finite, count(*) AS n FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _with_orders(spark, sf).agg(F.count_if(F.col("total").isNull()).alias("missing"), F.count_if(P.is_finite(F.col("total"))).alias("finite"), _n())


@query("p14_first_match", "SELECT CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 10 THEN 'middle' WHEN l_discount > 0.05 THEN 'cheap' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_quantity") > 40, "large").when(F.col("l_quantity") > 10, "middle").when(F.col("l_discount") > 0.05, "cheap")
    return table(spark, sf, "lineitem").groupBy(kind.alias("kind")).agg(_n())


@query("p15_fill_and_drop", f"WITH {_WITH_ORDERS} SELECT c_mktsegment, round(sum(coalesce(total, 0)), 2) AS filled, count(total) AS kept FROM c GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_orders(spark, sf)
    filled = rows.withColumn("total", F.coalesce("total", F.lit(0.0))).groupBy("c_mktsegment").agg(F.round(F.sum("total"), 2).alias("filled"))
    kept = rows.where(F.col("total").isNotNull()).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("kept"))
    return filled.join(kept, "c_mktsegment", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


@query("p16_cast", "SELECT DISTINCT l_quantity::BIGINT::VARCHAR AS quantity, 'x' AS mark FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").cast("string").alias("quantity"), F.lit("x").alias("mark")).distinct()


@query("p17_single_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.assert_unique(table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1), [])


@query("p25_suffix", "SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    left, right = table(spark, sf, "nation"), table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("n_nationkey_right"), F.col("n_name").alias("n_name_right"))
    return left.join(right, "n_regionkey").where("n_nationkey < n_nationkey_right").select("n_nationkey", "n_name", "n_name_right")


@query("p26_ordered_join", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = rank_by_value(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "place")
    right = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return left.join(right, "o_custkey", "left").select("place", "o_orderkey", "c_mktsegment")


@query("p27_groups_in_order", "SELECT o_orderpriority, count(*) AS n, dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").groupBy("o_orderpriority").agg(_n(), F.min("o_orderkey").alias("first"))
    return groups.withColumn("place", F.dense_rank().over(Window.orderBy("first")) - 1).drop("first")  # a row a priority


@query("p34_unique", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct().agg(_n())


@query("p36_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda x: x["n_name"]), ",").alias("names"))


@query("p38_pivot_mean", "SELECT l_linestatus, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS \"A\", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS \"N\", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS \"R\" FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))


@query("p39_by_group", "SELECT n_regionkey, count(*) AS n, median(n_nationkey) AS middle FROM nation GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_regionkey": [group["n_regionkey"].iloc[0]], "n": [len(group)], "middle": [float(group["n_nationkey"].median())]})

    return table(spark, sf, "nation").select("n_regionkey", "n_nationkey").groupBy("n_regionkey").applyInPandas(reduce, "n_regionkey long, n long, middle double")


@query("p42_approximate", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS near FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The exact counts, and whether the sketches' counts are within a tenth of them."""
    item = table(spark, sf, "lineitem").groupBy("l_returnflag")  # apart: together, a sketch would be kept for each order
    both = P.null_safe_join(item.agg(F.count_distinct("l_orderkey").alias("orders")), item.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("sketched")), ["l_returnflag"])
    return both.select("l_returnflag", "orders", (F.abs(F.col("sketched") / F.col("orders") - 1) < 0.1).alias("near"))


@query("p47_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rank_by_value(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "place").select("o_orderkey", "place")


@query("p53_searchsorted", "SELECT CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 17 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS place, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    edges = F.array(*[F.lit(float(x)) for x in (5, 17, 40)])
    return table(spark, sf, "lineitem").groupBy(F.size(F.filter(edges, lambda e: e < F.col("l_quantity"))).alias("place")).agg(_n())


@query("p55_concat", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return one.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))).groupBy("kind").agg(_n())


@query("p58_case", "SELECT n_nationkey, lower(n_name) AS low, upper(n_name) AS high FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("low"), F.upper("n_name").alias("high"))


@query("p59_strip", "SELECT n_nationkey, n_name AS name FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", P.strip(F.concat(F.lit(" \t\n"), "n_name", F.lit("  "))).alias("name"))


@query("p60_starts_with", "SELECT count(*) FILTER (WHERE starts_with(p_brand, 'Brand#1')) AS first, count(*) AS n FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").agg(F.count_if(F.col("p_brand").startswith("Brand#1")).alias("first"), _n())


@query("p62_list_functions", "SELECT p_partkey, list_aggregate(list_sort(string_split(p_name, ' ')), 'string_agg', ' ') AS sorted, len(string_split(p_name, ' ')) AS n FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(tokens), " ").alias("sorted"), F.size(tokens).alias("n"))


@query("p63_text_concat", "SELECT n_nationkey, n_name || '/' || n_regionkey AS name FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("/"), F.col("n_regionkey").cast("string")).alias("name"))


@query("p66_replace", "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(P.replace_strict(F.col("l_returnflag"), {"A": "accepted", "N": "none", "R": "returned"}).alias("flag")).agg(_n())


@query("p70_dates_and_patterns", "SELECT year(o_orderdate) AS year, regexp_extract(o_orderpriority, '^[0-9]') AS digit, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.regexp_extract("o_orderpriority", "^[0-9]", 0).alias("digit")).agg(_n())


# Preparation.


@query("d02_release_rows", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "release")
    table(spark, sf, "customer").write.partitionBy("c_mktsegment").parquet(path)
    return readers.read_release(spark, path, base=path).groupBy("c_mktsegment").agg(_n())


@query(
    "d03_validate",
    f"""WITH a AS (SELECT count(*) AS n, count(DISTINCT {T.LINE_SQL}) AS k, count(*) FILTER (WHERE l_linenumber < 0) AS negative, count(*) FILTER (WHERE l_linenumber NOT IN (0, 1)) AS non_binary, bool_and(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT >= 10 ELSE l_quantity::BIGINT = 0 END) AS rule FROM lineitem)
 SELECT 'contract' AS name, n = (SELECT count(*) FROM lineitem) AND negative = 0 AS passed, negative, non_binary FROM a UNION ALL SELECT 'unique_hashes', n = k, negative, non_binary FROM a UNION ALL SELECT 'label_rule', rule, negative, non_binary FROM a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    line = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    release = rows.select(line.alias("hash"), F.col("l_linenumber").alias("feat_0"), (F.col("l_quantity") > 10).cast("int").alias("feat_1"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").cast("long").alias("vt_count"))
    return prep.check_release(release, ["feat_0", "feat_1"], rows.count(), 10, 0)


@query("d08_first_occurrence", "SELECT p_brand, dense_rank() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return rank_by_value(first, "first", "p_brand", "id").select("p_brand", "id")


@query("d24_family_set", f"WITH {T.LINES} SELECT family, row_number() OVER (ORDER BY count(*) DESC, family) - 1 AS place FROM lines WHERE label = 1 GROUP BY 1 ORDER BY count(*) DESC, family LIMIT 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    top = T.lines(spark, sf).where("label = 1").groupBy("family").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "family").limit(5)
    path = new_path(spark, "family-set")
    readers.write_document(spark, path, {"families": [r.family for r in top.collect()]})
    return spark.createDataFrame(list(enumerate(readers.read_document(spark, path)["families"])), "place long, family string")


@query("d31_study_table", f"WITH {T.STUDY} SELECT role, reason, count(*) AS n, count(DISTINCT package) AS groups FROM study GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.study(spark, sf).groupBy("role", "reason").agg(_n(), F.count_distinct("package").alias("groups"))


@query("d34_restricted", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = prep.overlap(table(spark, sf, "part"), "p_partkey", [table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))])
    ids = kept.select("p_brand").distinct().withColumn("id", F.row_number().over(Window.orderBy("p_brand")) - 1)  # a row a brand
    return kept.select("p_partkey", "p_brand").join(ids, "p_brand").select("p_partkey", "id")


_PARTS_OF_LINES = "(SELECT DISTINCT l_partkey FROM lineitem)"


@query(
    "d43_namespaces",
    f"""SELECT 'row_counts' AS name, (SELECT count(*) FROM part) = (SELECT count(*) FROM {_PARTS_OF_LINES}) AS passed
 UNION ALL SELECT 'unique_keys', (SELECT count(*) = count(DISTINCT p_partkey) FROM part)
 UNION ALL SELECT 'same_keys', NOT EXISTS (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM {_PARTS_OF_LINES}) AND NOT EXISTS (SELECT l_partkey FROM {_PARTS_OF_LINES} EXCEPT SELECT p_partkey FROM part)
 UNION ALL SELECT 'lines_row_counts', (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM orders)
 UNION ALL SELECT 'lines_unique_keys', (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem) AND (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)
 UNION ALL SELECT 'lines_same_keys', NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AND NOT EXISTS (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Parts against those that lines name; lines against orders, whose keys are not single in lines."""
    part, item, orders = (table(spark, sf, t) for t in ("part", "lineitem", "orders"))
    parts = K.same_rows(part, item.select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")
    lines = K.same_rows(item.select(F.col("l_orderkey").alias("o_orderkey")), orders, "o_orderkey")
    return parts.unionByName(lines.withColumn("name", F.concat(F.lit("lines_"), "name")))


@query("d46_arm_columns", "SELECT 'local' AS learner, 'peer-present' AS condition, NULL::BIGINT AS dose, NULL::VARCHAR AS parameter, NULL::DOUBLE AS tuning_value, count(*) AS n FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.normalise_arms(table(spark, sf, "region").agg(_n()).withColumns({"learner": F.lit("local"), "condition": F.lit("peer-present")})).select("learner", "condition", "dose", "parameter", "tuning_value", "n")


@query("d50_one_of", "SELECT n_name FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'CHINA', 'NATION_1', 'NATION_2')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where(F.col("n_name").isin(["FRANCE", "GERMANY", "CHINA", "NATION_1", "NATION_2"])).select("n_name")


# Designs.


@query("e05_family_masks", f"WITH {T.STUDY}, {T.TARGETS} SELECT client, role, count(*) FILTER (WHERE label = 1 AND family IN (SELECT family FROM targets)) AS hidden, count(*) AS n FROM study GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hidden = T.targets(spark, sf).select("family").distinct().withColumn("hidden", F.lit(True))
    marked = T.study(spark, sf).join(hidden, "family", "left")
    return marked.groupBy("client", "role").agg(F.count_if((F.col("label") == 1) & F.coalesce("hidden", F.lit(False))).alias("hidden"), _n())


@query("e06_training_orders", f"WITH {_ORDERS} SELECT client, line, row_number() OVER (PARTITION BY client ORDER BY o, line) - 1 AS place FROM orders_")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, _ = _orders(spark, sf)
    return sel.placed_orders(orders, "line").select("client", "line", "place")


@query("e07_priorities", f"WITH {_ORDERS} SELECT line, p AS priority FROM orders_")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf)[0].select("line", "priority")


_SPEC = f"WITH {T.FAMILIES}, {T.TARGETS}, hidden AS (SELECT DISTINCT client, family FROM targets)"


@query("e08_exposure_spec", f"{_SPEC} SELECT learner, condition, dose, parameter, tuning_value, c.client, h.family, CASE WHEN condition = 'family-absent' OR (condition = 'peer-present' AND c.client = h.client) THEN 0 WHEN condition = 'peer-present' THEN dose END AS cap FROM arms, hidden h, (SELECT DISTINCT client FROM hidden) c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.exposure_spec(spark.createDataFrame(T.ARMS, T.ARM_SCHEMA), T.targets(spark, sf))


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    hidden = stage(hidden, "hidden")
    both = [rows.withColumn("condition", F.lit(c)) for c, rows in sel.trainings(orders, hidden, ["peer-present", "family-absent"], "line", 300).items()]
    return both[0].unionByName(both[1])


_CONDITIONS = f"""{_ORDERS}, peer AS (SELECT * FROM orders_ o WHERE NOT (label = 1 AND EXISTS (SELECT 1 FROM hidden h WHERE h.client = o.client AND h.family = o.family)) QUALIFY row_number() OVER (PARTITION BY client ORDER BY o, line) <= 300),
 absent AS (SELECT * FROM orders_ o WHERE NOT (label = 1 AND family IN (SELECT family FROM hidden)) QUALIFY row_number() OVER (PARTITION BY client ORDER BY o, line) <= 300), trained AS (SELECT *, 'peer-present' AS condition FROM peer UNION ALL SELECT *, 'family-absent' FROM absent), marked AS (SELECT t.*, h.client AS target FROM trained t LEFT JOIN hidden h USING (family))"""


@query("e12_exposure_checks", f"""WITH {_CONDITIONS}, peers AS (SELECT h.family, count(m.line) AS n FROM hidden h LEFT JOIN marked m ON m.family = h.family AND m.label = 1 AND m.client <> h.client AND condition = 'peer-present' GROUP BY 1), volumes AS (SELECT client, min(n) = max(n) AS same FROM (SELECT client, condition, count(*) AS n FROM trained GROUP BY 1, 2) GROUP BY 1)
 SELECT name, CASE name WHEN 'hidden_at_target' THEN (SELECT count(*) = 0 FROM marked WHERE label = 1 AND client = target AND condition = 'peer-present') WHEN 'absent_everywhere' THEN (SELECT count(*) = 0 FROM marked WHERE label = 1 AND target IS NOT NULL AND condition = 'family-absent') WHEN 'peers_present' THEN (SELECT bool_and(n >= 3) FROM peers) WHEN 'equal_sizes' THEN (SELECT bool_and(same) FROM volumes) ELSE (SELECT bool_and(role = 'fit') FROM marked) END AS passed
 FROM (VALUES ('hidden_at_target'), ('absent_everywhere'), ('peers_present'), ('equal_sizes'), ('fit_rows_only')) v(name)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.exposure_checks(_conditions(spark, sf), stage(T.targets(spark, sf), "targets"), 3)


@query("e13_family_fit_rows", f"WITH {T.STUDY} SELECT family, client, count(*) AS rows FROM study WHERE role = 'fit' AND label = 1 GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sel.peer_fit(_orders(spark, sf)[0])


@query("e14_family_totals", f"WITH {T.STUDY} SELECT family, count(*) AS rows FROM study WHERE label = 1 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.study(spark, sf).where("label = 1 and reason = 'eligible'").groupBy("family").agg(F.count(F.lit(1)).alias("rows"))


@query("e15_draw_dose", f"""WITH {_ORDERS} SELECT o.family, line, row_number() OVER (PARTITION BY o.family, h.client ORDER BY {T.draw_sql("'dose'", "5", "line")}, line) AS place FROM orders_ o JOIN hidden h ON h.family = o.family AND h.client <> o.client WHERE label = 1 QUALIFY place <= 25""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    drawn = sel.dose_extras(orders, hidden, "line", 25, 5)
    place = F.row_number().over(Window.partitionBy("family").orderBy(P.draw("dose", 5, F.col("line")), "line"))  # 25 rows a family
    return drawn.select("family", "line", place.alias("place"))


def _placebos(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(orders, base, choices): the two rarest families are hidden, each from the client that has most of it."""
    orders, _ = _orders(spark, sf)
    fit = [tuple(r) for r in sel.peer_fit(orders).collect()]  # a row a family and client
    totals: dict[str, int] = {}
    for family, _, n in fit:
        totals[family] = totals.get(family, 0) + n
    rare = sorted(totals, key=lambda f: (totals[f], f))[:2]
    hidden = [(max((n, c) for f, c, n in fit if f == family)[1], family) for family in rare]
    base = orders.where(~F.col("family").isin(list(totals)) | (F.col("label") == 0))
    free = {(f, c): n for f, c, n in fit}
    needs = {(c, f): {o: min(n, 3) for g, o, n in fit if g == f and o != c} for c, f in hidden}
    return orders, base, sel.choose_placebos(fit, free, needs, 5)


@query("e18_placebos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["client", "family", "placebo", "need", "reallocated", "hidden_peer_fit", "placebo_peer_fit"]
    return spark.createDataFrame([tuple(x[k] for k in keys) for x in _placebos(spark, sf)[2]], "client string, family string, placebo string, need long, reallocated long, hidden_peer_fit long, placebo_peer_fit long")


@query("e19_placebo_rows")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, base, choices = _placebos(spark, sf)
    return sel.placebo_extras(orders, base, choices, "line", 5)


_LEVELS = f"""{_ORDERS}, levels AS (SELECT dose, o.client, line, o.family FROM orders_ o JOIN hidden h ON h.family = o.family AND h.client <> o.client, (VALUES (0), (5), (20)) d(dose) WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY dose, o.family ORDER BY {T.draw_sql("'dose'", "5", "line")}, line) <= dose)"""


@query("e21_dose_checks", f"WITH {_LEVELS} SELECT dose, bool_and(n <= dose) AS passed, sum(n)::BIGINT AS rows FROM (SELECT dose, family, count(*) AS n FROM levels GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    levels = sel.dose_extras(orders, hidden, "line", 20, 5)
    place = F.row_number().over(Window.partitionBy("family").orderBy(P.draw("dose", 5, F.col("line")), "line"))
    spread = levels.withColumn("place", place).withColumn("dose", F.explode(F.array(F.lit(0), F.lit(5), F.lit(20)).cast("array<long>"))).where("place <= dose")
    return K.dose_checks(spread, hidden, "line")


@query("e22_placebo_checks", "SELECT name, true AS passed FROM (VALUES ('counts_matched'), ('placebos_unique'), ('placebos_unhidden')) v(name)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, base, choices = _placebos(spark, sf)
    chosen = spark.createDataFrame([(x["client"], x["family"], x["placebo"], x["need"]) for x in choices], "client string, family string, placebo string, need long")
    return K.placebo_checks(sel.placebo_extras(orders, base, choices, "line", 5), chosen)


# Evaluation and statistics.


@query("v0a_pools", f"WITH {_POOLS} SELECT pool, role, own, unseen, count(*) AS n FROM pool GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.pools(T.study(spark, sf), T.targets(spark, sf)).groupBy("pool", "role", "own", "unseen").agg(_n())


@query("v0c_blend", f"WITH {T.STUDY} SELECT client, round(avg(0.25 / (1 + exp(-score)) + 0.75 / (1 + exp(-2 * score))), 6) AS blended FROM study GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.study(spark, sf).groupBy("client").agg(F.avg(E.blend(F.col("score"), 2 * F.col("score"), 0.25)).alias("blended"))


@query("v0d_first_of_vector", f"WITH {T.STUDY} SELECT client, feature, min(line) AS line FROM study WHERE role = 'test' GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.study(spark, sf).where("role = 'test'").groupBy("client", "feature").agg(F.min("line").alias("line"))


@query("v0h_rates", f"WITH {_CLIENTS} SELECT client, alpha, population, round(hits::DOUBLE / trials, 6) AS rate FROM clients WHERE trials > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf)
    return E.client_counts(pool, thresholds, _ALPHAS).where("trials > 0").select("client", "alpha", "population", (F.col("hits") / F.col("trials")).alias("rate"))


@query("v0k_operating_check", f"WITH {_CLIENTS}, f AS (SELECT c.alpha, avg(hits::DOUBLE / trials) AS v FROM clients c WHERE population = 'benign' AND trials > 0 GROUP BY 1), s AS (SELECT alpha, bool_and(operating_status = 'valid') AS valid FROM thresholds GROUP BY 1), g AS (SELECT coalesce(max(abs(v - alpha)), 0) AS gap FROM f JOIN s USING (alpha) WHERE valid) SELECT 'operating_points' AS name, gap <= 0.05 AS passed, round(gap, 6) AS gap FROM g")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf)
    rates = E.client_counts(pool, thresholds, _ALPHAS).where("population = 'benign' and trials > 0").groupBy("alpha").agg(F.avg(F.col("hits") / F.col("trials")).alias("value"))
    status = thresholds.groupBy("alpha").agg(F.when(P.all_of(F.col("operating_status") == "valid"), F.lit("valid")).otherwise(F.lit("insufficient-evidence")).alias("operating_status"))
    return K.operating_check(rates.join(status, "alpha").withColumn("metric", F.lit("realised-fpr")), 0.05)


_POOL_CHECKS = "SELECT '{0}calibration_own_only' AS name, NOT bool_or(role = 'calibration' AND (NOT own OR client <> pool)) AS passed FROM {1} UNION ALL SELECT '{0}hidden_test_only', NOT bool_or(NOT own AND (role <> 'test' OR NOT unseen OR label <> 1)) FROM {1}"


@query("v0l_pool_checks", f"WITH {_POOLS}, leaky AS (SELECT * REPLACE (false AS own) FROM pool) {_POOL_CHECKS.format('', 'pool')} UNION ALL {_POOL_CHECKS.format('leaky_', 'leaky')}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The pools, and the same with every row marked as from elsewhere, which must fail."""
    pool = E.pools(T.study(spark, sf), T.targets(spark, sf))
    leaky = K.pool_checks(pool.withColumn("own", F.lit(False)))
    return K.pool_checks(pool).unionByName(leaky.withColumn("name", F.concat(F.lit("leaky_"), "name")))


_CELLS = f"""{T.FAMILIES}, cell AS (SELECT seed, client, family, learner, population, max(trials) AS trials, max(hits::DOUBLE / trials) FILTER (WHERE condition = 'peer-present') AS peer, max(hits::DOUBLE / trials) FILTER (WHERE condition = 'family-absent') AS absent FROM families WHERE alpha = 0.05 AND dose IS NULL AND parameter IS NULL AND learner <> 'local' GROUP BY ALL)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.families(spark, sf).where("alpha = 0.05 and dose is null and parameter is null and learner <> 'local'")
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("hits") / F.col("trials")))
    return rows.groupBy("seed", "client", "family", "learner", "population").agg(F.max("trials").alias("trials"), of("peer-present").alias("peer"), of("family-absent").alias("absent"))


@query("s20_sampling_noise", f"WITH {_CELLS} SELECT learner, population, round(avg((peer * (1 - peer) + absent * (1 - absent)) / trials), 6) AS noise FROM cell GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.sampling_noise(_cells(spark, sf), ["learner", "population"])


@query("s29_icc", f"""WITH {_CELLS}, g AS (SELECT learner, family, count(*) AS n, avg(peer - absent) AS m, var_pop(peer - absent) * count(*) AS ss FROM cell WHERE population = 'own-domain' GROUP BY 1, 2), a AS (SELECT learner, count(*) AS k, sum(n) AS t, sum(n * n) AS n2, sum(ss) AS w, sum(n * m) AS s1, sum(n * m * m) AS s2 FROM g GROUP BY 1),
 v AS (SELECT learner, (s2 - s1 * s1 / t) / (k - 1) AS b, w / (t - k) AS within, (t - n2 / t) / (k - 1) AS size FROM a) SELECT learner, round(greatest((b - within) / size, 0) / (greatest((b - within) / size, 0) + within), 6) AS icc FROM v""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return K.intraclass(_cells(spark, sf).where("population = 'own-domain'").withColumn("gain", F.col("peer") - F.col("absent")), ["learner"], "family", "gain")


@query("s36_seed_correlation", f"WITH {_CELLS}, m AS (SELECT learner, population, seed, avg(peer - absent) AS gain, avg(peer) AS recall FROM cell GROUP BY 1, 2, 3) SELECT learner, population, round(corr(gain, recall), 6) AS r FROM m GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = _cells(spark, sf).groupBy("learner", "population", "seed").agg(F.avg(F.col("peer") - F.col("absent")).alias("gain"), F.avg("peer").alias("recall"))
    return K.seed_correlation(means, ["learner", "population"], "gain", "recall")


@query("s22_percentile_limits", f"WITH {_CELLS} SELECT learner, round(quantile_cont(peer - absent, 0.025), 6) AS low, round(quantile_cont(peer - absent, 0.975), 6) AS high FROM cell GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    gain = F.col("peer") - F.col("absent")
    return _cells(spark, sf).groupBy("learner").agg(F.percentile(gain, 0.025).alias("low"), F.percentile(gain, 0.975).alias("high"))


@query("s07_contrast_family", f"WITH {T.SUMMARY} SELECT CASE WHEN e = 'knowledge_gain' AND alpha = 0.05 AND metric = 'federation-wide-recall' THEN 'primary' WHEN e = 'knowledge_gain' THEN 'reference' ELSE 'exploratory' END AS label, count(*) AS n FROM (SELECT DISTINCT learner, alpha, metric FROM summary), (VALUES ('knowledge_gain'), ('pooling_gain')) v(e) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.summary(spark, sf).select("learner", "alpha", "metric").distinct().withColumn("estimand", F.explode(F.array(F.lit("knowledge_gain"), F.lit("pooling_gain"))))
    return rows.groupBy(K.contrast_label(F.col("alpha"), F.col("metric"), F.col("estimand"), 0.05).alias("label")).agg(_n())


@query("c06_permutation_outcome", f"WITH {_CELLS}, g AS (SELECT learner, family, min(peer - absent) AS low, max(peer - absent) AS high FROM cell GROUP BY 1, 2) SELECT learner, family, CASE WHEN low IS NULL OR high IS NULL THEN 'not-estimable' WHEN low >= -0.2 AND high <= 0.2 THEN 'within-band' WHEN low > 0.2 OR high < -0.2 THEN 'outside-band' ELSE 'inconclusive' END AS outcome FROM g")
def _(spark: SparkSession, sf: str) -> DataFrame:
    gain = F.col("peer") - F.col("absent")
    ends = _cells(spark, sf).groupBy("learner", "family").agg(F.min(gain).alias("low"), F.max(gain).alias("high"))
    return ends.select("learner", "family", K.band_outcome(F.col("low"), F.col("high"), 0.2).alias("outcome"))


@query("x21_targets", f"WITH {T.FAMILIES} SELECT DISTINCT client, family FROM families WHERE trials > 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.families(spark, sf).where("trials > 0").select("client", "family").distinct()


@query("g02_arm_label", f"WITH {T.FAMILIES} SELECT CASE WHEN learner = 'local' THEN 'local' WHEN condition = 'full-exposure' THEN 'full exposure' WHEN condition = 'family-absent' THEN learner || ' without the family' WHEN dose IS NOT NULL THEN learner || ' at ' || dose || ' rows' ELSE learner || ' with peers' END AS label, count(*) AS n FROM families GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.families(spark, sf).groupBy(K.arm_label(F.col("learner"), F.col("condition"), F.col("dose")).alias("label")).agg(_n())


@query("g30_groups", f"WITH {_CELLS}, f AS (SELECT learner, family, avg(peer - absent) AS gain FROM cell GROUP BY 1, 2) SELECT learner, family AS \"group\", round(gain, 6) AS gain FROM f UNION ALL SELECT learner, 'all families', round(avg(gain), 6) FROM f GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    by = _cells(spark, sf).groupBy("learner", F.col("family").alias("group")).agg(F.avg(F.col("peer") - F.col("absent")).alias("gain"))
    return by.unionByName(by.groupBy("learner").agg(F.avg("gain").alias("gain")).withColumn("group", F.lit("all families")))
