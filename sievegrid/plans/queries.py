"""The library's own queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.functions import primitives as P
from sievegrid.operators import decomposition as D
from sievegrid.operators import descriptors as V
from sievegrid.operators import evaluation as E
from sievegrid.operators import preparation as prep
from sievegrid.operators import selection as sel
from sievegrid.operators import splits as S
from sievegrid.operators import statistics as stat
from sievegrid.operators import tables as X
from sievegrid.operators.ordering import rank_by_value
from sievegrid.plans import study as T
from sievegrid.session import stage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others as double with 6 places."""

    def one(f) -> Column:  # noqa: ANN001
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        return (c.cast("long") if kind in ("int", "smallint", "tinyint") else F.round(c.cast("double"), 6) if kind in ("double", "float") else c).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


# Primitives.


@query("p12_membership", "SELECT l_shipmode_or_flag AS flag, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_or_flag FROM lineitem WHERE l_returnflag IN ('R', 'A')) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("p18_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("p19_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left").na.fill(0, ["n"])


@query("p20_cross_grid", "SELECT r_name, f AS flag, (SELECT count(*) FROM lineitem WHERE l_returnflag = f) AS n FROM region, (SELECT DISTINCT l_returnflag AS f FROM lineitem)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "region").select("r_name").crossJoin(flags)


@query("p21_null_safe", f"WITH {T.SUMMARY} SELECT a.learner, a.dose, a.seed, round(a.value, 6) AS first, round(b.value, 6) AS second FROM summary a JOIN summary b ON a.seed = b.seed AND a.learner = b.learner AND a.dose IS NOT DISTINCT FROM b.dose WHERE a.alpha = 0.05 AND b.alpha = 0.01 AND a.metric = 'own-domain-recall' AND b.metric = a.metric AND a.condition = 'peer-present' AND b.condition = 'peer-present' AND a.parameter IS NULL AND b.parameter IS NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.summary(spark, sf).where("metric = 'own-domain-recall' and condition = 'peer-present' and parameter is null")
    side = lambda alpha, name: rows.where(F.col("alpha") == alpha).select("learner", "dose", "seed", F.col("value").alias(name))
    return P.null_safe_join(side(0.05, "first"), side(0.01, "second"), ["learner", "dose", "seed"])


@query("p22_semi", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(wanted, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("p23_anti", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    unwanted = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(unwanted, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("p24_arm_pivot", f"WITH {T.SUMMARY} SELECT seed, alpha, metric, round(max(CASE WHEN learner = 'local' THEN value END), 6) AS local, round(max(CASE WHEN learner = 'fedavg' AND condition = 'peer-present' AND dose IS NULL THEN value END), 6) AS peer FROM summary GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    arms = {"local": F.col("learner") == "local", "peer": (F.col("learner") == "fedavg") & (F.col("condition") == "peer-present") & F.col("dose").isNull()}
    return P.arm_values(T.summary(spark, sf), ["seed", "alpha", "metric"], "value", arms)


@query("p28_group_stats", "SELECT l_linestatus, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, min(l_extendedprice) AS first FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median"), F.min("l_extendedprice").alias("first"))


@query("p29_filtered_agg", "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 0) AS deep, round(avg(l_tax) FILTER (WHERE l_quantity > 25), 6) AS tax, coalesce(sum(l_quantity) FILTER (WHERE l_discount > 9), 0) AS none FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(P.safe_sum(F.when(F.col("l_discount") > 0.05, q)).cast("double").alias("deep"), F.avg(F.when(q > 25, F.col("l_tax"))).alias("tax"), P.safe_sum(F.when(F.col("l_discount") > 9, q)).cast("double").alias("none"))


@query("p30_any_all", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, bool_or(l_discount > 0.09) AS any_deep, bool_and(l_quantity > 1) AS all_more FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), P.any_of(F.col("l_discount") > 0.09).alias("any_deep"), P.all_of(F.col("l_quantity") > 1).alias("all_more"))


@query("p31_nunique_null", f"WITH {T.FAMILIES} SELECT learner, count(DISTINCT dose) + max(CASE WHEN dose IS NULL THEN 1 ELSE 0 END) AS doses FROM families GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.families(spark, sf).groupBy("learner").agg(P.n_unique(F.col("dose")).alias("doses"))


@query("p32_std", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS samp, round(stddev_pop(l_quantity), 6) AS pop, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.stddev_samp("l_quantity").alias("samp"), F.stddev_pop("l_quantity").alias("pop"), F.var_samp("l_quantity").alias("var"))


@query("p33_micro_rate", f"WITH {T.FAMILIES} SELECT learner, dose, round(sum(hits) / sum(trials), 6) AS rate FROM families GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.families(spark, sf).groupBy("learner", "dose").agg(P.micro_rate("hits", "trials").alias("rate"))


@query("p35_set_text", "SELECT l_suppkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("p37_pivot", f"WITH {T.SUMMARY} SELECT learner, round(max(value) FILTER (WHERE condition = 'peer-present'), 6) AS \"peer-present\", round(max(value) FILTER (WHERE condition = 'family-absent'), 6) AS \"family-absent\" FROM summary WHERE seed = 1 AND alpha = 0.05 AND dose IS NULL AND parameter IS NULL AND metric = 'federation-wide-recall' GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.summary(spark, sf).where("seed = 1 and alpha = 0.05 and dose is null and parameter is null and metric = 'federation-wide-recall'")
    return P.assert_unique(rows, ["learner", "condition"]).groupBy("learner").pivot("condition", ["peer-present", "family-absent"]).agg(F.max("value"))


@query("p40_macro", f"WITH {T.FAMILIES}, f AS (SELECT learner, condition, family, avg(hits::DOUBLE / trials) AS r FROM families WHERE dose IS NULL GROUP BY ALL) SELECT learner, condition, round(avg(r), 6) AS macro FROM f GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    per = T.families(spark, sf).where("dose is null").groupBy("learner", "condition", "family").agg(F.avg(F.col("hits") / F.col("trials")).alias("r"))
    return per.groupBy("learner", "condition").agg(F.avg("r").alias("macro"))


@query("p41_grouping_sets", f"WITH {T.LINES} SELECT client, family, count(*) AS n, sum(label)::BIGINT AS malware FROM lines GROUP BY GROUPING SETS ((client, family), (family), (client), ())")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.lines(spark, sf).groupingSets([["client", "family"], ["family"], ["client"], []], "client", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("malware"))


@query("p43_window_mean", f"WITH {T.SUMMARY} SELECT learner, dose, seed, metric, alpha, condition, parameter, tuning_value, round(avg(value) OVER (PARTITION BY learner, dose), 6) AS level FROM summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.summary(spark, sf).withColumn("level", F.avg("value").over(Window.partitionBy("learner", "dose"))).select("learner", "dose", "seed", "metric", "alpha", "condition", "parameter", "tuning_value", "level")


@query("p44_best_per_group", f"WITH {T.SUMMARY}, m AS (SELECT parameter, tuning_value, avg(value) AS score FROM summary WHERE alpha = 0.05 AND metric = 'own-domain-recall' AND parameter IS NOT NULL GROUP BY ALL) SELECT parameter, tuning_value, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY score DESC NULLS LAST, tuning_value) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_tuning(T.summary(spark, sf).withColumn("metric", F.regexp_replace("metric", "^own-domain-recall$", "calibration-auroc")), 0.05)


@query("p45_dense_rank", "SELECT DISTINCT p_size, dense_rank() OVER (ORDER BY p_size) AS rank FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.dense_rank_null_last(table(spark, sf, "part").select("p_size").distinct(), "p_size", "rank")


@query("p46_avg_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", P.average_rank("p_size", "p_brand").alias("rank"))


@query("p48_mixed_sort_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC NULLS FIRST, c_acctbal NULLS FIRST, c_custkey) AS place FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("c_mktsegment").orderBy(F.col("c_nationkey").desc_nulls_first(), F.col("c_acctbal").asc_nulls_first(), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.row_number().over(order).alias("place"))


@query("p49_worst_first", f"WITH {T.FAMILIES} SELECT experiment, seed, salt, alpha, population, client, round(hits::DOUBLE / trials, 6) AS recall FROM (SELECT experiment, seed, salt, alpha, population, client, sum(hits) AS hits, sum(trials) AS trials FROM families WHERE learner = 'local' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY experiment, seed, salt, alpha, population ORDER BY hits::DOUBLE / trials, client) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["experiment", "seed", "salt", "alpha", "population"]
    clients = T.families(spark, sf).where("learner = 'local'").groupBy(*keys, "client").agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))
    return D.worst_clients(clients, keys)


@query("p50_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("p51_stride", f"WITH {T.LINES}, f AS (SELECT family, count(*) AS n FROM lines GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, family) - 1 AS rank FROM f) SELECT family, n, rank % 4 AS batch FROM r WHERE rank % 2 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    totals = T.lines(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "family")) - 1)
    return ranked.where("rank % 2 = 0").select("family", "n", (F.col("rank") % 4).alias("batch"))


@query("p52_running", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    up = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(up), 2).alias("total"), F.max("o_totalprice").over(up).alias("most"))


@query("p54_lag", f"WITH {T.FAMILIES}, c AS (SELECT seed, dose, avg(hits::DOUBLE / trials) AS r FROM families WHERE learner = 'fedavg' AND condition = 'peer-present' AND dose IS NOT NULL GROUP BY ALL) SELECT seed, dose, round(r - lag(r) OVER (PARTITION BY seed ORDER BY dose), 6) AS step FROM c")
def _(spark: SparkSession, sf: str) -> DataFrame:
    curve = T.families(spark, sf).where("learner = 'fedavg' and condition = 'peer-present' and dose is not null").groupBy("seed", "dose").agg(F.avg(F.col("hits") / F.col("trials")).alias("r"))
    return curve.select("seed", "dose", (F.col("r") - F.lag("r").over(Window.partitionBy("seed").orderBy("dose"))).alias("step"))


@query("p56_diagonal", "SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL BY NAME SELECT 'part' AS kind, p_partkey AS key, p_brand AS brand FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    parts = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    return customers.unionByName(parts, allowMissingColumns=True)


@query("p57_setops", "(SELECT c_nationkey AS key, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT SELECT c_nationkey, 'none' FROM customer)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"))
    rest = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key")).subtract(c)
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(rest.withColumn("kind", F.lit("none")))


@query("p61_tokens", "WITH m AS (SELECT l_suppkey, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand DESC) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT l_suppkey, array_to_string(list_sort(string_split(t, '|')), '|') AS markets, len(string_split(t, '|')) AS market_count FROM m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = both.groupBy("l_suppkey").agg(F.array_join(F.reverse(F.array_sort(F.collect_set("p_brand"))), "|").alias("t"))
    return text.select("l_suppkey", P.sorted_tokens(F.col("t")).alias("markets"), F.size(F.split("t", "[|]")).alias("market_count"))


@query("p64_horizontal", "SELECT p_partkey, greatest(p_size, 25) AS most, least(p_size, 25) AS least, coalesce(p_size, 0) + length(p_name) AS total FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.greatest("p_size", F.lit(25)).alias("most"), F.least("p_size", F.lit(25)).alias("least"), (F.coalesce("p_size", F.lit(0)) + F.length("p_name")).alias("total"))


@query("p65_scalars", "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS l, round(sign(p_size - 25) * ln(1 + abs(p_size - 25)), 6) AS s, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) AS g, round(tanh(atanh(p_size / 100.0)), 6) AS z, upper(lower(p_name)) AS u FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("p_size") - 25
    return table(spark, sf, "part").select("p_partkey", F.log1p("p_retailprice").alias("l"), prep.signed_log(d).alias("s"), (1 / (1 + F.exp(-d / F.lit(10.0)))).alias("g"), F.tanh(F.atanh(F.col("p_size") / 100.0)).alias("z"), F.upper(F.lower("p_name")).alias("u"))


@query("p67_higher_quantile", f"WITH {T.LINES}, r AS (SELECT client, score, row_number() OVER (PARTITION BY client ORDER BY score) - 1 AS place_, count(*) OVER (PARTITION BY client) AS n FROM lines WHERE label = 0) SELECT client, round(score, 6) AS threshold, n FROM r WHERE place_ = ceil((1 - 0.05) * (n - 1))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.higher_quantile(T.lines(spark, sf).where("label = 0"), ["client"], "score", F.lit(1 - 0.05), "threshold")


@query("p68_linear_quantile", f"WITH {T.LINES} SELECT client, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high FROM lines GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return T.lines(spark, sf).groupBy("client").agg(F.percentile("score", F.lit(0.025)).alias("low"), F.percentile("score", F.lit(0.975)).alias("high"))


@query("p69_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.corr("l_extendedprice", "l_quantity").alias("r"))


# Preparation, splits and pairs.

_ROLE_COUNTS = "counts AS (SELECT client, family, role, count(*) AS rows FROM study WHERE reason = 'eligible' GROUP BY ALL), fit_rows AS (SELECT client, count(*) AS fit_rows FROM study WHERE role = 'fit' GROUP BY 1), by_role AS (SELECT client, family, sum(rows) FILTER (WHERE role = 'fit') AS target_fit_rows, coalesce(sum(rows) FILTER (WHERE role = 'test'), 0) AS target_test_rows FROM counts GROUP BY ALL)"


@query("d05_link", "SELECT l_suppkey::VARCHAR AS sha256, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS markets, count(DISTINCT p_brand) AS market_count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    metadata = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("sha256"), F.lit(1.0).alias("vt_count"))
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    index = both.groupBy(F.col("l_suppkey").cast("string").alias("sha256")).agg(F.array_join(F.collect_set("p_brand"), "|").alias("markets")).withColumns({"package": F.col("sha256"), "vt_count": F.lit(1.0)})
    linked, _ = prep.link_sources(metadata, index)
    return linked.select("sha256", "markets", "market_count")


@query("d06_assign", f"WITH {T.LINES} SELECT CASE WHEN family = 'Brand#11' AND month < '1995-06' THEN 'early' WHEN family = 'Brand#11' THEN 'late' WHEN family = 'Brand#12' THEN 'second' WHEN family = 'Brand#13' THEN 'third' END AS client, count(*) AS n FROM lines WHERE family IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.lines(spark, sf).drop("client").withColumns({"markets": F.col("family"), "market_count": F.lit(1), "year_month": F.col("month")})
    return prep.assign_clients(rows, {"Brand#12": "second", "Brand#13": "third"}, "Brand#11", "1995-06", ("early", "late")).groupBy("client").agg(F.count(F.lit(1)).alias("n"))


@query("d07_support", f"WITH {T.LINES} SELECT client, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS malware_rows, count(*) FILTER (WHERE label = 0) AS benign_rows, count(DISTINCT package) AS packages FROM lines GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.client_support(T.lines(spark, sf))




@query("d11_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one order or one feature tuple are one component; whole table."""
    found = prep.identities(T.lines(spark, sf), "line", "package", "feature")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("package").alias("packages"))


@query(
    "d11_customer_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT c_mktsegment || '-' || (c_custkey % 97) AS a, 'n' || c_nationkey || '-' || (c_custkey // 1000) AS b FROM customer),
 n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT u AS node, u AS r FROM n UNION SELECT n.v, reach.r FROM reach JOIN n ON reach.node = n.u)
 SELECT node, min(r) AS component FROM reach GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.operators.graph import connected_components

    c = table(spark, sf, "customer")
    edges = c.select(F.concat_ws("-", "c_mktsegment", F.col("c_custkey") % 97).alias("x"), F.concat_ws("-", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.floor(F.col("c_custkey") / 1000)).alias("y"))
    return connected_components(edges, "x", "y")


@query("d13_component_summary", f"WITH {T.LINES} SELECT package AS component, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS malware_rows, count(DISTINCT family) AS packages FROM lines GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.lines(spark, sf)
    return prep.component_summary(rows.select("line", F.col("package").alias("component")), rows.drop("package"), "line", "family")


@query("d14_reason", "SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'not-in-family-set' WHEN trim(source) = '' THEN 'empty-label' WHEN source IN ('src1', 'src2') THEN 'unknown-label' WHEN starts_with(source, 'src1') THEN 'singleton-label' ELSE 'eligible' END AS reason FROM documents")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"), F.when(F.col("n_chars") % 5 == 0, 0).otherwise(1).alias("label"))
    return prep.classify_labels(rows, ["src1", "src2"], "src1").select("doc_id", "reason")


@query("d15_corpus_support", f"WITH {T.STUDY} SELECT client, family, count(*) AS rows FROM study WHERE reason = 'eligible' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.corpus_support(T.study(spark, sf))


@query("d16_label_eligibility", f"WITH {T.STUDY} SELECT reason, count(*) AS rows, count(DISTINCT family) AS packages FROM study WHERE label = 1 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.label_eligibility(T.study(spark, sf))


@query("d17_family_sets", f"WITH {T.STUDY}, t AS (SELECT family, count(*) AS rows, count(DISTINCT client) AS c FROM study WHERE reason = 'eligible' GROUP BY 1 HAVING count(*) >= 400 AND count(DISTINCT client) >= 2), r AS (SELECT *, row_number() OVER (ORDER BY rows DESC, family) - 1 AS rank FROM t) SELECT CASE WHEN rank % 2 = 0 THEN 'primary' ELSE 'replication' END AS family_set, rank // 2 AS place, family, rows FROM r WHERE rank // 2 < 8")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.family_sets(prep.corpus_support(T.study(spark, sf)), 400, 2, 8)


_CONTROLLED = f"{T.STUDY}, {_ROLE_COUNTS}, pairs AS (SELECT client, family, target_fit_rows, target_test_rows, total_fit_rows, federation_test_rows, fit_rows, total_fit_rows - target_fit_rows AS peer_fit_rows FROM (SELECT *, sum(target_fit_rows) OVER (PARTITION BY family) AS total_fit_rows, sum(target_test_rows) OVER (PARTITION BY family) AS federation_test_rows FROM by_role) JOIN fit_rows USING (client) WHERE target_fit_rows IS NOT NULL), controlled AS (SELECT *, {T.RULE_SQL} AS eligible FROM pairs)"
_PAIR_COLUMNS = "client, family, target_fit_rows::BIGINT AS target_fit_rows, target_test_rows::BIGINT AS target_test_rows, total_fit_rows::BIGINT AS total_fit_rows, peer_fit_rows::BIGINT AS peer_fit_rows, eligible"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.study(spark, sf)
    return S.controlled_pairs(S.role_counts(rows), S.client_fit_rows(rows), T.RULE)


@query("d18_large_sets", f"WITH {_CONTROLLED}, t AS (SELECT family, count(*) AS rows FROM study WHERE reason = 'eligible' GROUP BY 1), e AS (SELECT family, count(*) AS eligible_pairs, count(*) FILTER (WHERE target_test_rows >= 30) AS own_domain_pairs FROM controlled WHERE eligible GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY rows DESC, family) - 1 AS rank FROM t JOIN e USING (family)) SELECT *, rank % 4 + 1 AS batch FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.large_family_sets(prep.corpus_support(T.study(spark, sf)), _pairs(spark, sf), 30, 4)


@query("d19_role_counts", f"WITH {T.STUDY}, {_ROLE_COUNTS} SELECT * FROM counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.role_counts(T.study(spark, sf))


@query("d20_controlled", f"WITH {_CONTROLLED} SELECT {_PAIR_COLUMNS}, federation_test_rows::BIGINT AS federation_test_rows, fit_rows FROM controlled")
def d20_controlled(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query("d21_natural", f"WITH {T.STUDY}, {_ROLE_COUNTS}, total AS (SELECT family, sum(target_fit_rows) AS total_fit_rows FROM by_role GROUP BY 1 HAVING sum(target_fit_rows) IS NOT NULL), p AS (SELECT f.client, t.family, t.total_fit_rows, coalesce(target_fit_rows, 0) AS target_fit_rows, coalesce(target_test_rows, 0) AS target_test_rows FROM fit_rows f CROSS JOIN total t LEFT JOIN by_role b ON b.client = f.client AND b.family = t.family), q AS (SELECT *, total_fit_rows - target_fit_rows AS peer_fit_rows, target_fit_rows / total_fit_rows AS target_share FROM p) SELECT {_PAIR_COLUMNS}, round(target_share, 6) AS target_share FROM (SELECT *, target_share <= 0.18 AND peer_fit_rows >= 300 AND target_test_rows >= 25 AS eligible FROM q)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.study(spark, sf)
    return S.natural_pairs(S.role_counts(rows), S.client_fit_rows(rows), 0.18, 300, 25)


@query("d22_assign_targets")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    names = [r.family for r in pairs.select("family").distinct().orderBy("family").collect()]
    return spark.createDataFrame(S.assign_targets(pairs, names, 1, 500), "client string, family string")


@query("d23_permuted_labels", f"""WITH {T.STUDY}, e AS (SELECT line, family FROM study WHERE reason = 'eligible'), h AS (SELECT line, row_number() OVER (ORDER BY {T.draw_sql("'place'", "line")}, line) AS k FROM e), t AS (SELECT family, row_number() OVER (ORDER BY {T.draw_sql("1", "7", "line")}, line) AS k FROM e), m AS (SELECT line, t.family FROM h JOIN t USING (k)) SELECT study.line, coalesce(m.family, study.family) AS family FROM study LEFT JOIN m ON study.line = m.line""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.permuted_labels(T.study(spark, sf), "line", 1, 7).select("line", "family")


@query("d26_roles", f"WITH {T.STUDY} SELECT package, role FROM roles")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.assign_roles(T.lines(spark, sf), "package", 1, 0, 0)


@query("d27_fit_rows", f"WITH {T.STUDY}, {_ROLE_COUNTS} SELECT * FROM fit_rows")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.client_fit_rows(T.study(spark, sf))


@query("d29_leakage", f"WITH {T.STUDY}, l AS (SELECT 'package' AS key, package::VARCHAR AS v, role FROM study UNION ALL SELECT 'feature', feature, role FROM study) SELECT key, count(*) FILTER (WHERE n > 1) AS leaking FROM (SELECT key, v, count(DISTINCT role) AS n FROM l GROUP BY ALL) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.leakage(T.study(spark, sf), ["package", "feature"])


@query("d30_best_attempt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.lines(spark, sf).withColumn("reason", F.when(F.col("label") == 0, F.lit("not-in-family-set")).otherwise(F.lit("eligible")))
    return S.best_attempt(rows, "package", 1, 0, 16, T.RULE)


@query("d33_overlap", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem").withColumn("s_suppkey", F.col("l_suppkey"))
    kept = prep.overlap(table(spark, sf, "supplier"), "s_suppkey", [item.where("l_discount > 0.09"), item.where("l_quantity > 49")])
    return rank_by_value(kept.select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "row").select("s_suppkey", "row")


@query("d36_sparse", "WITH l AS (SELECT vec_id, unnest(embedding) AS val, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings) SELECT idx, count(*) AS n, round(sum(sign(val) * ln(1 + abs(val::DOUBLE))), 4) AS total FROM l WHERE val <> 0 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.sources.readers import sparse_rows

    rows = sparse_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rows.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(prep.signed_log(F.col("val").cast("double"))), 4).alias("total"))


# Selection.

_ORDERS = f"""{T.STUDY}, {T.TARGETS}, hidden AS (SELECT DISTINCT client, family FROM targets), orders_ AS (SELECT *, {T.draw_sql("'order'", "1", "0", "line")} AS o, {T.draw_sql("'priority'", "1", "0", "line")} AS p FROM study WHERE role = 'fit')"""


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sel.training_orders(T.study(spark, sf), "line", 1, 0), T.targets(spark, sf).select("client", "family").distinct()


@query("e10_select_training", f"""WITH {_ORDERS}, kept AS (SELECT * FROM orders_ o WHERE NOT (label = 1 AND EXISTS (SELECT 1 FROM hidden h WHERE h.client = o.client AND h.family = o.family))) SELECT client, line FROM kept QUALIFY row_number() OVER (PARTITION BY client ORDER BY o, line) <= 600""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    return sel.within_budget(sel.hidden_rows(orders, hidden, "peer-present"), "line", 600).select("client", "line")


@query("e09_capped_dose", f"""WITH {_ORDERS}, m AS (SELECT o.*, h.client AS target FROM orders_ o LEFT JOIN hidden h USING (family)), r AS (SELECT *, row_number() OVER (PARTITION BY family, label = 1 AND client <> target ORDER BY p, line) AS k FROM m) SELECT client, family, count(*) AS n FROM r WHERE NOT (target IS NOT NULL AND label = 1) OR (client <> target AND k <= 20) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    return sel.capped(orders, hidden, "line", 20).groupBy("client", "family").agg(F.count(F.lit(1)).alias("n"))


@query("e11_exposure", f"""WITH {_ORDERS}, t AS (SELECT client, count(*) AS train_rows FROM orders_ GROUP BY 1), f AS (SELECT client, family, count(*) AS rows FROM orders_ WHERE label = 1 GROUP BY ALL) SELECT t.client, g.family, coalesce(rows, 0) AS rows, train_rows FROM t CROSS JOIN (SELECT DISTINCT family FROM hidden) g LEFT JOIN f ON f.client = t.client AND f.family = g.family""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    return sel.exposure_counts(orders, hidden).select("client", "family", "rows", "train_rows")


_EXTRAS = f"""{_ORDERS}, base AS (SELECT * FROM orders_ o WHERE NOT (label = 1 AND family IN (SELECT family FROM hidden)) QUALIFY row_number() OVER (PARTITION BY client ORDER BY o, line) <= 600),
 extras AS (SELECT o.client, line, o.family, label FROM orders_ o JOIN hidden h ON h.family = o.family AND h.client <> o.client WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY o.family, h.client ORDER BY {T.draw_sql("'dose'", "5", "line")}, line) <= 10)"""


@query("e16_dose_extras", f"WITH {_EXTRAS} SELECT * FROM extras")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    return sel.dose_extras(orders, hidden, "line", 10, 5)


@query("e17_substitute", f"""WITH {_EXTRAS}, s AS (SELECT client, line, family, label, row_number() OVER (PARTITION BY client ORDER BY {T.draw_sql("'slot'", "5", "line")}, line) AS k FROM base), x AS (SELECT client, line, family, label, row_number() OVER (PARTITION BY client ORDER BY {T.draw_sql("'extra'", "5", "line")}, line) AS k FROM extras) SELECT s.client, coalesce(x.line, s.line) AS line, coalesce(x.family, s.family) AS family, coalesce(x.label, s.label) AS label FROM s LEFT JOIN x ON x.client = s.client AND x.k = s.k""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders, hidden = _orders(spark, sf)
    base = sel.within_budget(sel.hidden_rows(orders, hidden, "family-absent"), "line", 600)
    return sel.substitute(base, sel.dose_extras(orders, hidden, "line", 10, 5), "line", 5)


# Evaluation.

_POOLS = f"""{T.STUDY}, {T.TARGETS}, hidden AS (SELECT DISTINCT client, family FROM targets), pool AS (SELECT s.client AS pool, s.*, true AS own, label = 1 AND h.family IS NOT NULL AS unseen FROM study s LEFT JOIN hidden h ON h.client = s.client AND h.family = s.family WHERE role IN ('calibration', 'test') UNION ALL SELECT h.client, s.*, false, true FROM study s JOIN hidden h ON h.family = s.family AND h.client <> s.client WHERE role = 'test' AND label = 1),
 alphas(alpha) AS (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)), cal AS (SELECT client, alpha, score, row_number() OVER (PARTITION BY client, alpha ORDER BY score) - 1 AS place_, count(*) OVER (PARTITION BY client, alpha) AS n FROM study, alphas WHERE role = 'calibration' AND label = 0),
 thresholds AS (SELECT client, alpha, score AS threshold, n AS calibration_benign, CASE WHEN n * alpha >= 10 THEN 'valid' ELSE 'insufficient-evidence' END AS operating_status FROM cal WHERE place_ = ceil((1 - alpha) * (n - 1)))"""
_ALPHAS = [0.01, 0.05, 0.1]
_CLIENTS = f"""{_POOLS}, member AS (SELECT pool AS client, population, score FROM pool, (VALUES ('benign'), ('known-family'), ('own-domain'), ('federation-wide')) p(population) WHERE role = 'test' AND CASE population WHEN 'benign' THEN own AND label = 0 WHEN 'known-family' THEN own AND label = 1 AND NOT unseen WHEN 'own-domain' THEN own AND label = 1 AND unseen ELSE label = 1 AND unseen END),
 grid AS (SELECT client, alpha, threshold, population FROM thresholds, (VALUES ('benign'), ('known-family'), ('own-domain'), ('federation-wide')) p(population)),
 clients AS (SELECT g.client, g.alpha, g.population, count(*) FILTER (WHERE score > threshold) AS hits, count(score) AS trials FROM grid g LEFT JOIN member m ON m.client = g.client AND m.population = g.population GROUP BY ALL)"""


def _thresholds(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Thresholds of every client of the study; clients are read apart, for rows may lack those that only fit."""
    found = E.calibrate(rows.where("role = 'calibration' and label = 0").select("client", "score"), _ALPHAS, 10, ["client"])
    return E.with_missing_thresholds(found, T.lines(spark, sf).where("package is not null").select("client").distinct(), _ALPHAS)


def _evaluated(spark: SparkSession, sf: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calibration and test rows, staged with the columns that are read, their pools, and thresholds, staged too: they are read more than once, and Spark knows how few they are."""
    rows = stage(T.study(spark, sf).where("role <> 'fit'").select("client", "family", "role", "label", "score", *more), "study")
    return rows, E.pools(rows, stage(T.targets(spark, sf), "targets")), stage(_thresholds(spark, sf, rows), "thresholds")


@query("v0e_threshold", f"WITH {_POOLS} SELECT client, alpha, round(threshold, 6) AS threshold, calibration_benign, operating_status FROM thresholds")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _thresholds(spark, sf, T.study(spark, sf))


@query("v0f_counts", f"WITH {_CLIENTS} SELECT * FROM clients")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf)
    return E.client_counts(pool, thresholds, _ALPHAS).select("client", "alpha", "population", "hits", "trials")


@query("v0f_families", f"WITH {_POOLS}, h AS (SELECT pool AS client, family, line, feature, score, population, row_number() OVER (PARTITION BY pool, population, family, feature ORDER BY line) = 1 AS first FROM pool, (VALUES ('own-domain'), ('federation-wide')) p(population) WHERE role = 'test' AND unseen AND (own OR population = 'federation-wide')) SELECT h.client, alpha, population, family, count(*) FILTER (WHERE score > threshold) AS hits, count(*) AS trials, count(*) FILTER (WHERE score > threshold AND first) AS unique_hits, count(*) FILTER (WHERE first) AS unique_trials FROM h JOIN thresholds t ON t.client = h.client GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf, "line", "feature")
    return E.family_counts(pool, thresholds, "line", "feature")


_RANKED = f"{T.STUDY}, ranked AS (SELECT client, role AS split, label, rank() OVER (PARTITION BY client, role ORDER BY score) + (count(*) OVER (PARTITION BY client, role, score) - 1) / 2.0 AS r FROM study WHERE role <> 'fit')"


@query("v0g_auroc", f"WITH {_RANKED} SELECT client, split, round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6)::DOUBLE AS auroc FROM ranked GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.auroc(T.study(spark, sf).where("role <> 'fit'").withColumn("split", F.col("role")), ["client", "split"])


@query("v0g_ap", f"WITH {T.STUDY}, b AS (SELECT client, score, count(*) FILTER (WHERE label = 1) AS p, count(*) AS n FROM study WHERE role = 'test' GROUP BY ALL), c AS (SELECT client, p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM b WINDOW w AS (PARTITION BY client ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT client, round(sum(p * tp / k) / sum(p), 6) AS auprc FROM c GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.average_precision(T.study(spark, sf).where("role = 'test'"), ["client"])


@query("s30_recall_at_fpr", f"WITH {T.STUDY}, b AS (SELECT client, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM study WHERE role = 'test' GROUP BY ALL), c AS (SELECT client, score, sum(p) OVER w / sum(p) OVER (PARTITION BY client) AS y, sum(q) OVER w / sum(q) OVER (PARTITION BY client) AS x FROM b WINDOW w AS (PARTITION BY client ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), d AS (SELECT *, coalesce(lag(y) OVER v, 0) AS y0, coalesce(lag(x) OVER v, 0) AS x0 FROM c WINDOW v AS (PARTITION BY client ORDER BY score DESC)) SELECT client, round(y0 + (y - y0) * (0.05 - x0) / (x - x0), 6) AS recall FROM d WHERE x0 <= 0.05 AND x > 0.05")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.recall_at_fpr(T.study(spark, sf).where("role = 'test'"), ["client"], 0.05)


_FAMILIES = """families AS (SELECT client, alpha, population, family, count(*) FILTER (WHERE score > threshold) AS hits, count(*) AS trials FROM (SELECT pool AS client, family, score, population FROM pool, (VALUES ('own-domain'), ('federation-wide')) p(population) WHERE role = 'test' AND unseen AND (own OR population = 'federation-wide')) JOIN thresholds USING (client) GROUP BY ALL)"""
_CURVES = """bins AS (SELECT client, role AS split, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM study WHERE role <> 'fit' GROUP BY ALL),
 sums AS (SELECT client, split, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM bins WINDOW w AS (PARTITION BY client, split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 curves AS (SELECT client, split, sum(q * (tp - p / 2.0)) / (sum(p) * sum(q)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS auprc FROM sums GROUP BY ALL HAVING sum(p) > 0 AND sum(q) > 0)"""
_METRICS = {
    "own-domain-unseen-recall": "avg(v) FILTER (WHERE population = 'own-domain' AND trials >= 5)",
    "federation-unseen-recall": "avg(v) FILTER (WHERE population = 'federation-wide')",
    "worst-client-unseen-recall": "min(v) FILTER (WHERE population = 'federation-wide')",
    "worst-client-fnr": "max(1 - v) FILTER (WHERE population = 'federation-wide')",
    "client-recall-dispersion": "stddev_pop(v) FILTER (WHERE population = 'federation-wide')",
    "known-family-recall": "avg(v) FILTER (WHERE population = 'known-family')",
    "realised-fpr": "avg(v) FILTER (WHERE population = 'benign')",
    "worst-client-fpr": "max(v) FILTER (WHERE population = 'benign')",
    "fpr-dispersion": "stddev_pop(v) FILTER (WHERE population = 'benign')",
}
_FAMILY_METRICS = {"family-macro-unseen-recall": "avg(hits / trials)", "family-recall-dispersion": "stddev_pop(hits / trials)", "micro-unseen-recall": "sum(hits) / sum(trials)"}
_CURVE_METRICS = {"auroc": "avg(auroc) FILTER (WHERE split = 'test')", "auprc": "avg(auprc) FILTER (WHERE split = 'test')", "calibration-auroc": "avg(auroc) FILTER (WHERE split = 'calibration')"}
_LONG = " UNION ALL ".join(
    [f"SELECT alpha, '{m}' AS metric, {v} AS value FROM r GROUP BY 1" for m, v in _METRICS.items()]
    + [f"SELECT alpha, '{m}', {v} FROM families WHERE population = 'federation-wide' GROUP BY 1" for m, v in _FAMILY_METRICS.items()]
    + [f"SELECT alpha, '{m}', (SELECT {v} FROM curves) FROM alphas" for m, v in _CURVE_METRICS.items()]
)


@query("v0j_summary", f"WITH {_CLIENTS}, {_FAMILIES}, {_CURVES}, r AS (SELECT *, hits::DOUBLE / nullif(trials, 0) AS v FROM clients), long AS ({_LONG}) SELECT l.alpha, metric, round(value, 6) AS value, s.status AS operating_status FROM long l JOIN (SELECT alpha, CASE WHEN bool_or(operating_status <> 'valid') THEN 'insufficient-evidence' ELSE 'valid' END AS status FROM thresholds GROUP BY 1) s ON s.alpha = l.alpha WHERE value IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, pool, thresholds = _evaluated(spark, sf, "line", "feature")
    return E.summarise(E.client_counts(pool, thresholds, _ALPHAS), E.family_counts(pool, thresholds, "line", "feature"), _discrimination(rows), thresholds, 5, [])


def _discrimination(rows: DataFrame) -> DataFrame:
    split = rows.where("role <> 'fit'").withColumn("split", F.col("role"))
    return E.discrimination(split, ["client", "split"])


# Decomposition and doses.

_WIDE = f"""{T.SUMMARY}, base AS (SELECT experiment, seed, salt, alpha, metric, max(value) FILTER (WHERE learner = 'local' AND condition = 'peer-present' AND dose IS NULL) AS local, max(value) FILTER (WHERE learner = 'central' AND condition = 'full-exposure') AS full_ FROM summary GROUP BY ALL),
 wide AS (SELECT s.experiment, s.seed, s.salt, s.alpha, s.metric, s.learner, b.local, b.full_, max(value) FILTER (WHERE condition = 'peer-present' AND dose IS NULL) AS peer, max(value) FILTER (WHERE condition = 'family-absent') AS absent FROM summary s JOIN base b USING (experiment, seed, salt, alpha, metric) WHERE s.learner <> 'local' GROUP BY ALL)"""


@query("a2_decompose", f"WITH {_WIDE} SELECT experiment, seed, salt, alpha, metric, learner, estimand, round(CASE estimand WHEN 'total_gain' THEN peer - local WHEN 'pooling_gain' THEN absent - local WHEN 'knowledge_gain' THEN peer - absent WHEN 'local_deficit' THEN full_ - local ELSE CASE WHEN abs(full_ - local) > 0 THEN (peer - local) / (full_ - local) END END, 6) AS value FROM wide, (VALUES ('total_gain'), ('pooling_gain'), ('knowledge_gain'), ('oracle_gap_recovery'), ('local_deficit')) e(estimand) WHERE estimand <> 'local_deficit' OR learner = 'central'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.decompose(T.summary(spark, sf))


_SEED_EFFECTS = f"""{T.FAMILIES}, q AS (SELECT *, hits::DOUBLE / trials AS r FROM families WHERE alpha = 0.05 AND population = 'federation-wide' AND dose IS NULL AND trials > 0),
 lo AS (SELECT experiment, seed, salt, client, family, max(r) AS local_recall FROM q WHERE learner = 'local' GROUP BY ALL),
 effects AS (SELECT q.experiment, q.seed, q.salt, q.client, q.family, q.learner, lo.local_recall, max(r) FILTER (WHERE condition = 'peer-present') AS peer_recall, max(r) FILTER (WHERE condition = 'family-absent') AS absent_recall, max(r) FILTER (WHERE condition = 'full-exposure') AS full_recall, max(trials) FILTER (WHERE condition = 'peer-present') AS trials, max(r) FILTER (WHERE condition = 'peer-present') - max(r) FILTER (WHERE condition = 'family-absent') AS knowledge_gain FROM q JOIN lo ON lo.seed = q.seed AND lo.client = q.client AND lo.family = q.family WHERE learner <> 'local' GROUP BY ALL)"""


@query("a3_family_seed_effects", f"WITH {_SEED_EFFECTS} SELECT experiment, seed, salt, client, family, learner, round(local_recall, 6) AS local_recall, round(peer_recall, 6) AS peer_recall, round(absent_recall, 6) AS absent_recall, round(full_recall, 6) AS full_recall, trials, round(knowledge_gain, 6) AS knowledge_gain FROM effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.family_seed_effects(T.families(spark, sf), 0.05)


@query("a4_family_effects", f"WITH {_SEED_EFFECTS} SELECT experiment, family, learner, round(avg(local_recall), 6) AS local_recall, round(avg(absent_recall), 6) AS absent_recall, round(avg(peer_recall), 6) AS peer_recall, round(avg(full_recall), 6) AS full_recall, round(avg(knowledge_gain), 6) AS knowledge_gain, round(avg(trials), 6) AS trials, count(DISTINCT seed) AS seeds FROM effects GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.family_effects(D.family_seed_effects(T.families(spark, sf), 0.05))


_DOSES = f"""{T.EXPOSURE}, {T.TARGETS}, effective AS (SELECT e.seed, learner, dose, e.family, sum(rows)::BIGINT AS effective_dose FROM exposure e JOIN targets t ON t.seed = e.seed AND t.family = e.family AND t.client <> e.client GROUP BY ALL)"""


@query("a6_effective_dose", f"WITH {_DOSES} SELECT 'main' AS experiment, seed, 0::BIGINT AS salt, learner, dose, family, effective_dose FROM effective")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.effective_peer_dose(T.exposure(spark, sf), T.targets(spark, sf))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    at_target = T.families(spark, sf).where("learner = 'fedavg'").join(T.targets(spark, sf).select("family", "client").distinct(), ["family", "client"])
    return D.dose_curve(D.dose_recall(at_target, 0.05), D.effective_peer_dose(T.exposure(spark, sf), T.targets(spark, sf)))


_CURVE = f"""{_DOSES}, {T.FAMILIES.removeprefix(T.LINES + ', ')}, rec AS (SELECT f.seed, f.learner, f.dose, f.family, f.client, hits::DOUBLE / trials AS recall FROM families f JOIN (SELECT DISTINCT family, client FROM targets) t ON t.family = f.family AND t.client = f.client WHERE learner = 'fedavg' AND alpha = 0.05 AND population = 'federation-wide' AND condition = 'peer-present' AND parameter IS NULL),
 curve AS (SELECT r.seed, r.learner, r.dose, r.family, r.client, r.recall, e.effective_dose, z.recall AS absent_recall, r.recall - z.recall AS knowledge_gain FROM rec r LEFT JOIN effective e ON e.seed = r.seed AND e.learner = r.learner AND e.family = r.family AND e.dose IS NOT DISTINCT FROM r.dose JOIN rec z ON z.dose = 0 AND z.seed = r.seed AND z.family = r.family)"""


@query("a7_dose_curve", f"WITH {_CURVE} SELECT seed, learner, dose, family, client, round(recall, 6) AS recall, effective_dose, round(knowledge_gain, 6) AS knowledge_gain FROM curve")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(spark, sf).select("seed", "learner", "dose", "family", "client", "recall", "effective_dose", "knowledge_gain")


@query("a9_levels", f"WITH {_CURVE} SELECT learner, dose, round(avg(effective_dose), 6) AS effective_dose, round(avg(recall), 6) AS recall, round(stddev_samp(recall), 6) AS recall_std, round(avg(knowledge_gain), 6) AS knowledge_gain, count(*) FILTER (WHERE effective_dose >= 50) AS observations_met, count(*) AS observations, coalesce(dose::VARCHAR, 'all-available') AS dose_level, avg(effective_dose) >= 50 AS meets_dose_criterion FROM curve GROUP BY learner, dose")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.dose_levels(_curve(spark, sf), 50)


# Statistics.


@query("s04_holm", f"WITH {T.SUMMARY}, p AS (SELECT learner, condition, seed, alpha, metric, dose, parameter, tuning_value, abs(value - 0.5) AS p FROM summary), r AS (SELECT *, concat_ws('|', learner, condition, seed, coalesce(dose, -1), coalesce(parameter, '-'), coalesce((tuning_value * 100)::BIGINT, 0)) AS name FROM p), s AS (SELECT alpha, metric, name, p, (count(*) OVER (PARTITION BY alpha, metric) - row_number() OVER (PARTITION BY alpha, metric ORDER BY p, name) + 1) * p AS s FROM r) SELECT alpha, metric, name, round(least(1, max(s) OVER (PARTITION BY alpha, metric ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM s")
def _(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("|", "learner", "condition", "seed", F.coalesce("dose", F.lit(-1)), F.coalesce("parameter", F.lit("-")), F.coalesce((F.col("tuning_value") * 100).cast("long"), F.lit(0)))
    rows = T.summary(spark, sf).select("alpha", "metric", name.alias("name"), F.abs(F.col("value") - 0.5).alias("p"))
    return stat.holm_adjusted(rows, ["alpha", "metric"], "p", "name").drop("p")


_GAINS = f"{_SEED_EFFECTS}, gains AS (SELECT learner, family, seed, avg(knowledge_gain) AS gain, avg(peer_recall) AS peer FROM effects GROUP BY ALL)"


def _gains(spark: SparkSession, sf: str) -> DataFrame:
    return D.family_seed_effects(T.families(spark, sf), 0.05).groupBy("learner", "family", "seed").agg(F.avg("knowledge_gain").alias("gain"), F.avg("peer_recall").alias("peer"))


@query("s03_paired_effects")
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = _gains(spark, sf).groupBy("learner", "seed").agg(F.avg("gain").alias("gain"))
    return stat.paired_effects(means, ["learner"], "gain")


@query("s06_cluster_bootstrap")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.study(spark, sf).where("role = 'test' and label = 1")
    return stat.cluster_bootstrap(rows, "package", F.col("score") > 0.5, F.col("score") > 0.6, 2000, 3)


@query("s17_variance", f"WITH {_GAINS}, c AS (SELECT learner, family, seed, gain, avg(gain) OVER (PARTITION BY learner) AS g, avg(gain) OVER (PARTITION BY learner, family) AS f, avg(gain) OVER (PARTITION BY learner, seed) AS s FROM gains), t AS (SELECT learner, sum((gain - g) ** 2) AS a, sum((f - g) ** 2) AS bf, sum((s - g) ** 2) AS bs, count(DISTINCT family) AS nf, count(DISTINCT seed) AS ns FROM c GROUP BY 1) SELECT learner, source, round(ss, 6) AS sum_squares, d AS degrees, round(coalesce(ss / nullif(a, 0), 0), 6) AS share FROM (SELECT learner, a, 'family' AS source, bf AS ss, nf - 1 AS d FROM t UNION ALL SELECT learner, a, 'seed', bs, ns - 1 FROM t UNION ALL SELECT learner, a, 'residual', greatest(a - bf - bs, 0), (nf - 1) * (ns - 1) FROM t)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.variance_shares(_gains(spark, sf), ["learner"], "family", "seed", "gain")


_FAMILY_MEANS = f"{_GAINS}, means AS (SELECT learner, family, round(avg(gain), 9) AS gain, round(avg(peer), 9) AS peer FROM gains GROUP BY ALL)"


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return _gains(spark, sf).groupBy("learner", "family").agg(F.round(F.avg("gain"), 9).alias("gain"), F.round(F.avg("peer"), 9).alias("peer"))


@query("s23_spearman", f"WITH {_FAMILY_MEANS}, r AS (SELECT learner, rank() OVER (PARTITION BY learner ORDER BY gain) + (count(*) OVER (PARTITION BY learner, gain) - 1) / 2.0 AS a, rank() OVER (PARTITION BY learner ORDER BY peer) + (count(*) OVER (PARTITION BY learner, peer) - 1) / 2.0 AS b FROM means) SELECT learner, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.spearman_table(_means(spark, sf), ["learner"], "gain", "peer")


@query("s28_anova", f"WITH {_GAINS}, c AS (SELECT learner, family, gain, avg(gain) OVER (PARTITION BY learner) AS g, avg(gain) OVER (PARTITION BY learner, family) AS u FROM gains), p AS (SELECT learner, family, count(*) AS n, sum((u - g) ** 2) AS b, sum((gain - u) ** 2) AS w FROM c GROUP BY ALL), t AS (SELECT learner, sum(b) AS between_, sum(w) AS within_, count(*) AS k, sum(n) AS total, sum(n * n) AS sq FROM p GROUP BY 1), m AS (SELECT *, between_ / (k - 1) AS mb, within_ / (total - k) AS mw, (total - sq / total) / (k - 1) AS size FROM t) SELECT learner, round(between_, 6) AS \"between\", round(within_, 6) AS within, round(mb, 6) AS ms_between, round(mw, 6) AS ms_within, round(size, 6) AS size, round(greatest((mb - mw) / size, 0) / nullif(greatest((mb - mw) / size, 0) + mw, 0), 6) AS icc FROM m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.anova(_gains(spark, sf), ["learner"], "family", "gain")


@query("s32_kendall", f"WITH {_GAINS}, r AS (SELECT learner, family, seed, rank() OVER (PARTITION BY learner, seed ORDER BY gain) + (count(*) OVER (PARTITION BY learner, seed, gain) - 1) / 2.0::DOUBLE AS r FROM gains), s AS (SELECT learner, family, sum(r) AS s, count(*) AS m FROM r GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY learner) AS n FROM s) SELECT learner, round(12 * sum((s - m * (n + 1) / 2.0::DOUBLE) ** 2) / (max(m) ** 2 * (max(n) ** 3 - max(n))), 6) AS w FROM n GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.kendall_table(_gains(spark, sf), ["learner"], "family", "seed", "gain")


@query("s33_leave_one_out", f"WITH {_FAMILY_MEANS}, m AS (SELECT * FROM means WHERE learner = 'fedavg'), x AS (SELECT o.family AS left_out, m.family, m.gain, m.peer FROM m o JOIN m ON m.family <> o.family), r AS (SELECT left_out, rank() OVER (PARTITION BY left_out ORDER BY gain) + (count(*) OVER (PARTITION BY left_out, gain) - 1) / 2.0 AS a, rank() OVER (PARTITION BY left_out ORDER BY peer) + (count(*) OVER (PARTITION BY left_out, peer) - 1) / 2.0 AS b FROM x) SELECT left_out, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.leave_one_out_table(_means(spark, sf).where("learner = 'fedavg'"), "family", "gain", "peer")


# Confirmatory tables.


@query("c12_top_families", f"WITH {T.FAMILIES} SELECT family, round(avg(trials), 6) AS trials FROM families WHERE population = 'federation-wide' GROUP BY 1 ORDER BY avg(trials) DESC, family LIMIT 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_families(T.families(spark, sf), 3)


@query("c13_micro", f"WITH {T.FAMILIES} SELECT experiment, seed, salt, round(sum(hits) FILTER (WHERE condition = 'peer-present') / sum(trials) FILTER (WHERE condition = 'peer-present') - sum(hits) FILTER (WHERE condition = 'family-absent') / sum(trials) FILTER (WHERE condition = 'family-absent'), 6) AS gain FROM families WHERE learner = 'fedavg' AND dose IS NULL AND alpha = 0.05 AND population = 'federation-wide' GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.micro_gain(T.families(spark, sf), 0.05, None)


_CELLS = f"""{T.FAMILIES}, q AS (SELECT *, hits::DOUBLE / trials AS r FROM families WHERE alpha = 0.05 AND dose IS NULL AND trials > 0), w AS (SELECT experiment, seed, salt, population, client, family, max(r) FILTER (WHERE learner = 'fedavg' AND condition = 'peer-present') AS peer_recall, max(r) FILTER (WHERE learner = 'fedavg' AND condition = 'family-absent') AS absent_recall, max(r) FILTER (WHERE learner = 'local') AS local_recall, max(trials) FILTER (WHERE learner = 'fedavg' AND condition = 'peer-present') AS trials FROM q GROUP BY ALL), g AS (SELECT *, absent_recall - local_recall AS pooling_gain, peer_recall - absent_recall AS knowledge_gain FROM w),
 hcells AS (SELECT *, least(greatest(knowledge_gain, 0), greatest(-pooling_gain, 0)) AS repair, greatest(knowledge_gain, 0) - least(greatest(knowledge_gain, 0), greatest(-pooling_gain, 0)) AS new_capability, least(knowledge_gain, 0) AS harm FROM g)"""


@query("c20_cells", f"WITH {_CELLS} SELECT seed, population, client, family, trials, round(pooling_gain, 6) AS pooling_gain, round(knowledge_gain, 6) AS knowledge_gain, round(repair, 6) AS repair, round(new_capability, 6) AS new_capability, round(harm, 6) AS harm FROM hcells")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.hidden_cells(T.families(spark, sf), 0.05).select("seed", "population", "client", "family", "trials", "pooling_gain", "knowledge_gain", "repair", "new_capability", "harm")


@query("c23_transfer", f"WITH {_CELLS} SELECT population, client, family, round(avg(pooling_gain), 6) AS pooling_gain, round(avg(knowledge_gain), 6) AS knowledge_gain, round(avg(repair), 6) AS repair, round(avg(new_capability), 6) AS new_capability, round(avg(harm), 6) AS harm, count(*) FILTER (WHERE knowledge_gain < 0) AS hurt, count(*) AS observations FROM hcells GROUP BY GROUPING SETS ((population, client, family), (population, family), (population, client), (population))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.transfer_scopes(D.hidden_cells(T.families(spark, sf), 0.05))


@query("c21_reml_shares")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stat.reml_share_table(D.hidden_cells(T.families(spark, sf), 0.05), "population", ["client", "family", "seed"], "knowledge_gain")


@query("s19_pair_shares")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Shares with client and family together as a source of its own, told from the residual by the seeds."""
    return stat.reml_share_table(D.hidden_cells(T.families(spark, sf), 0.05), "population", ["client", "family", "seed"], "knowledge_gain", pair=("client", "family"))


# Descriptors.


@query("v1_descriptors", "WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY ALL) SELECT a.label AS family, b.label AS known, round(sqrt(sum((a.x - b.x) ** 2)), 5) AS distance FROM m a JOIN m b USING (pos) WHERE a.label <> b.label GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = V.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    pairs = V.distances(means.withColumnRenamed("label", "family"), means.withColumnRenamed("label", "known"), "family", "known")
    return pairs.where("family <> known").select("family", "known", F.round("distance", 5).alias("distance"))


@query("v3_relatedness", "WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x, sum(x) > 0 AS a FROM l GROUP BY ALL), d AS (SELECT a.label AS family, b.label AS known, sqrt(sum((a.x - b.x) ** 2)) AS d, count(*) FILTER (WHERE a.a AND b.a) / count(*) FILTER (WHERE a.a OR b.a) AS j FROM m a JOIN m b USING (pos) WHERE a.label <> b.label GROUP BY ALL) SELECT family, known, round(d, 5) AS distance, round(j, 6) AS jaccard, row_number() OVER (PARTITION BY family ORDER BY d, known) AS rank FROM d")
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = V.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    pairs = V.distances(means.withColumnRenamed("label", "family"), means.withColumnRenamed("label", "known"), "family", "known").where("family <> known")
    return V.relatedness(pairs, "family", "known").withColumn("distance", F.round("distance", 5))


@query("l10_federated")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Federated rounds over vectors held by four holders, then every row scored."""
    from sievegrid.operators import learners as L

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).cast("long").alias("label"), (F.pmod("vec_id", F.lit(4))).alias("holder"))
    t = L.Training(width=len(rows.first()["features"]), hidden=(16,), epochs=2)
    weights, _ = L.train_federated(rows, "holder", t, 20)
    return L.score(rows, weights, t).select("vec_id", "label", "score")


# Extension, diagnostic and report tables.

_SCOPED = f"{T.FAMILIES}, recalls AS (SELECT scope, seed, learner, condition, dose, parameter, tuning_value, population, alpha, avg(hits::DOUBLE / trials) AS recall, count(*) AS families FROM families, (VALUES ('pooled'), ('primary')) s(scope) WHERE trials >= CASE WHEN population = 'federation-wide' THEN 1 ELSE 3 END GROUP BY ALL)"


def _recalls(spark: SparkSession, sf: str) -> DataFrame:
    minima = spark.createDataFrame([("main", 3)], "experiment string, min_trials int")
    scopes = spark.createDataFrame([("pooled", "main"), ("primary", "main")], "scope string, experiment string")
    return X.seed_recalls(T.families(spark, sf), minima, scopes)


@query("x1_seed_recalls", f"WITH {_SCOPED} SELECT * REPLACE (round(recall, 6) AS recall) FROM recalls")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _recalls(spark, sf)


_ABSENT = "condition = 'family-absent'"
_DIFFERENCE = "SELECT scope, population, alpha, seed, max(recall) FILTER (WHERE condition = 'peer-present' AND {first}) - max(recall) FILTER (WHERE {second}) AS d FROM recalls WHERE learner = 'fedavg' AND parameter IS NULL GROUP BY ALL"


@query("x2_arm_difference", f"WITH {_SCOPED} SELECT scope, population, alpha, seed, round(d, 6) AS difference FROM ({_DIFFERENCE.format(first='dose IS NULL', second=_ABSENT)})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.arm_difference(_recalls(spark, sf), "fedavg", X.arm_is("peer-present"), X.arm_is("family-absent"))


@query("x3_double_difference", f"WITH {_SCOPED}, a AS ({_DIFFERENCE.format(first='dose IS NULL', second='dose = 0')}), b AS ({_DIFFERENCE.format(first='dose = 100', second='dose = 0')}) SELECT scope, population, alpha, seed, round(a.d - b.d, 6) AS difference FROM a JOIN b USING (scope, population, alpha, seed)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _recalls(spark, sf)
    zero = X.arm_is("peer-present", 0)
    return X.double_difference(X.arm_difference(rows, "fedavg", X.arm_is("peer-present"), zero), X.arm_difference(rows, "fedavg", X.arm_is("peer-present", 100), zero))


_FAMILY_CURVES = f"{T.FAMILIES}, q AS (SELECT *, hits::DOUBLE / trials AS r FROM families WHERE condition = 'peer-present' AND trials > 0 AND parameter IS NULL), gg AS (SELECT *, r - max(r) FILTER (WHERE dose = 0) OVER (PARTITION BY experiment, seed, salt, population, alpha, learner, client, family) AS gain FROM q), curves AS (SELECT experiment, population, alpha, learner, family, dose, avg(gain) AS gain, count(DISTINCT seed) AS seeds FROM gg WHERE gain IS NOT NULL GROUP BY ALL)"


@query("x7_family_curves", f"WITH {_FAMILY_CURVES} SELECT * REPLACE (round(gain, 6) AS gain) FROM curves")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.dose_family_curves(T.families(spark, sf))


@query("x8_consistency", f"WITH {T.EXPOSURE}, {T.TARGETS}, p AS (SELECT e.seed, e.family, dose, coalesce(sum(rows) FILTER (WHERE e.client <> t.client), 0) AS pr, coalesce(sum(rows) FILTER (WHERE e.client = t.client), 0) AS tr FROM exposure e JOIN targets t ON t.seed = e.seed AND t.family = e.family WHERE dose IS NOT NULL GROUP BY ALL), l AS (SELECT 'realised-dose' AS measure, dose, pr <> dose AS bad, pr AS n FROM p UNION ALL SELECT 'target-zero', dose, tr <> 0, tr FROM p) SELECT 'main' AS experiment, measure, dose AS level, count(*) AS checked, count(*) FILTER (WHERE bad) AS mismatched, sum(n)::BIGINT AS rows FROM l GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.dose_consistency(T.exposure(spark, sf), T.targets(spark, sf))


_LARGE = f"{_SEED_EFFECTS}, sm AS (SELECT learner, family, seed, avg(knowledge_gain) AS gain, min(trials) AS trials FROM effects GROUP BY ALL), large AS (SELECT learner, family, avg(gain) AS gain, stddev_samp(gain) AS gain_sd, count(*) AS seeds, min(trials) AS min_trials, min(trials) >= 12 AS enough FROM sm GROUP BY ALL)"


def _large(spark: SparkSession, sf: str) -> DataFrame:
    return X.large_family_table(D.family_seed_effects(T.families(spark, sf), 0.05), None, 12)


@query("x14_large_families", f"WITH {_LARGE} SELECT * REPLACE (round(gain, 6) AS gain, round(gain_sd, 6) AS gain_sd) FROM large")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _large(spark, sf)


@query("x16_reliability", f"WITH {_LARGE}, t AS (SELECT learner, avg(gain) AS m, var_samp(gain) AS b, avg(gain_sd * gain_sd / seeds) AS n FROM large GROUP BY 1) SELECT learner, measure, round(CASE measure WHEN 'gain_mean' THEN m WHEN 'gain_sd' THEN sqrt(b) WHEN 'noise_sd' THEN sqrt(n) WHEN 'signal_sd' THEN sqrt(greatest(b - n, 0)) ELSE greatest(b - n, 0) / b END, 6) AS value FROM t, (VALUES ('gain_mean'), ('gain_sd'), ('noise_sd'), ('signal_sd'), ('reliability')) v(measure)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.reliability(_large(spark, sf), ["learner"])


@query("x18_stability", f"WITH {_CONTROLLED}, g AS (SELECT DISTINCT family FROM study WHERE label = 1), s AS (SELECT family, count(*) AS n, sum(target_test_rows)::BIGINT AS t FROM controlled WHERE eligible GROUP BY 1) SELECT g.family, 1::BIGINT AS seed, coalesce(n, 0) AS eligible_pairs, coalesce(t, 0) AS eligible_test_rows, coalesce(n, 0) > 0 AS eligible FROM g LEFT JOIN s USING (family)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.stability_grid(_pairs(spark, sf).withColumn("seed", F.lit(1).cast("long")), T.lines(spark, sf).where("label = 1").select("family").distinct())


@query("g10_support_levels", f"WITH {T.EXPOSURE}, {T.TARGETS}, p AS (SELECT e.seed, e.family, sum(rows)::BIGINT AS peer_rows, max(rows) / sum(rows) AS top FROM exposure e JOIN targets t ON t.seed = e.seed AND t.family = e.family AND t.client <> e.client WHERE dose IS NULL GROUP BY ALL) SELECT seed, CASE WHEN top >= 0.9 THEN 'single' WHEN top >= 0.35 THEN 'dominant' ELSE 'spread' END AS stratum, count(*) AS cells, round(avg(peer_rows), 6) AS gain FROM p GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cells = X.peer_concentration(T.exposure(spark, sf), T.targets(spark, sf)).withColumn("gain", F.col("peer_rows"))
    return X.support_levels(cells, ["seed"], 0.9, 0.35)


@query("g17_increments", f"WITH {_FAMILY_CURVES}, s AS (SELECT *, lag(dose) OVER w AS low, lag(gain) OVER w AS before FROM curves WHERE dose IS NOT NULL WINDOW w AS (PARTITION BY population, alpha, family ORDER BY dose)) SELECT population, alpha, family, low, dose AS high, round((gain - before) / (dose - low) * 10, 6) AS step FROM s WHERE low IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.dose_increments(X.dose_family_curves(T.families(spark, sf)), ["population", "alpha", "family"])


@query("g19_responses", f"WITH {_FAMILY_CURVES}, r AS (SELECT population, alpha, family, arg_max(gain, dose) AS top, max(gain) FILTER (WHERE dose IS NULL) AS nat, min(dose) FILTER (WHERE gain >= 0.1 AND dose IS NOT NULL) AS onset FROM curves GROUP BY ALL) SELECT population, alpha, family, round(top, 6) AS top_gain, round(nat, 6) AS natural_gain, onset AS onset_dose, CASE WHEN NOT top >= 0.1 THEN 'nonresponsive' WHEN onset <= 10 THEN 'early' ELSE 'late' END AS response FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.response_classes(X.dose_family_curves(T.families(spark, sf)), ["population", "alpha", "family"], 0.1, 10)


@query("g27_score_health", f"WITH {T.LINES} SELECT client, count(score) AS scores, 0::BIGINT AS nonfinite, round(min(score), 6) AS minimum, round(max(score), 6) AS maximum, count(*) FILTER (WHERE abs(score) > 0.9) AS above_large, count(*) FILTER (WHERE abs(score) > 1.2) AS above_extreme FROM lines GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.score_health(T.lines(spark, sf), ["client"], 0.9, 1.2)


_TAXONOMY = f"{_SEED_EFFECTS}, m AS (SELECT family, round(avg(full_) - avg(absent_recall), 9) AS headroom, round(avg(full_), 9) AS full_recall, round(avg(knowledge_gain), 9) AS gain, round(avg(absent_recall) - avg(local_recall), 9) AS pooling FROM (SELECT *, coalesce(full_recall, peer_recall) AS full_ FROM effects) GROUP BY 1)"


@query("y6_taxonomy", f"WITH {_TAXONOMY} SELECT family, round(headroom, 6) AS headroom, round(full_recall, 6) AS full_recall, round(gain, 6) AS gain, round(pooling, 6) AS pooling, CASE WHEN full_recall < 0.55 THEN 1 ELSE 0 END::BIGINT AS poor_classes, concat_ws(' ', CASE WHEN headroom < 0.2 THEN 'low_headroom' END, CASE WHEN headroom >= 0.2 AND full_recall >= 0.55 AND gain >= 0.2 THEN 'exposure_limited' END, CASE WHEN full_recall < 0.55 THEN 'poor_full' END, CASE WHEN pooling >= 0.2 AND abs(gain) < 0.2 THEN 'pooling_sufficient' END, CASE WHEN gain <= -0.2 THEN 'negative_transfer' END) AS labels FROM m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    effects = D.family_seed_effects(T.families(spark, sf), 0.05).withColumn("full_", F.coalesce("full_recall", "peer_recall"))
    nine = lambda c: F.round(c, 9)
    means = effects.groupBy("family").agg(nine(F.avg("full_") - F.avg("absent_recall")).alias("headroom"), nine(F.avg("full_")).alias("full_recall"), nine(F.avg("knowledge_gain")).alias("gain"), nine(F.avg("absent_recall") - F.avg("local_recall")).alias("pooling"))
    return X.taxonomy(means, 0.2, 0.55, ["full_recall"])


@query("r6_calibration", f"WITH {_CLIENTS} SELECT c.client, c.alpha, calibration_benign, trials AS benign_test, round(hits / trials, 6) AS realised_fpr, operating_status, round(hits / trials - c.alpha, 6) AS deviation, abs(hits / trials - c.alpha) > 0.02 AS breach FROM clients c JOIN thresholds t ON t.client = c.client AND t.alpha = c.alpha WHERE population = 'benign'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf)
    return X.operating_calibration(E.client_counts(pool, thresholds, _ALPHAS).select("client", "alpha", "population", "hits", "trials"), thresholds, 0.02)


@query("r7_fpr_summary", f"WITH {_CLIENTS}, k AS (SELECT client, hits / trials AS f, hits / trials - alpha AS d FROM clients WHERE population = 'benign') SELECT client, count(*) AS rows, round(avg(f), 6) AS realised_fpr, round(avg(d), 6) AS deviation, round(max(abs(d)), 6) AS max_deviation, count(*) FILTER (WHERE abs(d) > 0.02) AS breaches FROM k GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, pool, thresholds = _evaluated(spark, sf)
    counts = E.client_counts(pool, thresholds, _ALPHAS).select("client", "alpha", "population", "hits", "trials")
    return X.fpr_summary(X.operating_calibration(counts, thresholds, 0.02))


@query("r13_rescue", f"WITH {_SEED_EFFECTS} SELECT family, learner, round(avg(peer_recall), 6) AS peer_recall, round(avg(full_recall), 6) AS full_recall, CASE WHEN avg(full_recall) IS NULL THEN 'not-classifiable' WHEN avg(full_recall) < 0.7 THEN 'poorly-rescued' ELSE 'rescued' END AS level FROM effects GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    effects = D.family_effects(D.family_seed_effects(T.families(spark, sf), 0.05))
    return D.classify_rescue(effects, 0.7).select("family", "learner", "peer_recall", "full_recall", "level")


@query("c22_masking", f"WITH {T.SUMMARY}, w AS (SELECT seed, learner, alpha, max(value) FILTER (WHERE metric = 'own-domain-recall' AND condition = 'peer-present') - max(value) FILTER (WHERE metric = 'own-domain-recall' AND condition = 'family-absent') AS a, max(value) FILTER (WHERE metric = 'federation-wide-recall' AND condition = 'peer-present') - max(value) FILTER (WHERE metric = 'federation-wide-recall' AND condition = 'family-absent') AS r FROM summary WHERE dose IS NULL AND parameter IS NULL GROUP BY ALL) SELECT 'main' AS experiment, learner, alpha, count(*) AS seeds, count(*) FILTER (WHERE sign(a) * sign(r) < 0) AS disagree, count(*) FILTER (WHERE r >= 0.1 AND a <= 0) AS missed, count(*) FILTER (WHERE r <= -0.1 AND a >= 0) AS reassured FROM w WHERE a IS NOT NULL AND r IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.masking(T.summary(spark, sf), "own-domain-recall", "federation-wide-recall", 0.1)


@query("c05_band_outcome", f"WITH {_LARGE} SELECT learner, family, CASE WHEN gain_sd IS NULL THEN 'unresolved' WHEN gain - gain_sd >= -0.15 AND gain + gain_sd <= 0.15 THEN 'equivalent' WHEN gain - gain_sd > 0.15 OR gain + gain_sd < -0.15 THEN 'exceeds-band' ELSE 'unresolved' END AS outcome FROM large")
def _(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.col("gain") - F.col("gain_sd"), F.col("gain") + F.col("gain_sd")
    return _large(spark, sf).select("learner", "family", X.band_outcome(low, high, 0.15).alias("outcome"))


@query("g23_dose_models")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """AIC, cross-validated error and equivalent dose of three dose models; a block's curves are one row a seed."""
    import numpy as np
    import pandas as pd

    rows = T.families(spark, sf).where("learner = 'fedavg' and condition = 'peer-present' and parameter is null")
    seeds = rows.groupBy("population", "alpha", "seed", "dose").agg(F.avg(F.col("hits") / F.col("trials")).alias("recall"))
    base = F.max(F.when(F.col("dose") == 0, F.col("recall"))).over(Window.partitionBy("population", "alpha", "seed"))
    seeds = seeds.withColumn("gain", F.col("recall") - base)

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["dose"].notna()]
        wide = known.pivot(index="seed", columns="dose", values="gain").sort_index()
        natural = float(group[group["dose"].isna()]["gain"].mean())
        doses, curves = wide.columns.to_numpy(float), wide.to_numpy()
        out = []
        for model in ("log-linear", "emax", "isotonic"):
            parameters, fitted = stat.fit_curve(curves, doses, model)
            count = len(np.unique(fitted)) if model == "isotonic" else len(parameters)
            out.append({"population": group["population"].iloc[0], "alpha": group["alpha"].iloc[0], "model": model, "aic": stat.akaike(curves, fitted, count), "cv": stat.cross_validated(curves, doses, model), "equivalent": stat.equivalent_dose(fitted, natural, doses)})
        return pd.DataFrame(out)

    return seeds.groupBy("population", "alpha").applyInPandas(reduce, "population string, alpha double, model string, aic double, cv double, equivalent double")


@query("c02_worst_counts", f"WITH {T.FAMILIES}, s AS (SELECT seed, alpha, population, client, sum(hits)::DOUBLE / sum(trials) AS r FROM families WHERE learner = 'local' GROUP BY ALL), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY seed, alpha, population ORDER BY r, client) = 1) SELECT alpha, population, client, count(*) AS seeds FROM w GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["seed", "alpha", "population"]
    clients = T.families(spark, sf).where("learner = 'local'").groupBy(*keys, "client").agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))
    return D.worst_clients(clients, keys).groupBy("alpha", "population", "client").agg(F.count(F.lit(1)).alias("seeds"))


@query("c03_tradeoff", f"WITH {T.SUMMARY}, d AS (SELECT *, value - max(value) FILTER (WHERE learner = 'local') OVER (PARTITION BY experiment, seed, salt, alpha, metric) AS d FROM summary) SELECT metric, alpha, learner, condition, dose, parameter, tuning_value, round(avg(d), 6) AS mean_difference, round(min(d), 6) AS worst_difference, avg(d) >= -0.02 AS within FROM d WHERE learner <> 'local' GROUP BY metric, alpha, learner, condition, dose, parameter, tuning_value")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.tradeoff(T.summary(spark, sf), F.col("learner") == "local", 0.02)


@query("c07_headroom", f"WITH {T.SUMMARY}, g AS (SELECT seed, alpha, metric, max(value) FILTER (WHERE condition = 'full-exposure') - max(value) FILTER (WHERE learner = 'fedavg' AND condition = 'peer-present' AND dose IS NULL AND parameter IS NULL) AS gap FROM summary GROUP BY ALL) SELECT metric, alpha, count(*) AS seeds, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS worst_gap, avg(gap) >= 0.1 AS gated FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.headroom(T.summary(spark, sf), "fedavg", 0.1)


@query("c14_robustness")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Micro gain of all families, without the top ones, and of distinct vectors, with interval and p."""
    rows = T.families(spark, sf)
    variants = {"all": D.micro_gain(rows, 0.05, None), "top-removed": D.micro_gain(rows, 0.05, D.top_families(rows, 3)), "deduplicated": D.micro_gain(rows, 0.05, None, "unique_hits", "unique_trials")}
    stacked = None
    for name, part in variants.items():
        part = part.withColumn("variant", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stat.paired_effects(stacked, ["experiment", "variant"], "gain")


@query("c18_associations", f"WITH {_SEED_EFFECTS}, m AS (SELECT learner, family, round(avg(knowledge_gain), 9) AS gain, round(avg(peer_recall), 9) AS peer_recall, round(avg(local_recall), 9) AS local_recall, round(avg(trials), 9) AS trials FROM effects GROUP BY ALL), l AS (SELECT learner, gain, predictor, CASE predictor WHEN 'peer_recall' THEN peer_recall WHEN 'local_recall' THEN local_recall ELSE trials END AS x FROM m, (VALUES ('peer_recall'), ('local_recall'), ('trials')) p(predictor)), r AS (SELECT learner, predictor, rank() OVER (PARTITION BY learner, predictor ORDER BY gain) + (count(*) OVER (PARTITION BY learner, predictor, gain) - 1) / 2.0 AS a, rank() OVER (PARTITION BY learner, predictor ORDER BY x) + (count(*) OVER (PARTITION BY learner, predictor, x) - 1) / 2.0 AS b FROM l) SELECT learner, predictor, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    effects = D.family_seed_effects(T.families(spark, sf), 0.05)
    nine = lambda c, name: F.round(F.avg(c), 9).alias(name)
    means = effects.groupBy("learner", "family").agg(nine("knowledge_gain", "gain"), nine("peer_recall", "peer_recall"), nine("local_recall", "local_recall"), nine("trials", "trials"))
    return X.associations(means, ["learner"], "gain", ["peer_recall", "local_recall", "trials"])


@query("s09_effect_table")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.decompose(T.summary(spark, sf)).where("estimand in ('total_gain', 'pooling_gain', 'knowledge_gain')").withColumnRenamed("value", "difference")
    return X.contrast_effects(rows, ["experiment", "alpha", "metric", "learner", "estimand"], ["experiment", "alpha", "metric", "learner"])


@query("x5_control_contrasts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _recalls(spark, sf)
    pairs = {"all-less-none": (X.arm_is("peer-present"), X.arm_is("family-absent")), "ten-less-zero": (X.arm_is("peer-present", 10), X.arm_is("peer-present", 0)), "hundred-less-ten": (X.arm_is("peer-present", 100), X.arm_is("peer-present", 10))}
    stacked = None
    for name, (a, b) in pairs.items():
        part = X.arm_difference(rows, "fedavg", a, b).withColumn("contrast", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return X.contrast_effects(stacked, ["scope", "population", "alpha", "contrast"], ["scope", "population", "alpha"])


@query("y1_influence", f"WITH {_FAMILY_MEANS}, m AS (SELECT * FROM means WHERE learner = 'fedavg'), x AS (SELECT o.family AS left_out, m.gain, m.peer FROM m o JOIN m ON m.family <> o.family UNION ALL SELECT '', gain, peer FROM m), r AS (SELECT left_out, rank() OVER (PARTITION BY left_out ORDER BY gain) + (count(*) OVER (PARTITION BY left_out, gain) - 1) / 2.0 AS a, rank() OVER (PARTITION BY left_out ORDER BY peer) + (count(*) OVER (PARTITION BY left_out, peer) - 1) / 2.0 AS b FROM x), c AS (SELECT left_out, corr(a, b) AS rho FROM r GROUP BY 1) SELECT left_out, round(rho, 6) AS rho, round((SELECT rho FROM c WHERE left_out = '') - rho, 6) AS change FROM c WHERE left_out <> ''")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.influence(_means(spark, sf).where("learner = 'fedavg'"), "family", "gain", "peer")


@query("y2_seed_concordance", f"WITH {_GAINS}, p AS (SELECT a.learner, a.seed AS first, b.seed AS second, a.gain AS x, b.gain AS y FROM gains a JOIN gains b ON a.learner = b.learner AND a.family = b.family AND a.seed < b.seed), r AS (SELECT learner, first, second, rank() OVER (PARTITION BY learner, first, second ORDER BY x) + (count(*) OVER (PARTITION BY learner, first, second, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY learner, first, second ORDER BY y) + (count(*) OVER (PARTITION BY learner, first, second, y) - 1) / 2.0 AS b FROM p) SELECT learner, first, second, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.seed_concordance(_gains(spark, sf).select("learner", "family", "seed", "gain"), ["learner"])


@query("y3_support", f"WITH {T.EXPOSURE}, {T.TARGETS} SELECT 'main' AS experiment, e.seed, 0::BIGINT AS salt, e.family, sum(rows)::BIGINT AS peer_rows, count(*) FILTER (WHERE rows > 0) AS peers, round(max(rows) / sum(rows), 6) AS top_share FROM exposure e JOIN targets t ON t.seed = e.seed AND t.family = e.family AND t.client <> e.client WHERE dose IS NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return X.peer_concentration(T.exposure(spark, sf), T.targets(spark, sf))


@query("r10_arm_comparison", f"WITH {T.SUMMARY} SELECT learner, condition, round(avg(value) FILTER (WHERE metric = 'own-domain-recall'), 6) AS \"own-domain-recall\", round(avg(value) FILTER (WHERE metric = 'federation-wide-recall'), 6) AS \"federation-wide-recall\" FROM summary WHERE alpha = 0.05 AND dose IS NULL AND parameter IS NULL GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.summary(spark, sf).where("alpha = 0.05 and dose is null and parameter is null")
    return rows.groupBy("learner", "condition").pivot("metric", ["own-domain-recall", "federation-wide-recall"]).agg(F.avg("value"))


_STATES = "WITH l AS (SELECT label AS holder, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT holder, pos, avg(x) AS weight, count(*) AS rows FROM l GROUP BY ALL)"


def _states(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "embeddings").select(F.col("label").alias("holder"), F.posexplode("embedding").alias("pos", "x"))
    return long.groupBy("holder", "pos").agg(F.avg(F.col("x").cast("double")).alias("weight"), F.count(F.lit(1)).alias("rows")).withColumn("arm", F.lit(0))


@query("l05_average_states", f"{_STATES} SELECT 0::BIGINT AS arm, pos, round(sum(weight * rows) / sum(rows), 5) AS weight FROM s GROUP BY pos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.operators.learners import average_states

    return average_states(_states(spark, sf), ["arm"]).withColumn("weight", F.round("weight", 5))


@query("l06_robust_states", f"{_STATES}, a AS (SELECT pos, list_sort(list(weight)) AS w FROM s GROUP BY pos) SELECT 0::BIGINT AS arm, pos, round(w[(len(w) + 1) // 2], 5) AS median, round(list_sum(w[2:len(w) - 1]) / (len(w) - 2), 5) AS trimmed FROM a")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from sievegrid.operators.learners import robust_states

    rows = _states(spark, sf)
    median, trimmed = robust_states(rows, ["arm"], "median"), robust_states(rows, ["arm"], "trimmed")
    both = median.withColumnRenamed("weight", "median").join(trimmed.withColumnRenamed("weight", "trimmed"), ["arm", "pos"])
    return both.select("arm", "pos", F.round("median", 5).alias("median"), F.round("trimmed", 5).alias("trimmed"))


@query("l02_transform", "WITH l AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT pos, round(avg(x), 5) AS mean, round(stddev_pop(x) + 1e-6, 5) AS spread FROM l GROUP BY 1 HAVING avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0 END) BETWEEN 0.01 AND 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    return V.prevalence_transform(rows, "features", 0.01, 1.0).select("pos", F.round("mean", 5).alias("mean"), F.round("spread", 5).alias("spread"))
