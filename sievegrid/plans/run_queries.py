"""Queries of whole runs - fits, rounds, tuning grids, trees, evaluation of all arms - and of sparse matrices and namespaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators import decomposition as D
from sievegrid.operators import evaluation as E
from sievegrid.operators import execution as R
from sievegrid.operators import namespaces as N
from sievegrid.operators import selection as sel
from sievegrid.operators import trees
from sievegrid.operators.learners import Training
from sievegrid.plans import runs
from sievegrid.plans import study as T
from sievegrid.plans.surface_queries import ORACLE, QUERIES  # noqa: F401
from sievegrid.plans.queries import _POOLS, query
from sievegrid.session import new_path, stage, table
from sievegrid.sources import archives, sparse

ALPHAS = [0.01, 0.05, 0.1]
#: Rows a client that a run trains on.
BUDGET = 600
#: Weights of made-up linear scorers, small whole numbers: sums of their products with whole features are exact.
SCORERS = {"plain": [3, -2, 5, 0], "steep": [1, 7, -1, 2], "flat": [0, 1, 1, 1], "local": [2, 2, 2, -1]}


def with_features(rows: DataFrame) -> DataFrame:
    """Lines with features: whole numbers for exact sums, then their scaled forms with the lines' score for fits."""
    quantity, discount, tax = (F.split("feature", r"\|")[i].cast("double") for i in range(3))
    month = F.split("month", "-")[1].cast("double")
    return rows.withColumns({"whole": F.array(quantity, discount, tax, month), "features": F.array("score", quantity / 50, discount / 10, tax / 10, month / 12)})


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return with_features(T.study(spark, sf))


#: What a run reads of a line.
RUN_COLUMNS = ["line", "client", "role", "label", "family", "feature", "features"]


def _hidden(spark: SparkSession, sf: str) -> DataFrame:
    return T.targets(spark, sf).select("client", "family").distinct()


@query(
    "v0m_evaluate_arms",
    f"""WITH {_POOLS}, whole AS (SELECT line, string_split(feature, '|')[1]::DOUBLE AS a, string_split(feature, '|')[2]::DOUBLE AS b, string_split(feature, '|')[3]::DOUBLE AS c, string_split(month, '-')[2]::DOUBLE AS d FROM study),
 arms(arm, w, own_only) AS (VALUES {", ".join(f"('{k}', {w}, {k == 'local'})" for k, w in SCORERS.items())}),
 linear AS (SELECT line, arm, own_only, a * w[1] + b * w[2] + c * w[3] + d * w[4] AS z FROM whole, arms),
 scored AS (SELECT arm, pool AS client, line, role, label, family, feature, own, unseen, CASE WHEN own_only AND pool = 'ASIA' THEN -z ELSE z END AS z FROM pool JOIN linear USING (line)),
 ranked AS (SELECT arm, client, z, row_number() OVER (PARTITION BY arm, client ORDER BY z) - 1 AS at_, count(*) OVER (PARTITION BY arm, client) AS n FROM scored WHERE own AND role = 'calibration' AND label = 0),
 cut AS (SELECT arm, client, alpha, z AS threshold FROM ranked, alphas WHERE at_ = ceil((1 - alpha) * (n - 1))),
 member AS (SELECT arm, client, family, line, feature, z, unnest(CASE WHEN label = 0 THEN ['benign'] WHEN own AND NOT unseen THEN ['known-family'] WHEN own THEN ['own-domain', 'federation-wide'] ELSE ['federation-wide'] END) AS population FROM scored WHERE role = 'test' AND (own OR unseen)),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY arm, client, population, family, feature ORDER BY line) = 1 AS first FROM member),
 of_clients AS (SELECT arm, client, alpha, population, '' AS family, count(*) FILTER (WHERE z > threshold) AS hits, count(*) AS trials, 0 AS unique_hits, 0 AS unique_trials FROM member JOIN cut USING (arm, client) GROUP BY ALL),
 of_families AS (SELECT arm, client, alpha, population, family, count(*) FILTER (WHERE z > threshold) AS hits, count(*) AS trials, count(*) FILTER (WHERE z > threshold AND first) AS unique_hits, count(*) FILTER (WHERE first) AS unique_trials FROM firsts JOIN cut USING (arm, client) WHERE population IN ('own-domain', 'federation-wide') GROUP BY ALL)
 SELECT * FROM of_clients UNION ALL SELECT * FROM of_families""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four linear arms, one with a scorer of its own at one client, over all pools: counts by client, then by family."""
    columns = ["line", "client", "role", "label", "family", "feature", F.col("whole").alias("features")]
    rows = stage(prepared(spark, sf).where("role <> 'fit'").select(*columns), "prepared")  # fit rows are in no pool
    clients = [r["client"] for r in T.lines(spark, sf).select("client").distinct().collect()]
    linear = [(k, None, [float(x) for x in w] + [0.0]) for k, w in SCORERS.items() if k != "local"]
    linear += [("local", c, [(-1.0 if c == "ASIA" else 1.0) * x for x in SCORERS["local"]] + [0.0]) for c in clients]
    models = spark.createDataFrame(linear, "arm string, client string, weights array<double>")
    pools = E.pools(rows.select("line", "client", "role", "label", "family", "feature", "features"), _hidden(spark, sf))
    scored = stage(R.score_arms(pools, list(SCORERS), models, Training(width=4, hidden=())).drop("features"), "scored")
    told = R.evaluate_arms(scored, list(SCORERS), ALPHAS, 10, 5, "line", "feature")
    none = F.lit(0).cast("long")
    of_clients = told.clients.where("trials > 0").select("arm", "client", "alpha", "population", F.lit("").alias("family"), "hits", "trials", none.alias("unique_hits"), none.alias("unique_trials"))
    return of_clients.unionByName(told.families)


def _trainings(rows: DataFrame, hidden: DataFrame, conditions: list[str]) -> dict[str, DataFrame]:
    return sel.trainings(sel.training_orders(rows, "line", 1, 0), hidden, conditions, "line", BUDGET)


RUN_ARMS = [
    R.Arm("local", "local"),
    R.Arm("central", "central"),
    R.Arm("central|family-absent", "central", "family-absent"),
    R.Arm("central|full-exposure", "central", "full-exposure"),
    R.Arm("fedavg", "federated"),
    R.Arm("fedavg|family-absent", "federated", "family-absent"),
    R.Arm("fedprox", "federated", proximal=0.1),
    R.Arm("trimmed", "federated", rule="trimmed"),
    R.Arm("finetune", "finetune", base="fedavg"),
    R.Arm("blend", "blend", base="local", other="fedavg"),
]


@query("v0o_execute_run")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Ten arms fitted on what three conditions leave of each client's rows, and their summaries."""
    rows, hidden = stage(prepared(spark, sf).select(*RUN_COLUMNS), "prepared"), stage(_hidden(spark, sf), "hidden")
    t = Training(width=5, hidden=(16,), epochs=2, batch=64)
    told = R.execute_run(rows, hidden, _trainings(rows, hidden, ["peer-present", "family-absent", "full-exposure"]), RUN_ARMS, t, 3, new_path(spark, "run"), 5 * BUDGET, ALPHAS, row="line")
    return told.summary


@query("l15_tuning_grid")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's calibration AUROCs and each parameter's best value."""
    rows, hidden = stage(prepared(spark, sf).select(*RUN_COLUMNS), "prepared"), stage(_hidden(spark, sf), "hidden")
    arms, points = R.grid_arms([1, 2, 4], [0.001, 0.01, 0.1], [1, 2, 5])
    t = Training(width=5, hidden=(16,), epochs=1, batch=64)
    training = _trainings(rows, hidden, ["peer-present"])
    told = R.execute_run(rows, hidden, training, arms, t, 3, new_path(spark, "grid"), 5 * BUDGET, ALPHAS, row="line")
    named = spark.createDataFrame(points, "arm string, parameter string, tuning_value double")
    scores = stage(told.summary.join(named, "arm").where("metric = 'calibration-auroc' and alpha = 0.05"), "grid-scores")
    best = D.select_tuning(scores, 0.05).select("parameter", "tuning_value", F.lit(True).alias("selected"))
    return scores.join(best, ["parameter", "tuning_value"], "left").select("parameter", "tuning_value", "value", F.coalesce("selected", F.lit(False)).alias("selected"))


#: Edges between the whole values of quantity, discount, tax and month.
EDGES = [[i + 0.5 for i in range(a, b)] for a, b in ((1, 50), (0, 10), (0, 8), (1, 12))]


@query(
    "l07_first_cuts",
    f"""WITH {T.LINES}, x AS (SELECT client, label, unnest([0, 1, 2, 3]) AS feature, unnest([string_split(feature, '|')[1]::DOUBLE, string_split(feature, '|')[2]::DOUBLE, string_split(feature, '|')[3]::DOUBLE, string_split(month, '-')[2]::DOUBLE]) AS x FROM lines),
 e AS (SELECT feature - 1 AS feature, unnest(edges) AS edge FROM (SELECT unnest([1, 2, 3, 4]) AS feature, unnest({EDGES}) AS edges)),
 b AS (SELECT client, avg(label) AS p, count(*) AS n FROM lines GROUP BY 1),
 cells AS (SELECT client, feature, x, count(*) AS n, sum(label) AS y FROM x GROUP BY ALL),
 cuts AS (SELECT c.client, c.feature, edge, sum(c.n) FILTER (WHERE x <= edge) AS nl, sum(c.y) FILTER (WHERE x <= edge) AS yl, sum(c.n) AS n, sum(c.y) AS y FROM cells c JOIN e ON e.feature = c.feature GROUP BY ALL),
 sums AS (SELECT c.*, p * (1 - p) AS v, nl * p - yl AS gl, (c.n - nl) * p - (y - yl) AS gr FROM cuts c JOIN b ON b.client = c.client WHERE nl >= 20 AND c.n - nl >= 20),
 gains AS (SELECT *, gl * gl / (nl * v) + gr * gr / ((n - nl) * v) AS gain FROM sums),
 best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY client ORDER BY gain DESC, feature, edge) = 1)
 SELECT client AS holder, 0 AS node, feature, edge AS threshold, round(gain, 6) AS gain, n AS rows, NULL::DOUBLE AS value FROM best
 UNION ALL SELECT client, 1, NULL, NULL, NULL, NULL, round(-0.1 * gl / (nl * v), 6) FROM best UNION ALL SELECT client, 2, NULL, NULL, NULL, NULL, round(-0.1 * gr / ((n - nl) * v), 6) FROM best""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Each client's first tree of one level over all lines."""
    rows = with_features(T.lines(spark, sf)).select("client", "label", F.col("whole").alias("features"))
    forest = trees.fit_trees(rows, trees.Boosting(rounds=1, depth=1), "client", [np.array(e) for e in EDGES])
    return forest.table(spark).drop("tree")


@query("l07_boosted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of each client's fit rows, and how well they tell its calibration and test rows apart."""
    rows = stage(prepared(spark, sf).select("client", "role", "label", "features"), "prepared")
    forest = trees.fit_trees(rows.where("role = 'fit'"), trees.Boosting(rounds=10, depth=3), "client")
    scored = trees.score_trees(rows.where("role <> 'fit'").select("client", "role", "label", "features"), forest, "client")
    return E.discrimination(scored, ["client", "role"])


# Sparse matrices: a supplier is a row, a quantity a column, the number of its lines the value.

_CELLS = "cells AS (SELECT l_suppkey AS row, l_quantity::INT AS idx, count(*)::DOUBLE AS val FROM lineitem GROUP BY 1, 2)"
_WANTED = "wanted AS (SELECT c_custkey AS position, l_suppkey AS row FROM customer JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey = c_custkey % 100)"


def _matrix(spark: SparkSession, sf: str, rows_per_block: int = 64) -> DataFrame:
    item = table(spark, sf, "lineitem")
    cells = item.groupBy(F.col("l_suppkey").alias("row"), F.col("l_quantity").cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("val"))
    rows = item.agg(F.max("l_suppkey") + 1).first()[0]
    path = new_path(spark, "matrix")
    sparse.save_csr(cells, path, rows, rows_per_block=rows_per_block)
    return sparse.load_blocks(spark, path)


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row")).distinct()
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") % 100).alias("row")).join(known, "row")


@query("d44_sparse_round_trip", f"WITH {_CELLS} SELECT * FROM cells")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.load_csr(_matrix(spark, sf), 64)


@query("d45_gather", f"WITH {_CELLS}, {_WANTED} SELECT position, row, count(*) AS n, sum(val) AS total, sum(val * idx) AS weighted FROM wanted JOIN cells USING (row) GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = sparse.gather(_matrix(spark, sf), _positions(spark, sf), 64)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return found.select("position", "row", F.size("idx").alias("n"), total(F.col("val")).alias("total"), total(F.zip_with("val", "idx", lambda v, i: v * i)).alias("weighted"))


@query("d35_binary_rows", f"WITH {_CELLS}, {_WANTED} SELECT position, w.row, string_agg(CASE WHEN val IS NULL THEN '00' ELSE printf('%02X', val::INT % 256) END, '' ORDER BY i) AS features FROM wanted w CROSS JOIN (SELECT unnest(range(0, 51))::INT AS i) LEFT JOIN cells c ON c.row = w.row AND c.idx = i GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.binary_rows(_matrix(spark, sf), _positions(spark, sf), 51, 64).withColumn("features", F.hex("features"))


@query("d45_products", f"WITH {_CELLS} SELECT row, sum(val * (2 * idx - 7)) AS first, sum(val * (idx % 5)) AS second FROM cells GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    dense = np.array([[2.0 * i - 7, i % 5] for i in range(51)])
    blocks = _matrix(spark, sf)
    known = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row")).distinct()
    return sparse.products(blocks, dense, 64).join(known, "row").select("row", F.col("products")[0].alias("first"), F.col("products")[1].alias("second"))


# Namespaces: orders are samples, their lines of three sorts are representations.

_SORTS = {"returned": "l_returnflag = 'R'", "cheap": "l_discount >= 0.05", "small": "l_quantity <= 30"}
_KINDS = ", ".join(f"{k} AS (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem WHERE {w})" for k, w in _SORTS.items())
_HAS = " AND ".join(f"o_orderkey IN (SELECT l_orderkey FROM {k})" for k in _SORTS)


def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha256"), F.col("o_orderkey").alias("row"), (F.col("o_orderstatus") == "F").cast("long").alias("label"))


def _kinds(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Each kind has a row an order and line status, so orders of both are there twice."""
    item = table(spark, sf, "lineitem")
    out = {}
    for k, where in _SORTS.items():
        cells = item.where(where).groupBy("l_orderkey", "l_linestatus", F.col("l_quantity").cast("int").alias("idx")).agg(F.count(F.lit(1)).cast("float").alias("val"))
        pairs = cells.groupBy("l_orderkey", "l_linestatus").agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("p"))
        out[k] = pairs.select(F.upper(F.md5(F.col("l_orderkey").cast("string"))).alias("sha256"), F.ascii("l_linestatus").cast("long").alias("place"), F.col("p.idx").alias("idx"), F.col("p.val").alias("val"))
    return out


@query(
    "d41_namespace_manifest",
    f"""WITH {_KINDS}, s AS (SELECT *, {_HAS} AS whole FROM orders) SELECT 'samples' AS name, count(*) AS n FROM s UNION ALL SELECT 'rows', count(*) FROM s WHERE whole UNION ALL SELECT 'malware_rows', count(*) FROM s WHERE whole AND o_orderstatus = 'F' UNION ALL SELECT 'benign_rows', count(*) FROM s WHERE whole AND o_orderstatus <> 'F' """
    + " ".join(f"UNION ALL SELECT '{k}_missing', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {k}) UNION ALL SELECT '{k}_repeated', (SELECT count(*) - count(DISTINCT l_orderkey) FROM {k} WHERE l_orderkey IN (SELECT o_orderkey FROM orders))" for k in _SORTS),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    told = N.build_namespace(_assignments(spark, sf), _kinds(spark, sf), new_path(spark, "namespace"))
    return spark.createDataFrame(list(told.items()), "name string, n long")


@query(
    "d40_alignment",
    f"""WITH {_KINDS}, s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders WHERE {_HAS}),
 f AS (SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM returned GROUP BY 1), v AS (SELECT l_orderkey, count(DISTINCT l_quantity) AS n, sum(l_quantity) AS total FROM lineitem JOIN f USING (l_orderkey, l_linestatus) WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT o_orderkey AS position, row, n, total FROM s JOIN v ON l_orderkey = o_orderkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The returned lines of the namespace's orders, found by the orders' keys."""
    path = new_path(spark, "namespace")
    N.build_namespace(_assignments(spark, sf), _kinds(spark, sf), path)
    samples = spark.read.parquet(f"{path}/samples")
    asked = samples.select(F.col("source_row").alias("position"), "sha256")
    rows = N.aligned_rows(sparse.load_blocks(spark, f"{path}/returned"), samples, asked)
    return rows.select("position", "row", F.size("idx").alias("n"), F.aggregate(F.zip_with("val", "idx", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


@query("p06_numpy_files", "SELECT l_orderkey AS key, l_quantity AS quantity, l_extendedprice - l_discount AS net, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written as archives of arrays and read again in slices."""
    archives.register(spark)
    path = new_path(spark, "arrays")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.array("l_quantity", "l_extendedprice", "l_discount").alias("values"))
    lines.write.format("numpy").mode("append").option("slice_rows", 20_000).save(path)
    back = spark.read.format("numpy").schema("key long, values array<double>").option("slice_rows", 8192).load(path)
    return back.groupBy("key", F.col("values")[0].alias("quantity"), (F.col("values")[1] - F.col("values")[2]).alias("net")).agg(F.count(F.lit(1)).alias("n"))


def _line_hash(i: int) -> str:
    return f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR"


@query(
    "d49_run_digests",
    f"""WITH i AS (SELECT o_custkey AS run, o_orderkey::VARCHAR AS name, o_orderstatus || '|' || o_orderpriority AS value FROM orders), l AS (SELECT run, sha256(length(name) || ':' || name || coalesce('=' || value, '-')) AS h FROM i)
 SELECT run, sha256(concat_ws('|', count(*), {", ".join(_line_hash(i) for i in range(4))})) AS digest FROM l GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A customer is a run, its orders the inputs that the run depends on."""
    inputs = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").cast("string").alias("name"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").alias("value"))
    return runs.run_digests(inputs, ["run"])


_RUN_STATUS = "CASE WHEN seed = 2 THEN 'stale' WHEN seed = 5 THEN 'failed-validation' WHEN seed > 6 THEN 'missing' ELSE 'completed' END"


@query("r01_evidence", f"WITH {T.FAMILIES}, planned AS (SELECT unnest(range(1, 9)) AS seed), f AS (SELECT seed, count(*) AS n, sum(hits) AS hits, count(*) FILTER (WHERE seed > 3 AND tuning_value IS NOT NULL) AS tuned FROM families GROUP BY 1) SELECT seed, {_RUN_STATUS} AS status, CASE WHEN {_RUN_STATUS} = 'completed' THEN n END AS n, CASE WHEN {_RUN_STATUS} = 'completed' THEN hits END AS hits, CASE WHEN {_RUN_STATUS} = 'completed' THEN tuned END AS tuned FROM planned LEFT JOIN f USING (seed)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Family counts of six runs, those of the first three of a schema without tuning values; one run is stale, one failed, two are not there."""
    families = stage(T.families(spark, sf).withColumn("mode", F.lit("main")), "families")
    root = new_path(spark, "runs")
    ran = families.select(*runs.KEY).distinct()
    status = F.when(F.col("seed") == 5, F.lit("failed-validation")).otherwise(F.lit("completed"))
    statuses = stage(ran.select(*runs.KEY, status.alias("status"), F.lit(None).cast("string").alias("reason"), F.when(F.col("seed") == 2, F.lit("old")).otherwise(F.lit("now")).alias("digest")), "statuses")
    runs.write_runs(root, {"families": families.where("seed <= 3").drop("tuning_value")}, statuses.where("seed <= 3"))
    runs.write_runs(root, {"families": families.where("seed > 3")}, statuses.where("seed > 3"))
    planned = spark.range(1, 9).select(F.lit("main").alias("mode"), F.lit("main").alias("experiment"), F.col("id").alias("seed"), F.lit(0).cast("long").alias("salt"), F.lit("now").alias("digest"))
    found = runs.collect_evidence(spark, root, planned, ["families"])
    told = found.tables["families"].groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.count("tuning_value").alias("tuned"))
    return found.index.select("seed", "status").join(told, "seed", "left")
