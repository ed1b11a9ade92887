"""The study's tables over the driver's: a line of an order is a sample, its region the client, its brand the family.

Each builder has its SQL beside it, a chain of common table expressions that other engines run too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions.primitives import fraction
from sievegrid.operators.splits import with_roles
from sievegrid.session import table

SEEDS = 6
RULE = {"target_min_fit": 20, "peer_min_fit": 300, "federation_min_test": 120, "target_min_remaining_fit": 500}
RULE_SQL = "target_fit_rows >= 20 AND peer_fit_rows >= 300 AND federation_test_rows >= 120 AND fit_rows - target_fit_rows >= 500"
#: (learner, condition, dose, parameter, tuning value).
ARMS = [
    ("local", "peer-present", None, None, None),
    ("central", "peer-present", None, None, None),
    ("central", "family-absent", None, None, None),
    ("central", "full-exposure", None, None, None),
    ("fedavg", "peer-present", None, None, None),
    ("fedavg", "family-absent", None, None, None),
    ("fedavg", "peer-present", 0, None, None),
    ("fedavg", "peer-present", 10, None, None),
    ("fedavg", "peer-present", 100, None, None),
    ("fedprox", "peer-present", None, "mu", 0.1),
    ("fedprox", "peer-present", None, "mu", 0.01),
    ("fedprox", "peer-present", None, None, None),
    ("fedprox", "family-absent", None, None, None),
]
ARM_SCHEMA = "learner string, condition string, dose long, parameter string, tuning_value double"


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line, package, client, family, label, vt_count, month, feature, score): dimension tables join by their keys."""
    item = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("client"))
    brand = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("family"))
    # One after another: of a plain table Spark knows the size, of a join it takes the product, and would shuffle all lines by supplier.
    rows = item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(brand, F.col("l_partkey") == F.col("p_partkey"))
    percent = lambda c: F.round(F.col(c) * 100).cast("long")
    line = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", percent("l_extendedprice"))
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return rows.select(
        line.alias("line"),
        F.col("l_orderkey").alias("package"),
        "client",
        "family",
        label.cast("long").alias("label"),
        F.col("l_quantity").cast("long").alias("vt_count"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.concat_ws("|", F.col("l_quantity").cast("long"), percent("l_discount"), percent("l_tax")).alias("feature"),
        (fraction("score", line) + label * 0.25).alias("score"),
    )


LINE_SQL = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)"
LINES = f"""lines AS (SELECT {LINE_SQL} AS line, l_orderkey AS package, r_name AS client, p_brand AS family, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS label,
 l_quantity::BIGINT AS vt_count, strftime(l_shipdate, '%Y-%m') AS month,
 concat_ws('|', l_quantity::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT) AS feature,
 {draw_sql("'score'", LINE_SQL)} / 4294967296.0 + CASE WHEN l_returnflag = 'R' THEN 0.25 ELSE 0 END AS score
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""


def study(spark: SparkSession, sf: str, seed: int = 1, salt: int = 0, attempt: int = 0) -> DataFrame:
    """Lines with their role and reason."""
    rows = lines(spark, sf)
    return with_roles(rows, "package", seed, salt, attempt).withColumn("reason", F.when(F.col("label") == 0, F.lit("not-in-family-set")).otherwise(F.lit("eligible")))


STUDY = f"""{LINES}, sizes AS (SELECT package, count(*) AS n, {draw_sql("1", "0", "0", "package")} AS d FROM lines GROUP BY package),
 placed AS (SELECT package, coalesce(sum(n) OVER (ORDER BY d, package ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n) OVER () AS part FROM sizes),
 roles AS (SELECT package, CASE WHEN part < 0.6 THEN 'fit' WHEN part < 0.8 THEN 'calibration' ELSE 'test' END AS role FROM placed),
 study AS (SELECT lines.*, role, CASE WHEN label = 0 THEN 'not-in-family-set' ELSE 'eligible' END AS reason FROM lines JOIN roles USING (package))"""


def _share(learner: Column, condition: Column, dose: Column, *more: Column) -> Column:
    """A made-up recall between 0 and 1, higher for better arms."""
    bonus = F.when(learner == "local", 0.0).when(condition == "full-exposure", 0.5).when(condition == "family-absent", 0.125).when(dose == 0, 0.125).otherwise(0.25)
    return fraction("hit", learner, condition, F.coalesce(dose, F.lit(-1)), *more) * 0.5 + bonus


def families(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and trials of hidden families by run and arm, made up from the lines' counts."""
    cells = lines(spark, sf).where("label = 1").groupBy("client", "family").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("feature").alias("unique_trials"))
    arms = spark.createDataFrame(ARMS, ARM_SCHEMA)
    runs = cells.crossJoin(F.broadcast(arms)).withColumns(
        {
            "seed": F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SEEDS).cast("long"))),
        }
    )
    runs = runs.withColumn("population", F.explode(F.array(F.lit("federation-wide"), F.lit("own-domain")))).withColumn("alpha", F.explode(F.array(F.lit(0.05), F.lit(0.01))))
    share = _share(F.col("learner"), F.col("condition"), F.col("dose"), F.coalesce(F.col("parameter"), F.lit("-")), F.coalesce((F.col("tuning_value") * 100).cast("long"), F.lit(0)), F.col("seed"), F.col("population"), (F.col("alpha") * 100).cast("long"), F.col("client"), F.col("family"))
    return runs.select(
        F.lit("main").alias("experiment"), "seed", F.lit(0).cast("long").alias("salt"), "learner", "condition", "dose", "parameter", "tuning_value", "client", "alpha", "population", "family",
        F.floor(F.col("trials") * share).alias("hits"), "trials", F.floor(F.col("unique_trials") * share).alias("unique_hits"), "unique_trials",
    )


_ARM_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in a) + ")" for a in ARMS)
FAMILIES = f"""{LINES}, cells AS (SELECT client, family, count(*) AS trials, count(DISTINCT feature) AS unique_trials FROM lines WHERE label = 1 GROUP BY 1, 2),
 arms(learner, condition, dose, parameter, tuning_value) AS (VALUES {_ARM_ROWS}),
 runs AS (SELECT 'main' AS experiment, seed, 0::BIGINT AS salt, learner, condition, dose::BIGINT AS dose, parameter, tuning_value::DOUBLE AS tuning_value, client, alpha, population, family, trials, unique_trials,
 {draw_sql("'hit'", "learner", "condition", "coalesce(dose, -1)", "coalesce(parameter, '-')", "coalesce((tuning_value * 100)::BIGINT, 0)", "seed", "population", "(alpha * 100)::BIGINT", "client", "family")} / 4294967296.0 * 0.5
 + CASE WHEN learner = 'local' THEN 0.0 WHEN condition = 'full-exposure' THEN 0.5 WHEN condition = 'family-absent' THEN 0.125 WHEN dose = 0 THEN 0.125 ELSE 0.25 END AS share
 FROM cells, arms, (SELECT unnest(range(1, {SEEDS + 1})) AS seed), (VALUES ('federation-wide'), ('own-domain')) p(population), (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) a(alpha)),
 families AS (SELECT * EXCLUDE (share), floor(trials * share)::BIGINT AS hits, floor(unique_trials * share)::BIGINT AS unique_hits FROM runs)"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """(experiment, seed, salt, arm, alpha, metric, value): mean recall of hidden families by client population."""
    rows = families(spark, sf).withColumn("metric", F.concat(F.col("population"), F.lit("-recall")))
    keys = ["experiment", "seed", "salt", "learner", "condition", "dose", "parameter", "tuning_value", "alpha", "metric"]
    return rows.groupBy(*keys).agg(F.avg(F.col("hits") / F.col("trials")).alias("value"))


SUMMARY = f"""{FAMILIES}, summary AS (SELECT experiment, seed, salt, learner, condition, dose, parameter, tuning_value, alpha, population || '-recall' AS metric, avg(hits::DOUBLE / trials) AS value
 FROM families GROUP BY ALL)"""


def exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows of each family at each client by run and dose."""
    fit = study(spark, sf).where("role = 'fit' and label = 1").groupBy("client", "family").agg(F.count(F.lit(1)).alias("n"))
    doses = spark.createDataFrame([(0,), (10,), (100,), (None,)], "dose long")
    runs = fit.crossJoin(F.broadcast(doses)).withColumn("seed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SEEDS).cast("long"))))
    return runs.select(F.lit("main").alias("experiment"), "seed", F.lit(0).cast("long").alias("salt"), F.lit("fedavg").alias("learner"), F.lit("peer-present").alias("condition"), "dose", "client", "family", F.least(F.coalesce(F.floor(F.col("dose") / 3), F.col("n")), F.col("n")).cast("long").alias("rows"))


EXPOSURE = f"""{STUDY}, exposure AS (SELECT 'main' AS experiment, seed, 0::BIGINT AS salt, 'fedavg' AS learner, 'peer-present' AS condition, dose::BIGINT AS dose, client, family, least(coalesce(floor(dose / 3.0)::BIGINT, n), n)::BIGINT AS rows
 FROM (SELECT client, family, count(*) AS n FROM study WHERE role = 'fit' AND label = 1 GROUP BY 1, 2), (VALUES (0), (10), (100), (NULL)) d(dose), (SELECT unnest(range(1, {SEEDS + 1})) AS seed))"""


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Each family is hidden from the first of its clients by name."""
    cells = lines(spark, sf).select("client", "family").distinct()
    first = cells.groupBy("family").agg(F.min("client").alias("client"))
    return first.withColumn("seed", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SEEDS).cast("long")))).select(F.lit("main").alias("experiment"), "seed", F.lit(0).cast("long").alias("salt"), "family", "client")


TARGETS = f"targets AS (SELECT 'main' AS experiment, seed, 0::BIGINT AS salt, family, min(client) AS client FROM lines, (SELECT unnest(range(1, {SEEDS + 1})) AS seed) GROUP BY seed, family)"
