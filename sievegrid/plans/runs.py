"""Kept results of runs: what a result depends on as one digest, reuse by it, and evidence gathered over many runs.

A run's digest is made of its inputs, (run, name, value) rows: digests of rows are added, so inputs of any number combine map-side, in any
order. A result is kept under its digest: ``publish`` writes beside the place and renames, so that a result is whole or not there, and
of two writers the first stays.

Runs' tables lie partitioned by the runs' keys, their statuses in a table of their own, written last. ``collect_evidence``
tells completed runs from infeasible, failed, stale (kept under another digest) and missing ones, and reads the tables of the
completed ones, whatever columns they have, in one scan that is pruned by the keys.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators.checks import normalise_arms

KEY = ["mode", "experiment", "seed", "salt"]
STATUS = "mode string, experiment string, seed long, salt long, status string, reason string, digest string, written long"


def run_digests(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest) of (keys, name, value): a null value differs from an empty one, a row that occurs twice from one."""
    line = F.sha2(F.concat_ws("", F.length("name").cast("string"), F.lit(":"), "name", F.when(F.col("value").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "value"))), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return inputs.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("digest"))


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def kept(spark: SparkSession, root: str, name: str, digest: str) -> DataFrame | None:
    """The result of this name and digest, if it is whole."""
    path = f"{root}/{name}/{digest}"
    fs, mark = _fs(spark, f"{path}/_SUCCESS")
    return spark.read.parquet(path) if fs.exists(mark) else None


def publish(df: DataFrame, root: str, name: str, digest: str) -> DataFrame:
    spark = df.sparkSession
    attempt = f"{root}/{name}/_{digest}-{uuid.uuid4().hex}"
    fs, made = _fs(spark, attempt)
    try:
        df.write.parquet(attempt)
    except BaseException:
        fs.delete(made, True)
        raise
    _, place = _fs(spark, f"{root}/{name}/{digest}")
    if fs.exists(place) or not fs.rename(made, place):
        fs.delete(made, True)
    found = kept(spark, root, name, digest)
    if found is None:
        raise OSError(f"{place}: the result could not be kept")
    return found


def reuse_or_build(spark: SparkSession, root: str, name: str, digest: str, build) -> tuple[DataFrame, bool]:  # noqa: ANN001
    """(result, whether it was kept before)."""
    found = kept(spark, root, name, digest)
    return (found, True) if found is not None else (publish(build(), root, name, digest), False)


def write_runs(root: str, tables: dict[str, DataFrame], statuses: DataFrame) -> None:
    """Tables with the key's columns, any others beside them, and (key, status, reason, digest); a run's earlier tables are replaced."""
    for name, df in tables.items():
        df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*KEY).parquet(f"{root}/{name}")
    columns = [c.split()[0] for c in STATUS.split(", ")]
    written = statuses.withColumn("written", F.unix_micros(F.current_timestamp()))
    written.select(*columns).write.mode("append").parquet(f"{root}/_runs")


@dataclass(frozen=True)
class Evidence:
    index: DataFrame
    tables: dict[str, DataFrame]


def run_index(spark: SparkSession, root: str, planned: DataFrame) -> DataFrame:
    """(key, status, reason) of the planned runs (key, digest), by each run's last status."""
    fs, path = _fs(spark, f"{root}/_runs")
    rows = spark.read.schema(STATUS).parquet(f"{root}/_runs") if fs.exists(path) else spark.createDataFrame([], STATUS)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("status", "reason", "digest"), F.struct("written", "status")).alias("last"))
    told = planned.select(*KEY, F.col("digest").alias("expected")).join(last, KEY, "left")
    status = F.when(F.col("last").isNull(), F.lit("missing")).when(~F.col("last.digest").eqNullSafe(F.col("expected")), F.lit("stale")).otherwise(F.col("last.status"))
    return told.select(*KEY, status.alias("status"), F.when(status == F.col("last.status"), F.col("last.reason")).alias("reason"))


def collect_evidence(spark: SparkSession, root: str, planned: DataFrame, names: list[str], most: int = 100_000) -> Evidence:
    """The runs' statuses and, by table, the rows of the completed ones. The planned runs, of which there are at most ``most``, prune the scan."""
    index = run_index(spark, root, planned)
    rows = index.where("status = 'completed'").select(*KEY).limit(most + 1).collect()  # a row a run
    if len(rows) > most:
        raise ValueError(f"more than {most} runs: collect them mode by mode")
    done = spark.createDataFrame(rows, "mode string, experiment string, seed long, salt long")
    values = {k: sorted({r[k] for r in rows}) for k in KEY}
    tables = {}
    for name in names:
        df = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        pruned = df.where(F.lit(bool(rows)))
        for k in KEY:
            pruned = pruned.where(F.col(k).isin(values[k])) if rows else pruned
        kinds = {"seed": "long", "salt": "long"}
        typed = pruned.withColumns({k: F.col(k).cast(kinds.get(k, "string")) for k in KEY})
        tables[name] = normalise_arms(typed.join(done, KEY, "left_semi"))
    return Evidence(index, tables)


def require_final(index: DataFrame) -> None:
    """Raises unless every planned run is completed or infeasible."""
    open_ = index.where("status not in ('completed', 'infeasible')").groupBy("status").count().orderBy("status").collect()  # a row a status
    if open_:
        raise ValueError("runs are not final: " + ", ".join(f"{r['status']} {r['count']}" for r in open_))
