"""Sources and sinks of the study tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.sources import digests


def read_release(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """All Parquet files one folder below ``path``; with ``base``, the folders' names between it and the files are columns."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    return reader.parquet(f"{path}/*/*.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a value that does not fit its type fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report table as one sorted CSV file."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def read_market_index(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of the (gz) CSV whose hash is wanted, in any case. The file's reading is one task; the join deals its rows out."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(F.lower("sha256").alias("sha256"), F.col("pkg_name").alias("package"), "markets", F.col("vt_detection").cast("double").alias("vt_count"))
    return rows.join(wanted.select(F.lower("sha256").alias("sha256")).distinct(), "sha256", "left_semi")


def sparse_rows(df: DataFrame, row: str, features: str) -> DataFrame:
    """(row, idx, val) of the values that are not 0, from dense arrays."""
    long = df.select(row, F.posexplode(features).alias("idx", "val"))
    return long.where("val <> 0").select(row, "idx", F.col("val").cast("float").alias("val"))


def dense_rows(sparse: DataFrame, row: str, width: int) -> DataFrame:
    """(row, features) as arrays of ``width``, of rows that have a value."""
    pairs = sparse.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    return pairs.select(row, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float"))).alias("features"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*", known: DataFrame | None = None) -> DataFrame:
    """(name, stat, digest) of files; digests of files whose size and time are as in ``known`` are taken from there.

    Files of more than digests.PART bytes are read now, part by part; others where the result is read, one to a row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    if known is None:
        return _digested(files)
    now = files.select(*_named(), F.col("path"))
    old = now.join(known.select("name", "stat", "digest"), ["name", "stat"]).select("name", "stat", "digest")
    fresh = now.join(known.select("name", "stat"), ["name", "stat"], "left_anti").select("path")
    paths = [r.path for r in fresh.collect()]  # a row a source file
    if not paths:
        return old
    return old.unionByName(_digested(spark.read.format("binaryFile").load(paths)))


def _named() -> list[Column]:
    return [F.element_at(F.split("path", "/"), -1).alias("name"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("stat")]


def _digested(files: DataFrame) -> DataFrame:
    spark, at = files.sparkSession, F.col("_metadata.file_path")
    whole = files.select(*_named(), F.sha2("content", 256).alias("digest"))
    large = files.where(F.col("length") > digests.PART).select("path", "length", at.alias("at"), F.expr(digests.FILE).alias("file"), *_named()).collect()  # a row a large file
    large = [r for r in large if digests.in_parts(spark, r["path"])] if large and digests.can_chain() else []
    if not large:
        return whole
    found = digests.chained_digests(spark, [(r["path"], r["length"], r["file"]) for r in large], digests.PART)
    rows = spark.createDataFrame([(r["name"], r["stat"], d) for r, d in zip(large, found, strict=True)], "name string, stat string, digest string")
    others = files.where(~at.isin([r["at"] for r in large]))  # by the files' list: large ones are not opened
    return others.select(*_named(), F.sha2("content", 256).alias("digest")).unionByName(rows)


def dataset_digest(digests: DataFrame) -> str:
    """SHA-256 of the sorted name:digest lines."""
    lines = sorted(f"{r.name}:{r.digest}" for r in digests.select("name", "digest").collect())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def fingerprint(record: dict) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()


def write_document(spark: SparkSession, path: str, record: dict) -> None:
    """One JSON line at any store Spark writes to."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.text(path).first()[0])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_evidence(df: DataFrame, path: str) -> None:
    """Partitioned by run keys, so later reads prune to the runs they want."""
    df.write.mode("overwrite").partitionBy("mode", "experiment", "seed", "salt").parquet(path)


def read_evidence(spark: SparkSession, path: str, mode: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("mode") == mode)
