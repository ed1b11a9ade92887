"""Namespaces: the samples that every representation has, with each representation's rows aligned to one order.

All representations are merged in one pass: a row of each goes to its key, all to one shuffle by key, and one aggregate tells which
kinds a key has and keeps their values, in place of a semi-join a kind. Keys that a kind lacks or has twice are counted, not lost silently.
The kept samples are numbered in the order of the assignments, and each kind is written as a matrix by these numbers.

Defined cases: keys compare in lower case; rows without a key are left out; a kind's key that occurs twice takes its first row by ``place``, then
by its values, and is counted; kinds may have keys that no sample has; no common sample raises.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.operators.splits import dense_ids
from sievegrid.sources import sparse

VECTOR = "struct<idx:array<int>,val:array<float>>"


def shard_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a glob pattern, in order of their paths; none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    if not len(found):
        raise FileNotFoundError(pattern)
    return sorted(f.getPath().toString() for f in found)


def read_archives(spark: SparkSession, paths: list[str], keys: tuple[str, ...] = ("hash", "hashes"), metas: list[str] | None = None, pickled: bool = False) -> DataFrame:
    """(sha256, place, idx, val) of .npz archives: a CSR matrix (data, indices, indptr, shape) or a dense X, and the rows' hashes.

    Hashes lie in the same archive under one of ``keys``, or in the archive of ``metas`` at the same place of the list. An archive is read
    whole by one task. ``pickled`` allows arrays of objects, which can run code when they are read: for trusted files only.
    """
    pairs = spark.createDataFrame([(p, (metas or paths)[i], i) for i, p in enumerate(paths)], "matrix string, meta string, shard int")
    content = spark.read.format("binaryFile").load(sorted({*paths, *(metas or paths)})).select("path", "content")
    matrix = content.select(F.col("path").alias("matrix"), F.col("content").alias("x"))
    meta = content.select(F.col("path").alias("meta"), F.col("content").alias("m"))
    both = pairs.join(matrix, "matrix") if metas is None else pairs.join(matrix, "matrix").join(meta, "meta")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                with np.load(io.BytesIO(r.x), allow_pickle=pickled) as archive:
                    if "indptr" in archive.files:
                        bounds, idx, val = archive["indptr"], archive["indices"], archive["data"].astype(np.float32)
                    else:
                        dense = archive["X"].astype(np.float32)
                        row, idx = np.nonzero(dense)
                        bounds, val = np.searchsorted(row, np.arange(len(dense) + 1)), dense[row, idx]
                    held = archive if metas is None else np.load(io.BytesIO(r.m), allow_pickle=pickled)
                    names = [str(h).lower() for h in held[next(k for k in keys if k in held.files)]]
                yield pd.DataFrame({"sha256": names, "place": (np.int64(r.shard) << 40) + np.arange(len(names)), "idx": [np.sort(idx[a:b]).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], "val": [val[a:b][np.argsort(idx[a:b])] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    columns = ["shard", "x"] if metas is None else ["shard", "x", "m"]
    return both.select(*columns).mapInPandas(run, "sha256 string, place long, idx array<int>, val array<float>")


def merged(assignments: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """(sha256, source_row, label, repeats and one (idx, val) a kind): a row a sample of assignments (sha256, row, label).

    A kind (sha256, place, idx, val) that lacks the sample is null; ``repeats`` has the kinds' numbers of further rows of the key.
    """
    vector = F.struct("idx", "val").cast(VECTOR)
    sample = assignments.select(F.lower("sha256").alias("sha256"), F.lit("").alias("kind"), F.lit(None).cast("long").alias("place"), F.lit(None).cast(VECTOR).alias("vector"), F.struct(F.col("row").cast("long").alias("row"), F.col("label").cast("long").alias("label")).alias("sample"))
    parts = [rows.select(F.lower("sha256").alias("sha256"), F.lit(name).alias("kind"), F.col("place").cast("long").alias("place"), vector.alias("vector"), F.lit(None).cast("struct<row:long,label:long>").alias("sample")) for name, rows in kinds.items()]
    every = reduce(DataFrame.unionByName, [sample, *parts]).where("sha256 is not null")
    of = lambda name, x: F.when(F.col("kind") == name, x)
    first = [F.min(of(k, F.struct("place", "vector")))["vector"].alias(k) for k in kinds]
    repeats = F.array(*[F.greatest(F.count(of(k, F.lit(1))) - 1, F.lit(0)) for k in kinds]) if kinds else F.array().cast("array<long>")
    told = every.groupBy("sha256").agg(F.min("sample").alias("sample"), repeats.alias("repeats"), *first)
    return told.where("sample is not null").select("sha256", F.col("sample.row").alias("source_row"), F.col("sample.label").alias("label"), "repeats", *kinds)


def overlap(together: DataFrame, kinds: list[str]) -> DataFrame:
    """The samples that all kinds have, with ``row``: their number in order of source_row."""
    whole = together.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kinds], F.lit(True)))
    least, most = whole.agg(F.min("source_row"), F.max("source_row")).first()
    spread = F.floor((F.col("source_row") - (least or 0)) * F.lit((1 << 32) / ((most or 0) - (least or 0) + 1)))
    return dense_ids(whole, spread.cast("long"), "source_row", "row")


def manifest(together: DataFrame, kinds: list[str]) -> DataFrame:
    """(name, n): samples, overlap, its malware and benign rows, and each kind's missing and repeated keys."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kinds], F.lit(True))
    counts = {"samples": F.count(F.lit(1)), "rows": F.count_if(whole), "malware_rows": F.count_if(whole & (F.col("label") == 1)), "benign_rows": F.count_if(whole & (F.col("label") == 0))}
    for i, k in enumerate(kinds):
        counts |= {f"{k}_missing": F.count_if(F.col(k).isNull()), f"{k}_repeated": F.coalesce(F.sum(F.get("repeats", F.lit(i))), F.lit(0))}
    row = together.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counts])).alias("c")).select("c.name", "c.n")


def cells(samples: DataFrame, kind: str) -> DataFrame:
    """(row, idx, val) of a kind's values by the samples' numbers."""
    return samples.select("row", F.explode(F.arrays_zip(F.col(f"{kind}.idx").alias("idx"), F.col(f"{kind}.val").alias("val"))).alias("x")).select("row", "x.idx", "x.val")


def aligned_rows(blocks: DataFrame, samples: DataFrame, order: DataFrame, rows_per_block: int = sparse.ROWS_PER_BLOCK) -> DataFrame:
    """A kind's rows for the keys of ``order`` (position, sha256); a key that is no sample raises."""
    placed = order.join(samples.select("sha256", "row"), "sha256", "left")
    checked = placed.withColumn("row", F.coalesce("row", F.raise_error(F.concat(F.lit("no aligned row for "), "sha256")).cast("long")))
    return sparse.gather(blocks, checked.select("position", "row"), rows_per_block)


def build_namespace(assignments: DataFrame, kinds: dict[str, DataFrame], path: str, half: frozenset[str] = frozenset(), logged: frozenset[str] = frozenset(), rows_per_block: int = sparse.ROWS_PER_BLOCK) -> dict[str, int]:
    """Writes the merge, the samples and each kind's matrix below ``path``; the manifest's counts.

    Kinds in ``half`` are kept as half floats, those in ``logged`` as signed logarithms.
    """
    spark = assignments.sparkSession
    merged(assignments, kinds).write.mode("overwrite").parquet(f"{path}/merged")
    together = spark.read.parquet(f"{path}/merged")
    told = {r["name"]: r["n"] for r in manifest(together, list(kinds)).collect()}
    if not told["rows"]:
        raise ValueError("no sample has every representation")
    overlap(together, list(kinds)).write.mode("overwrite").parquet(f"{path}/samples")
    samples = spark.read.parquet(f"{path}/samples")
    for k in kinds:
        values = cells(samples, k)
        sparse.save_csr(sparse.signed_log(values) if k in logged else values, f"{path}/{k}", told["rows"], k in half, rows_per_block)
    return told


def check_namespace(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """(name, passed): every kind has as many rows as there are samples, keys are single, numbers have no gaps."""
    samples = spark.read.parquet(f"{path}/samples").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha256").alias("keys"), F.coalesce(F.max("row") + 1, F.lit(0)).alias("last"), F.count_distinct("row").alias("numbers"))
    for k in kinds:
        rows = sparse.load_blocks(spark, f"{path}/{k}").agg(F.coalesce(F.sum(F.size("counts")), F.lit(0)).alias(k))
        samples = samples.crossJoin(rows)  # one row each
    checks = {"unique_keys": F.col("keys") == F.col("n"), "numbers": (F.col("last") == F.col("n")) & (F.col("numbers") == F.col("n"))} | {f"{k}_rows": F.col(k) == F.col("n") for k in kinds}
    return samples.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])).alias("c")).select("c.name", "c.passed")
