"""Sparse matrices as tables of row blocks.

A row of the table is a block of consecutive matrix rows: (block, counts, gaps, data). ``counts`` has each row's number of values,
``gaps`` the column numbers, delta-coded within a row, ``data`` the values as little-endian half or single floats. Files are
in order of blocks, so a scan for some of them reads their row groups only. A block is the unit of work: its size is bounded by the rows of
a block times the matrix' width.

Defined cases: rows without values are kept; a cell that occurs twice is refused; a gathered position outside the matrix is refused,
a row that is asked for twice comes twice; an empty matrix has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "block long, counts array<int>, gaps array<int>, data binary"
ROWS_PER_BLOCK = 4096
#: Bytes of the dense side of a product, at most.
DENSE_BYTES = 1 << 28


def encoded(row: np.ndarray, idx: np.ndarray, val: np.ndarray, rows: int, half: bool) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(counts, gaps, data) of the cells of ``rows`` rows, numbered from 0."""
    order = np.lexsort((idx, row))
    row, idx, val = row[order], idx[order], val[order]
    same = row[1:] == row[:-1]
    if (same & (idx[1:] == idx[:-1])).any():
        raise ValueError("a cell occurs twice")
    gaps = idx.copy()
    gaps[1:][same] -= idx[:-1][same]
    return np.bincount(row, minlength=rows).astype(np.int32), gaps.astype(np.int32), val.astype("<f2" if half else "<f4").tobytes()


def decoded(counts: np.ndarray, gaps: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, columns, values)."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    run = np.cumsum(np.asarray(gaps, np.int64))
    before = np.concatenate([[0], run])[bounds[:-1]]
    half = len(data) == 2 * len(gaps) and len(gaps) > 0
    return bounds, run - np.repeat(before, counts), np.frombuffer(data, "<f2" if half else "<f4").astype(np.float32)


def save_csr(cells: DataFrame, path: str, rows: int, half: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Writes the cells (row, idx, val) of a matrix of ``rows`` rows."""
    spark = cells.sparkSession
    blocks = -(-rows // rows_per_block)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        block = int(b["block"].iloc[0])
        b = b[b["idx"].notna()]
        inside = b["row"].to_numpy(np.int64) - block * rows_per_block
        own = min(rows_per_block, rows - block * rows_per_block)
        if own <= 0 or len(inside) and (inside.max() >= own or inside.min() < 0):
            raise ValueError("a cell lies outside the matrix")
        counts, gaps, data = encoded(inside, b["idx"].to_numpy(np.int64), b["val"].to_numpy(float), own, half)
        return pd.DataFrame({"block": [block], "counts": [counts], "gaps": [gaps], "data": [data]})

    numbered = cells.select(F.floor(F.col("row") / rows_per_block).alias("block"), F.col("row").cast("long").alias("row"), F.col("idx").cast("int").alias("idx"), F.col("val").cast("double").alias("val"))
    every = spark.range(blocks).select(F.col("id").alias("block"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("val"))
    made = numbered.unionByName(every).groupBy("block").applyInPandas(run, BLOCK)
    made.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def load_csr(blocks: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(row, idx, val) of the values of all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                bounds, idx, val = decoded(r.counts, r.gaps, r.data)
                yield pd.DataFrame({"row": np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + r.block * rows_per_block, "idx": idx.astype(np.int32), "val": val})

    return blocks.mapInPandas(run, "row long, idx int, val float")


def gather(blocks: DataFrame, wanted: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(position, row, idx, val), idx and val as arrays, of (position, row): rows of the matrix in an order of the caller's.

    Wanted rows are gathered by block, in lots of at most about a block's rows, so that a block meets a lot once, however often it is asked for.
    """
    asked = wanted.select("position", F.col("row").cast("long").alias("row"), F.floor(F.col("row") / rows_per_block).alias("block"))
    lots = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).alias("lots"))
    dealt = asked.join(lots, "block").groupBy("block", F.pmod(F.xxhash64("position"), "lots").alias("lot")).agg(F.collect_list(F.struct("position", "row")).alias("asked"))
    both = dealt.join(blocks, "block", "left").select("block", F.col("asked.position").alias("positions"), F.col("asked.row").alias("rows"), "counts", "gaps", "data")
    kind = dict(wanted.dtypes)["position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a lot at a time, without a Python object a row
                block, positions, rows, counts, gaps, data = b.slice(i, 1).columns
                rows, counts = rows.flatten(), None if counts.null_count else counts.flatten().to_numpy()
                place = rows.to_numpy() - block[0].as_py() * rows_per_block
                if counts is None or place.max() >= len(counts) or place.min() < 0:
                    raise ValueError("a position lies outside the matrix")
                bounds, idx, val = decoded(counts, gaps.flatten().to_numpy(), data[0].as_py())
                sizes = bounds[place + 1] - bounds[place]
                ends = np.cumsum(sizes)
                at = np.repeat(bounds[place] - (ends - sizes), sizes) + np.arange(ends[-1])
                starts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (idx[at].astype(np.int32), val[at])]
                yield pa.RecordBatch.from_arrays([positions.flatten(), rows, *lists], ["position", "row", "idx", "val"])

    return both.mapInArrow(run, f"position {kind}, row long, idx array<int>, val array<float>")


def binary_rows(blocks: DataFrame, wanted: DataFrame, width: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(position, row, features): the wanted rows as dense bytes."""
    sparse = gather(blocks, wanted, rows_per_block)
    kind = dict(wanted.dtypes)["position"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dense = np.zeros((len(b), width), np.uint8)
            for i, (idx, val) in enumerate(zip(b["idx"], b["val"], strict=True)):
                dense[i, idx] = val
            yield b[["position", "row"]].assign(features=[r.tobytes() for r in dense])

    return sparse.mapInPandas(run, f"position {kind}, row long, features binary")


def products(blocks: DataFrame, dense: np.ndarray, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(row, products): each row times the columns of ``dense``, a matrix that every worker gets and whose size is checked."""
    if dense.nbytes > DENSE_BYTES:
        raise ValueError(f"the dense side has more than {DENSE_BYTES} bytes: multiply by some of its columns at a time")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                bounds, idx, val = decoded(r.counts, r.gaps, r.data)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                out = np.stack([np.bincount(row, val * dense[idx, k], minlength=len(bounds) - 1) for k in range(dense.shape[1])], axis=1)
                yield pd.DataFrame({"row": np.arange(len(out)) + r.block * rows_per_block, "products": list(out)})

    return blocks.mapInPandas(run, "row long, products array<double>")


def signed_log(cells: DataFrame) -> DataFrame:
    return cells.withColumn("val", F.signum("val") * F.log1p(F.abs(F.col("val").cast("double"))))
