"""Training-order materialisation: fixed-length token sequences in a keyed pseudo-random order, in fixed-stride shards.

Documents become token ids (an end token after each) and sequences of ``seq_len`` ids, the last one padded. Sequence
i of N gets slot P(i), where P is a keyed Feistel permutation of the next power of four, walked in cycles until it
falls below N. Slots are cut into ranges; one task writes a range's shards, sorted. A shard is one file of records of
equal length, so slot s is in shard s // shard_rows at byte (s % shard_rows) * stride, and a reader can stop and go on
anywhere. The files come from Spark's own writer: commits are atomic, lost executors are made up for, any store works.

Record: int64 document id, int32 sequence number, int32 tokens that count, seq_len uint16 ids, and a line feed; little-endian.

Tokenizing twice, once for the counts, takes less disk than keeping the ids. Both passes must see the same partitions; a
partition with another count than before fails the job.

Defined cases: a null or empty text gives one sequence of the end token; a null id is written as the least int64; repeated
rows are written as often as they occur; an empty table gives no shards; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.textvec import U, mix
from sievegrid.llm.tokens import encoder, share_ranks

HEADER = 16
NO_ID = -(1 << 63)
ROUNDS = 6


class Permutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [mix(np.array([(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1], U))[0] for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        mask, half = U((1 << self.half) - 1), U(self.half)
        left, right = x >> half, x & mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix(left + key) & mask), left
            else:
                left, right = right, left ^ (mix(right + key) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(U), back)
        while (out := x >= U(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary column, without a copy a row."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def materialise(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = 256,
    shard_rows: int = 16384,
    key: int = 2024,
) -> int:
    """Write the shards below ``path`` (shard=0, shard=1, ...); the number of sequences."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            n += int((-(-encoder(ranks.value).sizes(batch.column(1)) // seq_len)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["part", "n"])

    counts = {r.part: r.n for r in base.mapInArrow(counted, "part long, n long").collect()}  # a row a partition
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    if not total:
        return 0
    order = Permutation(total, key)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done = 0
        for batch in batches:
            for first, last, ids, bounds in encoder(ranks.value).encode(batch.column(1)):
                size = np.diff(bounds)
                number = -(-size // seq_len)
                owner = np.repeat(np.arange(last - first), number)
                seq = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                begin = bounds[owner] + seq * seq_len
                held = np.minimum(bounds[owner + 1] - begin, seq_len)
                record = np.zeros((len(owner), HEADER + 2 * seq_len), np.uint8)
                names = np.array([NO_ID if x is None else x for x in batch.column(0).slice(first, last - first).to_pylist()], np.int64)
                record[:, :8] = names[owner].astype("<i8").view(np.uint8).reshape(-1, 8)
                record[:, 8:12] = seq.astype("<i4").view(np.uint8).reshape(-1, 4)
                record[:, 12:16] = held.astype("<i4").view(np.uint8).reshape(-1, 4)
                tokens = np.full((len(owner), seq_len), encoder(ranks.value).end, "<u2")
                tokens[np.arange(seq_len)[None] < held[:, None]] = ids
                record[:, HEADER:] = tokens.view(np.uint8).reshape(len(owner), -1)
                slot = order.slots(offsets[part] + done + np.arange(len(owner)))
                done += len(owner)
                yield pa.RecordBatch.from_arrays([pa.array(slot), _binary(record)], names=["slot", "record"])
        if done != counts.get(part, 0):
            raise RuntimeError(f"partition {part} has {done} sequences and had {counts.get(part, 0)}: the input changed")

    shards = -(-total // shard_rows)
    rows = base.mapInArrow(written, "slot long, record binary").withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    ranged = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    ranged.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return total


def stride(seq_len: int) -> int:
    return HEADER + 2 * seq_len + 1


def read_slots(spark: SparkSession, path: str, seq_len: int = 256, shard_rows: int = 16384) -> DataFrame:
    """(slot, shard, place, id, seq, n_tokens, tokens) of every record, read back from the shards; tokens as uint16 bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    width = stride(seq_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, width)
                for a in range(0, len(data), 2048):
                    rows = data[a : a + 2048]
                    field = lambda i, j, kind, rows=rows: np.ascontiguousarray(rows[:, i:j]).view(kind).ravel()
                    place = np.arange(a, a + len(rows))
                    ids = field(0, 8, "<i8")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard * shard_rows + place),
                            pa.array(np.full(len(rows), shard, np.int32)),
                            pa.array(place),
                            pa.array(ids, mask=ids == NO_ID),
                            pa.array(field(8, 12, "<i4")),
                            pa.array(field(12, 16, "<i4")),
                            _binary(rows[:, HEADER : HEADER + 2 * seq_len]),
                        ],
                        names=["slot", "shard", "place", "id", "seq", "n_tokens", "tokens"],
                    )

    return files.select("shard", "content").mapInArrow(run, "slot long, shard int, place long, id long, seq int, n_tokens int, tokens binary")
