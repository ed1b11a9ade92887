"""SHA-256 of large files, part by part: a part's task starts from the state that the part before has left."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.session import discard, new_path

#: Bytes of a file that are digested in one task.
PART = 1 << 27
#: Bytes of a row of a staged part.
BLOCK = 1 << 20
BOM = b"\xef\xbb\xbf"
SCHEMA = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("seq", pa.int32()), ("size", pa.int64()), ("bytes", pa.binary()), ("part", pa.int64())])
COLUMNS = "file long, start long, seq int, size long, bytes binary, part long"
#: A file's number.
FILE = "xxhash64(_metadata.file_path)"


class _State(ctypes.Structure):
    """OpenSSL's SHA256_CTX, which hashlib does not give out."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


def _crypto() -> ctypes.CDLL:
    """The OpenSSL that hashlib is linked with."""
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


def advance(state: bytes | None, data: Iterable[bytes]) -> bytes:
    """The state after ``data``; None: the state of nothing."""
    crypto, now = _crypto(), _State()
    if state is None:
        crypto.SHA256_Init(ctypes.byref(now))
    else:
        now = _State.from_buffer_copy(state)
    for piece in data:
        crypto.SHA256_Update(ctypes.byref(now), piece, ctypes.c_size_t(len(piece)))
    return bytes(now)


def finish(state: bytes) -> str:
    now, digest = _State.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(digest, ctypes.byref(now))
    return digest.raw.hex()


def can_chain() -> bool:
    """Whether this Python's OpenSSL gives its states out."""
    try:
        return finish(advance(advance(None, [b"sieve"]), [b"grid" * 32])) == hashlib.sha256(b"sieve" + b"grid" * 32).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def in_parts(spark: SparkSession, path: str) -> bool:
    """Whether the text reader takes the file as it is, not unpacked by its name's ending."""
    jvm = spark.sparkContext._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return codecs.getCodec(jvm.org.apache.hadoop.fs.Path(path)) is None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, seq, part, size, bytes): the lines of each split, each ended by a line feed, in blocks."""
    key, held, size, seq = None, [], 0, 0

    def block() -> pa.RecordBatch:
        data = b"".join(held)
        return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "seq": seq, "size": len(data), "bytes": data, "part": key[2]}], SCHEMA)

    for batch in batches:
        keys = [batch.column(name).to_numpy() for name in ("file", "start")]
        turns = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        for low, high in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            if low == high:
                continue
            here = tuple(batch.column(name)[low].as_py() for name in ("file", "start", "part"))
            if key != here:
                if held:
                    yield block()
                key, held, size, seq = here, [], 0, 0
            held += [b"\n".join(batch.column("value").slice(low, high - low).to_pylist()), b"\n"]
            size += len(held[-2]) + 1
            if size >= BLOCK:
                yield block()
                held, size, seq = [], 0, seq + 1
    if held:
        yield block()


def chained_digests(spark: SparkSession, files: list[tuple[str, int, int]], part: int = PART) -> list[str]:
    """The SHA-256 of each of the files (path, length, FILE).

    Lines of bytes are what Spark reads of any file in splits. They are staged in blocks once; then a job a part takes the files'
    states on, so the jobs are as many as the largest file has parts. A file's state, 112 bytes, goes through the driver.
    """
    if len({i for _, _, i in files}) < len(files):
        raise ValueError("two files have the same number")
    staged = new_path(spark, "file-parts")
    left = [staged]
    try:
        lines = spark.read.option("lineSep", "\n").text([re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path, _, _ in files])
        start = F.col("_metadata.file_block_start")
        rows = lines.select(F.expr(FILE).alias("file"), start.alias("start"), F.floor(start / part).alias("part"), F.col("value").cast("binary").alias("value"))
        rows.mapInArrow(_blocks, COLUMNS).write.partitionBy("part").option("compression", "none").parquet(staged)
        blocks = spark.read.schema(COLUMNS).parquet(staged)
        read = {r["file"]: r for r in blocks.groupBy("file").agg(F.sum("size").alias("size"), F.max("part").alias("last")).collect()}
        states, spare = {}, {}
        for path, length, i in files:
            over = read[i]["size"] - length
            # The reader leaves out a byte order mark at the file's start; a last line may have no line feed.
            marked, spare[i] = over < 0, over + len(BOM) if over < 0 else over
            if spare[i] not in (0, 1):
                raise ValueError(f"{path} has {length} bytes, {read[i]['size']} were read with a line feed a line")
            states[i] = advance(None, [BOM] if marked else [])
        for k in range(max(r["last"] for r in read.values()) + 1):
            states |= _next(blocks.where(F.col("part") == k), states, {i: spare[i] for i, r in read.items() if r["last"] == k})
        return [finish(states[i]) for _, _, i in files]
    finally:
        discard(spark, left)


def _next(blocks: DataFrame, states: dict[int, bytes], spare: dict[int, int]) -> dict[int, bytes]:
    """The states after one part. spare: how many bytes too many end the files whose last part this is."""

    def take(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        file = key[0].as_py()
        rows = rows.sort_by([("start", "ascending"), ("seq", "ascending")])
        data = [b.as_py() for b in rows["bytes"]]
        if spare.get(file):
            data[-1] = data[-1][: -spare[file]]
        return pa.table({"file": pa.array([file], pa.int64()), "state": pa.array([advance(states[file], data)], pa.binary())})

    found = blocks.select("file", "start", "seq", "bytes").groupBy("file").applyInArrow(take, "file long, state binary")
    return {r["file"]: bytes(r["state"]) for r in found.collect()}
