"""NumPy files as a Spark source and sink: ``spark.read.format("numpy")`` after ``register(spark)``.

A file (.npy, or .npz with an array a column) is read in slices of rows, a task a slice, each from its own place in the file: an
uncompressed member of an archive is sought into, a compressed one is skipped through in pieces. The schema is declared by the reader: columns are
the arrays' names, ``row`` a row's number in its file and ``file`` the file's name; a .npy file has the one column of any other name.
Arrays of one dimension are numbers, of two arrays. Written tables are folders of archives that appear, with a _SUCCESS mark, when all
tasks have ended; a task that is run twice leaves one of its files.

Python opens the files, so the folder must be one that the driver and all executors see; other stores have
``namespaces.read_archives``, by way of Spark's binary files. Arrays of objects are refused: reading them can run code. Empty arrays have no
slices; an array that a file lacks, or arrays of unlike lengths, are errors.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE = 1 << 20


def local_path(path: str) -> str:
    scheme, sep, rest = path.partition(":")
    if sep and len(scheme) > 1 and scheme != "file":
        raise ValueError(f"{path}: not a folder that Python can open")
    return "/" + rest.lstrip("/") if scheme == "file" and sep else path


class Member:
    """One array of a file, opened at its first row."""

    def __init__(self, path: str, name: str | None) -> None:
        if name is None:
            self.stream = open(path, "rb")  # noqa: SIM115
        else:
            self.archive = zipfile.ZipFile(path)
            if f"{name}.npy" not in self.archive.namelist():
                raise ValueError(f"{path} has no array {name}")
            self.stream = self.archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.stream)
        if self.dtype.hasobject:
            raise ValueError(f"{path}: arrays of objects are not read")
        if fortran and len(self.shape) > 1 or len(self.shape) not in (1, 2):
            raise ValueError(f"{path}: arrays must have one or two dimensions, row by row")
        self.start = self.stream.tell()

    def rows(self, first: int, last: int) -> np.ndarray:
        size = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self.stream.seek(self.start + first * size)  # within a compressed member, reads on in pieces
        out, got = bytearray((last - first) * size), 0
        while got < len(out):
            piece = self.stream.read(min(PIECE, len(out) - got))
            if not piece:
                raise ValueError("an array ends early")
            out[got : got + len(piece)] = piece
            got += len(piece)
        return np.frombuffer(bytes(out), self.dtype).reshape(last - first, *self.shape[1:])

    def close(self) -> None:
        self.stream.close()
        if hasattr(self, "archive"):
            self.archive.close()


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    last: int


class NumpyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema = schema
        self.root, self.step = local_path(options["path"]), int(options.get("slice_rows", 65_536))
        self.arrays = [f.name for f in schema.fields if f.name not in ("row", "file")]

    def _files(self) -> list[str]:
        if not os.path.isdir(self.root):
            return [self.root]
        return sorted(os.path.join(d, f) for d, _, files in os.walk(self.root) for f in files if f.endswith((".npy", ".npz")) and not os.path.basename(d).startswith("_"))

    def _name(self, path: str, name: str) -> str | None:
        return name if path.endswith(".npz") else None

    def partitions(self) -> list[Slice]:
        out = []
        for path in self._files():
            lengths = set()
            for name in self.arrays:
                member = Member(path, self._name(path, name))
                lengths.add(member.shape[0])
                member.close()
            if len(lengths) != 1:
                raise ValueError(f"{path}: arrays of unlike lengths or none")
            n = lengths.pop()
            out += [Slice(path, a, min(a + self.step, n)) for a in range(0, n, self.step)]
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no slices at all
            return
        kinds = to_arrow_schema(self.schema)
        columns = []
        for field in kinds:
            if field.name == "row":
                columns.append(pa.array(np.arange(partition.first, partition.last)).cast(field.type))
            elif field.name == "file":
                columns.append(pa.array([os.path.basename(partition.path)] * (partition.last - partition.first)))
            else:
                member = Member(partition.path, self._name(partition.path, field.name))
                x = member.rows(partition.first, partition.last)
                member.close()
                flat = pa.array(x.astype(x.dtype.newbyteorder("=")).ravel())
                if x.ndim == 2:
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                columns.append(flat.cast(field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NumpyWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.schema, self.overwrite = schema, overwrite
        self.root, self.step = local_path(options["path"]), int(options.get("slice_rows", 65_536))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(f"{self.root}/_temporary", exist_ok=True)
        files = []
        for batch in iterator:
            for a in range(0, batch.num_rows, self.step):
                part = batch.slice(a, self.step)
                arrays = {}
                for name, column in zip(part.schema.names, part.columns, strict=True):
                    if column.null_count:
                        raise ValueError(f"{name}: nulls have no place in an array")
                    lists = pa.types.is_list(column.type)
                    x = (column.flatten() if lists else column).to_numpy(zero_copy_only=False)
                    if x.dtype == object:
                        x = x.astype(str)
                    arrays[name] = x.reshape(len(part), -1) if lists else x
                file = f"{self.root}/_temporary/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files):05d}.npz"
                np.savez(file, **arrays)
                files.append(file)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.root, exist_ok=True)
        if self.overwrite:
            for f in os.listdir(self.root):
                if f.endswith(".npz"):
                    os.remove(f"{self.root}/{f}")
        for message in messages:
            for file in message.files if message else []:
                os.replace(file, f"{self.root}/{os.path.basename(file)}")
        self._cleared()
        with open(f"{self.root}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        folder = f"{self.root}/_temporary"
        if os.path.isdir(folder):
            for f in os.listdir(folder):
                os.remove(f"{folder}/{f}")
            os.rmdir(folder)


class NumpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numpy"

    def schema(self) -> str:
        raise ValueError("declare the schema of a numpy source")

    def reader(self, schema: StructType) -> NumpyReader:
        return NumpyReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NumpyWriter:
        return NumpyWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumpySource)
