"""Digests of files larger than a task's part."""

import gzip
import hashlib
import os
import random

import pytest

from sievegrid.sources import readers


@pytest.fixture
def small_splits(spark):
    confs = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.sources.binaryFile.maxLength": "5000"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k in confs:
        spark.conf.unset(k)


def test_files_larger_than_a_row_are_digested_in_parts(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr("sievegrid.sources.digests.PART", 4000, raising=False)
    noise = random.Random(1).randbytes
    files = {
        "small.bin": noise(300),
        "large.bin": noise(20_000),
        "ended.bin": noise(8_000) + b"\n",
        "marked[1].csv": b"\xef\xbb\xbf" + b"a,b\r\n\r\n" * 2_000,
        "marked open.csv": b"\xef\xbb\xbf" + noise(6_000) + b"x",
        "feeds.txt": b"\n" * 9_000,
        "one line.txt": b"z" * 9_001,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r["name"]: r["digest"] for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert found == {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}


def test_packed_files_are_digested_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sievegrid.sources.digests.PART", 4000, raising=False)
    (tmp_path / "index.csv.gz").write_bytes(gzip.compress(random.Random(2).randbytes(9_000)))
    (tmp_path / "plain.bin").write_bytes(os.urandom(9_000))
    digests = readers.file_digests(spark, str(tmp_path))
    expected = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    assert {r["name"]: r["digest"] for r in digests.collect()} == expected
    (tmp_path / "later.bin").write_bytes(os.urandom(9_000))
    again = {r["name"]: r["digest"] for r in readers.file_digests(spark, str(tmp_path), known=digests).collect()}
    assert again == expected | {"later.bin": hashlib.sha256((tmp_path / "later.bin").read_bytes()).hexdigest()}
