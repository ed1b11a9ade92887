"""Session helpers: building a session, reading tables and staging tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievegrid", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one, for local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='sievegrid-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_remove_local, root.removeprefix("file://"))
    return root


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Paths made inside recording() blocks that are open.
_scratch: list[list[str]] = []


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_folder(spark)}/sievegrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of what is staged inside, but for tables staged with ``keep``."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def discard(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Delete staged paths, but for those that ``reader`` reads."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in reader.inputFiles()} if reader is not None and paths else set()
    for path in list(paths):
        if path.rpartition("/")[2] not in read:
            _delete(spark, path)
            paths.remove(path)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name, keep)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside needs its shuffles no more; loops would fill the disks with them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/sievegrid/"
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        plain = folder.replace("file:///", "file:/")
        if plain.startswith(root.replace("file:///", "file:/")):
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bucketed(df: DataFrame, name: str, keys: list[str], rows: int, rows_per_bucket: int = 500_000) -> Iterator[DataFrame]:
    """The table, kept by ``keys`` in buckets for as long as the block runs: joins on the keys shuffle the other side only."""
    spark = df.sparkSession
    buckets = min(max(-(-rows // rows_per_bucket), 1), 8192)
    path, kept = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(kept)
    try:
        yield spark.table(kept)
    finally:
        spark.sql(f"DROP TABLE {kept}")
        _delete(spark, path)
