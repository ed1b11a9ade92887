"""Kept results, evidence over runs, and NumPy files as a source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.plans import runs as S
from sievegrid.session import new_path
from sievegrid.sources import archives

INPUTS = "run string, name string, value string"
BASE = [("r", "training.mu", "0.1"), ("r", "budget", "6000"), ("r", "spec.salts", "0"), ("other", "spec.salts", "0")]


def digest(spark, rows):
    return {r.run: r.digest for r in S.run_digests(spark.createDataFrame(rows, INPUTS), ["run"]).collect()}


@pytest.mark.parametrize(
    "rows,same",
    [
        (BASE[::-1], True),
        ([*BASE[:3], ("other", "spec.salts", "0,7")], True),
        ([("r", "training.mu", "0.5"), *BASE[1:]], False),
        ([BASE[0], ("r", "budget", "6001"), *BASE[2:]], False),
        ([*BASE[:2], ("r", "spec.salts", "0,1"), BASE[3]], False),
        ([*BASE, ("r", "new", None)], False),
        ([*BASE, BASE[0]], False),
        (BASE[1:], False),
    ],
)
def test_a_run_is_invalidated_by_what_it_depends_on(spark, rows, same):
    assert (digest(spark, rows)["r"] == digest(spark, BASE)["r"]) == same


def test_names_values_and_nulls_do_not_run_together(spark):
    rows = [("a", "x", "1=2"), ("b", "x=1", "2"), ("c", "x", None), ("d", "x", ""), ("e", "x-", None), ("f", "x", "-")]
    assert len(set(digest(spark, rows).values())) == 6


def test_results_are_kept_whole_and_first(spark):
    root, built = new_path(spark, "store"), []

    def build():
        built.append(1)
        return spark.range(3).toDF("x")

    for expected in (False, True):
        df, reused = S.reuse_or_build(spark, root, "stage", "d1", build)
        assert reused == expected and df.count() == 3
    assert len(built) == 1
    assert S.publish(spark.range(9).toDF("x"), root, "stage", "d1").count() == 3
    assert S.reuse_or_build(spark, root, "stage", "d2", build)[1] is False
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        S.publish(broken, root, "stage", "d3")
    assert S.kept(spark, root, "stage", "d3") is None
    assert sorted(os.listdir(f"{root}/stage".removeprefix("file://"))) == ["d1", "d2"]


KEYS = "mode string, experiment string, seed long, salt long"


def test_evidence_tells_runs_apart_and_reads_two_schemas_in_one_scan(spark):
    root = new_path(spark, "runs")
    old = spark.createDataFrame([("m", "e", s, 0, "local", "peer", float(s)) for s in (1, 2)], f"{KEYS}, learner string, condition string, value double")
    new = spark.createDataFrame([("m", "e", s, 0, "fed", "peer", 10, float(s)) for s in (3, 4)] + [("m", "f", 3, 0, "fed", "peer", 10, 9.0)], f"{KEYS}, learner string, condition string, dose long, value double")
    status = f"{KEYS}, status string, reason string, digest string"
    S.write_runs(root, {"summary": old}, spark.createDataFrame([("m", "e", 1, 0, "completed", None, "d"), ("m", "e", 2, 0, "completed", None, "before")], status))
    S.write_runs(root, {"summary": new}, spark.createDataFrame([("m", "e", 3, 0, "completed", None, "d"), ("m", "e", 4, 0, "failed-validation", None, "d"), ("m", "e", 5, 0, "infeasible", "no targets", "d"), ("m", "f", 3, 0, "completed", None, "d")], status))
    planned = spark.createDataFrame([("m", "e", s, 0, "d") for s in range(1, 7)], f"{KEYS}, digest string")
    found = S.collect_evidence(spark, root, planned, ["summary"])
    assert {r.seed: (r.status, r.reason) for r in found.index.collect()} == {1: ("completed", None), 2: ("stale", None), 3: ("completed", None), 4: ("failed-validation", None), 5: ("infeasible", "no targets"), 6: ("missing", None)}
    rows = {(r.experiment, r.seed): (r.learner, r.dose, r.parameter, r.value) for r in found.tables["summary"].collect()}
    assert rows == {("e", 1): ("local", None, None, 1.0), ("e", 3): ("fed", 10, None, 3.0)}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found.tables["summary"].where("value > -1")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert all(k in line.partition("PartitionFilters")[2] for k in ("mode", "experiment", "seed", "salt"))
    with pytest.raises(ValueError, match="failed-validation 1, missing 1, stale 1"):
        S.require_final(found.index)
    S.write_runs(root, {"summary": old.where("seed = 2").withColumn("value", F.lit(7.0))}, spark.createDataFrame([("m", "e", 2, 0, "completed", None, "d")], status))
    again = S.collect_evidence(spark, root, planned.where("seed <= 3 or seed = 5"), ["summary"])
    S.require_final(again.index)
    assert {r.seed: r.value for r in again.tables["summary"].collect()} == {1: 1.0, 2: 7.0, 3: 3.0}


def test_no_runs_is_no_evidence(spark):
    planned = spark.createDataFrame([("m", "e", 1, 0, "d")], f"{KEYS}, digest string")
    assert [r.status for r in S.run_index(spark, new_path(spark, "none"), planned).collect()] == ["missing"]


def test_tables_are_written_as_arrays_and_read_in_slices(spark, tmp_path):
    archives.register(spark)
    df = spark.range(1000).select("id", (F.col("id") / 4).alias("half"), F.array(F.col("id"), F.col("id") * 2).alias("pair"), F.format_string("n%d", "id").alias("name")).repartition(3)
    path = f"{tmp_path}/table"
    df.write.format("numpy").mode("append").option("slice_rows", 100).save(path)
    back = spark.read.format("numpy").schema("id long, half double, pair array<long>, name string, file string, row int").option("slice_rows", 30).load(path)
    rows = back.collect()
    assert {r.id: (r.half, list(r.pair), r.name) for r in rows} == {i: (i / 4, [i, 2 * i], f"n{i}") for i in range(1000)}
    assert max(r.row for r in rows) < 100 and len({r.file for r in rows}) >= 10
    assert back.rdd.getNumPartitions() >= 30
    df.where("id < 5").write.format("numpy").mode("overwrite").save(path)
    assert spark.read.format("numpy").schema("id long").load(path).count() == 5
    with pytest.raises(Exception, match="nulls have no place"):
        spark.createDataFrame([(None,)], "x long").write.format("numpy").mode("append").save(f"{tmp_path}/nulls")


def test_files_of_others_are_read(spark, tmp_path):
    archives.register(spark)
    x = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.save(tmp_path / "one.npy", x)
    np.savez_compressed(tmp_path / "two.npz", x=x, y=np.arange(20, dtype=">i4"))
    read = lambda name, schema: spark.read.format("numpy").schema(schema).option("slice_rows", 7).load(f"{tmp_path}/{name}")
    assert {r.row: list(r.x) for r in read("one.npy", "row long, x array<float>").collect()} == {i: list(v) for i, v in enumerate(x)}
    assert sorted((r.row, r.y, list(r.x)) for r in read("two.npz", "row long, y int, x array<double>").collect()) == [(i, i, list(v)) for i, v in enumerate(x)]
    np.savez(tmp_path / "bad.npz", x=x, y=np.arange(3))
    np.savez(tmp_path / "objects.npz", x=np.array([{}, 1], dtype=object))
    for name, schema, match in (("two.npz", "z int", "no array"), ("bad.npz", "x array<float>, y int", "unlike"), ("objects.npz", "x int", "objects")):
        with pytest.raises(Exception, match=match):
            read(name, schema).collect()
    np.save(tmp_path / "none.npy", np.zeros(0))
    assert read("none.npy", "x double").count() == 0
    with pytest.raises(ValueError, match="Python can open"):
        archives.local_path("hdfs://host/x")
    assert archives.local_path("file:///a/b") == archives.local_path("file:/a/b") == "/a/b"
