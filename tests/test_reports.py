"""Tables of one plan: what is shared is built once, what is kept is not built again, what is staged is deleted."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sievegrid.plans import reports as R
from sievegrid.session import shared_folder


class Counted:
    def __init__(self):
        self.built = []

    def step(self, name, needs, f, table=True, **settings):
        def build(*dfs):
            self.built.append(name)
            return f(*dfs)

        return R.Step(name, needs, build, table, settings)


def staged(spark):
    root = f"{shared_folder(spark)}/sievegrid/{spark.sparkContext.applicationId}".removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def steps_of(c, at=2, least=0):
    return [
        c.step("sums", ("rows",), lambda r: r.groupBy("k").agg(F.sum("v").alias("v")), table=False),
        c.step("alone", ("rows",), lambda r: r.select("k").distinct(), table=False),
        c.step("keys", ("alone",), lambda a: a),
        c.step("large", ("sums",), lambda s: s.where(F.col("v") >= at), at=at),
        c.step("small", ("sums", "other"), lambda s, o: s.join(o, "k").where(F.col("v") < 100), least=least),
        c.step("none", ("large",), lambda x: x.where("false")),
    ]


@pytest.fixture
def sources(spark):
    return {"rows": spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 9)], "k string, v long"), "other": spark.createDataFrame([("a",), ("b",)], "k string")}


DIGESTS = {"rows": "r1", "other": "o1"}


def test_shared_steps_are_staged_once_and_deleted(spark, sources):
    c, root, before = Counted(), tempfile.mkdtemp(), staged(spark)
    made = R.build_tables(spark, root, steps_of(c), sources, DIGESTS)
    assert made.shared == {"rows", "sums"} and made.reused == set()
    assert sorted(c.built) == sorted(["sums", "alone", "keys", "large", "small", "none"])
    assert {(r.k, r.v) for r in made.tables["large"].collect()} == {("a", 3), (None, 9)}
    assert {(r.k, r.v) for r in made.tables["small"].collect()} == {("a", 3), ("b", 1)}
    assert made.tables["none"].columns == ["k", "v"] and made.tables["none"].count() == 0
    assert staged(spark) == before
    told = {r["name"]: (r["rows"], r["columns"]) for r in R.manifest(spark, made).collect()}
    assert told == {"keys": (3, 1), "large": (2, 2), "small": (2, 2), "none": (0, 2)}


def test_a_change_reaches_what_depends_on_it(spark, sources):
    root = tempfile.mkdtemp()
    first = R.build_tables(spark, root, steps_of(Counted()), sources, DIGESTS)
    again = Counted()
    made = R.build_tables(spark, root, steps_of(again), sources, DIGESTS)
    assert again.built == [] and made.reused == {"keys", "large", "small", "none"} and made.digests == first.digests
    setting = Counted()
    made = R.build_tables(spark, root, steps_of(setting, at=5), sources, DIGESTS)
    assert sorted(setting.built) == ["large", "none", "sums"] and made.reused == {"keys", "small"}
    assert {(r.k, r.v) for r in made.tables["large"].collect()} == {(None, 9)}
    source = Counted()
    made = R.build_tables(spark, root, steps_of(source), sources, DIGESTS | {"other": "o2"})
    assert sorted(source.built) == ["small", "sums"] and made.reused == {"keys", "large", "none"}


def test_wanted_tables_only(spark, sources):
    c, root = Counted(), tempfile.mkdtemp()
    made = R.build_tables(spark, root, steps_of(c), sources, DIGESTS, ["none", "none"])
    assert list(made.tables) == ["none"] and sorted(c.built) == ["large", "none", "sums"] and made.shared == set()


def test_a_failed_build_leaves_whole_tables_and_no_staged_ones(spark, sources):
    c, root, before = Counted(), tempfile.mkdtemp(), staged(spark)

    def fails(*_):
        raise RuntimeError("broke off")

    steps = [*steps_of(c), R.Step("broken", ("sums", "large"), fails)]
    with pytest.raises(RuntimeError, match="broke off"):
        R.build_tables(spark, root, steps, sources, DIGESTS)
    assert staged(spark) == before
    again = Counted()
    made = R.build_tables(spark, root, [*steps_of(again), R.Step("broken", ("sums", "large"), lambda s, x: s.join(x.select("k"), "k"))], sources, DIGESTS)
    assert made.reused == {"keys", "large", "small", "none"} and again.built == ["sums"]


@pytest.mark.parametrize(
    ("steps", "message"),
    [
        ([R.Step("a", ("b",), lambda b: b), R.Step("b", ("a",), lambda a: a)], "needs itself"),
        ([R.Step("a", ("nowhere",), lambda x: x)], "unknown"),
        ([R.Step("a", ("rows",), lambda x: x), R.Step("a", ("rows",), lambda x: x)], "named twice"),
        ([R.Step("rows", ("other",), lambda x: x)], "named twice"),
    ],
)
def test_plans_that_cannot_be_built(spark, sources, steps, message):
    with pytest.raises(ValueError, match=message):
        R.build_tables(spark, tempfile.mkdtemp(), steps, sources, DIGESTS)


def test_sources_without_digest(spark, sources):
    with pytest.raises(ValueError, match="without digest"):
        R.build_tables(spark, tempfile.mkdtemp(), steps_of(Counted()), sources, {"rows": "r1"})


def test_long_cells(spark):
    df = spark.createDataFrame([("a", None, 1, True), (None, 2, None, False)], "k string, j long, m long, `b.c` boolean")
    got = {(r.entity, r.measure): r.value for r in R.long_cells("t", df, ["k", "j"]).collect()}
    assert got == {("a|-", "m"): 1.0, ("a|-", "b.c"): 1.0, ("-|2", "m"): None, ("-|2", "b.c"): 0.0}
