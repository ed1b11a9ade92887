"""Block-sparse matrices and aligned namespaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import namespaces as N
from sievegrid.session import new_path
from sievegrid.sources import sparse

CELLS = "row long, idx int, val double"


def random_matrix(rows, width, seed=0, share=0.3):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(rows, width)) * 4) / 4 * (rng.random((rows, width)) < share)


def cells_of(spark, dense):
    return spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], CELLS)


def dense_of(cells, shape):
    out = np.zeros(shape)
    for r in cells.collect():
        assert out[r.row, r.idx] == 0
        out[r.row, r.idx] = r.val
    return out


@pytest.mark.parametrize("half", [False, True])
def test_matrices_come_back_as_they_were(spark, half):
    dense = random_matrix(53, 17)
    dense[[0, 20, 52]] = 0
    path = new_path(spark, "matrix")
    sparse.save_csr(cells_of(spark, dense), path, 53, half, 10)
    blocks = sparse.load_blocks(spark, path)
    assert {r.block: len(r.counts) for r in blocks.collect()} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 3}
    assert (dense_of(sparse.load_csr(blocks, 10), dense.shape) == dense).all()
    size = sum(len(r.data) for r in blocks.collect())
    assert size == np.count_nonzero(dense) * (2 if half else 4)
    assert all((np.array(r.gaps) >= 0).all() for r in blocks.collect())


def test_wanted_blocks_are_filtered_in_the_scan(spark):
    path = new_path(spark, "matrix")
    sparse.save_csr(cells_of(spark, random_matrix(40, 3)), path, 40, False, 10)
    plan = sparse.load_blocks(spark, path).where("block = 2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(block), EqualTo(block,2)]" in plan


def test_rows_are_gathered_by_position(spark):
    dense = random_matrix(53, 9, 1)
    path = new_path(spark, "matrix")
    sparse.save_csr(cells_of(spark, dense), path, 53, False, 10)
    order = [52, 0, 7, 7, 31, 20] + [3] * 40
    wanted = spark.createDataFrame(list(enumerate(order)), "position long, row long")
    got = {r.position: r for r in sparse.gather(sparse.load_blocks(spark, path), wanted, 10).collect()}
    assert sorted(got) == list(range(len(order)))
    for position, row in enumerate(order):
        back = np.zeros(9)
        back[got[position].idx] = got[position].val
        assert got[position].row == row and (back == dense[row]).all()
    for outside in (53, 60, -1):
        with pytest.raises(Exception, match="outside the matrix"):
            sparse.gather(sparse.load_blocks(spark, path), spark.createDataFrame([(0, outside)], "position long, row long"), 10).collect()


def test_binary_rows_are_dense_bytes(spark):
    path = new_path(spark, "matrix")
    sparse.save_csr(cells_of(spark, np.array([[1, 0], [0, 1], [1, 1]])), path, 3)
    wanted = spark.createDataFrame([(0, 2), (1, 0)], "position long, row long")
    got = {r.position: list(r.features) for r in sparse.binary_rows(sparse.load_blocks(spark, path), wanted, 2).collect()}
    assert got == {0: [1, 1], 1: [1, 0]}


def test_products_are_those_of_the_dense_matrix(spark, monkeypatch):
    dense, weights = random_matrix(35, 8, 2), np.random.default_rng(3).normal(size=(8, 3))
    path = new_path(spark, "matrix")
    sparse.save_csr(cells_of(spark, dense), path, 35, False, 8)
    got = {r.row: r.products for r in sparse.products(sparse.load_blocks(spark, path), weights, 8).collect()}
    assert sorted(got) == list(range(35)) and np.allclose([got[i] for i in range(35)], dense @ weights)
    monkeypatch.setattr(sparse, "DENSE_BYTES", 10)
    with pytest.raises(ValueError, match="dense side"):
        sparse.products(sparse.load_blocks(spark, path), weights)


def test_odd_matrices(spark):
    path = new_path(spark, "matrix")
    sparse.save_csr(spark.createDataFrame([], CELLS), path, 0)
    assert sparse.load_blocks(spark, path).count() == 0
    sparse.save_csr(spark.createDataFrame([], CELLS), path, 5)
    blocks = sparse.load_blocks(spark, path)
    assert sparse.load_csr(blocks).count() == 0 and list(blocks.first().counts) == [0] * 5
    for bad in ([(0, 1, 1.0), (0, 1, 2.0)], [(5, 0, 1.0)]):
        with pytest.raises(Exception, match="twice|outside"):
            sparse.save_csr(spark.createDataFrame(bad, CELLS), path, 5)
    logged = sparse.signed_log(spark.createDataFrame([(0, 0, -2.0), (0, 1, 3.0)], CELLS)).collect()
    assert np.allclose([r.val for r in logged], [-np.log1p(2), np.log1p(3)])


def sha(i):
    return f"{i:064x}"


SPLITS = {"test": [13, 14, 15, 16], "train": [10, 11, 12]}


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Three kinds in their shards: CSR with a file of hashes, CSR with another name for them, dense with hashes inside."""
    base, rng, written = tmp_path_factory.mktemp("shards"), np.random.default_rng(3), {"static": {}, "graph": {}, "report": {}}
    for split, members in SPLITS.items():
        folder = base / "2013"
        folder.mkdir(exist_ok=True)
        names = np.array([sha(i).upper() for i in members])
        values = {"static": (rng.random((len(members), 5)) < 0.5).astype(np.float32), "graph": (rng.random((len(members), 4)) * 4).astype(np.float32), "report": (np.round(rng.normal(size=(len(members), 6)) * 5) * (rng.random((len(members), 6)) < 0.7)).astype(np.float32)}
        for kind, x in values.items():
            written[kind] |= dict(zip(members, x, strict=True))
            if kind == "graph":
                np.savez(folder / f"graph_{split}.npz", X=x, y=np.zeros(len(members)), hash=names.astype(object))
                continue
            row, idx = np.nonzero(x)
            np.savez(folder / f"{kind}_{split}_X.npz", data=x[row, idx], indices=idx, indptr=np.searchsorted(row, np.arange(len(x) + 1)), shape=x.shape)
            np.savez(folder / f"{kind}_{split}_meta.npz", y=np.zeros(len(members)), **{"hash" if kind == "static" else "hashes": names})
    return base, written


@pytest.fixture(scope="module")
def kinds(spark, archives):
    base, _ = archives
    out = {k: N.read_archives(spark, N.shard_files(spark, f"{base}/*/{k}_*_X.npz"), metas=N.shard_files(spark, f"{base}/*/{k}_*_meta.npz")) for k in ("static", "report")}
    return out | {"graph": N.read_archives(spark, N.shard_files(spark, f"{base}/*/graph_*.npz"), pickled=True)}


def test_shards_are_found_in_order_and_none_is_an_error(spark, archives):
    base, _ = archives
    assert [p.rpartition("/")[2] for p in N.shard_files(spark, f"{base}/*/graph_*.npz")] == ["graph_test.npz", "graph_train.npz"]
    with pytest.raises(FileNotFoundError):
        N.shard_files(spark, f"{base}/*/nothing_*.npz")


def test_archives_keep_the_order_of_shards_and_their_values(kinds, archives):
    for kind, rows in kinds.items():
        got = rows.orderBy("place").collect()
        assert [r.sha256 for r in got] == [sha(i) for s in ("test", "train") for i in SPLITS[s]]
        for r in got:
            want = archives[1][kind][int(r.sha256, 16)]
            back = np.zeros_like(want)
            back[r.idx] = r.val
            assert (back == want).all()


def test_objects_are_not_unpickled_unasked(spark, archives):
    with pytest.raises(Exception, match="allow_pickle"):
        N.read_archives(spark, N.shard_files(spark, f"{archives[0]}/*/graph_*.npz")).collect()


def test_a_namespace_aligns_every_kind_to_one_order(spark, kinds, archives):
    samples = [(sha(i), 100 + 7 * i, i % 2) for i in (16, 9, 12, 10, 14, 20, 15)] + [(None, 5, 0)]
    assignments = spark.createDataFrame(samples, "sha256 string, row long, label long")
    doubled = kinds | {"graph": kinds["graph"].unionByName(kinds["graph"].where(F.col("sha256") == sha(14)).withColumn("place", F.lit(1 << 60)).withColumn("val", F.transform("val", lambda v: v + 1)))}
    doubled["report"] = doubled["report"].where(F.col("sha256") != sha(15))
    path = new_path(spark, "namespace")
    told = N.build_namespace(assignments, doubled, path, frozenset({"report"}), frozenset({"report"}), 2)
    assert told == {"samples": 7, "rows": 4, "malware_rows": 0, "benign_rows": 4, "static_missing": 2, "static_repeated": 0, "report_missing": 3, "report_repeated": 0, "graph_missing": 2, "graph_repeated": 1}
    kept = spark.read.parquet(f"{path}/samples")
    order = [r.sha256 for r in kept.orderBy("row").collect()]
    assert order == [sha(i) for i in (10, 12, 14, 16)]
    assert {r.name: r.passed for r in N.check_namespace(spark, path, list(doubled)).collect()} == dict.fromkeys(["unique_keys", "numbers", "static_rows", "report_rows", "graph_rows"], True)
    asked = spark.createDataFrame([(0, sha(14)), (1, sha(10))], "position long, sha256 string")
    for kind in doubled:
        blocks = sparse.load_blocks(spark, f"{path}/{kind}")
        for r in N.aligned_rows(blocks, kept, asked, 2).collect():
            want = archives[1][kind][(14, 10)[r.position]].astype(float)
            back = np.zeros_like(want)
            back[r.idx] = r.val
            assert np.allclose(back, np.sign(want) * np.log1p(np.abs(want)) if kind == "report" else want, atol=2e-3 if kind == "report" else 0)
    with pytest.raises(Exception, match="no aligned row"):
        N.aligned_rows(blocks, kept, spark.createDataFrame([(0, sha(99))], "position long, sha256 string"), 2).collect()


def test_a_damaged_namespace_fails_its_checks(spark, kinds):
    assignments = spark.createDataFrame([(sha(i), i, 0) for i in range(10, 17)], "sha256 string, row long, label long")
    path = new_path(spark, "namespace")
    N.build_namespace(assignments, kinds, path)
    sparse.save_csr(spark.createDataFrame([], CELLS), f"{path}/graph", 3)
    assert [r.name for r in N.check_namespace(spark, path, list(kinds)).where("not passed").collect()] == ["graph_rows"]


def test_no_common_sample_is_an_error(spark, kinds):
    with pytest.raises(ValueError, match="no sample"):
        N.build_namespace(spark.createDataFrame([("x", 1, 0)], "sha256 string, row long, label long"), kinds, new_path(spark, "none"))


def test_gathered_rows_come_in_arrow_lots_and_repeat_as_often_as_asked(spark):
    from sievegrid.session import new_path
    from sievegrid.sources import sparse

    cells = [(r, i, float(r + i)) for r in range(30) for i in range(r % 4)]
    path = new_path(spark, "lots")
    sparse.save_csr(spark.createDataFrame(cells, "row long, idx int, val double"), path, 30, rows_per_block=8)
    asked = [(f"p{k}", k % 30 if k % 2 else 5) for k in range(200)] + [(None, 7)]
    got = sparse.gather(sparse.load_blocks(spark, path), spark.createDataFrame(asked, "position string, row long"), 8)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # no Python object a row asked for
    found = sorted((str(r.position), r.row, list(r.idx), list(r.val)) for r in got.collect())
    assert found == sorted((str(p), r, list(range(r % 4)), [float(r + i) for i in range(r % 4)]) for p, r in asked)
