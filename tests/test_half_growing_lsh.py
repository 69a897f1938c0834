"""Packed half-precision vectors, pools that grow by batches, hyperplane hashing."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiver.functions import half
from quiver.operators import index, ivf, knn, lsh
from quiver.plans import catalog
from quiver.session import scratch_path
from quiver.sources import growing, sinks
from tests.conftest import SF_SMALL
from tests.test_cells_tiles import P_SCHEMA, drawn, rows_of


# ---- half precision -----------------------------------------------------------------

def test_whole_buffers_round_trip():
    draw = np.random.default_rng(1)
    rows = [draw.normal(size=4).tolist(), None, [], [1e-8, 70000.0, -0.33333, 65504.0], None, [float("inf"), float("-inf"), 6.1e-5, 0.0]]
    for kind in (pa.float32(), pa.float64()):
        for lists in (pa.array(rows, pa.list_(kind)), pa.array([[9.0], *rows], pa.list_(kind)).slice(1)):
            packed = half.pack_lists(lists)
            with np.errstate(over="ignore"):
                want = [None if r is None else np.array(r, np.float32).astype(np.float16) for r in rows]
            assert packed.to_pylist() == [None if w is None else w.tobytes() for w in want]
            back = half.unpack_lists(packed).to_pylist()
            assert back == [None if w is None else w.astype(np.float32).tolist() for w in want]
            assert half.unpack_lists(packed.slice(2, 3)).to_pylist() == back[2:5]
    assert half.pack_lists(pa.array([], pa.list_(pa.float32()))).to_pylist() == []
    assert half.unpack_lists(pa.array([], pa.binary())).to_pylist() == []


def test_store_of_half_the_size(spark, tmp_path):
    draw = np.random.default_rng(2)
    X = draw.normal(size=(2000, 64)).astype(np.float32)
    df = spark.createDataFrame([(s, p, "i", i, X[i].tolist()) for i in range(1000) for s in ("query", "cand") for p in ("a", "b") if i % 2 == (p == "b")],
                               "side string, split string, modality string, id long, vector array<float>")
    sizes = {}
    for kind in (False, True):
        path = str(tmp_path / str(kind))
        sinks.write_embeddings(df.coalesce(1), path, half=kind)
        sizes[kind] = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
        for split in ("a", "b"):
            got = {r.id: r.vec for r in sinks.read_embeddings(spark, path, "cand", split).collect()}
            assert len(got) == 500
            for i, v in got.items():
                assert (np.array(v) == (X[i].astype(np.float16) if kind else X[i]).astype(np.float64)).all()
    assert 0.4 < sizes[True] / sizes[False] < 0.6
    stored = spark.read.parquet(str(tmp_path / "True"))
    assert half.is_packed(stored, "vector") and stored.schema["vector"].metadata == {"element": "float16", "dim": 64}


def test_ragged_and_broken_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        half.with_packed(df, "v")
    packed = half.with_packed(df.where("id = 1"), "v")
    assert packed.select(half.unpacked(packed, "v").alias("v")).first().v == [1.0, 2.0]
    broken = packed.select("id", F.expr("CAST(substring(v, 1, 2) AS BINARY)").alias("v", metadata=packed.schema["v"].metadata))
    with pytest.raises(Exception, match="4 bytes expected, found 2"):
        broken.select(half.unpacked(broken, "v")).collect()
    empty = half.with_packed(df.where("id = 3"), "v")
    assert empty.select(half.unpacked(empty, "v")).collect() == []


# ---- growing pool -------------------------------------------------------------------

def _vectors(spark, ids, c_mod="it", d=3):
    return spark.createDataFrame([(i, c_mod, [float(i), 1.0, 0.5][:d]) for i in ids], P_SCHEMA)


def test_appended_batches_equal_a_rebuild(spark):
    q, p = drawn(spark, 3, 10, 90)
    pool = growing.GrowingPool(spark, scratch_path(spark, "growing"))
    assert pool.version() == 0 and pool.read().count() == 0
    for part in range(3):
        assert pool.append(p.where(F.col("doc_id") % 3 == part)) == part + 1
    assert rows_of(knn.search_topk(q, pool.read(), 5)) == rows_of(knn.search_topk(q, p, 5))
    assert pool.read(1).count() == p.where("doc_id % 3 = 0").count()                      # earlier versions stay readable
    assert pool.append(p.where("false")) == 3 and len(pool.batches()) == 3


def test_known_ids_are_refused(spark):
    path = scratch_path(spark, "growing")
    pool = growing.GrowingPool(spark, path)
    pool.append(_vectors(spark, range(0, 100, 2)))
    pool.append(_vectors(spark, [4], "t"))                                                # another modality may have the id
    for batch, error in ((_vectors(spark, [101, 4]), growing.DuplicateIds), (_vectors(spark, [301, 301]), growing.DuplicateIds),
                         (_vectors(spark, [500], d=2), ValueError), (_vectors(spark, [600]).union(_vectors(spark, [601], d=2)), ValueError)):
        with pytest.raises(error):
            pool.append(batch)
    assert pool.version() == 2 and pool.read().count() == 51
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert len(files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches"))) == 2      # refused batches are gone
    assert pool.append(_vectors(spark, range(1, 100, 2))) == 3 and pool.read().count() == 101


def test_half_a_batch_is_never_seen(spark):
    path = scratch_path(spark, "growing")
    pool = growing.GrowingPool(spark, path)
    pool.append(_vectors(spark, [1]))
    _vectors(spark, [2, 3]).write.parquet(f"{path}/batches/unfinished")
    assert [r.doc_id for r in pool.read().collect()] == [1]


def test_two_writers_at_once(spark, monkeypatch):
    """Another commit between the check and the own one: checked again, then committed behind it or refused."""
    path = scratch_path(spark, "growing")
    pool, other = growing.GrowingPool(spark, path), growing.GrowingPool(spark, path)
    kept = growing.GrowingPool._commit

    def slower(meanwhile):
        def commit(self, version, batches):
            if self is pool and meanwhile:
                other.append(meanwhile.pop())
            return kept(self, version, batches)
        return commit
    monkeypatch.setattr(growing.GrowingPool, "_commit", slower([_vectors(spark, [7])]))
    assert pool.append(_vectors(spark, [5, 9])) == 2
    assert sorted(r.doc_id for r in pool.read().collect()) == [5, 7, 9]
    monkeypatch.setattr(growing.GrowingPool, "_commit", slower([_vectors(spark, [11])]))
    with pytest.raises(growing.DuplicateIds):
        pool.append(_vectors(spark, [10, 11]))
    assert sorted(r.doc_id for r in pool.read().collect()) == [5, 7, 9, 11]


# ---- hyperplane hashing ---------------------------------------------------------------

def test_hamming_and_bucket_distance(spark):
    draw = np.random.default_rng(4)
    planes, X, Q = draw.normal(size=(32, 5)), draw.normal(size=(40, 5)), draw.normal(size=(6, 5))
    codes = np.packbits(lsh.signs(X, planes), axis=1)
    assert (lsh.hamming(Q, planes, codes) == (lsh.signs(Q, planes)[:, None] != lsh.signs(X, planes)[None]).sum(-1)).all()
    p = spark.createDataFrame([(i, "it", x.tolist()) for i, x in enumerate(X)], P_SCHEMA)
    cells = lsh.HashCells(p, 32, 4)
    where = {r.doc_id: (r.tile, bytes(r.code)) for r in cells.pool.df.collect()}
    want = lsh.signs(X, cells.planes)
    assert all(where[i] == (int((want[i, :4] << np.arange(4)).sum()), np.packbits(want[i]).tobytes()) for i in range(40))
    far = cells.bounds(Q, "it", "ip", 0.0)
    sure = np.abs(Q @ cells.planes[:4].T)
    for j, tile in enumerate(cells.cells["it"]):
        differ = lsh.signs(Q, cells.planes[:4]) != (tile >> np.arange(4) & 1)
        assert np.allclose(far[:, j], (sure * differ).sum(1))


def test_hashed_shortlist_of_everything_is_exact(spark):
    q, p = drawn(spark, 5, 6, 60)
    built = index.Index(p, "LSH64")
    assert rows_of(built.search(q, 4, nprobe=9, shortlist=100)) == rows_of(knn.search_topk(q, p, 4))
    assert built.search(q, 30, nprobe=5, shortlist=30).groupBy("qid", "q_mod", "c_mod").count().where("count < 20").isEmpty()
    with pytest.raises(ValueError):
        built.search(q, 4, exact=True)
    with pytest.raises(ValueError):
        index.Index(p, "LSH12")


def test_recall_of_the_registered_hashing(spark):
    u = catalog._unit_views(spark, SF_SMALL, materialize=True)
    q, p = catalog._queries(u).where("qid % 50 = 0"), catalog._pool(u)
    found = ivf.recall_at_k(index.Index(p, "LSH").search(q, 10, catalog.LSH_PROBE), knn.search_topk(q, p, 10)).collect()
    assert len(found) == 9 and all(r.recall >= 0.9 for r in found)
