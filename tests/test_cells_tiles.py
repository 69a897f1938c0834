"""Tiles that meet in pairs, cells visited until their bounds allow no better answer, tiled contrastive scores."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quiver.operators import ivf, knn, pairs, tiles
from quiver.plans import catalog
from tests.conftest import SF_SMALL

KEY = ["qid", "q_mod", "c_mod", "doc_id", "score", "rank"]
Q_SCHEMA = "qid long, q_mod string, vec array<double>"
P_SCHEMA = "doc_id long, c_mod string, vec array<double>"


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


def drawn(spark, seed, n_q, n_p, d=8, unit=False, mods=("i", "t")):
    """Clustered vectors with zero vectors, exact copies and one far cluster; two modalities of different size."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d)) * 3
    P = centres[draw.integers(0, 6, n_p)] + 0.4 * draw.normal(size=(n_p, d))
    P[::17] = 0.0
    P[1::13] = P[1]
    Q = centres[draw.integers(0, 6, n_q)] + 0.6 * draw.normal(size=(n_q, d))
    Q[0] = 0.0
    if unit:
        P, Q = (X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-9) for X in (P, Q))
    q = spark.createDataFrame([(i, m, Q[(i + k) % n_q].tolist()) for i in range(n_q) for k, m in enumerate(mods)], Q_SCHEMA)
    p = spark.createDataFrame([(i, m, P[i].tolist()) for k, m in enumerate(mods) for i in range(n_p // (1 + 2 * k))], P_SCHEMA)
    return q, p


@pytest.fixture(params=[True, False], ids=["by path", "in groups"])
def ways(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(tiles, "readable", lambda spark: False)


def test_blocks_and_shards_meet(spark, ways):
    q, p = drawn(spark, 1, 30, 200)
    want = rows_of(knn.search_topk(q, p, 7, exclude_self=True))
    assert rows_of(knn.search_topk(q, p, 7, exclude_self=True, min_blocks=4)) == want
    small = knn.run_blocked(q, p, ["qid", "q_mod"], lambda b: knn._payload_by_mod(b, "qid", "q_mod", "vec"), knn._topk_kernel(7, "ip", True),
                            knn.HITS_SCHEMA, min_blocks=3, shard_bytes=1 << 20, block_bytes=1 << 20)
    assert small.select("qid", "q_mod", "c_mod").distinct().count() == 120


def test_every_pair_of_tiles_is_one_job():
    left, right = [(k, [f"l{i}"]) for i, k in enumerate((1, 1, 2, 3))], [(k, [f"r{i}"]) for i, k in enumerate((1, 1, 1, 2, 4))]
    for cores in (1, 8):
        met = sorted((a[0], files[0]) for a, run in tiles.jobs_of(left, right, cores) for files in run)
        assert met == sorted((f"l{i}", f"r{j}") for i, k in enumerate((1, 1, 2, 3)) for j, m in enumerate((1, 1, 1, 2, 4)) if k == m)
    assert tiles._together([("a", 3), ("b", 3), ("c", 9), ("d", 1)], 6) == [["a", "b"], ["c"], ["d"]]


def test_tiles_hold_every_row_once(spark):
    df = spark.range(1000).selectExpr("id", "CAST(id % 3 * id % 7 AS INT) AS tile")
    made = tiles.tiled(df, "t", 50, ["id"], "tile")
    seen = [(key, i) for key, files in made.tiles for i in tiles.read_tile(files)["id"]]
    assert sorted(seen) == sorted((r.tile, r.id) for r in df.collect())
    assert max(len(tiles.read_tile(files)) for _, files in made.tiles) <= 50
    assert tiles.tiled(df.where("false"), "t", 50, ["id"], "tile").tiles == []


@pytest.mark.parametrize("metric,unit,nprobe,tile_rows", [("ip", False, 1, 50_000), ("l2", True, 3, 20)])
def test_exact_cells_equal_exact_search(spark, metric, unit, nprobe, tile_rows):
    q, p = drawn(spark, 2, 25, 200, unit=unit)
    want = rows_of(knn.search_topk(q, p, 5, metric, exclude_self=True))
    assert rows_of(ivf.search_ivf(q, p, 5, 7, nprobe, metric, exclude_self=True, reach=1.0, max_group_rows=tile_rows)) == want


def test_cells_in_groups(spark, ways):
    q, p = drawn(spark, 3, 20, 150)
    assert rows_of(ivf.search_ivf(q, p, 6, 8, 2, reach=1.0, max_group_rows=15)) == rows_of(knn.search_topk(q, p, 6))


def test_few_probes_still_give_k_answers(spark):
    q, p = drawn(spark, 4, 15, 90)
    got = ivf.search_ivf(q, p, 40, 12, 1)
    n = {(r.qid, r.q_mod, r.c_mod): r["count"] for r in got.groupBy("qid", "q_mod", "c_mod").count().collect()}
    assert len(n) == 60 and {v for k, v in n.items() if k[2] == "i"} == {40} and {v for k, v in n.items() if k[2] == "t"} == {30}


def test_bounds_hold_and_prune(spark, monkeypatch):
    q, p = drawn(spark, 5, 30, 400)
    cells = ivf.Cells(p, ivf.train_cells(p, 8), 1000)
    P = {m: [(r.tile, np.array(r.vec)) for r in cells.pool.df.where(F.col("c_mod") == m).collect()] for m in cells.mods}
    Q = np.array([r.vec for r in q.collect()])
    for metric in ("ip", "l2"):
        for m in cells.mods:
            bound = cells.bounds(Q, m, metric, 1.0)
            for tile, x in P[m]:
                true = -(Q @ x) if metric == "ip" else np.square(Q - x).sum(1)
                assert (true >= bound[:, list(cells.cells[m]).index(tile)] - 1e-9).all()
    visits = []
    kept = tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda df, name, *a: (visits.append(df.count()) if name == "ivf-probes" else None, kept(df, name, *a))[1])
    assert rows_of(ivf.search_cells(q, cells, 3, 1, "l2", reach=1.0)) == rows_of(knn.search_topk(q, p, 3, "l2"))
    every = q.count() * sum(map(len, cells.cells.values()))
    assert len(visits) <= 4 and sum(visits) < 0.8 * every


def test_recall_of_the_registered_search(spark):
    u = catalog._unit_views(spark, SF_SMALL, materialize=True)
    q = catalog._queries(u).where("qid % 50 = 0")
    got = ivf.search_ivf(q, catalog._pool(u), 10, None, catalog.IVF_PROBE, reach=catalog.IVF_REACH)
    found = ivf.recall_at_k(got, knn.search_topk(q, catalog._pool(u), 10)).collect()
    assert len(found) == 9 and all(r.recall >= 0.9 for r in found)
    assert got.groupBy("qid", "q_mod", "c_mod").count().where("count <> 10").isEmpty()


def test_empty_sides(spark):
    q, p = drawn(spark, 6, 5, 20)
    assert rows_of(ivf.search_ivf(q.limit(0), p, 3, 4, 2, centroids=np.zeros((4, 8)))) == []
    assert rows_of(ivf.search_ivf(q, p.where("false"), 3, 4, 2, centroids=np.zeros((4, 8)))) == []
    assert rows_of(knn.search_topk(q.where("false"), p, 3, min_blocks=2)) == []


def sizes_kernel():
    def run(n_q, frames):                      # made here, so that workers needn't import this file
        n = [len(f) for f in frames]
        yield pd.DataFrame({"n_q": [n_q], "n_p": [sum(n)], "most_p": [max(n)]})
    return run, "n_q long, n_p long, most_p long"


def test_frames_of_a_tile(tmp_path):
    """All rows in order; a large file is cut, small ones are put together."""
    names, sizes, at = [], (50, 7, 0, 8, 1, 40), 0
    for i, n in enumerate(sizes):
        names.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(pa.table({"id": pa.array(range(at, at + n), pa.int64()), "vec": pa.array([[float(x)] * 3 for x in range(at, at + n)], pa.list_(pa.float64()))}), names[-1])
        at += n
    frames = list(tiles.read_frames(names, 20))
    assert [len(f) for f in frames] == [20, 20, 17, 9, 20, 20]
    assert [i for f in frames for i in f["id"]] == list(range(at)) and all((f["vec"].str[2] == f["id"]).all() for f in frames)
    assert list(tiles.read_frames([], 20)) == []


def test_tasks_hold_frames_of_blocks_and_shards(spark, monkeypatch):
    """Before, a task held a whole query block and a whole pool shard."""
    q, p = drawn(spark, 12, 60, 500)
    want = rows_of(knn.search_topk(q, p, 5))
    monkeypatch.setattr(knn, "FRAME_BYTES", 16 * (8 * 8 + 96))
    assert rows_of(knn.search_topk(q, p, 5, min_blocks=2)) == want
    sizes = knn.run_blocked(q, p, ["qid", "q_mod"], len, *sizes_kernel(), min_blocks=2).collect()
    assert max(r.n_q for r in sizes) <= 16 and max(r.most_p for r in sizes) <= 16
    assert sum(r.n_q * r.n_p for r in sizes) == q.count() * p.count()                       # every pair of rows meets once


def test_job_lists_need_no_python(spark):
    """Before, a list of jobs was a Python RDD, read by workers of their own."""
    q, p = drawn(spark, 13, 10, 30)
    met = tiles.meet(tiles.tiled(q, "q", 5, ["qid"]), tiles.tiled(p, "p", 20, ["doc_id"]), len, *sizes_kernel())
    dealt = tiles.deal(spark, [(files, "x") for _, files in tiles.tiled(p, "p", 20, ["doc_id"]).tiles], lambda f, word: [pd.DataFrame({"n": [len(f)]})], "n long")
    assert sum(r.n_q * r.n_p for r in met.collect()) == q.count() * p.count() and sum(r.n for r in dealt.collect()) == p.count()
    for found in (met, dealt):
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


# ---- contrastive ------------------------------------------------------------------------

def plain_contrast(Q, P, q_rows, p_rows, scale):
    """batch -> (n, loss, accuracy) from all scores of each group."""
    unit = [X / np.maximum(np.linalg.norm(X, axis=1, keepdims=True), 1e-6) for X in (Q, P)]
    out = {}
    for i, (batch, grp, pos, target) in enumerate(q_rows):
        mine = [(col, scale * unit[0][i] @ unit[1][j]) for j, (g, col) in enumerate(p_rows) if g == grp]
        s = np.array([x for _, x in mine])
        best = min(c for c, x in mine if round(x, 10) == max(round(y, 10) for y in s))
        own = dict(mine)[target]
        out.setdefault(batch, []).append((s.max() + np.log(np.exp(s - s.max()).sum()) - own, float(best == target)))
    return {b: (len(v), round(float(np.mean([x for x, _ in v])), 6), round(float(np.mean([y for _, y in v])), 6)) for b, v in out.items()}


@pytest.mark.parametrize("tile_rows", [7, 1 << 15])
def test_tiled_contrast_equals_plain(spark, ways, tile_rows):
    """Groups of one large step and many small ones, copies and zero vectors among the positives."""
    draw = np.random.default_rng(8)
    q_rows, p_rows = [], []
    for step, batches in ((0, 6), (1, 1), (2, 2)):
        for b in range(batches):
            q_rows += [(step * 10 + b, step, pos, b * 5 + pos) for pos in range(5)]
            p_rows += [(step, b * 5 + pos) for pos in range(5)]
    Q, P = draw.normal(size=(len(q_rows), 6)), draw.normal(size=(len(p_rows), 6))
    P[3], P[4], Q[7] = P[2], 0.0, 0.0
    q = spark.createDataFrame([(b, g, p, t - p, x.tolist()) for (b, g, p, t), x in zip(q_rows, Q)], "batch_id long, step_id long, pos int, off int, vec array<double>")
    p = spark.createDataFrame([(g, c, x.tolist()) for (g, c), x in zip(p_rows, P)], "step_id long, col long, vec array<double>")
    got = pairs.contrastive_eval(q, p, np.log(20.0), "step_id", F.col("off"), tile_rows)
    want = plain_contrast(Q, P, q_rows, p_rows, 20.0)
    assert {r.batch_id: (r.n, pytest.approx(r.loss, abs=2e-6), r.accuracy) for r in got.collect()} == want


def test_running_sums_stay_stable():
    """Scores far apart, merged tile by tile in any order."""
    draw = np.random.default_rng(9)
    s = draw.normal(size=(4, 60)) * 400
    target = np.array([3, 59, 0, 30])
    for order in (np.arange(60), np.arange(60)[::-1]):
        state = (np.full(4, -np.inf), np.zeros(4), np.full(4, -np.inf), np.full(4, -1, np.int64), np.full(4, np.nan))
        for cols in np.array_split(order, 7):
            state = pairs._online(state, s[:, cols], cols, target)
        top, rest, _, arg, own = state
        assert np.allclose(top + np.log(rest), s.max(1) + np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)))
        assert (arg == s.argmax(1)).all() and (own == s[np.arange(4), target]).all()
