"""Search and metrics: brute force on small fixtures, edge rows, properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import ivf, knn
from quiver.operators import metrics as M
from quiver.plans import evaluate as E

Q_SCHEMA = "qid long, q_mod string, vec array<double>"
P_SCHEMA = "doc_id long, c_mod string, vec array<double>"


def _unit(X):
    n = np.linalg.norm(X, axis=1, keepdims=True)
    return np.where(n > 0, X / np.where(n > 0, n, 1), X)


def _brute_topk(Q, qids, C, docs, k, exclude_self=False):
    out = {}
    S = np.round(Q @ C.T, 6)
    for i, q in enumerate(qids):
        cand = [(-S[i, j], docs[j]) for j in range(len(docs)) if not (exclude_self and docs[j] == q)]
        cand.sort()
        out[q] = [d for _, d in cand[:k]]
    return out


def _frames(spark, Q, qids, C, docs):
    qd = spark.createDataFrame([(int(i), "it", [float(x) for x in v]) for i, v in zip(qids, Q)], Q_SCHEMA)
    pd_ = spark.createDataFrame([(int(i), "it", [float(x) for x in v]) for i, v in zip(docs, C)], P_SCHEMA)
    return qd, pd_


@pytest.mark.parametrize("exclude_self,blocks", [(False, 1), (True, 3)])
def test_topk_equals_brute_force(spark, exclude_self, blocks):
    rng = np.random.default_rng(7)
    C = _unit(rng.normal(size=(120, 8)))
    docs = np.arange(120) * 3
    Q = C[::4]
    qids = docs[::4]
    qd, pdf = _frames(spark, Q, qids, C, docs)
    got = knn.search_topk(qd, pdf.repartition(5), 7, exclude_self=exclude_self, min_blocks=blocks)
    got_lists = {}
    for r in got.orderBy("qid", "rank").collect():
        got_lists.setdefault(r.qid, []).append(r.doc_id)
    assert got_lists == _brute_topk(Q, qids, C, docs, 7, exclude_self)


def test_k_above_pool_and_zero_vector(spark):
    qd = spark.createDataFrame([(1, "it", [0.0, 0.0]), (2, "it", [1.0, 0.0])], Q_SCHEMA)
    pdf = spark.createDataFrame([(30, "it", [0.0, 1.0]), (10, "it", [1.0, 0.0]), (20, "it", [0.6, 0.8])], P_SCHEMA)
    rows = knn.search_topk(qd, pdf, 10).orderBy("qid", "rank").collect()
    assert len(rows) == 6
    zero = [r for r in rows if r.qid == 1]
    assert [r.doc_id for r in zero] == [10, 20, 30] and all(r.score == 0.0 for r in zero)
    assert [r.doc_id for r in rows if r.qid == 2] == [10, 20, 30]


def test_l2_metric_orders_ascending(spark):
    qd = spark.createDataFrame([(1, "t", [1.0, 0.0])], Q_SCHEMA)
    pdf = spark.createDataFrame([(5, "t", [0.0, 1.0]), (6, "t", [1.0, 0.0]), (7, "t", [0.6, 0.8])], P_SCHEMA)
    rows = knn.search_topk(qd, pdf, 3, metric="l2").orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [6, 7, 5]
    assert rows[0].score == 0.0


def _ranked_fixture(spark, rank_of_relevant, pool_size):
    """One query whose relevant doc sits at a given rank of the full ordering."""
    scores = np.linspace(0.99, 0.01, pool_size)
    vecs = [[float(s), float(np.sqrt(1 - s * s))] for s in scores]
    qd = spark.createDataFrame([(1, "it", [1.0, 0.0])], Q_SCHEMA)
    pdf = spark.createDataFrame([(100 + i, "it", v) for i, v in enumerate(vecs)], P_SCHEMA)
    rel = spark.createDataFrame([("1", str(100 + rank_of_relevant - 1))], "qid string, doc_id string")
    return qd, pdf, rel


def test_mrr_rank_four_and_beyond_depth(spark):
    qd, pdf, rel = _ranked_fixture(spark, 4, 10)
    r = M.per_query(knn.first_relevant_rank(qd, pdf, rel), [1, 5]).collect()[0]
    assert r.first_rank == 4 and r.rr == 0.25 and r.hit_1 == 0 and r.hit_5 == 1
    qd, pdf, rel = _ranked_fixture(spark, 1001, 1005)
    r = M.per_query(knn.first_relevant_rank(qd, pdf, rel), [1, 100]).collect()[0]
    assert r.first_rank == 1001 and r.rr == 0.0


def test_hit_rate_not_recall(spark):
    """Three relevant docs, one in the top five: Recall@5 is 1, not 1/3."""
    qd, pdf, _ = _ranked_fixture(spark, 1, 20)
    rel = spark.createDataFrame([("1", "102"), ("1", "115"), ("1", "118")], "qid string, doc_id string")
    r = M.per_query(knn.first_relevant_rank(qd, pdf, rel), [5]).collect()[0]
    assert r.hit_5 == 1 and r.first_rank == 3


def test_unjudged_query_counts_in_mean(spark):
    qd = spark.createDataFrame([(1, "it", [1.0, 0.0]), (2, "it", [0.0, 1.0])], Q_SCHEMA)
    pdf = spark.createDataFrame([(1, "it", [1.0, 0.0]), (2, "it", [0.0, 1.0])], P_SCHEMA)
    rel = spark.createDataFrame([("1", "1")], "qid string, doc_id string")
    per_q = M.per_query(knn.first_relevant_rank(qd, pdf, rel), [1])
    rep = M.report(per_q, None, [1], "d", "test", "p").collect()[0]
    assert rep.n == 2 and rep.hits_1 == 1 and rep.mrr == 0.5


def test_relevance_by_key_equals_explicit_judgments(spark):
    rng = np.random.default_rng(3)
    C = _unit(rng.normal(size=(60, 6)))
    labels = rng.integers(0, 4, 60)
    rows = [(i, "it", [float(x) for x in C[i]], int(labels[i])) for i in range(60)]
    qd = spark.createDataFrame(rows, Q_SCHEMA + ", rel_key int")
    pdf = spark.createDataFrame(rows, P_SCHEMA + ", rel_key int")
    by_key = knn.first_relevant_rank(qd, pdf, None, exclude_self=True)
    pairs = [(str(i), str(j)) for i in range(60) for j in range(60) if i != j and labels[i] == labels[j]]
    jd = spark.createDataFrame(pairs, "qid string, doc_id string")
    explicit = knn.first_relevant_rank(qd, pdf, jd, exclude_self=True)
    a = {r.qid: r.first_rank for r in by_key.collect()}
    b = {r.qid: r.first_rank for r in explicit.collect()}
    assert a == b
    # brute force
    S = np.round(C @ C.T, 6)
    for i in range(60):
        order = sorted((-S[i, j], j) for j in range(60) if j != i)
        ranks = [n + 1 for n, (_, j) in enumerate(order) if labels[j] == labels[i]]
        assert a[i] == (ranks[0] if ranks else None)


def test_metric_properties(spark):
    """hit@k is non-decreasing in k; MRR lies between hit@1 and 1; repartitioning changes nothing."""
    rng = np.random.default_rng(11)
    C = _unit(rng.normal(size=(80, 5)))
    labels = rng.integers(0, 5, 80)
    rows = [(i, "it", [float(x) for x in C[i]], int(labels[i])) for i in range(80)]
    qd = spark.createDataFrame(rows, Q_SCHEMA + ", rel_key int")
    pdf = spark.createDataFrame(rows, P_SCHEMA + ", rel_key int")
    ks = [1, 5, 10, 50]
    g1 = M.grid_summary(M.per_query(knn.first_relevant_rank(qd, pdf, None, exclude_self=True), ks), ks).collect()[0]
    hits = [g1[f"hits_{k}"] for k in ks]
    assert hits == sorted(hits)
    assert g1.hits_1 / g1.n <= g1.mrr <= 1.0
    g2 = M.grid_summary(M.per_query(knn.first_relevant_rank(
        qd.repartition(3), pdf.repartition(7).orderBy(F.rand(1)), None, exclude_self=True), ks), ks).collect()[0]
    assert g1 == g2


def test_metric_list_and_wide_columns(spark):
    cfg = spark.createDataFrame([("Recall@10, MRR, recall@5, NDCG@3, Recall@1",)], "metrics string")
    spec = [(r.metric, r.k) for r in M.metric_spec(cfg).collect()]
    assert spec == [("Recall@10", 10), ("recall@5", 5), ("Recall@1", 1)]
    assert M.search_depth([k for _, k in spec]) == 1000
    assert M.search_depth([5, 2000]) == 2000
    cols = M.report_columns([("Recall@10", 10), ("Recall@1", 1), ("recall@3", 3)])
    assert cols[7:] == ["Recall@1", "Recall@10", "MRR", "recall@3"]


def test_duplicate_pool_ids_refused(spark):
    views = spark.createDataFrame([(1, "it", [1.0, 0.0]), (1, "it", [0.0, 1.0]), (2, "it", [1.0, 1.0])],
                                  "id long, modality string, vec array<double>")
    assert E.duplicate_ids(views.withColumnRenamed("id", "doc_id")).collect()[0]["count"] == 2
    with pytest.raises(E.DuplicatePoolIds):
        E.build_pool(views)


def test_ivf_recall_and_salting(spark):
    rng = np.random.default_rng(5)
    centers = _unit(rng.normal(size=(8, 16)))
    X = _unit(np.repeat(centers, 40, axis=0) + 0.15 * rng.normal(size=(320, 16)))
    docs = np.arange(320)
    qd, pdf = _frames(spark, X[::5], docs[::5], X, docs)
    exact = knn.search_topk(qd, pdf, 10)
    approx = ivf.search_ivf(qd, pdf, 10, n_cells=8, nprobe=3, seed=2)
    rec = ivf.recall_at_k(approx, exact).collect()[0].recall
    assert rec >= 0.9
    # full probe with tiny groups (every cell salted on both sides) equals the exact search
    full = ivf.search_ivf(qd, pdf, 10, n_cells=8, nprobe=8, seed=2, max_group_rows=7)
    key = ["qid", "q_mod", "c_mod", "doc_id", "score", "rank"]
    assert sorted(map(tuple, full.select(*key).collect())) == sorted(map(tuple, exact.select(*key).collect()))


def test_tiled_path_equals_broadcast_path(spark):
    """Several query blocks (co-group on block x shard, nothing on the driver) = one broadcast block."""
    rng = np.random.default_rng(13)
    C = _unit(rng.normal(size=(90, 6)))
    labels = rng.integers(0, 3, 90)
    rows = [(i, m, [float(x) for x in (C[i] if m == "it" else C[(i + 1) % 90])], int(labels[i]))
            for i in range(90) for m in ("i", "it")]
    qd = spark.createDataFrame(rows, Q_SCHEMA + ", rel_key int")
    pdf = spark.createDataFrame(rows, P_SCHEMA + ", rel_key int")
    jd = spark.createDataFrame([(str(i), str((i * 7) % 90)) for i in range(90)], "qid string, doc_id string")
    for judg in (None, jd):
        a = knn.first_relevant_rank(qd, pdf, judg, exclude_self=judg is None)
        b = knn.first_relevant_rank(qd, pdf, judg, exclude_self=judg is None, min_blocks=3)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    t1 = knn.search_topk(qd, pdf, 4)
    t3 = knn.search_topk(qd, pdf, 4, min_blocks=3)
    assert sorted(map(tuple, t1.collect())) == sorted(map(tuple, t3.collect()))


def test_first_rank_l2_metric_brute_force(spark):
    rng = np.random.default_rng(17)
    C = rng.normal(size=(50, 4))
    labels = rng.integers(0, 3, 50)
    rows = [(i, "t", [float(x) for x in C[i]], int(labels[i])) for i in range(50)]
    qd = spark.createDataFrame(rows, Q_SCHEMA + ", rel_key int")
    pdf = spark.createDataFrame(rows, P_SCHEMA + ", rel_key int")
    got = {r.qid: r.first_rank for r in knn.first_relevant_rank(qd, pdf, None, metric="l2", exclude_self=True).collect()}
    D = np.round(((C[:, None, :] - C[None, :, :]) ** 2).sum(-1), 6)
    for i in range(50):
        order = sorted((D[i, j], j) for j in range(50) if j != i)
        ranks = [n + 1 for n, (_, j) in enumerate(order) if labels[j] == labels[i]]
        assert got[i] == (ranks[0] if ranks else None)


def test_permutation_invariance_property(spark):
    """Shuffling the pool's row order and partitioning changes no hit list (hypothesis)."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    rng = np.random.default_rng(21)
    C = _unit(rng.normal(size=(40, 5)))
    docs = np.arange(40)
    qd, pdf = _frames(spark, C[:6], docs[:6], C, docs)
    base = sorted(map(tuple, knn.search_topk(qd, pdf, 5).collect()))

    @settings(max_examples=3, deadline=None)
    @given(st.permutations(list(range(40))), st.integers(1, 6))
    def check(perm, parts):
        _, p2 = _frames(spark, C[:6], docs[:6], C[perm], docs[perm])
        got = sorted(map(tuple, knn.search_topk(qd, p2.repartition(parts), 5).collect()))
        assert got == base

    check()


def test_empty_sides(spark):
    qd = spark.createDataFrame([(1, "it", [1.0, 0.0])], Q_SCHEMA)
    pdf = spark.createDataFrame([(2, "it", [1.0, 0.0])], P_SCHEMA)
    empty_q = qd.limit(0)
    empty_p = pdf.limit(0)
    assert knn.search_topk(empty_q, pdf, 3).count() == 0
    assert knn.search_topk(qd, empty_p, 3).count() == 0
    no_judg = spark.createDataFrame([], "qid string, doc_id string")
    r = knn.first_relevant_rank(qd, pdf, no_judg).collect()
    assert [(x.c_mod, x.first_rank) for x in r] == [("it", None)]
    assert knn.first_relevant_rank(qd, empty_p, no_judg).count() == 0


def test_dimension_checks(spark):
    import warnings
    ok = spark.createDataFrame([(1, "it", [1.0, 0.0])], P_SCHEMA)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert E.check_dim(ok, configured=768) == 2
        assert any("dimension mismatch" in str(x.message) for x in w)
    ragged = spark.createDataFrame([(1, "it", [1.0, 0.0]), (2, "it", [1.0])], P_SCHEMA)
    with pytest.raises(ValueError):
        E.check_dim(ragged)


def test_pool_broadcast_path(spark):
    """Query side over the budget, pool within it: the pool is broadcast; results equal brute force."""
    rng = np.random.default_rng(23)
    C = _unit(rng.normal(size=(30, 4)))
    Q = _unit(rng.normal(size=(200, 4)))
    qd, _ = _frames(spark, Q, np.arange(200), C, np.arange(30))
    _, pdf = _frames(spark, Q[:1], np.arange(1), C, np.arange(30))
    budget = 30 * (8 * 4 + 96) + 10          # fits the pool (30 rows), not the queries (200 rows)
    got = knn.search_topk(qd, pdf, 5, block_bytes=budget)
    got_lists = {}
    for r in got.orderBy("qid", "rank").collect():
        got_lists.setdefault(r.qid, []).append(r.doc_id)
    assert got_lists == _brute_topk(Q, np.arange(200), C, np.arange(30), 5)
    labels = rng.integers(0, 3, 200)
    rows_q = [(i, "it", [float(x) for x in Q[i]], int(labels[i])) for i in range(200)]
    rows_p = [(i, "it", [float(x) for x in C[i]], int(i % 3)) for i in range(30)]
    qk = spark.createDataFrame(rows_q, Q_SCHEMA + ", rel_key int")
    pk = spark.createDataFrame(rows_p, P_SCHEMA + ", rel_key int")
    a = knn.first_relevant_rank(qk, pk, None, block_bytes=budget)
    b = knn.first_relevant_rank(qk, pk, None)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("metric,exclude_self", [("ip", False), ("ip", True), ("l2", False)])
def test_deep_topk_with_ties_across_batches(spark, metric, exclude_self):
    """Many exact ties, k larger than an Arrow batch, several batches merged per task."""
    rng = np.random.default_rng(29)
    base = _unit(rng.normal(size=(6, 3)))
    C = base[rng.integers(0, 6, 70)]                 # 70 candidates, only 6 distinct vectors
    docs = rng.permutation(1000)[:70].astype(np.int64)
    Q = np.vstack([C[:5], np.zeros((1, 3))])
    qids = np.concatenate([docs[:5], [5000]])
    qd, pdf = _frames(spark, Q, qids, C, docs)
    prev = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = knn.search_topk(qd, pdf.repartition(3), 25, metric=metric, exclude_self=exclude_self)
        rows = got.orderBy("qid", "rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", prev)
    got_lists = {}
    for r in rows:
        got_lists.setdefault(r.qid, []).append(r.doc_id)
    if metric == "ip":
        S = -np.round(Q @ C.T, 6)
    else:
        S = np.round(((Q[:, None, :] - C[None, :, :]) ** 2).sum(-1), 6)
    for i, q in enumerate(qids):
        cand = sorted((S[i, j], docs[j]) for j in range(70) if not (exclude_self and docs[j] == q))
        assert got_lists[q] == [d for _, d in cand[:25]], (q, metric)


def test_what_a_search_finds_is_not_broadcast(spark, monkeypatch):
    """Before, thresholds, counts and hits were planned as broadcasts, since they came from a short list of jobs."""
    from quiver.operators import lookup, project
    rng = np.random.default_rng(21)
    units = spark.createDataFrame([(i, m, rng.normal(size=6).tolist(), i % 4) for i in range(80) for m in ("i", "t")],
                                  "id long, modality string, vec array<double>, rel_key int")
    q = units.select(F.col("id").alias("qid"), F.col("modality").alias("q_mod"), "vec", "rel_key")
    p = units.select(F.col("id").alias("doc_id"), F.col("modality").alias("c_mod"), "vec", "rel_key")
    plans, written = [], knn.materialize

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    monkeypatch.setattr(knn, "materialize", lambda df: written(planned(df)))
    ranks = planned(knn.first_relevant_rank(q, p, None, exclude_self=True, min_blocks=2))
    hits = knn.search_topk(q, p, 5, min_blocks=2)
    vectors = units.select("id", F.col("modality").alias("c_mod"), "vec")
    found, missing = (planned(x) for x in lookup.hit_vectors(hits, vectors))
    points = planned(project.neighborhood_pca(hits, q.select("qid", "q_mod", "vec"), vectors))
    assert len(plans) == 5 and all("Join" in x and "BroadcastExchange" not in x for x in plans)
    want = knn.first_relevant_rank(q, p, None, exclude_self=True)
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, want.collect()))
    assert (found.count(), missing.count(), points.count()) == (160 * 2 * 5, 0, 160 * 2 * 6)
