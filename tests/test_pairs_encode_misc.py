"""Pairs and contrastive evaluation, encoders, projection, streaming."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from quiver.operators import encode, knn, pairs, project
from quiver.session import checkpoint_dir
from quiver.streaming import search as stream_search


def test_contrastive_matches_numpy(spark):
    rng = np.random.default_rng(1)
    bs, d, scale = 6, 5, 10.0
    Q, P = rng.normal(size=(bs, d)), rng.normal(size=(bs, d))
    q = spark.createDataFrame([(0, i, [float(x) for x in Q[i]]) for i in range(bs)], "batch_id long, pos int, vec array<double>")
    p = spark.createDataFrame([(0, i, [float(x) for x in P[i]]) for i in range(bs)], "batch_id long, col int, vec array<double>")
    got = pairs.contrastive_eval(q, p, np.log(scale)).collect()[0]
    qn = Q / np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), 1e-6)
    pn = P / np.maximum(np.linalg.norm(P, axis=1, keepdims=True), 1e-6)
    S = scale * qn @ pn.T
    m = S.max(1)
    loss = np.mean(m + np.log(np.exp(S - m[:, None]).sum(1)) - np.diag(S))
    acc = np.mean(S.argmax(1) == np.arange(bs))
    assert abs(got.loss - round(loss, 6)) < 1e-9 and abs(got.accuracy - round(acc, 6)) < 1e-9 and got.n == bs


def test_argmax_accuracy_reductions(spark):
    df = spark.createDataFrame([([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0.7, 0.2], 1)], "logits array<double>, label int")
    assert [r.correct for r in pairs.argmax_accuracy(df, "logits", "label", "none").collect()] == [1.0, 1.0, 0.0]
    m = pairs.argmax_accuracy(df, "logits", "label", "mean").collect()[0]
    assert m.n == 3 and m.n_correct == 2
    assert pairs.argmax_accuracy(df, "logits", "label", "sum") is None


def test_epoch_batches_deterministic_and_complete(spark):
    ids = spark.range(0, 203).withColumnRenamed("id", "vid")
    a = pairs.epoch_batches(ids, "vid", 16, seed=3, epoch=0, buckets=4)
    b = pairs.epoch_batches(ids.repartition(5), "vid", 16, seed=3, epoch=0, buckets=4)
    ra = sorted(map(tuple, a.collect()))
    assert ra == sorted(map(tuple, b.collect()))
    assert len({r[0] for r in ra}) == 203
    sizes = {r["batch_id"]: r["count"] for r in a.groupBy("batch_id").count().collect()}
    assert sizes == {i: 16 for i in range(12)} | {12: 11}             # one short batch, the last
    assert ra == sorted(map(tuple, pairs.epoch_batches(ids, "vid", 16, seed=3, epoch=0, buckets=64).collect()))
    c = pairs.epoch_batches(ids, "vid", 16, seed=3, epoch=1, buckets=4)
    assert sorted(map(tuple, c.collect())) != ra


def test_hashing_encoder_whole_text(spark):
    enc = encode.HashingEncoder(dim=8)
    v = enc.encode_text("a b a")
    assert np.abs(v).sum() in (1, 3)
    assert not enc.encode_text("").any() and not enc.encode_text(" \t\n ").any()
    assert np.array_equal(enc.encode_text("  a b a "), v)
    long_text = " ".join(["w%d" % i for i in range(50_000)])
    assert np.abs(enc.encode_text(long_text)).sum() > 0
    df = spark.createDataFrame([(1, "x y"), (2, None), (3, "")], "id long, t string")
    out = {r.id: r.vec for r in encode.encode_batch(df, "t").collect()}
    assert len(out[1]) == encode.HASH_DIM and out[2] == [0.0] * encode.HASH_DIM == out[3]


def test_encoder_hook_is_checked_first(spark):
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    import pytest
    with pytest.raises(ValueError):
        encode.encode_batch(df, "t", make_encoder=lambda: (lambda xs: np.zeros((1, 3))))
    with pytest.raises(TypeError):
        encode.encode_batch(df, "t", make_encoder=lambda: None)
    assert encode.check_encoder(encode.hashing_encoder(dim=5), "") == 5


def test_mlp_and_fp16_match_numpy(spark):
    rng = np.random.default_rng(2)
    d = 4
    T_, I_ = rng.normal(size=(3, d)), rng.normal(size=(3, d))
    df = spark.createDataFrame([([float(x) for x in T_[i]], [float(x) for x in I_[i]]) for i in range(3)],
                               "t array<double>, i array<double>")
    w = encode.rule_mlp_weights(d)
    got = np.array([r.v for r in df.select(encode.fuse_mlp(F.col("t"), F.col("i"), w).alias("v")).collect()])
    x = np.hstack([T_, I_])
    want = np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    assert np.allclose(got, want, atol=1e-12)
    f = spark.createDataFrame([([0.1, 1e-6, 70000.0, -0.33333],)], "v array<float>")
    got16 = f.select(encode.quantize_fp16(F.col("v")).alias("q")).collect()[0].q
    want16 = np.array([0.1, 1e-6, 70000.0, -0.33333], np.float32).astype(np.float16).astype(np.float32)
    assert np.array_equal(np.array(got16, np.float32), want16)


def test_pca_distances_and_sign(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(6, 10))
    xy = project.pca_2d(X)
    Xc = X - X.mean(0)
    _, _, Vt = np.linalg.svd(Xc, full_matrices=False)
    ref = Xc @ Vt[:2].T
    assert np.allclose(np.abs(xy), np.abs(ref))
    for j in range(2):
        assert xy[np.argmax(np.abs(xy[:, j])), j] > 0
    assert np.allclose(project.pca_2d(X[:1]), 0)


def test_stream_equals_batch(spark):
    rng = np.random.default_rng(9)
    C = rng.normal(size=(40, 4))
    C /= np.linalg.norm(C, axis=1, keepdims=True)
    pool = spark.createDataFrame([(i, "it", [float(x) for x in C[i]]) for i in range(40)],
                                 "doc_id long, c_mod string, vec array<double>")
    queries = spark.createDataFrame([(i, "it", [float(x) for x in C[i]]) for i in range(0, 40, 3)],
                                    "qid long, q_mod string, vec array<double>")
    root = f"{checkpoint_dir(spark)}/test-stream-{uuid.uuid4().hex}"
    queries.repartition(3).write.parquet(f"{root}/q")
    got = stream_search.run_stream_search(spark, f"{root}/q", pool, 5, f"{root}/out", f"{root}/ck")
    want = knn.search_topk(queries, pool, 5)
    cols = ["qid", "doc_id", "rank"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stream_resumes_from_checkpoint(spark):
    """A restarted stream processes only new files; all results equal the batch search."""
    rng = np.random.default_rng(12)
    C = rng.normal(size=(30, 3))
    C /= np.linalg.norm(C, axis=1, keepdims=True)
    pool = spark.createDataFrame([(i, "it", [float(x) for x in C[i]]) for i in range(30)],
                                 "doc_id long, c_mod string, vec array<double>")

    def qdf(ids):
        return spark.createDataFrame([(int(i), "it", [float(x) for x in C[i]]) for i in ids],
                                     "qid long, q_mod string, vec array<double>")
    root = f"{checkpoint_dir(spark)}/test-resume-{uuid.uuid4().hex}"
    qdf(range(0, 10)).coalesce(1).write.parquet(f"{root}/q/part=a")
    first = stream_search.run_stream_search(spark, f"{root}/q", pool, 3, f"{root}/out", f"{root}/ck")
    assert first.select("qid").distinct().count() == 10
    qdf(range(10, 20)).coalesce(1).write.parquet(f"{root}/q/part=b")
    both = stream_search.run_stream_search(spark, f"{root}/q", pool, 3, f"{root}/out", f"{root}/ck")
    batches = spark.read.parquet(f"{root}/out").select("batch_id").distinct().count()
    assert batches == 2
    want = knn.search_topk(qdf(range(20)), pool, 3)
    cols = ["qid", "doc_id", "rank"]
    assert sorted(map(tuple, both.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
