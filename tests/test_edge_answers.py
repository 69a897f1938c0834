"""Answers that the driver's tables never reach."""

import math

import numpy as np

from quiver.operators import encode, knn, metrics, pairs, runlog
from quiver.plans import evaluate as E
from quiver.plans import retrieval
from quiver.sources import qrels as Q

VIEW = "qid long, q_mod string, vec array<double>"
POOL = "doc_id long, c_mod string, vec array<double>"


def _unit(draw, n, d=8):
    x = draw.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_query_rows_with_one_id_are_searched_each(spark):
    draw = np.random.default_rng(0)
    q, c = _unit(draw, 2), _unit(draw, 30)
    queries = spark.createDataFrame([(7, "it", v.tolist()) for v in q], VIEW)
    pool = spark.createDataFrame([(i, "it", v.tolist()) for i, v in enumerate(c)], POOL)
    hits = knn.search_topk(queries, pool, 3).collect()
    want = sorted((int(d), r + 1) for v in q for r, d in enumerate(np.argsort(-(c @ v))[:3]))
    assert sorted((h.doc_id, h.rank) for h in hits) == want and {h.q_mod for h in hits} == {"it"}
    judged = spark.createDataFrame([("7", "4")], "qid string, doc_id string")
    got = knn.first_relevant_rank(queries, pool, judged).collect()
    assert sorted(r.first_rank for r in got) == sorted(int((c @ v > c[4] @ v).sum()) + 1 for v in q)


def test_judged_scores_round_like_the_scan(spark):
    """Sign vectors of 256 elements score multiples of 1/128: all ties at the seventh place."""
    draw = np.random.default_rng(1)
    c = np.sign(draw.normal(size=(60, 256))) / 16
    queries = spark.createDataFrame([(0, "it", c[0].tolist())], VIEW)
    pool = spark.createDataFrame([(i, "it", v.tolist()) for i, v in enumerate(c)], POOL)
    ranked = {h.doc_id: h.rank for h in knn.search_topk(queries, pool, 60).collect()}
    for metric in ("ip", "l2"):
        ranked = {h.doc_id: h.rank for h in knn.search_topk(queries, pool, 60, metric=metric).collect()}
        for doc in (5, 17, 42):
            judged = spark.createDataFrame([("0", str(doc))], "qid string, doc_id string")
            assert knn.first_relevant_rank(queries, pool, judged, metric=metric).first().first_rank == ranked[doc]


def test_the_mean_is_rounded_once(spark):
    long = spark.createDataFrame([(0, "t", "d", "s", "p", m, n, 1, 1, 0.12344996) for m in ("txt_only", "img_only") for n in ("img_txt", "img_only")]
                                 + [(1, "t", "d", "s", "p", "img_only", "img_only", 1, 1, 0.5)],
                                 "task_id int, task string, dataset string, split string, cand_pool string, "
                                 "query_modality string, candidate_modality string, n long, hits_1 long, mrr double")
    rows = metrics.wide_report(long, [("Recall@1", 1)]).collect()
    assert [r.MRR for r in rows] == [0.1234, 0.5, 0.1234, 0.1234, 0.1234]
    assert [(r.QueryModality, r.CandidateModality, r.TaskID) for r in rows[:3]] == [
        ("img_only", "img_only", 0), ("img_only", "img_only", 1), ("img_only", "img_txt", 0)]


def test_losses_that_are_no_numbers_never_win(spark):
    stats = spark.createDataFrame([("a", 1, "n/a"), ("a", 2, "NaN"), ("a", 3, "0.5"), ("a", 4, None), ("b", 1, "bad")],
                                  "run_id string, epoch int, loss string")
    got = {r.run_id: (r.best_epoch, r.best_loss) for r in runlog.best_epoch(stats).collect()}
    assert got == {"a": (3, 0.5), "b": (1, math.inf)}


def test_unicode_blanks_separate_fields(spark):
    lines = spark.createDataFrame([(1, "q1\u00a00\u2003d1 1"), (2, "\u3000q2 0 d2\x1c2 5\u00a0"), (3, "q3 0 d3")], "line_no long, value string")
    got = [(r.qid, r.doc_id, r.rel, r.task_id) for r in Q.parse_qrels(lines).orderBy("line_no").collect()]
    assert got == [("q1", "d1", 1, "0"), ("q2", "d2", 2, "5")]
    assert [r.line_no for r in Q.qrels_rejects(lines).collect()] == [3]


def test_mlp_fusion_through_the_plans(spark):
    corpus = spark.createDataFrame([(i, f"caption {i} words", f"question {i}", bytearray(f"image {i}".encode())) for i in range(6)],
                                   "id long, caption string, question string, image binary")
    encoded = retrieval.encode_corpus(corpus)
    d = len(encoded.first().cap_vec)
    weights = encode.rule_mlp_weights(d)
    views = {(r.id, r.modality): r.vec for r in retrieval.side_views(encoded, "cand", "mlp", mlp_weights=weights).collect()}
    for r in encoded.collect():
        x = np.concatenate([np.array(r.cap_vec), np.array(r.img_vec)])
        h = np.maximum(x @ weights["w1"] + weights["b1"], 0) @ weights["w2"] + weights["b2"]
        assert np.allclose(views[r.id, "it"], h, atol=1e-6)
    report = retrieval.evaluate_corpus(corpus, None, E.EvalConfig(), fusion="mlp", mlp_weights=weights)
    assert {r.n for r in report.collect()} == {6} and report.count() == 9


def test_logit_scale_is_taken_as_stored(spark):
    q = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "batch_id long, pos int, vec array<double>")
    p = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.6, 0.8])], "batch_id long, col int, vec array<double>")
    got = pairs.contrastive_eval(q, p, math.log(2.0)).first()
    want = np.mean([np.log(np.exp(2 * np.array(s)).sum()) - 2 * s[i] for i, s in enumerate([[1.0, 0.6], [0.0, 0.8]])])
    assert abs(got.loss - want) < 1e-6 and got.accuracy == 1.0


def test_prefixes_over_many_chunk_groups(spark, monkeypatch):
    """Chunks of 3 steps in groups of 2: running means and minima as over one plain window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    monkeypatch.setattr(runlog, "CHUNKS_TOGETHER", 2)
    draw = np.random.default_rng(3)
    log = spark.createDataFrame([(k, i, float(draw.integers(0, 100)) / 4, int(draw.integers(1, 4))) for k in "ab" for i in range(60)],
                                "k string, step long, value double, n long")
    w = Window.partitionBy("k").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    want = log.select("k", "step", (F.sum(F.col("value") * F.col("n")).over(w) / F.sum("n").over(w)).alias("m"), F.min("value").over(w).alias("b"))
    want = {(r.k, r.step): (r.m, r.b) for r in want.collect()}
    means = {(r.k, r.step): r.cum_avg for r in runlog.cumulative_avg(log, ["k"], chunk_steps=3).collect()}
    best = {(r.k, r.step): r.best_so_far for r in runlog.running_best(log, ["k"], order="step", chunk_steps=3).collect()}
    assert all(abs(means[x] - m) < 1e-9 and best[x] == b for x, (m, b) in want.items()) and len(means) == len(want) == len(best)
    at = runlog.row_index(log, ["k"], "step", chunk_steps=3)
    assert all(r._r == r.step for r in at.collect())
