"""Sinks, the evaluation config expansion, the fusion switch, the full evaluation job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import encode, views
from quiver.plans import evaluate as E
from quiver.sources import sinks


def test_eval_config_expand(spark):
    cfg = spark.createDataFrame(
        [("test", ["Set_A", "Other"], ["Pool_A", "pool_b"], ["Q1", "q2"], ["Recall@1, Recall@5", "Recall@10"])],
        "split string, datasets_name array<string>, correspond_cand_pools_name array<string>, "
        "correspond_qrels_name array<string>, correspond_metrics_name array<string>")
    rows = E.eval_config_expand(cfg).orderBy("task_pos").collect()
    assert [(r.dataset, r.cand_pool, r.qrels_name, r.metrics) for r in rows] == [
        ("set_a", "pool_a", "q1", "Recall@1, Recall@5"), ("other", "pool_b", "q2", "Recall@10")]
    bad = spark.createDataFrame([("test", ["a"], ["b", "c"], ["q"], ["m"])], cfg.schema)
    with pytest.raises(ValueError):
        E.eval_config_expand(bad)


def test_fusion_switch(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0], 1, 1)],
                                 "id long, img_vec array<double>, txt_vec array<double>, img_mask int, txt_mask int")
    w = encode.rule_mlp_weights(2)
    got = {r.modality: r.vec for r in views.modality_vectors(base, "mlp", mlp_weights=w).collect()}
    x = np.array([0.0, 1.0, 1.0, 0.0])          # concat [txt, img] for the 'it' view
    want = np.maximum(x @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    assert np.allclose(got["it"], want)
    with pytest.raises(ValueError):
        views.modality_vectors(base, "concat")


def test_pool_store_and_report_sinks(spark, tmp_path):
    pool = spark.createDataFrame([(2, "it", [1.0]), (1, "it", [0.5]), (3, "t", [0.1])],
                                 "doc_id long, c_mod string, vec array<double>")
    sinks.write_pool(pool, str(tmp_path / "pool"))
    back = spark.read.parquet(str(tmp_path / "pool"))
    assert sorted((r.doc_id, r.c_mod) for r in back.collect()) == [(1, "it"), (2, "it"), (3, "t")]
    assert back.where(F.col("c_mod") == "t").count() == 1
    store = pool.select(F.lit("cand").alias("side"), F.lit("test").alias("split"),
                        F.col("c_mod").alias("modality"), F.col("doc_id").alias("id"), F.col("vec").alias("vector"))
    sinks.write_embeddings(store, str(tmp_path / "emb"))
    assert spark.read.parquet(str(tmp_path / "emb")).count() == 3
    assert sinks.write_report_tsv(pool.limit(0), str(tmp_path / "rep")) is None


def test_evaluation_job_writes_tsv(spark, tmp_path):
    views_df = spark.createDataFrame(
        [(i, m, [float(np.cos(i + k)), float(np.sin(i * k + 1))], i % 2) for i in range(12)
         for k, m in enumerate(["i", "t", "it"])],
        "id long, modality string, vec array<double>, label int")
    q, p = E.sides(views_df)
    lines = spark.createDataFrame([(i, f"{i} 0 {(i + 2) % 12} 1 {i % 2}") for i in range(12)],
                                  "line_no long, value string")
    path = E.evaluate_and_write(q, p, lines, str(tmp_path / "tsv"))
    rep = sinks.read_report_tsv(spark, path)
    assert rep.columns[:7] == ["TaskID", "Task", "Dataset", "Split", "CandPool", "QueryModality", "CandidateModality"]
    assert rep.columns[7:] == ["Recall@1", "Recall@5", "Recall@10", "Recall@50", "Recall@100", "MRR"]
    assert rep.count() == 18
    assert path.split("/")[-1].startswith("evaluation_results_")


def test_corpus_encoding_and_store(spark, tmp_path):
    from quiver.plans import retrieval
    corpus = spark.createDataFrame(
        [(1, "test", b"a cat", "a cat", "what animal"), (2, "test", None, None, ""), (3, "test", b"", "", "dog?")],
        "id long, split string, image binary, caption string, question string")
    enc = retrieval.encode_corpus(corpus)
    rows = {r.id: r for r in enc.collect()}
    assert (rows[1].cap_mask, rows[1].q_mask, rows[1].img_mask) == (1, 1, 1)
    assert (rows[2].cap_mask, rows[2].q_mask, rows[2].img_mask) == (0, 0, 0)
    assert (rows[3].cap_mask, rows[3].q_mask, rows[3].img_mask) == (0, 1, 1)
    retrieval.store_embeddings(enc, str(tmp_path / "store"))
    st = spark.read.parquet(str(tmp_path / "store"))
    assert st.count() == 18
    assert sorted(r.side for r in st.select("side").distinct().collect()) == ["cand", "query"]
    rep = retrieval.evaluate_corpus(corpus).collect()
    assert len(rep) == 9 and all(r.n == 3 for r in rep)


def test_every_stored_split_is_read_back_and_searched(spark):
    """All rows as queries and as candidates, by brute force over numpy's half precision."""
    from quiver.plans import catalog
    from tests.conftest import SF_SMALL
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float32).astype(np.float16).astype(np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norms, out=x, where=norms > 0)
    scores = np.round(x @ x.T, 6)
    got = {}
    for r in catalog.QUERIES["embedding_store_splits"](spark, SF_SMALL).collect():
        got.setdefault((r.split, r.qid), []).append((r.rank, r.doc_id))
    for i, qid in enumerate(ids):
        split = {0: "validation", 1: "test"}.get(qid % 10, "train")
        best = ids[np.lexsort((ids, -scores[i]))[:10]]
        assert [d for _, d in sorted(got.pop((split, qid)))] == list(best)
    assert not got
