"""Registered queries: each binds an operator to the driver tables.

Every function takes (spark, sf_dir) and returns a DataFrame over whole tables;
searches write their vectors once, and so run jobs, before they return. Column names match the SQL oracle in ``quiver.plans.oracle``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.functions import vectors as V
from quiver.operators import encode, index, ivf, knn, lookup, pairs, project, runlog, views
from quiver.operators import metrics as M
from quiver.plans import evaluate as E
from quiver.session import scratch_path, spread
from quiver.sources import bindings as B
from quiver.sources import qrels as QR
from quiver.streaming import search as stream_search

# Fixed values of the registered queries.
K_SEARCH = 10
TEXT_WEIGHT = 0.7


def _round_vec(c, digits: int = 6):
    return F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))


def _views(spark: SparkSession, sf: str, fusion: str = "sum", text_weight: float = 0.5) -> DataFrame:
    # spread a one-file table before the per-element vector expressions run
    base = spread(B.load_base_vectors(spark, sf))
    return views.modality_vectors(base, fusion, text_weight, keep=["id", "label"])


def _unit_views(spark: SparkSession, sf: str, fusion: str = "sum", text_weight: float = 0.5,
                materialize: bool = False) -> DataFrame:
    """Unit modality vectors; ``materialize`` writes them once (the searched pool table)."""
    from quiver.plans.evaluate import unit_views
    return unit_views(_views(spark, sf, fusion, text_weight), materialize)


def _queries(unit: DataFrame, mods=None) -> DataFrame:
    q = unit.select(F.col("id").alias("qid"), F.col("modality").alias("q_mod"), "vec", F.col("label").alias("rel_key"))
    return q.where(F.col("q_mod").isin(mods)) if mods else q


def _pool(unit: DataFrame, mods=None) -> DataFrame:
    p = unit.select(F.col("id").alias("doc_id"), F.col("modality").alias("c_mod"), "vec",
                    F.col("label").alias("rel_key"))
    return p.where(F.col("c_mod").isin(mods)) if mods else p


# ---- vectors ----------------------------------------------------------------------

def q_l2_normalize(spark, sf):
    u = _unit_views(spark, sf)
    return u.select("id", "modality", _round_vec(F.col("vec")).alias("vec"))


def q_l2_normalize_eps(spark, sf):
    u = V.with_l2_normalized_eps(_views(spark, sf), "vec")
    return u.select("id", "modality", _round_vec(F.col("vec")).alias("vec"))


def q_pair_cosine(spark, sf):
    base = B.load_base_vectors(spark, sf)
    u = V.with_l2_normalized(V.with_l2_normalized(base, "img_vec", "img_unit"), "txt_vec", "txt_unit")
    return u.select("id", (V.round_score(V.dot("img_unit", "txt_unit")) + F.lit(0.0)).alias("cosine"))


def q_fuse_sum(spark, sf):
    base = B.load_base_vectors(spark, sf)
    v = V.fuse_sum(V.mask_gate("img_vec", "img_mask"), V.mask_gate("txt_vec", "txt_mask"))
    return base.select("id", _round_vec(v).alias("vec"))


def q_fuse_weighted(spark, sf):
    base = B.load_base_vectors(spark, sf)
    v = V.fuse_weighted(V.mask_gate("img_vec", "img_mask"), V.mask_gate("txt_vec", "txt_mask"), TEXT_WEIGHT)
    return base.select("id", _round_vec(v).alias("vec"))


def q_mask_gate(spark, sf):
    base = B.load_base_vectors(spark, sf)
    return base.select("id", "txt_mask", _round_vec(V.mask_gate("txt_vec", "txt_mask")).alias("vec"))


def q_dim_check(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    s = V.dim_stats(emb, "embedding")
    return s.select("min_dim", "max_dim", "n_rows",
                    F.when(F.col("min_dim") == F.col("max_dim"), F.lit("ok")).otherwise(F.lit("ragged"))
                    .alias("status"))


# ---- search -------------------------------------------------------------------------

def _hits_out(h: DataFrame) -> DataFrame:
    return h.select("qid", "q_mod", "c_mod", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def q_knn_exact(spark, sf):
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(knn.search_topk(_queries(u, ["it"]), _pool(u, ["it"]), K_SEARCH))


def q_knn_l2(spark, sf):
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(knn.search_topk(_queries(u, ["t"]), _pool(u, ["t"]), K_SEARCH, metric="l2"))


def q_knn_block(spark, sf):
    """All nine cells, self excluded, query side cut into several broadcast blocks."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(knn.search_topk(_queries(u), _pool(u), K_SEARCH, exclude_self=True, min_blocks=4))


QUERIES = {
    "l2_normalize": q_l2_normalize,
    "l2_normalize_eps": q_l2_normalize_eps,
    "pair_cosine": q_pair_cosine,
    "fuse_sum": q_fuse_sum,
    "fuse_weighted": q_fuse_weighted,
    "mask_gate": q_mask_gate,
    "dim_check": q_dim_check,
    "knn_exact": q_knn_exact,
    "knn_l2": q_knn_l2,
    "knn_block": q_knn_block,
}


# ---- judgments ------------------------------------------------------------------------


KS = [k for _, k in M.parse_metric_list(M.DEFAULT_METRICS)]


def _lines(spark, sf):
    return B.qrels_lines(spark.read.parquet(f"{sf}/embeddings.parquet"))


def q_qrels_parse(spark, sf):
    return QR.parse_qrels(_lines(spark, sf))


def q_qrels_rejects(spark, sf):
    """Every line also arrives cut to its first three fields; the cut copies are malformed."""
    lines = _lines(spark, sf)
    cut = lines.select((F.col("line_no") + F.lit(1 << 40)).alias("line_no"),
                       F.substring_index("value", " ", 3).alias("value"))
    return QR.qrels_rejects(lines.unionByName(cut))


def q_qrels_generate(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("split", F.lit(B.DEFAULT_SPLIT))
    return QR.generate_identity_qrels(emb, "vec_id", "split")


def q_qrel_sets(spark, sf):
    return QR.qrel_sets(QR.parse_qrels(_lines(spark, sf)))


def q_task_last_wins(spark, sf):
    """Each query's lines twice: the later copy carries another task; the later one wins."""
    lines = _lines(spark, sf)
    later = lines.select((F.col("line_no") + F.lit(1 << 40)).alias("line_no"),
                         F.concat_ws(" ", F.col("value"), F.lit("extra")).alias("value"))
    relabel = later.select("line_no", F.regexp_replace("value", r" (\d+) extra$", " 9$1").alias("value"))
    return QR.task_map(QR.parse_qrels(lines.unionByName(relabel)))


# ---- evaluation --------------------------------------------------------------------------

def _eval_sides(spark, sf, c_mods=None):
    return E.sides(_views(spark, sf), c_mods)


def _label_ranks(spark, sf, c_mods=None):
    q, p = _eval_sides(spark, sf, c_mods)
    return E.ranks(q, p, None, E.EvalConfig(exclude_self=True))


def q_hit_at_k(spark, sf):
    per_q = M.per_query(_label_ranks(spark, sf), KS)
    return per_q.select("qid", "q_mod", "c_mod", "first_rank", *[f"hit_{k}" for k in KS])


def q_mrr(spark, sf):
    per_q = M.per_query(_label_ranks(spark, sf), KS)
    return per_q.select("qid", "q_mod", "c_mod", (F.round("rr", 6) + F.lit(0.0)).alias("rr"))


def q_eval_grid(spark, sf):
    return M.grid_summary(M.per_query(_label_ranks(spark, sf), KS), KS)


def q_grid_missing_modality(spark, sf):
    """The pool lacks the text-only modality: its three cells are absent, not errors."""
    return M.grid_summary(M.per_query(_label_ranks(spark, sf, ["i", "it"]), KS), KS)


def q_eval_report(spark, sf):
    q, p = _eval_sides(spark, sf)
    return M.rounded(E.evaluate(q, p, _lines(spark, sf)))


def q_eval_report_wide(spark, sf):
    q, p = _eval_sides(spark, sf)
    return M.wide_report(E.evaluate(q, p, _lines(spark, sf)), M.parse_metric_list(M.DEFAULT_METRICS))


def q_unjudged_queries(spark, sf):
    """Per cell: queries with and without a positive judgment; all stay in the MRR mean."""
    q, p = _eval_sides(spark, sf)
    lines = _lines(spark, sf)
    per_q = M.per_query(E.ranks(q, p, lines, E.EvalConfig()), KS)
    judged = QR.positive_judgments(QR.parse_qrels(lines)).select("qid").distinct().withColumn("judged", F.lit(1))
    j = per_q.withColumn("qid_s", F.col("qid").cast("string")).join(
        judged.withColumnRenamed("qid", "qid_s"), "qid_s", "left")
    return j.groupBy("q_mod", "c_mod").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("judged").alias("n_judged"),
        F.sum(F.when(F.col("judged").isNull(), 1).otherwise(0)).cast("bigint").alias("n_unjudged"),
        (F.round(F.avg("rr"), 6) + F.lit(0.0)).alias("mrr"))


def q_relevant_hits(spark, sf):
    """Top-10 hits of every cell that are judged relevant (semi join on string ids)."""
    u = _unit_views(spark, sf, materialize=True)
    hits = knn.search_topk(_queries(u), _pool(u), K_SEARCH)
    judg = QR.positive_judgments(QR.parse_qrels(_lines(spark, sf)))
    h = hits.withColumn("q_s", F.col("qid").cast("string")).withColumn("d_s", F.col("doc_id").cast("string"))
    rel = h.join(judg, (h.q_s == judg.qid) & (h.d_s == judg.doc_id), "left_semi")
    return rel.select("qid", "q_mod", "c_mod", "doc_id", F.col("rank").cast("int").alias("rank"))


def q_pool_build(spark, sf):
    pool = E.build_pool(_views(spark, sf))
    return pool.select("doc_id", "c_mod", _round_vec(F.col("vec")).alias("vec"))


def q_pool_counts(spark, sf):
    pool = E.build_pool(_views(spark, sf), materialize=False)
    judged = QR.qrel_sets(QR.parse_qrels(_lines(spark, sf)))
    a = pool.groupBy(F.col("c_mod").alias("modality")).agg(F.count(F.lit(1)).alias("n"))
    b = judged.agg(F.count(F.lit(1)).alias("n")).select(F.lit("judged_queries").alias("modality"), "n")
    return a.unionByName(b)


def q_duplicate_ids(spark, sf):
    """A pool fed with both the embedding ids and the corpus ids: shared ids are reported."""
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"))
    corpus = B.load_corpus(spark, sf).select(F.col("id").alias("doc_id"))
    return E.duplicate_ids(emb.unionByName(corpus))


def q_modality_fanout(spark, sf):
    """Three views per corpus record (order i, t, it) with masks."""
    corpus = B.load_corpus(spark, sf)
    out = views.fanout_items(corpus, side="cand")
    return out.select("id", "view_pos", "modality", "txt", "txt_mask", "img_mask")


QUERIES.update({
    "qrels_parse": q_qrels_parse,
    "qrels_rejects": q_qrels_rejects,
    "qrels_generate": q_qrels_generate,
    "qrel_sets": q_qrel_sets,
    "task_last_wins": q_task_last_wins,
    "hit_at_k": q_hit_at_k,
    "mrr": q_mrr,
    "eval_grid": q_eval_grid,
    "grid_missing_modality": q_grid_missing_modality,
    "eval_report": q_eval_report,
    "eval_report_wide": q_eval_report_wide,
    "unjudged_queries": q_unjudged_queries,
    "relevant_hits": q_relevant_hits,
    "pool_build": q_pool_build,
    "pool_counts": q_pool_counts,
    "duplicate_ids": q_duplicate_ids,
    "modality_fanout": q_modality_fanout,
})


# ---- views and pairs ------------------------------------------------------------------


SEED = 42
BATCH = 32
STEP_BATCHES = 4          # batches whose positives are gathered together
LOGIT_SCALE = math.log(100.0)     # as a model stores it
CARD_TOP_K = 7


def _has_img(c="img"):
    return F.when(F.col(c).isNull(), 0).otherwise(1).alias("has_img")


def q_candidate_view(spark, sf):
    corpus = B.load_corpus(spark, sf)
    parts = [views.candidate_view(corpus, m) for m in ["it", "i", "t", "unknown"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "modality", "txt", _has_img())


def q_query_view(spark, sf):
    corpus = B.load_corpus(spark, sf)
    parts = [views.query_view(corpus, m) for m in views.MODALITIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "modality", "txt", _has_img())


def q_first_question(spark, sf):
    return B.load_corpus(spark, sf).select("id", "question")


def q_sampled_question(spark, sf):
    c = B.load_corpus(spark, sf).select("id")
    s = views.sample_question_long(c, B.load_user_questions(spark, sf), T.hash_draw("id", F.lit(SEED)), "question")
    return s.select("id", "question")


def _query_items(spark, sf):
    corpus = B.load_corpus(spark, sf)
    parts = [views.query_view(corpus, m) for m in views.MODALITIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return views.with_masks(out)


def q_mask_columns(spark, sf):
    return _query_items(spark, sf).select("id", "modality", "txt", "txt_mask", "img_mask")


def q_valid_queries(spark, sf):
    ok, rejected = views.valid_queries(_query_items(spark, sf))
    return (ok.select("id", "modality", F.lit("ok").alias("status"))
              .unionByName(rejected.select("id", "modality", F.lit("rejected").alias("status"))))


def _pairs_out(p):
    return p.select("id", "q_mode", "t_mode", F.col("query.txt").alias("q_txt"), _has_img("query.img").alias("q_has_img"),
                    F.col("pos_cand.txt").alias("c_txt"), _has_img("pos_cand.img").alias("c_has_img"))


def q_train_pairs(spark, sf):
    return _pairs_out(pairs.train_pairs(B.load_corpus(spark, sf), SEED, epoch=0,
                                        questions=B.load_user_questions(spark, sf)))


def q_train_pairs_fixed_target(spark, sf):
    return _pairs_out(pairs.train_pairs(B.load_corpus(spark, sf), SEED, epoch=0, fixed_target=True,
                                        questions=B.load_user_questions(spark, sf)))


def q_pair_flatten(spark, sf):
    p = pairs.train_pairs(B.load_corpus(spark, sf), SEED, epoch=0, questions=B.load_user_questions(spark, sf))
    b = pairs.epoch_batches(p, "id", 8, SEED, 0)
    return pairs.pair_flatten(b)


def q_epoch_batches(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    return pairs.epoch_batches(emb, "vec_id", BATCH, SEED, 1).select(
        "vec_id", "batch_id", "pos")


def _contrastive_sides(spark, sf):
    base = B.load_base_vectors(spark, sf)
    b = pairs.epoch_batches(base, "id", BATCH, SEED, 0)
    q = b.select("batch_id", "pos", V.mask_gate("img_vec", "img_mask").alias("vec"))
    p = b.select("batch_id", F.col("pos").alias("col"), V.mask_gate("txt_vec", "txt_mask").alias("vec"))
    return b, q, p


def q_contrastive_eval(spark, sf):
    _, q, p = _contrastive_sides(spark, sf)
    return pairs.contrastive_eval(q, p, LOGIT_SCALE)


def q_contrastive_eval_global(spark, sf):
    """Positives of STEP_BATCHES consecutive batches are gathered into one logit row."""
    b, _, _ = _contrastive_sides(spark, sf)
    b = (b.withColumn("step_id", F.floor(F.col("batch_id") / STEP_BATCHES).cast("bigint"))
          .withColumn("rnk", (F.col("batch_id") % STEP_BATCHES).cast("int")))
    q = b.select("batch_id", "step_id", "pos", "rnk", V.mask_gate("img_vec", "img_mask").alias("vec"))
    p = b.select("step_id", (F.col("rnk") * BATCH + F.col("pos")).alias("col"),
                 V.mask_gate("txt_vec", "txt_mask").alias("vec"))
    return pairs.contrastive_eval(q, p, LOGIT_SCALE, group_col="step_id", col_offset=F.col("rnk") * BATCH)


def q_argmax_accuracy(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    return pairs.argmax_accuracy(emb.select(F.col("embedding").alias("logits"), "label"), "logits", "label")


# ---- content, cards, vectors of hits ------------------------------------------------------

def _it_hits(spark, sf, k):
    u = _unit_views(spark, sf, materialize=True)
    return u, knn.search_topk(_queries(u, ["it"]), _pool(u, ["it"]), k)


def q_content_lookup(spark, sf):
    _, hits = _it_hits(spark, sf, K_SEARCH)
    out = lookup.content_lookup(_hits_out(hits), B.load_corpus(spark, sf))
    return out.drop("image_content")


def q_search_cards(spark, sf):
    u, hits = _it_hits(spark, sf, CARD_TOP_K)
    return lookup.search_cards(_queries(u, ["it"]), hits, B.load_corpus(spark, sf))


def q_hit_vectors(spark, sf):
    u = _unit_views(spark, sf, materialize=True)
    hits = knn.search_topk(_queries(u), _pool(u), K_SEARCH)
    raw = _views(spark, sf).select("id", F.col("modality").alias("c_mod"), "vec")
    found, _ = lookup.hit_vectors(hits, raw)
    return found.select("qid", "q_mod", "c_mod", F.col("rank").cast("int").alias("rank"), "doc_id",
                        (V.round_score(V.l2_norm("vec")) + F.lit(0.0)).alias("norm"))


QUERIES.update({
    "candidate_view": q_candidate_view,
    "query_view": q_query_view,
    "first_question": q_first_question,
    "sampled_question": q_sampled_question,
    "mask_columns": q_mask_columns,
    "valid_queries": q_valid_queries,
    "train_pairs": q_train_pairs,
    "train_pairs_fixed_target": q_train_pairs_fixed_target,
    "pair_flatten": q_pair_flatten,
    "epoch_batches": q_epoch_batches,
    "contrastive_eval": q_contrastive_eval,
    "contrastive_eval_global": q_contrastive_eval_global,
    "argmax_accuracy": q_argmax_accuracy,
    "content_lookup": q_content_lookup,
    "search_cards": q_search_cards,
    "hit_vectors": q_hit_vectors,
})


# ---- run log ---------------------------------------------------------------------------


LOG_CHUNK_STEPS = 1000     # small chunks and blocks so the split paths run at every scale
LOG_BLOCK_ROWS = 256
LOSS_METRIC = "error"
WIDE_COLUMNS = sorted(f"{p}_{m}" for m, p in B.PHASE_OF_METRIC.items())


def _r6(c):
    return (F.round(c, 6) + F.lit(0.0))


def _log(spark, sf):
    return B.metric_log(spark.read.parquet(f"{sf}/events.parquet"))


def _epoch_stats(spark, sf):
    return B.epoch_stats(spark.read.parquet(f"{sf}/events.parquet"))


def q_rolling_meter(spark, sf):
    """Series keyed by metric alone (five hot keys)."""
    m = runlog.rolling_meter(_log(spark, sf), ["metric"], block_rows=LOG_BLOCK_ROWS, chunk_steps=LOG_CHUNK_STEPS)
    return m.select("metric", "step", "value", "window_n", "median", _r6(F.col("avg")).alias("avg"), "max")


def q_cumulative_avg(spark, sf):
    c = runlog.cumulative_avg(_log(spark, sf), ["metric"], chunk_steps=LOG_CHUNK_STEPS)
    return c.select("metric", "step", "value", "count", _r6(F.col("cum_avg")).alias("cum_avg"))


def q_running_best(spark, sf):
    r = runlog.running_best(_epoch_stats(spark, sf), ["run_id", "metric"], chunk_steps=8)
    return r.select("run_id", "metric", "epoch", _r6(F.col("value")).alias("value"),
                    _r6(F.col("best_so_far")).alias("best_so_far"), "is_best")


def q_global_avg(spark, sf):
    g = runlog.global_avg(_log(spark, sf), ["run_id", "metric"])
    return g.select("run_id", "metric", "count", _r6(F.col("total")).alias("total"),
                    _r6(F.col("global_avg")).alias("global_avg"))


def q_epoch_means(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch"), F.col("event_type").alias("metric"),
        "value")
    e = runlog.epoch_means(events, ["run_id", "epoch", "metric"])
    return e.select("run_id", "epoch", "metric", "n", _r6(F.col("mean")).alias("mean"))


def _best_epoch(spark, sf):
    loss = _epoch_stats(spark, sf).where(F.col("metric") == LOSS_METRIC).withColumnRenamed("value", "loss")
    return runlog.best_epoch(loss)


def q_best_epoch(spark, sf):
    return _best_epoch(spark, sf).select("run_id", "best_epoch", _r6(F.col("best_loss")).alias("best_loss"))


def q_run_stats_wide(spark, sf):
    s = _epoch_stats(spark, sf).withColumn("value", _r6(F.col("value")))
    wide = runlog.stats_wide(s, ["run_id", "epoch"], "phase", "metric", "value", WIDE_COLUMNS)
    return wide.join(_best_epoch(spark, sf).select("run_id", "best_epoch"), "run_id", "left")


QUERIES.update({
    "rolling_meter": q_rolling_meter,
    "cumulative_avg": q_cumulative_avg,
    "running_best": q_running_best,
    "global_avg": q_global_avg,
    "epoch_means": q_epoch_means,
    "best_epoch": q_best_epoch,
    "run_stats_wide": q_run_stats_wide,
})


# ---- encoders -----------------------------------------------------------------------


def q_encode_batch(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return encode.encode_batch(docs, "text", "vec").select("doc_id", "vec")


def q_encode_fused(spark, sf):
    fused = encode.encode_fused(B.load_corpus(spark, sf), side="cand")
    return fused.select("id", "modality", _round_vec(F.col("vec")).alias("vec"))


def q_fuse_mlp(spark, sf):
    base = B.load_base_vectors(spark, sf)
    w = encode.rule_mlp_weights(encode.HASH_DIM)
    v = encode.fuse_mlp(V.mask_gate("txt_vec", "txt_mask"), V.mask_gate("img_vec", "img_mask"), w)
    return base.select("id", _round_vec(v).alias("vec"))


def q_quantize_fp16(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    return emb.select("vec_id", encode.quantize_fp16(F.col("embedding")).alias("vec"))


QUERIES.update({
    "encode_batch": q_encode_batch,
    "encode_fused": q_encode_fused,
    "fuse_mlp": q_fuse_mlp,
    "quantize_fp16": q_quantize_fp16,
})


# ---- approximate search, projection, streaming ------------------------------------------


IVF_CELLS = 16               # the least; cells grow with the pool
IVF_PROBE = 8
IVF_REACH = 0.4              # of a cell's radius that its bound counts


def q_knn_ivf(spark, sf):
    """Approximate: the bound counts a part of each cell's radius; every query gets k answers."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(ivf.search_ivf(_queries(u), _pool(u), K_SEARCH, None, IVF_PROBE, materialize_inputs=False, reach=IVF_REACH))


def q_knn_ivf_exact(spark, sf):
    """Cells are visited until no unvisited one can hold a better answer."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(ivf.search_ivf(_queries(u), _pool(u), K_SEARCH, None, IVF_PROBE, materialize_inputs=False, reach=1.0))


PQ_FACTORY = "IVF,PQ16"      # 16 bytes a vector
SQ_FACTORY = "PCA32,SQ8"     # 32 bytes a vector


def q_knn_pq(spark, sf):
    """Approximate: cells, product codes of what the centroids leave over, a shortlist scored exactly."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(index.Index(_pool(u), PQ_FACTORY).search(_queries(u), K_SEARCH, IVF_PROBE, IVF_REACH))


LSH_PROBE = 15               # buckets of 16


def q_knn_lsh(spark, sf):
    """Approximate: buckets of hyperplane codes in growing balls, a shortlist by Hamming distance scored exactly."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(index.Index(_pool(u), "LSH").search(_queries(u), K_SEARCH, LSH_PROBE))


def q_knn_pq_exact(spark, sf):
    """Product codes, and every vector scored exactly that its code doesn't rule out."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(index.Index(_pool(u), "PQ16").search(_queries(u), K_SEARCH, exact=True))


def q_knn_sq8_exact(spark, sf):
    """Bytes per principal component, and every vector scored exactly that its code doesn't rule out."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(index.Index(_pool(u), SQ_FACTORY).search(_queries(u), K_SEARCH, exact=True))


def q_knn_ivf_full_probe(spark, sf):
    """Probing every cell makes the cell-partitioned search exact."""
    u = _unit_views(spark, sf, materialize=True)
    return _hits_out(ivf.search_ivf(_queries(u), _pool(u), K_SEARCH, IVF_CELLS, IVF_CELLS,
                                    materialize_inputs=False))


def q_neighborhood_pca(spark, sf):
    raw = E.write_once(_views(spark, sf))          # raw vectors: projected; unit vectors: searched
    u = V.with_l2_normalized(raw, "vec")
    hits = knn.search_topk(_queries(u), _pool(u), lookup.VIZ_TOP)
    qv = raw.select(F.col("id").alias("qid"), F.col("modality").alias("q_mod"), "vec")
    cv = raw.select("id", F.col("modality").alias("c_mod"), "vec")
    return project.neighborhood_pca(hits, qv, cv)


def q_stream_search(spark, sf):
    """The fused-view queries written as files, searched as a stream against the fused pool."""
    root = scratch_path(spark, "quiver-stream")
    u = _unit_views(spark, sf, materialize=True)
    # as many files as the table has; a trigger takes four, so a micro-batch is bounded
    _queries(u, ["it"]).select("qid", "q_mod", "vec").write.parquet(f"{root}/queries")
    return stream_search.run_stream_search(spark, f"{root}/queries", _pool(u, ["it"]), K_SEARCH,
                                           f"{root}/hits", f"{root}/checkpoint", files_per_trigger=4)


QUERIES.update({
    "knn_ivf": q_knn_ivf,
    "knn_ivf_exact": q_knn_ivf_exact,
    "knn_lsh": q_knn_lsh,
    "knn_pq": q_knn_pq,
    "knn_pq_exact": q_knn_pq_exact,
    "knn_sq8_exact": q_knn_sq8_exact,
    "knn_ivf_full_probe": q_knn_ivf_full_probe,
    "neighborhood_pca": q_neighborhood_pca,
    "stream_search": q_stream_search,
})


# ---- corpus to report ------------------------------------------------------------------

def q_corpus_eval_report(spark, sf):
    """Encode the conversation corpus (captions, questions, images), evaluate with identity judgments."""
    from quiver.plans import retrieval
    cfg = E.EvalConfig(dataset="conversations", cand_pool="conversations")
    return M.rounded(retrieval.evaluate_corpus(B.load_corpus(spark, sf), None, cfg))


QUERIES.update({"corpus_eval_report": q_corpus_eval_report})


def q_eval_report_tsv(spark, sf):
    """The report written as a timestamped TSV under the checkpoint folder, read back."""
    from quiver.sources import sinks
    q, p = _eval_sides(spark, sf)
    out = scratch_path(spark, "quiver-reports")
    path = E.evaluate_and_write(q, p, _lines(spark, sf), out)
    names = M.report_columns(M.parse_metric_list(M.DEFAULT_METRICS))
    types = {"TaskID": "int"}
    schema = ", ".join(f"`{c}` {types.get(c, 'double' if c.startswith('Recall@') or c == 'MRR' else 'string')}"
                       for c in names)
    return sinks.read_report_tsv(spark, path, schema)


QUERIES.update({"eval_report_tsv": q_eval_report_tsv})


def q_pair_contrastive_eval(spark, sf):
    """Validation on real pairs: corpus -> pairs -> seeded batches -> encode both items -> loss, accuracy."""
    p = pairs.train_pairs(B.load_corpus(spark, sf), SEED, epoch=0, modes=["img_txt"],
                          questions=B.load_user_questions(spark, sf))
    b = E.write_once(pairs.epoch_batches(p, "id", 8, SEED, 0))
    q, pos = pairs.encode_pair_items(b)
    return pairs.contrastive_eval(q, pos, LOGIT_SCALE)


QUERIES.update({"pair_contrastive_eval": q_pair_contrastive_eval})


# ---- round trips through files, by split --------------------------------------------------


def _split_of(c):
    """Every tenth record validates, every next one tests, the others train."""
    return F.when(c % 10 == 0, "validation").when(c % 10 == 1, "test").otherwise("train")


def q_qrels_files(spark, sf):
    """Judgments with several documents, repeats and rel 0, written per split, read as text and parsed."""
    v, label = F.col("vec_id"), F.col("label")

    def line(doc, rel, task):
        return F.concat_ws(" ", v, F.lit(0), doc, F.lit(rel), task)
    lines = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", _split_of(v).alias("split"), F.posexplode(F.array(
        line(v, 1, label % 2), line(v, 2, label % 3), line(2 * v, 0, label % 4), line(2 * v + 1, 1, label % 5))).alias("k", "value"))
    path = scratch_path(spark, "quiver-judgments")
    QR.write_qrels(lines.withColumn("line_no", F.struct("vec_id", "k")), path)
    parts = []
    for split in ("train", "validation", "test"):
        parsed = QR.parse_qrels(QR.read_qrels_text(spark, f"{path}/split={split}"))
        sets = QR.qrel_sets(parsed).join(QR.task_map(parsed), "qid")
        parts.append(sets.select(F.lit(split).alias("split"), "qid", F.array_join("doc_ids", ",").alias("doc_ids"), "n_docs", "task_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stored_by_split(spark, sf):
    """The vectors of both sides, stored by split in half precision; a reader of (side, split) as unit vectors."""
    from quiver.sources import sinks
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), _split_of(F.col("vec_id")).alias("split"), F.col("embedding").cast("array<float>").alias("vector"))
    sides = base.select("id", "split", "vector", F.explode(F.array(F.lit("query"), F.lit("cand"))).alias("side"), F.lit("i").alias("modality"))
    path = scratch_path(spark, "quiver-embeddings")
    sinks.write_embeddings(sides, path, half=True)
    return lambda side, split: V.with_l2_normalized(sinks.read_embeddings(spark, path, side, split, ["i"]), "vec")


def q_embedding_store(spark, sf):
    """Every vector of the store read back and searched against every other, as one list."""
    return q_embedding_store_splits(spark, sf).drop("split")


def q_embedding_store_splits(spark, sf):
    """All splits of the store read back, the queries of each searched against the candidates of all."""
    read, splits = _stored_by_split(spark, sf), ("train", "validation", "test")
    pool = reduce(DataFrame.unionByName, [read("cand", s) for s in splits]).select(
        F.col("id").alias("doc_id"), F.col("modality").alias("c_mod"), "vec")
    parts = [_hits_out(knn.search_topk(read("query", s).select(F.col("id").alias("qid"), F.col("modality").alias("q_mod"), "vec"),
                                       pool, K_SEARCH)).withColumn("split", F.lit(s)) for s in splits]
    return reduce(DataFrame.unionByName, parts)


def q_pool_append(spark, sf):
    """A pool grown by three batches of interleaved ids, searched by the fused queries."""
    from quiver.sources.growing import GrowingPool
    u = _unit_views(spark, sf, materialize=True)
    pool = GrowingPool(spark, scratch_path(spark, "quiver-growing"))
    for part in range(3):
        pool.append(_pool(u, ["it"]).where(F.col("doc_id") % 3 == part))
    return _hits_out(knn.search_topk(_queries(u, ["it"]), pool.read(), K_SEARCH))


QUERIES.update({"pool_append": q_pool_append, "qrels_files": q_qrels_files, "embedding_store": q_embedding_store,
                "embedding_store_splits": q_embedding_store_splits})
