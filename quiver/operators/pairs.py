"""Training pairs, seeded epoch batches, and in-batch contrastive evaluation.

A pair is (query item, positive candidate item) built from one corpus record
with a query modality and a target modality drawn independently from a seeded
hash (reruns agree, unlike a global RNG). Batches are cut by a global position
made of counts per range of the draw, so no single task sorts the table. Contrastive
scores are matrix products of tiles of queries and positives of a batch or step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.functions import vectors as V
from quiver.operators import tiles

# Training query modes in draw order.
TRAIN_MODES = ["img_txt", "img_only", "txt_only"]


def _mode_of(draw: Column, modes: list[str]) -> Column:
    arr = F.array(*[F.lit(m) for m in modes])
    return F.get(arr, (draw % len(modes)).cast("int"))


def _item(mode: Column, txt: Column, txt_for_only: Column, image: Column) -> Column:
    """(txt, img) of an item for a long mode name."""
    t = (F.when(mode == "img_txt", txt).when(mode == "img_only", F.lit("")).when(mode == "txt_only", txt_for_only))
    i = F.when(mode == "txt_only", F.lit(None).cast("binary")).otherwise(image)
    return F.struct(t.alias("txt"), i.alias("img"))


def train_pairs(corpus: DataFrame, seed: int, epoch: int = 0, modes: list[str] | None = None,
                fixed_target: bool = False, questions: DataFrame | None = None) -> DataFrame:
    """(id, q_mode, t_mode, query STRUCT<txt,img>, pos_cand STRUCT<txt,img>).

    Query text is a seeded draw among the valid questions (from the record's
    ``questions`` array, or from ``questions`` in long form (id, turn, question));
    the target text is the caption (``img_only`` drops it, ``txt_only`` drops the
    image). With ``fixed_target`` the target is always caption + image.
    """
    modes = modes or TRAIN_MODES
    q_mode = _mode_of(T.hash_draw("id", F.lit(seed), F.lit(epoch), F.lit("query")), modes)
    t_mode = F.lit("img_txt") if fixed_target else _mode_of(
        T.hash_draw("id", F.lit(seed), F.lit(epoch), F.lit("target")), modes)
    draw_key = F.concat_ws("-", F.col("id").cast("string"), F.lit(epoch))
    if questions is None:
        base = corpus.withColumn("_q", T.sampled_question_any(corpus, draw_key, F.lit(seed)))
    else:
        from quiver.operators.views import sample_question_long
        base = sample_question_long(corpus, questions, T.hash_draw(draw_key, F.lit(seed)), "_q")
    df = base.select("id", "caption", "image", "_q", q_mode.alias("q_mode"), t_mode.alias("t_mode"))
    return df.select(
        "id", "q_mode", "t_mode",
        _item(F.col("q_mode"), F.col("_q"), F.col("_q"), F.col("image")).alias("query"),
        _item(F.col("t_mode"), F.col("caption"), F.col("caption"), F.col("image")).alias("pos_cand"),
    )


DRAW_BITS = 32               # of the seeded draw
DRAW_BUCKETS = 1 << 12       # ranges of the draw; each is ordered by itself


def epoch_batches(df: DataFrame, id_col: str, batch_size: int, seed: int, epoch: int,
                  buckets: int = DRAW_BUCKETS) -> DataFrame:
    """Seeded shuffle into batches: (.., batch_id, pos); all batches but the last are full.

    Rows are ordered by a seeded draw (the id breaks ties). The draw's range is
    cut into ``buckets``; a row's position is the number of rows in earlier
    buckets plus its place in its own, so no window holds the whole table and
    the batches don't depend on the number of buckets.
    """
    draw = T.hash_draw(id_col, F.lit(seed), F.lit(epoch))
    d = df.withColumn("_draw", draw).withColumn("_bucket", F.floor(F.col("_draw") * buckets / (1 << DRAW_BITS)))
    counts = d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(          # one row per bucket
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", id_col)) - 1
    d = d.withColumn("_place", place).join(before, "_bucket").withColumn("_at", F.col("_before") + F.col("_place"))
    return (d.withColumn("batch_id", F.floor(F.col("_at") / batch_size).cast("bigint"))
             .withColumn("pos", (F.col("_at") % batch_size).cast("int"))
             .drop("_draw", "_bucket", "_place", "_before", "_at"))


def pair_flatten(pairs: DataFrame) -> DataFrame:
    """Flatten pairs of a batch to items: row 2*pos is the query, 2*pos+1 its positive.

    Input has (batch_id, pos, query, pos_cand); output (batch_id, idx, role, txt,
    txt_mask, img_mask) with masks from the padding rule.
    """
    items = pairs.select("batch_id", "pos", F.posexplode(F.array(
        F.struct(F.lit("query").alias("role"), F.col("query.txt").alias("txt"), F.col("query.img").alias("img")),
        F.struct(F.lit("pos_cand").alias("role"), F.col("pos_cand.txt").alias("txt"),
                 F.col("pos_cand.img").alias("img")),
    )).alias("k", "it"))
    return items.select(
        "batch_id", (F.col("pos") * 2 + F.col("k")).alias("idx"), F.col("it.role").alias("role"),
        T.padded_text("it.txt").alias("txt"), T.text_mask("it.txt").alias("txt_mask"),
        T.binary_mask("it.img").alias("img_mask"))


GROUP_ROWS = 1 << 13         # rows of one side that a contrastive tile has, at most
SCORE_TILE = 1 << 19         # scores that a task holds at once
ARGMAX_DIGITS = 10           # scores that round alike are a tie
CONTRAST_SCHEMA = "batch_id long, pos long, target long, top double, rest double, best double, arg long, own double"


def _unit_rows(vectors, eps: float = V.NORM_EPS) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.sqrt(np.square(x).sum(axis=1)), eps)[:, None]


def _rows_by_group(frame: pd.DataFrame) -> dict:
    """Group -> (row numbers of the frame)."""
    return frame.groupby("grp", sort=False).indices


def _online(state: tuple, scores: np.ndarray, cols: np.ndarray, target: np.ndarray) -> tuple:
    """Merge a tile of scores (queries x columns) into running (maximum, scaled sum of exponents, best column, own score)."""
    top, rest, best, arg, own = state
    new_top = np.maximum(top, scores.max(axis=1))
    # a maximum of -inf has nothing summed below it
    rest = rest * np.exp(np.where(np.isfinite(top), top - new_top, 0.0)) + np.exp(scores - new_top[:, None]).sum(axis=1)
    rounded = np.round(scores, ARGMAX_DIGITS)
    tile_best = rounded.max(axis=1)
    tile_arg = np.where(rounded == tile_best[:, None], cols[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (tile_best > best) | ((tile_best == best) & (tile_arg < arg))
    at = cols[None, :] == target[:, None]
    own = np.where(at.any(axis=1), np.where(at, scores, -np.inf).max(axis=1), own)
    return new_top, rest, np.where(better, tile_best, best), np.where(better, tile_arg, arg), own


def _contrast_kernel(scale: float):
    """One matrix product per (group, run of positives); a query's sums go on over the tiles of its group."""
    def run(queries, frames):
        frame, unit, rows_of = queries
        state = {g: [np.full(len(r), -np.inf), np.zeros(len(r)), np.full(len(r), -np.inf), np.full(len(r), -1, np.int64), np.full(len(r), np.nan)]
                 for g, r in rows_of.items()}
        target = frame["target"].to_numpy(np.int64)
        for positives in frames:
            other, cols = _unit_rows(positives["vec"]), positives["col"].to_numpy(np.int64)
            for g, theirs in _rows_by_group(positives).items():
                mine = rows_of.get(g)
                if mine is None:
                    continue
                step = max(1, SCORE_TILE // len(theirs))
                for i in range(0, len(mine), step):
                    rows = mine[i: i + step]
                    scores = unit[rows] @ other[theirs].T * scale
                    merged = _online(tuple(c[i: i + step] for c in state[g]), scores, cols[theirs], target[rows])
                    for column, values in zip(state[g], merged):
                        column[i: i + step] = values
        for g, rows in rows_of.items():
            top, rest, best, arg, own = state[g]
            met = np.isfinite(top)
            if met.any():
                ids = {c: frame[c].to_numpy(np.int64)[rows][met] for c in ("batch_id", "pos", "target")}
                yield pd.DataFrame(ids | {"top": top[met], "rest": rest[met], "best": best[met], "arg": arg[met], "own": own[met]})
    return run


def contrastive_eval(q: DataFrame, p: DataFrame, logit_scale: float, group_col: str = "batch_id",
                     col_offset: Column | None = None, tile_rows: int = GROUP_ROWS) -> DataFrame:
    """In-batch contrastive loss and accuracy per batch.

    q: (batch_id, pos, vec) queries; p: (<group_col>, col, vec) positives, where
    ``col`` is the logit column index of a positive and the target of query
    ``pos`` is ``pos + offset`` (offset 0 in-batch; rank*bs when positives are
    gathered across batches). ``logit_scale`` is the stored (logarithmic) scale of
    the logits. Vectors are eps-normalised here. Loss is the cross
    entropy against the target (stable log-sum-exp); accuracy counts argmax ==
    target, ties to the lowest column.

    Both sides are stored once, many small groups to a tile or a large group in
    several; a task multiplies a tile of queries with tiles of positives and keeps
    a running log-sum-exp and argmax per query, so no (query, positive) pair
    becomes a row. What is shuffled is each item once and one row per query and
    run of tiles.
    """
    target = F.col("pos") if col_offset is None else F.col("pos") + col_offset
    grp = F.col(group_col).cast("long")
    rows = p.count()
    buckets = max(1, -(-2 * rows // tile_rows))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int")
    left = q.select(grp.alias("grp"), F.col("batch_id").cast("long").alias("batch_id"), F.col("pos").cast("long").alias("pos"),
                    target.cast("long").alias("target"), V.as_double("vec").alias("vec")).withColumn("bucket", bucket)
    right = p.select(grp.alias("grp"), F.col("col").cast("long").alias("col"), V.as_double("vec").alias("vec")).withColumn("bucket", bucket)
    found = tiles.meet(
        tiles.tiled(left, "contrast-queries", tile_rows, ["batch_id", "pos"], "bucket"),
        tiles.tiled(right, "contrast-positives", tile_rows, ["grp", "col"], "bucket"),
        lambda frame: (frame, _unit_rows(frame["vec"]), _rows_by_group(frame)), _contrast_kernel(math.exp(logit_scale)), CONTRAST_SCHEMA)
    # a query's parts come from different runs of tiles: their exponents are scaled to the common maximum
    parts = found.groupBy("batch_id", "pos", "target").agg(
        F.max("top").alias("m"), F.collect_list(F.struct("top", "rest")).alias("parts"),
        F.min(F.struct(-F.col("best"), F.col("arg"))).getField("arg").alias("arg"),
        F.max(F.when(~F.isnan("own"), F.col("own"))).alias("own"))
    total = F.aggregate("parts", F.lit(0.0), lambda z, x: z + x["rest"] * F.exp(x["top"] - F.col("m")))
    per_q = parts.select(
        "batch_id", (F.col("m") + F.log(total) - F.col("own")).alias("loss"), F.when(F.col("arg") == F.col("target"), 1.0).otherwise(0.0).alias("correct"))
    return per_q.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.round(F.avg("loss"), 6) + F.lit(0.0)).alias("loss"),
        (F.round(F.avg("correct"), 6) + F.lit(0.0)).alias("accuracy"))


def argmax_accuracy(df: DataFrame, logits: str, label: str, reduction: str = "mean") -> DataFrame | None:
    """argmax(logits) == label per row ('none') or its mean ('mean'); other values give None."""
    correct = (F.array_position(logits, F.array_max(logits)) - 1 == F.col(label)).cast("double")
    if reduction == "none":
        return df.withColumn("correct", correct)
    if reduction == "mean":
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(correct).cast("bigint").alias("n_correct"),
                      F.avg(correct).alias("accuracy"))
    return None


def encode_pair_items(batched_pairs: DataFrame, text_encoder=None, image_encoder=None,
                      fusion: str = "sum", text_weight: float = 0.5,
                      mlp_weights=None) -> tuple[DataFrame, DataFrame]:
    """Encode both items of every batched pair once: (queries, positives) for ``contrastive_eval``.

    Items are stacked (one row per item), each base input is encoded in one pass,
    missing inputs are padded and gated after encoding, then fused.
    """
    from quiver.operators import encode, views
    items = batched_pairs.select("batch_id", "pos", F.explode(F.array(
        F.struct(F.lit("query").alias("role"), F.col("query.txt").alias("txt"), F.col("query.img").alias("img")),
        F.struct(F.lit("pos_cand").alias("role"), F.col("pos_cand.txt").alias("txt"),
                 F.col("pos_cand.img").alias("img")))).alias("it"))
    items = items.select("batch_id", "pos", "it.role", "it.txt", "it.img",
                         T.text_mask("it.txt").alias("txt_mask"), T.binary_mask("it.img").alias("img_mask"))
    items = encode.encode_batch(items, "txt", "txt_vec", text_encoder or encode.hashing_encoder(salt=encode.TEXT_SALT))
    items = encode.encode_batch(items, "img", "img_vec",
                                image_encoder or encode.hashing_encoder(salt=encode.IMAGE_SALT))
    img = V.mask_gate("img_vec", "img_mask")
    txt = V.mask_gate("txt_vec", "txt_mask")
    vec = views.fused(img, txt, fusion, text_weight, mlp_weights)
    fused = items.select("batch_id", "pos", "role", vec.alias("vec"))
    q = fused.where(F.col("role") == "query").select("batch_id", "pos", "vec")
    p = fused.where(F.col("role") == "pos_cand").select("batch_id", F.col("pos").alias("col"), "vec")
    return q, p
