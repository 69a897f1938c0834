"""Query and candidate views, masks, and the three-modality fan-out.

A corpus record ``(id, image, caption, questions)`` becomes an item
``(id, txt, img, txt_mask, img_mask)`` per modality: ``it`` keeps text and
image, ``i`` keeps the image with empty text, ``t`` keeps the text without image.
Candidate views use the caption, query views the first valid question (a
``questions`` array, or a precomputed ``question`` column).
Everything is a projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.functions import vectors as V

MODALITIES = T.MODALITIES


def _item(df: DataFrame, txt: Column, mode: str, keep: list[str]) -> DataFrame:
    if mode == "it":
        t, img = txt, F.col("image")
    elif mode == "i":
        t, img = F.lit(""), F.col("image")
    elif mode == "t":
        t, img = txt, F.lit(None).cast("binary")
    else:
        t, img = F.lit(""), F.lit(None).cast("binary")
    return df.select(*keep, F.lit(mode).alias("modality"), t.alias("txt"), img.alias("img"))


def candidate_view(corpus: DataFrame, mode: str, keep: list[str] | None = None) -> DataFrame:
    """Candidate item per record; an unknown mode gives empty text and no image (no error)."""
    return _item(corpus, F.col("caption"), mode, keep or ["id"])


def query_view(corpus: DataFrame, mode: str, keep: list[str] | None = None) -> DataFrame:
    """Query item per record with the first valid question as text."""
    if mode not in MODALITIES:
        raise ValueError(f"a query shows one of {MODALITIES}, not {mode!r}")
    return _item(corpus, T.question_of(corpus), mode, keep or ["id"])


def with_masks(items: DataFrame, txt: str = "txt", img: str = "img") -> DataFrame:
    """Pad and mask: null or '' text -> ('', 0); null image -> mask 0."""
    return (items.withColumn("txt_mask", T.text_mask(txt))
                 .withColumn("img_mask", T.binary_mask(img))
                 .withColumn(txt, T.padded_text(txt)))


def valid_queries(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split masked items into (accepted, rejected): a query needs text or image."""
    ok = (F.col("txt_mask") == 1) | (F.col("img_mask") == 1)
    return items.where(ok), items.where(~ok)


def fanout_items(corpus: DataFrame, side: str = "cand", keep: list[str] | None = None) -> DataFrame:
    """All three views of each record in one pass (order i, t, it), with masks."""
    keep = keep or ["id"]
    txt = F.col("caption") if side == "cand" else T.question_of(corpus)
    views = F.array(
        F.struct(F.lit("i").alias("modality"), F.lit("").alias("txt"), F.col("image").alias("img")),
        F.struct(F.lit("t").alias("modality"), txt.alias("txt"), F.lit(None).cast("binary").alias("img")),
        F.struct(F.lit("it").alias("modality"), txt.alias("txt"), F.col("image").alias("img")),
    )
    out = corpus.select(*keep, F.posexplode(views).alias("view_pos", "v")).select(
        *keep, "view_pos", "v.modality", "v.txt", "v.img")
    return with_masks(out)


# ---- vector fan-out -----------------------------------------------------------

FUSIONS = ("sum", "weight", "mlp")


def fused(img: Column, txt: Column, fusion: str, text_weight: float, mlp_weights=None) -> Column:
    """The fusion switch: 'sum', 'weight' (text weight, clamped) or 'mlp' (given weights)."""
    if fusion == "sum":
        return V.fuse_sum(img, txt)
    if fusion == "weight":
        return V.fuse_weighted(img, txt, text_weight)
    if fusion == "mlp":
        if mlp_weights is None:
            raise ValueError("mlp fusion needs weights")
        from quiver.operators.encode import fuse_mlp
        return fuse_mlp(txt, img, mlp_weights)
    raise ValueError(f"Unknown fusion: {fusion}")


def modality_vectors(base: DataFrame, fusion: str = "sum", text_weight: float = 0.5,
                     keep: list[str] | None = None, modalities: list[str] | None = None,
                     mlp_weights=None) -> DataFrame:
    """Three modality vectors per record from its base image and text vectors.

    Each base modality is encoded once; a view gates the vector of a modality
    it lacks (after encoding, so a padded input gives a zero vector), then fuses.
    ``base`` has (id, img_vec, txt_vec, img_mask, txt_mask). Output: keep.. +
    (modality, vec ARRAY<DOUBLE>), not normalised.
    """
    keep = keep or ["id"]
    mods = modalities or MODALITIES
    img = V.mask_gate("img_vec", "img_mask")
    txt = V.mask_gate("txt_vec", "txt_mask")
    zero_img = V.mask_gate("img_vec", F.lit(0))
    zero_txt = V.mask_gate("txt_vec", F.lit(0))
    per_mod = {
        "i": fused(img, zero_txt, fusion, text_weight, mlp_weights),
        "t": fused(zero_img, txt, fusion, text_weight, mlp_weights),
        "it": fused(img, txt, fusion, text_weight, mlp_weights),
    }
    views = F.array(*[F.struct(F.lit(m).alias("modality"), per_mod[m].alias("vec")) for m in mods])
    return base.select(*keep, F.explode(views).alias("v")).select(*keep, "v.modality", "v.vec")


def unit_modality_vectors(base: DataFrame, fusion: str = "sum", text_weight: float = 0.5,
                          keep: list[str] | None = None, modalities: list[str] | None = None) -> DataFrame:
    """Modality vectors, zero-safe L2-normalised (the searchable form)."""
    return V.with_l2_normalized(modality_vectors(base, fusion, text_weight, keep, modalities), "vec")


# ---- questions in long form -----------------------------------------------------

def sample_question_long(records: DataFrame, questions: DataFrame, draw: Column, out: str = "sampled") -> DataFrame:
    """A seeded draw among each record's valid questions, kept in long form.

    ``questions`` is (id, turn, question) with valid questions only. The pick is
    ``draw mod n`` over the questions ordered by turn; n comes from a partial
    count and positions from the chunked row index, so a record with very many
    questions is never gathered into one row or one window. No question: ''.
    """
    from quiver.operators.runlog import row_index
    counts = questions.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    r = records.join(counts, "id", "left").withColumn(
        "_pick", F.when(F.col("_n") > 0, draw % F.col("_n")))
    ranked = row_index(questions.select("id", "turn", "question"), ["id"], "turn").select(
        "id", F.col("_r").alias("_pick"), F.col("question").alias("_sq"))
    return (r.join(ranked, ["id", "_pick"], "left")
             .withColumn(out, F.coalesce("_sq", F.lit(""))).drop("_n", "_pick", "_sq"))
