"""Corpus to report: encode each base input once, build both sides, evaluate.

The candidate side shows captions, the query side questions; both show the same
image. So a corpus is encoded with three passes (caption text, question text,
image), written once, and the six views (three per side) are projections of
that table. The identity judgments of the judgment generator ("record i is
relevant to query i") close the loop, as in the reference's own evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.operators import encode, views
from quiver.plans import evaluate as E
from quiver.session import materialize
from quiver.sources import qrels as Q
from quiver.sources import sinks


def encode_corpus(corpus: DataFrame, text_encoder=None, image_encoder=None,
                  batch_size: int = encode.ENCODE_BATCH) -> DataFrame:
    """(id, cap_vec, q_vec, img_vec, cap_mask, q_mask, img_mask), written once."""
    d = corpus.select("id", F.col("caption").alias("cap"), T.question_of(corpus).alias("q"),
                      F.col("image").alias("img"))
    d = (d.withColumn("cap_mask", T.text_mask("cap")).withColumn("q_mask", T.text_mask("q"))
          .withColumn("img_mask", T.binary_mask("img")))
    te = text_encoder or encode.hashing_encoder(salt=encode.TEXT_SALT)
    ie = image_encoder or encode.hashing_encoder(salt=encode.IMAGE_SALT)
    d = encode.encode_batch(d, "cap", "cap_vec", te, batch_size)
    d = encode.encode_batch(d, "q", "q_vec", te, batch_size)
    d = encode.encode_batch(d, "img", "img_vec", ie, batch_size)
    return materialize(d.select("id", "cap_vec", "q_vec", "img_vec", "cap_mask", "q_mask", "img_mask"))


def side_views(encoded: DataFrame, side: str, fusion: str = "sum", text_weight: float = 0.5,
               mlp_weights=None) -> DataFrame:
    """The three modality vectors of one side (cand: caption, query: question)."""
    txt, mask = ("cap_vec", "cap_mask") if side == "cand" else ("q_vec", "q_mask")
    base = encoded.select("id", F.col(txt).alias("txt_vec"), "img_vec", F.col(mask).alias("txt_mask"), "img_mask")
    return views.modality_vectors(base, fusion, text_weight, mlp_weights=mlp_weights)


def store_embeddings(encoded: DataFrame, path: str, split: str = "test", fusion: str = "sum",
                     text_weight: float = 0.5, mlp_weights=None) -> None:
    """The embedding store: one file set per side x split x modality."""
    parts = []
    for side in ("query", "cand"):
        v = side_views(encoded, side, fusion, text_weight, mlp_weights)
        parts.append(v.select(F.lit(side).alias("side"), F.lit(split).alias("split"), "modality", "id",
                              F.col("vec").cast("array<float>").alias("vector")))
    sinks.write_embeddings(parts[0].unionByName(parts[1]), path)


def evaluate_corpus(corpus: DataFrame, judgment_lines: DataFrame | None = None, cfg: E.EvalConfig | None = None,
                    text_encoder=None, image_encoder=None, fusion: str = "sum",
                    text_weight: float = 0.5, mlp_weights=None) -> DataFrame:
    """Long report for a corpus; without judgments, the identity judgments of every record."""
    encoded = encode_corpus(corpus, text_encoder, image_encoder)
    pool = E.build_pool(side_views(encoded, "cand", fusion, text_weight, mlp_weights))
    queries = E.query_table(side_views(encoded, "query", fusion, text_weight, mlp_weights))
    if judgment_lines is None:
        # ids from the written encoding, not from the corpus plan (read once, not recomputed)
        lines = Q.generate_identity_qrels(encoded.select("id"), "id")
        judgment_lines = lines.select(F.col("id").alias("line_no"), "value")
    return E.evaluate(queries, pool, judgment_lines, cfg)
