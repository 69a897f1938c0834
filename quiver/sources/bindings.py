"""Bindings from the driver tables to the engine's fixtures.

The driver tables hold no images or judgments, so each fixture is derived from
a table by a fixed rule (stated in FIXTURES.md section 3). Every binding is a
lazy projection of the whole table: no row subset is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.functions import vectors as V
from quiver.sources.tables import table

# Fixed values of the bindings.
TEXT_MIX = (0.8, 0.6)        # txt_vec[i] = 0.8*v[i] + 0.6*v[(i+1) mod d]
MISSING_TEXT_EVERY = 70      # rows whose id is a multiple of this have no text (mask 0)
DEFAULT_SPLIT = "test"


def base_vectors(emb: DataFrame) -> DataFrame:
    """(id, label, img_vec, txt_vec, img_mask, txt_mask) from ``embeddings``.

    The image vector is the stored embedding; the text vector mixes each element
    with its right neighbour (wrapping), so the two modalities differ but correlate.
    Text is marked missing on a fixed set of ids so zero vectors occur.
    """
    a, b = TEXT_MIX
    v = V.as_double("embedding")
    txt = F.transform(v, lambda x, i: F.lit(a) * x + F.lit(b) * F.element_at(v, (i + 1) % F.size(v) + 1))
    return emb.select(
        F.col("vec_id").alias("id"),
        F.col("label"),
        v.alias("img_vec"),
        txt.alias("txt_vec"),
        F.lit(1).alias("img_mask"),
        F.when(F.col("vec_id") % MISSING_TEXT_EVERY == 0, F.lit(0)).otherwise(F.lit(1)).alias("txt_mask"),
    )


def load_base_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_vectors(table(spark, sf_dir, "embeddings"))


def qrels_lines(emb: DataFrame) -> DataFrame:
    """Judgment text lines ``qid 0 doc rel task`` with rel = label % 3 and task = label % 2.

    ``line_no`` carries file order (Spark has no row order); rel 0 lines exercise
    the 'no judgment but task known' path.
    """
    return emb.select(
        F.col("vec_id").alias("line_no"),
        F.concat_ws(" ", F.col("vec_id").cast("string"), F.lit("0"), F.col("vec_id").cast("string"),
                    (F.col("label") % 3).cast("string"), (F.col("label") % 2).cast("string")).alias("value"),
    )


def user_questions(conversations: DataFrame) -> DataFrame:
    """Valid user questions in long form (id, turn, question): stripped, non-blank."""
    q = T.strip_ws(F.col("text"))
    return (conversations.where(F.col("role") == "user")
            .select(F.col("conv_id").alias("id"), "turn", q.alias("question"))
            .where(F.col("question").isNotNull() & (F.col("question") != "")))


def corpus(conversations: DataFrame) -> DataFrame:
    """Corpus records from ``conversations``: one per conversation.

    caption = first assistant text (null when none), image = UTF-8 bytes of the
    caption as an opaque stand-in, question = first valid user question ('' when
    none). Both are partial ``min`` aggregates over (turn, text) structs, so a
    conversation with very many turns is never gathered into one row; the other
    questions stay in long form (``user_questions``) for sampling.
    """
    valid_q = T.strip_ws(F.col("text"))
    is_q = (F.col("role") == "user") & valid_q.isNotNull() & (valid_q != "")
    agg = conversations.groupBy("conv_id").agg(
        F.min(F.when(is_q, F.struct("turn", valid_q.alias("text")))).alias("_q"),
        F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("_a"),
    )
    return agg.select(
        F.col("conv_id").alias("id"),
        F.lit(DEFAULT_SPLIT).alias("split"),
        F.encode(F.col("_a.text"), "UTF-8").alias("image"),
        F.col("_a.text").alias("caption"),
        F.coalesce(F.col("_q.text"), F.lit("")).alias("question"),
    )


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(table(spark, sf_dir, "conversations"))


def load_user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_questions(table(spark, sf_dir, "conversations"))


def metric_log(events: DataFrame) -> DataFrame:
    """Training metric log from ``events``: run = user, metric = event type, step = event id."""
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("step"),
        F.col("value").cast("double").alias("value"),
        F.lit(1).cast("bigint").alias("n"),
    )


# The phase each event type stands for in the per-epoch statistics.
PHASE_OF_METRIC = {"click": "train", "view": "train", "purchase": "val", "signup": "val", "error": "test"}


def epoch_stats(events: DataFrame) -> DataFrame:
    """Per-epoch statistics (run_id, epoch, metric, phase, value): epoch = day of month of ts,
    value = mean of the events' values (exact decimal sum / count)."""
    e = events.select(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("epoch"),
                      F.col("event_type").alias("metric"), F.col("value").cast("decimal(38,12)").alias("v"))
    phase = F.create_map(*[x for kv in PHASE_OF_METRIC.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (e.groupBy("run_id", "epoch", "metric")
             .agg((F.sum("v").cast("double") / F.count(F.lit(1))).alias("value"))
             .withColumn("phase", F.coalesce(phase[F.col("metric")], F.lit("train"))))
