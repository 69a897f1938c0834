"""Search as a query stream against a static pool (Structured Streaming).

Queries arrive as files; each micro-batch (bounded by ``maxFilesPerTrigger``)
is searched with the exact top-k operator, so the micro-batch is the broadcast
query block and the pool is scanned once per batch. Results are written under
``batch_id=<n>`` with overwrite, so a replayed batch (after a failure) rewrites
the same folder: the sink is idempotent, the checkpoint records progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators import knn

QUERY_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("q_mod", T.StringType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])


def start_stream_search(spark: SparkSession, query_dir: str, pool: DataFrame, k: int, out_dir: str,
                        checkpoint: str, files_per_trigger: int = 1, available_now: bool = True,
                        metric: str = "ip"):
    """Start the streaming search; returns the StreamingQuery."""
    stream = (spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(query_dir))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # an empty micro-batch yields an empty folder: no extra job to test for it
        hits = knn.search_topk(batch, pool, k, metric=metric)
        (hits.select("qid", "q_mod", "c_mod", "doc_id", "score", F.col("rank").cast("int").alias("rank"))
             .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_stream_search(spark: SparkSession, query_dir: str, pool: DataFrame, k: int, out_dir: str,
                      checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """Process every query file present now, then return all results."""
    q = start_stream_search(spark, query_dir, pool, k, out_dir, checkpoint, files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out_dir).drop("batch_id")
