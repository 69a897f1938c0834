"""Sinks: pool table, embedding store, report TSV."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import half as H


def write_pool(pool: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unit vectors as Parquet, one directory per modality, sorted by id inside files
    (min/max statistics then prune id lookups)."""
    (pool.repartitionByRange("c_mod", "doc_id").sortWithinPartitions("c_mod", "doc_id")
         .write.mode(mode).partitionBy("c_mod").parquet(path))


def write_embeddings(store: DataFrame, path: str, mode: str = "overwrite", half: bool = False) -> None:
    """Embedding store (side, split, modality, id, vector): one file set per side x split x modality.

    ``half`` stores two bytes an element, packed in a binary column whose metadata
    has the dimension.
    """
    stored = H.with_packed(store, "vector") if half else store
    stored.write.mode(mode).partitionBy("side", "split", "modality").parquet(path)


def read_embeddings(spark, path: str, side: str, split: str, modalities: list[str] | None = None) -> DataFrame:
    """(id, modality, vec) of one side and split, of either kind of store; only their folders are read."""
    stored = spark.read.parquet(path)
    vector = H.unpacked(stored, "vector") if H.is_packed(stored, "vector") else F.col("vector")
    found = stored.where((F.col("side") == side) & (F.col("split") == split))
    if modalities is not None:
        found = found.where(F.col("modality").isin(modalities))
    return found.select("id", "modality", vector.cast("array<double>").alias("vec"))


def report_file_name(now: datetime | None = None) -> str:
    return f"evaluation_results_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.tsv"


def write_report_tsv(report: DataFrame, directory: str) -> str | None:
    """Tab-separated report with header in a timestamped folder; an empty report writes nothing.

    The report has one row per (task, modality pair), so a single output file is cheap.
    """
    if report.isEmpty():
        return None
    path = f"{directory.rstrip('/')}/{report_file_name()}"
    (report.coalesce(1).write.mode("errorifexists")
           .option("sep", "\t").option("header", True).csv(path))
    return path


def read_report_tsv(spark, path: str, schema=None) -> DataFrame:
    """Read a written report back (a declared schema keeps the column types exact)."""
    r = spark.read.option("sep", "\t").option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)

