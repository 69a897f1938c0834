"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_path


def store(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives lost executors. Returns the table and its
    path, so that a caller can :func:`drop` it as soon as nothing reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"quiver-llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def utf8_list(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null becomes the empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have in any case of letters: the given ones, marked and lengthened until they are new."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's JVM finds a shuffle unreachable, which without
    a nudge may be long after the files of several steps fill the disks.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()
