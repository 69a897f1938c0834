"""Session helpers.

A cluster hands us its session; we only fill in settings that are unset, so a
job never overrides what the cluster operator chose (shuffle partitions,
checkpoint folder, memory).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the engine relies on. Applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quiver") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the existing one."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUIVER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Kernels are pickled by reference; a worker started from another folder than
    the driver could not import them otherwise.
    """
    context = spark.sparkContext
    if getattr(context, "_quiver_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quiver-code-"), "quiver.zip")   # the driver serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._quiver_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in spark.checkpoint.dir.

    Set our own only where it is unset (local tests); never override a cluster's.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quiver-ckpt-")   # one machine: driver and tasks share its folders
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


SPREAD_BYTES = 16 << 20          # a core's share of a table below which it is dealt out anew


def spread(df):
    """Round-robin a small table over all cores before CPU-heavy row work.

    A small or single file is read as one or a few partitions; encoders or dense
    search would then run on a few cores only. The size is the optimizer's
    estimate, so nothing runs to find it; large inputs have partitions enough and
    are left as they are (no shuffle).
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(par) if size < par * SPREAD_BYTES else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path to write to, in a fresh folder below the shared checkpoint folder that is deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)               # takes note of existing folders only
    return f"{path}/data"


def materialize(df):
    """Write a table that several passes will read, and read it back (cuts lineage).

    The table goes to a fresh folder under spark.checkpoint.dir (the cluster's
    shared folder) as Parquet: computed once, readable after an executor loss,
    and later scans get column pruning and filter pushdown. A small table is
    spread first so the written table has a file per core; a large one keeps its
    partitioning. The folder is deleted when the driver ends: a lazy result may
    read it until then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "quiver-table")
    spread(df).write.parquet(path)
    return spark.read.parquet(path)
