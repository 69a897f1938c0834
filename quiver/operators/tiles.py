"""Tiles: tables stored once, whose files meet in pairs without a shuffle.

A table is written as Parquet files of bounded size below the shared checkpoint
folder (:func:`tiled`). Work on pairs of tiles is a small list of jobs, each one
left tile and a run of right tiles; Spark deals the list out, and a task reads its
tiles by path (:func:`meet`). So every row is written once, however many partners
its tile has, and what goes through a shuffle is the list and what the kernel
yields.

Tiles are opened with Arrow's file systems. Where the shared folder is on one that
only Hadoop can open, the same pairs meet in a co-group instead, which copies rows
to their partners; the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import checkpoint_dir, materialize, scratch_path, spread

# Fixed values.
JOBS_A_CORE = 8              # jobs that a core should get at least, where there are tiles enough
TASKS_A_CORE = 8             # tasks that the jobs of very many small tiles share
READ_BYTES = 1 << 20         # of a column of a file that is read in frames, held at once


@dataclass(frozen=True)
class Tiled:
    """A stored table and its tiles: (key, files), the key null where the table isn't cut by one."""
    df: DataFrame
    key: str | None
    ids: tuple[str, ...]
    rows: int
    tiles: list[tuple[int | None, list[str]]] | None = field(default=None)


# ---- files --------------------------------------------------------------------------

def _opened(path: str):
    """(file system, path in it) of a path as Hadoop writes it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return filesystems.LocalFileSystem(), "/" + rest.lstrip("/")
    if path.startswith("/"):
        return filesystems.LocalFileSystem(), path
    return filesystems.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def readable(spark: SparkSession) -> bool:
    """Whether tasks can open files of the shared folder by path."""
    try:
        _opened(checkpoint_dir(spark))
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def read_tile(files: Iterable[str], columns: list[str] | None = None) -> pd.DataFrame:
    """The rows of a tile, all columns unless said; list columns are arrays."""
    parts = []
    for name in files:
        system, path = _opened(name)
        with system.open_input_file(path) as file:
            parts.append(pq.ParquetFile(file).read(columns, use_threads=False))
    return pa.concat_tables(parts).to_pandas()


def read_frames(files: Iterable[str], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a tile a frame at a time, ``rows`` at most; what follows fills up a small file's."""
    held, n = [], 0
    for name in files:
        system, path = _opened(name)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file, buffer_size=READ_BYTES, pre_buffer=False).iter_batches(rows, use_threads=False):
                if held and n + len(batch) > rows:
                    yield pa.Table.from_batches(held).to_pandas()
                    held, n = [], 0
                held.append(batch)
                n += len(batch)
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def _together(files: list[tuple[str, int]], rows: int) -> list[list[str]]:
    """Neighbouring files, as many together as have ``rows`` rows at most."""
    found, n = [], 0
    for name, size in sorted(files):
        if found and n + size <= rows:
            found[-1].append(name)
            n += size
        else:
            found.append([name])
            n = size
    return found


def tiled(df: DataFrame, name: str, rows: int, ids: list[str], key: str | None = None, by_path: bool | None = None) -> Tiled:
    """Store ``df`` in tiles of at most ``rows`` rows; with ``key`` (an integer column, not null) each of one key only.

    Rows are gathered by key once, and Spark splits a frequent key over several
    tasks while it does so (rebalance). ``ids`` tell rows apart well enough to
    spread them. What reaches the driver is one entry per file.
    """
    spark = df.sparkSession
    if not (readable(spark) if by_path is None else by_path):
        return Tiled(materialize(df), key, tuple(ids), rows)
    path = scratch_path(spark, f"quiver-{name}")
    writer = (df.hint("rebalance", key) if key else spread(df)).write.option("maxRecordsPerFile", rows)
    (writer.partitionBy(key) if key else writer).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if key:                      # rebalancing has left few files a key
        names = sorted(unquote(name) for name in stored.inputFiles())
        found = [(int(name.split(f"/{key}=")[1].split("/")[0]), [name]) for name in names]
    else:
        counted = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
        found = [(None, group) for group in _together([(unquote(r["file"]), r["n"]) for r in counted], rows)]
    return Tiled(stored, key, tuple(ids), rows, found)


# ---- pairs --------------------------------------------------------------------------

def jobs_of(left: list, right: list, cores: int) -> list[tuple[list[str], list[list[str]]]]:
    """(files of a left tile, files of each of a run of right tiles): every left tile with all right tiles of its key.

    A left tile's partners are cut into as few runs as keep all cores busy, since
    a job reads its left tile once and merges over its run.
    """
    by_key: dict[int | None, list[list[str]]] = {}
    for key, files in right:
        by_key.setdefault(key, []).append(files)
    partners = [(files, by_key.get(key, [])) for key, files in left]
    run = max(1, sum(len(p) for _, p in partners) // (JOBS_A_CORE * cores))
    return [(files, p[i: i + run]) for files, p in partners for i in range(0, len(p), run)]


def _listed(spark: SparkSession, tasks: int, **columns: pa.Array) -> DataFrame:
    """A list of jobs, dealt to tasks; it goes to the JVM by Arrow, so no Python worker is started to read it."""
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pa.table({"job": pa.array(range(n), pa.int32()), **columns})).repartitionByRange(tasks, "job")


def meet(left: Tiled, right: Tiled, prepare: Callable, kernel: Callable, schema: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """``kernel(prepare(left rows), iterator of frames of right rows)`` for every left tile and all right tiles of its key.

    The kernel yields frames of ``schema``. What it finds for one left tile may
    come in several parts, one a run of right tiles, which the caller merges.
    With ``frames`` (rows of the left, of the right) a task holds no whole tile:
    the kernel gets the rows of a left tile in frames of so many at most, each
    with all rows of the run, in frames too.
    """
    spark = left.df.sparkSession
    if left.tiles is None or right.tiles is None:
        return _meet_in_groups(left, right, prepare, kernel, schema)
    cores = spark.sparkContext.defaultParallelism
    jobs = jobs_of(left.tiles, right.tiles, cores)
    if not jobs:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                if frames is None:
                    yield from kernel(prepare(read_tile(a)), (read_tile(files) for files in b))
                    continue
                for part in read_frames(a, frames[0]):
                    yield from kernel(prepare(part), read_frames([name for files in b for name in files], frames[1]))
    a, b = pa.array([a for a, _ in jobs], pa.list_(pa.string())), pa.array([b for _, b in jobs], pa.list_(pa.list_(pa.string())))
    return _listed(spark, min(len(jobs), TASKS_A_CORE * cores), a=a, b=b).mapInPandas(run, schema)


def deal(spark: SparkSession, jobs: list[tuple[list[str], str]], run: Callable, schema: str) -> DataFrame:
    """``run(rows of a tile, word)`` for every job (files of a tile, word); it yields frames of ``schema``."""
    if not jobs:
        return spark.createDataFrame([], schema)

    def each(batches):
        for batch in batches:
            for files, word in zip(batch["files"], batch["word"]):
                yield from run(read_tile(files), word)
    files, word = pa.array([files for files, _ in jobs], pa.list_(pa.string())), pa.array([word for _, word in jobs], pa.string())
    return _listed(spark, len(jobs), files=files, word=word).mapInPandas(each, schema)


def _meet_in_groups(left: Tiled, right: Tiled, prepare: Callable, kernel: Callable, schema: str) -> DataFrame:
    """The same by co-group: each side of a key is cut into parts by a hash, and its rows go to every part of the other side."""
    spark, key = left.df.sparkSession, left.key or "_key"

    def parts(side: Tiled, name: str) -> tuple[DataFrame, DataFrame]:
        df = side.df if side.key else side.df.withColumn(key, F.lit(0))
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()             # one row a key
        table = spark.createDataFrame([(r[key], max(1, math.ceil(r["n"] / side.rows))) for r in counts], f"{key} int, {name} int")
        return df, table
    (a, a_parts), (b, b_parts) = parts(left, "_na"), parts(right, "_nb")
    both = F.broadcast(a_parts.join(b_parts, key))
    own = {n: F.pmod(F.xxhash64(*side.ids), F.col(n)).cast("int") for n, side in (("_na", left), ("_nb", right))}
    every = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("_na", "_nb")}
    a = a.join(both, key).withColumn("_a", own["_na"]).withColumn("_b", every["_nb"]).drop("_na", "_nb")
    b = b.join(both, key).withColumn("_b", own["_nb"]).withColumn("_a", every["_na"]).drop("_na", "_nb")
    names = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"long": "int64", "int": "int32", "double": "float64", "string": "object"}
    empty = pd.DataFrame({n: pd.Series([], dtype=kinds[t]) for n, t in names})

    def group(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = list(kernel(prepare(x), iter([y]))) if len(x) and len(y) else []
        return pd.concat(out, ignore_index=True) if out else empty
    keys = [key, "_a", "_b"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(group, schema)
