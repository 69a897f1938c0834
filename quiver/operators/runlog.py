"""Training-run meters as window jobs over a metric log (run_id, metric, step, value, n).

A meter keeps the last 20 values of a series (median, mean, max, latest) and a
running total and count (global mean). Here a series is a window key and steps
order it. One key may hold a large share of all rows, so no window is ever
partitioned by the key alone:

* a row's index in its series comes from per-chunk counts (chunk = step range,
  a partial aggregate) plus a prefix sum over chunks, plus a row number inside
  the chunk (a window bounded by the chunk width);
* 20-row frames run over fixed blocks of row indexes; the 19 rows before a
  block are copied into it as a halo, so each window partition holds at most
  block + 19 rows;
* running totals, counts and minima are prefix aggregates: per-chunk partials,
  a prefix over chunks, then a running aggregate inside the chunk.

Sums are exact DECIMAL so every partitioning (and every engine) gives the same
means; the mean is the DOUBLE sum divided by the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
WINDOW_SIZE = 20
EXACT = "decimal(38,12)"
DEFAULT_CHUNK_STEPS = 1 << 16    # step range of one chunk (rows per chunk <= this for unique steps)
DEFAULT_BLOCK_ROWS = 1 << 14     # rows per frame block
CHUNKS_TOGETHER = 1 << 12        # chunks whose prefix is one window


def _chunked(df: DataFrame, order: str, chunk_steps: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_steps)).cast("bigint"))


def _prefix_over_chunks(parts: DataFrame, keys: list[str], cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Exclusive prefix aggregates over the chunks of each key: out -> ("sum" or "min", column).

    Two levels: a prefix over the chunks inside a group of CHUNKS_TOGETHER, and
    one over the groups, so a series of very many chunks isn't one window.
    """
    fold = {"sum": F.sum, "min": F.min}
    d = parts.withColumn("_group", F.floor(F.col("_chunk") / CHUNKS_TOGETHER).cast("bigint"))
    earlier = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*keys, "_group").orderBy("_chunk").rowsBetween(*earlier)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(*earlier)
    totals = d.groupBy(*keys, "_group").agg(*[fold[f](c).alias(f"_t{n}") for n, (f, c) in cols.items()])
    groups = totals.select(*keys, "_group", *[fold[f](f"_t{n}").over(outer).alias(f"_o{n}") for n, (f, _) in cols.items()])
    chunks = d.select(*keys, "_chunk", "_group", *[fold[f](c).over(inner).alias(f"_i{n}") for n, (f, c) in cols.items()])

    def both(n: str, f: str) -> Column:
        i, o = F.col(f"_i{n}"), F.col(f"_o{n}")
        return F.least(i, o) if f == "min" else F.coalesce(i + o, i, o)      # least passes over nulls
    return chunks.join(groups, [*keys, "_group"], "left").select(
        *keys, "_chunk", *[both(n, f).alias(n) for n, (f, _) in cols.items()])


def row_index(df: DataFrame, keys: list[str], order: str, tiebreak: list[str] | None = None,
              chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Adds ``_r``: the 0-based position of each row in its series ordered by ``order``."""
    d = _chunked(df, order, chunk_steps)
    counts = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = _prefix_over_chunks(counts, keys, {"_before": ("sum", "_cnt")})
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, *(tiebreak or []))
    d = d.withColumn("_within", F.row_number().over(w) - 1)
    return (d.join(before, [*keys, "_chunk"], "left")
             .withColumn("_r", F.coalesce("_before", F.lit(0)) + F.col("_within"))
             .drop("_before", "_within", "_chunk"))


def _exact(c: str) -> Column:
    return F.col(c).cast(EXACT)


def rolling_meter(log: DataFrame, keys: list[str], order: str = "step", value: str = "value",
                  size: int = WINDOW_SIZE, block_rows: int = DEFAULT_BLOCK_ROWS,
                  chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Median (lower middle), mean, max and latest value over the last ``size`` values.

    Output: keys + (order, value, window_n, median, avg, max).
    """
    if block_rows < size:
        raise ValueError("block_rows must be >= window size")
    d = row_index(log.select(*keys, order, value), keys, order, chunk_steps=chunk_steps)
    # each row belongs to its block; the last size-1 rows of a block are also copied
    # into the next block as its halo (one pass: explode, no union)
    blk = F.floor(F.col("_r") / block_rows).cast("bigint")
    in_tail = F.col("_r") % block_rows >= block_rows - (size - 1)
    copies = F.when(in_tail, F.array(F.struct(blk.alias("b"), F.lit(False).alias("h")),
                                     F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    copies = copies.otherwise(F.array(F.struct(blk.alias("b"), F.lit(False).alias("h"))))
    u = d.select("*", F.explode(copies).alias("_c")).select(
        "*", F.col("_c.b").alias("_blk"), F.col("_c.h").alias("_halo")).drop("_c")
    w = Window.partitionBy(*keys, "_blk").orderBy("_r").rowsBetween(-(size - 1), 0)
    n = F.count(F.lit(1)).over(w)
    vals = F.array_sort(F.collect_list(value).over(w))
    out = u.select(
        *keys, order, value, "_halo",
        n.alias("window_n"),
        F.element_at(vals, F.ceil(n / 2).cast("int")).alias("median"),
        (F.sum(_exact(value)).over(w).cast("double") / n).alias("avg"),
        F.max(value).over(w).alias("max"),
    )
    return out.where(~F.col("_halo")).drop("_halo")


def _running(log: DataFrame, keys: list[str], order: str, chunk_steps: int,
             partial: dict[str, Column], combine: dict[str, tuple[str, str]], within: dict[str, Column],
             tiebreak: list[str] | None = None) -> DataFrame:
    """Generic prefix aggregate: per-chunk partials, exclusive prefix over chunks, running within chunk."""
    d = _chunked(log, order, chunk_steps)
    parts = d.groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in partial.items()])
    before = _prefix_over_chunks(parts, keys, combine)
    w = (Window.partitionBy(*keys, "_chunk").orderBy(order, *(tiebreak or []))
         .rowsBetween(Window.unboundedPreceding, 0))
    d = d.select("*", *[c.over(w).alias(n) for n, c in within.items()])
    return d.join(before, [*keys, "_chunk"], "left").drop("_chunk")


def cumulative_avg(log: DataFrame, keys: list[str], order: str = "step", value: str = "value",
                   weight: str = "n", chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """Count-weighted mean of everything up to and including each step (running total / count)."""
    d = log.withColumn("_vn", (F.col(value) * F.col(weight)).cast(EXACT))
    r = _running(
        d, keys, order, chunk_steps,
        partial={"_pt": F.sum("_vn"), "_pn": F.sum(weight)},
        combine={"_bt": ("sum", "_pt"), "_bn": ("sum", "_pn")},
        within={"_wt": F.sum("_vn"), "_wn": F.sum(weight)},
    )
    total = F.coalesce("_bt", F.lit(0).cast(EXACT)) + F.col("_wt")
    count = F.coalesce("_bn", F.lit(0)) + F.col("_wn")
    return r.select(*keys, order, value, count.cast("bigint").alias("count"),
                    (total.cast("double") / count).alias("cum_avg"))


def running_best(stats: DataFrame, keys: list[str], order: str = "epoch", loss: str = "value",
                 chunk_steps: int = DEFAULT_CHUNK_STEPS) -> DataFrame:
    """is_best = loss <= every earlier loss of the series (an equal loss also flags)."""
    r = _running(
        stats, keys, order, chunk_steps,
        partial={"_pm": F.min(loss)},
        combine={"_bm": ("min", "_pm")},
        within={"_wm": F.min(loss)},
    )
    best = F.least(F.coalesce("_bm", F.lit(float("inf"))), F.col("_wm"))
    return r.select(*keys, order, loss, best.alias("best_so_far"), (F.col(loss) <= best).alias("is_best"))


def global_avg(log: DataFrame, keys: list[str], value: str = "value", weight: str = "n") -> DataFrame:
    """Total, count and count-weighted mean per series (Spark's partial/final merge of meters)."""
    return (log.groupBy(*keys)
               .agg(F.sum((F.col(value) * F.col(weight)).cast(EXACT)).alias("_t"),
                    F.sum(weight).cast("bigint").alias("count"))
               .select(*keys, "count", F.col("_t").cast("double").alias("total"),
                       (F.col("_t").cast("double") / F.col("count")).alias("global_avg")))


def epoch_means(log: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean per (keys) with every step weighted 1."""
    return (log.groupBy(*keys)
               .agg(F.sum(_exact(value)).alias("_t"), F.count(F.lit(1)).alias("n"))
               .select(*keys, "n", (F.col("_t").cast("double") / F.col("n")).alias("mean")))


def best_epoch(stats: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "loss",
               eval_freq: int = 1) -> DataFrame:
    """Per run, the evaluated epoch with the lowest loss; ties go to the later epoch.

    Only epochs with ``epoch % eval_freq == 0`` are evaluated; a null, unparsable
    or NaN loss counts as +inf.
    """
    worst = F.lit(float("inf"))
    s = stats.where(F.col(epoch) % eval_freq == 0).withColumn(
        "_l", F.coalesce(F.nanvl(F.col(loss).try_cast("double"), worst), worst))
    return s.groupBy(run).agg(
        F.max_by(epoch, F.struct(-F.col("_l"), F.col(epoch))).alias("best_epoch"),
        F.min("_l").alias("best_loss"))


def stats_wide(stats: DataFrame, keys: list[str], phase: str, metric: str, value: str,
               columns: list[str]) -> DataFrame:
    """Prefix each metric with its phase (``phase_metric``) and pivot to one row per key.

    ``columns`` lists the expected names so the pivot needs no extra pass; an
    absent phase gives null columns.
    """
    named = stats.withColumn("_name", F.concat_ws("_", phase, metric))
    return named.groupBy(*keys).pivot("_name", columns).agg(F.first(value))
