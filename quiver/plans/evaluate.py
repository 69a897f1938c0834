"""The evaluation job: pool -> nine-cell search -> judgments -> report.

One plan covers all 3 x 3 (query modality, candidate modality) cells. The pool
and the query views are normalised once and written once as Parquet under the
cluster's spark.checkpoint.dir (``session.materialize``), because each is
scanned by several passes; this also cuts lineage so a lost executor recomputes
from the written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions import vectors as V
from quiver.operators import knn
from quiver.operators import metrics as M
from quiver.sources import qrels as Q
from quiver.session import materialize as write_once


@dataclass
class EvalConfig:
    dataset: str = "embeddings"
    split: str = "test"
    cand_pool: str = "embeddings"
    metrics: str = M.DEFAULT_METRICS
    metric: str = "ip"
    exclude_self: bool = False

    def normalized(self) -> "EvalConfig":
        return EvalConfig(self.dataset.lower(), self.split, self.cand_pool.lower(), self.metrics,
                          self.metric, self.exclude_self)


class DuplicatePoolIds(ValueError):
    pass


# Keys of the evaluation config.
CONFIG_LISTS = ["datasets_name", "correspond_cand_pools_name", "correspond_qrels_name", "correspond_metrics_name"]


def eval_config_expand(config: DataFrame) -> DataFrame:
    """One evaluation task per position of the parallel config lists.

    ``config`` has (split, datasets_name, correspond_cand_pools_name,
    correspond_qrels_name, correspond_metrics_name), the lists as arrays. The four
    lists must have equal length (checked on the small config table); names are
    lower-cased, the metric string is kept as written.
    """
    sizes = F.array(*[F.size(c) for c in CONFIG_LISTS])
    bad = config.where(F.array_min(sizes) != F.array_max(sizes)).limit(1).collect()
    if bad:
        raise ValueError("the four config lists must name one entry per evaluation task")
    z = F.arrays_zip(*[F.col(c) for c in CONFIG_LISTS])
    e = config.select("split", F.posexplode(z).alias("task_pos", "t"))
    return e.select(
        "split", "task_pos",
        F.lower(F.col("t.datasets_name")).alias("dataset"),
        F.lower(F.col("t.correspond_cand_pools_name")).alias("cand_pool"),
        F.lower(F.col("t.correspond_qrels_name")).alias("qrels_name"),
        F.col("t.correspond_metrics_name").alias("metrics"),
    )


def duplicate_ids(pool: DataFrame, id_col: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """Pool ids seen more than once (per modality); must be empty to build a pool."""
    keys = (by or []) + [id_col]
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def unit_views(views: DataFrame, materialize: bool = True) -> DataFrame:
    """Zero-safe unit vectors of the modality views, written once when both the pool and the
    queries come from the same records (one normalisation pass, one checkpoint)."""
    u = V.with_l2_normalized(views, "vec")
    return write_once(u) if materialize else u


def _pool_of(units: DataFrame) -> DataFrame:
    p = units.select(F.col("id").alias("doc_id"), F.col("modality").alias("c_mod"),
                     *[F.col(c).alias("rel_key") for c in units.columns if c == "label"], "vec")
    return p


def _queries_of(units: DataFrame) -> DataFrame:
    return units.select(F.col("id").alias("qid"), F.col("modality").alias("q_mod"),
                        *[F.col(c).alias("rel_key") for c in units.columns if c == "label"], "vec")


def pool_stats(pool: DataFrame):
    """One aggregation job: the first duplicated (modality, id), if any, and the vector sizes."""
    per_id = pool.groupBy("c_mod", "doc_id").agg(F.count(F.lit(1)).alias("c"),
                                                 F.min(F.size("vec")).alias("mn"), F.max(F.size("vec")).alias("mx"))
    return per_id.agg(
        F.min(F.when(F.col("c") > 1, F.struct("c_mod", "doc_id"))).alias("dup"),
        F.min("mn").alias("min_dim"), F.max("mx").alias("max_dim"), F.count(F.lit(1)).alias("n_ids"),
    ).first()


def check_unique(pool: DataFrame, stats=None) -> None:
    st = stats or pool_stats(pool)
    if st["dup"] is not None:
        raise DuplicatePoolIds(f"pool id {st['dup']['doc_id']} occurs more than once in modality {st['dup']['c_mod']}")


def check_dim(pool: DataFrame, configured: int | None = None, stats=None) -> int:
    """The vector size of the pool: ragged vectors are an error; a configured size that
    differs from the data is replaced by the data's, with a warning."""
    import warnings
    st = stats or pool_stats(pool)
    if st["n_ids"] == 0:
        return configured or 0
    if st["min_dim"] != st["max_dim"]:
        raise ValueError(f"ragged vectors in the pool: sizes {st['min_dim']}..{st['max_dim']}")
    d = int(st["max_dim"])
    if configured is not None and configured != d:
        warnings.warn(f"dimension mismatch: config {configured}, data {d}; using {d}")
    return d


def check_pool(pool: DataFrame, configured_dim: int | None = None) -> int:
    """Unique ids per modality and one vector size, from a single job."""
    st = pool_stats(pool)
    check_unique(pool, st)
    return check_dim(pool, configured_dim, st)


def build_pool(views: DataFrame, check_unique_ids: bool = True, materialize: bool = True) -> DataFrame:
    """Searchable pool from modality views (id, modality, vec): unique ids, unit vectors.

    The pool is written once (checkpoint) and then scanned by every pass; the
    duplicate-id check reads the written table. Raises on a duplicate id.
    """
    pool = _pool_of(unit_views(views, materialize))
    if check_unique_ids:
        check_pool(pool)
    return pool


def query_table(views: DataFrame, materialize: bool = True) -> DataFrame:
    return _queries_of(unit_views(views, materialize))


def sides(views: DataFrame, pool_modalities: list[str] | None = None,
          materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries, pool) from one set of records: normalised and written once, pool ids checked."""
    units = unit_views(views, materialize)
    pool = _pool_of(units)
    if pool_modalities is not None:
        pool = pool.where(F.col("c_mod").isin(pool_modalities))
    check_pool(pool)
    return _queries_of(units), pool


def ranks(queries: DataFrame, pool: DataFrame, judgment_lines: DataFrame | None, cfg: EvalConfig) -> DataFrame:
    """First relevant rank per (query, cell); relevance by judgments, or by rel_key when no lines."""
    judgments = None
    if judgment_lines is not None:
        judgments = Q.positive_judgments(Q.parse_qrels(judgment_lines))
    return knn.first_relevant_rank(queries, pool, judgments, cfg.metric, cfg.exclude_self)


def evaluate_and_write(queries: DataFrame, pool: DataFrame, judgment_lines: DataFrame | None,
                       out_dir: str, cfg: EvalConfig | None = None) -> str | None:
    """The whole evaluation job: report for every cell, written as a timestamped TSV
    (wide form, reference column order); returns the path, or None for an empty report."""
    from quiver.sources.sinks import write_report_tsv
    cfg = (cfg or EvalConfig()).normalized()
    wide = M.wide_report(evaluate(queries, pool, judgment_lines, cfg), M.parse_metric_list(cfg.metrics))
    return write_report_tsv(wide, out_dir)


def evaluate(queries: DataFrame, pool: DataFrame, judgment_lines: DataFrame | None,
             cfg: EvalConfig | None = None) -> DataFrame:
    """Long report (task, modalities, n, hits_k, mrr) for every cell present in both sides."""
    cfg = (cfg or EvalConfig()).normalized()
    metric_list = M.parse_metric_list(cfg.metrics)
    ks = [k for _, k in metric_list]
    per_q = M.per_query(ranks(queries, pool, judgment_lines, cfg), ks)
    tasks = Q.task_map(Q.parse_qrels(judgment_lines)) if judgment_lines is not None else None
    return M.report(per_q, tasks, ks, cfg.dataset, cfg.split, cfg.cand_pool)
