"""Exact top-k similarity search and exact first-relevant rank.

Physical design (no cross join, no all-pairs rows):

* The size of the query side is checked against a byte budget before anything
  is collected. If it fits, it is broadcast once and the pool is scanned with
  ``mapInPandas``; every task multiplies its Arrow batches by the query block
  (numpy BLAS, tiled so one score tile stays small) and keeps only a running
  top-k per query. Only those rows leave the task. Tiles are scored in single
  precision first, whose error is bounded; what the bound doesn't decide is
  scored in double precision, so answers are exact.
* If it does not fit, nothing goes through the driver: query blocks and pool
  shards are stored once and meet in pairs, each bounded on both sides, running
  the same kernel (``run_blocked``, ``tiles``).
* A ``row_number`` window merges the per-task lists; for k <= the window group
  limit threshold Spark adds a partial WindowGroupLimit before the shuffle.
* Evaluation does not need the hit list at all: the rank of the first relevant
  candidate is ``1 + #candidates ordered before the best relevant one``. That is
  a per-task count followed by a partial-aggregated sum, so its shuffle carries
  one number per query and task, whatever the search depth.

Order is total: rounded score (6 places), then candidate id ascending.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.functions import vectors as V
from quiver.operators import tiles
from quiver.session import materialize, spread

# Fixed values.
DEFAULT_BLOCK_BYTES = 32 << 20      # broadcast budget per query block
TILE_ELEMS = 1 << 20                # score-tile size inside a task (1M doubles = 8 MB)
SLAB_ROWS, SLAB_COLS = 512, 2048    # queries and candidates of a screened tile
FIRST_COLS = 256                    # candidates that first lists are made from, all in double precision
DENSE_ELEMS = 1 << 18               # scores of a screened tile that are worked out in double precision at once
WORD, BYTE_MOST = 8, 255            # booleans of a machine word, and how often each can be added to its byte
MANY = 64                           # candidates of a slab that single precision leaves over, above which a query's are scored by one product
SCREEN_MOST = 1e15                  # norms up to which single precision is asked
INT64_MAX = np.iinfo(np.int64).max
METRICS = ("ip", "l2")


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}; expected one of {METRICS}")


def _stack(vectors: pd.Series) -> np.ndarray:
    rows = vectors.to_numpy()
    if len(rows) == 0:
        return np.zeros((0, 0))
    sizes = set(map(len, rows))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} to {max(sizes)} numbers in one block")
    return np.concatenate(rows).astype(np.float64, copy=False).reshape(len(rows), -1 if max(sizes) else 0)


def _keys(Q: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    """Sort keys (lower is better): -score for inner product, squared distance for l2."""
    if metric == "ip":
        return -np.round(Q @ C.T, V.SCORE_DIGITS)
    d = (Q * Q).sum(1)[:, None] + (C * C).sum(1)[None, :] - 2.0 * (Q @ C.T)
    return np.round(np.maximum(d, 0.0), V.SCORE_DIGITS)


def _score_from_key(key: np.ndarray, metric: str) -> np.ndarray:
    s = -key if metric == "ip" else key
    return s + 0.0  # folds -0.0 into 0.0


def _row_chunks(n_rows: int, n_cols: int):
    step = max(1, TILE_ELEMS // max(1, n_cols))
    for s in range(0, n_rows, step):
        yield s, min(n_rows, s + step)


def _portions(rows: np.ndarray, n_cols: int):
    """Runs of ``rows`` whose scores against so many candidates are few enough to be held several times."""
    step = max(1, DENSE_ELEMS // max(1, n_cols))
    for i in range(0, len(rows), step):
        yield rows[i: i + step]


def pair_keys(Q: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    """Sort keys of row pairs, by the formula and rounding of :func:`_keys`."""
    dot = np.einsum("ij,ij->i", Q, C)
    if metric == "ip":
        return -np.round(dot, V.SCORE_DIGITS)
    d = (Q * Q).sum(1) + (C * C).sum(1) - 2.0 * dot
    return np.round(np.maximum(d, 0.0), V.SCORE_DIGITS)


class Screen:
    """Scores in single precision, with a bound of their error: they rule pairs out, the rest is scored exactly.

    ``tile`` gives, for a run of queries and of candidates, numbers that grow with
    the score; a pair whose key is at most ``limit`` has a number of at least
    ``least(limit)``, one whose key is above it a number below ``most(limit)``.
    """

    def __init__(self, Q: np.ndarray, C: np.ndarray, metric: str):
        self.Q, self.C, self.metric, self._rooms = Q, C, metric, {}
        q, c = (np.sqrt(np.einsum("ij,ij->i", X, X)) for X in (Q, C))
        far = float(np.nan_to_num(c, nan=0.0, posinf=np.inf).max(initial=0.0))
        self.usable = max(far, float(np.nan_to_num(q, nan=0.0, posinf=np.inf).max(initial=0.0))) <= SCREEN_MOST
        if not self.usable:
            return
        self.q, self.c = Q.astype(np.float32), C.astype(np.float32)
        self.sq = np.square(q)
        self.half = (np.square(c) / 2.0).astype(np.float32) if metric == "l2" else None
        # sums of d rounded products, the rounding of the limit, and half a digit of the key
        self.slack = (Q.shape[1] + 32) * 2.0 ** -23 * q * far + 10.0 ** -V.SCORE_DIGITS
        if metric == "l2":
            self.slack = self.slack + 2.0 ** -21 * (far * far + self.sq)

    def tile(self, rows, a: int, b: int) -> np.ndarray:
        """The numbers of a tile, in a buffer that the next call overwrites."""
        q = self.q[rows]
        found = np.matmul(q, self.c[a:b].T, out=self._room("numbers", len(q), b - a, np.float32))
        return found if self.half is None else np.subtract(found, self.half[None, a:b], out=found)

    def marks(self, name: str, compare, found: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """``compare(found, bound)`` row by row, its rows filled up with False to whole words, in a buffer of that name."""
        n, width = found.shape
        mask = self._room(name, n, -(-width // WORD) * WORD, bool)
        mask[:, width:] = False
        compare(found, bound[:, None], out=mask[:, :width])
        return mask

    def reached(self, found: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a tile to look through for numbers of at least their bound, and these rows' numbers."""
        with np.errstate(invalid="ignore"):
            hit = np.flatnonzero(np.fmax.reduce(found, axis=1, initial=-np.inf) >= least)
        return (np.arange(len(found)), found) if 2 * len(hit) > len(found) else (hit, found[hit])

    def passing(self, found: np.ndarray, least: np.ndarray, most: int = MANY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns) of the numbers of a tile that reach their row's bound, and the rows where more than ``most`` do."""
        rows, part = self.reached(found, least)
        r, c, many = _few(self.marks("may", np.greater_equal, part, least[rows]), most)
        return rows[r], c, rows[many]

    def _room(self, name: str, n: int, width: int, kind) -> np.ndarray:
        if name not in self._rooms or len(self._rooms[name]) < n * width:
            self._rooms[name] = np.empty(n * width, kind)
        return self._rooms[name][: n * width].reshape(n, width)

    def _at(self, rows, limit: np.ndarray) -> np.ndarray:
        return -limit if self.metric == "ip" else (self.sq[rows] - limit) / 2.0

    def least(self, rows, limit: np.ndarray) -> np.ndarray:
        at = self._at(rows, limit)
        return (at - self.slack[rows] - 2.0 ** -22 * np.abs(at)).astype(np.float32)

    def most(self, rows, limit: np.ndarray) -> np.ndarray:
        at = self._at(rows, limit)
        return (at + self.slack[rows] + 2.0 ** -22 * np.abs(at)).astype(np.float32)

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Keys of the pairs (rows[i], cols[i])."""
        step = max(1, (2 * TILE_ELEMS) // max(1, self.Q.shape[1]))
        parts = [pair_keys(self.Q[rows[i: i + step]], self.C[cols[i: i + step]], self.metric) for i in range(0, len(rows), step)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _positions(sought: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of every place where an id of ``sought`` stands in the sorted ``docs``."""
    left, right = np.searchsorted(docs, sought, "left"), np.searchsorted(docs, sought, "right")
    n = right - left
    rows = np.repeat(np.arange(len(sought)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + left[rows]


def _cut(found: tuple[np.ndarray, np.ndarray], s: int, e: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (rows, columns) those in a tile, counted from its corner; rows ascend."""
    rows, cols = found
    i, j = np.searchsorted(rows, s, "left"), np.searchsorted(rows, e, "left")
    inside = (cols[i:j] >= a) & (cols[i:j] < b)
    return rows[i:j][inside] - s, cols[i:j][inside] - a


def _among(found: tuple[np.ndarray, np.ndarray], rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (rows, columns) in a tile of ``n`` rows those whose row is one of ``rows``, by its place there."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    at = place[found[0]]
    return at[at >= 0], found[1][at >= 0]


def _in_words(mask: np.ndarray) -> bool:
    return mask.shape[1] % WORD == 0 and mask.flags.c_contiguous


def _marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a sparse matrix of booleans, eight at once."""
    if not _in_words(mask):
        return np.nonzero(mask)
    words = mask.view(np.uint64).ravel()
    some = np.flatnonzero(words)
    word, byte = np.nonzero(words[some].view(np.uint8).reshape(-1, WORD))
    return np.divmod(some[word] * WORD + byte, mask.shape[1])


def _per_row(mask: np.ndarray) -> np.ndarray:
    """How many are true in each row; eight are added at once, in the bytes of a word."""
    if not _in_words(mask):
        return np.add.reduce(mask, axis=1, dtype=np.int32)
    words, n = mask.view(np.uint64), np.zeros(len(mask), np.int32)
    for a in range(0, words.shape[1], BYTE_MOST):
        sums = np.add.reduce(words[:, a: a + BYTE_MOST], axis=1)
        n += sums.view(np.uint8).reshape(-1, WORD).sum(axis=1, dtype=np.int32)
    return n


def _few(mask: np.ndarray, most: int = MANY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns) of what is true in rows with ``most`` at most, and the rows that have more; may unmark these."""
    some = np.flatnonzero(mask.any(axis=1))
    part = mask[some] if 2 * len(some) < len(mask) else mask
    many = _per_row(part) > most
    rows = some if part is not mask else np.arange(len(mask))
    if many.any():
        part[many] = False
    r, c = _marked(part)
    return rows[r], c, rows[many]


def _insert(acc_k: np.ndarray, acc_d: np.ndarray, rows: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> None:
    """Put (row, key, doc) entries into dense, sorted top-k lists; finite keys only.

    A list and a row's new entries are two sorted runs, which a stable sort by key
    merges in one go; a row where equal keys then have docs out of order is sorted by both.
    """
    ok = np.isfinite(keys)
    rows, keys, docs = rows[ok], keys[ok], docs[ok]
    if len(rows) == 0:
        return
    k = acc_k.shape[1]
    o = np.lexsort((docs, keys, rows))
    hit, first, n = np.unique(rows[o], return_index=True, return_counts=True)
    place = np.arange(len(o)) - np.repeat(first, n)
    o, at, place = (x[place < k] for x in (o, np.repeat(np.arange(len(hit)), n), place))
    K, D = (np.concatenate([acc[hit], rest], axis=1) for acc, rest in zip((acc_k, acc_d), empty_topk(len(hit), min(k, int(n.max())))))
    K[at, k + place], D[at, k + place] = keys[o], docs[o]
    o = np.argsort(K, axis=1, kind="stable")
    key, doc = np.take_along_axis(K, o, axis=1), np.take_along_axis(D, o, axis=1)
    tied = np.flatnonzero(((key[:, 1:] == key[:, :-1]) & (doc[:, 1:] < doc[:, :-1])).any(axis=1))
    if len(tied):
        o = np.lexsort((D[tied], K[tied]), axis=-1)
        key[tied], doc[tied] = np.take_along_axis(K[tied], o, axis=1), np.take_along_axis(D[tied], o, axis=1)
    acc_k[hit], acc_d[hit] = key[:, :k], doc[:, :k]


def _absorb(K: np.ndarray, docs: np.ndarray, rows: np.ndarray, acc_k: np.ndarray, acc_d: np.ndarray) -> None:
    """Merge the exact keys of ``rows`` against ``docs`` (ascending) into their lists."""
    k = acc_k.shape[1]
    full = np.isfinite(acc_k[rows, -1])
    if full.any():
        warm = np.flatnonzero(full)
        kth, last = acc_k[rows[warm], -1], acc_d[rows[warm], -1]
        part = K if full.all() else K[warm]
        r, c = _marked(part <= kth[:, None])
        key = part[r, c]
        better = (key < kth[r]) | (docs[c] < last[r])
        _insert(acc_k, acc_d, rows[warm[r[better]]], key[better], docs[c[better]])
        if full.all():
            return
        rows, K = rows[~full], K[~full]
    nc = len(docs)
    if nc > k:
        kth = np.partition(K, k - 1, axis=1)[:, k - 1]
        lt = K < kth[:, None]
        eq = K == kth[:, None]
        need = k - lt.sum(axis=1)
        sel = lt | (eq & (np.cumsum(eq, axis=1) <= need[:, None]))
        idx = np.argpartition(~sel, k - 1, axis=1)[:, :k]
    else:
        idx = np.broadcast_to(np.arange(nc), (len(rows), nc))
    bk = np.take_along_axis(K, idx, axis=1)
    bd = np.where(np.isfinite(bk), docs[idx], INT64_MAX)
    bk = np.where(np.isfinite(bk), bk, np.inf)
    K2 = np.concatenate([acc_k[rows], bk], axis=1)
    D2 = np.concatenate([acc_d[rows], bd], axis=1)
    o = np.lexsort((D2, K2), axis=-1)[:, :k]
    acc_k[rows] = np.take_along_axis(K2, o, axis=1)
    acc_d[rows] = np.take_along_axis(D2, o, axis=1)


def empty_topk(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), np.inf), np.full((n, k), INT64_MAX, np.int64)


def topk_merge(Q: np.ndarray, qids: np.ndarray, C: np.ndarray, docs: np.ndarray, k: int, metric: str,
               exclude_self: bool, acc=None, docs_sorted: bool = False, key=None):
    """Merge a candidate block into a running top-k per query row.

    ``key`` (first row, last row -> sort keys) takes the place of ``C`` where
    candidates aren't vectors.

    ``acc`` is dense: (keys n x k, docs n x k), padded with +inf / INT64_MAX, and
    merged in place. Vectors are scored in single precision first (:class:`Screen`),
    and only pairs that may beat a query's k-th answer so far are scored in double
    precision; a query without k answers yet gets every score of a slab, and so
    does one with very many ties at its k-th. First lists come from a narrow slab,
    and the slabs after it double, so that few pairs beat a k-th that is still poor.
    """
    n = len(qids)
    acc_k, acc_d = acc = empty_topk(n, k) if acc is None else acc
    if len(docs) == 0 or n == 0:
        return acc
    if not docs_sorted:
        perm = np.argsort(docs, kind="stable")
        C, docs = C[perm], docs[perm]
    nc = len(docs)
    selves = _positions(qids, docs) if exclude_self else None
    screen = Screen(Q, C, metric) if key is None else None
    if screen is None or not screen.usable:
        for s, e in _row_chunks(n, nc):
            K = _keys(Q[s:e], C, metric) if key is None else key(s, e)
            if exclude_self:
                K[_cut(selves, s, e, 0, nc)] = np.inf
            _absorb(K, docs, np.arange(s, e), acc_k, acc_d)
        return acc
    width, first = max(SLAB_COLS, 8 * k), max(FIRST_COLS, 4 * k)
    for s in range(0, n, SLAB_ROWS):
        e = min(n, s + SLAB_ROWS)
        at = np.arange(s, e)
        begun, b = np.isfinite(acc_k[s:e, -1]).all(), 0
        while b < nc:
            a, b = b, min(nc, b + (width if begun else min(width, max(first, b))))
            out = _cut(selves, s, e, a, b) if exclude_self else None
            full = np.isfinite(acc_k[s:e, -1])
            dense = at[~full]
            if full.any():
                least = screen.least(slice(s, e), np.where(full, acc_k[s:e, -1], 0.0))
                least[~full] = np.inf
                found = screen.tile(slice(s, e), a, b)
                if exclude_self:
                    found[out] = -np.inf
                r, c, many = screen.passing(found, least, max(MANY, min(2 * k, 2 * MANY)))
                if len(many):
                    dense = np.union1d(dense, many + s)
                if len(r):
                    _insert(acc_k, acc_d, r + s, screen.exact(r + s, c + a), docs[c + a])
            for rows in _portions(dense, b - a):
                K = _keys(Q[rows], C[a:b], metric)
                if exclude_self:
                    K[_among(out, rows - s, e - s)] = np.inf
                _absorb(K, docs[a:b], rows, acc_k, acc_d)
    return acc


def dense_to_rows(acc):
    """(rows, keys, docs) of the filled entries of a dense top-k."""
    acc_k, acc_d = acc
    r, c = np.nonzero(np.isfinite(acc_k))
    return r, acc_k[r, c], acc_d[r, c]


def topk_dense(Q: np.ndarray, qids: np.ndarray, C: np.ndarray, docs: np.ndarray, k: int, metric: str,
               exclude_self: bool):
    """Top-k of a query block against one candidate block: (rows, keys, docs)."""
    return dense_to_rows(topk_merge(Q, qids, C, docs, k, metric, exclude_self))


# ---- query blocks ---------------------------------------------------------------

def _block_count(df: DataFrame, vec: str, budget_bytes: int, extra_row_bytes: int = 0) -> tuple[int, int, int]:
    """(rows, blocks, bytes of a row) for a query side, from a size check that collects nothing big.

    ``extra_row_bytes`` is the per-row working memory of the kernel (e.g. a k-deep
    top-k buffer per pool modality), so a block bounds memory, not only the broadcast.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, d = int(stats["n"] or 0), int(stats["d"] or 0)
    row_bytes = 8 * max(d, 1) + 96
    per_block = max(1, budget_bytes // (row_bytes + extra_row_bytes))
    return n, max(1, math.ceil(n / per_block)), row_bytes


def _ensure_group_limit(spark: SparkSession, k: int) -> None:
    """Keep the partial top-k (WindowGroupLimit) before the shuffle for any k."""
    cur = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > cur:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(k))


DEFAULT_SHARD_BYTES = 16 << 20     # pool bytes per shard when neither side can be broadcast
FRAME_BYTES = 8 << 20              # bytes of a side's vectors that a task then holds at once


def run_blocked(queries: DataFrame, pool: DataFrame, query_keys: list[str], payload_fn, kernel,
                schema: str, block_bytes: int = DEFAULT_BLOCK_BYTES, min_blocks: int = 1,
                shard_bytes: int = DEFAULT_SHARD_BYTES, extra_row_bytes: int = 0) -> DataFrame:
    """Run ``kernel(payload_fn(query_block), pool_batches)`` over every (query, pool) pair of blocks.

    * One block (its size checked first): the block is broadcast and the pool is
      scanned once by ``mapInPandas`` -- no shuffle of the pool.
    * Queries over the budget but a pool within it: the pool is broadcast and the
      queries are scanned; each task holds the whole pool, so results are final.
    * Neither side within the budget: nothing goes through the driver. Both sides
      are stored in tiles, and tasks read the pairs of one query block and a run
      of pool shards by path (``tiles.meet``), so no row is copied per partner.
      A task reads both in frames of ``FRAME_BYTES``, so its memory doesn't follow the blocks.
      Results are partial per run and are merged by the caller (window top-k,
      min, sum), exactly as across pool partitions.
    """
    spark = queries.sparkSession
    n, n_blocks, query_bytes = _block_count(queries, "vec", block_bytes, extra_row_bytes)
    n_blocks = max(n_blocks, min_blocks)
    if n_blocks <= 1:
        bc = spark.sparkContext.broadcast(payload_fn(queries.toPandas()))
        return pool.mapInPandas(lambda it: kernel(bc.value, it), schema)
    n_pool, n_pool_blocks, pool_bytes = _block_count(pool, "vec", block_bytes)
    if n_pool_blocks <= 1 and min_blocks <= 1:
        # many queries, small pool: broadcast the pool (its size checked) and scan the
        # queries; every task sees the whole pool, so its results are already final
        bc = spark.sparkContext.broadcast(pool.toPandas())

        def scan_queries(batches):
            for qpdf in batches:
                if len(qpdf):
                    yield from kernel(payload_fn(qpdf), iter([bc.value]))
        return spread(queries).mapInPandas(scan_queries, schema)
    n_shards = max(1, math.ceil(n_pool_blocks * block_bytes / shard_bytes))
    blocks = tiles.tiled(queries, "query-blocks", max(1, -(-n // n_blocks)), query_keys)
    shards = tiles.tiled(pool, "pool-shards", max(1, -(-n_pool // n_shards)), ["doc_id"])
    # frames of a tile are of one size, since each of a block's reads all rows of a run
    frames = tuple(max(1, -(-side.rows // -(-side.rows // max(1, FRAME_BYTES // size)))) for side, size in ((blocks, query_bytes), (shards, pool_bytes)))
    return tiles.meet(blocks, shards, payload_fn, kernel, schema, frames)


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort, where a side holds what a search has found.

    Spark takes the size of what tasks yield from that of their list of jobs, some
    kilobytes, and would broadcast all of it through the driver.
    """
    return left.join(right.hint("merge"), on, how)


# ---- repeated query ids ----------------------------------------------------------

REPEAT_MARK = "\x01"


def split_repeats(queries: DataFrame) -> DataFrame:
    """Queries whose (qid, q_mod) occurs once, or else told apart by a number behind q_mod.

    Every query row is searched and scored by itself, so two rows with one id must
    not share a result list; :func:`join_repeats` takes the number off again.
    """
    keys = ["qid", "q_mod"]
    if queries.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return queries
    order = Window.partitionBy(*keys).orderBy("vec", *[c for c in queries.columns if c not in (*keys, "vec")])
    nth = F.row_number().over(order)
    return queries.withColumn("q_mod", F.when(nth == 1, F.col("q_mod")).otherwise(
        F.concat(F.col("q_mod"), F.lit(REPEAT_MARK), nth.cast("string"))))


def join_repeats(found: DataFrame) -> DataFrame:
    return found.withColumn("q_mod", F.substring_index("q_mod", REPEAT_MARK, 1))


# ---- top-k search ---------------------------------------------------------------

HITS_SCHEMA = "qid long, q_mod string, c_mod string, doc_id long, score double"


def _under(blocks: dict) -> tuple[np.ndarray, ...]:
    """The arrays of all blocks under one another, and the name of each row's block: what one product can score."""
    held = {name: arrays for name, arrays in blocks.items() if len(arrays[0])} or blocks
    names = np.repeat(np.array(list(held), object), [len(arrays[0]) for arrays in held.values()])
    parts = list(zip(*held.values()))
    return (*(x[0] if len(x) == 1 else np.concatenate(x) for x in parts), names)


def _topk_kernel(k: int, metric: str, exclude_self: bool):
    def run(blocks, batches):
        best = {}  # c_mod -> (keys, docs)
        qids, Q, q_mods = _under(blocks) if blocks else ([], None, None)
        for pdf in batches:
            if pdf.empty:
                continue
            for c_mod, g in pdf.groupby("c_mod", sort=False):
                g = g.sort_values("doc_id", kind="stable")      # doc order once per batch
                C = _stack(g["vec"])
                docs = g["doc_id"].to_numpy(np.int64)
                if len(qids):
                    best[c_mod] = topk_merge(Q, qids, C, docs, k, metric, exclude_self, best.get(c_mod),
                                             docs_sorted=True)
        for c_mod, acc in best.items():
            rows, keys, docs = dense_to_rows(acc)
            yield pd.DataFrame({
                "qid": qids[rows].astype(np.int64), "q_mod": q_mods[rows], "c_mod": c_mod,
                "doc_id": docs.astype(np.int64), "score": _score_from_key(keys, metric),
            })
    return run


def _payload_by_mod(pdf: pd.DataFrame, id_col: str, mod_col: str, vec_col: str):
    out = {}
    for m, g in pdf.groupby(mod_col, sort=False):
        out[m] = (g[id_col].to_numpy(np.int64), _stack(g[vec_col]))
    return out


def search_topk(queries: DataFrame, pool: DataFrame, k: int, metric: str = "ip",
                exclude_self: bool = False, block_bytes: int = DEFAULT_BLOCK_BYTES,
                with_rank: bool = True, min_blocks: int = 1) -> DataFrame:
    """Exact top-k per query row, for every (query modality, pool modality) cell.

    queries: (qid BIGINT, q_mod STRING, vec ARRAY<DOUBLE>)
    pool:    (doc_id BIGINT, c_mod STRING, vec ARRAY<DOUBLE>)
    returns: (qid, q_mod, c_mod, doc_id, score, rank) with rank 1..k; a pool
    smaller than k gives fewer rows; ``exclude_self`` drops doc_id == qid.
    Vectors are searched as given (normalise first for cosine). The strategy
    (broadcast queries, broadcast pool, or stored query blocks and pool shards)
    follows the byte budget; ``min_blocks`` > 1 forces the last.
    """
    _check_metric(metric)
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = queries.sparkSession
    q = split_repeats(queries.select("qid", "q_mod", V.as_double("vec").alias("vec")))
    p = pool.select("doc_id", "c_mod", V.as_double("vec").alias("vec"))
    # working memory per query row: a k-deep (key, doc) buffer for each of (up to) 3 pool modalities
    cands = run_blocked(q, p, ["qid", "q_mod"], lambda b: _payload_by_mod(b, "qid", "q_mod", "vec"),
                        _topk_kernel(k, metric, exclude_self), HITS_SCHEMA, block_bytes, min_blocks,
                        extra_row_bytes=3 * 16 * k)
    if not with_rank:
        return join_repeats(cands)
    _ensure_group_limit(spark, k)
    order = F.desc("score") if metric == "ip" else F.asc("score")
    w = Window.partitionBy("qid", "q_mod", "c_mod").orderBy(order, F.asc("doc_id"))
    return join_repeats(cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


# ---- first relevant rank ---------------------------------------------------------

THR_SCHEMA = "qid long, q_mod string, c_mod string, best_key double, best_doc long"
CNT_SCHEMA = "qid long, q_mod string, c_mod string, n_before long"


def _groups(keys: np.ndarray) -> dict:
    """Value -> row numbers, ascending; null values are left out."""
    return pd.Series(np.arange(len(keys))).groupby(keys, sort=False, dropna=True).indices


def best_of_group(Q: np.ndarray, qids: np.ndarray, C: np.ndarray, docs: np.ndarray, metric: str, exclude_self: bool,
                  bk: np.ndarray, bd: np.ndarray) -> None:
    """Lower (bk, bd) to the best (key, doc) of each query among the candidates, whose docs ascend."""
    selves = _positions(qids, docs) if exclude_self else None
    screen = Screen(Q, C, metric)
    for s in range(0, len(qids), SLAB_ROWS):
        e = min(len(qids), s + SLAB_ROWS)
        for a in range(0, len(docs), SLAB_COLS):
            b = min(len(docs), a + SLAB_COLS)
            out = _cut(selves, s, e, a, b) if exclude_self else None
            dense = np.arange(s, e)
            if screen.usable:
                found = screen.tile(slice(s, e), a, b)
                if exclude_self:
                    found[out] = -np.inf
                # nothing below the best so far, and nothing clearly below the slab's own best
                rows, part = screen.reached(found, screen.least(slice(s, e), bk[s:e]))
                with np.errstate(invalid="ignore"):
                    top = np.fmax.reduce(part, axis=1, initial=-np.inf) - 2.0 * screen.slack[s:e][rows]
                least = np.maximum(top.astype(np.float32), screen.least(rows + s, bk[rows + s]))
                least = np.fmax(least, np.nextafter(np.float32(-np.inf), np.float32(0)))
                r, c, many = _few(screen.marks("may", np.greater_equal, part, least))
                r, dense = rows[r], rows[many] + s
                if len(r):
                    key, doc = screen.exact(r + s, c + a), docs[c + a]
                    o = np.lexsort((doc, key, r))
                    r, first = np.unique(r[o], return_index=True)
                    key, doc = key[o][first], doc[o][first]
                    better = np.isfinite(key) & ((key < bk[r + s]) | ((key == bk[r + s]) & (doc < bd[r + s])))
                    bk[r[better] + s], bd[r[better] + s] = key[better], doc[better]
            for rows in _portions(dense, b - a):
                K = _keys(Q[rows], C[a:b], metric)
                if exclude_self:
                    K[_among(out, rows - s, e - s)] = np.inf
                K[~np.isfinite(K)] = np.inf
                col = K.argmin(axis=1)                     # the first of the least: docs ascend
                key, doc = K[np.arange(len(rows)), col], docs[a:b][col]
                better = np.isfinite(key) & ((key < bk[rows]) | ((key == bk[rows]) & (doc < bd[rows])))
                bk[rows[better]], bd[rows[better]] = key[better], doc[better]


def _best_by_key_kernel(metric: str, exclude_self: bool):
    """Per task: best candidate sharing the query's relevance key (pass A); only rows of one key meet."""
    def run(blocks, batches):
        best, mine, n = {}, {}, 0
        if blocks:
            qids, Q, qkeys, q_mods = _under(blocks)
            groups = _groups(qkeys)
            order = np.concatenate([np.zeros(0, np.int64), *groups.values()])         # rows of a key next to each other
            qids, Q, q_mods = qids[order], Q[order], q_mods[order]
            for value, rows in groups.items():
                mine[value], n = slice(n, n + len(rows)), n + len(rows)
        for pdf in batches:
            if pdf.empty:
                continue
            for c_mod, g in pdf.groupby("c_mod", sort=False):
                g = g.sort_values("doc_id", kind="stable")
                C = _stack(g["vec"])
                docs = g["doc_id"].to_numpy(np.int64)
                bk, bd = best.setdefault(c_mod, (np.full(n, np.inf), np.full(n, INT64_MAX)))
                for value, cols in _groups(g["rel_key"].to_numpy()).items():
                    at = mine.get(value)
                    if at is not None:
                        best_of_group(Q[at], qids[at], C[cols], docs[cols], metric, exclude_self, bk[at], bd[at])
        for c_mod, (bk, bd) in best.items():
            ok = np.isfinite(bk)
            if ok.any():
                yield pd.DataFrame({"qid": qids[ok], "q_mod": q_mods[ok], "c_mod": c_mod,
                                    "best_key": bk[ok] + 0.0, "best_doc": bd[ok]})
    return run


def count_ahead(Q: np.ndarray, qids: np.ndarray, t_key: np.ndarray, t_doc: np.ndarray, C: np.ndarray, docs: np.ndarray, metric: str,
                exclude_self: bool, acc: np.ndarray) -> None:
    """Add to ``acc`` the candidates (docs ascend) ordered before each query's threshold, itself and the threshold left out."""
    never = [_positions(t_doc, docs), *([_positions(qids, docs)] if exclude_self else [])]
    screen = Screen(Q, C, metric)
    for s in range(0, len(qids), SLAB_ROWS):
        e = min(len(qids), s + SLAB_ROWS)
        if screen.usable:
            low, high = (f(slice(s, e), t_key[s:e]) for f in (screen.least, screen.most))
        for a in range(0, len(docs), SLAB_COLS):
            b = min(len(docs), a + SLAB_COLS)
            out = [_cut(places, s, e, a, b) for places in never]
            dense = np.arange(s, e)
            if screen.usable:
                found = screen.tile(slice(s, e), a, b)
                for places in out:
                    found[places] = -np.inf
                rows, part = screen.reached(found, low)
                may, sure = screen.marks("may", np.greater_equal, part, low[rows]), screen.marks("sure", np.greater, part, high[rows])
                n_sure = _per_row(sure)
                np.logical_xor(may, sure, out=may)
                r, c, many = _few(may)
                n_sure[many] = 0
                acc[rows + s] += n_sure
                r, dense = rows[r], rows[many] + s
                if len(r):
                    key, doc = screen.exact(r + s, c + a), docs[c + a]
                    before = (key < t_key[r + s]) | ((key == t_key[r + s]) & (doc < t_doc[r + s]))
                    acc[s:e] += np.bincount(r[before], minlength=e - s)
            for rows in _portions(dense, b - a):
                K = _keys(Q[rows], C[a:b], metric)
                t_k, t_d = t_key[rows, None], t_doc[rows, None]
                before = (K < t_k) | ((K == t_k) & (docs[None, a:b] < t_d))
                for places in out:
                    before[_among(places, rows - s, e - s)] = False
                acc[rows] += before.sum(axis=1)


def _count_before_kernel(metric: str, exclude_self: bool):
    """Per task: candidates ordered strictly before each query's threshold (pass B)."""
    def run(blocks, batches):
        asked = {}                                            # c_mod -> the arrays of its blocks, and their counts
        for c_mod in dict.fromkeys(cm for _, cm in blocks):
            arrays = _under({q_mod: v for (q_mod, cm), v in blocks.items() if cm == c_mod})
            asked[c_mod] = (*arrays, np.zeros(len(arrays[0]), np.int64))
        for pdf in batches:
            if pdf.empty:
                continue
            for c_mod, g in pdf.groupby("c_mod", sort=False):
                if c_mod not in asked or len(asked[c_mod][0]) == 0:
                    continue
                qids, Q, tk, td, _, acc = asked[c_mod]
                g = g.sort_values("doc_id", kind="stable")
                count_ahead(Q, qids, tk, td, _stack(g["vec"]), g["doc_id"].to_numpy(np.int64), metric, exclude_self, acc)
        for c_mod, (qids, _, _, _, q_mods, acc) in asked.items():
            nz = acc > 0
            if nz.any():
                yield pd.DataFrame({"qid": qids[nz], "q_mod": q_mods[nz], "c_mod": c_mod, "n_before": acc[nz]})
    return run


def best_relevant_by_key(queries: DataFrame, pool: DataFrame, metric: str = "ip",
                         exclude_self: bool = False, block_bytes: int = DEFAULT_BLOCK_BYTES,
                         min_blocks: int = 1) -> DataFrame:
    """Best candidate per query among those with the same ``rel_key`` (relevance by rule).

    No (query, relevant) pair is materialised: each task keeps one best per query,
    and a partial-aggregated min merges the tasks.
    """
    _check_metric(metric)
    q = queries.select("qid", "q_mod", V.as_double("vec").alias("vec"), "rel_key")
    p = pool.select("doc_id", "c_mod", V.as_double("vec").alias("vec"), "rel_key")

    def payload(block):
        return {m: (g["qid"].to_numpy(np.int64), _stack(g["vec"]), g["rel_key"].to_numpy())
                for m, g in block.groupby("q_mod", sort=False)}
    parts = run_blocked(q, p, ["qid", "q_mod"], payload, _best_by_key_kernel(metric, exclude_self),
                        THR_SCHEMA, block_bytes, min_blocks)
    best = parts.groupBy("qid", "q_mod", "c_mod").agg(
        F.min(F.struct("best_key", "best_doc")).alias("b"))
    return best.select("qid", "q_mod", "c_mod", F.col("b.best_key").alias("best_key"),
                       F.col("b.best_doc").alias("best_doc"))


def _pair_key(metric: str):
    """Sort key of vector pairs, by the formula and rounding of :func:`_keys`."""
    @F.pandas_udf("double")
    def key(q: pd.Series, c: pd.Series) -> pd.Series:
        if len(q) == 0:
            return pd.Series([], dtype="float64")
        return pd.Series(pair_keys(_stack(q), _stack(c), metric))
    return key


def best_relevant_by_judgments(queries: DataFrame, pool: DataFrame, judgments: DataFrame,
                               metric: str = "ip", exclude_self: bool = False) -> DataFrame:
    """Best judged-relevant candidate per (query, cell) from explicit judgments.

    judgments: (qid STRING, doc_id STRING) positive pairs. Ids match as strings.
    Two equi-joins (AQE splits a hot document or query); the score of each judged
    pair is computed once, rounded like those of the scan so that both agree on ties.
    """
    _check_metric(metric)
    j = judgments.select(F.col("qid").alias("j_qid"), F.col("doc_id").alias("j_doc")).distinct()
    q = queries.select(F.col("qid").cast("string").alias("j_qid"), "qid", "q_mod",
                       V.as_double("vec").alias("qvec"))
    p = pool.select(F.col("doc_id").cast("string").alias("j_doc"), "doc_id", "c_mod",
                    V.as_double("vec").alias("cvec"))
    pairs = j.join(q, "j_qid").join(p, "j_doc")
    if exclude_self:
        pairs = pairs.where(F.col("doc_id") != F.col("qid"))
    key = _pair_key(metric)("qvec", "cvec")
    best = (pairs.select("qid", "q_mod", "c_mod", (key + F.lit(0.0)).alias("best_key"), "doc_id")
                 .groupBy("qid", "q_mod", "c_mod")
                 .agg(F.min(F.struct("best_key", "doc_id")).alias("b")))
    return best.select("qid", "q_mod", "c_mod", F.col("b.best_key").alias("best_key"),
                       F.col("b.doc_id").alias("best_doc"))


def with_thresholds(queries: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Queries with their thresholds in every pool modality side by side (c_mods, best_keys,
    best_docs), so that a vector is stored and read once; queries without any are left out."""
    found = thresholds.groupBy("qid", "q_mod").agg(F.sort_array(F.collect_list(F.struct("c_mod", "best_key", "best_doc"))).alias("t"))
    found = found.select("qid", "q_mod", *[F.col(f"t.{c}").alias(f"{c}s") for c in ("c_mod", "best_key", "best_doc")])
    return sorted_join(found, queries.select("qid", "q_mod", V.as_double("vec").alias("vec")), ["qid", "q_mod"])


def _payload_by_cell(block: pd.DataFrame) -> dict:
    """(q_mod, c_mod) -> (qids, vectors, keys, docs) of the queries with a threshold there."""
    out = {}
    for q_mod, g in block.groupby("q_mod", sort=False):
        qids, Q = g["qid"].to_numpy(np.int64), _stack(g["vec"])
        at = np.repeat(np.arange(len(g)), g["c_mods"].map(len))
        mods, keys, docs = (np.concatenate(g[c].to_numpy()) for c in ("c_mods", "best_keys", "best_docs"))
        for c_mod in dict.fromkeys(mods):
            mine = mods == c_mod
            rows = at[mine]
            out[q_mod, c_mod] = (qids[rows], Q if len(rows) == len(Q) else Q[rows], keys[mine].astype(np.float64), docs[mine].astype(np.int64))
    return out


def count_before_joined(tq: DataFrame, pool: DataFrame, metric: str = "ip", exclude_self: bool = False,
                        block_bytes: int = DEFAULT_BLOCK_BYTES, min_blocks: int = 1) -> DataFrame:
    """Pass B on queries that already carry their thresholds (``with_thresholds``):
    candidates ordered before the threshold, per (query, cell)."""
    _check_metric(metric)
    p = pool.select("doc_id", "c_mod", V.as_double("vec").alias("vec"))
    parts = run_blocked(tq, p, ["qid", "q_mod"], _payload_by_cell, _count_before_kernel(metric, exclude_self),
                        CNT_SCHEMA, block_bytes, min_blocks)
    return parts.groupBy("qid", "q_mod", "c_mod").agg(F.sum("n_before").alias("n_before"))


def count_before(queries: DataFrame, pool: DataFrame, thresholds: DataFrame, metric: str = "ip",
                 exclude_self: bool = False, block_bytes: int = DEFAULT_BLOCK_BYTES,
                 min_blocks: int = 1) -> DataFrame:
    """Per (query, cell): number of candidates ordered before the threshold candidate."""
    return count_before_joined(with_thresholds(queries, thresholds), pool, metric, exclude_self, block_bytes, min_blocks)


def modalities_of(df: DataFrame, col: str) -> list[str]:
    """Distinct modality codes (at most a handful) present in a table."""
    return sorted(r[0] for r in df.select(col).distinct().collect())


def first_relevant_rank(queries: DataFrame, pool: DataFrame, judgments: DataFrame | None = None,
                        metric: str = "ip", exclude_self: bool = False,
                        block_bytes: int = DEFAULT_BLOCK_BYTES, min_blocks: int = 1) -> DataFrame:
    """Rank of the first relevant candidate for every query row and pool modality.

    Relevance is given either by ``judgments`` (qid, doc_id strings) or, when it is
    None, by equal ``rel_key`` columns on both sides. Queries with no relevant
    candidate in the pool get a null rank (they still count in every mean).
    Output: (qid, q_mod, c_mod, first_rank).
    """
    queries = split_repeats(queries)
    if judgments is None:
        thr = best_relevant_by_key(queries, pool, metric, exclude_self, block_bytes, min_blocks)
    else:
        thr = best_relevant_by_judgments(queries, pool, judgments, metric, exclude_self)
    # thresholds with their query vectors, written once: read by the size check, the
    # block collect (or the co-group) and, without the vectors, by the final join
    tq = materialize(with_thresholds(queries, thr))
    cnt = count_before_joined(tq, pool, metric, exclude_self, block_bytes, min_blocks)
    ranked = sorted_join(tq.select("qid", "q_mod", F.explode("c_mods").alias("c_mod")), cnt, ["qid", "q_mod", "c_mod"], "left").select(
        "qid", "q_mod", "c_mod", (F.coalesce("n_before", F.lit(0)) + 1).alias("first_rank"))
    c_mods = modalities_of(pool, "c_mod")
    grid = queries.select("qid", "q_mod", F.explode(F.array(*[F.lit(m) for m in c_mods])).alias("c_mod"))
    return join_repeats(sorted_join(grid, ranked, ["qid", "q_mod", "c_mod"], "left"))
