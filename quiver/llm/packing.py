"""Best-fit packing of documents into training sequences, in bulk-synchronous steps.

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are
interchangeable, and so are sequences with one gap; both are therefore kept as
runs of consecutive ranks. Pieces are ranked over the cluster by length (longest
first, salted by a hash so that a length shared by a third of all pieces is
ranked in many tasks). A step takes all pieces of the next length at once: a
sweep from the smallest gap that fits upwards gives each run of gaps the next
ranks (rank decides who gets which), gaps are updated, and new sequences are
opened for the ranks left over. Steps repeat down to length one, so the result is
that of best-fit decreasing. A sweep sees runs, of which there are at most a few
per length, never pieces: what it keeps is bounded by ``capacity`` whatever the
size of the corpus. The matches are then applied to all pieces in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import store, utf8_list
from quiver.llm.tokens import in_slices, piece_ids

CAPACITY = 4096
END_ID = 1
RANKED_TOGETHER = 500_000    # pieces of one length that one task ranks, about


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each text, then END_ID, cut at ``capacity``."""
    def run(batches):
        ids_of = piece_ids(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), utf8_list(batch.column("text"))
            for first, last in in_slices(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[first:last], ids_of.texts(texts[first:last])):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at: at + 4 * capacity]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
                                      + [pa.array(c, pa.int64()) for c in columns[2:]],
                                      ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_steps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of matches, one row each, sorted by length and first rank.

    Columns: length, first rank, pieces per sequence, first sequence, offset of
    the first piece there. ``counts`` has the number of pieces of each length.
    """
    runs: dict[int, list[tuple[int, int]]] = {}      # gap -> runs (first sequence, number)
    gaps: list[int] = []                             # the gaps of which there are runs, ascending
    opened, matches = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):                      # no gap fits: open sequences for all that are left
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            per = min(gap // length, left)
            used = min(n, left // per)
            matches.append((length, rank, per, first, capacity - gap))
            put(gap - per * length, first, used)
            put(gap, first + used, n - used)
            rank += used * per
            left -= used * per
    return np.array(sorted(matches), np.int64).reshape(-1, 5)


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with its rank (from 0) among the pieces of its length."""
    salts = found.count() // RANKED_TOGETHER + 1
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    return (salted.withColumn("place", place).join(before.select("length", "salt", "before"), ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("place") - 1).drop("salt", "place", "before"))


def _apply(matches: np.ndarray):
    starts = matches[:, 0] * (1 << 44) + matches[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            found = matches[np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1]
            within = rank - found[:, 1]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(columns | {
                "sequence_id": pa.array(found[:, 3] + within // found[:, 2]),
                "offset": pa.array(found[:, 4] + within % found[:, 2] * length)})
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``docs`` has doc_id and text; other columns are ignored. Null or empty text
    is one piece of the end id. Repeated rows and null ids are packed like any
    other row; an empty table gives no rows. ``tokenizer`` is the path of a
    vocabulary file (None: the installed public one).
    """
    found, _ = store(pieces(docs, capacity, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return ranked(found).mapInArrow(
        _apply(plan_steps(counts, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
