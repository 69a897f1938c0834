"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Every text is a bag of hashed features, runs of one and two words. The corpus
and the target are counted in an array of BUCKETS, and a bucket's gain is the
log ratio of its smoothed shares in both; a document weighs the mean gain of its
features. A Gumbel draw seeded by the document's id is added, and the documents
with the highest sums are those that sampling without replacement would draw.

Ranks come from a least-significant-digit radix sort over the cluster: the
composite key (score downwards, then id) is cut into digits of DIGIT_BITS bits,
and each pass is a stable counting sort. The rows lie in blocks of consecutive
places; a pass counts each digit in each block, turns the counts into global
prefix offsets, and an offset plus the row's place among the equal digits of its
block is its place after the pass. The last pass's places are the final ranks.
Blocks are of equal size after each pass whatever the keys, so no key is hot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import drop, store, utf8_list

BUCKETS = 10_000
SCALE = 1000                 # gains and draws are whole thousandths
SEED = 7
LEAST_WORDS = 20             # documents with fewer words are never drawn
PERCENT = 25                 # of the others, rounded down
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 20         # places of a block, at most
BLOCKS_A_PARTITION = 8       # so that blocks spread evenly over the shuffle partitions
SLICE_BYTES = 1 << 20        # bytes whose features are computed at once
LONG_WORD = 64               # longer words are hashed one by one

# The table of the CRC-32 of zlib and PNG (reflected polynomial EDB88320), by its rule.
_table = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _table = np.where(_table & 1, (_table >> 1) ^ np.uint32(0xEDB88320), _table >> 1)
CRC_TABLE = _table


# ---------------------------------------------------------------- features

def _continued(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each word; words up to LONG_WORD byte by byte for all at once."""
    state = state.copy()
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    sizes = size[order]
    first = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))         # words before it are long
    for k in order[:first]:
        word = raw[start[k]: start[k] + size[k]].tobytes()
        state[k] = zlib.crc32(word, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short, sizes = order[first:], sizes[first:]
    now, at = state[short], start[short]
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, side="left"))                 # words of more than i bytes stand first
        now[:n] = (now[:n] >> np.uint32(8)) ^ CRC_TABLE[(now[:n] ^ raw[at[:n] + i]) & np.uint32(255)]
    state[short] = now
    return state


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every feature of every text, and the number of words of each text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    capital = (raw >= 65) & (raw <= 90)
    low = np.where(capital, raw | 32, raw)
    inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    first = np.zeros(len(raw) + 1, bool)                                  # where a text begins
    first[ends[ends < len(raw)]] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    start = np.nonzero(inside & (~before | first[:-1]))[0]
    end = np.nonzero(inside & (~after | first[1:]))[0] + 1
    owner = np.searchsorted(ends, start, side="right")
    none = np.full(len(start), 0xFFFFFFFF, np.uint32)
    word = _continued(none, low, start, end - start)
    paired = np.nonzero(owner[:-1] == owner[1:])[0]
    spaced = (word[paired] >> np.uint32(8)) ^ CRC_TABLE[(word[paired] ^ np.uint32(32)) & np.uint32(255)]
    pair = _continued(spaced, low, start[paired + 1], (end - start)[paired + 1])
    crc = np.concatenate((word, pair)) ^ np.uint32(0xFFFFFFFF)
    return (np.concatenate((owner, owner[paired])), (crc % np.uint32(BUCKETS)).astype(np.int64),
            np.bincount(owner, minlength=len(texts)))


def _slices(texts: list[bytes]):
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all the texts (column ``text``) fall into each bucket.

    A task adds up its own array; what reaches the driver is one sum a bucket.
    """
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = utf8_list(batch.column("text"))
            for i, j in _slices(found):
                total += np.bincount(features(found[i:j])[1], minlength=BUCKETS)
        bucket = np.nonzero(total)[0]
        yield pa.record_batch({"bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(total[bucket])})
    counts = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of each bucket's smoothed share in the target and the corpus."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; the array of gains has a fixed size."""
    def weigh(batches):
        for batch in batches:
            texts = utf8_list(batch.column("text"))
            for i, j in _slices(texts):
                owner, bucket, words = features(texts[i:j])
                n = np.bincount(owner, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, owner, gain[bucket])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(words.astype(np.int64)),
                                       "n_features": pa.array(n.astype(np.int64)), "weight": pa.array(total // np.maximum(n, 1))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Whole thousandths of the Gumbel draw that the id seeds."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# ---------------------------------------------------------------- radix sort

def digits_of(keys: list[tuple[Column, int]], bits: int = DIGIT_BITS) -> list[Column]:
    """The digits of a composite key, least significant first; ``keys`` are (non-negative long, its bits), major first."""
    found = []
    for key, width in reversed(keys):
        found += [F.shiftright(key, at).bitwiseAND((1 << bits) - 1) for at in range(0, width, bits)]
    return found


def radix_ranks(rows: DataFrame, keys: list[tuple[Column, int]], count: int, bits: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """``rows`` (stored; ``place`` a distinct long) with ``rank``, their place from 0 by ``keys``; equal keys keep their order.

    ``count`` is the number of rows. ``place`` may leave gaps at first.
    """
    spark = rows.sparkSession
    if block_rows is None:
        blocks = BLOCKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
        block_rows = min(BLOCK_ROWS, -(-count // blocks) or 1)
    carried, path, block = rows.columns, None, F.expr(f"place div {block_rows}")
    digits = digits_of(keys, bits) or [F.lit(0).cast("long")]
    for n, digit in enumerate(digits):
        cut = rows.withColumn("_digit", digit).withColumn("_block", block)
        counts = cut.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
        # where a digit begins: one row a digit, of which there are 2**bits; where a block's share of it begins: by digit
        starts = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select(
            "_digit", (F.sum("_n").over(Window.orderBy("_digit")) - F.col("_n")).alias("_start"))
        shares = counts.select("_digit", "_block", (F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")).alias("_before"))
        offsets = shares.join(starts, "_digit").select("_digit", "_block", (F.col("_start") + F.col("_before")).alias("_offset"))
        within = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("place")) - 1
        sorted_rows = (cut.withColumn("_within", within).join(offsets, ["_digit", "_block"])
                       .withColumn("place", F.col("_offset") + F.col("_within")).select(*carried))
        if n + 1 == len(digits):
            return sorted_rows.withColumnRenamed("place", "rank")
        (rows, stored), last = store(sorted_rows, "radix"), path
        if last:
            drop(spark, last)
        path = stored


def _bits(least: int, most: int) -> int:
    return max(1, (most - least).bit_length())


def id_keys(doc_id: Column, first: int, last: int) -> list[tuple[Column, int]]:
    """Keys in the order of ids from ``first`` to ``last``, null last."""
    if last - first + 1 < 1 << 62:
        return [(F.coalesce(doc_id - F.lit(first), F.lit(last - first + 1)), _bits(first, last + 1))]
    return [(F.coalesce(F.shiftright(doc_id, 32) + (1 << 31), F.lit(1 << 32)), 33),      # halves: their distance is no long
            (F.coalesce(doc_id, F.lit(0)).bitwiseAND((1 << 32) - 1), 32)]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS,
             digit_bits: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has texts.

    ``rank`` is 1, 2, 3, ... down the drawn documents and null for the others;
    of equal scores the smaller id comes first, a null id last, and repeated
    rows one after the other. Null text has no words: weight 0, never drawn. A
    target without words weighs buckets by how rare they are. An empty table
    gives no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored, _ = store(weighed.withColumn("place", F.monotonically_increasing_id()), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    span = fit.agg(F.count(F.lit(1)), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    count, low, high, first, last = (x or 0 for x in span)
    out = ["doc_id", "n_features", "weight", "score"]
    keys = [(F.lit(high) - F.col("score"), _bits(low, high)), *id_keys(F.col("doc_id"), first, last)]
    ranked = radix_ranks(fit.select(*out, "place"), keys, count, digit_bits, block_rows)
    drawn = F.when(F.col("rank") < count * percent // 100, F.col("rank") + 1).cast("long")
    return ranked.select(*out, drawn.alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
