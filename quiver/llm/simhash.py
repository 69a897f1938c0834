"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits. To find all pairs of fingerprints that
differ in at most four bits, the fingerprint is cut into three segments of 22,
21 and 21 bits, each read as a word of the perfect binary Golay code (23, 12, 7):
every 23-bit word has exactly one codeword within three bits, named by a 12-bit
index. Two fingerprints at distance four or less have a midpoint at distance two
or less from both; by the pigeonhole rule its errors fall on one segment (one or
two of them) or on two segments (one each). So the keys of a fingerprint are the
index triples of every word at distance two or less: its own triple with one
segment decoded to an index two bits away, or two segments to indices one bit
away. Few are distinct, since a word has six indices within one bit and 22 within
two: about 140 keys of 36 bits, of which two linked fingerprints share one.

Fingerprints under one key are compared directly while the key has few of them,
and what is linked there is tied to its first (no list of pairs is written).
A key with many (dense clusters) goes another exact way: two fingerprints differ
in at most ``2 r`` bits if and only if some 64-bit word lies within ``r`` bits of
both, so each such fingerprint is listed under every word of its ball and linked
to the smallest fingerprint there; no pairs are formed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, store, utf8_list
from quiver.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
DIRECT_LIMIT = 64            # fingerprints under one key that are compared pair by pair
ONE_BIT_KEYS = 6             # distinct indices of a word and the words one bit away, at most
TWO_BIT_KEYS = 24            # and two bits away, at most (1 + 5 + 16, or 1 + 21 near a codeword)
SEGMENTS = ((0, 22), (22, 21), (43, 21))     # (first bit, bits) of each segment
GOLAY_POLYNOMIAL = 0xC75     # generator of the (23, 12) Golay code, degree 11


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; no word: 0."""
    words = text.lower().split()         # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1]
        last = ends[shingle_words - 1:]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first.tolist(), last.tolist())),
                             np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at: at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null text counts as empty."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle_words) for t in utf8_list(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"),
                                   "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay keys

@lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and lower 11 bits, and the error pattern of each syndrome."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word
    upper = np.array([remainder(x << 11) for x in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for n in range(4):
        for places in combinations(range(23), n):
            pattern = sum(1 << p for p in places)
            errors[remainder(pattern)] = pattern
    return upper, np.arange(1 << 11, dtype=np.int64), errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    upper, lower, errors = _golay_tables()
    return (words ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]) >> 11


def _distinct_first(values: np.ndarray, most: int) -> np.ndarray:
    """The distinct values of each row in ``most`` columns, filled up with the row's first column."""
    own, ordered = values[:, :1], np.sort(values, axis=1)
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    found = np.repeat(own, most, axis=1)
    rows, columns = np.nonzero(fresh)
    found[rows, (np.cumsum(fresh, axis=1) - 1)[rows, columns]] = ordered[rows, columns]
    return found


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint, each key once per row."""
    fps = fps.view(np.uint64)
    own, one, two = [], [], []           # per segment: index of the word, and of the words one or two bits away
    for first, width in SEGMENTS:
        word = ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None]
        bits = 1 << np.arange(width)
        x, y = np.triu_indices(width, 1)
        singles = golay_index(word ^ np.concatenate(([0], bits)))
        doubles = golay_index(word ^ (bits[x] | bits[y]))
        own.append(singles[:, :1])
        one.append(_distinct_first(singles, ONE_BIT_KEYS))
        two.append(_distinct_first(np.concatenate((singles, doubles), axis=1), TWO_BIT_KEYS))
    places = (24, 12, 0)
    base = sum(o << p for o, p in zip(own, places))
    keys = [base ^ ((two[s] ^ own[s]) << places[s]) for s in range(3)]
    for s, t in combinations(range(3), 2):
        both = ((one[s] ^ own[s]) << places[s])[:, :, None] ^ ((one[t] ^ own[t]) << places[t])[:, None, :]
        keys.append(base ^ both.reshape(len(fps), -1))
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def _emit_keys(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 2048):
            part = fps[at: at + 2048]
            rows, keys = golay_keys(part)
            yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(part[rows])})


def _smallest_linked(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint, its place or that of the first one it reaches over links within the key."""
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        least = np.where(close, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _direct_links(max_bits: int):
    """Compares all fingerprints of a key; what is linked there is tied to its first, not pair by pair."""
    def run(batches):
        for batch in batches:
            left, right = [], []
            for members in batch.column("members").to_pylist():
                fps = np.array(sorted(members), np.int64).view(np.uint64)
                first = _smallest_linked(fps, max_bits)
                tied = np.nonzero(first != np.arange(len(fps)))[0]
                left.append(fps[tied])
                right.append(fps[first[tied]])
            if left:
                yield pa.record_batch({"a": pa.array(np.concatenate(left).view(np.int64)),
                                       "b": pa.array(np.concatenate(right).view(np.int64))})
    return run


def _ball(radius: int) -> np.ndarray:
    """All 64-bit words with at most ``radius`` ones."""
    return np.array([sum(1 << p for p in places) for n in range(radius + 1)
                     for places in combinations(range(64), n)], np.uint64)


def _emit_ball(radius: int):
    def run(batches):
        ball = _ball(radius)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64):
                part = fps[at: at + 64]
                words = (part[:, None] ^ ball[None, :]).reshape(-1)
                yield pa.record_batch({"word": pa.array(words.view(np.int64)),
                                       "fp": pa.array(np.repeat(part, len(ball)).view(np.int64))})
    return run


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, direct_limit: int = DIRECT_LIMIT) -> DataFrame:
    """Links (a, b) with the same components as all pairs within ``max_bits`` bits of each other.

    ``max_bits`` is 1 to 4 (the keys are built for four). Under sparse keys all
    pairs are compared and linked ones tied to the first; dense keys tie the
    fingerprints around a word to the smallest there. Rows stay below the number
    of fingerprints times keys in either case.
    """
    if not 1 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 1 to {MAX_BITS}")
    # a fingerprint is few bytes but gives some hundred keys: as many tasks as shuffles have, not one by the size of the rows
    tasks = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = distinct_fps.repartition(tasks).mapInArrow(_emit_keys, "key long, fp long")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = keys.join(counts.hint("merge"), "key")       # sizes before the key step mislead the planner
    direct = (sized.filter(F.col("n") <= direct_limit).groupBy("key").agg(F.collect_list("fp").alias("members"))
              .mapInArrow(_direct_links(max_bits), "a long, b long"))
    crowded = sized.filter(F.col("n") > direct_limit).select("fp").distinct()
    # an odd bound leaves one bit to one side: its ball is one bit smaller
    wide = crowded.mapInArrow(_emit_ball((max_bits + 1) // 2), "word long, fp long")
    narrow = wide if max_bits % 2 == 0 else crowded.mapInArrow(_emit_ball(max_bits // 2), "word long, fp long")
    heads = narrow.groupBy("word").agg(F.min("fp").alias("head"))
    if max_bits % 2 == 0:
        heads = narrow.groupBy("word").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    starred = wide.join(heads.hint("merge"), "word").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return direct.union(starred).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (columns doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints that differ
    in ``max_bits`` bits or fewer. Null text counts as empty: like every text
    without a word it has fingerprint zero and links like any other. Repeated
    rows stay and share a component. A null doc_id stays a row, but never names a
    component unless no id is known (then null). An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    fps, _ = store(fingerprints(docs, shingle_words), "fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found, found_path = store(links(groups.select("fp"), max_bits), "simhash-links")
    roots = connected_components(found, "a", "b")
    drop(spark, found_path)
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, all columns kept.

    Rows that repeat a doc_id are one document here and stay together; rows with
    a null doc_id stay.
    """
    found = near_duplicates(docs, shingle_words, max_bits)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
