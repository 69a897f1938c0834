"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

The shingles of a text (five words each; a shorter text is one shingle) are
hashed once. The upper eight bits of a hash name one of 256 bins and each bin
keeps its smallest hash. An empty bin takes the value of another bin: every bin
has its own fixed order in which it tries the others (optimal densification), so
equal texts fill alike and unequal ones independently. The low four bits of each
bin are packed into 16 words, written as 256 hexadecimal digits. The likeness of
two fingerprints is the share of equal digits, corrected for the one in sixteen
that agree by chance.

Texts are compared with their neighbours in descending doc_id order. Id
boundaries (quantiles) cut that order into buckets of like size; a bucket is one
window, and the first row of every bucket is copied to the end of the bucket
before it, so texts are shuffled once and no window spans the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.spans import let

SHINGLE_WORDS = 5
BINS = 256                   # the upper eight bits of a hash
BITS = 4                     # kept of each bin
TRIES = 24                   # bins looked at in turn before all others are gone through
BUCKETS_PER_PARTITION = 4
EMPTY_BIN = (1 << 56) - 1    # lower 56 bits of a bin without a shingle

_BLANKS = " \t\n\x0b\f\r"


def _first_of_bins(hashes: Column) -> Column:
    """The smallest hash of each bin, in bin order; a bin without any has EMPTY_BIN in its lower bits."""
    markers = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                          lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(EMPTY_BIN)))
    ordered = F.sort_array(F.concat(hashes, markers))
    return let(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (
        F.shiftright(x, 56) != F.shiftright(F.get(o, i - 1), 56))))


def _densified(bins: Column) -> Column:
    """Every empty bin takes the value of the first filled bin in its own order of all bins."""
    def value(found: Column, at: Column) -> Column:
        taken = F.get(found, at.bitwiseAND(F.lit(BINS - 1)))
        return F.when(taken.bitwiseAND(F.lit(EMPTY_BIN)) != EMPTY_BIN, taken)

    def fill(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # an odd stride goes through all bins; start and stride come from the bin's number alone
            code = F.hash(i)
            start, stride = code.bitwiseAND(F.lit(BINS - 1)), F.shiftright(code, 8).bitwiseOR(F.lit(1))
            spots = [value(found, start + stride * t) for t in range(TRIES)]
            rest = F.aggregate(F.sequence(F.lit(TRIES), F.lit(BINS - 1)), F.lit(None).cast("long"),
                               lambda a, t: F.coalesce(a, value(found, start + stride.bitwiseAND(F.lit(BINS - 1)) * t)))
            return F.when(x.bitwiseAND(F.lit(EMPTY_BIN)) != EMPTY_BIN, x).otherwise(F.coalesce(*spots, rest))
        return F.transform(found, one)

    return let(bins, fill)


def _packed(bins: Column) -> Column:
    """The low bits of all bins, 16 bins in each long."""
    per = 64 // BITS
    return let(bins, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda w: F.aggregate(
        F.slice(b, w * per + 1, F.lit(per)), F.lit(0).cast("long"),
        lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1))))))


def signature(text: Column) -> Column:
    """The packed fingerprint as an array of longs; null for a text without a word."""
    words = F.split(F.btrim(F.lower(text), F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(codes: Column) -> Column:
        spots = F.sequence(F.lit(0), F.greatest(F.size(codes) - SHINGLE_WORDS, F.lit(0)))
        return F.transform(spots, lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(SHINGLE_WORDS)]))

    made = _packed(_densified(_first_of_bins(let(hashed, shingles))))
    return F.when(F.length(F.btrim(text, F.lit(_BLANKS))) > 0, made)


def as_text(packed: Column) -> Column:
    """256 hexadecimal digits; the empty string for a text without a word."""
    return F.coalesce(F.lower(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; two texts without a word are alike, one without is unlike."""
    def unequal(x: Column, y: Column) -> Column:
        diff = x.bitwiseXOR(y)
        for step in (1, 2):
            diff = diff.bitwiseOR(F.shiftrightunsigned(diff, step))
        return F.bit_count(diff.bitwiseAND(F.lit(0x1111111111111111)))
    wrong = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, d: n + d)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - wrong / BINS - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def _bucket(order: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``order``, found in two steps over about sqrt(n) bounds each."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i: i + step] for i in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= order))
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    return let(below(heads), lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + below(F.get(inner, k - 1))))


def _in_buckets(docs: DataFrame) -> DataFrame:
    """doc_id, text, order, bucket, halo: all rows, and behind each bucket a copy of the row that follows it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("order", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("bucket", _bucket(F.col("order"), bounds))
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("order").alias("head")).collect())
    if not heads:
        return rows.withColumn("halo", F.lit(False))
    buckets = [b for b, _ in heads]
    # the row after a bucket is the head of the next lower bucket; after the lowest comes the first of all
    copies = [(head, above) for (_, head), above in zip(heads, buckets[1:] + buckets[:1])]
    halo = spark.createDataFrame(copies, "head long, target int")         # one row per bucket
    copied = rows.join(F.broadcast(halo), rows["order"] == halo["head"]).select(
        "doc_id", "text", "order", F.col("target").alias("bucket"), F.lit(True).alias("halo"))
    return rows.withColumn("halo", F.lit(False)).unionByName(copied)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's, in descending doc_id order;
    the first document follows the last. Null text is empty; a null doc_id comes
    after all others; rows with one doc_id follow each other by their texts. A
    single row is its own next. An empty table gives no rows; other columns are
    ignored.
    """
    follows = Window.partitionBy("bucket").orderBy("halo", F.desc("order"), "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    arranged = (_in_buckets(docs).withColumn("next_text", F.lead("text").over(follows))
                .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut),
                                               F.substring(F.col("next_text"), F.lit(1), cut)))
                .withColumn("own", signature(F.col("text")))
                .withColumn("n_chars", n.cast("long")))
    made = arranged.withColumn("next_own", F.lead("own").over(follows)).filter(~F.col("halo"))
    changed = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
                          signature(F.col("edited")).alias("changed"))
    return changed.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                          as_text(F.col("changed")).alias("edited_fingerprint"),
                          likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                          likeness(F.col("own"), F.col("next_own")).alias("near_next"))
