"""Removal of repeated strings over a whole corpus by a sparse, hash-compared suffix sort.

Every byte covered by a string of WIDTH bytes that also starts earlier (smaller
doc_id, or same document and earlier start) is removed. Texts are UTF-8 bytes.

1. Each text is cut into runs of windows under one content-defined anchor
   (``suffix_scan``): one row per 30 bytes or so, instead of one per byte.
   Equal windows have equal anchors, so anchors seen once drop out.
2. A run whose whole content was seen earlier is repeated throughout.
3. Distinct contents under one anchor may still share some windows (the edges of
   copied passages). Their texts are sorted as suffixes on both sides of the
   anchor (``suffix_sort``), which tells for every window whether an earlier
   content has it. Tasks hold a few anchors at a time; an anchor with more than
   SORTED_TOGETHER contents (a short line that a third of all documents have)
   goes by the windows' digests instead, grouped over the cluster.
4. The repeated stretches of each document are joined to its text and removed.

Hot strings are counted with partial aggregation and joined with splittable
sort-merge joins; no step gathers the rows of one string in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, release, store, utf8_list
from quiver.llm.suffix_scan import runs
from quiver.llm.suffix_sort import repeated_windows

WIDTH = 100
SORTED_TOGETHER = 20_000     # contents of one anchor that one task sorts, at most
BLOCK_CONTENTS = 30_000      # contents sorted at once
VERSION_SHIFT = 40           # texts that share a doc_id are told apart in the upper bits of a start


def _versioned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, version, doc_id, text), and the same without rows that repeat id and text.

    Null ids come first; different texts under one id are numbered.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc")
    if shared.isEmpty():
        rows = rows.withColumn("version", F.lit(0).cast("long"))
        return rows, rows
    texts = (rows.join(shared, "doc", "left_semi").select("doc", F.sha2("text", 256).alias("sha")).distinct()
             .groupBy("doc").agg(F.array_sort(F.collect_set("sha")).alias("all")))       # the texts of one id
    rows = rows.join(texts, "doc", "left").withColumn("version", F.coalesce(
        F.array_position("all", F.sha2("text", 256)) - 1, F.lit(0)).cast("long")).drop("all")
    return rows, rows.dropDuplicates(["doc", "version"])


def _runs_of(width: int):
    def emit(batches):
        for batch in batches:
            docs, versions = (batch.column(c).to_pylist() for c in ("doc", "version"))
            parts, owners, size = [], [], 0
            for doc, version, text in zip(docs, versions, utf8_list(batch.column("text"))):
                found = runs(text, width)
                parts.append((*found[:2], found[2] + (version << VERSION_SHIFT), *found[3:]))
                owners.append(np.full(len(found[0]), doc, np.int64))
                size += len(found[0])
                if size > 100_000:
                    yield _run_batch(parts, owners)
                    parts, owners, size = [], [], 0
            if parts:
                yield _run_batch(parts, owners)
    return emit


def _run_batch(parts, owners) -> pa.RecordBatch:
    anchor, content, start, number, at = (np.concatenate(c) for c in zip(*parts))
    return pa.record_batch({"anchor": pa.array(anchor), "content": pa.array(content), "doc": pa.array(np.concatenate(owners)),
                            "start": pa.array(start), "number": pa.array(number.astype(np.int32)),
                            "at": pa.array((at - (start & ((1 << VERSION_SHIFT) - 1))).astype(np.int32))})


RUNS = "anchor long, content long, doc long, start long, number int, at int"


def _contexts(width: int):
    """The bytes of the wanted runs of each text."""
    def emit(batches):
        for batch in batches:
            rows = []
            for doc, text, wanted in zip(batch.column("doc").to_pylist(), utf8_list(batch.column("text")),
                                         batch.column("wanted").to_pylist()):
                for w in wanted:
                    start = w["start"] & ((1 << VERSION_SHIFT) - 1)
                    rows.append((w["anchor"], w["many"], doc, w["start"], w["at"], text[start: start + w["number"] + width - 1]))
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                names = ("anchor", "many", "doc", "start", "at", "context")
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))
    return emit


CONTEXTS = "anchor long, many boolean, doc long, start long, at int, context binary"
STRETCHES = "doc long, first long, last long"


def _sorted_stretches(width: int):
    """Repeated stretches of contexts that come sorted by anchor and position."""
    def solve(anchor, doc, start, at, context):
        at = np.array(at, np.int64)
        groups = np.cumsum(np.concatenate(([0], np.diff(np.array(anchor)) != 0)))
        found = repeated_windows(context, at, groups, width)[:, ::-1]          # windows from left to right
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        base = np.array(start, np.int64)[row] + at[row] - width                # start of the window ``width`` bytes before the anchor
        return pa.record_batch({"doc": pa.array(np.array(doc, np.int64)[row]), "first": pa.array(base + first),
                                "last": pa.array(base + end - 1 + width)})

    def emit(batches):
        names = ("anchor", "doc", "start", "at", "context")
        held = [[] for _ in names]
        for batch in batches:
            for h, name in zip(held, names):
                h += batch.column(name).to_pylist()
            n = len(held[0])
            if n >= BLOCK_CONTENTS:
                cut = n                                                        # the last anchor may go on
                while cut and held[0][cut - 1] == held[0][n - 1]:
                    cut -= 1
                if cut:
                    yield solve(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if held[0]:
            yield solve(*held)
    return emit


def _windows_of(width: int):
    """Digest and position of every window of each context."""
    def emit(batches):
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for doc, start, context in zip(batch.column("doc").to_pylist(), batch.column("start").to_pylist(),
                                           batch.column("context").to_pylist()):
                n = len(context) - width + 1
                keys = [digest(context[i: i + width]).to_bytes(16, "little") for i in range(n)]
                yield pa.record_batch({"key": pa.array(keys, pa.binary()), "doc": pa.array([doc] * n, pa.int64()),
                                       "start": pa.array(range(start, start + n), pa.int64())})
    return emit


def repeated_stretches(texts: DataFrame, width: int, sorted_together: int) -> list[DataFrame]:
    """Tables (doc, first, last) of stretches covered by windows that also start earlier; they may overlap."""
    spark = texts.sparkSession
    every = texts.select("doc", "version", "text").mapInArrow(_runs_of(width), RUNS)
    # both sides of this join are plain tables, so that Spark can split the rows of a hot anchor
    again, again_path = store(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    release(spark)
    shared, shared_path = store(every.join(again.hint("merge"), "anchor", "left_semi"), "shared-runs")
    drop(spark, again_path)
    release(spark)

    place = F.struct("doc", "start")
    contents, contents_path = store(shared.groupBy("anchor", "content").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("number").alias("number"), F.first("at").alias("at")), "contents")
    release(spark)
    whole, _ = store(shared.join(contents.filter("n > 1").select("anchor", "content", "first").hint("merge"), ["anchor", "content"])
                     .filter(place > F.col("first"))
                     .select("doc", F.col("start").alias("first"), (F.col("start") + F.col("number") + width - 1).alias("last")), "whole")
    drop(spark, shared_path)
    release(spark)
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = (contents.join(several.hint("merge"), "anchor").select(
        F.col("first.doc").alias("doc"), F.struct("anchor", (F.col("kinds") > sorted_together).alias("many"), F.col("first.start").alias("start"),
                                                   "number", "at").alias("w"))
              .withColumn("version", F.shiftright("w.start", VERSION_SHIFT)))
    of_doc = wanted.groupBy("doc", "version").agg(F.collect_list("w").alias("wanted"))   # runs of one text
    contexts, contexts_path = store(texts.select("doc", "version", "text").join(of_doc.hint("merge"), ["doc", "version"])
                                    .mapInArrow(_contexts(width), CONTEXTS), "contexts")
    drop(spark, contents_path)
    release(spark)

    few = contexts.filter("not many").drop("many").repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    sorted_, _ = store(few.mapInArrow(_sorted_stretches(width), STRETCHES), "sorted-stretches")
    digests = contexts.filter("many").select("doc", "start", "context").mapInArrow(_windows_of(width), "key binary, doc long, start long")
    heads, heads_path = store(digests.groupBy("key").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n"))
                              .filter("n > 1").drop("n"), "window-heads")
    by_digest, _ = store(digests.join(heads.hint("merge"), "key").filter(place > F.col("head"))
                         .select("doc", F.col("start").alias("first"), (F.col("start") + width).alias("last")), "digest-stretches")
    drop(spark, heads_path)
    drop(spark, contexts_path)
    release(spark)
    return [whole, sorted_, by_digest]


def _remove(batches):
    for batch in batches:
        rows = []
        for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), utf8_list(batch.column("text")),
                                       batch.column("found").to_pylist()):
            kept, at, removed, spans = [], 0, 0, 0
            for first, last in sorted((f["first"], f["last"]) for f in found or ()):
                if spans and first <= at:                      # touches the stretch before
                    removed += max(0, last - at)
                else:
                    kept.append(text[at:first])
                    spans, removed = spans + 1, removed + last - first
                at = max(at, last)
            kept.append(text[at:])
            rows.append((doc_id, len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        if rows:
            columns = list(zip(*rows))
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]),
                                   pa.array(columns[4], pa.string())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, sorted_together: int = SORTED_TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs`` (columns doc_id, text).

    Null text is empty; texts shorter than ``width`` lose nothing. Rows that
    repeat id and text are one document and get equal results; different texts
    under one id are judged in a fixed order of their digests. Null ids come
    before all others. An empty table gives no rows; other columns are ignored.
    """
    texts, distinct = _versioned(docs)
    parts = repeated_stretches(distinct, width, sorted_together)
    stretches = parts[0].unionByName(parts[1]).unionByName(parts[2])
    mask = F.lit((1 << VERSION_SHIFT) - 1)
    of_doc = (stretches.withColumn("version", F.shiftright("first", VERSION_SHIFT))
              .groupBy("doc", "version").agg(F.collect_list(F.struct(
                  F.col("first").bitwiseAND(mask).alias("first"), F.col("last").bitwiseAND(mask).alias("last"))).alias("found")))
    return texts.join(of_doc.hint("merge"), ["doc", "version"], "left").select("doc_id", "text", "found").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
