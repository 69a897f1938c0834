"""Importance resampling against a plain version, the radix sort against sorting, awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import resample as R
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def bag(text):
    w = words(text)
    return [zlib.crc32(g.encode()) % 10_000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target):
    """doc_id -> (n_features, weight, score, rank) for distinct ids."""
    s, t = Counter(b for x in docs.values() for b in bag(x)), Counter(b for x in target for b in bag(x))
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = {}
    for d, text in docs.items():
        found = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in bag(text)]
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        out[d] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((d for d in docs if len(words(docs[d])) >= 20), key=lambda d: (-out[d][2], d is None, d or 0))
    for n, d in enumerate(fit[: 25 * len(fit) // 100]):
        out[d][3] = n + 1
    return {d: tuple(v) for d, v in out.items()}


def test_features_of_awkward_texts():
    draw = np.random.default_rng(1)
    texts = ["", " ", "a", "A b", "ab" * 100 + " x " + "é" * 200, "x" * 64 + " " + "y" * 65, "\x00a\x7fb", "日本 ÉCOLE école", "0-1_2"]
    texts += ["".join(draw.choice(list("aB0 é-z\n"), 200)) for _ in range(50)]
    owner, bucket, n = R.features([t.encode() for t in texts])
    assert [sorted(bucket[owner == i].tolist()) for i in range(len(texts))] == [sorted(bag(t)) for t in texts]
    assert n.tolist() == [len(words(t)) for t in texts]


def test_resampling_against_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in R.resample(docs, target).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()}, [r.text for r in target.collect()])


def test_awkward_rows(spark):
    texts = ["some words of the target " * 9, "other words entirely, " * 12, "Fünf Wörter " * 30, "x " * 19, "y " * 20]
    docs = H.awkward_docs(spark, *texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = R.resample(docs, docs.where("doc_id = 10"), percent=100).collect()
    assert len(got) == len(rows)
    fit = [r for r in got if r["rank"] is not None]
    assert sorted(r["rank"] for r in fit) == list(range(1, 1 + sum(len(words(t)) >= 20 for _, t in rows)))
    assert [r["rank"] for r in sorted(fit, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))] == list(range(1, len(fit) + 1))
    nothing = [r for r in got if r.n_features == 0]
    assert len(nothing) == 3 and all(r.weight == 0 and r["rank"] is None for r in nothing)
    assert R.resample(H.empty_docs(spark), docs).collect() == []
    assert all(r.n_features >= 0 for r in R.resample(docs, H.empty_docs(spark)).collect())


@pytest.mark.parametrize("bits,block", [(3, 7), (11, 50), (4, None)])
def test_radix_ranks_are_a_stable_sort(spark, bits, block):
    """Most rows share one key; equal keys keep their order; null ids come last."""
    draw = np.random.default_rng(2)
    rows = [(int(draw.integers(0, 9)) * int(draw.random() < 0.4), None if draw.random() < 0.05 else int(draw.integers(-40, 40)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "score long, doc_id long, mark long").repartition(5).withColumn("place", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    keys = [(F.lit(8) - F.col("score"), 4), *R.id_keys(F.col("doc_id"), -40, 39)]
    got = sorted(R.radix_ranks(df, keys, len(rows), bits, block).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(600))
    want = sorted(df.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0, r.place))
    assert [(r.score, r.doc_id, r.mark) for r in got] == [(r.score, r.doc_id, r.mark) for r in want]


def test_ids_over_the_whole_range_of_a_long(spark):
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 5, 1 << 40, -(1 << 40)]
    docs = spark.createDataFrame([(i, "same words in every text " * 5) for i in ids] + [(None, "same words in every text " * 5)], "doc_id long, text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in R.resample(docs, docs, percent=100).collect()}
    order = sorted(got, key=lambda d: (-got[d][2], d is None, d or 0))
    assert [got[d][3] for d in order] == list(range(1, 9))
