"""URL filter: rules first, boosted trees on lexical features for the URLs that no rule meets.

The URLs that a rule judges are the labelled ones. They are split in halves by a
hash of the URL: one half gives the suffix statistics (how often the URLs that
end their host in ``com``, ``example.com``, ..., begin their path in ``/fr/`` or
end it in ``.html`` are blocked, and how many URLs do so), the other half is
what the trees are fitted on, so that no URL's own label is among its features.

Counts run over all URLs. The fit sees at most TRAIN_ROWS labelled URLs (those
with the smallest hashes, as many of each verdict, weighed by how many they stand
for), so what its one task holds is bounded; it is gradient boosting of the
logistic loss by Newton steps over quantile bins. Every URL is scored in its own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, store

#: (verdict, host and path): fits the host and its subdomains where the path begins so; the longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
TRAIN_ROWS = 20_000          # labelled URLs that the fit sees, at most
TREES, DEPTH, RATE = 60, 4, 0.2
BINS = 64                    # quantile bins of a feature
PENALTY = 1.0                # added to the second derivatives of a leaf
LEAST_GAIN = 1e-3
PRIOR_URLS = 4.0             # URLs without a tendency that each suffix starts with
SLICE_BYTES = 1 << 20        # bytes whose features are computed at once

KEYS = ("tld", "domain", "site", "directory", "extension")
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "url_digits", "host_digits",
           "url_entropy", "host_entropy", "parameters", "query_length", "hyphens", "fragment")
COUNTED = KEYS[:3]           # parts whose number of URLs is a feature too; of path parts it would just name them
STATISTICS = (*(f"{k}_blocked" for k in KEYS), *(f"{k}_urls" for k in COUNTED))
FEATURES = (*LEXICAL, *STATISTICS)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- parts and rules

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/?#``, A-Z in lower case) and path (on to ``?#``); both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(reversed(rules), key=lambda r: len(r[1])):      # later ones stand before earlier ones
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------- lexical features

def _entropy(owner: np.ndarray, raw: np.ndarray, rows: int) -> np.ndarray:
    """Shannon entropy in bits of the bytes of each row."""
    pairs, n = np.unique(owner * 256 + raw, return_counts=True)
    row = pairs >> 8
    total = np.bincount(row, n, rows)
    share = n / total[row]
    return np.bincount(row, -share * np.log2(share), rows)


def _bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.repeat(np.arange(len(texts)), sizes), sizes


def lexical(urls: list[bytes], hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    """The features named in LEXICAL, one row per URL."""
    rows = len(urls)
    raw, owner, size = _bytes_of(urls)
    host, host_owner, host_size = _bytes_of(hosts)

    def share(owner, hit, size):
        return np.bincount(owner, hit, rows) / np.maximum(size, 1)
    queries = [u.partition(b"#")[0].partition(b"?")[2] for u in urls]
    return np.column_stack([
        size, host_size, [len(p) for p in paths], [sum(map(bool, p.split(b"/"))) for p in paths],
        [h.count(b".") + 1 if h else 0 for h in hosts],
        share(owner, (raw >= 48) & (raw <= 57), size), share(host_owner, (host >= 48) & (host <= 57), host_size),
        _entropy(owner, raw, rows), _entropy(host_owner, host, rows),
        [sum(map(bool, q.replace(b";", b"&").split(b"&"))) for q in queries], [len(q) for q in queries],
        [h.count(b"-") for h in hosts], [b"#" in u for u in urls]]).astype(np.float64)


# ---------------------------------------------------------------- boosted trees

class Trees:
    """Complete binary trees: feature and threshold of every inner place, value of every leaf."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.threshold, self.value = start, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of a block, from 0 to 1."""
        total, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (x[row, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For derivatives summed by (node, feature, bin): gain, feature and last left bin of each node's best split.

    Cuts in a stretch that no row of the node lies in are equally good; the middle one is taken.
    """
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]

    def value(g, h):
        return g * g / (h + penalty)
    gain = value(left_g, left_h) + value(all_g - left_g, all_h - left_h) - value(all_g, all_h)
    flat = gain.reshape(len(g), -1)
    node, best = np.arange(len(g)), flat.argmax(axis=1)
    feature, first = best // gain.shape[2], best % gain.shape[2]
    at = np.arange(gain.shape[2])
    same = (left_h[node, feature] == left_h[node, feature, first][:, None]) & (at >= first[:, None])
    return flat[node, best], feature, first + (same.sum(axis=1)) // 2


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees fitted to labels ``y`` (1: block); one label alone gives no trees, none at all an even start."""
    weight = np.ones(len(y)) if weight is None else weight * len(y) / max(weight.sum(), 1e-300)
    ones = float((weight * y).sum())
    start = float(np.log((ones + 1) / (len(y) - ones + 1)))
    inner = (1 << depth) - 1
    if y.all() or not y.any():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(width)]
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])    # bin b: at most cuts[b]
    place = (np.arange(width) * BINS + bins).ravel()
    margin, found = np.full(n, start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            cell = np.repeat((at - first) * width * BINS, width) + place
            g, h = (np.bincount(cell, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS) for w in (grad, hess))
            gain, f, b = best_splits(g, h)
            for k in np.nonzero(gain > LEAST_GAIN)[0]:
                if b[k] < len(cuts[f[k]]):
                    feature[first + k], threshold[first + k] = f[k], cuts[f[k]][b[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + PENALTY)
        margin += value[leaf]
        found.append((feature, threshold, value))
    return Trees(start, *(np.array(c) for c in zip(*found)))


# ---------------------------------------------------------------- jobs

def _keyed(urls: DataFrame) -> DataFrame:
    """``urls`` (url and more) with host, path and the five parts that statistics are kept of."""
    host, path = host_and_path(F.col("url"))
    keyed = urls.withColumn("host", host).withColumn("path", path)
    keyed = keyed.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("host", "path")})
    last = [F.substring_index("host", ".", -n) for n in (1, 2, 3)]
    return keyed.withColumns(dict(zip(KEYS, [
        *last, F.regexp_extract("path", r"^/[^/]*/?", 0), F.regexp_extract("path", r"\.([^./]*)/?$", 1)])))


def suffix_statistics(keyed: DataFrame) -> DataFrame:
    """One row for each combination of KEYS: for each part how many URLs (logarithm) share it, and the share of blocks.

    ``keyed`` has KEYS, ``seen`` (1 for a URL whose label counts) and ``blocked``.
    Rows are summed by combination first, so no part gathers its URLs anywhere.
    """
    sums = [F.sum(c).alias(c) for c in ("urls", "seen", "blocked")]
    combos, _ = store(keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("urls"), *[F.sum(c).cast("long").alias(c) for c in ("seen", "blocked")]),
                      "url-combinations")
    parts = combos.select(*KEYS, "urls", "seen", "blocked", F.posexplode(F.array(*KEYS)).alias("kind", "part"))
    totals, _ = store(parts.groupBy("kind", "part").agg(*sums), "url-suffixes")
    joined = parts.select(*KEYS, "kind", "part").join(totals, ["kind", "part"])
    share = (F.col("blocked") + PRIOR_URLS / 2) / (F.col("seen") + PRIOR_URLS)
    return joined.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("kind") == i, share)).alias(f"{k}_blocked") for i, k in enumerate(KEYS)],
        *[F.max(F.when(F.col("kind") == i, F.log1p(F.col("urls").cast("double")))).alias(f"{k}_urls") for i, k in enumerate(COUNTED)])


def _features(batch: pa.RecordBatch):
    """Slices of a batch with the features of their rows."""
    texts = [[x or b"" for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("url", "host", "path")]
    given = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]) if batch.num_rows else None
    first, size = 0, 0
    for i, url in enumerate(texts[0]):
        size += len(url)
        if size >= SLICE_BYTES or i + 1 == batch.num_rows:
            yield batch.slice(first, i + 1 - first), np.hstack([lexical(*(t[first:i + 1] for t in texts)), given[first:i + 1]])
            first, size = i + 1, 0


def _fit_in_task(batches):
    x, y, weight = [np.zeros((0, len(FEATURES)))], [], []
    for batch in batches:
        for rows, features in _features(batch):
            x.append(features)
            y += rows.column("label").to_pylist()
            weight += rows.column("weight").to_pylist()
    model = boost(np.vstack(x), np.array(y, np.float64), np.array(weight, np.float64))
    yield pa.record_batch({"start": pa.array([model.start])} | {
        c: pa.array([np.ascontiguousarray(v, t).tobytes()]) for c, v, t in (
            ("feature", model.feature, np.int64), ("threshold", model.threshold, np.float64), ("value", model.value, np.float64))})


def _statistics_half(url="url"):
    return F.pmod(F.xxhash64(url), F.lit(2)) == 0


def train(urls: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Trees, DataFrame]:
    """Trees and suffix statistics from ``urls`` (url, label: 1 block, 0 allow, null unknown).

    Every URL counts in the statistics' sizes; a labelled URL either gives its
    label to them or may be fitted on, once however often it occurs.
    """
    keyed = _keyed(urls.select("url", F.col("label").cast("int").alias("label")))
    seen = F.when(F.col("label").isNotNull() & _statistics_half(), 1).otherwise(0)
    statistics, _ = store(suffix_statistics(keyed.withColumn("seen", seen).withColumn("blocked", F.coalesce(F.col("label"), F.lit(0)) * seen)),
                          "url-statistics")
    fitted, fitted_path = store(urls.where(F.col("label").isNotNull() & F.col("url").isNotNull() & ~_statistics_half())
                                .groupBy("url").agg(F.max("label").cast("int").alias("label")), "url-labelled")
    there = {r["label"]: r["n"] for r in fitted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = train_rows // 2
    chosen = [fitted.where(F.col("label") == v).orderBy(F.xxhash64(F.lit(1), "url"), "url").limit(half)
              .withColumn("weight", F.lit(max(1.0, there.get(v, 0) / half))) for v in (0, 1)]
    rows = _keyed(chosen[0].unionByName(chosen[1])).join(statistics, list(KEYS))
    sample, path = store(rows.select("url", "host", "path", "label", "weight", *STATISTICS), "url-sample")
    found = sample.coalesce(1).mapInArrow(_fit_in_task, "start double, feature binary, threshold binary, value binary").collect()
    drop(urls.sparkSession, path)
    drop(urls.sparkSession, fitted_path)
    inner = (1 << DEPTH) - 1
    if not found:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0)), statistics
    feature, threshold, value = (np.frombuffer(found[0][c], t).reshape(-1, w) for c, t, w in (
        ("feature", np.int64, inner), ("threshold", np.float64, inner), ("value", np.float64, inner + 1)))
    return Trees(found[0]["start"], feature, threshold, value), statistics


def score(pages: DataFrame, model: Trees, statistics: DataFrame) -> DataFrame:
    """(page_id, url, host, path, score): the chance of a block for every row of ``pages`` (page_id, url)."""
    def run(batches):
        for batch in batches:
            for rows, features in _features(batch):
                yield pa.record_batch({c: rows.column(c) for c in ("page_id", "url", "host", "path")}
                                      | {"score": pa.array(model.score(features), pa.float64())})
    # every combination of parts has its row of statistics, since they were counted over these URLs
    keyed = _keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).join(statistics, list(KEYS), "left")
    filled = keyed.fillna(0.5, list(STATISTICS[:len(KEYS)])).fillna(0.0, list(STATISTICS[len(KEYS):]))
    return filled.select("page_id", "url", "host", "path", *STATISTICS).mapInArrow(
        run, "page_id long, url string, host string, path string, score double")


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages`` (page_id, url).

    ``rule`` is the longest rule that fits (null: none) and gives the verdict;
    where none fits, the trees do: block at a score of a half or more. A null URL
    and one without ``://`` have an empty host and path, and are scored like any
    other. Repeated rows and null ids give rows of their own; without a labelled
    URL nothing is known and URLs are allowed; an empty table gives no rows;
    other columns are ignored.
    """
    def ruled(urls: DataFrame) -> DataFrame:
        rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
        return urls.withColumn("rule", rule).withColumn("verdict", verdict)
    labelled = ruled(_keyed(pages.select("url"))).select("url", F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0).alias("label"))
    model, statistics = train(labelled, train_rows)
    blocked = (F.col("score") >= 0.5) if len(model.value) or model.start else F.lit(False)
    return (ruled(score(pages, model, statistics))
            .withColumn("verdict", F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "score"))
