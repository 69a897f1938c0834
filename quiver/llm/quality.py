"""Quality classifier: naive-Bayes-scaled n-grams under a linear support vector machine.

A text is the set of its n-grams: byte trigrams, words and word pairs, hashed to
2**BITS indicators. Each indicator is scaled by the log ratio of its smoothed
shares in the two classes, rows are normalised, and a linear hinge-loss model is
fitted by dual coordinate descent, both classes weighing the same. Its margins
become scores by a logistic curve fitted on rows kept out of the descent, so a
score is the share of good texts at that margin.

The fit sees at most TRAIN_ROWS labelled rows (those with the smallest id
hashes), so what one task holds is bounded; every document is scored, in its own
row, without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import drop, store, text_or_empty, utf8_list
from quiver.llm.polyhash import mixed, prefixes, stretch

TRAIN_ROWS = 16_000          # labelled rows that the fit sees, at most
BITS = 18
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
CALIBRATED_SHARE = 5         # one row in so many is kept for the logistic curve
PIECE = 1 << 20              # bytes that are hashed at once, about
BLANK = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- features

def _trigrams(data: bytes) -> np.ndarray:
    """Numbers of the byte trigrams; pieces share two bytes, so none is lost at a cut."""
    found = []
    for at in range(0, max(1, len(data) - 2), PIECE):
        wide = np.frombuffer(data[at: at + PIECE + 2], np.uint8).astype(np.uint64)
        if len(wide) >= 3:
            found.append(np.unique(mixed((wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:], BITS)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _word_hashes(data: bytes) -> np.ndarray:
    """The hash of every word in order; pieces end at blanks, so no word is cut."""
    found, at = [], 0
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        raw = np.frombuffer(data[at:end], np.uint8)
        blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
        starts = np.nonzero(blank[:-1] & ~blank[1:])[0]
        if len(starts):
            found.append(stretch(prefixes(raw), starts, np.nonzero(~blank[:-1] & blank[1:])[0]))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def text_features(data: bytes) -> np.ndarray:
    """The sorted distinct n-gram numbers of a text, below 2**BITS."""
    found, words = [_trigrams(data)], _word_hashes(data)
    if len(words):
        found.append(mixed(words + np.uint64(11), BITS))
        found.append(mixed(words[:-1] * np.uint64(31) + words[1:] + np.uint64(7), BITS))
        same = words[:-1] == words[1:]
        runs = [same.any(), (same[:-1] & same[1:]).any(), (same[:-3] & same[1:-2] & same[2:-1] & same[3:]).any()]
        found.append(np.nonzero(runs)[0].astype(np.uint64))    # indicators 0 to 2: one word 2, 3, 5 times in a row
    return np.unique(np.concatenate(found)).astype(np.int32)


# ---------------------------------------------------------------- model

class Model:
    """ratio and weight of every indicator (and of the constant), and the curve's slope and shift."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, slope: float, shift: float):
        self.value, self.square = ratio * weight, ratio * ratio
        self.slope, self.shift = slope, shift

    def margin(self, features: np.ndarray) -> float:
        return (self.value[features].sum() + self.value[-1]) / np.sqrt(self.square[features].sum() + self.square[-1])

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -500, 500))))


def class_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed share of every indicator in class 1 and class 0; the constant has ratio 1."""
    shares = []
    for label in (1, 0):
        picked = [r for r, y in zip(rows, labels) if y == label]
        n = np.bincount(np.concatenate(picked), minlength=1 << BITS) + SMOOTHING
        shares.append(n / n.sum())
    return np.append(np.log(shares[0] / shares[1]), 1.0)


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray,
                 cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the hinge-loss machine on normalised scaled rows, by dual coordinate descent.

    The upper bound of a row's dual variable weighs both classes the same.
    """
    n = len(rows)
    y = np.where(labels == 1, 1.0, -1.0)
    most = np.where(labels == 1, cost * n / (2 * max(1, (labels == 1).sum())), cost * n / (2 * max(1, (labels == 0).sum())))
    full = [np.append(r, len(ratio) - 1) for r in rows]
    scaled = [ratio[r] / np.sqrt(np.square(ratio[r]).sum()) for r in full]      # rows of length one: the diagonal is 1
    weight, dual = np.zeros(len(ratio)), np.zeros(n)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            index, x = full[i], scaled[i]
            new = min(max(dual[i] - (y[i] * (weight[index] @ x) - 1.0), 0.0), most[i])
            if new != dual[i]:
                weight[index] += (new - dual[i]) * y[i] * x
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return weight


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, every row weighing the same."""
    share = 1.0 / len(labels)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (share * (p - target)) + 1e-6 * theta
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), slope)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, kept_out: np.ndarray) -> Model:
    """The model of labelled rows; without both labels (in either part) every score is that of the shift alone."""
    def both(y):
        return (y == 1).any() and (y == 0).any()
    grown = [r for r, k in zip(rows, kept_out) if not k]
    if not both(labels[~kept_out]):
        share = (labels == 1).mean() if len(labels) else 1.0
        return Model(np.append(np.zeros(1 << BITS), 1.0), np.zeros((1 << BITS) + 1), 0.0, 4.0 * (2 * share - 1))
    ratio = class_ratios(grown, labels[~kept_out])
    weight = dual_descent(grown, labels[~kept_out], ratio)
    plain = Model(ratio, weight, 1.0, 0.0)
    held = kept_out if both(labels[kept_out]) else np.ones(len(labels), bool)
    margins = np.array([plain.margin(r) for r, h in zip(rows, held) if h])
    return Model(ratio, weight, *logistic_curve(margins, labels[held]))


# ---------------------------------------------------------------- jobs

def _fit_in_task(batches):
    rows, labels, kept_out = [], [], []
    for batch in batches:
        column = batch.column("features")
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        flat_from = ends[0]
        rows += [flat[i - flat_from: j - flat_from].copy() for i, j in zip(ends[:-1], ends[1:])]
        labels += batch.column("quality").to_pylist()
        kept_out += batch.column("kept_out").to_pylist()
    model = fit(rows, np.array(labels, np.int64), np.array(kept_out, bool))
    yield pa.record_batch({"value": pa.array([model.value.tobytes()]), "square": pa.array([model.square.tobytes()]),
                           "slope": pa.array([model.slope]), "shift": pa.array([model.shift])})


def _features_of(batches):
    for batch in batches:
        found = [text_features(t) for t in utf8_list(batch.column("text"))]
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        yield pa.record_batch({"quality": batch.column("quality"), "kept_out": batch.column("kept_out"),
                               "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))})


def held_out(doc_id="doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled documents outside the held-out part.

    Labels other than 0 and 1 and null ids are ignored; a document labelled
    more than once counts once, with its smaller label.
    """
    wanted = (labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
              .withColumn("kept_out", F.pmod(F.hash("doc_id"), F.lit(CALIBRATED_SHARE)) == 0))
    chosen = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(wanted), "doc_id")  # at most train_rows rows
              .groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("kept_out").alias("kept_out"),
                                     F.max("text").alias("text"))
              .select("text", "quality", "kept_out"))
    rows, path = store(chosen.mapInArrow(_features_of, "quality int, kept_out boolean, features array<int>"), "quality-rows")
    found = rows.coalesce(1).mapInArrow(_fit_in_task, "value binary, square binary, slope double, shift double").collect()
    drop(docs.sparkSession, path)
    model = Model(np.ones(1), np.zeros(1), found[0]["slope"], found[0]["shift"])
    model.value, model.square = (np.frombuffer(found[0][c], np.float64) for c in ("value", "square"))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (columns doc_id, text).

    The score reads nothing but the text; null text is empty and scores by the
    constant alone. Repeated rows and null ids (never held out) give rows of
    their own; an empty table gives none; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            scores = [model.score(text_features(t)) for t in utf8_list(batch.column("text"))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                                   "score": pa.array(scores, pa.float64())})
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns kept, scored in place without a shuffle."""
    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd
        return pd.Series([model.score(text_features((t or "").encode())) >= 0.5 for t in texts], dtype=bool)
    return docs.filter(good(F.col("text")))
