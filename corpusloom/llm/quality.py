"""A quality classifier: naive-Bayes support vectors.

Features are indicators of word and word-pair hashes (``BUCKETS`` of them);
runs of other visible characters count as words. Each indicator is scaled by
the log-ratio of its smoothed counts in the two classes, a linear hinge-loss
model is fitted to them by dual coordinate descent, and a logistic curve over
its margins gives the score.

Labels are learnt from rows whose crc32(doc_id) mod 3 is not 1. Of those at
most about ``MOST_ROWS`` are taken, by a hash of the doc_id; where one doc_id is
on many rows, by a hash of doc_id and text as well, like rows once. Their
features are stored, and go to the driver for the fit; if they exceed
``MOST_BYTES``, fewer rows do, by the same hash, long texts like short ones.
All documents are scored, where they lie, with a model of a fixed size.
doc_id decides which rows are learnt from; it, source, lang and labels are
never inputs of a score.

Defined results: a null or empty text has no features and scores as the
model's bias does. Without rows of both classes to learn from, all scores are
the share of label 1, or 0.5. Of several labels of a doc_id the largest counts.
A null doc_id is not held out. Each input row
gives one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import documents, in_tasks, stored

BUCKETS = 1 << 18
MOST_ROWS = 6000
MOST_BYTES = 64 << 20
EPOCHS = 15
C = 1.0
FOLDS, HELD_OUT = 3, 1


def features(column: pa.Array):
    """(lo, hi, doc, feature): the distinct features of documents lo:hi, in order; a long document's pieces are gathered."""
    held = np.zeros(0, np.int64)
    for c in W.chunks(column, W.MIXED, W.LOWER, 1):
        h, two = c.hashes(), c.begins(2)
        doc = np.concatenate([c.doc[: c.mine], c.doc[two]])
        key = np.unique(doc * BUCKETS + (np.concatenate([h[: c.mine], W.grams(h, 2)[two]]) >> W.U(46)).astype(np.int64))
        if not c.whole:
            held = np.union1d(held, key)
            if not c.final:
                continue
            key, held = held, held[:0]
        yield c.lo, c.hi, key // BUCKETS, key % BUCKETS


def fold(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0))


def _example_rows(batches):
    for batch in batches:
        rows = [b""] * batch.num_rows
        for lo, hi, doc, feature in features(W.text_column(batch)):
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            for d in range(hi - lo):
                rows[lo + d] = feature[cuts[d] : cuts[d + 1]].astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("k"), pa.array(rows, pa.binary())], ["label", "k", "features"])


def fit(x: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, c: float = C, seed: int = 0) -> tuple[np.ndarray, float, float, float]:
    """Weight of each feature, bias, and the slope and offset of the logistic curve. y: -1 or 1."""
    count = {s: np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, l in zip(x, y) if l == s)]).astype(np.int64), minlength=BUCKETS) + 1.0 for s in (-1, 1)}
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    unseen = count[1] + count[-1] == 2
    ratio[unseen] = 0
    rare = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    scale = [1 / max(1e-9, math.sqrt(float((ratio[f] ** 2).sum()))) for f in x]  # rows of length 1, so long texts weigh no more
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)).tolist():
            f = x[i]
            r = ratio[f] * scale[i]
            g = y[i] * (float(w[f] @ r) + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), c * rare[int(y[i])])  # length 1, and 1 for the bias
            if step := new - alpha[i]:
                alpha[i] = new
                w[f] += step * y[i] * r
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    margin = np.array([float(w[f] @ ratio[f]) * s for f, s in zip(x, scale)]) + bias
    a, b = _logistic(margin, (y > 0).astype(float))
    return np.stack([w * ratio, ratio**2]), bias, a, b


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of label 1 over the margin, 0 at margin 0 (both classes weigh the same)."""
    n = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-a * margin))
        g, h = float((n * (p - y) * margin).sum()) + 1e-4 * a, float((n * p * (1 - p) * margin**2).sum()) + 1e-4
        a -= max(-1.0, min(1.0, g / h))
    return max(a, 0.1), 0.0


def _sampled(key, most: int, n: int):
    """All of n, or about most of them, by a hash that does not depend on what else there is."""
    return F.pmod(key, F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS):
    """The fitted model, or the share of label 1 if there is only one class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if not n:
        return 0.5
    some = known.where(_sampled(F.xxhash64("doc_id"), most_rows, n))
    texts = documents(docs)
    found = texts.select("doc_id").join(F.broadcast(some), "doc_id").count()  # some: about most_rows rows
    rows = texts.join(F.broadcast(some), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("k"))
    if found > 2 * most_rows:  # one doc_id may be on any number of rows
        rows = rows.dropDuplicates(["k"]).where(_sampled(F.col("k"), most_rows, found))
    rows = stored(in_tasks(rows, _example_rows, "label int, k long, features binary"), "examples")
    total = rows.agg(F.sum(F.length("features"))).first()[0] or 0
    rows = rows.where(_sampled(F.xxhash64("k"), MOST_BYTES, total)).select("label", "features").collect()
    rows = sorted((int(r["label"]), bytes(r["features"])) for r in rows)
    y = np.array([1 if label else -1 for label, _ in rows])
    if len(set(y.tolist())) < 2:
        return float((y > 0).mean()) if len(y) else 0.5
    return fit([np.frombuffer(f, np.uint32).astype(np.int64) for _, f in rows], y)


def score_batches(sent):
    """batches of text -> scores."""

    def score(column: pa.Array) -> np.ndarray:
        model = sent.value
        if isinstance(model, float):
            return np.full(len(column), model)
        (weight, square), bias, a, b = model
        out = np.zeros(len(column))
        for lo, hi, doc, feature in features(column):
            dot = np.bincount(doc, weight[feature], minlength=hi - lo)
            length = np.sqrt(np.bincount(doc, square[feature], minlength=hi - lo))
            out[lo:hi] = dot / np.maximum(length, 1e-9)
        return 1 / (1 + np.exp(-(a * (out + bias) + b)))

    return score


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    score = score_batches(docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most_rows)))

    def run(batches):
        for batch in batches:
            s = score(W.text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = in_tasks(documents(docs), run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns."""
    score = score_batches(docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most_rows)))

    def run(batches):
        for batch in batches:
            text = batch.column("row").field("text").cast(pa.string()).fill_null("")
            yield batch.filter(pa.array(score(text) >= 0.5, pa.bool_()))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # in one struct no name clashes
    return in_tasks(rows, run, rows.schema).select("row.*")
