"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

A document's features are the distinct n-grams (``SIZES``) of its lower-cased
characters, hashed to ``BUCKETS``.  On a bounded labelled sample (``SAMPLE`` documents a
class) each bucket gets its log-count ratio between the classes; a logistic regression
by stochastic gradient descent is trained on features scaled by these ratios and by the
root of how many the document has.  Both classes weigh the same however rare one is, and
passes go on until the mean loss is under ``ENOUGH`` (or ``STEPS`` documents were seen), so
a sample of a few hundred gets more of them.  Scores use whole texts of any length.

Null and empty texts have no features and get the bias alone.  Without labels of both
classes the score is the share of ones among the labels (0 without any).  Repeated rows
get equal scores; labels that are null or neither 0 nor 1 are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import labelled

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 19
SAMPLE = 2500
ENOUGH, STEPS, PASSES, RATE, SLOWING, DECAY, SMOOTH = 0.02, 120_000, 200, 0.5, 0.1, 1e-6, 1.0
STEEPEST = 4.0  # of a document's gradient, in units of an even one
FOLDS, OUT = 5, 0


def features(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a text, repeats included."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    c = np.where((c >= 9) & (c <= 13), np.uint64(32), c) + np.uint64(1)
    out, h = [], c
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(C.BASES[0]) + c[n - 1 :]
        if n in SIZES:
            out.append(((h * np.uint64(C.BASES[1])) >> np.uint64(45)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def log_count_ratio(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per bucket: the log of how often it is in documents of class 1 against class 0, each
    count raised by ``SMOOTH`` and divided by its class's number of documents."""
    count = np.full((2, BUCKETS), SMOOTH)
    for d, k in zip(docs, y):
        count[k, d] += 1
    ones = int(y.sum())
    size = np.array([len(y) - ones, ones]) + 2 * SMOOTH
    return (np.log(count[1] / size[1]) - np.log(count[0] / size[0])).astype(np.float32)


def train(texts: list[str], y: np.ndarray) -> bytes:
    """float32: bias, then a weight for each bucket."""
    model = np.zeros(BUCKETS + 1, np.float32)
    ones = int(y.sum())
    if not 0 < ones < len(y):
        share = ones / len(y) if len(y) else 0.0
        model[0] = 30.0 if share == 1 else -30.0
        return model.tobytes()
    docs = [np.unique(features(t)) for t in texts]
    ratio = log_count_ratio(docs, y)
    weight = (len(y) / 2 / (len(y) - ones), len(y) / 2 / ones)
    w, bias, rng = np.zeros(BUCKETS, np.float32), 0.0, np.random.default_rng(7)
    for epoch in range(min(PASSES, -(-STEPS // len(docs)))):
        rate, loss = RATE / (1 + SLOWING * epoch), 0.0
        for i in rng.permutation(len(docs)):
            d, c = docs[i], weight[y[i]]
            x = ratio[d] / np.float32(max(1, len(d)) ** 0.5)
            p = 1 / (1 + np.exp(-np.clip(bias + float(w[d] @ x), -30, 30)))
            loss -= c * np.log(max(1e-12, p if y[i] else 1 - p))
            g = np.clip(c * (p - y[i]), -STEEPEST, STEEPEST)
            w[d] -= rate * (g * x + DECAY * w[d])
            bias -= 0.1 * rate * g
        if loss < ENOUGH * len(docs):
            break
    model[0], model[1:] = bias, w * ratio
    return model.tobytes()


def _text(value) -> str | None:
    """One text at a time, so that a batch is never held twice."""
    return value.as_py()


def score(model: bytes, texts) -> np.ndarray:
    m = np.frombuffer(model, np.float32)
    bias, w = float(m[0]), m[1:]
    seen = np.zeros(len(w), np.int32)
    out = np.full(len(texts), bias)
    for k, t in enumerate(map(_text, texts)):
        if t:
            f = features(t)
            seen[f] = np.arange(len(f), dtype=np.int32)  # the last of each repeated bucket counts
            f = f[seen[f] == np.arange(len(f), dtype=np.int32)]
            out[k] += float(w[f].sum(dtype=np.float64)) / max(1, len(f)) ** 0.5
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, or the columns ``carry``, and _score."""
    rows = labelled.training_rows(docs, labels, label, id_col, text_col, FOLDS, OUT, sample)
    return labelled.score_all(docs, labelled.fit(rows, train), score, text_col, carry or [id_col])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        labelled.held_out("doc_id", FOLDS, OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
