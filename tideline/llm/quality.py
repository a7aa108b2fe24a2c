"""Quality: supervised subword embeddings with a softmax output.

Every word and every 3- to 5-byte n-gram of a word with its boundaries is hashed to a
learned vector; word trigrams that came before in the document share one.  A document is the average of the vectors of all its features; a softmax
over two classes follows.  Vectors and output are trained by numpy stochastic gradient
descent on a bounded labelled sample (``SAMPLE`` documents a class), with gradients
weighted so that both classes count the same.  For scoring, the two linear layers are multiplied
out, so a feature is one number; whole texts of any length are read.

Null and empty texts have no features and get the bias alone.  Without labels of both
classes the score is 1 if only good ones are known and else 0.  Repeated rows get equal
scores; labels that are null or neither 0 nor 1 are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import labelled

SIZES = (3, 4, 5)
BUCKETS, DIM = 1 << 17, 8
REPEAT = 0  # the bucket of repeated word trigrams
SAMPLE = 2500
EPOCHS, RATE = 12, 2.0
FOLDS, OUT = 4, 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some rows, and the row of each."""
    n = len(offsets) - 1
    # a separator before each row keeps n-grams inside their row
    at = offsets[:-1] + np.arange(n)
    own = np.full(len(data) + n + 1, 0x20, np.uint8)
    inside = np.ones(len(own), bool)
    inside[at] = False
    inside[-1] = False
    own[inside] = np.where(C.IS_SEP[data], 0x20, data)
    row = np.append(np.repeat(np.arange(n), np.diff(offsets) + 1), n - 1)
    sep = np.cumsum(own == 0x20)
    shift, base = np.uint64(64 - 17), np.uint64(C.BASES[0])
    starts, ends, _ = C.find_words(own, np.array([0, len(own)]))
    word = C.hash_words(own, starts, ends, C.BASES[1])
    buckets, rows = [(word >> shift).astype(np.int32)], [row[starts]]
    # three words that came before in the row, in this order, are one token whatever they are
    begin = np.arange(max(0, len(word) - 2))
    begin = begin[rows[0][begin] == rows[0][begin + 2]]
    three = C.mix(C.hash_ranges(word, begin, begin + 3, C.BASES[2]) + rows[0][begin].astype(np.uint64))
    _, first = np.unique(three, return_index=True)
    again = np.ones(len(three), bool)
    again[first] = False
    rows.append(rows[0][begin[again]])
    buckets.append(np.full(len(rows[1]), REPEAT, np.int32))
    c = own.astype(np.uint64) + np.uint64(1)
    h = c
    for k in range(2, max(SIZES) + 1):
        if len(c) < k:
            break
        h = h[:-1] * base + c[k - 1 :]
        if k in SIZES:
            # no separator strictly inside
            ok = sep[k - 2 : len(sep) - 1] - sep[: len(sep) - k + 1] == 0
            buckets.append(((C.mix(h[ok])) >> shift).astype(np.int32))
            rows.append(row[: len(h)][ok])
    return np.concatenate(buckets), np.concatenate(rows)


def train(texts: list[str], y: np.ndarray) -> bytes:
    """float32: bias, then a logit for each bucket."""
    model = np.zeros(BUCKETS + 1, np.float32)
    ones = int(y.sum())
    if not 0 < ones < len(y):
        model[0] = 30.0 if ones else -30.0
        return model.tobytes()
    docs = []
    for t in texts:
        b, _ = features(*C.utf8(pa.array([t])))
        u, n = np.unique(b, return_counts=True)
        docs.append((u, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(11)
    v = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = np.array([len(y) / 2 / (len(y) - ones), len(y) / 2 / ones])
    steps, total = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            u, share = docs[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            hidden = share @ v[u]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            g = (p / p.sum()).astype(np.float32)
            g[y[i]] -= 1
            g *= np.float32(min(4.0, weight[y[i]]))
            back = g @ out
            out -= 0.1 * rate * np.outer(g, hidden)
            bias -= 0.02 * rate * g
            # a document's step is shared by its features, so it is scaled to their spread
            v[u] -= (rate / np.float32(max(1e-6, float((share * share).sum())) ** 0.5)) * share[:, None] * back
    model[0], model[1:] = bias[1] - bias[0], v @ (out[1] - out[0])
    return model.tobytes()


def score(model: bytes, texts) -> np.ndarray:
    m = np.frombuffer(model, np.float32)
    w = m[1:].astype(np.float64)
    data, offsets = C.utf8(texts)
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for a, b in C.row_chunks(offsets):
        f, row = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        total[a:b] = np.bincount(row, w[f], b - a)
        n[a:b] = np.bincount(row, minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(float(m[0]) + total / np.maximum(n, 1), -30, 30)))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE, carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, or the columns ``carry``, and _score."""
    rows = labelled.training_rows(docs, labels, label, id_col, text_col, FOLDS, OUT, sample)
    return labelled.score_all(docs, labelled.fit(rows, train), score, text_col, carry or [id_col])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        labelled.held_out("doc_id", FOLDS, OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.7).cast("int").alias("predicted"),
    )
