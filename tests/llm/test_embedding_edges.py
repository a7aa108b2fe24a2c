"""op5: repeated and null ids, short vectors, many labels; against brute force."""

import itertools

import numpy as np
import pytest

from tests.llm.test_operators import groups, vectors
from tideline.llm import embedding_dedup


def brute(rows, threshold=0.93):
    links = []
    for (a, (_, v, k)), (b, (_, w, m)) in itertools.combinations(enumerate(rows), 2):
        if k is not None and k == m and len(v) == len(w) and any(v) and any(w):
            v, w = np.array(v, float), np.array(w, float)
            if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links.append((a, b))
    g, n = groups(len(rows), links), np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[g[k]] = min(least.get(g[k], i), i)
    return sorted(((i, int(n[k]), least.get(g[k])) for k, (i, _, _) in enumerate(rows)), key=repr)


def found(spark, rows):
    return sorted(map(tuple, embedding_dedup.near_vectors(vectors(spark, rows)).select("vec_id", "n_links", "component_id").collect()), key=repr)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_repeated_and_null_ids(spark):
    """An id under another label or with another vector is a vector of its own."""
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 64))
    near = [f32(v + rng.normal(0, 0.05, 64)) for v in base for _ in range(3)]
    rows = [(1, near[0], 0), (2, near[1], 0), (1, near[3], 1), (3, near[4], 1), (1, near[6], 0), (4, near[7], 0)]
    rows += [(None, near[9], 0), (9, near[10], 0), (None, near[11], 0), (None, near[12], 0), (None, near[13], 0), (7, near[12], 1), (8, near[12], None), (1, near[0], 0)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert (1, 1, 1) in want and (None, 2, 9) in want and (None, 1, None) in want


@pytest.mark.parametrize("d", [1, 2, 3, 4, 7])
def test_short_vectors(spark, d, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)
    rng = np.random.default_rng(d)
    rows = [(k, f32(rng.standard_normal(d)), k % 2) for k in range(240)] + [(500 + k, [0.0] * d, 0) for k in range(2)]
    assert found(spark, rows) == brute(rows)
    x = rng.standard_normal((500, d))
    row, _ = embedding_dedup.decode(x / np.linalg.norm(x, axis=1, keepdims=True), 1024)
    assert len(row) / 500 <= 2 * 1.5**d


@pytest.mark.parametrize("d", [9, 12, 16, 20, 24, 33])
@pytest.mark.parametrize("words", [128, 1024, 4096])
def test_recall_in_few_dimensions(d, words):
    """Made pairs at the threshold share a filter."""
    rng = np.random.default_rng(d)
    x, n = rng.standard_normal((2, 800, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * n / np.linalg.norm(n, axis=1, keepdims=True)
    a, b = (set(zip(*(v.tolist() for v in embedding_dedup.decode(z, words)))) for z in (x, y))
    assert len({r for r, _ in a & b}) / 800 >= 0.97


def test_vectors_of_many_labels(spark):
    v = f32(np.random.default_rng(5).standard_normal(16))
    rows = [(k, v, k % 90) for k in range(270)]
    assert found(spark, rows) == brute(rows)
