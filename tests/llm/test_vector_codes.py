"""Heap Lloyd against plain Lloyd in whole numbers, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest

from tideline.llm import vector_codes as V


def table(spark, rows, more=""):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, name int")


def lloyd(rows, parts, entries, rounds, scale=256):
    """Codes and errors by id, and the entries, by comparing everything in every round."""
    ok = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    w = -(-len(ok[0][1]) // parts)
    x = [[max(-V.MOST, min(V.MOST, math.floor(scale * float(np.float32(c))))) for c in v] + [0] * (w * parts - len(v)) for _, v in ok]
    books = [[r[p * w : p * w + w] for r in x[:entries]] for p in range(parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return far.index(min(far)), min(far)

    for k in range(rounds + 1):
        near = [[nearest(r[p * w : p * w + w], books[p]) for p in range(parts)] for r in x]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [r[p * w : p * w + w] for r, c in zip(x, near) if c[p][0] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    rows = sorted(((i, "".join(f"{c:02x}" for c, _ in n), sum(d for _, d in n)) for (i, _), n in zip(ok, near)), key=repr)
    return rows, ",".join(str(c) for b in books for e in b for c in e)


def check(spark, rows, parts, entries, rounds, scale=256):
    got, books = V.quantize(table(spark, rows), parts, entries, rounds, scale)
    want, text = lloyd(rows, parts, entries, rounds, scale)
    assert sorted((tuple(r) for r in got.select("id", "code", "error").collect()), key=repr) == want
    assert books.text() == text


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 6), (2, 5, 0), (3, 16, 2), (1, 1, 2), (16, 64, 2)])
def test_codes_are_those_of_plain_lloyd(spark, parts, entries, rounds, monkeypatch):
    rng = np.random.default_rng(parts)
    middles = rng.standard_normal((9, 16))
    rows = [(k, [float(np.float32(c)) for c in middles[k % 9] + rng.standard_normal(16) * 0.3], k % 3) for k in range(150)]
    rows += [(k, rows[4][1], None) for k in range(300, 360)]  # copies
    rows += [(k, [1.0] * 16, 1) for k in range(-3, 0)]  # equal first entries: ties
    check(spark, rows, parts, entries, rounds)


def test_far_apart_and_large_numbers(spark):
    rows = [(k, [float(10.0 ** (k % 12)) * (-1) ** k, float(k), 0.5, -0.001], 1) for k in range(60)]
    check(spark, rows, 2, 7, 4)


def test_codes_edges(spark):
    rows = [
        (1, [0.5, 0.25, 1.0], 1), (2, None, 1), (3, [0.1, None, 0.2], 1), (4, [float("nan"), 0.0, 1.0], 2), (5, [float("inf"), 0.0, 1.0], 2), (6, [], 2),
        (7, [0.5, 0.5], 1), (1, [0.25, 0.25, 1.0], None), (None, [0.0, 0.0, 0.0], None),
    ]
    check(spark, rows, 2, 64, 2)
    got, books = V.quantize(table(spark, []))
    assert got.columns == ["id", "label", "code", "error"] and got.count() == 0 and books is None


def test_only_what_drift_caught_up_with_is_compared_again(monkeypatch):
    """Of well separated clusters nothing is popped; of ties everything."""
    book = np.array([[[0], [1000]]])
    x = np.concatenate([np.arange(40), 1000 + np.arange(40)]).reshape(-1, 1)
    heaps = [V.Heaps(np.full(80, -1), np.zeros(0, np.int64), np.zeros(0))]
    books = V.Codebooks(book, np.zeros((1, 2)))
    moves = V._advance(x, heaps, books)[3]
    assert [m["sums"] for m in moves] == [[40, 780], [40, 40780]]
    books = books.moved({(0, m["entry"]): m["sums"] for m in moves})
    assert books.entries.tolist() == [[[19], [1019]]]
    assert len(heaps[0].pop(books.drift[0])) == 0
    tie = [V.Heaps(np.full(1, -1), np.zeros(0, np.int64), np.zeros(0))]
    V._advance(np.array([[500]]), tie, V.Codebooks(book, np.zeros((1, 2))))
    assert tie[0].code.tolist() == [0] and tie[0].pop(np.zeros(2)).tolist() == [0]


def test_label_errors_and_digest(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(32)], None if k % 4 == 0 else k % 3) for k in range(90)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = V.op13_vector_codes(spark, str(tmp_path)).collect()
    want, text = lloyd(rows, 16, 64, 2)
    error, label = {i: e for i, _, e in want}, {i: g for i, _, g in rows}
    for r in got:
        assert r["label_error"] == sum(e for i, e in error.items() if label[i] == label[r["vec_id"]])
        assert r["codebooks_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 90
