"""Primitives against numpy on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.peaks import peaks


def frame(spark, values, distances=None):
    d = distances if distances is not None else range(len(values))
    return spark.createDataFrame([(1, float(x), float(v)) for x, v in zip(d, values)], "transect_id long, distance double, v double")


def column(df, c):
    return [r[0] for r in df.select(c.alias("o"), "distance").orderBy("distance").select("o").collect()]


@pytest.mark.parametrize("n", [2, 3, 6, 7, 40])
def test_gradient_is_numpys(spark, n):
    rng = np.random.default_rng(n)
    v, d = rng.integers(0, 255, n), np.cumsum(rng.uniform(0.1, 2, n))
    got = column(frame(spark, v, d), S.gradient("v", S.series()))
    assert np.allclose(got, np.gradient(v.astype(float), d))


def test_gradient_tiny_first_gap_and_single_point(spark):
    v, d = [10, 20, 30, 25], [0, 4e-5, 1.00004, 2.00004]
    assert np.allclose(column(frame(spark, v, d), S.gradient("v", S.series())), np.gradient(np.array(v, float), d))
    assert column(frame(spark, [5]), S.gradient("v", S.series())) == [None]


@pytest.mark.parametrize("n,size", [(1, 3), (3, 5), (6, 11), (30, 7)])
def test_uniform_pads_with_ends(spark, n, size):
    v = np.random.default_rng(n).integers(0, 200, n).astype(float)
    want = np.convolve(np.pad(v, size // 2, mode="edge"), np.ones(size) / size, "valid")
    df = S.indexed(frame(spark, v), S.series())
    assert np.allclose(column(df, S.uniform("v", size, S.series())), want)
    assert np.allclose(column(df, S.uniform("v", size, S.series(), truncate=True)), np.floor(want + 1e-9))


def test_local_minimum_and_median(spark):
    df = frame(spark, [3, 1, 1, 2, 0])
    assert column(df, S.local_minimum("v", S.series())) == [False, True, True, False, True]
    assert column(df, S.median3("v", S.series())) == [3, 1, 1, 1, 0]


def test_savitzky_golay_keeps_parabolas(spark):
    x = np.arange(9.0)
    df = S.indexed(frame(spark, 2 * x * x - 3 * x + 1), S.series())
    assert np.allclose(column(df, S.savitzky_golay("v", S.series())), 2 * x * x - 3 * x + 1)
    assert column(S.indexed(frame(spark, [1, 2, 3, 4]), S.series()), S.savitzky_golay("v", S.series())) == [None] * 4


def test_gradient_of_a_line_is_constant(spark):
    got = column(frame(spark, np.arange(20) * 3.0 + 1), S.gradient("v", S.series()))
    assert np.allclose(got, 3)


def brute_peaks(x, prominence, width=None):
    """Every run by scanning outwards from it."""
    out, s = [], 0
    while s < len(x):
        e = s
        while e + 1 < len(x) and x[e + 1] == x[s]:
            e += 1
        if 0 < s and e < len(x) - 1 and x[s - 1] < x[s] > x[e + 1]:
            sides = []
            for step, at in ((-1, s), (1, e)):
                low, k = x[s], at
                while 0 <= k < len(x) and x[k] <= x[s]:
                    low, k = min(low, x[k]), k + step
                sides.append(low)
            prom, p = x[s] - max(sides), (s + e) // 2
            if prom >= prominence:
                h, ends = x[s] - prom / 2, []
                for step in (-1, 1):
                    k = p
                    while x[k] > h:
                        k += step
                    ends.append(k - step * ((h - x[k]) / (x[k - step] - x[k]) if x[k] < h else 0.0))
                if width is None or ends[1] - ends[0] >= width:
                    out.append(p)
        s = e + 1
    return out


def found_peaks(spark, series, prominence, width=None):
    df = spark.createDataFrame([(k, [None if v is None else float(v) for v in x]) for k, x in enumerate(series)], "k long, x array<double>")
    got = dict(tuple(r) for r in df.select("k", peaks(F.col("x"), prominence, width)).collect())
    return [got[k] for k in range(len(series))]


def test_peaks(spark):
    assert found_peaks(spark, [[0, 5, 5, 5, 0], [5, 4, 3, 4, 5], [1, 2], [], [3], [2, 2, 2]], 1) == [[2], [], [], [], [], []]
    assert found_peaks(spark, [[0, 9, 7, 8, 0]], 2) == [[1]]
    assert found_peaks(spark, [[0, 9, 0, 0, 4, 4, 4, 4, 0]], 3, 3.0) == [[5]]
    # a null is no peak and its neighbours border on nothing; beyond it the series goes on
    assert found_peaks(spark, [[0, 5, None, 5, 0], [0, None, 1, 9, 1], [None, None]], 1) == [[], [3], []]


@pytest.mark.parametrize("prominence,width", [(0.5, None), (3, None), (2, 2.5), (1, 3.0), (0, 1.0)])
def test_peaks_brute_force(spark, prominence, width):
    rng = np.random.default_rng(17)
    series = [rng.integers(0, top, n).tolist() for n in (2, 5, 9, 40, 160) for top in (2, 4, 12, 250)]
    series += [np.cumsum(rng.normal(0, 1, 150)).tolist() for _ in range(6)] + [list(range(60, 0, -1)), list(range(60))]
    want = [brute_peaks([float(v) for v in x], prominence, width) for x in series]
    assert found_peaks(spark, series, prominence, width) == want
    assert any(want)


def test_runs(spark):
    df = frame(spark, [1, 1, 2, 2, 1])
    w = S.series()
    df = df.withColumn("c", S.changed("v", w)).withColumn("run", S.run_number("c", w))
    assert column(df, F.col("run")) == [0, 0, 1, 1, 2]
