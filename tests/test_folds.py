"""Folds, ranks and kernels in the JVM against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import series as S
from tideline.functions.quantiles import exact_quantiles
from tideline.operators import boundaries as B
from tideline.operators import classify as K
from tideline.operators import matching as M
from tideline.operators import statistics as T


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), (None, 57), ("hot", 4000)) for v in rng.integers(0, 60, n) / 4 - 5]
    rows += [("hot", 1.25)] * 3000 + [("nulls", None)] * 3 + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 77, 99, 100)}
    got = {r["g"]: [r[c] for c in wanted] for r in exact_quantiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for g, values in got.items():
        assert values == pytest.approx([np.quantile([v for k, v in rows if k == g and v is not None], p) for p in wanted.values()], abs=1e-12)
    assert exact_quantiles(df.limit(0), ["g"], "v", wanted).count() == 0
    every = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert every == np.median([v for _, v in rows if v is not None])
    assert "percentile" not in exact_quantiles(df, ["g"], "v", wanted)._jdf.queryExecution().toString()


def padded(x, k):
    return np.pad(np.asarray(x, float), k, mode="edge")


@pytest.mark.parametrize("size", [1, 3, 5, 11])
def test_smoothing_by_name_and_width(spark, size):
    rng = np.random.default_rng(size)
    series = {k: rng.integers(0, 250, n).tolist() for k, n in enumerate((1, 2, 4, 30))}
    df = spark.createDataFrame([(k, float(d), int(v)) for k, x in series.items() for d, v in enumerate(x)], "transect_id long, distance double, v int")
    w, half = S.series(), size // 2
    at = S.indexed(df, w)
    order = min(2, size - 1)
    out = at.select(
        "transect_id", "distance", S.smoothed(F.col("v").cast("double"), w, "uniform", size).alias("uniform"), S.smoothed(F.col("v").cast("double"), w, "median", size).alias("median"),
        S.smoothed(F.col("v").cast("double"), w, "savgol", size, order=order).alias("savgol"), S.smoothed(F.col("v").cast("double"), w, "gaussian", sigma=size / 3).alias("gaussian"),
    )
    got = {}
    for r in out.orderBy("transect_id", "distance").collect():
        for m in ("uniform", "median", "savgol", "gaussian"):
            got.setdefault((r["transect_id"], m), []).append(r[m])
    g = np.exp(-0.5 * (np.arange(-int(4 * size / 3 + 0.5), int(4 * size / 3 + 0.5) + 1) / (size / 3)) ** 2)
    fit = [np.polyval(np.polyfit(np.arange(size) - half, e, order), 0) for e in np.eye(size)]
    for k, x in series.items():
        windows = np.lib.stride_tricks.sliding_window_view(padded(x, half), size)
        want = {"uniform": windows.mean(axis=1), "median": np.median(windows, axis=1), "savgol": windows @ fit, "gaussian": np.convolve(padded(x, len(g) // 2), g / g.sum(), "valid")}
        for m, v in want.items():
            assert got[k, m] == pytest.approx(v.tolist(), abs=1e-8)


def test_smoothing_refuses_what_it_does_not_know(spark):
    for m in ({"method": "uniform", "size": 4}, {"method": "savgol", "size": 3, "order": 3}, {"method": "loess"}):
        with pytest.raises(ValueError):
            S.smoothed("v", S.series(), **m)


def test_dominant_frequency_is_that_of_the_fast_transform(spark):
    rng = np.random.default_rng(1)
    points, zones, want = [], [], {}
    for t, n in enumerate((5, 11, 12, 40, 73)):
        x = np.round(100 + 3 * np.arange(n) + 30 * np.sin(2 * np.pi * rng.uniform(0.1, 0.4) * np.arange(n) + t) + rng.normal(0, 5, n)).astype(int)
        points += [(t, k * 1.5, int(v)) for k, v in enumerate(x)]
        zones.append((t, 0, 0.0, n * 1.5, "WATER"))
        if n > 10:
            rest = x - np.polyval(np.polyfit(np.arange(n), x, 1), np.arange(n))
            want[t] = (np.argmax(np.abs(np.fft.fft(rest))[1 : n // 2]) + 1) / (n * 1.5)
    p = spark.createDataFrame(points, "transect_id long, distance double, nir int")
    z = spark.createDataFrame(zones, "transect_id long, zone_order int, start double, end double, zone_class string")
    assert {r["transect_id"]: r["dominant_frequency"] for r in T.dominant_frequency(p, z).collect()} == pytest.approx(want)


def test_thinning_is_the_greedy_scan(spark):
    rng = random.Random(2)
    series = {t: [(float(d), -rng.randrange(0, 40) / 2) for d in sorted(rng.sample(range(200), n))] for t, n in ((1, 1), (2, 40), (3, 90))}
    rows = spark.createDataFrame([(t, d, g) for t, x in series.items() for d, g in x], "transect_id long, distance double, g double").repartition(5)
    levels = [-2.0, -8.5, -30.0]
    want = set()
    for t, x in series.items():
        for level in levels:
            kept = []
            for d, g in x:
                if g < level and kept and d - kept[-1][0] < 15:
                    kept[-1] = (d, g) if abs(g) > abs(kept[-1][1]) else kept[-1]
                elif g < level:
                    kept.append((d, g))
            want |= {(t, level, d) for d, _ in kept}
    assert {tuple(r) for r in M.thinned(rows, levels, 15.0).collect()} == want


def test_merging_moves_the_anchor_on_by_what_was_merged(spark):
    rng = random.Random(3)
    methods = ["inflection_point", "rgb_foam_peak", "derivative_magnitude"]
    rows = [(t, k, rng.randrange(60) / 2, rng.choice(methods), rng.randrange(50, 95) / 100, {"nir": 1.0}) for t in range(6) for k in range(5 * t + 1)]
    df = spark.createDataFrame(rows, "transect_id long, index int, distance double, detection_method string, confidence double, band_magnitudes map<string,double>").repartition(3)
    want, clean = set(), set()
    for t in range(6):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], methods.index(r[3]), r[1]))
        k = 0
        while k < len(own):
            group = [j for j in range(k, len(own)) if own[j][2] - own[k][2] < 5 and own[j][3] == own[k][3]]
            want.add(own[max(group, key=lambda j: (own[j][4], -j))][:2])
            k += len(group)
        for m in methods:
            one = [r for r in own if r[3] == m]
            while one:
                near = [r for r in one if r[2] - one[0][2] < 5]
                clean.add(max(near, key=lambda r: (r[4], -near.index(r)))[:2])
                one = one[len(near) :]
    got = B.merge_nearby(df)
    assert got.columns == df.columns
    assert {(r["transect_id"], r["index"]) for r in got.collect()} == want
    assert {(r["transect_id"], r["index"]) for r in B.merge_by_method(df).collect()} == clean
    assert got.first()["band_magnitudes"] == {"nir": 1.0}


@pytest.mark.parametrize("rounds", [1, 3, 10])
def test_short_segments_are_merged_in_turn(spark, rounds):
    rng = random.Random(rounds)
    names = ["UNKNOWN", "VEG_DUNES", "DRY_BEACH", "WATER"]
    lines = {t: [rng.choice(names) if rng.random() < 0.5 else "DRY_BEACH" for _ in range(n)] for t, n in ((1, 1), (2, 12), (3, 45), (4, 60))}
    df = spark.createDataFrame([(t, float(k), c) for t, x in lines.items() for k, c in enumerate(x)], "transect_id long, distance double, predicted_class string")
    want = {}
    for t, x in lines.items():
        c = list(x)
        for _ in range(rounds):
            edge = [k for k in range(len(c)) if k == 0 or c[k] != c[k - 1]] + [len(c)]
            for z, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                if c[a] != "UNKNOWN" and b - 1 - a < 2.5:
                    after, before = c[b] if b < len(c) else "UNKNOWN", c[a - 1] if a else "UNKNOWN"
                    c[a:b] = [after if after != "UNKNOWN" else before] * (b - a)
                    break
            else:
                break
        want |= {(t, float(k)): v for k, v in enumerate(c)}
    got = {(r["transect_id"], r["distance"]): r["predicted_class"] for r in K.merge_short_segments(df, rounds=rounds).collect()}
    assert got == want
