"""Classes, boundaries, matching, statistics and geometry on hand-sized cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import boundaries as B
from tideline.operators import classify as K
from tideline.operators import features as X
from tideline.operators import geometry as G
from tideline.operators import matching as M
from tideline.operators import statistics as T


def labelled(spark, names, t=1):
    return spark.createDataFrame([(t, float(k), c) for k, c in enumerate(names)], "transect_id long, distance double, predicted_class string")


def classes(df):
    return [r[0] for r in df.orderBy("distance").select("predicted_class").collect()]


V, D, W, S_, U = "VEG_DUNES", "DRY_BEACH", "BEACH_WET", "WATER", "UNKNOWN"


def test_median_smoothing_drops_single_points(spark):
    assert classes(K.smooth_classes(labelled(spark, [V, V, D, V, D, D]))) == [V, V, V, D, D, D]
    assert classes(K.smooth_classes(labelled(spark, [V]))) == [V]


def test_monotonic_relaxed_keeps_each_class_once(spark):
    got = classes(K.monotonic_relaxed(labelled(spark, [V, V, D, U, S_, W, D])))
    assert got == [V, U, D, U, S_, S_, U]


def test_monotonic_strict_needs_span(spark):
    got = classes(K.monotonic_strict(labelled(spark, [V, V, V, V, D, S_, S_, S_, S_, W, W, W, W])))
    assert got == [V] * 4 + [U] + [S_] * 4 + [U] * 4


def test_short_segments_go_to_the_next(spark):
    assert classes(K.merge_short_segments(labelled(spark, [V] * 5 + [D] + [W] * 5))) == [V] * 5 + [W] * 6


def test_segments(spark):
    got = K.segments(labelled(spark, [V, V, D, U])).orderBy("run").select("predicted_class", "span", "points").collect()
    assert [tuple(r) for r in got] == [(V, 1.0, 2), (D, 0.0, 1), (U, 0.0, 1)]


def test_vote_ties_go_to_the_first_met(spark):
    df = labelled(spark, [D, V, V, D, U]).withColumn("flag", F.lit(False))
    assert classes(K.vote_by_zone(df, "flag")) == [D] * 5


def detections(spark, rows):
    return spark.createDataFrame([(1, i, float(d), m, c) for i, d, m, c in rows], "transect_id long, index int, distance double, detection_method string, confidence double")


def test_merge_follows_the_anchor(spark):
    # interleaved methods: the middle one is skipped and the last met twice
    rows = [(10, 10, "derivative_magnitude", 0.7), (11, 11, "inflection_point", 0.8), (12, 12, "derivative_magnitude", 0.9)]
    got = B.merge_nearby(detections(spark, rows)).select("distance").collect()
    assert sorted(r[0] for r in got) == [12.0, 12.0]
    clean = B.merge_by_method(detections(spark, rows)).select("distance").collect()
    assert sorted(r[0] for r in clean) == [11.0, 12.0]


def scored(spark, rows, method):
    return detections(spark, [(int(d), d, method, c) for d, c in rows]).select("*", *[F.lit(None).cast("double").alias(c) for c in ("magnitude", "nir_value", "nir_drop", "brightness_before", "nir_before", "variance_ratio")], F.lit(0).alias("bands_agreeing"), F.lit(None).cast("map<string,double>").alias("band_magnitudes"), F.lit(False).alias("sustained")).select(*B.FIELDS)


@pytest.mark.parametrize(
    "strict,relaxed,want",
    [
        ([(60, 0.8), (90, 0.8)], [], [(60.0, "strict")]),
        ([(20, 0.9)], [(60, 0.6)], []),  # strict rows, all out of bounds
        ([], [(60, 0.6)], [(60.0, "fallback")]),
        ([(200, 0.9)], [(60, 0.6), (220, 0.8)], [(60.0, "fallback")]),
        ([], [(220, 0.8)], [(220.0, "fallback")]),
        ([], [(60, 0.45)], []),
    ],
)
def test_best_dry_wet(spark, strict, relaxed, want):
    got = B.best_dry_wet(scored(spark, strict, "derivative_magnitude"), scored(spark, relaxed, "derivative_magnitude_relaxed"))
    assert [tuple(r) for r in got.select("distance", "detection_mode").collect()] == want


def test_unknown_filter_keeps_nothing(spark):
    d = detections(spark, [(1, 1, "inflection_point", 0.9)]).withColumns({"from_class": F.lit(D), "to_class": F.lit(W)})
    assert B.filter_by_type(d, "shore_only").count() == 1
    assert B.filter_by_type(d, "nonsense").count() == 0


def test_matching_counts(spark):
    det = detections(spark, [(10, 10, "inflection_point", 0.8), (14, 14, "inflection_point", 0.9), (50, 50, "inflection_point", 0.9)]).withColumn("boundary_type", F.lit("A->B"))
    man = spark.createDataFrame([(1, 12.0, "A_to_B", 1), (1, 90.0, "B_to_C", 2), (2, 5.0, "A_to_B", 1)], "transect_id long, position double, manual_type string, seq int")
    m = M.match_transitions(det, man, 5.0)
    assert {r["label"]: r["count"] for r in m.groupBy("label").count().collect()} == {"TP": 2, "FP": 1, "FN": 2}
    s = M.metrics(m).first()
    assert (s["precision"], s["recall"]) == (pytest.approx(2 / 3), 0.5)
    assert s["mae"] == 2.0


def test_shared_zone_edge_belongs_to_the_first(spark):
    z = spark.createDataFrame([(1, 0, 0.0, 5.0, "A"), (1, 1, 5.0, 9.0, "B")], "transect_id long, zone_order int, start double, end double, zone_class string")
    p = spark.createDataFrame([(1, 5.0), (1, 6.0), (1, 20.0)], "transect_id long, distance double")
    assert [tuple(r) for r in M.points_in_zones(p, z).orderBy("distance").select("distance", "zone_class").collect()] == [(5.0, "A"), (6.0, "B")]


def test_f_tail_known_values():
    assert T._beta_tail(4.0, 3, 20) == pytest.approx(0.0221, abs=2e-4)
    assert T._beta_tail(1.0, 1, 1) == pytest.approx(0.5, abs=1e-9)
    assert T._beta_tail(0.0, 2, 9) == 1.0


def test_bad_transects_are_set_aside(spark):
    s = spark.createDataFrame([(1, 0.0, 1, 1, 1, 1), (2, 0.0, 1, None, 1, 1), (3, 0.0, -1, 1, 1, 1)], "transect_id long, distance double, red int, green int, blue int, nir int")
    good, bad = X.valid_samples(s)
    assert [r[0] for r in good.select("transect_id").collect()] == [1]
    assert sorted(r[0] for r in bad.select("transect_id").collect()) == [2, 3]


def test_short_and_constant_transects(spark):
    s = spark.createDataFrame([(1, 0.0, 9, 9, 9, 9)] + [(2, float(k), 50, 50, 50, 50) for k in range(7)], "transect_id long, distance double, red int, green int, blue int, nir int")
    got = {r["transect_id"]: r for r in X.compute_features(s).collect()}
    assert got[1]["nir_d1"] is None and got[1]["variability"] is None and got[1]["slope"] == 0
    assert got[2]["nir_d1"] == 0 and not got[2]["has_oscillations"]


def test_utm_reference_point(spark):
    x, y = G.to_utm(F.lit(9.0), F.lit(48.0), 32)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(500000.0, abs=1e-6)
    assert r["y"] == pytest.approx(5316300.0, abs=500)
    with pytest.raises(ValueError):
        G.reproject(spark.createDataFrame([], "transect_id long, points array<struct<x:double,y:double>>"), "EPSG:31370", "EPSG:4326")


def test_line_ends_and_directions(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (2.5, 0.0)]), (2, [(1.0, 0.0), (0.0, 0.0)])], "transect_id long, points array<struct<x:double,y:double>>")
    got = G.densify(line).where("transect_id = 1").orderBy("distance").collect()
    assert [r["distance"] for r in got] == [0, 1, 2, 2.5]
    assert [r["direction"] for r in G.directions(line).orderBy("transect_id").collect()] == ["west_to_east", "east_to_west"]


def test_correlation_and_snr_guard(spark):
    p = spark.createDataFrame([(1, float(k), 5, 5, 5, 5) for k in range(6)], "transect_id long, distance double, red int, green int, blue int, nir int")
    z = spark.createDataFrame([(1, 0, 0.0, 5.0, "A")], "transect_id long, zone_order int, start double, end double, zone_class string")
    assert all(math.isinf(r["snr_db"]) for r in T.snr(p, z).collect())
    assert T.correlation_matrix(p, ["red", "nir"]).collect()[0]["r"] is None


def test_equal_distances_give_no_gradient(spark):
    s = spark.createDataFrame([(1, float(d), 9 * k, 9, 9, 9 + k) for k, d in enumerate([0, 1, 1, 2, 3])], "transect_id long, distance double, red int, green int, blue int, nir int")
    got = X.compute_features(s).orderBy("distance", "nir").collect()
    assert got[0]["nir_d1"] is not None and got[1]["nir_d1"] is None


# ------------------------------------------------ brute force, repeated distances


def brute_relaxed(labels):
    seen, top, out = set(), -1, []
    for c in labels:
        if c == "UNKNOWN" or c in seen:
            out.append("UNKNOWN")
        elif K.ORDER[c] < top:
            out.append(["VEG_DUNES", "DRY_BEACH", "BEACH_WET", "WATER"][top])
        else:
            seen.add(c)
            top = K.ORDER[c]
            out.append(c)
    return out


def brute_strict(labels, distances, least):
    edge = [k for k in range(len(labels)) if k == 0 or labels[k] != labels[k - 1]] + [len(labels)]
    seen, top, out = set(), -1, ["UNKNOWN"] * len(labels)
    for a, b in zip(edge[:-1], edge[1:]):
        c = labels[a]
        if c != "UNKNOWN" and distances[b - 1] - distances[a] >= least and c not in seen and K.ORDER[c] >= top:
            seen.add(c)
            top = K.ORDER[c]
            out[a:b] = [c] * (b - a)
    return out


def test_monotonic_brute_force(spark):
    import random

    rng, names, rows = random.Random(3), list(K.CLASSES), []
    for t in range(60):
        n = rng.choice([1, 2, 3, 6, 7, 25])
        labels = [names[rng.randrange(6)] for _ in range(n)]
        labels = [labels[k // rng.choice([1, 3])] for k in range(n)]
        rows += [(t, float(k), c) for k, c in enumerate(labels)]
    df = spark.createDataFrame(rows, "transect_id long, distance double, predicted_class string")
    relaxed, strict = (
        {(r[0], r[1]): r[2] for r in f(df).collect()} for f in (K.monotonic_relaxed, K.monotonic_strict)
    )
    for t in range(60):
        d, c = [r[1] for r in rows if r[0] == t], [r[2] for r in rows if r[0] == t]
        assert [relaxed[t, x] for x in d] == brute_relaxed(c)
        assert [strict[t, x] for x in d] == brute_strict(c, d, 2.5)


def test_repeated_distances_keep_their_rows(spark):
    rows = [(1, 0.0, "DRY_BEACH", 1), (1, 1.0, "BEACH_WET", 2), (1, 1.0, "BEACH_WET", 3), (1, 2.0, "WATER", 4)]
    df = spark.createDataFrame(rows, "transect_id long, distance double, predicted_class string, red int")
    zones = spark.createDataFrame([(1, 0, 0.0, 1.0, "A"), (1, 1, 1.0, 5.0, "B")], "transect_id long, zone_order int, start double, end double, zone_class string")
    for f in (K.monotonic_relaxed, K.monotonic_strict, lambda x: M.points_in_zones(x, zones)):
        assert sorted(r["red"] for r in f(df).collect()) == [1, 2, 3, 4]
    assert [r["zone_class"] for r in M.points_in_zones(df, zones).orderBy("red").collect()] == ["A", "A", "A", "B"]


def test_falling_distances_are_set_aside(spark):
    rows = [(1, 5.0, 0), (1, 4.0, 1), (2, 4.0, 2), (2, 4.0, 3), (2, 5.0, 4)]
    df = spark.createDataFrame([(t, d, o, 1, 2, 3, 4) for t, d, o in rows], "transect_id long, distance double, ord long, red int, green int, blue int, nir int")
    sound, bad = X.valid_samples(df)
    assert {r["transect_id"] for r in sound.collect()} == {2} and [r["n_falling"] for r in bad.collect()] == [1]


def boundary_frames(spark, nir, at):
    rows = [(1, float(k), 100, 100, 100, int(v)) for k, v in enumerate(nir)]
    points = spark.createDataFrame(rows, "transect_id long, distance double, red int, green int, blue int, nir int")
    return points, spark.createDataFrame([(1, 1, "A_to_B", float(x)) for x in at], "transect_id long, seq int, manual_type string, position double")


def test_transition_of_a_step(spark):
    nir = [200] * 10 + [150, 100, 50] + [50] * 8
    got = T.transition_characteristics(*boundary_frames(spark, nir, [11])).collect()[0]
    smooth = np.concatenate([np.polyval(np.polyfit(range(5), nir[1:6], 2), [0, 1]), np.convolve(nir[1:], np.array([-3, 12, 17, 12, -3]) / 35, "valid"), np.polyval(np.polyfit(range(5), nir[-5:], 2), [3, 4])])
    d1 = np.gradient(smooth)
    assert got["nir_before"] == pytest.approx(np.mean(nir[1:11])) and got["nir_after"] == pytest.approx(np.mean(nir[11:]))
    assert got["nir_d1_min"] == pytest.approx(d1.min()) and got["nir_d2_at_boundary"] == pytest.approx(np.gradient(d1)[10])
    assert got["width"] == 2.0 and got["longest_run"] == (d1 < -3).sum()
    light = (np.array(nir, float) + 300) / 4
    assert got["variability_ratio"] == pytest.approx(np.std(light[11:]) / np.std(light[1:11]))


def test_transition_that_rises_has_thresholds_below(spark):
    got = T.transition_characteristics(*boundary_frames(spark, [50] * 10 + [200] * 10, [10])).collect()[0]
    assert got["nir_drop"] == -150 and got["width"] is None  # nir never falls below where it began
    assert got["variability_ratio"] is None


def test_transition_needs_samples_on_both_sides(spark):
    assert T.transition_characteristics(*boundary_frames(spark, range(30), [0])).count() == 0
    assert T.transition_characteristics(*boundary_frames(spark, range(4), [2])).count() == 0


def test_type_accuracy(spark):
    matches = spark.createDataFrame([("TP", "a", "a"), ("TP", "a", "b"), ("TP", "b", None), ("FN", "c", None)], "label string, manual_type string, detected_type string")
    got = {r["manual_type"]: (r["total"], r["correct"], r["accuracy"]) for r in M.type_accuracy(matches).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
