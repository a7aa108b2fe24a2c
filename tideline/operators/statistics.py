"""Group statistics of classes, zones, sections and boundaries.

Wide tables are stacked (one row for each feature) before grouping, so any number of
features is one aggregation, summed on the map side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.quantiles import with_quantiles
from ..functions.tables import settle
from .matching import KEY, boundary_windows, count_if, zone_slices

EPS = 1e-10
PAIRS = (("dry_wet", "BEACH_DRY", "BEACH_WET"), ("wet_water", "BEACH_WET", "WATER"), ("veg_dry", "VEGETATED_DUNES", "BEACH_DRY"))
#: The features of the class tables.
CLASS_FEATURES = "red green blue nir brightness ndvi ndwi nir_ratio blue_red_ratio red_green_ratio variability".split()


def stack(df: DataFrame, keys: list, features: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    out = df.select(*keys, F.explode(cells).alias("_s"))
    return out.select(*out.columns[:-1], "_s.feature", "_s.value")


def class_statistics(labelled: DataFrame, features: list[str] = CLASS_FEATURES, by: str = "zone_class") -> DataFrame:
    """feature, class, mean, std, min, max, n (nulls included in n)."""
    v = F.col("value")
    return stack(labelled, [F.col(by).alias("class")], features).groupBy("feature", "class").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(F.lit(1)).alias("n")
    )


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 > 0) & (n2 > 0) & (pooled > 0), (m1 - m2) / pooled).otherwise(0.0)


def _beta_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution: the regularised incomplete beta function by its
    continued fraction."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0 if flip else 0.0
    front = exp(a * log(x) + b * log(1 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    p = front * h
    return 1 - p if flip else p


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([np.nan if not np.isfinite(x) else _beta_tail(x, a, b) for x, a, b in zip(f, d1, d2)])


def discriminability(labelled: DataFrame, features: list[str] = CLASS_FEATURES, by: str = "zone_class") -> DataFrame:
    """Per feature: ANOVA F and p over the classes, |Cohen's d| of three pairs, their mean,
    and the rank by it.  The long table is summed by feature and class first."""
    v = F.col("value")
    s = stack(labelled, [F.col(by).alias("class")], features).where("value is not null").groupBy("feature", "class").agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v")
    )
    grand = Window.partitionBy("feature")
    s = s.withColumn("g", F.sum(F.col("n") * F.col("m")).over(grand) / F.sum("n").over(grand))

    def of(c: str, x: str) -> Column:
        return F.max(F.when(F.col("class") == c, F.col(x)))

    sums = [
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
    ]
    for name, a, b in PAIRS:
        d = cohens_d(of(a, "m"), of(a, "v"), F.coalesce(of(a, "n"), F.lit(0)), of(b, "m"), of(b, "v"), F.coalesce(of(b, "n"), F.lit(0)))
        sums.append(F.abs(d).alias(f"{name}_effect"))
    out = s.groupBy("feature").agg(*sums)
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    out = out.withColumn("f_statistic", F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2)))
    out = out.withColumn("p_value", f_tail("f_statistic", d1.cast("double"), d2.cast("double")))
    mean = sum((F.col(f"{n}_effect") for n, _, _ in PAIRS), F.lit(0.0)) / 3
    out = out.withColumn("overall_discriminability", mean)
    rank = F.row_number().over(Window.orderBy(F.desc("overall_discriminability"), "feature"))  # one row a feature
    return out.select("feature", "f_statistic", "p_value", *[f"{n}_effect" for n, _, _ in PAIRS], "overall_discriminability", rank.alias("rank"))


def compare_tp_fp(windows: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: mean and std of TP and FP rows, difference, |Cohen's d| (0 if one side
    has a single row), strongest first."""
    v = F.col("value")

    def side(x: str, agg) -> Column:
        return agg(F.when(F.col("label") == x, v))

    s = stack(windows, ["label"], features).where("label in ('TP', 'FP')").groupBy("feature").agg(
        side("TP", F.avg).alias("tp_mean"), side("TP", F.stddev_samp).alias("tp_std"), side("FP", F.avg).alias("fp_mean"), side("FP", F.stddev_samp).alias("fp_std"),
        side("TP", F.count).alias("n1"), side("FP", F.count).alias("n2"),
    )
    d = F.abs(cohens_d(F.col("tp_mean"), F.col("tp_std") * F.col("tp_std"), F.col("n1"), F.col("fp_mean"), F.col("fp_std") * F.col("fp_std"), F.col("n2")))
    return s.where("n2 > 0").select("feature", "tp_mean", "tp_std", "fp_mean", "fp_std", (F.col("tp_mean") - F.col("fp_mean")).alias("difference"), F.coalesce(d, F.lit(0.0)).alias("effect_size"))


def window_features(points: DataFrame, detections: DataFrame, half: float = 5.0) -> DataFrame:
    """Fourteen statistics of the samples around each detection."""
    rows = boundary_windows(points, detections.select(KEY, F.col("detected_position").alias("centre"), "label"), "centre", half)
    aggs = []
    for c in ("nir_d1_smooth", "nir", "brightness", "ndvi", "ndwi"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    aggs += [
        F.min("nir_d1_smooth").alias("nir_d1_min"), F.max("variability").alias("variability_max"), F.avg("variability").alias("variability_mean"),
        (F.min_by("nir", "distance") - F.max_by("nir", "distance")).cast("double").alias("nir_drop"),
    ]
    return rows.groupBy(KEY, "centre", "label").agg(*aggs)


WINDOW_FEATURES = (
    "nir_d1_smooth_mean nir_d1_smooth_std nir_mean nir_std brightness_mean brightness_std ndvi_mean ndvi_std ndwi_mean ndwi_std "
    "nir_d1_min variability_max variability_mean nir_drop"
).split()


def zone_derivatives(features: DataFrame, zones: DataFrame, threshold: float = -3.0) -> DataFrame:
    """Per zone of at least three samples: derivative statistics, crossings, sustained drops,
    variation, trend and whether all bands fall or rise together."""
    rows = zone_slices(features, zones)
    zone = [KEY, "zone_order"]
    w = Window.partitionBy(*zone).orderBy("distance")
    below = F.coalesce(F.col("nir_d1_smooth") < threshold, F.lit(False))
    rows = rows.withColumn("_below", below).withColumn("_new", S.changed("_below", w))
    rows = rows.withColumn("_run", S.run_number("_new", w))
    long_runs = rows.where("_below").groupBy(*zone, "_run").count().where("count >= 3").groupBy(*zone).agg(F.count(F.lit(1)).alias("sustained_drops"))
    nir, b = F.col("nir").cast("double"), F.col("brightness")
    means = {c: F.avg(f"{c}_d1").alias(f"{c}_d1_mean") for c in ("red", "green", "blue", "nir")}
    out = rows.groupBy(*zone, "zone_class", "zone_start", "zone_end").agg(
        F.count(F.lit(1)).alias("num_points"), *means.values(),
        F.stddev_samp("nir_d1").alias("nir_d1_std"), F.min("nir_d1").alias("nir_d1_min"), F.max("nir_d1").alias("nir_d1_max"),
        count_if(F.col("_below")).alias("threshold_crossings"),
        F.try_divide(F.stddev_samp(nir), F.avg(nir)).alias("nir_cv"), F.try_divide(F.stddev_samp(b), F.avg(b)).alias("brightness_cv"),
        F.regr_slope(nir, F.col("distance")).alias("nir_slope"), F.regr_r2(nir, F.col("distance")).alias("nir_r_squared"),
        F.regr_slope(b, F.col("distance")).alias("brightness_slope"),
    ).where("num_points >= 3")
    down = up = F.lit(True)
    for c in means:
        down, up = down & (F.col(f"{c}_d1_mean") < 0), up & (F.col(f"{c}_d1_mean") > 0)
    return (
        out.join(long_runs, zone, "left")
        .fillna(0, ["sustained_drops"])
        .withColumns({"span": F.col("zone_end") - F.col("zone_start"), "crossing_rate": F.col("threshold_crossings") / F.col("num_points"), "derivative_alignment": down | up})
    )


def dominant_frequency(points: DataFrame, zones: DataFrame, zone_class: str = "WATER") -> DataFrame:
    """The strongest frequency of the linearly detrended nir in each zone of the class with
    more than ten samples: the line by regression, then a discrete Fourier transform as sums
    of cosines and sines; of equal powers the lower frequency."""
    w = Window.partitionBy(KEY, "zone_order").orderBy("distance")
    rows = zone_slices(points, zones.where(F.col("zone_class") == zone_class)).withColumn("k", (F.row_number().over(w) - 1).cast("double"))
    x = F.col("nir").cast("double")
    zone = rows.groupBy(KEY, "zone_order").agg(
        F.regr_slope(x, F.col("k")).alias("slope"), F.regr_intercept(x, F.col("k")).alias("level"), F.count(F.lit(1)).alias("n"),
        ((F.max("distance") - F.min("distance")) / (F.count(F.lit(1)) - 1)).alias("step"), F.collect_list(F.struct("k", x.alias("x"))).alias("series"),
    ).where("n > 10")
    left = F.transform("series", lambda s: F.struct(s["k"].alias("k"), (s["x"] - F.col("level") - F.col("slope") * s["k"]).alias("x")))

    def power(j: Column) -> Column:
        def part(wave) -> Column:
            return F.aggregate("rest", F.lit(0.0), lambda total, s: total + s["x"] * wave(2 * math.pi * j * s["k"] / F.col("n")))

        return F.struct((F.pow(part(F.cos), 2) + F.pow(part(F.sin), 2)).alias("power"), (-j).alias("j"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int") - 1), power))
    return zone.withColumn("rest", left).select(KEY, "zone_order", (-best["j"] / (F.col("n") * F.col("step"))).alias("dominant_frequency"))


def hypotheses(zone_stats: DataFrame) -> DataFrame:
    """Per class: means behind the three hypotheses (crossings, sustained share, alignment)."""
    return zone_stats.groupBy("zone_class").agg(
        F.avg("threshold_crossings").alias("mean_crossings"), F.avg("crossing_rate").alias("mean_crossing_rate"),
        F.when(F.sum("threshold_crossings") > 0, F.sum("sustained_drops") / F.sum("threshold_crossings")).otherwise(0.0).alias("sustained_ratio"),
        (100 * F.avg(F.col("derivative_alignment").cast("double"))).alias("aligned_pct"), F.avg("nir_cv").alias("mean_nir_cv"),
    )


def snr(points: DataFrame, zones: DataFrame, least: int = 5) -> DataFrame:
    """20 log10(mean / population std) of each band in each zone of five samples or more;
    infinite where nothing varies."""
    long = stack(zone_slices(points, zones), [KEY, "zone_order", "zone_class"], ["red", "green", "blue", "nir"])
    s = long.groupBy(KEY, "zone_order", "zone_class", F.col("feature").alias("band")).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return s.where(F.col("n") >= least).select(KEY, "zone_order", "zone_class", "band", F.when(F.col("s") > 0, 20 * F.log10(F.col("m") / F.col("s"))).otherwise(F.lit(float("inf"))).alias("snr_db"))


SECTION_BANDS = ("red", "green", "blue", "nir", "brightness")
SECTION_RATIOS = ("ndvi", "ndwi", "nir_ratio", "rg_ratio", "blue_red_ratio")


def profile_columns() -> dict[str, Column]:
    """Brightness of all four bands and the indices of the offline profiles."""
    r, g, b, n = (F.col(c).cast("double") for c in ("red", "green", "blue", "nir"))
    light = (r + g + b + n) / 4
    return {
        "brightness": light, "ndvi": (n - r) / (n + r + EPS), "ndwi": (g - n) / (g + n + EPS), "nir_ratio": n / (light + EPS),
        "rg_ratio": r / (g + EPS), "blue_red_ratio": b / (r + EPS),
    }


def section_profiles(points: DataFrame, zones: DataFrame, inset: float = 5.0) -> DataFrame:
    """Zone x band or index: mean, spread, quartiles; sections are cut in from the zone edges.
    Bands and brightness also have a variation coefficient and, where more than three samples
    vary, the population's skewness and excess kurtosis."""
    rows = zone_slices(points, zones, inset).withColumns(profile_columns())
    v = F.col("value")
    s = stack(rows, [KEY, "zone_order", "zone_class"], [*SECTION_BANDS, *SECTION_RATIOS]).groupBy(KEY, "zone_order", "zone_class", F.col("feature").alias("band")).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"),
        F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt"),
    )
    is_band = F.col("band").isin(*SECTION_BANDS)
    many = is_band & (F.col("n") > 3) & (F.col("std") > 0)
    return s.withColumns(
        {
            "iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min"), "cv": F.when(is_band, F.col("std") / (F.col("mean") + EPS)),
            "skewness": F.when(many, F.col("_skew")), "kurtosis": F.when(many, F.col("_kurt")),
        }
    ).drop("_skew", "_kurt")


def section_derivatives(points: DataFrame, zones: DataFrame, inset: float = 5.0) -> DataFrame:
    """Per section: samples, length, variability (more than five samples) and, for five or
    more, the derivatives of nir and brightness smoothed within the section."""
    one = [KEY, "zone_order", "zone_class"]
    w = Window.partitionBy(*one).orderBy("distance")
    rows = S.indexed(zone_slices(points, zones, inset).withColumns(profile_columns()), w)
    rows = rows.withColumns({"_n": S.savitzky_golay(F.col("nir").cast("double"), w), "_b": S.savitzky_golay("brightness", w)})
    rows = rows.withColumns({"_n1": S.gradient("_n", w), "_b1": S.gradient("_b", w)}).withColumn("_n2", S.gradient("_n1", w))
    return rows.groupBy(*one).agg(
        F.count(F.lit(1)).alias("n"), (F.max("distance") - F.min("distance")).alias("length_m"),
        F.when(F.count(F.lit(1)) > 5, F.stddev_pop("brightness")).alias("variability"),
        F.avg("_n1").alias("nir_d1_mean"), F.stddev_samp("_n1").alias("nir_d1_std"), F.min("_n1").alias("nir_d1_min"), F.max("_n1").alias("nir_d1_max"),
        F.avg("_n2").alias("nir_d2_mean"), F.stddev_samp("_n2").alias("nir_d2_std"),
        F.avg("_b1").alias("brightness_d1_mean"), F.stddev_samp("_b1").alias("brightness_d1_std"),
    )


def class_zone_statistics(points: DataFrame, zones: DataFrame, inset: float = 5.0) -> DataFrame:
    """Per class: its samples pooled over all sections, with population std, and as feature
    ``variability`` the sample std of brightness of each section of more than five samples.
    Indices are 0 where their denominator is not positive."""
    r, g, b, n = (F.col(c).cast("double") for c in ("red", "green", "blue", "nir"))
    light = (r + g + b + n) / 4

    def safe(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    rows = zone_slices(points, zones, inset).withColumns(
        {"brightness": light, "ndvi": safe(n - r, n + r), "ndwi": safe(g - n, g + n), "nir_ratio": safe(n, light), "blue_red_ratio": safe(b, r)}
    )
    v = F.col("value")
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    pooled = stack(rows, ["zone_class"], ["red", "green", "blue", "nir", "brightness", "ndvi", "ndwi", "nir_ratio", "blue_red_ratio"]).groupBy("zone_class", "feature").agg(*aggs)
    each = rows.groupBy("zone_class", KEY, "zone_order").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("brightness").alias("value")).where("_n > 5")
    return pooled.unionByName(each.groupBy("zone_class", F.lit("variability").alias("feature")).agg(*aggs))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both; null where one of them doesn't vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def section_correlations(points: DataFrame, zones: DataFrame, inset: float = 5.0) -> DataFrame:
    rows = zone_slices(points, zones, inset)
    pairs = (("red", "green"), ("red", "nir"), ("green", "nir"), ("blue", "nir"))
    out = rows.groupBy(KEY, "zone_order", "zone_class").agg(F.count(F.lit(1)).alias("n"), *[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"corr_{a}_{b}") for a, b in pairs])
    return out.where("n > 3")


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Section means by class and band."""
    m = F.col("mean")
    return profiles.groupBy("zone_class", "band").agg(
        F.avg(m).alias("mean_of_means"), F.stddev_samp(m).alias("std_of_means"), F.min(m).alias("min_mean"), F.max(m).alias("max_mean"),
        F.percentile(m, 0.5).alias("median_mean"), F.count(F.lit(1)).alias("n_sections"),
    )


def separability(labelled: DataFrame, features: list[str] = CLASS_FEATURES, top: int = 15) -> DataFrame:
    """Spread of the class means over the mean class std, the largest first (a top-k report)."""
    s = class_statistics(labelled, features)
    out = s.groupBy("feature").agg(F.try_divide(F.max("mean") - F.min("mean"), F.avg("std")).alias("separability"))
    return out.orderBy(F.desc("separability"), "feature").limit(top)


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k:]]
    one = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def five_numbers(labelled: DataFrame, features: list[str], by: str = "zone_class") -> DataFrame:
    """Per feature and class: range, quartiles, mean, deviation, number."""
    v = F.col("value")
    rows = settle(stack(labelled, [F.col(by).alias("class")], features).select("feature", "class", "value"), "values")
    out = rows.groupBy("feature", "class").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return with_quantiles(out, rows, ["feature", "class"], "value", quarters).select("feature", "class", "min", *quarters, "max", "mean", "std", "n")


def threshold_coverage(df: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Per column: five percentiles and the share of rows at or above its level.  Values are
    compared when rounded to nine places: a standard deviation's last bits say nothing."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("level")) for c, x in levels.items()])
    rows = settle(df.select(F.explode(cells).alias("s")).select("s.*"), "values")
    shares = rows.groupBy("feature", "level").agg((100 * F.avg((F.round("value", 9) >= F.col("level")).cast("double"))).alias("pct_covered"))
    wanted = {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}
    return with_quantiles(shares, rows, ["feature", "level"], "value", wanted).select("feature", "level", *wanted, "pct_covered")


def boundary_profile(points: DataFrame, manual: DataFrame, half: float = 10.0) -> DataFrame:
    """Mean and std of each band by boundary type and offset from the boundary."""
    rows = boundary_windows(points, manual, "position", half)
    return stack(rows, ["manual_type", "offset"], ["red", "green", "blue", "nir"]).groupBy("manual_type", "offset", F.col("feature").alias("band")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )


def boundary_changes(features: DataFrame, manual: DataFrame, half: float = 10.0) -> DataFrame:
    """Per boundary: band means before and after, change and change in percent, and the
    derivative's mean and largest size near it."""
    rows = boundary_windows(features, manual, "position", half)
    before, after = F.col("offset") < 0, F.col("offset") >= 0
    aggs = []
    for b in ("red", "green", "blue", "nir"):
        aggs += [F.avg(F.when(before, F.col(b))).alias(f"{b}_before"), F.avg(F.when(after, F.col(b))).alias(f"{b}_after")]
    aggs += [F.avg("nir_d1").alias("nir_d1_mean"), F.max(F.abs("nir_d1")).alias("nir_d1_max_abs"), F.max(F.abs("nir_d2_w5")).alias("nir_d2_max_abs"), F.count(F.lit(1)).alias("n")]
    out = rows.groupBy(KEY, "seq", "manual_type").agg(*aggs)
    change = {f"{b}_change": F.col(f"{b}_after") - F.col(f"{b}_before") for b in ("red", "green", "blue", "nir")}
    pct = {f"{b}_change_pct": F.when(F.col(f"{b}_before") != 0, 100 * (F.col(f"{b}_after") - F.col(f"{b}_before")) / F.col(f"{b}_before")) for b in ("red", "green", "blue", "nir")}
    return out.withColumns(change | pct)


SIDES = {"nir": "nir_drop", "brightness": "brightness_drop", "nir_ratio": "nir_ratio_change", "rg_ratio": "rg_ratio_change"}


def transition_characteristics(points: DataFrame, manual: DataFrame, half: float = 10.0) -> DataFrame:
    """How a boundary looks: means on both sides and their difference, steepest falls and
    where, 20-80 % width of the nir fall, asymmetry, how far the bands' steepest points lie
    apart, texture ratio, second derivative, longest run below -3, red/green pattern.

    Derivatives are taken on the smoothed slice around the boundary, edges included, and
    rounded to nine places, so that the first of equal ones is found.  A slice needs five
    samples and one on each side, or its boundary is left out."""
    bands = ("red", "green", "blue", "nir")
    one = [KEY, "seq"]
    w = Window.partitionBy(*one).orderBy("distance")
    rows = boundary_windows(points.select(KEY, "distance", *bands), manual, "position", half)
    rows = S.indexed(rows.withColumns(profile_columns()), w).where("n >= 5")
    sloped = (*bands, "brightness", "rg_ratio")
    rows = rows.withColumns({f"s_{b}": S.savitzky_golay(F.col(b).cast("double"), w) for b in sloped})
    rows = rows.withColumns({f"e_{b}": S.gradient(f"s_{b}", w) for b in sloped})
    rows = rows.withColumn("d2", S.gradient("e_nir", w)).withColumns({f"d_{b}": F.round(f"e_{b}", 9) for b in sloped})
    before, after = F.col("offset") < 0, F.col("offset") >= 0
    rows = rows.withColumn("_s", F.coalesce(F.col("d_nir") < -3, F.lit(False))).withColumn("_c", S.changed("_s", w)).withColumn("_r", S.run_number("_c", w))

    def steepness(b: str, place: str) -> Column:  # the first of the steepest falls; unknown slopes are none
        return F.when(F.col(f"d_{b}").isNotNull(), F.struct(f"d_{b}", place))

    # what the second look needs of the whole slice: the mean before, the fall, the steepest place
    whole = Window.partitionBy(*one)
    rows = rows.withColumns(
        {
            "_before": F.avg(F.when(before, F.col("nir"))).over(whole), "_after": F.avg(F.when(after, F.col("nir"))).over(whole),
            "p": F.min(steepness("nir", "i")).over(whole)["i"], "_run": F.when(F.col("_s"), F.count(F.lit(1)).over(Window.partitionBy(*one, "_r"))),
        }
    )
    total = F.abs(F.col("_before") - F.col("_after"))
    k, nearest = F.col("i") - F.col("p"), F.struct(F.abs("offset"), "distance")

    def first_under(part: float) -> Column:
        return F.min(F.when(F.col("nir") < F.round(F.col("_before") - part * total, 9), F.col("distance")))

    sides = {f"{c}_{side}": F.avg(F.when(at, F.col(c).cast("double"))) for c in SIDES for side, at in (("before", before), ("after", after))}
    places = {f"at_{b}": F.min(steepness(b, "distance"))["distance"] for b in (*bands, "brightness")}
    aggs = sides | places | {
        "nir_d1_min": F.min("d_nir"), "brightness_d1_min": F.min("d_brightness"), "rg_ratio_d1_min": F.min("d_rg_ratio"),
        "brightness_std_before": F.stddev_pop(F.when(before, F.col("brightness"))), "brightness_std_after": F.stddev_pop(F.when(after, F.col("brightness"))),
        "nir_d2_max_abs": F.max(F.abs("d2")), "nir_d2_at_boundary": F.min_by("d2", nearest), "rg_ratio_at_boundary": F.min_by("rg_ratio", nearest),
        "longest_run": F.coalesce(F.max("_run"), F.lit(0)),
        "_width": first_under(0.8) - first_under(0.2), "_p": F.first("p"), "_n": F.first("n"),
        "_left": F.avg(F.when(k.between(-3, -1), F.abs("d_nir"))), "_right": F.avg(F.when(k.between(1, 3), F.abs("d_nir"))),
    }
    out = rows.groupBy(*one, "manual_type", "position").agg(*[v.alias(c) for c, v in aggs.items()]).where("nir_before is not null and nir_after is not null")
    at = [F.col(f"at_{b}") for b in bands]
    mean = sum(at[1:], at[0]) / 4
    inner = (F.col("_p") > 2) & (F.col("_p") < F.col("_n") - 2) & (F.col("_right") > 0)
    return out.withColumns(
        {name: F.col(f"{c}_before") - F.col(f"{c}_after") for c, name in SIDES.items()}
        | {
            "width": F.when(F.abs(F.col("nir_before") - F.col("nir_after")) > 5, F.col("_width")), "asymmetry": F.when(inner, F.col("_left") / F.col("_right")),
            "band_synchrony": F.sqrt(sum(((a - mean) * (a - mean) for a in at[1:]), (at[0] - mean) * (at[0] - mean)) / 4),
            "variability_ratio": F.when(F.col("brightness_std_before") > 0, F.col("brightness_std_after") / F.col("brightness_std_before")),
        }
    ).drop("_width", "_p", "_n", "_left", "_right")


def transition_summary(characteristics: DataFrame, features: list[str]) -> DataFrame:
    v = F.col("value")
    return stack(characteristics, ["manual_type"], features).groupBy("manual_type", "feature").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")
    )


def multiscale_profiles(points: DataFrame, flagged: DataFrame, half: float = 15.0, sizes=(1, 3, 5, 7, 9, 11)) -> DataFrame:
    """Mean nir profile around detected and missed boundaries of a type, smoothed at several
    sizes: the largest gradient of each and their ratio (infinite over 0)."""
    rows = boundary_windows(points, flagged, "position", half)
    mean = rows.groupBy("manual_type", "detected", "offset").agg(F.avg("nir").alias("m"))
    w = Window.partitionBy("manual_type", "detected").orderBy("offset")
    mean = S.indexed(mean, w)
    mean = mean.withColumns({f"u{z}": S.uniform("m", z, w) for z in sizes})
    mean = mean.withColumns({f"g{z}": F.abs(S.gradient(f"u{z}", w, "offset")) for z in sizes})
    cells = F.array(*[F.struct(F.lit(z).alias("size"), F.col(f"g{z}").alias("g")) for z in sizes])
    g = F.col("s.g")
    out = mean.select("manual_type", "detected", F.explode(cells).alias("s")).groupBy("manual_type", F.col("s.size").alias("size")).agg(
        F.max(F.when(F.col("detected"), g)).alias("detected"), F.max(F.when(~F.col("detected"), g)).alias("missed")
    )
    both = F.col("detected").isNotNull() & F.col("missed").isNotNull()
    return out.withColumn("ratio", F.when(both & (F.col("missed") > 0), F.col("detected") / F.col("missed")).when(both, F.lit(float("inf"))))


def multiscale_derivative(features: DataFrame, transect: int, sizes=(1, 3, 5, 7, 9)) -> DataFrame:
    """Plot data: nir_d1 of one transect smoothed at several sizes."""
    w = S.series(KEY)
    rows = features.where(F.col(KEY) == transect)
    rows = rows.withColumns({f"w{s}": S.uniform("nir_d1", s, w) for s in sizes})
    return stack(rows, ["distance"], [f"w{s}" for s in sizes]).withColumnRenamed("feature", "size")


def rolling_features(points: DataFrame, column: str, sizes=(3, 5, 7, 9, 11)) -> DataFrame:
    """Centred rolling mean, std, min, max and range; null where the window is not full."""
    w, out = S.series(KEY), {}
    c = F.col(column).cast("double")
    for s in sizes:
        frame = w.rowsBetween(-(s // 2), s // 2)
        full = F.count(c).over(frame) == s
        for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{name}_{s}"] = F.when(full, agg(c).over(frame))
        out[f"range_{s}"] = F.when(full, F.max(c).over(frame) - F.min(c).over(frame))
    return points.select(KEY, "distance", *[v.alias(k) for k, v in out.items()])


def smoothed_derivatives(points: DataFrame, column: str = "nir") -> DataFrame:
    """Savitzky-Golay smoothing with first and second derivative."""
    w = S.series(KEY)
    rows = S.indexed(points, w).withColumn("smooth", S.savitzky_golay(F.col(column).cast("double"), w))
    rows = rows.withColumn("d1", S.gradient("smooth", w))
    return rows.withColumn("d2", S.gradient("d1", w)).select(KEY, "distance", "smooth", "d1", "d2")


#: Smoothings compared by default: name, then method, width and, where it has one, sigma.
SMOOTHINGS = {
    "uniform_3": {"method": "uniform", "size": 3}, "gaussian_2": {"method": "gaussian", "sigma": 2.0},
    "savgol_5_2": {"method": "savgol", "size": 5, "order": 2}, "median_5": {"method": "median", "size": 5},
}


def smoothing_methods(points: DataFrame, manual: DataFrame, half: float = 20.0, methods: dict[str, dict] | None = None) -> DataFrame:
    """Vegetation boundaries with ten samples around: the largest gradient after each kind of
    smoothing (``series.smoothed`` with the arguments given).  Moving mean and Gaussian keep
    the integer type of the band (cut to integers)."""
    methods = methods or SMOOTHINGS
    veg = manual.where(F.col("manual_type").startswith("VEGETATED_DUNE"))
    w = Window.partitionBy(KEY, "seq").orderBy("distance")
    rows = S.indexed(boundary_windows(points, veg, "position", half).select(KEY, "seq", "distance", "nir"), w).where("n >= 10")
    smooth = {name: S.smoothed(F.col("nir").cast("double"), w, **m) for name, m in methods.items()}
    smooth = {name: F.floor(c + 1e-9).cast("double") if methods[name]["method"] in ("uniform", "gaussian") else c for name, c in smooth.items()}
    rows = rows.withColumns({f"_{k}": c for k, c in smooth.items()})
    rows = rows.withColumns({f"_{k}": F.abs(S.gradient(f"_{k}", w)) for k in smooth})
    most = rows.groupBy(KEY, "seq").agg(*[F.max(f"_{k}").alias(k) for k in smooth])
    cells = F.array(*[F.struct(F.lit(k).alias("method"), F.col(k).alias("max_abs_gradient")) for k in smooth])
    return most.select(KEY, "seq", F.explode(cells).alias("m")).select(KEY, "seq", "m.*")


def processing_stats(classed: DataFrame, found: DataFrame) -> DataFrame:
    """Totals and per-transect averages of points and boundaries, and their confidence."""
    p = classed.agg(F.countDistinct(KEY).alias("transects"), F.count(F.lit(1)).alias("points"))
    t = found.agg(F.count(F.lit(1)).alias("transitions"), F.avg("confidence").alias("conf_mean"), F.stddev_pop("confidence").alias("conf_std"), F.min("confidence").alias("conf_min"), F.max("confidence").alias("conf_max"))
    return p.join(t).withColumns({"points_per_transect": F.try_divide("points", "transects"), "transitions_per_transect": F.try_divide("transitions", "transects")})
