"""Signal features of every sample: one exchange on the transect, then window layers.

Each layer holds windows of the same partitioning and order, so Spark plans a single
exchange and sort for all of them; the two peak features are folds over a transect's
values as arrays.  Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.peaks import peaks
from .config import DEFAULT, Config

EPS = S.EPS
BANDS = ("red", "green", "blue", "nir")
SCALES, SECOND_SCALES = (5, 7, 9, 11), (5, 7, 9)
FEATURES = (
    "ndvi ndwi brightness nir_ratio blue_red_ratio red_green_ratio rg_ratio_d1 rg_ratio_d1_smooth nir_d1 nir_d1_smooth "
    "brightness_d1 red_d1 red_d1_smooth green_d1 green_d1_smooth blue_d1 blue_d1_smooth variability slope curvature "
    "local_range spectral_angle has_oscillations nir_d1_w5 nir_d1_w7 nir_d1_w9 nir_d1_w11 nir_d2_w5 nir_d2_w7 nir_d2_w9 "
    "has_rgb_foam_peak"
).split()


def band(name: str) -> Column:
    return F.col(name).cast("double")


def point_columns() -> dict[str, Column]:
    """Features of a sample alone."""
    r, g, b, n = (band(c) for c in BANDS)
    return {
        "ndvi": (n - r) / (n + r + EPS),
        "ndwi": (g - n) / (g + n + EPS),
        "brightness": (r + g + b + n) / 4,
        "nir_ratio": n / ((r + g + b) / 3 + EPS),
        "blue_red_ratio": b / (r + EPS),
        "red_green_ratio": r / (g + EPS),
    }


def pair_columns() -> dict[str, Column]:
    """The pairwise ratios and normalised differences of the offline profiling."""
    r, g, b, n = (band(c) for c in BANDS)
    out = {f"{x}_{y}_ratio": c / (d + EPS) for x, c, y, d in (
        ("red", r, "blue", b), ("red", r, "nir", n), ("green", g, "blue", b), ("green", g, "nir", n),
        ("blue", b, "nir", n), ("red", r, "green", g), ("blue", b, "red", r))}
    return out | {f"nd_{x}": (c - d) / (c + d + EPS) for x, c, d in (("rg", r, g), ("rb", r, b), ("gb", g, b))}


def guarded_indices() -> dict[str, Column]:
    """Indices that are 0 where the denominator is not positive."""
    r, g, _, n = (band(c) for c in BANDS)

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return {"ndvi": safe(n - r, n + r), "ndwi": safe(g - n, g + n), "nir_ratio4": safe(n, (r + g + band("blue") + n) / 4)}


def spectral_angle(w) -> Column:
    """Degrees between a sample's band vector and the one before."""
    now = [band(c) for c in BANDS]
    before = [F.lag(c).over(w) for c in now]
    dot = sum((a * b for a, b in zip(now, before)), F.lit(0.0))
    a, b = (F.sqrt(sum((x * x for x in v), F.lit(0.0))) for v in (now, before))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (a * b + EPS)))
    return F.when(before[0].isNull() | (a == 0) | (b == 0), 0.0).otherwise(F.degrees(F.acos(cosine)))


def window_features(df: DataFrame, key: str = "transect_id") -> DataFrame:
    """All features but the peaks.  Keeps the input columns, adds i and n."""
    w = S.series(key)
    df = S.indexed(df, w).withColumns(point_columns())
    df = df.withColumn("rgb", (band("red") + band("green") + band("blue")) / 3)
    first = {f"{b}_d1": S.gradient(band(b), w) for b in BANDS}
    first |= {"brightness_d1": S.gradient("brightness", w), "rg_ratio_d1": S.gradient("red_green_ratio", w)}
    first |= {f"u{s}": S.uniform(band("nir"), s, w, truncate=True) for s in SCALES}
    first |= {
        "rgb7": S.uniform("rgb", 7, w),
        "variability": S.centred(F.stddev_samp, "brightness", w),
        "local_range": S.centred(F.max, "brightness", w) - S.centred(F.min, "brightness", w),
        "slope": F.when(S.centred(F.count, "brightness", w) < 3, 0.0).otherwise(
            F.regr_slope(F.col("brightness"), F.col("i").cast("double")).over(w.rowsBetween(-3, 3))
        ),
        "c1": S.gradient_by_index("brightness", w),
        "spectral_angle": spectral_angle(w),
    }
    df = df.withColumns(first)
    second = {f"{b}_d1_smooth": S.uniform(f"{b}_d1", 3, w) for b in BANDS}
    second |= {"rg_ratio_d1_smooth": S.uniform("rg_ratio_d1", 5, w), "curvature": S.gradient_by_index("c1", w)}
    second |= {f"nir_d1_w{s}": S.gradient(f"u{s}", w) for s in SCALES}
    df = df.withColumns(second)
    df = df.withColumns({f"nir_d2_w{s}": S.gradient(f"nir_d1_w{s}", w) for s in SECOND_SCALES})
    return df.drop("c1", *[f"u{s}" for s in SCALES])


PEAKS = ("has_oscillations", "has_rgb_foam_peak")


def peak_features(df: DataFrame, config: Config = DEFAULT, key: str = "transect_id") -> DataFrame:
    """Adds has_oscillations and has_rgb_foam_peak.  A transect's rows are gathered in the
    partitioning of the windows, its peaks are folds over two of their columns, and the rows
    are laid out again."""
    rest = [c for c in df.columns if c not in (key, "i")]
    series = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", *rest))).alias("_s"))
    osc = peaks(F.transform("_s", lambda s: s["brightness"]), config.oscillation_prominence)
    foam = peaks(F.transform("_s", lambda s: s["rgb7"]), config.foam_prominence, config.foam_width)
    near = F.flatten(F.transform(osc, lambda p: F.sequence(p - 3, p + 2)))
    rows = series.select(key, "_s", near.alias("_osc"), foam.alias("_foam")).select(key, F.explode("_s").alias("_r"), "_osc", "_foam")
    flags = [F.array_contains(a, F.col("_r.i").cast("int")).alias(c) for c, a in zip(PEAKS, ("_osc", "_foam"))]
    return rows.select(*[key if c == key else F.col(f"_r.`{c}`") for c in df.columns], *flags)


def compute_features(samples: DataFrame, config: Config = DEFAULT, peaks: bool = True) -> DataFrame:
    """The 31 features beside the input columns (and i, n).  Without ``peaks`` the two of
    them are left out, and no rows are gathered."""
    df = window_features(samples)
    names = FEATURES if peaks else [c for c in FEATURES if c not in PEAKS]
    kept = [*samples.columns, *[c for c in ("i", "n") if c not in samples.columns]]
    if peaks:
        df = peak_features(df.select(*kept, "rgb7", *[c for c in FEATURES if c not in PEAKS]), config)
    return df.select(*kept, *names)


def feature_summary(features: DataFrame) -> DataFrame:
    """Mean, standard deviation and range of ten features, a row each."""
    names = "ndvi ndwi brightness nir_ratio nir_d1 nir_d1_smooth variability slope curvature local_range".split()
    stacked = features.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in names])).alias("s"))
    return stacked.groupBy(F.col("s.feature").alias("feature")).agg(
        F.avg("s.v").alias("mean"), F.stddev_samp("s.v").alias("std"), F.min("s.v").alias("min"), F.max("s.v").alias("max")
    )


def valid_samples(samples: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(samples of sound transects, violations): a transect with a null, a negative value or
    a distance that falls in the order given is set aside with the counts of each.  Readers
    and samplers number their rows in ``ord``; without that column distances can't fall."""
    w = S.series("transect_id", order) if order in samples.columns else None
    null = F.lit(False)
    negative = F.lit(False)
    for c in (*BANDS, "distance"):
        null = null | F.col(c).isNull()
    for c in BANDS:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    falls = F.coalesce(F.col("distance") < F.lag("distance").over(w), F.lit(False)) if w is not None else F.lit(False)
    marked = samples.withColumns({"_null": null, "_neg": negative, "_fall": falls})
    bad = (
        marked.groupBy("transect_id")
        .agg(
            F.sum(F.col("_null").cast("int")).alias("n_null"),
            F.sum(F.col("_neg").cast("int")).alias("n_negative"),
            F.sum(F.col("_fall").cast("int")).alias("n_falling"),
            F.max(F.greatest(*BANDS)).alias("largest"),
        )
        .where("n_null + n_negative + n_falling > 0")
    )
    return samples.join(bad, "transect_id", "left_anti"), bad
