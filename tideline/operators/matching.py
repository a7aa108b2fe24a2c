"""Detections against manual labels: band joins, verdicts, metrics, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.quantiles import with_quantiles
from ..functions.tables import settle
from .config import CLASS_ALIAS

KEY = "transect_id"


def aliased(c) -> Column:
    """A manual class under the detectors' name."""
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for manual, own in CLASS_ALIAS.items():
        out = F.when(c == manual, own).otherwise(out)
    return out


def manual_boundaries(zones: DataFrame, joiner: str = "_to_") -> DataFrame:
    """Where a zone ends and another begins: position and A_to_B, in table order."""
    w = Window.partitionBy(KEY).orderBy("start")
    return (
        zones.withColumn("_next", F.lead("zone_class").over(w))
        .where(F.col("_next").isNotNull())
        .select(
            KEY,
            F.col("end").alias("position"),
            F.concat("zone_class", F.lit(joiner), "_next").alias("manual_type"),
            F.row_number().over(w).alias("seq"),
        )
    )


def first_dry_wet(zones: DataFrame) -> DataFrame:
    """The first dry-to-wet boundary of each transect."""
    b = manual_boundaries(zones).where("manual_type = 'BEACH_DRY_to_BEACH_WET'")
    return b.groupBy(KEY).agg(F.min("position").alias("position"))


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, within: float) -> DataFrame:
    """Rows of one transect with |a - b| <= within, as an equi-join: distances are cut into
    buckets of that width and the right side stands in its own and both neighbouring ones."""
    width = max(within, 1e-9)
    left = left.withColumn("_k", F.floor(F.col(a) / width))
    right = right.withColumn("_k", F.explode(F.array(*[F.floor(F.col(b) / width) + s for s in (-1, 0, 1)])))
    return left.join(right, [KEY, "_k"]).where(F.abs(F.col(a) - F.col(b)) <= within).drop("_k")


def match_transitions(detected: DataFrame, manual: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """TP: a detection with a manual boundary within the tolerance (the closest, ties by
    label order); FP: one without; FN: a manual boundary without any detection near."""
    d = detected.select(KEY, F.col("index").alias("det"), F.col("distance").alias("detected_position"), "confidence", "detection_method", "boundary_type")
    m = manual.select(KEY, "seq", "position", "manual_type")
    pairs = near_pairs(d, m, "detected_position", "position", tolerance)
    error = F.abs(F.col("detected_position") - F.col("position"))
    by = Window.partitionBy(KEY, "det", "detection_method").orderBy(error, "seq")
    best = pairs.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
    tp = best.select(
        KEY, "detected_position", F.lit("TP").alias("label"), F.col("position").alias("manual_position"), "manual_type",
        error.alias("distance_error"), F.col("boundary_type").alias("detected_type"), "confidence",
    )
    fp = d.join(best.select(KEY, "det", "detection_method"), [KEY, "det", "detection_method"], "left_anti").select(
        KEY, "detected_position", F.lit("FP").alias("label"), F.lit(None).cast("double").alias("manual_position"),
        F.lit(None).cast("string").alias("manual_type"), F.lit(None).cast("double").alias("distance_error"),
        F.col("boundary_type").alias("detected_type"), "confidence",
    )
    fn = m.join(pairs.select(KEY, "seq").distinct(), [KEY, "seq"], "left_anti").select(
        KEY, F.lit(None).cast("double").alias("detected_position"), F.lit("FN").alias("label"), F.col("position").alias("manual_position"),
        "manual_type", F.lit(None).cast("double").alias("distance_error"), F.lit(None).cast("string").alias("detected_type"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return tp.unionByName(fp).unionByName(fn)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def metrics(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, mean and root mean square error of the TPs."""
    sums = matches.groupBy(*(by or [])).agg(
        *[F.coalesce(count_if(F.col("label") == x), F.lit(0)).alias(x.lower()) for x in ("TP", "FP", "FN")],
        F.avg(F.when(F.col("label") == "TP", F.col("distance_error"))).alias("mae"),
        F.sqrt(F.avg(F.when(F.col("label") == "TP", F.col("distance_error") * F.col("distance_error")))).alias("rmse"),
    )
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def categories(detected: DataFrame, truth: DataFrame, near: float = 5.0, far: float = 10.0) -> DataFrame:
    """One verdict a transect from its best detection: CORRECT, LOCALIZATION_ERROR,
    FALSE_POSITIVE (too far) or FALSE_NEGATIVE (none)."""
    best = detected.groupBy(KEY).agg(
        F.max_by("distance", F.struct("confidence", -F.col("distance"))).alias("detected_location"),
        F.max("confidence").alias("confidence"),
    )
    error = F.abs(F.col("detected_location") - F.col("position"))
    verdict = (
        F.when(F.col("detected_location").isNull(), "FALSE_NEGATIVE").when(error <= near, "CORRECT").when(error <= far, "LOCALIZATION_ERROR").otherwise("FALSE_POSITIVE")
    )
    return truth.join(best, KEY, "left").select(
        KEY, F.col("position").alias("manual_location"), "detected_location", error.alias("error_m"), "confidence", verdict.alias("result")
    )


def category_metrics(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = {"CORRECT": "correct", "LOCALIZATION_ERROR": "near", "FALSE_NEGATIVE": "false_neg", "FALSE_POSITIVE": "false_pos"}
    s = verdicts.groupBy(*(by or [])).agg(
        *[count_if(F.col("result") == k).alias(v) for k, v in names.items()], F.count(F.lit(1)).alias("total"), F.avg("error_m").alias("avg_error")
    )
    found = F.col("correct") + F.col("near") + F.col("false_pos")
    s = s.withColumns({"precision": ratio(F.col("correct"), found), "recall": ratio(F.col("correct"), F.col("correct") + F.col("false_neg"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def shell_line_metrics(verdicts: DataFrame) -> DataFrame:
    """The validator's rates: near misses leave precision and count for recall."""
    s = verdicts.agg(
        count_if(F.col("result") == "CORRECT").alias("tp"), count_if(F.col("result") == "LOCALIZATION_ERROR").alias("loc"),
        count_if(F.col("result") == "FALSE_POSITIVE").alias("fp"), F.count(F.lit(1)).alias("total"), F.avg("error_m").alias("mean_error"),
        F.percentile("error_m", 0.5).alias("median_error"), F.stddev_pop("error_m").alias("std_error"), F.max("error_m").alias("max_error"),
    )
    return s.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp") + F.col("loc"), F.col("total"))})


def points_in_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Samples with the zone they lie in, both ends included; on a shared edge the first
    zone wins.  A transect's few zones come as one array, so every sample stays one row,
    whatever its distance.  Each task looks its transects up among their zones: by the size
    of its file Spark would send either table whole, the samples too."""
    z = F.struct("zone_order", F.col("start").alias("zone_start"), F.col("end").alias("zone_end"), "zone_class")
    of = zones.groupBy(KEY).agg(F.array_sort(F.collect_list(z)).alias("_zones"))
    first = F.filter("_zones", lambda x: F.col("distance").between(x["zone_start"], x["zone_end"]))
    return points.join(of.hint("shuffle_hash"), KEY).withColumn("_z", F.get(first, F.lit(0))).where("_z is not null").select(*points.columns, "_z.*")


def zone_slices(points: DataFrame, zones: DataFrame, inset: float = 0.0) -> DataFrame:
    """Samples of every zone: [start, end], or with an inset [start + inset, end - inset)."""
    z = zones.select(KEY, "zone_order", F.col("start").alias("zone_start"), F.col("end").alias("zone_end"), "zone_class")
    rows = points.join(z, KEY)
    if inset:
        return rows.where((F.col("distance") >= F.col("zone_start") + inset) & (F.col("distance") < F.col("zone_end") - inset))
    return rows.where("distance between zone_start and zone_end")


def boundary_windows(points: DataFrame, boundaries: DataFrame, at: str, half: float) -> DataFrame:
    """Samples within ``half`` of each boundary, with offset from it."""
    return near_pairs(points, boundaries, "distance", at, half).withColumn("offset", F.col("distance") - F.col(at))


def detected_flags(manual: DataFrame, matches: DataFrame, within: float = 10.0) -> DataFrame:
    """Manual boundaries with whether a TP lies strictly within the distance."""
    tp = matches.where("label = 'TP'").select(KEY, F.col("detected_position").alias("_p"))
    near = near_pairs(manual, tp, "position", "_p", within).where(F.abs(F.col("position") - F.col("_p")) < within)
    hit = near.select(KEY, "seq").distinct().withColumn("detected", F.lit(True))
    return manual.join(hit, [KEY, "seq"], "left").withColumn("detected", F.coalesce("detected", F.lit(False)))


def thresholds(n: int = 30, a: float = -2.0, b: float = -5.0) -> list[float]:
    return [a + (b - a) * k / (n - 1) for k in range(n)]


def thinned(rows: DataFrame, levels: list[float], separation: float) -> DataFrame:
    """(transect_id, threshold, distance) of the candidates g below each level that a greedy
    scan keeps: one closer than ``separation`` to the last kept one replaces it if it is
    stronger.  A fold over a transect's candidates by distance, for every level."""
    series = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("distance", "g"))).alias("series"))
    series = series.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in levels])))

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = F.coalesce(s["distance"] - last["distance"] < separation, F.lit(False))
        instead = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(s))
        return F.when(~near, F.concat(kept, F.array(s))).when(F.abs(s["g"]) > F.abs(last["g"]), instead).otherwise(kept)

    none = F.slice("series", 1, 0)
    below = F.filter("series", lambda s: s["g"] < F.col("threshold"))
    kept = series.select(KEY, "threshold", F.explode(F.aggregate(below, none, step)).alias("s"))
    return kept.select(KEY, "threshold", F.col("s.distance").alias("distance"))


def sweep(features: DataFrame, manual: DataFrame, levels: list[float] | None = None, separation: float = 15.0, tolerance: float = 10.0) -> DataFrame:
    """Precision and recall of the simple derivative detector at each threshold.

    Features are computed once.  Candidates that pass the mildest threshold go, a transect
    at a time, through the greedy thinning for every threshold: a candidate closer than
    ``separation`` to the last kept one replaces it if it is stronger.  A detection is a TP
    if any manual boundary lies within the tolerance; it uses up the first in table order.
    """
    levels = levels or thresholds()
    w = S.series(KEY)
    rows = (
        features.withColumn("_min", S.local_minimum("nir_d1_smooth", w))
        .where((F.col("nir_d1_smooth") < max(levels)) & (F.col("nir") > 50) & F.col("_min"))
        .select(KEY, "distance", F.col("nir_d1_smooth").alias("g"))
    )

    found = thinned(rows, levels, separation)
    found = settle(found, "thinned")  # three branches read it
    pairs = near_pairs(found, manual.select(KEY, "seq", "position"), "distance", "position", tolerance)
    first = pairs.groupBy(KEY, "threshold", "distance").agg(F.min("seq").alias("seq"))
    hits = first.groupBy("threshold").agg(F.count(F.lit(1)).alias("tp"), F.countDistinct(KEY, "seq").alias("used"))
    made = found.groupBy("threshold").agg(F.count(F.lit(1)).alias("num_detections"))
    n = manual.agg(F.count(F.lit(1)).alias("manual"))
    every = features.sparkSession.createDataFrame([(x,) for x in levels], "threshold double")
    out = every.join(made, "threshold", "left").join(hits, "threshold", "left").fillna(0).join(F.broadcast(n))  # one row
    out = out.withColumns({"fp": F.col("num_detections") - F.col("tp"), "fn": F.col("manual") - F.col("used")})
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("num_detections")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    out = out.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("threshold", "tp", "fp", "fn", "num_detections", "precision", "recall", "f1_score")


def optimum(swept: DataFrame) -> DataFrame:
    """The first threshold with the best F1."""
    return swept.orderBy(F.desc("f1_score"), F.desc("threshold")).limit(1)


def confusion(matches: DataFrame) -> DataFrame:
    """TP counts of manual against detected type, long form over the union of labels."""
    tp = matches.where("label = 'TP'").select("manual_type", "detected_type")
    labels = tp.select(F.col("manual_type").alias("l")).union(tp.select("detected_type")).where("l is not null").distinct()
    # labels are class pairs: a few dozen at most, whatever the data
    grid = labels.select(F.col("l").alias("manual_type")).join(F.broadcast(labels.select(F.col("l").alias("detected_type"))))
    counts = tp.groupBy("manual_type", "detected_type").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["manual_type", "detected_type"], "left").fillna(0, ["n"])


def type_accuracy(matches: DataFrame) -> DataFrame:
    """Per manual type: its TPs, those whose detected type has the same name, and the share."""
    tp = matches.where("label = 'TP'").groupBy("manual_type").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("manual_type") == F.col("detected_type")).alias("correct"))
    return tp.withColumn("accuracy", F.col("correct") / F.col("total"))


def error_distribution(matches: DataFrame) -> DataFrame:
    e, hits = F.col("distance_error"), matches.where("label = 'TP'").select("distance_error")
    out = hits.agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop(e).alias("std"),
        (F.avg(e) > 1).alias("biased"), (100 * F.avg((e <= 5).cast("double"))).alias("pct_5"), (100 * F.avg((e <= 10).cast("double"))).alias("pct_10"),
    )
    return with_quantiles(out, hits, [], "distance_error", {"median": 0.5}).select("mae", "rmse", "median", "std", "biased", "pct_5", "pct_10")


def error_ecdf(matches: DataFrame) -> DataFrame:
    """Distinct errors with the share of TPs at most as large; sums by value first."""
    counts = matches.where("label = 'TP'").groupBy("distance_error").agg(F.count(F.lit(1)).alias("n"))
    total = matches.where("label = 'TP'").agg(F.count(F.lit(1)).alias("_n"))
    upto = S.running_total(counts, "distance_error", F.col("n"), "_upto")
    return upto.join(F.broadcast(total)).select("distance_error", (F.col("_upto") / F.col("_n")).alias("share"))  # one row
