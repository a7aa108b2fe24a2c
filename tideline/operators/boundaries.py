"""Boundary detectors, their scores, and what becomes of the candidates.

Detectors are filters over window columns of the same partitioning as the features, so
they add no exchange.  All return one schema; what a detector does not know is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from .config import DEFAULT, Config

KEY = "transect_id"
WATERS = ("WATER", "WAVE_CRESTS")
FIELDS = (
    "transect_id", "index", "distance", "detection_method", "confidence", "magnitude", "nir_value", "nir_drop",
    "brightness_before", "nir_before", "variance_ratio", "bands_agreeing", "band_magnitudes", "sustained",
)
#: Thresholds of the other bands relative to the one of nir.
SCALING = {"nir": 1.0, "red": 0.85, "green": 0.80, "blue": 0.75}


def _record(rows: DataFrame, method: str, **columns: Column) -> DataFrame:
    kinds = {"bands_agreeing": "int", "band_magnitudes": "map<string,double>", "sustained": "boolean", "detection_method": "string"}
    given = {"index": F.col("i"), "distance": F.col("distance"), "transect_id": F.col(KEY), "detection_method": F.lit(method), "nir_value": F.col("nir").cast("double")} | columns
    return rows.select(*[given.get(f, F.lit(None).cast(kinds.get(f, "double"))).alias(f) for f in FIELDS])


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _add(condition: Column, amount) -> Column:
    return F.when(condition, amount).otherwise(0.0)


def vegetation_inflection(f: DataFrame) -> DataFrame:
    w = S.series(KEY)
    before, after = F.lag("nir_d2_w7").over(w), F.lead("nir_d2_w7").over(w)
    rows = f.withColumns(
        {
            "_a": before,
            "_b": after,
            "_m1": F.avg(F.col("nir").cast("double")).over(w.rowsBetween(-10, -1)),
            "_m2": F.avg(F.col("nir").cast("double")).over(w.rowsBetween(0, 9)),
        }
    ).withColumn("_cc", F.abs(F.col("_a") - F.col("_b")))
    size = F.least("n", F.col("i") + 10) - F.greatest(F.lit(0), F.col("i") - 10)
    rows = rows.where((F.col("_a") * F.col("_b") < 0) & (F.col("_cc") > 1.0) & (size >= 10) & (F.col("_m1") > F.col("_m2") + 20))
    return _record(rows, "inflection_point", confidence=F.least(0.65 + F.col("_cc") / 10, F.lit(0.85)), magnitude=F.col("_cc"))


def surf_foam(f: DataFrame, require_nir_drop: bool = True) -> DataFrame:
    drop = F.coalesce(F.col("nir_d1_w7") < -2, F.lit(False))
    falling = F.coalesce(F.col("rg_ratio_d1_smooth") < -0.01, F.lit(False))
    base = F.lit(0.82) if require_nir_drop else F.when(drop, 0.80).otherwise(0.70)
    rows = f.where(F.col("has_rgb_foam_peak") & drop if require_nir_drop else F.col("has_rgb_foam_peak"))
    return _record(rows, "rgb_foam_peak", confidence=F.least(base + _add(falling, 0.03), F.lit(0.90)), magnitude=F.col("nir_d1_w7"))


def consensus(threshold: float) -> tuple[Column, Column]:
    """How many bands fall together at a sample, and their smoothed derivatives."""
    count = sum((F.coalesce(F.col(f"{b}_d1_smooth") < threshold * s, F.lit(False)).cast("int") for b, s in SCALING.items()), F.lit(0))
    return count, F.create_map(*[x for b in SCALING for x in (F.lit(b), F.col(f"{b}_d1_smooth"))])


def sustained(g: str, threshold: float, w, length: int = 3) -> Column:
    frame = w.rowsBetween(0, length - 1)
    return (F.max(g).over(frame) < threshold) & (F.count(g).over(frame) == length)


def drop_candidates(f: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Local minima of the derivative below the threshold on bright enough samples, with
    what came before and after: shared by the strict and the relaxed score."""
    w = S.series(KEY)
    past, future = w.rowsBetween(-5, -1), w.rowsBetween(0, 4)
    nir, v = F.col("nir").cast("double"), "variability"
    early, late = F.col("i") >= 5, F.col("i") < F.col("n") - 5
    rows = f.withColumns(
        {
            "_min": S.local_minimum("nir_d1_w5", w),
            "_drop": F.when(early, F.avg(nir).over(past) - nir).otherwise(0.0),
            "_bb": F.when(early, F.avg("brightness").over(past)).otherwise(0.0),
            "_nb": F.when(early, F.avg(nir).over(past)).otherwise(0.0),
            "_vr": F.when(early & late, F.avg(v).over(future) / (F.avg(v).over(past) + 1e-6)).otherwise(0.0),
            "_hold": sustained("nir_d1_w5", config.derivative, w),
        }
    )
    return rows.where((F.col("nir_d1_w5") < config.derivative) & (nir > config.nir_min) & F.col("_min"))


def _scored(rows: DataFrame, method: str, confidence: Column, config: Config) -> DataFrame:
    count, bands = consensus(config.derivative)
    return _record(
        rows, method, confidence=confidence, magnitude=F.col("nir_d1_w5"), nir_drop=F.col("_drop"), brightness_before=F.col("_bb"),
        nir_before=F.col("_nb"), variance_ratio=F.col("_vr"), bands_agreeing=count, band_magnitudes=bands, sustained=F.col("_hold"),
    )


def dry_wet_strict(candidates: DataFrame, config: Config = DEFAULT) -> DataFrame:
    g, d, i = F.abs("nir_d1_w5"), F.col("distance"), F.col("i")
    drop, bb, nb, vr, rg = (F.col(c) for c in ("_drop", "_bb", "_nb", "_vr", "red_green_ratio"))
    count, _ = consensus(config.derivative)
    near = d.between(40, 70)
    conf = _clip(0.50 + (g + config.derivative) / 30, 0.50, 0.70)
    conf = conf + _add(g > 12, 0.10) + _add(drop > 50, 0.08) + _add((i >= 5) & (bb - F.col("brightness") > 25), 0.05)
    conf = conf + _add(vr > 4, 0.07) + _add(F.col("_hold"), 0.08) + _add(count >= 3, 0.08) + _add(rg.between(0.95, 1.15), 0.05)
    conf = conf + _add(d.between(*config.zone), 0.05) - _add(near & (drop < config.strict_drop), 0.20)
    for value, level, most, floor in (
        (drop, config.soft_drop, 0.15, None), (bb, config.soft_brightness, 0.10, 0), (nb, config.soft_nir, 0.10, 0), (vr, config.soft_variance, 0.08, 0),
    ):
        short = value < level if floor is None else (value < level) & (value > floor)
        conf = conf - _add(short, most * (level - value) / level)
    kept = candidates.where(rg.between(0.90, 1.20) & ~(near & (vr < config.strict_variance_min)))
    return _scored(kept, "derivative_magnitude", _clip(conf, 0.30, 0.95), config).where(F.col("confidence") >= config.strict_low)


def dry_wet_relaxed(candidates: DataFrame, config: Config = DEFAULT) -> DataFrame:
    g, d, i = F.abs("nir_d1_w5"), F.col("distance"), F.col("i")
    drop, bb, nb, vr = (F.col(c) for c in ("_drop", "_bb", "_nb", "_vr"))
    bad = (i >= 5) & ((drop < config.relaxed_drop) | (bb < config.relaxed_brightness) | (nb < config.relaxed_nir))
    bad = bad | ((i >= 5) & (i < F.col("n") - 5) & (vr < config.relaxed_variance)) | ~d.between(*config.bounds)
    conf = _clip(0.40 + (g + config.derivative) / 40, 0.40, 0.60) + _add(g > 10, 0.08) + _add(drop > 30, 0.06) + _add(vr > 3, 0.05)
    conf = conf + _add(d.between(*config.zone), 0.05) - _add(d.between(40, 70) & (drop < 40), 0.15)
    return _scored(candidates.where(~bad), "derivative_magnitude_relaxed", F.least(conf, F.lit(0.85)), config).where(
        F.col("confidence") >= config.relaxed_low
    )


def best_dry_wet(strict: DataFrame, relaxed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The one dry/wet boundary of each transect.  Strict rows decide if one lies in the
    expected zone; relaxed ones step in otherwise, unless there were strict rows and all of
    them lay out of bounds."""
    both = strict.withColumn("_strict", F.lit(True)).unionByName(relaxed.withColumn("_strict", F.lit(False)))
    rows = both.withColumns({"_in": F.col("distance").between(*config.bounds), "_zone": F.col("distance").between(*config.zone)})
    over = Window.partitionBy(KEY)

    def some(c: Column) -> Column:
        return F.max(c.cast("int")).over(over) == 1

    st = F.col("_strict")
    rows = rows.withColumns(
        {
            "_any": some(st),
            "_any_in": some(st & F.col("_in")),
            "_any_zone": some(st & F.col("_in") & F.col("_zone")),
            "_relaxed_zone": some(~st & F.col("_zone")),
        }
    )
    fallback = ~F.col("_any_zone")
    pool = F.when(F.col("_any_zone"), st & F.col("_in") & F.col("_zone")).otherwise(
        ~st & (F.col("_zone") | ~F.col("_relaxed_zone")) & (~F.col("_any") | F.col("_any_in"))
    )
    order = Window.partitionBy(KEY).orderBy(F.desc("confidence"), "distance")
    best = rows.where(pool).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    least = F.when(fallback, config.fallback_low).otherwise(config.strict_low)
    return (
        best.withColumn("detection_mode", F.when(fallback, "fallback").otherwise("strict"))
        .where(F.col("confidence") >= least)
        .select(*FIELDS, "detection_mode")
    )


def _merged(ranked: DataFrame, keys: list[str], given: list[str], order: list[str], config: Config) -> DataFrame:
    """A fold over a group's detections in ``order``: an anchor's detections of its method
    within ``merge_distance``, from the anchor on, give way to the most confident of them
    (the first of equals), and the anchor moves on by as many rows."""
    row = F.struct(F.struct(*order).alias("at"), "distance", "detection_method", "confidence", F.struct(*given).alias("row"))
    by_order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    series = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(row), by_order).alias("series"))

    def step(state: Column, _: Column) -> Column:
        k = state["k"]
        at = F.get("series", k)
        group = F.filter(
            F.transform("series", lambda x, j: F.struct(j.alias("j"), x["distance"].alias("d"), x["detection_method"].alias("m"), x["confidence"].alias("c"))),
            lambda x: (x["j"] >= k) & (x["d"] - at["distance"] < config.merge_distance) & (x["m"] == at["detection_method"]),
        )
        best = F.array_max(F.transform(group, lambda x: F.struct(x["c"].alias("c"), (-x["j"]).alias("j"))))
        moved = F.struct((k + F.size(group)).alias("k"), F.concat(state["kept"], F.array(-best["j"])).alias("kept"))
        return F.when(k < F.size("series"), moved).otherwise(state)

    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("kept"))
    walked = series.withColumn("kept", F.aggregate(F.sequence(F.lit(1), F.size("series")), start, step)["kept"])
    return walked.select(F.explode(F.transform("kept", lambda k: F.get("series", k)["row"])).alias("r")).select("r.*")


def merge_nearby(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Detections of one method less than ``merge_distance`` from an anchor give way to the
    most confident.  The anchor then moves on by as many rows as were merged, whatever
    methods lie between: kept as the pipeline's results depend on it."""
    rank = F.when(F.col("detection_method") == "inflection_point", 0).when(F.col("detection_method") == "rgb_foam_peak", 1).otherwise(2)
    return _merged(found.withColumn("_rank", rank), [KEY], found.columns, ["distance", "_rank", "index"], config)


def merge_by_method(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The clean variant: per transect and method, greedily from the first detection."""
    return _merged(found, [KEY, "detection_method"], found.columns, ["distance", "index"], config)


def is_beach_water(a: Column, b: Column) -> Column:
    """Dry to wet beach, or any land to any water, in either direction."""

    def one_way(x: Column, y: Column) -> Column:
        to_water = x.isin("VEG_DUNES", "DRY_BEACH", "BEACH_WET") & y.isin(*WATERS)
        return to_water | ((x == "DRY_BEACH") & (y == "BEACH_WET"))

    return one_way(a, b) | one_way(b, a)


def neighbour_classes(classed: DataFrame) -> DataFrame:
    """The nearest known class at or before each sample and after it, within ten samples."""
    w = S.series(KEY)
    known = F.when(F.col("predicted_class") != "UNKNOWN", F.col("predicted_class"))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    side = {
        "from_class": F.last(known, ignorenulls=True).over(w.rowsBetween(-9, 0)),
        "to_class": F.first(known, ignorenulls=True).over(w.rowsBetween(1, 9)),
    }
    return classed.select(KEY, F.col("i").alias("index"), *[F.when(inner, F.coalesce(c, F.lit("UNKNOWN"))).alias(n) for n, c in side.items()])


def add_class_info(found: DataFrame, classed: DataFrame) -> DataFrame:
    out = found.join(neighbour_classes(classed), [KEY, "index"], "left")
    better = F.coalesce(is_beach_water(F.col("from_class"), F.col("to_class")), F.lit(False))
    return out.withColumns(
        {
            "boundary_type": F.concat("from_class", F.lit("->"), "to_class"),
            "confidence": F.when(better, F.least(F.col("confidence") + 0.1, F.lit(0.95))).otherwise(F.col("confidence")),
        }
    )


def quality_filter(found: DataFrame, samples: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Confident enough, away from both ends, and between different classes."""
    span = samples.groupBy(KEY).agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"))
    a, b = F.coalesce("from_class", F.lit("UNKNOWN")), F.coalesce("to_class", F.lit("UNKNOWN"))
    least = F.when(F.col("detection_mode") == "fallback", config.fallback_low).otherwise(config.min_confidence)
    inside = F.col("distance").between(F.col("_lo") + config.edge_buffer, F.col("_hi") - config.edge_buffer)
    return found.join(span, KEY).where((F.col("confidence") >= least) & inside & (a != b)).drop("_lo", "_hi")


def boundary_kinds() -> dict[str, Column]:
    a, b, m = F.col("from_class"), F.col("to_class"), F.col("detection_method")
    beach = ("DRY_BEACH", "BEACH_WET")
    kinds = {
        "shore": ((a == "DRY_BEACH") & (b == "BEACH_WET")) | ((b == "DRY_BEACH") & (a == "BEACH_WET"))
        | m.isin("derivative_magnitude", "derivative_magnitude_relaxed"),
        "water": ((a == "BEACH_WET") & b.isin(*WATERS)) | ((b == "BEACH_WET") & a.isin(*WATERS)),
        "vegetation": ((a == "VEG_DUNES") & b.isin(*beach)) | ((b == "VEG_DUNES") & a.isin(*beach)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in kinds.items()}


def filter_by_type(found: DataFrame, wanted: str) -> DataFrame:
    """``all``, ``shore_only`` or ``waterline``; any other word keeps nothing."""
    kinds = boundary_kinds()
    keep = {"all": F.lit(True), "shore_only": kinds["shore"], "waterline": kinds["shore"] | kinds["water"]}
    return found.where(keep.get(wanted, F.lit(False)))


def detect(features: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All detections before merging, with detection_mode of the dry/wet one."""
    candidates = drop_candidates(features, config)
    best = best_dry_wet(dry_wet_strict(candidates, config), dry_wet_relaxed(candidates, config), config)
    rest = vegetation_inflection(features).unionByName(surf_foam(features))
    return rest.withColumn("detection_mode", F.lit(None).cast("string")).unionByName(best)


def find_transitions(classed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From a table of features with classes to filtered boundaries of all kinds."""
    merged = merge_nearby(detect(classed, config), config)
    return quality_filter(add_class_info(merged, classed), classed, config)


def with_transition_flag(classed: DataFrame, found: DataFrame) -> DataFrame:
    flags = found.select(KEY, F.col("index").alias("i")).distinct().withColumn("transition_flag", F.lit(True))
    return classed.join(flags, [KEY, "i"], "left").withColumn("transition_flag", F.coalesce("transition_flag", F.lit(False)))
