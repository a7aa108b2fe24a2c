"""Land-cover classes: rules, smoothing, segments, order along the shore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from .config import CLASSES, DEFAULT, Config

#: Order of the classes from land to sea; both water classes share one.
ORDER = {"VEG_DUNES": 0, "DRY_BEACH": 1, "BEACH_WET": 2, "WATER": 3, "WAVE_CRESTS": 3}
#: Classes that may lie side by side.
NEIGHBOURS = (
    ("VEG_DUNES", "DRY_BEACH"), ("DRY_BEACH", "BEACH_WET"), ("BEACH_WET", "WATER"),
    ("BEACH_WET", "WAVE_CRESTS"), ("WATER", "WAVE_CRESTS"),
)


def _plus(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def classify(features: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds predicted_class and confidence by the first rule that holds."""
    nr, ndwi, br, b, v, osc = (
        F.col(c) for c in ("nir_ratio", "ndwi", "blue_red_ratio", "brightness", "variability", "has_oscillations")
    )
    v_low, v_high = F.coalesce(v <= config.dry_variability_max, F.lit(False)), F.coalesce(v >= config.veg_variability_min, F.lit(False))
    water = (nr <= config.nir_ratio_water_max) & (
        (ndwi > config.ndwi_water_min) | (br > config.blue_red_water_min) | (nr < config.nir_ratio_water_sure)
    )
    wet = (nr > config.nir_ratio_wet_min) & (nr < config.nir_ratio_wet_max) & (ndwi >= config.ndwi_wet_min) & (b <= config.wet_brightness_max)
    dry = (nr >= config.nir_ratio_dry_min) & (b >= config.dry_brightness_min) & v_low
    veg = (nr >= config.nir_ratio_dry_min) & v_high & (b <= config.veg_brightness_max)
    crest = (nr < config.nir_ratio_water_max) & F.coalesce(v > 20, F.lit(False)) & osc
    c_water = 0.85 + _plus(ndwi > config.ndwi_water_min, 0.05) + _plus(br > config.blue_red_water_min, 0.05) + _plus(nr < 0.25, 0.05)
    c_wet = 0.70 + _plus(ndwi > 0.35, 0.10) - _plus((nr < 0.45) | (nr > 0.65), 0.10)
    c_dry = 0.80 + _plus(b > 205, 0.05) + _plus(F.coalesce(v < 5, F.lit(False)), 0.05)
    c_veg = 0.70 + _plus(F.coalesce(v > 25, F.lit(False)), 0.10) + _plus(osc, 0.05)
    name = (
        F.when(water, "WATER").when(wet, "BEACH_WET").when(dry, "DRY_BEACH").when(veg, "VEG_DUNES").when(crest, "WAVE_CRESTS").otherwise("UNKNOWN")
    )
    confidence = (
        F.when(water, F.least(c_water, F.lit(0.95)))
        .when(wet, F.least(F.greatest(c_wet, F.lit(0.60)), F.lit(0.85)))
        .when(dry, F.least(c_dry, F.lit(0.90)))
        .when(veg, F.least(c_veg, F.lit(0.85)))
        .when(crest, 0.65)
        .otherwise(0.30)
    )
    return features.withColumns({"predicted_class": name, "confidence": confidence})


def code(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(CLASSES.index("UNKNOWN"))
    for k, name in enumerate(CLASSES):
        out = F.when(c == name, k).otherwise(out)
    return out


def smooth_classes(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Median of three on the class codes; the confidence stays as it was."""
    middle = S.median3(code("predicted_class"), S.series(key))
    return classed.withColumn("predicted_class", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), middle + 1))


def with_runs(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Adds run, numbering the maximal stretches of one class along each transect."""
    w = S.series(key)
    return classed.withColumn("_new", S.changed("predicted_class", w)).withColumn("run", S.run_number("_new", w)).drop("_new")


def segments(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """A row for each stretch: class, first and last distance, span, points."""
    return (
        with_runs(classed, key)
        .groupBy(key, "run")
        .agg(
            F.first("predicted_class").alias("predicted_class"),
            F.min("distance").alias("start"),
            F.max("distance").alias("end"),
            F.count(F.lit(1)).alias("points"),
            F.avg("distance").alias("centroid"),
        )
        .withColumn("span", F.col("end") - F.col("start"))
    )


def _no_higher_before(first: dict[str, Column], c: str) -> Column:
    """No class of higher order comes before class ``c`` does for the first time."""
    out = F.lit(True)
    for other, at in first.items():
        if ORDER[other] > ORDER[c]:
            out = out & F.coalesce(at > first[c], F.lit(True))
    return out


def monotonic_relaxed(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Each class once, in shore order.  A class is taken where it comes first, unless one
    further out came before; its later points become UNKNOWN.  A class that is never taken
    is renamed to the class of the furthest order so far.  Rows keep their number, also
    where distances repeat."""
    w, names = S.series(key), F.array(*[F.lit(c) for c in ("VEG_DUNES", "DRY_BEACH", "BEACH_WET", "WATER")])
    given, rows = classed.columns, S.indexed(classed, w)
    c, place = F.col("predicted_class"), F.lit(None).cast("int")
    for name, order in ORDER.items():
        place = F.when(c == name, order).otherwise(place)
    rows = rows.withColumns(
        {"_top": F.max(place).over(w.rowsBetween(Window.unboundedPreceding, -1))}
        | {f"_{x}": F.min(F.when(c == x, F.col("i"))).over(S.whole(w)) for x in ORDER}
    )
    first = {x: F.col(f"_{x}") for x in ORDER}
    label = F.lit("UNKNOWN")
    for x in ORDER:
        taken = F.when(F.col("i") == first[x], x).otherwise("UNKNOWN")
        label = F.when(c == x, F.when(_no_higher_before(first, x), taken).otherwise(F.element_at(names, F.col("_top") + 1))).otherwise(label)
    return rows.withColumn("predicted_class", label).select(*given)


def monotonic_strict(classed: DataFrame, config: Config = DEFAULT, key: str = "transect_id") -> DataFrame:
    """Only zones of at least ``min_span``, each class once and never going back: a zone is
    kept if no zone of its class and none of higher order was kept before; the rest is
    UNKNOWN.  Labels are written out in full."""
    w, c = S.series(key), F.col("predicted_class")
    zone = Window.partitionBy(key, "run")
    runs = with_runs(classed, key).withColumn("_span", F.max("distance").over(zone) - F.min("distance").over(zone))
    long = (c != "UNKNOWN") & (F.col("_span") >= config.min_span)
    runs = runs.withColumns({f"_{x}": F.min(F.when(long & (c == x), F.col("run"))).over(S.whole(w)) for x in ORDER})
    first = {x: F.col(f"_{x}") for x in ORDER}
    label = F.lit("UNKNOWN")
    for x in ORDER:
        label = F.when((c == x) & (F.col("run") == first[x]) & _no_higher_before(first, x), x).otherwise(label)
    return runs.withColumn("predicted_class", label).select(*classed.columns)


def merge_short_segments(classed: DataFrame, config: Config = DEFAULT, rounds: int = 10, key: str = "transect_id") -> DataFrame:
    """Up to ``rounds`` times, the first short segment of a known class takes the class of
    the next segment, of the one before, or UNKNOWN: whichever is known first.  A fold over
    the segments of a transect; segments of one class that meet become one."""
    numbered = with_runs(classed, key)
    zone = F.struct(F.col("run").cast("long").alias("first"), F.col("run").cast("long").alias("last"), F.col("predicted_class").alias("c"), F.col("start").alias("a"), F.col("end").alias("b"))
    zones = segments(classed, key).groupBy(key).agg(F.array_sort(F.collect_list(zone)).alias("zones"))

    def joined(zones: Column) -> Column:
        def step(done: Column, z: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            longer = F.struct(last["first"].alias("first"), z["last"].alias("last"), last["c"].alias("c"), last["a"].alias("a"), z["b"].alias("b"))
            return F.when(last["c"] == z["c"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(z)))

        return F.aggregate(zones, F.slice(zones, 1, 0), step)

    def once(state: Column, _: Column) -> Column:
        short = F.filter(F.transform(state, lambda z, k: F.when((z["c"] != "UNKNOWN") & (z["b"] - z["a"] < config.min_span), k)), lambda k: k.isNotNull())
        at = F.get(short, F.lit(0))
        after, before = F.get(state, at + 1)["c"], F.when(at > 0, F.get(state, at - 1)["c"])
        new = F.coalesce(F.when(after != "UNKNOWN", after), before, F.lit("UNKNOWN"))
        renamed = F.transform(state, lambda z, k: F.struct(z["first"].alias("first"), z["last"].alias("last"), F.when(k == at, new).otherwise(z["c"]).alias("c"), z["a"].alias("a"), z["b"].alias("b")))
        return F.when(at.isNull(), state).otherwise(joined(renamed))

    merged = zones.select(key, F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("zones"), once)).alias("z"))
    merged = merged.select(key, F.explode(F.sequence("z.first", "z.last")).alias("run"), F.col("z.c").alias("_class"))
    out = numbered.withColumn("run", F.col("run").cast("long")).join(merged, [key, "run"])
    return out.withColumn("predicted_class", F.col("_class")).select(*classed.columns)


def vote_by_zone(classed: DataFrame, flag: str, key: str = "transect_id") -> DataFrame:
    """Zones between flagged points take their most frequent known class (ties: the one
    met first); zones without a known class stay as they are."""
    w = S.series(key)
    zoned = classed.withColumn("zone", F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    votes = (
        zoned.where("predicted_class <> 'UNKNOWN'")
        .groupBy(key, "zone", "predicted_class")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("distance").alias("met"))
    )
    best = Window.partitionBy(key, "zone").orderBy(F.desc("votes"), "met")
    winner = votes.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, "zone", F.col("predicted_class").alias("_won"))
    return zoned.join(winner, [key, "zone"], "left").withColumn("predicted_class", F.coalesce("_won", "predicted_class")).drop("_won")


def sequence_violations(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Neighbouring points of known classes that may not touch, and single points unlike
    both neighbours."""
    w = S.series(key)
    allowed = F.lit(False)
    for a, b in NEIGHBOURS:
        for x, y in ((a, b), (b, a)):
            allowed = allowed | ((F.col("before") == x) & (F.col("predicted_class") == y))
    known = (F.col("before") != "UNKNOWN") & (F.col("predicted_class") != "UNKNOWN")
    jump = known & (F.col("before") != F.col("predicted_class")) & ~allowed
    alone = (F.col("before") != F.col("predicted_class")) & (F.col("after") != F.col("predicted_class"))
    return (
        classed.withColumns({"before": F.lag("predicted_class").over(w), "after": F.lead("predicted_class").over(w)})
        .withColumns({"jump": F.coalesce(jump, F.lit(False)), "alone": F.coalesce(alone, F.lit(False))})
        .where("jump or alone")
        .select(key, "distance", "before", "predicted_class", "after", "jump", "alone")
    )


def context_is_clear(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Adds clear: at most two classes within three points on either side."""
    return classed.withColumn("clear", F.size(F.collect_set("predicted_class").over(S.series(key).rowsBetween(-3, 3))) <= 2)


def class_distribution(classed: DataFrame, key: str = "transect_id") -> DataFrame:
    """Points of each class for each transect and, with a null transect, over all."""
    return (
        classed.groupingSets([[key, "predicted_class"], ["predicted_class"]], key, "predicted_class").agg(F.count(F.lit(1)).alias("points"))
    )
