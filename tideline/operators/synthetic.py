"""Made-up transects that follow the statistics of real classes, and how near they come.

Every normal draw is a function of the seed, the transect, the band and the distance alone
(Box and Muller's rule on two uniform numbers out of a digest), so the rows are the same
however they are dealt to tasks, and any part of them can be made by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import spread

BANDS = ("red", "green", "blue", "nir")
#: Zones of a made-up transect: class, first metre, metre behind the last.
ZONES = (("VEG_DUNES", 0, 55), ("BEACH_DRY", 55, 105), ("BEACH_WET", 105, 120), ("WATER", 120, 300))
#: Names under which a class may stand in the statistics.
NAMES = {"VEGETATED_DUNE": "VEG_DUNES", "VEGETATED_DUNES": "VEG_DUNES"}
#: Where dry turns to wet, how far the transition reaches, width to sigma.
SHELL_LINE, REACH, SIGMAS = 105.0, 115.0, 2.5
SMOOTHING = 5


def uniform(*names) -> tuple[Column, Column]:
    """Two uniform numbers, above 0 and below 1, that depend on the values named alone."""
    digest = F.md5(F.concat_ws(":", *[n.cast("string") if isinstance(n, Column) else F.lit(str(n)) for n in names]))
    return tuple((F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("double") + 0.5) / float(1 << 48) for k in range(2))


def normal(*names) -> Column:
    a, b = uniform(*names)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def class_rows(stats: DataFrame) -> DataFrame:
    """A row a class: mean and deviation of each band, averaged over a class's names."""
    name = F.col("class")
    for other, own in NAMES.items():
        name = F.when(F.col("class") == other, own).otherwise(name)
    pick = {f"{b}_{v}": F.avg(F.when(F.col("feature") == b, F.col(v))) for b in BANDS for v in ("mean", "std")}
    return stats.groupBy(name.alias("zone_class")).agg(*[c.alias(k) for k, c in pick.items()])


def synthetic_spectra(ids: DataFrame, stats: DataFrame, seed: int = 42, zones=ZONES, shell: tuple[float, float, float] | None = None) -> DataFrame:
    """transect_id, distance, zone_class, four bands and brightness, a metre apart, for each of
    ``ids``.  ``stats`` has class, feature, mean and std, as ``class_statistics`` gives them;
    zones of a class without them are left out.  Bands are drawn alone, smoothed by a moving
    mean within the zone (beyond its ends there is nothing) and kept between 0 and 255;
    ``shell`` (drop of nir, drop of brightness, width) is what goes off behind the shell line."""
    metres = F.array(*[F.struct(F.lit(c).alias("zone_class"), F.sequence(F.lit(a), F.lit(b - 1)).alias("at")) for c, a, b in zones])
    ids = spread(ids.select("transect_id"), "ids", "transect_id")
    rows = ids.select("transect_id", F.explode(metres).alias("z")).select("transect_id", "z.zone_class", F.explode("z.at").alias("m"))
    rows = rows.join(F.broadcast(class_rows(stats)), "zone_class")  # a row a class
    rows = rows.select("transect_id", "zone_class", F.col("m").cast("double").alias("distance"), *[(F.col(f"{b}_mean") + F.col(f"{b}_std") * normal(seed, F.col("transect_id"), b, F.col("m"))).alias(b) for b in BANDS])
    around = Window.partitionBy("transect_id", "zone_class").orderBy("distance").rowsBetween(-(SMOOTHING // 2), SMOOTHING // 2)
    rows = rows.withColumns({b: F.least(F.greatest(F.sum(b).over(around) / SMOOTHING, F.lit(0.0)), F.lit(255.0)) for b in BANDS})
    rows = rows.withColumn("brightness", (F.col("red") + F.col("green") + F.col("blue") + F.col("nir")) / 4)
    if shell:
        nir, brightness, width = (float(v) for v in shell)
        part = F.when((F.col("distance") >= SHELL_LINE) & (F.col("distance") < REACH), 0.5 * (1 + F.tanh((F.col("distance") - SHELL_LINE) / (width / SIGMAS)))).otherwise(0.0)
        rows = rows.withColumns({"nir": F.col("nir") - nir * part, "brightness": F.col("brightness") - brightness * part})
    return rows.select("transect_id", "distance", "zone_class", *BANDS, "brightness")


def compare_spectra(made: DataFrame, stats: DataFrame) -> DataFrame:
    """Per class and band: mean and deviation of made-up and of real spectra, and how far
    the means lie apart in real deviations (null where there is none)."""
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in BANDS])).alias("s")
    own = made.select("zone_class", cells).groupBy("zone_class", F.col("s.band").alias("band")).agg(F.avg("s.v").alias("made_mean"), F.stddev_pop("s.v").alias("made_std"))
    real = class_rows(stats)
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_mean").alias("real_mean"), F.col(f"{b}_std").alias("real_std")) for b in BANDS])).alias("s")
    both = own.join(F.broadcast(real.select("zone_class", cells).select("zone_class", "s.*")), ["zone_class", "band"])  # a row a class and band
    return both.withColumn("apart", F.try_divide(F.col("made_mean") - F.col("real_mean"), F.nullif("real_std", F.lit(0.0))))
