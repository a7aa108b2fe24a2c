"""Lines and raster tiles: densify, prune, sample.

Lines: transect_id, points array<struct<x,y>>.  Tiles: raster_id, priority, left, top,
res, width, height, nodata.  Pixels: raster_id, row, col and four bands.  Spatial joins
are equi-joins on coarse grid cells, so neither side has to be small.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.tables import settle, spread
from . import projections as P

KEY = "transect_id"


def directions(lines: DataFrame) -> DataFrame:
    first, last = F.col("points")[0], F.element_at("points", -1)
    return lines.select(KEY, F.when(first["x"] < last["x"], "west_to_east").otherwise("east_to_west").alias("direction"))


def global_direction(lines: DataFrame) -> DataFrame:
    """The direction of the first transect, which holds for all."""
    return directions(lines).agg(F.min_by("direction", KEY).alias("direction"))


def segments(lines: DataFrame) -> DataFrame:
    """seg, both ends, and the length of line before the segment (start) and after it (stop)."""
    pairs = F.arrays_zip(
        F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b")
    )
    s = lines.where("size(points) > 1").select(KEY, F.posexplode(pairs).alias("seg", "p")).select(
        KEY, "seg", F.col("p.a.x").alias("x0"), F.col("p.a.y").alias("y0"), F.col("p.b.x").alias("x1"), F.col("p.b.y").alias("y1")
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = s.withColumn("length", F.sqrt(dx * dx + dy * dy))
    stop = F.sum("length").over(Window.partitionBy(KEY).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("length"))


def densify(lines: DataFrame, interval: float = 1.0) -> DataFrame:
    """Points at 0, interval, 2 interval ... and at the end of each line: distance, x, y, and
    ord, which ascends along the line.  Every segment makes its own points, so no line is
    gathered."""
    s = segments(spread(lines, "lines", KEY)).where("length > 0")
    line = Window.partitionBy(KEY)
    s = s.withColumns({"total": F.max("stop").over(line), "last_seg": F.max("seg").over(line)})
    first, after = F.ceil(F.col("start") / interval), F.ceil(F.col("stop") / interval)
    own = F.when(after > first, F.transform(F.sequence(first, after - 1), lambda k: k * F.lit(float(interval)))).otherwise(F.array().cast("array<double>"))
    ends = F.when(F.col("seg") == F.col("last_seg"), F.array("total")).otherwise(F.array().cast("array<double>"))
    rows = s.select("*", F.posexplode(F.concat(own, ends)).alias("_k", "distance"))
    t = (F.col("distance") - F.col("start")) / F.col("length")
    return rows.select(
        KEY, "distance", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"),
        (F.shiftleft(F.col("seg").cast("long"), 32) + F.col("_k")).alias("ord"),
    ).dropDuplicates([KEY, "distance"])


def tile_bounds(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns({"right": F.col("left") + F.col("width") * F.col("res"), "bottom": F.col("top") - F.col("height") * F.col("res")})


def _cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, cell: float) -> DataFrame:
    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))

    return df.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def _sorted(df: DataFrame) -> DataFrame:
    """Rows made by explode count as few in Spark's estimate: joined by sorting, whatever it
    says, so that no table of tiles or pixels is sent whole through the driver."""
    return df.hint("merge")


def _crosses() -> Column:
    """Liang-Barsky: does the segment (x0, y0)-(x1, y1) meet the box?"""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for d, near, far in ((dx, F.col("left") - F.col("x0"), F.col("right") - F.col("x0")), (dy, F.col("bottom") - F.col("y0"), F.col("top") - F.col("y0"))):
        a, b = near / F.when(d != 0, d), far / F.when(d != 0, d)
        low = F.greatest(low, F.coalesce(F.least(a, b), F.lit(0.0)))
        high = F.least(high, F.coalesce(F.greatest(a, b), F.lit(1.0)))
        ok = ok & ((d != 0) | ((near <= 0) & (far >= 0)))
    return ok & (low <= high)


def overlapping_tiles(lines: DataFrame, tiles: DataFrame, cell: float = 1000.0) -> DataFrame:
    """(transect_id, raster_id, priority) of every tile that a line meets."""
    s = _cells(segments(lines), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), cell)
    b = tile_bounds(tiles)
    b = _cells(b, F.col("left"), F.col("right"), F.col("bottom"), F.col("top"), cell)
    return s.join(_sorted(b), ["_cx", "_cy"]).where(_crosses()).select(KEY, "raster_id", "priority").distinct()


def _sampled(points: DataFrame, tiles: DataFrame, pixels, cell: float) -> tuple[DataFrame, DataFrame | None]:
    """Samples of points, and the pixels that could not be read, if ``pixels`` says so."""
    p = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    b = tile_bounds(tiles)
    b = _cells(b, F.col("left"), F.col("right"), F.col("bottom"), F.col("top"), cell)
    hit = p.join(_sorted(b), ["_cx", "_cy"]).where("x between left and right and y between bottom and top")
    hit = hit.withColumns({"row": F.floor((F.col("top") - F.col("y")) / F.col("res")), "col": F.floor((F.col("x") - F.col("left")) / F.col("res"))})
    hit = hit.where("row >= 0 and row < height and col >= 0 and col < width")
    unread = None
    if callable(pixels):
        hit = settle(hit.select(*points.columns, "raster_id", "priority", "nodata", "row", "col"), "wanted")
        pixels = settle(pixels(hit), "pixels")
        if "problem" in pixels.columns:
            unread = hit.join(_sorted(pixels.where("problem is not null")), ["raster_id", "row", "col"])
            pixels = pixels.where("problem is null").drop("problem")
    found = hit.join(_sorted(pixels), ["raster_id", "row", "col"]).where(
        "nodata is null or (red <> nodata and green <> nodata and blue <> nodata and nir <> nodata)"
    )
    first = Window.partitionBy(KEY, "distance").orderBy("priority", "raster_id")
    found = found.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return found.select(*points.columns, "red", "green", "blue", "nir"), unread


def sample_points(points: DataFrame, tiles: DataFrame, pixels, cell: float = 1000.0) -> DataFrame:
    """The nearest pixel of the first tile, by priority, that holds the point and none of
    whose bands is nodata; points without any are left out.  ``pixels`` is a table, or a
    function that finds the wanted ones of (raster_id, row, col)."""
    return _sampled(points, tiles, pixels, cell)[0]


def sample_lines(
    lines: DataFrame, tiles: DataFrame, pixels, direction: str | None = None, interval: float = 1.0, cell: float = 1000.0
) -> tuple[DataFrame, DataFrame]:
    """Samples along every line, with ord, which ascends with their distance; and the
    problems (transect_id, reason) of blocks that can't be read and of lines without any
    sample.  From east to west, distance counts from the far end of the line's full length."""
    got, unread = _sampled(densify(lines, interval), tiles, pixels, cell)
    if direction is None:
        direction = (global_direction(lines).first() or {"direction": "west_to_east"})["direction"]
    if direction == "east_to_west":
        total = segments(lines).groupBy(KEY).agg(F.max("stop").alias("_total"))
        got = got.join(_sorted(total), KEY).withColumns({"distance": F.col("_total") - F.col("distance"), "ord": -F.col("ord")}).drop("_total")
    got = got.select(KEY, "distance", "red", "green", "blue", "nir", "ord")
    problems = lines.select(KEY).join(got.select(KEY).distinct(), KEY, "left_anti").select(KEY, F.lit("no pixel under the line").alias("reason"))
    if unread is not None:
        problems = problems.unionByName(unread.groupBy(KEY, F.col("problem").alias("reason")).count().select(KEY, F.concat("reason", F.lit(" ("), "count", F.lit(" samples)")).alias("reason")))
    return got, problems


def sample_transects(lines: DataFrame, tiles: DataFrame, pixels, direction: str | None = None, interval: float = 1.0) -> DataFrame:
    """The samples of ``sample_lines``."""
    return sample_lines(lines, tiles, pixels, direction, interval)[0]


def random_transects(lines: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` lines at sorted random positions among the ids: the same ones for one seed."""
    n = lines.count()
    chosen = sorted(random.Random(seed).sample(range(n), min(k, n)))
    ranked = S.running_total(lines, KEY, F.lit(1), "_p")
    picks = lines.sparkSession.createDataFrame([(c + 1,) for c in chosen], "_p long")
    return ranked.join(F.broadcast(picks), "_p").drop("_p")  # at most k rows


def evenly_spaced(results: DataFrame, k: int = 5) -> DataFrame:
    """At most ``k`` transects at even positions, both ends among them."""
    ids = results.select(KEY).distinct()
    n = ids.count()
    at = sorted({j * (n - 1) // max(k - 1, 1) + 1 for j in range(k)}) if n > k else None
    ranked = S.running_total(ids, KEY, F.lit(1), "_p")
    return (ranked.where(F.col("_p").isin(at)) if at else ranked).select(KEY)


def to_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """WGS 84 degrees to UTM metres."""
    return P.TransverseMercator(zone * 6 - 183.0, north=0.0 if north else 10_000_000.0, on=P.WGS84).forward(lon, lat)


reproject = P.reproject
