"""The sample, label and tile tables that queries run on, made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import spread

LENGTH = 300


def spectral_points(spark: SparkSession, sf_dir: str, irregular: bool = False) -> DataFrame:
    """transect_id, distance and four integer bands: dunes, dry and wet beach, water."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    p = e.select(
        "event_id",
        F.expr(f"event_id div {LENGTH}").alias("transect_id"),
        (F.col("event_id") % LENGTH).alias("x"),
        ((F.floor("value") % 7) - 3).alias("j"),
        ((F.col("event_id") % 5) - 2).alias("k"),
    )
    t = F.col("transect_id")
    p = p.withColumns({"e1": 50 + t % 7, "e2": 95 + (3 * t) % 17}).withColumn("e3", F.col("e2") + 15 + t % 4)
    p = p.withColumn("s", F.col("x") - F.col("e2"))
    x, j, k, s = (F.col(c) for c in "xjks")
    zones = (
        (x < F.col("e1"), (165 + 10 * j + 3 * k, 156 + 10 * j, 136 + 10 * j, 132 + 9 * j)),
        (x < F.col("e2"), (219 + j, 218 + j, 212 + j, 184 + j)),
        (x < F.col("e3"), (195 + 3 * j - 2 * s, 188 + 3 * j - 2 * s, 166 + 3 * j - 2 * s, 132 + 4 * j - 5 * s)),
        (F.lit(True), (124 + 9 * j + 6 * k, 148 + 9 * j, 128 + 9 * j + 4 * k, F.when(x % 37 < 2, 55 + 3 * j).otherwise(23 + 3 * j))),
    )
    bands = {}
    for b, name in enumerate(("red", "green", "blue", "nir")):
        value = None
        for condition, values in zones:
            value = F.when(condition, values[b]) if value is None else value.when(condition, values[b])
        bands[name] = F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int")
    distance = x + (F.col("event_id") * 7 % 10) / 100.0 if irregular else x.cast("double")
    return p.select("transect_id", distance.cast("double").alias("distance"), *[v.alias(c) for c, v in bands.items()])


def manual_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transect_id, zone_order, start, end, zone_class: labels with a known bias."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(f"event_id div {LENGTH}").alias("transect_id"), (F.col("event_id") % LENGTH).alias("x"))
    t = F.col("transect_id")
    one = e.groupBy("transect_id").agg(F.max("x").alias("last")).withColumns({"e1": 50 + t % 7, "e2": 95 + (3 * t) % 17})
    shift = t % 9 - 4 + F.when(t % 8 == 0, 12).otherwise(0)
    one = one.withColumns({"e3": F.col("e2") + 15 + t % 4, "b": shift})
    edges = [F.lit(0), F.col("e1") + F.col("b"), F.col("e2") + F.col("b"), F.col("e3") + F.col("b"), F.col("last")]
    names = ("VEGETATED_DUNES", "BEACH_DRY", "BEACH_WET", "WATER")
    zones = F.array(
        *[
            F.struct(
                F.lit(z).alias("zone_order"),
                F.least(edges[z], F.col("last")).cast("double").alias("start"),
                F.least(edges[z + 1], F.col("last")).cast("double").alias("end"),
                F.lit(c).alias("zone_class"),
            )
            for z, c in enumerate(names)
        ]
    )
    return one.select("transect_id", F.explode(zones).alias("z")).select("transect_id", "z.*").where("end > start")


POINTS_SQL = f"""
raw AS (
  SELECT event_id, event_id // {LENGTH} AS transect_id, event_id % {LENGTH} AS x,
         CAST(floor(value) AS BIGINT) % 7 - 3 AS j, event_id % 5 - 2 AS k FROM events
), edged AS (
  SELECT *, 50 + transect_id % 7 AS e1, 95 + (3 * transect_id) % 17 AS e2,
         95 + (3 * transect_id) % 17 + 15 + transect_id % 4 AS e3 FROM raw
), placed AS (SELECT *, x - e2 AS s FROM edged),
points AS (
  SELECT transect_id, @distance AS distance,
    CAST(least(greatest(CASE WHEN x < e1 THEN 165+10*j+3*k WHEN x < e2 THEN 219+j WHEN x < e3 THEN 195+3*j-2*s ELSE 124+9*j+6*k END, 0), 255) AS INTEGER) AS red,
    CAST(least(greatest(CASE WHEN x < e1 THEN 156+10*j WHEN x < e2 THEN 218+j WHEN x < e3 THEN 188+3*j-2*s ELSE 148+9*j END, 0), 255) AS INTEGER) AS green,
    CAST(least(greatest(CASE WHEN x < e1 THEN 136+10*j WHEN x < e2 THEN 212+j WHEN x < e3 THEN 166+3*j-2*s ELSE 128+9*j+4*k END, 0), 255) AS INTEGER) AS blue,
    CAST(least(greatest(CASE WHEN x < e1 THEN 132+9*j WHEN x < e2 THEN 184+j WHEN x < e3 THEN 132+4*j-5*s
                             WHEN x % 37 < 2 THEN 55+3*j ELSE 23+3*j END, 0), 255) AS INTEGER) AS nir
  FROM placed
)"""
REGULAR = POINTS_SQL.replace("@distance", "CAST(x AS DOUBLE)")
IRREGULAR = POINTS_SQL.replace("@distance", "CAST(x + (event_id * 7 % 10) / 100.0 AS DOUBLE)")

ZONES_SQL = f"""
zone_base AS (
  SELECT event_id // {LENGTH} AS transect_id, max(event_id % {LENGTH}) AS last FROM events GROUP BY 1
), zone_edges AS (
  SELECT transect_id, last, 50 + transect_id % 7 AS e1, 95 + (3 * transect_id) % 17 AS e2,
         95 + (3 * transect_id) % 17 + 15 + transect_id % 4 AS e3,
         transect_id % 9 - 4 + CASE WHEN transect_id % 8 = 0 THEN 12 ELSE 0 END AS b FROM zone_base
), zones AS (
  SELECT transect_id, zone_order, CAST(least(lo, last) AS DOUBLE) AS zstart, CAST(least(hi, last) AS DOUBLE) AS zend, zone_class
  FROM (
    SELECT transect_id, last, 0 AS zone_order, 0 AS lo, e1 + b AS hi, 'VEGETATED_DUNES' AS zone_class FROM zone_edges
    UNION ALL SELECT transect_id, last, 1, e1 + b, e2 + b, 'BEACH_DRY' FROM zone_edges
    UNION ALL SELECT transect_id, last, 2, e2 + b, e3 + b, 'BEACH_WET' FROM zone_edges
    UNION ALL SELECT transect_id, last, 3, e3 + b, last, 'WATER' FROM zone_edges
  ) WHERE least(hi, last) > least(lo, last)
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each transect: straight for every third, else with a bend and running west."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(f"event_id div {LENGTH}").alias("transect_id")).distinct()
    t = spread(t, "ids", "transect_id")  # filters on the points stay behind this scan, not on every event
    y = F.col("transect_id") * 10.0

    def points(*xy):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), (y + float(dy)).alias("y")) for x, dy in xy])

    straight, bent = points((0, 0), (30, 40)), points((40, 0), (10, 40), (10, 45.5))
    return t.select("transect_id", F.when(F.col("transect_id") % 3 == 0, straight).otherwise(bent).alias("points"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 50 x 100 m over the lines, one above the other and overlapping by a row."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.expr(f"max(event_id div {LENGTH}) div 10 + 1").alias("m"))
    k = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("raster_id"))
    return k.select(
        "raster_id", F.col("raster_id").alias("priority"), F.lit(0.0).alias("left"), (F.col("raster_id") * 100 + 100.0).alias("top"), F.lit(1.0).alias("res"),
        F.lit(50).alias("width"), F.lit(101).alias("height"), F.lit(0).alias("nodata"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(tiles(spark, sf_dir).select("raster_id"), "tiles", "raster_id", 50)  # 5,050 pixels each
    p = p.select("raster_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("row"))
    p = p.select("raster_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("col"))
    v = F.col("row") * 7 + F.col("col") * 3 + F.col("raster_id")
    return p.select("raster_id", "row", "col", *[((v * m) % 251).cast("int").alias(b) for b, m in (("red", 1), ("green", 2), ("blue", 3), ("nir", 5))])


LINES_SQL = f"""
ids AS (SELECT DISTINCT event_id // {LENGTH} AS transect_id FROM events),
vertex AS (
  SELECT transect_id, k, x, transect_id * 10.0::DOUBLE + dy AS y FROM ids JOIN (VALUES (0, 0, 0.0, 0.0), (0, 1, 30.0, 40.0), (1, 0, 40.0, 0.0), (1, 1, 10.0, 40.0), (1, 2, 10.0, 45.5)) v(kind, k, x, dy)
  ON v.kind = (transect_id % 3 <> 0)::INT
), seg0 AS (
  SELECT transect_id, k AS seg, x::DOUBLE AS x0, y::DOUBLE AS y0, lead(x::DOUBLE) OVER (PARTITION BY transect_id ORDER BY k) AS x1, lead(y::DOUBLE) OVER (PARTITION BY transect_id ORDER BY k) AS y1 FROM vertex
), seg1 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM seg0 WHERE x1 IS NOT NULL),
seg AS (SELECT *, sum(length) OVER (PARTITION BY transect_id ORDER BY seg) AS stop, sum(length) OVER (PARTITION BY transect_id) AS total, seg = max(seg) OVER (PARTITION BY transect_id) AS is_last FROM seg1),
dist AS (
  SELECT *, unnest(range(ceil(stop - length)::BIGINT, ceil(stop)::BIGINT))::DOUBLE AS distance FROM seg UNION ALL SELECT *, total FROM seg WHERE is_last
), dense AS (
  SELECT transect_id, distance, x0 + (distance - (stop - length)) / length * (x1 - x0) AS x, y0 + (distance - (stop - length)) / length * (y1 - y0) AS y FROM dist
), tile AS (
  SELECT raster_id, 0.0 AS l, raster_id * 100 + 100.0 AS t, 50.0 AS r, raster_id * 100 - 1.0 AS b
  FROM (SELECT unnest(range(0, (SELECT max(event_id // {LENGTH}) // 10 + 2 FROM events))) AS raster_id)
)"""
