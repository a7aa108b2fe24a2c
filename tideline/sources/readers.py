"""Readers.  All parse with column expressions but those of rasters, which decode a block
at a time (``tiff``)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import settle
from ..operators.projections import epsg
from .tiff import BANDS_OUT, Tiff, TiffSource, by_ranges, held, opened

SAMPLES = "TransectID long, distance double, red int, green int, blue int, nir int"


def samples_csv(spark: SparkSession, path, numbered: bool = False) -> DataFrame:
    """Samples; with ``numbered`` also ord, which ascends with the lines of a file."""
    out = spark.read.csv(path, schema=SAMPLES, header=True).withColumnRenamed("TransectID", "transect_id")
    return out.withColumn("ord", F.monotonically_increasing_id()) if numbered else out


def samples_by_priority(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of several sample files, each transect comes from the first that has it."""
    parts = [samples_csv(spark, p).withColumn("_p", F.lit(k)) for k, p in enumerate(paths)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    least = F.min("_p").over(Window.partitionBy("transect_id"))
    return both.withColumn("_m", least).where("_p = _m").drop("_p", "_m")


def tagged(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Sample files one after the other, with the seed that each belongs to."""
    out = None
    for seed, p in paths.items():
        part = samples_csv(spark, p).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def parse_zones(lines: DataFrame, column: str = "value") -> DataFrame:
    """Manual zones from lines ``transect,start,end,CLASS`` with an optional tail: an
    unquoted list ``[a, b]``, ``NA`` or nothing.  Lines that don't begin with a number are
    dropped."""
    v = F.trim(F.col(column))
    head = r"^\s*(-?\d+)\s*,\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*,(.*)$"
    rest = F.regexp_extract(v, head, 4)
    with_list = rest.contains("[")
    before = F.regexp_replace(F.split(rest, r"\[")[0], r"[,\s]+$", "")
    tail = F.regexp_extract(rest, r"\[([^\]]*)\]?", 1)
    name = F.when(with_list, before).when(rest.contains(","), F.regexp_replace(rest, r",[^,]*$", "")).otherwise(rest)
    numbers = F.filter(F.transform(F.split(tail, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    order = F.row_number().over(Window.partitionBy("transect_id").orderBy("start", "end")) - 1
    return (
        lines.where(v.rlike(head))
        .select(
            F.regexp_extract(v, head, 1).cast("long").alias("transect_id"),
            F.regexp_extract(v, head, 2).cast("double").alias("start"),
            F.regexp_extract(v, head, 3).cast("double").alias("end"),
            F.trim(name).alias("zone_class"),
            F.when(with_list, numbers).alias("wave_crests"),
        )
        .withColumn("zone_order", order)
    )


def manual_zones(spark: SparkSession, path) -> DataFrame:
    return parse_zones(spark.read.text(path))


def transect_features(spark: SparkSession, path) -> DataFrame:
    """transect_id, points and problem of every feature of a FeatureCollection: a problem is
    a geometry other than a LineString, an id that is missing or given twice, a line of less
    than two points or with a point that is no pair of numbers."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<TransectID:long>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    f = f.select(F.col("f.properties.TransectID").alias("transect_id"), F.col("f.geometry.type").alias("type"), F.from_json("f.geometry.coordinates", "array<array<double>>").alias("xy"))
    bad = F.exists("xy", lambda p: p.isNull() | (F.size(p) < 2) | F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull())
    twice = F.count(F.lit(1)).over(Window.partitionBy("transect_id")) > 1
    reasons = {
        "no TransectID": F.col("transect_id").isNull(), "a TransectID that stands twice": twice, "not a LineString": ~F.coalesce(F.col("type") == "LineString", F.lit(False)),
        "less than two points": F.coalesce(F.size("xy") < 2, F.lit(True)), "a point that is no pair of numbers": F.coalesce(bad, F.lit(True)),
    }
    problem = F.coalesce(*[F.when(c, F.lit(r)) for r, c in reasons.items()])
    points = F.transform("xy", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return f.withColumn("problem", problem).select("transect_id", F.when(F.col("problem").isNull(), points).alias("points"), "problem")


def transects_geojson(spark: SparkSession, path) -> DataFrame:
    """transect_id and points of a FeatureCollection of LineStrings; a feature with a problem
    is an error when read."""
    f = transect_features(spark, path)
    checked = F.when(F.col("problem").isNull(), F.col("points")).otherwise(F.raise_error(F.concat(F.lit("every feature needs a LineString and a TransectID: "), "problem")))
    return f.select("transect_id", checked.alias("points")).orderBy("transect_id")


def geojson_crs(spark: SparkSession, path) -> str:
    """The coordinate system that a GeoJSON names; without one it is in WGS 84 degrees."""
    stated = spark.read.schema("crs struct<type:string,properties:struct<name:string>>").option("multiLine", True).json(path)
    found = stated.where("crs.properties.name is not null").first()
    code = epsg(found["crs"]["properties"]["name"]) if found else 4326
    return f"EPSG:{code}" if code else found["crs"]["properties"]["name"]


def detections_json(spark: SparkSession, path) -> DataFrame:
    """(transect_id, distance) of the dry/wet boundaries in a detections file."""
    schema = "samples array<struct<transect_id:long,boundary_info:struct<DRY_WET:struct<distance:double>>>>"
    s = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("samples").alias("s"))
    return s.select("s.transect_id", F.col("s.boundary_info.DRY_WET.distance").alias("distance")).where("distance is not null")


# -------------------------------------------------------------------------- logs

#: The line formats of the log.
LOG = {
    "transect": r"\[(\d+)/\d+\] Processing transect (\d+)",
    "selected": r"Selected shell line at ([\d.]+)m?.*?conf(?:idence)?[=: ]+([\d.]+)",
    "mode": r"mode[=: ]+(\w+)",
    "boundaries": r"Detected (\d+) zone boundaries",
    "filtered": r"Filtered (\d+) -> (\d+)",
    "rejected": r"Rejected at ([\d.]+)m: (.*)",
}


def parse_log(lines: DataFrame, column: str = "value", order: str = "line_no") -> DataFrame:
    """A row for each log line, with what it says and the transect it belongs to: the last
    one announced, carried forward over the file.  Where lines have ``part`` (a stretch of the
    file, ascending), stretches are gone over each for itself, and the last announcement of
    each is handed on; so a long file is as many tasks as it has stretches."""
    v = F.col(column)

    def get(name: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(v, LOG[name], group), F.lit(""))

    rows = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    rows = rows.withColumn("_said", get("transect", 2).cast("long"))
    ends = rows.where("_said is not null").groupBy("file", "part").agg(F.max_by("_said", order).alias("_last"))
    parts = rows.groupBy("file", "part").count().join(ends, ["file", "part"], "left")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    handed = parts.select("file", "part", F.last("_last", ignorenulls=True).over(before).alias("_handed"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_lines"))
    last = Window.partitionBy("file", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last("_said", ignorenulls=True).over(last)
    a, b = get("filtered", 1).cast("int"), get("filtered", 2).cast("int")
    rows = rows.withColumns({"_own": own, "_place": F.count(F.lit(1)).over(last) - 1}).join(handed, ["file", "part"])
    return rows.select(
        "file", (F.col("_lines") + F.col("_place")).alias(order), F.coalesce("_own", "_handed").alias("transect_id"), F.col("_said").isNotNull().alias("starts"),
        get("selected", 1).cast("double").alias("selected_at"), get("selected", 2).cast("double").alias("confidence"), get("mode", 1).alias("mode"),
        get("boundaries", 1).cast("int").alias("boundaries"), (a - b).alias("filtered"), get("rejected", 1).cast("double").alias("rejected_at"), get("rejected", 2).alias("reason"),
    )


def read_log(spark: SparkSession, path) -> DataFrame:
    """Lines in file order: the file's name and the number of the line in it.  Files are read
    in splits, each a stretch of lines, whose order is that of its rows."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line_no"), "value"
    )
    return parse_log(settle(lines, "log-lines"))


def log_summary(parsed: DataFrame) -> DataFrame:
    """Per transect: selected position and mode, boundaries, attrition, rejections by reason."""
    reasons = {"nir_drop": "drop", "brightness": "brightness", "variance": "varia", "distance": "distance"}
    has = {f"rejected_{k}": F.sum(F.coalesce(F.lower("reason").contains(w), F.lit(False)).cast("int")) for k, w in reasons.items()}
    return parsed.where("transect_id is not null").groupBy("transect_id").agg(
        F.max("selected_at").alias("selected_at"), F.max("confidence").alias("confidence"), F.first("mode", ignorenulls=True).alias("mode"),
        F.max("boundaries").alias("boundaries"), F.sum("filtered").alias("filtered"), F.count("reason").alias("rejections"), *[v.alias(k) for k, v in has.items()],
    )


def log_report(found: DataFrame) -> DataFrame:
    """Rows (section, name, value) over the transects of ``log_summary``: detection rate,
    share of each mode, confidence, attrition of boundaries, rejections by reason."""
    got = F.col("selected_at").isNotNull()
    conf = F.when(got, F.col("confidence"))
    total, detected, met = F.count(F.lit(1)), F.count("selected_at"), F.coalesce(F.sum("boundaries"), F.lit(0))
    reasons = [c for c in found.columns if c.startswith("rejected_")]
    figures = {
        "overall": {"transects": total, "detected": detected, "failed": total - detected, "detected_pct": F.try_divide(100 * detected, total)},
        "confidence": {"mean": F.avg(conf), "median": F.percentile(conf, 0.5), "std": F.stddev_samp(conf), "min": F.min(conf), "max": F.max(conf)},
        "attrition": {"boundaries": met, "filtered": F.coalesce(F.sum("filtered"), F.lit(0)), "final": detected, "attrition_pct": F.try_divide(100 * (met - detected), met)},
        "rejections": {"total": F.sum("rejections"), "per_transect": F.avg("rejections")} | {c[9:]: F.sum(c) for c in reasons},
    }
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.cast("double").alias("value")) for s, part in figures.items() for n, v in part.items()])
    rows = found.agg(cells.alias("_cells")).select(F.explode("_cells").alias("_c")).select("_c.*")
    modes = found.where(got & F.col("mode").isNotNull()).groupBy("mode").agg(F.count(F.lit(1)).alias("_n"))
    shares = modes.join(F.broadcast(found.agg(detected.alias("_all"))))  # one row
    count = shares.select(F.lit("modes").alias("section"), F.col("mode").alias("name"), F.col("_n").cast("double").alias("value"))
    share = shares.select(F.lit("mode_pct").alias("section"), F.col("mode").alias("name"), (100 * F.col("_n") / F.col("_all")).alias("value"))
    return rows.unionByName(count).unionByName(share)


def lines_with(lines: DataFrame, words: list[str], column: str = "value", top: int | None = None, order: str | None = None) -> DataFrame:
    """Lines that hold any of the words, in any case; with ``top``, so many first ones by
    ``order`` (or by the line itself)."""
    v, hit = F.lower(F.col(column)), F.lit(False)
    for w in words:
        hit = hit | v.contains(w.lower())
    found = lines.where(hit)
    return found if top is None else found.orderBy(order or column).limit(top)


# ----------------------------------------------------------------------- rasters


def _files(spark: SparkSession, folder: str, content: bool) -> DataFrame:
    """The .tif and .tiff files of a folder, not of its subfolders; their bytes only if asked
    for."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.tiff?$"))
    return files.select("path", *(["content"] if content else []))


_META = (
    "path string, left double, top double, res double, width int, height int, bands int, dtype string, crs string, nodata double, block_width int, block_height int, problem string"
)

_meta = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[k]) for n, k in (f.split() for f in _META.split(", "))])


def raster_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each raster of a folder, from its header alone, read where the task runs;
    ``problem`` says why one can't be read.  Where Python can't read the store in part,
    whole files are."""
    ranged = by_ranges(folder)

    def run(batches):
        for batch in batches:
            rows = []
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    found = Tiff(opened(path) if ranged else held(batch.column("content")[k].as_py())).meta()
                except (ValueError, KeyError, IndexError, struct.error, OSError) as gone:
                    found = {"problem": str(gone) or type(gone).__name__}
                rows.append({"path": path} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=_meta)

    out = _files(spark, folder, not ranged).mapInArrow(run, _META)
    rank = F.row_number().over(Window.orderBy("path")) - 1  # one row a file
    return out.withColumn("raster_id", rank.cast("int")).withColumn("priority", F.col("raster_id"))


def raster_meta(spark: SparkSession, folder: str) -> DataFrame:
    """``raster_index`` where every file can be read; else an error."""
    found = raster_index(spark, folder)
    wrong = F.concat(F.col("path"), F.lit(": "), F.col("problem"))
    return found.withColumn("bands", F.when(F.col("problem").isNull(), F.col("bands")).otherwise(F.raise_error(wrong).cast("int"))).drop("problem")


def check_rasters(meta: DataFrame) -> DataFrame:
    """The index again, or an error: no file, no or different systems, not four bands."""
    s = meta.agg(F.count(F.lit(1)).alias("n"), F.count("crs").alias("known"), F.countDistinct("crs").alias("systems"), F.min("bands").alias("a"), F.max("bands").alias("b")).first()
    for wrong, what in ((not s["n"], "no raster was found"), (s["known"] < s["n"], "a raster has no coordinate system"), (s["systems"] > 1, "coordinate systems differ"), (s["n"] and (s["a"], s["b"]) != (4, 4), "every raster needs four bands")):
        if wrong:
            raise ValueError(what)
    return meta


def raster_pixels(spark: SparkSession, folder: str, meta: DataFrame) -> DataFrame:
    """raster_id, row, col and four bands of all pixels, by ranges of blocks."""
    spark.dataSource.register(TiffSource)
    found = spark.read.format(TiffSource.name()).load(folder)
    plain = F.regexp_replace("path", "^file:/+", "/")
    return found.join(meta.select(plain.alias("path"), "raster_id"), "path").select("raster_id", "row", "col", *BANDS_OUT)


_WANTED = f"raster_id int, row long, col long, {', '.join(f'{b} int' for b in BANDS_OUT)}, problem string"


_picked = pa.schema([("raster_id", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), *((b, pa.int32()) for b in BANDS_OUT), ("problem", pa.string())])


def _picker(source):
    """Wanted pixels, sorted by raster and block, to their bands: each block is read once.
    Pixels of a block that can't be read have no bands but a problem."""

    def read(batches):
        path = t = block = x = wrong = None
        for batch in batches:
            at = batch.to_pandas()
            out = np.zeros((4, len(at)), np.int32)
            problem = np.full(len(at), None, object)
            names, blocks = at["path"].to_numpy(), at["block"].to_numpy()
            rows, columns = at["row"].to_numpy(), at["col"].to_numpy()
            new = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1, [len(at)]]) if len(at) else [0]
            for a, b in zip(new[:-1], new[1:]):
                if (names[a], blocks[a]) != (path, block):
                    try:
                        if names[a] != path or t is None:
                            t = None  # while it is not opened
                            t = Tiff(source(names[a]))
                        x, wrong = t.block(int(blocks[a])), None
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error, OSError) as gone:
                        x, wrong = None, f"{names[a]}: {str(gone) or type(gone).__name__}"
                    path, block = names[a], blocks[a]
                if x is None:
                    problem[a:b] = wrong
                else:
                    out[:, a:b] = x[:4, rows[a:b] % t.block_height, columns[a:b] % t.block_width]
            lost = pa.array(problem, pa.string())
            bands = [pa.array(v, pa.int32(), mask=np.array([p is not None for p in problem], bool)) for v in out]
            yield pa.RecordBatch.from_arrays([batch.column("raster_id"), batch.column("row"), batch.column("col"), *bands, lost], schema=_picked)

    return read


def pixels_of(spark: SparkSession, folder: str, meta: DataFrame):
    """A function from wanted (raster_id, row, col) to those rows with their four bands and,
    where a block can't be read, the problem instead.  Only the blocks that samples fall on
    are read; blocks are dealt to tasks, so a large raster is not one task."""
    ranged = by_ranges(folder)

    def whole(wanted: pa.Table, files: pa.Table) -> pa.Table:
        """One file's bytes and the pixels wanted of it."""
        source = {p: held(c.as_py()) for p, c in zip(files["path"].to_pylist(), files["content"])}
        return pa.Table.from_batches(list(_picker(source.get)(wanted.sort_by("block").combine_chunks().to_batches())) if wanted.num_rows and source else [], _picked)

    def pick(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("raster_id").cast("int"), F.col("row").cast("long"), F.col("col").cast("long")).distinct()
        across = F.ceil(F.col("width") / F.col("block_width"))
        tiles = meta.select("path", F.col("raster_id").cast("int"), "block_width", "block_height", across.alias("across"))
        block = F.floor(F.col("row") / F.col("block_height")) * F.col("across") + F.floor(F.col("col") / F.col("block_width"))
        at = wanted.join(tiles, "raster_id").select("raster_id", "row", "col", "path", block.alias("block"))
        if not ranged:
            return at.groupBy("path").cogroup(_files(spark, folder, True).groupBy("path")).applyInArrow(whole, _WANTED)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return at.repartition(n, "path", "block").sortWithinPartitions("path", "block").mapInArrow(_picker(opened), _WANTED)

    return pick
