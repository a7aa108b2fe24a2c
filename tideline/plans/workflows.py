"""The entry points: analyse rasters and lines, prepare training samples, validate."""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import boundaries as B
from ..operators import classify as K
from ..operators import features as X
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import statistics as T
from ..operators.config import DEFAULT, Config
from ..sources import readers, writers

LOG = logging.getLogger("tideline")

MANUAL_TYPES = {
    "DRY_WET": ("BEACH_DRY_to_BEACH_WET", "BEACH_WET_to_BEACH_DRY"),
    "VEG_DRY": ("VEGETATED_DUNES_to_BEACH_DRY", "VEGETATED_DUNE_to_BEACH_DRY"),
    "WET_WATER": ("BEACH_WET_to_WATER", "WATER_to_BEACH_WET"),
}
DETECTED_TYPES = {
    "DRY_WET": ("DRY_BEACH->BEACH_WET", "BEACH_WET->DRY_BEACH"),
    "VEG_DRY": ("VEG_DUNES->DRY_BEACH", "DRY_BEACH->VEG_DUNES"),
    "WET_WATER": ("BEACH_WET->WATER", "WATER->BEACH_WET"),
}


def classify_samples(samples: DataFrame, config: Config = DEFAULT, monotonic: str | bool = False, checked: bool = False) -> DataFrame:
    """Sound transects with features, class and confidence.  ``monotonic`` is False, or the
    smoothing that lets no class come back: "relaxed" (or True) or "strict".  Samples that
    ``valid_samples`` has gone over already are ``checked``."""
    sound = (samples if checked else X.valid_samples(samples)[0]).drop("ord")
    classed = K.smooth_classes(K.classify(X.compute_features(sound, config), config))
    if not monotonic:
        return classed
    if monotonic == "strict":
        return K.monotonic_strict(classed, config)
    if monotonic not in (True, "relaxed"):
        raise ValueError(f"no monotonic smoothing is called {monotonic}")
    return K.monotonic_relaxed(classed)


def problems_at(found: DataFrame, stage: str, reason: str = "reason") -> DataFrame:
    """Rows (transect_id, stage, reason) of what went wrong with single transects or tiles."""
    key = F.col("transect_id") if "transect_id" in found.columns else F.lit(None)
    return found.select(key.cast("long").alias("transect_id"), F.lit(stage).alias("stage"), F.col(reason).alias("reason"))


def sampled_lines(spark: SparkSession, rasters: str, features: DataFrame, crs: str) -> tuple[DataFrame, DataFrame]:
    """Samples of the sound ones of ``features`` in the rasters' coordinate system, of sound
    transects; and all problems on the way.  What is wrong with one line, tile or block
    leaves the others as they are; without any tile, or with tiles that don't go together,
    there is nothing to do, which is an error."""
    index = settle(readers.raster_index(spark, rasters), "tiles")
    wrong = problems_at(index.where("problem is not null").select(F.concat("path", F.lit(": "), "problem").alias("reason")), "raster")
    meta = readers.check_rasters(index.where("problem is null").drop("problem"))
    lines = G.reproject(features.where("problem is null").drop("problem"), crs, meta.select("crs").first()["crs"])
    wrong = wrong.unionByName(problems_at(features.where("problem is not null"), "read", "problem"))
    off = F.exists("points", lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    lines = settle(lines.withColumn("_off", F.coalesce(off, F.lit(True))), "lines")
    wrong = wrong.unionByName(problems_at(lines.where("_off").select("transect_id", F.lit("outside the rasters' coordinate system").alias("reason")), "reproject"))
    samples, lost = G.sample_lines(lines.where("not _off").drop("_off"), meta, readers.pixels_of(spark, rasters, meta))
    samples = settle(samples, "samples")
    sound, bad = X.valid_samples(samples)
    counts = F.concat("n_null", F.lit(" null, "), "n_negative", F.lit(" negative, "), "n_falling", F.lit(" falling"))
    wrong = wrong.unionByName(problems_at(lost, "sample")).unionByName(problems_at(bad.select("transect_id", counts.alias("reason")), "validate"))
    return sound, settle(wrong, "problems")


def say_problems(problems: DataFrame, output: str) -> None:
    writers.table_csv(problems.orderBy("stage", "transect_id", "reason"), f"{output}/problems")
    for stage, n in problems.groupBy("stage").count().orderBy("stage").collect():
        LOG.warning("%s: %d problems, listed in %s/problems", stage, n, output)


def say_summary(classed: DataFrame, kept: DataFrame) -> None:
    points, transects = classed.agg(F.count(F.lit(1)), F.countDistinct("transect_id")).first()
    LOG.info("%d points of %d transects, %d boundaries", points, transects, kept.count())
    for name, n in classed.groupBy("predicted_class").count().orderBy(F.desc("count"), "predicted_class").collect():
        LOG.info("%s: %d points, %.1f %%", name, n, 100 * n / points)


def analyze_all_transects(
    spark: SparkSession,
    rasters: str,
    transects: str,
    output: str,
    boundary_types: str = "shore_only",
    config: Config = DEFAULT,
    lines_crs: str | None = None,
    visualize: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Tiles and lines to classified samples and boundaries, written under ``output``, with
    the list of what went wrong.  Lines are brought to the tiles' coordinate system from
    ``lines_crs`` or the one their file names.  What would be drawn of ``visualize`` evenly
    spaced transects stands in plot_points."""
    features = settle(readers.transect_features(spark, transects), "features")
    samples, problems = sampled_lines(spark, rasters, features, lines_crs or readers.geojson_crs(spark, transects))
    say_problems(problems, output)
    classed = settle(classify_samples(samples, config, checked=True), "classes")
    found = settle(B.find_transitions(classed, config), "boundaries")
    points = B.with_transition_flag(classed, found)
    writers.points_csv(points, f"{output}/points")
    kept = B.filter_by_type(found, boundary_types)
    kept.drop("band_magnitudes").write.mode("overwrite").parquet(f"{output}/boundaries")
    writers.summary_json(classed, kept, f"{output}/summary")
    if visualize:
        shown = F.broadcast(G.evenly_spaced(classed, visualize))  # ``visualize`` ids
        writers.points_csv(points.join(shown, "transect_id", "left_semi"), f"{output}/plot_points")
    say_summary(classed, kept)
    return classed, kept


def training_samples(
    spark: SparkSession,
    rasters: str,
    transects: str,
    output: str,
    k: int,
    seed: int,
    boundary_types: str = "shore_only",
    config: Config = DEFAULT,
    lines_crs: str | None = None,
) -> DataFrame:
    """Samples of ``k`` random lines with class and boundaries, for labelling by hand; what was
    asked for, a JSON line a transect and the list of what went wrong stand beside them."""
    every = settle(readers.transect_features(spark, transects), "features")
    sound = every.where("problem is null")
    drawn = G.random_transects(sound, k, seed).unionByName(every.where("problem is not null"))
    samples, problems = sampled_lines(spark, rasters, drawn, lines_crs or readers.geojson_crs(spark, transects))
    say_problems(problems, output)
    classed = settle(classify_samples(samples, config, checked=True), "classes")
    samples = samples.drop("ord")
    kept = B.filter_by_type(settle(B.find_transitions(classed, config), "boundaries"), boundary_types)
    samples.withColumnRenamed("transect_id", "TransectID").write.mode("overwrite").csv(f"{output}/samples", header=True)
    writers.points_csv(B.with_transition_flag(classed, kept), f"{output}/points")
    kept.drop("band_magnitudes").write.mode("overwrite").parquet(f"{output}/boundaries")
    writers.summary_json(classed, kept, f"{output}/transects")
    asked = {"random_seed": seed, "samples_requested": k, "raster_dir": rasters, "transect_file": transects, "boundary_types": boundary_types}
    counts = sound.agg(F.count(F.lit(1)).alias("transects_available")).join(classed.agg(F.countDistinct("transect_id").alias("samples_processed")))  # single rows
    counts.withColumns({c: F.lit(v) for c, v in asked.items()}).coalesce(1).write.mode("overwrite").json(f"{output}/metadata")
    say_summary(classed, kept)
    return samples


def run_feature_analysis(samples: DataFrame, zones: DataFrame, output: str) -> dict[str, DataFrame]:
    """Profiles of the labelled sections and characteristics of the labelled boundaries."""
    profiles = settle(T.section_profiles(samples, zones), "profiles")
    around = settle(T.transition_characteristics(samples, M.manual_boundaries(zones)), "around")
    numbers = [c for c, t in around.dtypes if t in ("double", "bigint") and c not in ("transect_id", "position")]
    tables = {
        "section_profiles": profiles,
        "section_derivatives": T.section_derivatives(samples, zones),
        "section_correlations": T.section_correlations(samples, zones),
        "class_spectral_profiles": T.profile_summary(profiles),
        "class_zone_statistics": T.class_zone_statistics(samples, zones),
        "transition_characteristics": around,
        "transition_summary": T.transition_summary(around, numbers),
    }
    for name, t in tables.items():
        writers.table_csv(t, f"{output}/{name}")
    return tables


def run_log_analysis(spark: SparkSession, logs: str, output: str) -> DataFrame:
    """What the logs say of each transect, their rejections, and a report of rates."""
    parsed = settle(readers.read_log(spark, logs), "log")
    found = readers.log_summary(parsed)
    writers.table_csv(found, f"{output}/transects")
    writers.table_csv(parsed.where("rejected_at is not null").select("file", "line_no", "transect_id", "rejected_at", "reason"), f"{output}/rejections")
    report = readers.log_report(found)
    writers.text_report("Test log summary", report, f"{output}/report")
    return report


def run_all_validations(samples: DataFrame, zones: DataFrame, output: str, tolerance: float = 5.0, kind: str | None = None, config: Config = DEFAULT) -> dict[str, DataFrame]:
    """Match detections to labels and write every validation table and a report."""
    sound, bad = X.valid_samples(samples)
    counts = F.concat("n_null", F.lit(" null, "), "n_negative", F.lit(" negative, "), "n_falling", F.lit(" falling"))
    say_problems(settle(problems_at(bad.select("transect_id", counts.alias("reason")), "validate"), "problems"), output)
    classed = settle(classify_samples(sound, config, checked=True), "classes")
    found, manual = B.find_transitions(classed, config), M.manual_boundaries(zones)
    if kind:
        manual = manual.where(F.col("manual_type").isin(*MANUAL_TYPES[kind]))
        found = found.where(F.col("boundary_type").isin(*DETECTED_TYPES[kind]))
    matches = settle(M.match_transitions(settle(found, "boundaries"), manual, tolerance), "matches")
    labelled = M.points_in_zones(classed, zones)
    tables = {
        "transition_matches": matches,
        "metrics": M.metrics(matches),
        "feature_comparison_TP_vs_FP": T.compare_tp_fp(T.window_features(classed, matches), T.WINDOW_FEATURES),
        "within_zone_statistics": T.zone_derivatives(classed, zones),
        "threshold_sensitivity": M.sweep(classed, manual),
        "boundary_type_confusion_matrix": M.confusion(matches),
        "boundary_type_accuracy": M.type_accuracy(matches),
        "error_distribution": M.error_distribution(matches),
        "feature_statistics_by_class": T.class_statistics(labelled),
        "feature_discriminability": T.discriminability(labelled),
    }
    for name, t in tables.items():
        writers.table_csv(t, f"{output}/{name}")
    shore = found.where(F.col("detection_method").startswith("derivative_magnitude"))
    verdicts = settle(M.categories(shore, M.first_dry_wet(zones), tolerance, 2 * tolerance), "verdicts")
    writers.shell_line_report(verdicts, M.shell_line_metrics(verdicts), f"{output}/shell_line")
    return tables


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, which may not have it installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tideline-"), "tideline"), "zip", root, "tideline")
    spark.sparkContext.addPyFile(path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Analyse transects over raster tiles, draw training samples, validate against manual zones, profile the zones, or read logs.")
    p.add_argument("--mode", default="analyze", choices=["analyze", "train", "validate", "profile", "logs"])
    p.add_argument("--rasters", help="folder of tiles (analyze, train)")
    p.add_argument("--transects", help="GeoJSON of lines (analyze, train)")
    p.add_argument("--samples", help="CSV of samples (validate, profile)")
    p.add_argument("--zones", help="text file of manual zones (validate, profile)")
    p.add_argument("--logs", help="log files (logs)")
    p.add_argument("--output", required=True)
    p.add_argument("--boundary-types", default="shore_only", choices=["all", "shore_only", "waterline"])
    p.add_argument("--num-transects", type=int, default=10)
    p.add_argument("--seed", type=int, default=321197)
    p.add_argument("--lines-crs", help="coordinate system of the lines, if not the one their file names (analyze, train)")
    p.add_argument("--num-visualize", type=int, default=5, help="evenly spaced transects whose points are written apart (analyze)")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--tolerance", type=float, default=5.0)
    p.add_argument("--kind", choices=sorted(MANUAL_TYPES))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    needs = {"validate": ("samples", "zones"), "profile": ("samples", "zones"), "logs": ("logs",)}.get(a.mode, ("rasters", "transects"))
    if missing := [f"--{n}" for n in needs if not getattr(a, n)]:
        p.error(f"{a.mode} needs {' and '.join(missing)}")
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    ship(spark)
    if a.mode == "analyze":
        analyze_all_transects(spark, a.rasters, a.transects, a.output, a.boundary_types, lines_crs=a.lines_crs, visualize=a.num_visualize)
    elif a.mode == "train":
        training_samples(spark, a.rasters, a.transects, a.output, a.num_transects, a.seed, a.boundary_types, lines_crs=a.lines_crs)
    elif a.mode == "profile":
        run_feature_analysis(readers.samples_csv(spark, a.samples), readers.manual_zones(spark, a.zones), a.output)
    elif a.mode == "logs":
        run_log_analysis(spark, a.logs, a.output)
    else:
        tables = run_all_validations(readers.samples_csv(spark, a.samples, numbered=True), readers.manual_zones(spark, a.zones), a.output, a.tolerance, a.kind)
        small = {n: tables[n] for n in ("metrics", "boundary_type_confusion_matrix", "error_distribution", "feature_discriminability")}
        spark.createDataFrame([(writers.markdown("Validation", small),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.output}/report")


if __name__ == "__main__":
    main()
