"""Every registered query with its SQL twin.

A query returns doubles rounded to six places (and -0.0 as 0.0), as its twin does, so
that the two engines' last bits don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import boundaries as B
from ..operators import classify as K
from ..operators import features as X
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import statistics as T
from ..operators import synthetic as Y
from ..operators.config import DEFAULT, THRESHOLD_SETS
from ..sources import writers
from . import fixture, twins
from .twins import W, frame, r

QUERIES: dict = {}
ORACLES: dict = {}
KEY = "transect_id"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def out(prefix: str, body: str, plain: str, doubles: str = "") -> str:
    """``plain`` columns as they are and ``doubles`` rounded, from ``body``."""
    cols = [c for c in [plain, *[r(c) for c in doubles.split()]] if c]
    return f"{prefix}SELECT {', '.join(cols)} FROM ({body})"


# ------------------------------------------------------------------ shared tables


def points(s, d, irregular=False):
    return fixture.spectral_points(s, d, irregular)


def feats(s, d, irregular=False):
    return X.compute_features(points(s, d, irregular))


def nums(s, d):
    """The features but the two peak flags: nothing leaves the JVM."""
    return X.compute_features(points(s, d), peaks=False)


def classes(s, d):
    return K.smooth_classes(K.classify(feats(s, d)))


def manual(s, d):
    return M.manual_boundaries(fixture.manual_zones(s, d))


def settled(s, d):
    """Classes that several steps of a query read."""
    return settle(classes(s, d), "classes")


def unmerged(s, d, c=None):
    """Filtered boundaries without the merging of near ones, which SQL can't follow."""
    c = c or settled(s, d)  # four detectors and the class lookup read it
    return settle(B.quality_filter(B.add_class_info(B.detect(c), c), c), "boundaries")


def matches(s, d):
    return settle(M.match_transitions(unmerged(s, d), manual(s, d)), "matches")


def labelled(s, d):
    return M.points_in_zones(nums(s, d), fixture.manual_zones(s, d))


# ------------------------------------------------------------- features, windows

NUMBERS = " ".join(c for c in X.FEATURES if not c.startswith("has_"))


@query("features", out(twins.featured(), "SELECT * FROM feat", "transect_id, distance, has_oscillations, has_rgb_foam_peak", NUMBERS))
def _(s, d):
    return feats(s, d).select(KEY, "distance", *X.FEATURES)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["features"](spark, sf_dir)


@query("features_irregular", out(twins.featured(irregular=True), "SELECT * FROM feat", "transect_id, has_oscillations, has_rgb_foam_peak", "distance " + NUMBERS))
def _(s, d):
    return feats(s, d, True).select(KEY, "distance", *X.FEATURES)


_SUMMARY = "ndvi ndwi brightness nir_ratio nir_d1 nir_d1_smooth variability slope curvature local_range".split()


@query(
    "feature_summary",
    out(twins.featured(), " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS lo, max({c}) AS hi FROM feat" for c in _SUMMARY), "feature", "mean std lo hi"),
)
def _(s, d):
    return X.feature_summary(nums(s, d)).withColumnsRenamed({"min": "lo", "max": "hi"})


_PAIR_SQL = {
    "red_blue_ratio": "red / (blue + 1e-10)", "red_nir_ratio": "red / (nir + 1e-10)", "green_blue_ratio": "green / (blue + 1e-10)",
    "green_nir_ratio": "green / (nir + 1e-10)", "blue_nir_ratio": "blue / (nir + 1e-10)", "red_green_ratio": "red / (green + 1e-10)",
    "blue_red_ratio": "blue / (red + 1e-10)", "nd_rg": "(red - green) / (red + green + 1e-10)", "nd_rb": "(red - blue) / (red + blue + 1e-10)",
    "nd_gb": "(green - blue) / (green + blue + 1e-10)",
}


@query(
    "band_indices",
    out(
        twins.base(),
        "SELECT *, CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) ELSE 0 END AS ndvi, CASE WHEN green + nir > 0 THEN (green - nir) / (green + nir) ELSE 0 END AS ndwi, "
        "CASE WHEN red + green + blue + nir > 0 THEN nir / ((red + green + blue + nir) / 4) ELSE 0 END AS nir_ratio4, "
        + ", ".join(f"{v} AS {k}" for k, v in _PAIR_SQL.items()) + " FROM points",
        "transect_id, distance",
        "ndvi ndwi nir_ratio4 " + " ".join(_PAIR_SQL),
    ),
)
def _(s, d):
    return points(s, d).select(KEY, "distance", *[v.alias(k) for k, v in (X.guarded_indices() | X.pair_columns()).items()])


_SIZES = (3, 5, 7, 9, 11)


def _rolling_sql() -> str:
    cols = []
    for z in _SIZES:
        fr = frame(-(z // 2), z // 2)
        for name, f in (("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("max", "max(x)")):
            cols.append(f"CASE WHEN count(*) OVER {fr} = {z} THEN {f} OVER {fr} END AS {name}_{z}")
        cols.append(f"CASE WHEN count(*) OVER {fr} = {z} THEN max(x) OVER {fr} - min(x) OVER {fr} END AS range_{z}")
    return f"SELECT transect_id, distance, {', '.join(cols)} FROM (SELECT *, nir::DOUBLE AS x FROM points)"


@query("rolling_features", out(twins.base(), _rolling_sql(), "transect_id, distance", " ".join(f"{k}_{z}" for z in _SIZES for k in ("mean", "std", "min", "max", "range"))))
def _(s, d):
    return T.rolling_features(points(s, d), "nir", _SIZES)


def _sg(x: str, w: str = W) -> str:
    def at(k):
        return x if k == 0 else f"{'lag' if k < 0 else 'lead'}({x}, {abs(k)}) OVER ({w})"

    def add(terms):
        return "(" + " + ".join(f"{c} * {at(k)}" for k, c in terms) + ") / 35"

    ends = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5)}
    cases = " ".join(
        f"WHEN i = {p} THEN {add([(k - p, c) for k, c in enumerate(e)])} WHEN i = n - 1 - {p} THEN {add([(p - k, c) for k, c in enumerate(e)])}" for p, e in ends.items()
    )
    return f"CASE WHEN n < 5 THEN NULL {cases} ELSE {add([(-2, -3), (-1, 12), (0, 17), (1, 12), (2, -3)])} END"


@query(
    "smoothed_derivatives",
    out(
        twins.base(twins.indexed("points", "ix"), f"sg AS (SELECT *, {_sg('nir::DOUBLE')} AS smooth FROM ix)", f"sg1 AS (SELECT *, {twins.grad('smooth')} AS d1 FROM sg)"),
        f"SELECT *, {twins.grad('d1')} AS d2 FROM sg1", "transect_id, distance", "smooth d1 d2",
    ),
)
def _(s, d):
    return T.smoothed_derivatives(points(s, d))


@query(
    "multiscale_derivative",
    out(twins.featured(f"ms AS (SELECT *, {', '.join(f'{twins.uniform('nir_d1', z)} AS w{z}' for z in (1, 3, 5, 7, 9))} FROM feat WHERE transect_id = 0)"),
        " UNION ALL ".join(f"SELECT distance, 'w{z}' AS size, w{z} AS value FROM ms" for z in (1, 3, 5, 7, 9)), "distance, size", "value"),
)
def _(s, d):
    return T.multiscale_derivative(nums(s, d), 0)


@query(
    "sustained_and_consensus",
    out(twins.detected(), "SELECT transect_id, distance, hold, bands, vr AS variance_ratio FROM near", "transect_id, distance, hold, bands", "variance_ratio"),
)
def _(s, d):
    f, w = nums(s, d), B.S.series(KEY)
    v = F.avg("variability")
    ratio = F.when((F.col("i") >= 5) & (F.col("i") < F.col("n") - 5), v.over(w.rowsBetween(0, 4)) / (v.over(w.rowsBetween(-5, -1)) + 1e-6)).otherwise(0.0)
    return f.select(KEY, "distance", F.coalesce(B.sustained("nir_d1_w5", -8.0, w), F.lit(False)).alias("hold"), B.consensus(-8.0)[0].alias("bands"), ratio.alias("variance_ratio"))


# ---------------------------------------------------------------------- classes


@query("classified_points", out(twins.classed(), "SELECT transect_id, distance, raw_class AS predicted_class, class_confidence AS confidence FROM coded", "transect_id, distance, predicted_class", "confidence"))
def _(s, d):
    return K.classify(feats(s, d)).select(KEY, "distance", "predicted_class", "confidence")


@query("smoothed_classes", twins.classed() + "SELECT transect_id, distance, predicted_class FROM smooth")
def _(s, d):
    return classes(s, d).select(KEY, "distance", "predicted_class")


_SEGMENTS = """SELECT transect_id, CAST(run AS BIGINT) AS run, any_value(predicted_class) AS predicted_class, min(distance) AS "start", max(distance) AS "end",
  count(*) AS points, avg(distance) AS centroid, max(distance) - min(distance) AS span FROM runs GROUP BY transect_id, run"""


@query("segments", out(twins.classed(twins.RUNS_SQL), _SEGMENTS, 'transect_id, run, predicted_class, "start", "end", points', "centroid span"))
def _(s, d):
    return K.segments(classes(s, d))


@query("class_distribution", twins.classed() + "SELECT transect_id, predicted_class, count(*) AS points FROM smooth GROUP BY GROUPING SETS ((transect_id, predicted_class), (predicted_class))")
def _(s, d):
    return K.class_distribution(classes(s, d))


# the classes' order along the shore, and what came further out before a class's first point
_SHORE = """
shored AS (SELECT *, CASE predicted_class WHEN 'VEG_DUNES' THEN 0 WHEN 'DRY_BEACH' THEN 1 WHEN 'BEACH_WET' THEN 2 WHEN 'WATER' THEN 3 WHEN 'WAVE_CRESTS' THEN 3 END AS place FROM {source}),
begins AS (SELECT transect_id, predicted_class, place, min({at}) AS b FROM shored WHERE place IS NOT NULL {among} GROUP BY ALL),
taken AS (SELECT * FROM begins x WHERE NOT EXISTS (SELECT 1 FROM begins y WHERE y.transect_id = x.transect_id AND y.place > x.place AND y.b < x.b))"""


@query(
    "monotonic_relaxed",
    twins.classed(_SHORE.format(source="smooth", at="i", among=""))
    + f"""SELECT p.transect_id, p.distance, CASE WHEN p.place IS NULL THEN 'UNKNOWN' WHEN t.b IS NULL THEN ['VEG_DUNES', 'DRY_BEACH', 'BEACH_WET', 'WATER'][p.top + 1]
  WHEN t.b = p.i THEN p.predicted_class ELSE 'UNKNOWN' END AS predicted_class
FROM (SELECT *, max(place) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM shored) p LEFT JOIN taken t USING (transect_id, predicted_class)""",
)
def _(s, d):
    return K.monotonic_relaxed(classes(s, d)).select(KEY, "distance", "predicted_class")


@query(
    "monotonic_strict",
    twins.classed(twins.RUNS_SQL, "wide AS (SELECT *, max(distance) OVER z - min(distance) OVER z AS span FROM runs WINDOW z AS (PARTITION BY transect_id, run))", _SHORE.format(source="wide", at="run", among="AND span >= 2.5"))
    + """SELECT p.transect_id, p.distance, coalesce(t.predicted_class, 'UNKNOWN') AS predicted_class
FROM shored p LEFT JOIN taken t ON t.transect_id = p.transect_id AND t.predicted_class = p.predicted_class AND t.b = p.run""",
)
def _(s, d):
    return K.monotonic_strict(classes(s, d)).select(KEY, "distance", "predicted_class")


@query(
    "short_segment_merge",
    twins.recursive(twins.classed(
        """step AS (
  SELECT 0 AS round, transect_id, i, distance, predicted_class AS c FROM smooth
  UNION ALL
  SELECT round + 1, transect_id, i, distance, CASE WHEN run = short THEN coalesce(CASE WHEN after <> 'UNKNOWN' THEN after END, before, 'UNKNOWN') ELSE c END FROM (
    SELECT *, min(CASE WHEN c <> 'UNKNOWN' AND span < 2.5 THEN run END) OVER (PARTITION BY transect_id) AS short,
      first_value(c) OVER (PARTITION BY transect_id ORDER BY run RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after,
      first_value(c) OVER (PARTITION BY transect_id ORDER BY run RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT *, max(distance) OVER (PARTITION BY transect_id, run) - min(distance) OVER (PARTITION BY transect_id, run) AS span FROM (
      SELECT *, sum(new) OVER (PARTITION BY transect_id ORDER BY i) AS run FROM (
        SELECT *, coalesce(c <> lag(c) OVER (PARTITION BY transect_id ORDER BY i), false)::INT AS new FROM step WHERE round < 10))))
)"""
    ))
    + "SELECT transect_id, distance, c AS predicted_class FROM step WHERE round = 10",
)
def _(s, d):
    return K.merge_short_segments(classes(s, d)).select(KEY, "distance", "predicted_class")


@query(
    "zone_vote",
    twins.detected(
        """flagged AS (SELECT s.*, f.i IS NOT NULL AS flag FROM smooth s LEFT JOIN (SELECT DISTINCT transect_id, i FROM final) f ON f.transect_id = s.transect_id AND f.i = s.i)""",
        f"zoned AS (SELECT *, sum(flag::INT) OVER ({W} ROWS UNBOUNDED PRECEDING) AS zone FROM flagged)",
        "votes AS (SELECT transect_id, zone, predicted_class, count(*) AS votes, min(distance) AS met FROM zoned WHERE predicted_class <> 'UNKNOWN' GROUP BY ALL)",
        "winner AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transect_id, zone ORDER BY votes DESC, met) AS rn FROM votes) WHERE rn = 1)",
    )
    + "SELECT z.transect_id, z.distance, coalesce(w.predicted_class, z.predicted_class) AS predicted_class FROM zoned z LEFT JOIN winner w USING (transect_id, zone)",
)
def _(s, d):
    c = settle(classes(s, d), "classes")
    flagged = B.with_transition_flag(c, B.quality_filter(B.add_class_info(B.detect(c), c), c))
    return K.vote_by_zone(flagged, "transition_flag").select(KEY, "distance", "predicted_class")


@query(
    "sequence_violations",
    twins.classed(
        f"""sided AS (SELECT *, lag(predicted_class) OVER ({W}) AS before, lead(predicted_class) OVER ({W}) AS after FROM smooth)""",
        """judged AS (SELECT *, coalesce(before <> 'UNKNOWN' AND predicted_class <> 'UNKNOWN' AND before <> predicted_class AND NOT (
  least(before, predicted_class) || '|' || greatest(before, predicted_class) IN ('DRY_BEACH|VEG_DUNES', 'BEACH_WET|DRY_BEACH', 'BEACH_WET|WATER', 'BEACH_WET|WAVE_CRESTS', 'WATER|WAVE_CRESTS')), false) AS jump,
  coalesce(before <> predicted_class AND after <> predicted_class, false) AS alone FROM sided)""",
    )
    + "SELECT transect_id, distance, before, predicted_class, after, jump, alone FROM judged WHERE jump OR alone",
)
def _(s, d):
    return K.sequence_violations(classes(s, d))


@query("clear_context", twins.classed() + f"SELECT transect_id, distance, len(list_distinct(list(predicted_class) OVER {frame(-3, 3)})) <= 2 AS clear FROM smooth")
def _(s, d):
    return K.context_is_clear(classes(s, d)).select(KEY, "distance", "clear")


# ------------------------------------------------------------------- boundaries

_DET = 'transect_id, i AS "index", distance, detection_method'


@query("vegetation_inflection", out(twins.detected(), "SELECT * FROM veg", _DET, "confidence magnitude"))
def _(s, d):
    return B.vegetation_inflection(classes(s, d)).select(KEY, "index", "distance", "detection_method", "confidence", "magnitude")


@query("surf_foam", out(twins.detected(), "SELECT * FROM surf", _DET, "confidence magnitude"))
def _(s, d):
    return B.surf_foam(classes(s, d)).select(KEY, "index", "distance", "detection_method", "confidence", "magnitude")


_SCORED = "SELECT *, ndrop AS nir_drop, bb AS brightness_before, nb AS nir_before, vr AS variance_ratio, bands AS bands_agreeing, nir_d1_w5 AS magnitude, hold AS sustained FROM "
_SCORES = "confidence magnitude nir_drop brightness_before nir_before variance_ratio"


@query("dry_wet_strict", out(twins.detected(), _SCORED + "strict", 'transect_id, i AS "index", distance, bands_agreeing, sustained', _SCORES))
def _(s, d):
    return B.dry_wet_strict(B.drop_candidates(classes(s, d))).select(KEY, "index", "distance", "bands_agreeing", "sustained", *_SCORES.split())


@query("dry_wet_relaxed", out(twins.detected(), _SCORED + "relaxed", 'transect_id, i AS "index", distance, bands_agreeing, sustained', _SCORES))
def _(s, d):
    return B.dry_wet_relaxed(B.drop_candidates(classes(s, d))).select(KEY, "index", "distance", "bands_agreeing", "sustained", *_SCORES.split())


@query("best_dry_wet", out(twins.detected(), "SELECT * FROM best", _DET + ", detection_mode", "confidence magnitude"))
def _(s, d):
    c = B.drop_candidates(classes(s, d))
    c = settle(c, "candidates")
    return B.best_dry_wet(B.dry_wet_strict(c), B.dry_wet_relaxed(c)).select(KEY, "index", "distance", "detection_method", "detection_mode", "confidence", "magnitude")


@query("boundaries_unmerged", out(twins.detected(), "SELECT * FROM final", _DET + ", detection_mode, from_class, to_class, boundary_type", "confidence magnitude"))
def _(s, d):
    return unmerged(s, d).select(KEY, "index", "distance", "detection_method", "detection_mode", "from_class", "to_class", "boundary_type", "confidence", "magnitude")


@query("boundaries", out(twins.merged(), "SELECT * FROM final", _DET + ", detection_mode, from_class, to_class, boundary_type", "confidence magnitude"))
def _(s, d):
    return B.find_transitions(settle(classes(s, d), "classes")).select(KEY, "index", "distance", "detection_method", "detection_mode", "from_class", "to_class", "boundary_type", "confidence", "magnitude")


@query(
    "boundaries_merged_by_method",
    twins.recursive(out(
        twins.detected(
            "seq AS (SELECT *, row_number() OVER (PARTITION BY transect_id, detection_method ORDER BY distance) AS k FROM final)",
            """walk AS (SELECT transect_id, detection_method, k, distance AS anchor FROM seq WHERE k = 1 UNION ALL
SELECT s.transect_id, s.detection_method, s.k, CASE WHEN s.distance - w.anchor < 5 THEN w.anchor ELSE s.distance END FROM walk w JOIN seq s
ON s.transect_id = w.transect_id AND s.detection_method = w.detection_method AND s.k = w.k + 1)""",
            "best_of AS (SELECT s.*, row_number() OVER (PARTITION BY transect_id, detection_method, anchor ORDER BY confidence DESC, distance) AS rn FROM seq s JOIN walk USING (transect_id, detection_method, k))",
        ),
        "SELECT * FROM best_of WHERE rn = 1", _DET, "confidence",
    )),
)
def _(s, d):
    return B.merge_by_method(unmerged(s, d)).select(KEY, "index", "distance", "detection_method", "confidence")


@query(
    "boundary_kinds",
    twins.detected()
    + """SELECT detection_method, boundary_type, count(*) AS n, count(*) FILTER (shore) AS shore, count(*) FILTER (water) AS water, count(*) FILTER (veg) AS vegetation
FROM (SELECT *, boundary_type IN ('DRY_BEACH->BEACH_WET', 'BEACH_WET->DRY_BEACH') OR detection_method IN ('derivative_magnitude', 'derivative_magnitude_relaxed') AS shore,
  boundary_type IN ('BEACH_WET->WATER', 'WATER->BEACH_WET', 'BEACH_WET->WAVE_CRESTS', 'WAVE_CRESTS->BEACH_WET') AS water,
  boundary_type IN ('VEG_DUNES->DRY_BEACH', 'DRY_BEACH->VEG_DUNES', 'VEG_DUNES->BEACH_WET', 'BEACH_WET->VEG_DUNES') AS veg FROM final) GROUP BY ALL""",
)
def _(s, d):
    kinds = [F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(k) for k, v in B.boundary_kinds().items()]
    return unmerged(s, d).groupBy("detection_method", "boundary_type").agg(F.count(F.lit(1)).alias("n"), *kinds)


@query(
    "per_point_export",
    out(
        twins.detected(), """SELECT s.transect_id, s.distance, red, green, blue, nir, predicted_class, class_confidence AS confidence, f.i IS NOT NULL AS transition_flag
FROM smooth s LEFT JOIN (SELECT DISTINCT transect_id, i FROM final) f ON f.transect_id = s.transect_id AND f.i = s.i""",
        "transect_id, distance, red, green, blue, nir, predicted_class, transition_flag", "confidence",
    ),
)
def _(s, d):
    c = settle(classes(s, d), "classes")
    flagged = B.with_transition_flag(c, B.quality_filter(B.add_class_info(B.detect(c), c), c))
    return flagged.select(KEY, "distance", *X.BANDS, "predicted_class", "confidence", "transition_flag")


@query(
    "processing_stats",
    out(
        twins.detected(),
        """SELECT *, points / transects AS points_per_transect, transitions / transects AS transitions_per_transect FROM
(SELECT count(DISTINCT transect_id) AS transects, count(*) AS points FROM smooth),
(SELECT count(*) AS transitions, avg(confidence) AS conf_mean, stddev_pop(confidence) AS conf_std, min(confidence) AS conf_min, max(confidence) AS conf_max FROM final)""",
        "transects, points, transitions", "conf_mean conf_std conf_min conf_max points_per_transect transitions_per_transect",
    ),
)
def _(s, d):
    classed = settled(s, d)
    return T.processing_stats(classed, unmerged(s, d, classed))


# --------------------------------------------------------------- labels, matches


@query("manual_boundaries", twins.chain(fixture.ZONES_SQL, twins.MANUAL_SQL) + "SELECT transect_id, position, manual_type, seq FROM manual")
def _(s, d):
    return manual(s, d)


@query("first_dry_wet", twins.chain(fixture.ZONES_SQL, twins.MANUAL_SQL) + "SELECT transect_id, min(position) AS position FROM manual WHERE manual_type = 'BEACH_DRY_to_BEACH_WET' GROUP BY 1")
def _(s, d):
    return M.first_dry_wet(fixture.manual_zones(s, d))


_MATCH = "transect_id, detected_position, label, manual_position, manual_type, detected_type"


@query("match_transitions", out(twins.matched(), "SELECT * FROM matches", _MATCH, "distance_error confidence"))
def _(s, d):
    return matches(s, d)


_METRICS_SQL = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM (
SELECT count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'FN') AS fn,
avg(distance_error) AS mae, sqrt(avg(distance_error * distance_error)) AS rmse FROM matches))"""


@query("match_metrics", out(twins.matched(), _METRICS_SQL, "tp, fp, fn", "mae rmse precision recall f1"))
def _(s, d):
    return M.metrics(matches(s, d))


_VERDICT_SQL = """
bestd AS (SELECT transect_id, distance AS detected_location, confidence FROM (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY confidence DESC, distance) AS rn FROM final) WHERE rn = 1),
truth AS (SELECT transect_id, min(position) AS position FROM manual WHERE manual_type = 'BEACH_DRY_to_BEACH_WET' GROUP BY 1),
verdicts AS (
  SELECT transect_id, position AS manual_location, detected_location, abs(detected_location - position) AS error_m, confidence,
    CASE WHEN detected_location IS NULL THEN 'FALSE_NEGATIVE' WHEN abs(detected_location - position) <= 5 THEN 'CORRECT'
         WHEN abs(detected_location - position) <= 10 THEN 'LOCALIZATION_ERROR' ELSE 'FALSE_POSITIVE' END AS result
  FROM truth LEFT JOIN bestd USING (transect_id)
)"""


def verdicts(s, d):
    return M.categories(unmerged(s, d), M.first_dry_wet(fixture.manual_zones(s, d)))


@query("match_categories", out(twins.detected(fixture.ZONES_SQL, twins.MANUAL_SQL, _VERDICT_SQL), "SELECT * FROM verdicts", "transect_id, manual_location, detected_location, result", "error_m confidence"))
def _(s, d):
    return verdicts(s, d)


_RATED_SQL = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *,
CASE WHEN correct + near + false_pos > 0 THEN correct / (correct + near + false_pos) ELSE 0 END AS precision,
CASE WHEN correct + false_neg > 0 THEN correct / (correct + false_neg) ELSE 0 END AS recall FROM (
SELECT count(*) FILTER (result = 'CORRECT') AS correct, count(*) FILTER (result = 'LOCALIZATION_ERROR') AS near, count(*) FILTER (result = 'FALSE_NEGATIVE') AS false_neg,
count(*) FILTER (result = 'FALSE_POSITIVE') AS false_pos, count(*) AS total, avg(error_m) AS avg_error FROM verdicts))"""


@query(
    "category_metrics",
    out(
        twins.detected(fixture.ZONES_SQL, twins.MANUAL_SQL, _VERDICT_SQL),
        _RATED_SQL,
        "correct, near, false_neg, false_pos, total", "avg_error precision recall f1",
    ),
)
def _(s, d):
    return M.category_metrics(verdicts(s, d))


@query(
    "shell_line_metrics",
    out(
        twins.detected(fixture.ZONES_SQL, twins.MANUAL_SQL, _VERDICT_SQL),
        """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN total > 0 THEN (tp + loc) / total ELSE 0 END AS recall FROM (
SELECT count(*) FILTER (result = 'CORRECT') AS tp, count(*) FILTER (result = 'LOCALIZATION_ERROR') AS loc, count(*) FILTER (result = 'FALSE_POSITIVE') AS fp, count(*) AS total,
avg(error_m) AS mean_error, median(error_m) AS median_error, stddev_pop(error_m) AS std_error, max(error_m) AS max_error FROM verdicts)""",
        "tp, loc, fp, total", "mean_error median_error std_error max_error precision recall",
    ),
)
def _(s, d):
    return M.shell_line_metrics(verdicts(s, d))


@query("detected_flags", twins.matched() + """SELECT transect_id, position, manual_type, seq, EXISTS (SELECT 1 FROM matches x WHERE x.label = 'TP' AND x.transect_id = m.transect_id AND abs(x.detected_position - m.position) < 10) AS detected FROM manual m""")
def _(s, d):
    return M.detected_flags(manual(s, d), matches(s, d))


_SWEEP = twins.recursive(twins.featured(
    fixture.ZONES_SQL, twins.MANUAL_SQL,
    f"""low AS (SELECT transect_id, distance, nir_d1_smooth AS g FROM (SELECT *, NOT coalesce(nir_d1_smooth > lag(nir_d1_smooth) OVER ({W}), false)
  AND NOT coalesce(nir_d1_smooth > lead(nir_d1_smooth) OVER ({W}), false) AS is_min FROM feat) WHERE is_min AND nir > 50)""",
    "levels AS (SELECT -2.0::DOUBLE + -3.0::DOUBLE * k / 29 AS threshold FROM range(30) t(k))",
    "seq AS (SELECT *, row_number() OVER (PARTITION BY transect_id, threshold ORDER BY distance) AS k FROM low JOIN levels ON g < threshold)",
    """walk AS (SELECT transect_id, threshold, k, distance AS d, g, 1 AS grp FROM seq WHERE k = 1 UNION ALL
SELECT s.transect_id, s.threshold, s.k, CASE WHEN s.distance - w.d >= 15 OR abs(s.g) > abs(w.g) THEN s.distance ELSE w.d END,
  CASE WHEN s.distance - w.d >= 15 OR abs(s.g) > abs(w.g) THEN s.g ELSE w.g END, w.grp + (s.distance - w.d >= 15)::INT
FROM walk w JOIN seq s ON s.transect_id = w.transect_id AND s.threshold = w.threshold AND s.k = w.k + 1)""",
    "made AS (SELECT transect_id, threshold, grp, arg_max(d, k) AS p FROM walk GROUP BY ALL)",
    "hit AS (SELECT m.transect_id, threshold, grp, min(seq) AS seq FROM made m JOIN manual x ON x.transect_id = m.transect_id AND abs(m.p - x.position) <= 10 GROUP BY ALL)",
    """tally AS (SELECT threshold, (SELECT count(*) FROM hit h WHERE h.threshold = l.threshold) AS tp, (SELECT count(*) FROM made h WHERE h.threshold = l.threshold) AS num_detections,
  (SELECT count(*) FROM manual) - (SELECT count(DISTINCT (transect_id, seq)) FROM hit h WHERE h.threshold = l.threshold) AS fn FROM levels l)""",
    """rated AS (SELECT *, num_detections - tp AS fp, CASE WHEN num_detections > 0 THEN tp / num_detections ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM tally)""",
    "swept AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM rated)",
))


@query("threshold_sweep", out(_SWEEP, "SELECT * FROM swept", "tp, fp, fn, num_detections", "threshold precision recall f1_score"))
def _(s, d):
    return M.sweep(nums(s, d), manual(s, d))


@query("threshold_optimum", out(_SWEEP, "SELECT * FROM swept ORDER BY f1_score DESC, threshold DESC LIMIT 1", "tp, fp, fn, num_detections", "threshold precision recall f1_score"))
def _(s, d):
    return M.optimum(M.sweep(nums(s, d), manual(s, d)))


def _set_sql(name: str, soft_drop: float, soft_brightness: float, soft_nir: float) -> str:
    body = out(twins.detected(fixture.ZONES_SQL, twins.MANUAL_SQL, _VERDICT_SQL, drop=soft_drop, bright=soft_brightness, bright_nir=soft_nir), _RATED_SQL, "correct, near, false_neg, false_pos, total", "avg_error precision recall f1")
    return f"SELECT '{name}' AS threshold_set, * FROM ({body})"


@query("threshold_sets", " UNION ALL ".join(_set_sql(k, **v) for k, v in THRESHOLD_SETS.items()))
def _(s, d):
    c, out_ = settle(classes(s, d), "classes"), None
    for name, changes in THRESHOLD_SETS.items():
        config = DEFAULT.but(**changes)
        found = B.quality_filter(B.add_class_info(B.detect(c, config), c), c, config)
        v = M.category_metrics(M.categories(found, M.first_dry_wet(fixture.manual_zones(s, d)))).withColumn("threshold_set", F.lit(name))
        out_ = v if out_ is None else out_.unionByName(v)
    return out_


@query(
    "confusion_matrix",
    twins.matched("tps AS (SELECT manual_type, detected_type FROM matches WHERE label = 'TP')", "lab AS (SELECT manual_type AS l FROM tps UNION SELECT detected_type FROM tps WHERE detected_type IS NOT NULL)")
    + "SELECT a.l AS manual_type, b.l AS detected_type, (SELECT count(*) FROM tps WHERE tps.manual_type = a.l AND tps.detected_type = b.l) AS n FROM lab a, lab b",
)
def _(s, d):
    return M.confusion(matches(s, d))


@query(
    "type_accuracy",
    out(twins.matched(), "SELECT manual_type, count(*) AS total, count(*) FILTER (manual_type = detected_type) AS correct, count(*) FILTER (manual_type = detected_type) / count(*) AS accuracy FROM matches WHERE label = 'TP' GROUP BY ALL",
        "manual_type, total, correct", "accuracy"),
)
def _(s, d):
    return M.type_accuracy(matches(s, d))


@query(
    "error_distribution",
    out(
        twins.matched(), """SELECT avg(e) AS mae, sqrt(avg(e * e)) AS rmse, median(e) AS median, stddev_pop(e) AS std, avg(e) > 1 AS biased,
100 * avg((e <= 5)::INT::DOUBLE) AS pct_5, 100 * avg((e <= 10)::INT::DOUBLE) AS pct_10 FROM (SELECT distance_error AS e FROM matches WHERE label = 'TP')""", "biased", "mae rmse median std pct_5 pct_10",
    ),
)
def _(s, d):
    return M.error_distribution(matches(s, d))


@query("error_ecdf", out(twins.matched(), "SELECT DISTINCT distance_error, cume_dist() OVER (ORDER BY distance_error) AS share FROM matches WHERE label = 'TP'", "", "distance_error share"))
def _(s, d):
    return M.error_ecdf(matches(s, d))


# -------------------------------------------------------------------- statistics

_IN_ZONE = """
labelled AS (SELECT * FROM (
  SELECT p.*, z.zone_order, z.zone_class, row_number() OVER (PARTITION BY p.transect_id, p.i ORDER BY z.zone_order) AS rn
  FROM feat p JOIN zones z ON z.transect_id = p.transect_id AND p.distance BETWEEN z.zstart AND z.zend) WHERE rn = 1)"""
_CF = T.CLASS_FEATURES
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT zone_class AS class, '{c}' AS feature, {c}::DOUBLE AS value FROM labelled" for c in _CF) + ")"


@query("points_in_zones", twins.featured(fixture.ZONES_SQL, _IN_ZONE) + "SELECT transect_id, distance, zone_order, zone_class FROM labelled")
def _(s, d):
    return labelled(s, d).select(KEY, "distance", "zone_order", "zone_class")


@query(
    "class_statistics",
    out(twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG), "SELECT feature, class, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, count(*) AS n FROM long GROUP BY ALL", "feature, class, n", "mean std lo hi"),
)
def _(s, d):
    return T.class_statistics(labelled(s, d)).withColumnsRenamed({"min": "lo", "max": "hi"})


_MADE = (
    "stats AS (SELECT CASE class WHEN 'VEGETATED_DUNES' THEN 'VEG_DUNES' ELSE class END AS class, feature, avg(value) AS mean, stddev_samp(value) AS std FROM long WHERE feature IN ('red', 'green', 'blue', 'nir') GROUP BY ALL)",
    """drawn AS (
  SELECT transect_id, zone_class, m, feature, mean + std * sqrt(-2 * ln((('0x' || substr(h, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)) * cos(2 * pi() * ((('0x' || substr(h, 13, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)) AS v
  FROM (SELECT transect_id, zone_class, m, feature, mean, std, md5('42:' || transect_id || ':' || feature || ':' || m) AS h
    FROM (SELECT DISTINCT transect_id FROM points), (SELECT zone_class, unnest(range(a, b)) AS m FROM (VALUES ('VEG_DUNES', 0, 55), ('BEACH_DRY', 55, 105), ('BEACH_WET', 105, 120), ('WATER', 120, 300)) z(zone_class, a, b)) z
    JOIN stats ON stats.class = z.zone_class)
)""",
    """even AS (
  SELECT transect_id, zone_class, m, feature, least(greatest(sum(v) OVER (PARTITION BY transect_id, zone_class, feature ORDER BY m ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 0.0), 255.0) AS v FROM drawn
)""",
    """made AS (
  SELECT transect_id, zone_class, m::DOUBLE AS distance, red, green, blue, nir - 20 * part AS nir, (red + green + blue + nir) / 4 - 15 * part AS brightness
  FROM (SELECT *, CASE WHEN m >= 105 AND m < 115 THEN 0.5 * (1 + tanh((m - 105) / (4 / 2.5))) ELSE 0 END AS part FROM (
    SELECT transect_id, zone_class, m, max(v) FILTER (feature = 'red') AS red, max(v) FILTER (feature = 'green') AS green, max(v) FILTER (feature = 'blue') AS blue, max(v) FILTER (feature = 'nir') AS nir FROM even GROUP BY ALL))
)""",
)


def made(s, d):
    stats = settle(T.class_statistics(labelled(s, d), list(X.BANDS)), "stats")
    return Y.synthetic_spectra(points(s, d).select(KEY).distinct(), stats, shell=(20.0, 15.0, 4.0)), stats


@query("synthetic_spectra", out(twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG, *_MADE), "SELECT * FROM made", "transect_id, distance, zone_class", "red green blue nir brightness"))
def _(s, d):
    return made(s, d)[0]


@query(
    "synthetic_comparison",
    out(
        twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG, *_MADE, "ml AS (" + " UNION ALL ".join(f"SELECT zone_class, '{b}' AS band, {b} AS v FROM made" for b in X.BANDS) + ")"),
        "SELECT zone_class, band, avg(v) AS made_mean, stddev_pop(v) AS made_std, any_value(mean) AS real_mean, any_value(std) AS real_std, (avg(v) - any_value(mean)) / nullif(any_value(std), 0) AS apart FROM ml JOIN stats ON class = zone_class AND feature = band GROUP BY ALL",
        "zone_class, band", "made_mean made_std real_mean real_std apart",
    ),
)
def _(s, d):
    return Y.compare_spectra(*made(s, d))


def _disc_sql() -> str:
    pick = ", ".join(f"max(CASE WHEN class = '{c}' THEN {x} END) AS {x}_{c}" for c in ("VEGETATED_DUNES", "BEACH_DRY", "BEACH_WET", "WATER") for x in ("n", "m", "v"))
    effects = ", ".join(
        f"abs((m_{a} - m_{b}) / sqrt(((n_{a} - 1) * v_{a} + (n_{b} - 1) * v_{b}) / (n_{a} + n_{b} - 2))) AS {name}_effect" for name, a, b in T.PAIRS
    )
    return f"""SELECT *, (dry_wet_effect + wet_water_effect + veg_dry_effect) / 3 AS overall_discriminability FROM (
SELECT feature, (ssb / (k - 1)) / (ssw / (total - k)) AS f_statistic, {effects} FROM (
SELECT feature, sum(n * (m - g) * (m - g)) AS ssb, sum((n - 1) * v) AS ssw, sum(n) AS total, count(*) AS k, {pick} FROM (
SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM (
SELECT feature, class, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM long WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY feature))"""


@query("discriminability", out(twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG), _disc_sql(), "feature", "f_statistic dry_wet_effect wet_water_effect veg_dry_effect overall_discriminability"))
def _(s, d):
    return T.discriminability(labelled(s, d)).drop("p_value", "rank")


@query(
    "discriminability_ranked",
    twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG) + f"SELECT feature, row_number() OVER (ORDER BY overall_discriminability DESC, feature)::INTEGER AS rank FROM ({_disc_sql()})",
)
def _(s, d):
    return T.discriminability(labelled(s, d)).select("feature", "rank")


@query("anova_p_values")
def _(s, d):
    return T.discriminability(labelled(s, d)).select("feature", "p_value")


@query(
    "separability",
    out(
        twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG),
        "SELECT feature, (max(mean) - min(mean)) / avg(std) AS separability FROM (SELECT feature, class, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY ALL) GROUP BY feature ORDER BY separability DESC, feature LIMIT 15",
        "feature", "separability",
    ),
)
def _(s, d):
    return T.separability(labelled(s, d))


_CORR = "red green blue nir brightness ndvi ndwi nir_ratio variability curvature".split()


@query(
    "correlation_matrix",
    out(twins.featured(), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM feat" for k, a in enumerate(_CORR) for b in _CORR[k:]), "a, b", "r"),
)
def _(s, d):
    return T.correlation_matrix(nums(s, d), _CORR)


@query(
    "five_numbers",
    out(
        twins.featured(fixture.ZONES_SQL, _IN_ZONE, _LONG),
        "SELECT feature, class, min(value) AS lo, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM long GROUP BY ALL",
        "feature, class, n", "lo q1 median q3 hi mean std",
    ),
)
def _(s, d):
    return T.five_numbers(labelled(s, d), _CF).withColumnsRenamed({"min": "lo", "max": "hi"})


_LEVELS = {"nir_ratio": 0.8, "brightness": 195.0, "variability": 10.0, "ndwi": 0.25}


@query(
    "threshold_coverage",
    out(
        twins.featured(),
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {x}::DOUBLE AS level, {', '.join(f'quantile_cont({c}, {p / 100}) AS p{p}' for p in (5, 25, 50, 75, 95))}, 100 * avg((round({c}, 9) >= {x})::INT::DOUBLE) AS pct_covered FROM feat" for c, x in _LEVELS.items()
        ),
        "feature, level", "p5 p25 p50 p75 p95 pct_covered",
    ),
)
def _(s, d):
    return T.threshold_coverage(nums(s, d), _LEVELS)


def _slice(table: str, name: str, inset: float = 0) -> str:
    on = f"p.distance >= z.zstart + {inset} AND p.distance < z.zend - {inset}" if inset else "p.distance BETWEEN z.zstart AND z.zend"
    return f"{name} AS (SELECT p.*, z.zone_order, z.zone_class, z.zstart, z.zend FROM {table} p JOIN zones z ON z.transect_id = p.transect_id AND {on})"


_ZD = "PARTITION BY transect_id, zone_order ORDER BY distance"


_ZONE_STATS = twins.featured(
    fixture.ZONES_SQL, _slice("feat", "sl0"),
    f"sl AS (SELECT *, nir_d1_smooth < -3 AS below FROM sl0)", f"sl1 AS (SELECT *, (below <> lag(below) OVER ({_ZD}))::INT AS ch FROM sl)",
    f"sl2 AS (SELECT *, sum(coalesce(ch, 0)) OVER ({_ZD} ROWS UNBOUNDED PRECEDING) AS run FROM sl1)",
    "lr AS (SELECT transect_id, zone_order, count(*) AS sustained_drops FROM (SELECT transect_id, zone_order, run, count(*) AS c FROM sl2 WHERE below GROUP BY ALL) WHERE c >= 3 GROUP BY ALL)",
    """zs AS (SELECT transect_id, zone_order, zone_class, zstart, zend, count(*) AS num_points, avg(red_d1) AS red_d1_mean, avg(green_d1) AS green_d1_mean, avg(blue_d1) AS blue_d1_mean, avg(nir_d1) AS nir_d1_mean,
  stddev_samp(nir_d1) AS nir_d1_std, min(nir_d1) AS nir_d1_min, max(nir_d1) AS nir_d1_max, count(*) FILTER (below) AS threshold_crossings, stddev_samp(nir) / avg(nir) AS nir_cv,
  stddev_samp(brightness) / avg(brightness) AS brightness_cv, regr_slope(nir, distance) AS nir_slope, regr_r2(nir, distance) AS nir_r_squared, regr_slope(brightness, distance) AS brightness_slope FROM sl GROUP BY ALL)""",
)
_ZONE_DERIVATIVES = """SELECT zs.*, coalesce(sustained_drops, 0) AS sustained_drops, zend - zstart AS span, threshold_crossings / num_points AS crossing_rate,
  greatest(red_d1_mean, green_d1_mean, blue_d1_mean, nir_d1_mean) < 0 OR least(red_d1_mean, green_d1_mean, blue_d1_mean, nir_d1_mean) > 0 AS derivative_alignment
FROM zs LEFT JOIN lr USING (transect_id, zone_order) WHERE num_points >= 3"""


@query(
    "zone_derivatives",
    out(
        _ZONE_STATS,
        _ZONE_DERIVATIVES,
        "transect_id, zone_order, zone_class, num_points, threshold_crossings, sustained_drops, derivative_alignment",
        "red_d1_mean green_d1_mean blue_d1_mean nir_d1_mean nir_d1_std nir_d1_min nir_d1_max nir_cv brightness_cv nir_slope nir_r_squared brightness_slope span crossing_rate",
    ),
)
def _(s, d):
    return T.zone_derivatives(nums(s, d), fixture.manual_zones(s, d)).drop("zone_start", "zone_end")


@query(
    "zone_hypotheses",
    out(
        _ZONE_STATS,
        f"""SELECT zone_class, avg(threshold_crossings) AS mean_crossings, avg(crossing_rate) AS mean_crossing_rate,
  CASE WHEN sum(threshold_crossings) > 0 THEN sum(sustained_drops) / sum(threshold_crossings) ELSE 0 END AS sustained_ratio,
  100 * avg(derivative_alignment::INT::DOUBLE) AS aligned_pct, avg(nir_cv) AS mean_nir_cv FROM ({_ZONE_DERIVATIVES}) GROUP BY zone_class""",
        "zone_class", "mean_crossings mean_crossing_rate sustained_ratio aligned_pct mean_nir_cv",
    ),
)
def _(s, d):
    return T.hypotheses(T.zone_derivatives(nums(s, d), fixture.manual_zones(s, d)))


@query(
    "dominant_frequency",
    out(
        twins.base(
            fixture.ZONES_SQL, _slice("points", "sl"),
            "kx AS (SELECT transect_id, zone_order, distance, nir::DOUBLE AS x, row_number() OVER z - 1 AS k, count(*) OVER (PARTITION BY transect_id, zone_order) AS n FROM sl WHERE zone_class = 'WATER' WINDOW z AS (PARTITION BY transect_id, zone_order ORDER BY distance))",
            "line AS (SELECT transect_id, zone_order, regr_slope(x, k) AS slope, regr_intercept(x, k) AS level, (max(distance) - min(distance)) / (count(*) - 1) AS step FROM kx WHERE n > 10 GROUP BY ALL)",
            "bins AS (SELECT *, unnest(range(1, n // 2)) AS j FROM kx JOIN line USING (transect_id, zone_order))",
            "power AS (SELECT transect_id, zone_order, j, n, step, sum((x - level - slope * k) * cos(2 * pi() * j * k / n)) ** 2 + sum((x - level - slope * k) * sin(2 * pi() * j * k / n)) ** 2 AS p FROM bins GROUP BY ALL)",
        ),
        "SELECT transect_id, zone_order, first(j / (n * step) ORDER BY p DESC, j) AS dominant_frequency FROM power GROUP BY ALL", "transect_id, zone_order", "dominant_frequency",
    ),
)
def _(s, d):
    return T.dominant_frequency(points(s, d), fixture.manual_zones(s, d))


@query(
    "snr_by_zone",
    out(
        twins.base(fixture.ZONES_SQL, _slice("points", "sl"), "bl AS (" + " UNION ALL ".join(f"SELECT transect_id, zone_order, zone_class, '{b}' AS band, {b}::DOUBLE AS v FROM sl" for b in X.BANDS) + ")"),
        "SELECT transect_id, zone_order, zone_class, band, CASE WHEN stddev_pop(v) > 0 THEN 20 * log10(avg(v) / stddev_pop(v)) ELSE 'infinity'::DOUBLE END AS snr_db FROM bl GROUP BY ALL HAVING count(*) >= 5",
        "transect_id, zone_order, zone_class, band", "snr_db",
    ),
)
def _(s, d):
    return T.snr(points(s, d), fixture.manual_zones(s, d))


_INDICES = """(nir::DOUBLE - red) / (nir + red + 1e-10) AS ndvi, (green::DOUBLE - nir) / (green + nir + 1e-10) AS ndwi, nir / (brightness + 1e-10) AS nir_ratio,
red / (green + 1e-10) AS rg_ratio, blue / (red + 1e-10) AS blue_red_ratio"""
_IS_BAND = "band IN ('red', 'green', 'blue', 'nir', 'brightness')"
_SECTION = twins.base(
    fixture.ZONES_SQL, _slice("points", "sl0", 5), f"sl AS (SELECT *, {_INDICES} FROM (SELECT *, (red::DOUBLE + green + blue + nir) / 4 AS brightness FROM sl0))",
    "bl AS (" + " UNION ALL ".join(f"SELECT transect_id, zone_order, zone_class, '{b}' AS band, {b}::DOUBLE AS v FROM sl" for b in (*T.SECTION_BANDS, *T.SECTION_RATIOS)) + ")",
    "mo AS (SELECT transect_id, zone_order, band, avg(v) AS m FROM bl GROUP BY ALL)",
    """prof AS (SELECT bl.transect_id, bl.zone_order, zone_class, bl.band, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi, median(v) AS median,
  quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, avg((v - m) ** 3) / nullif(avg((v - m) ** 2), 0) ** 1.5 AS sk, avg((v - m) ** 4) / nullif(avg((v - m) ** 2), 0) ** 2 - 3 AS ku
  FROM bl JOIN mo USING (transect_id, zone_order, band) GROUP BY ALL)""",
)


def profiles(s, d):
    return T.section_profiles(points(s, d), fixture.manual_zones(s, d))


@query(
    "section_profiles",
    out(
        _SECTION, "SELECT *, q75 - q25 AS iqr, hi - lo AS range, " + f"CASE WHEN {_IS_BAND} THEN std / (mean + 1e-10) END AS cv, CASE WHEN {_IS_BAND} AND n > 3 AND std > 0 THEN sk END AS skewness, CASE WHEN {_IS_BAND} AND n > 3 AND std > 0 THEN ku END AS kurtosis FROM prof",
        "transect_id, zone_order, zone_class, band, n", "mean std lo hi median q25 q75 iqr range cv skewness kurtosis",
    ),
)
def _(s, d):
    return profiles(s, d).withColumnsRenamed({"min": "lo", "max": "hi"})


@query(
    "profile_summary",
    out(
        _SECTION, "SELECT zone_class, band, avg(mean) AS mean_of_means, stddev_samp(mean) AS std_of_means, min(mean) AS min_mean, max(mean) AS max_mean, median(mean) AS median_mean, count(*) AS n_sections FROM prof GROUP BY ALL",
        "zone_class, band, n_sections", "mean_of_means std_of_means min_mean max_mean median_mean",
    ),
)
def _(s, d):
    return T.profile_summary(profiles(s, d))


_SD = "PARTITION BY transect_id, zone_order ORDER BY distance"


@query(
    "section_derivatives",
    out(
        twins.base(
            fixture.ZONES_SQL, _slice("points", "sl0", 5), "sl AS (SELECT *, (red::DOUBLE + green + blue + nir) / 4 AS brightness FROM sl0)", twins.indexed("sl", "si", _SD, "transect_id, zone_order"),
            f"ss AS (SELECT *, {_sg('nir::DOUBLE', _SD)} AS sn, {_sg('brightness', _SD)} AS sb FROM si)",
            f"s1 AS (SELECT *, {twins.grad('sn', w=_SD)} AS n1, {twins.grad('sb', w=_SD)} AS b1 FROM ss)", f"s2 AS (SELECT *, {twins.grad('n1', w=_SD)} AS n2 FROM s1)",
        ),
        """SELECT transect_id, zone_order, zone_class, count(*) AS n, max(distance) - min(distance) AS length_m, CASE WHEN count(*) > 5 THEN stddev_pop(brightness) END AS variability,
avg(n1) AS nir_d1_mean, stddev_samp(n1) AS nir_d1_std, min(n1) AS nir_d1_min, max(n1) AS nir_d1_max, avg(n2) AS nir_d2_mean, stddev_samp(n2) AS nir_d2_std,
avg(b1) AS brightness_d1_mean, stddev_samp(b1) AS brightness_d1_std FROM s2 GROUP BY ALL""",
        "transect_id, zone_order, zone_class, n", "length_m variability nir_d1_mean nir_d1_std nir_d1_min nir_d1_max nir_d2_mean nir_d2_std brightness_d1_mean brightness_d1_std",
    ),
)
def _(s, d):
    return T.section_derivatives(points(s, d), fixture.manual_zones(s, d))


@query(
    "class_zone_statistics",
    out(
        twins.base(
            fixture.ZONES_SQL, _slice("points", "sl0", 5), "sl1 AS (SELECT *, (red::DOUBLE + green + blue + nir) / 4 AS brightness FROM sl0)",
            """sl AS (SELECT *, CASE WHEN nir + red > 0 THEN (nir::DOUBLE - red) / (nir + red) ELSE 0 END AS ndvi, CASE WHEN green + nir > 0 THEN (green::DOUBLE - nir) / (green + nir) ELSE 0 END AS ndwi,
CASE WHEN brightness > 0 THEN nir / brightness ELSE 0 END AS nir_ratio, CASE WHEN red > 0 THEN blue::DOUBLE / red ELSE 0 END AS blue_red_ratio FROM sl1)""",
            "bl AS (" + " UNION ALL ".join(f"SELECT zone_class, '{c}' AS feature, {c}::DOUBLE AS v FROM sl" for c in "red green blue nir brightness ndvi ndwi nir_ratio blue_red_ratio".split())
            + " UNION ALL SELECT zone_class, 'variability', stddev_samp(brightness) FROM sl GROUP BY zone_class, transect_id, zone_order HAVING count(*) > 5)",
        ),
        "SELECT zone_class, feature, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM bl GROUP BY ALL", "zone_class, feature, n", "mean std lo hi",
    ),
)
def _(s, d):
    return T.class_zone_statistics(points(s, d), fixture.manual_zones(s, d)).withColumnsRenamed({"min": "lo", "max": "hi"})


@query(
    "section_correlations",
    out(
        _SECTION, "SELECT transect_id, zone_order, zone_class, count(*) AS n, " + ", ".join(f"corr({a}::DOUBLE, {b}::DOUBLE) AS corr_{a}_{b}" for a, b in (("red", "green"), ("red", "nir"), ("green", "nir"), ("blue", "nir")))
        + " FROM sl GROUP BY ALL HAVING count(*) > 3", "transect_id, zone_order, zone_class, n", "corr_red_green corr_red_nir corr_green_nir corr_blue_nir",
    ),
)
def _(s, d):
    return T.section_correlations(points(s, d), fixture.manual_zones(s, d))


_AROUND = """around AS (SELECT f.*, m.seq, m.manual_type, m.position, f.distance - m.position AS off FROM feat f JOIN manual m ON m.transect_id = f.transect_id AND abs(f.distance - m.position) <= 10)"""


@query(
    "boundary_profile",
    out(
        twins.featured(fixture.ZONES_SQL, twins.MANUAL_SQL, _AROUND, "bl AS (" + " UNION ALL ".join(f"SELECT manual_type, off, '{b}' AS band, {b}::DOUBLE AS v FROM around" for b in X.BANDS) + ")"),
        'SELECT manual_type, off AS "offset", band, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n FROM bl GROUP BY ALL', 'manual_type, "offset", band, n', "mean std",
    ),
)
def _(s, d):
    return T.boundary_profile(points(s, d), manual(s, d))


_BC = [f"{b}_{x}" for b in X.BANDS for x in ("before", "after")]


@query(
    "boundary_changes",
    out(
        twins.featured(fixture.ZONES_SQL, twins.MANUAL_SQL, _AROUND),
        "SELECT *, " + ", ".join(f"{b}_after - {b}_before AS {b}_change, CASE WHEN {b}_before <> 0 THEN 100 * ({b}_after - {b}_before) / {b}_before END AS {b}_change_pct" for b in X.BANDS)
        + " FROM (SELECT transect_id, seq, manual_type, " + ", ".join(f"avg({b}) FILTER (off < 0) AS {b}_before, avg({b}) FILTER (off >= 0) AS {b}_after" for b in X.BANDS)
        + ", avg(nir_d1) AS nir_d1_mean, max(abs(nir_d1)) AS nir_d1_max_abs, max(abs(nir_d2_w5)) AS nir_d2_max_abs, count(*) AS n FROM around GROUP BY ALL)",
        "transect_id, seq, manual_type, n", " ".join(_BC + [f"{b}_change{x}" for b in X.BANDS for x in ("", "_pct")]) + " nir_d1_mean nir_d1_max_abs nir_d2_max_abs",
    ),
)
def _(s, d):
    return T.boundary_changes(nums(s, d), manual(s, d))


_TW = "PARTITION BY transect_id, seq ORDER BY distance"
_TR = (*X.BANDS, "brightness", "rg_ratio")
_TRANSITION = twins.base(
    fixture.ZONES_SQL, twins.MANUAL_SQL,
    "ta AS (SELECT p.*, m.seq, m.manual_type, m.position, p.distance - m.position AS off, (red::DOUBLE + green + blue + nir) / 4 AS brightness FROM points p JOIN manual m ON m.transect_id = p.transect_id AND abs(p.distance - m.position) <= 10)",
    f"tb AS (SELECT *, {_INDICES} FROM ta)", twins.indexed("tb", "tc0", _TW, "transect_id, seq"), "tc AS (SELECT * FROM tc0 WHERE n >= 5)",
    f"td AS (SELECT *, {', '.join(f'{_sg(f'{b}::DOUBLE', _TW)} AS s_{b}' for b in _TR)} FROM tc)",
    f"te AS (SELECT *, {', '.join(f'{twins.grad(f's_{b}', w=_TW)} AS e_{b}' for b in _TR)} FROM td)",
    f"tf AS (SELECT *, {twins.grad('e_nir', w=_TW)} AS d2, {', '.join(f'round(e_{b}, 9) AS d_{b}' for b in _TR)} FROM te)",
    # the group of a run of steep samples: its number minus the number of steep samples so far
    f"tg AS (SELECT *, coalesce(d_nir < -3, false) AS steep, i - sum(coalesce(d_nir < -3, false)::INT) OVER ({_TW} ROWS UNBOUNDED PRECEDING) AS isle FROM tf)",
    "tr AS (SELECT transect_id, seq, max(k) AS longest_run FROM (SELECT transect_id, seq, isle, count(*) AS k FROM tg WHERE steep GROUP BY ALL) GROUP BY ALL)",
    "tm AS (SELECT transect_id, seq, manual_type, position, max(n) AS n, " + ", ".join(f"avg({c}::DOUBLE) FILTER (off < 0) AS {c}_before, avg({c}::DOUBLE) FILTER (off >= 0) AS {c}_after" for c in T.SIDES)
    + ", " + ", ".join(f"(array_agg(distance ORDER BY d_{b}, distance))[1] AS at_{b}" for b in (*X.BANDS, "brightness"))
    + """, (array_agg(i ORDER BY d_nir, distance))[1] AS p, min(d_nir) AS nir_d1_min, min(d_brightness) AS brightness_d1_min, min(d_rg_ratio) AS rg_ratio_d1_min,
  stddev_pop(brightness) FILTER (off < 0) AS brightness_std_before, stddev_pop(brightness) FILTER (off >= 0) AS brightness_std_after, max(abs(d2)) AS nir_d2_max_abs,
  (array_agg(d2 ORDER BY abs(off), distance))[1] AS nir_d2_at_boundary, (array_agg(rg_ratio ORDER BY abs(off), distance))[1] AS rg_ratio_at_boundary FROM tg GROUP BY ALL)""",
    """tn AS (SELECT g.transect_id, g.seq, min(g.distance) FILTER (nir < round(nir_before - 0.2::DOUBLE * abs(nir_before - nir_after), 9)) AS a20,
  min(g.distance) FILTER (nir < round(nir_before - 0.8::DOUBLE * abs(nir_before - nir_after), 9)) AS a80, avg(abs(d_nir)) FILTER (i - p BETWEEN -3 AND -1) AS lft, avg(abs(d_nir)) FILTER (i - p BETWEEN 1 AND 3) AS rgt
  FROM tg g JOIN tm USING (transect_id, seq) GROUP BY ALL)""",
    "tt AS (SELECT tm.*, " + ", ".join(f"{c}_before - {c}_after AS {name}" for c, name in T.SIDES.items())
    + """, CASE WHEN abs(nir_before - nir_after) > 5 THEN a80 - a20 END AS width, CASE WHEN p > 2 AND p < n - 2 AND rgt > 0 THEN lft / rgt END AS asymmetry,
  (SELECT stddev_pop(x) FROM (SELECT unnest([at_red, at_green, at_blue, at_nir]) AS x)) AS band_synchrony, coalesce(longest_run, 0) AS longest_run,
  CASE WHEN brightness_std_before > 0 THEN brightness_std_after / brightness_std_before END AS variability_ratio
  FROM tm JOIN tn USING (transect_id, seq) LEFT JOIN tr USING (transect_id, seq) WHERE nir_before IS NOT NULL AND nir_after IS NOT NULL)""",
)
_TRANSITION_COLUMNS = [f"{c}_{x}" for c in T.SIDES for x in ("before", "after")] + [*T.SIDES.values()] + [f"at_{b}" for b in (*X.BANDS, "brightness")] + (
    "nir_d1_min brightness_d1_min rg_ratio_d1_min brightness_std_before brightness_std_after nir_d2_max_abs nir_d2_at_boundary rg_ratio_at_boundary width asymmetry band_synchrony variability_ratio"
).split()


@query("transition_characteristics", out(_TRANSITION, "SELECT * FROM tt", "transect_id, seq, manual_type, longest_run", " ".join(["position", *_TRANSITION_COLUMNS])))
def _(s, d):
    return T.transition_characteristics(points(s, d), manual(s, d))


_TS = "nir_drop nir_d1_min width asymmetry band_synchrony variability_ratio longest_run brightness_drop nir_ratio_change rg_ratio_change nir_d2_max_abs rg_ratio_at_boundary rg_ratio_d1_min".split()


@query(
    "transition_summary",
    out(
        _TRANSITION, "SELECT manual_type, feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, count(v) AS n FROM ("
        + " UNION ALL ".join(f"SELECT manual_type, '{c}' AS feature, {c}::DOUBLE AS v FROM tt" for c in _TS) + ") GROUP BY ALL", "manual_type, feature, n", "mean std lo hi",
    ),
)
def _(s, d):
    return T.transition_summary(T.transition_characteristics(points(s, d), manual(s, d)), _TS).withColumnsRenamed({"min": "lo", "max": "hi"})


_MS = (1, 3, 5, 7, 9, 11)
_MW = "PARTITION BY manual_type, detected ORDER BY off"


@query(
    "multiscale_profiles",
    out(
        twins.matched(
            "flagged AS (SELECT *, EXISTS (SELECT 1 FROM matches x WHERE x.label = 'TP' AND x.transect_id = m.transect_id AND abs(x.detected_position - m.position) < 10) AS detected FROM manual m)",
            "mp AS (SELECT manual_type, detected, p.distance - f.position AS off, avg(nir) AS m FROM points p JOIN flagged f ON f.transect_id = p.transect_id AND abs(p.distance - f.position) <= 15 GROUP BY ALL)",
            f"mi AS (SELECT *, row_number() OVER ({_MW}) - 1 AS i, count(*) OVER (PARTITION BY manual_type, detected) AS n FROM mp)",
            f"mu AS (SELECT *, {', '.join(f'{twins.uniform('m', z, _MW)} AS u{z}' for z in _MS)} FROM mi)",
            f"mg AS (SELECT manual_type, detected, {', '.join(f'abs({twins.grad(f'u{z}', 'off', _MW)}) AS g{z}' for z in _MS)} FROM mu)",
        ),
        f"""SELECT *, CASE WHEN detected IS NOT NULL AND missed IS NOT NULL THEN CASE WHEN missed > 0 THEN detected / missed ELSE 'infinity'::DOUBLE END END AS ratio FROM (
{' UNION ALL '.join(f'SELECT manual_type, {z} AS size, max(g{z}) FILTER (detected) AS detected, max(g{z}) FILTER (NOT detected) AS missed FROM mg GROUP BY manual_type' for z in _MS)})""",
        "manual_type, size", "detected missed ratio",
    ),
)
def _(s, d):
    return T.multiscale_profiles(points(s, d), M.detected_flags(manual(s, d), matches(s, d)))


def _kernel(weights: str, half: int) -> str:
    """A sum of neighbours, end values repeated; weights in terms of k."""
    return f"list_sum(list_transform(range({-half}, {half + 1}), lambda k: {weights} * x[greatest(1, least(n, i + k))]))"


_SMOOTH = {
    "uniform_3": f"floor({_kernel('1', 1)} / 3 + 1e-9)",
    "gaussian_2": f"floor({_kernel('exp(-k * k / 8.0::DOUBLE)', 8)} / list_sum(list_transform(range(-8, 9), lambda k: exp(-k * k / 8.0::DOUBLE))) + 1e-9)",
    "savgol_5_2": _kernel("[-3, 12, 17, 12, -3][k + 3] / 35.0::DOUBLE", 2),
    "median_5": "list_median(list_transform(range(-2, 3), lambda k: x[greatest(1, least(n, i + k))]))",
}


@query(
    "smoothing_methods",
    out(
        twins.base(
            fixture.ZONES_SQL, twins.MANUAL_SQL,
            "near AS (SELECT p.transect_id, seq, list(nir::DOUBLE ORDER BY distance) AS x, list(distance ORDER BY distance) AS d, count(*) AS n FROM points p JOIN manual m ON p.transect_id = m.transect_id AND abs(distance - position) <= 20 WHERE manual_type LIKE 'VEGETATED_DUNE%' GROUP BY ALL HAVING count(*) >= 10)",
            "sm AS (" + " UNION ALL ".join(f"SELECT transect_id, seq, d, n, '{k}' AS method, list_transform(range(1, n + 1), lambda i: {v}) AS v FROM near" for k, v in _SMOOTH.items()) + ")",
            "flat AS (SELECT transect_id, seq, method, unnest(v) AS v, unnest(d) AS d FROM sm)",
            "side AS (SELECT *, lag(v) OVER o AS vm, lead(v) OVER o AS vp, d - lag(d) OVER o AS h0, lead(d) OVER o - d AS h1 FROM flat WINDOW o AS (PARTITION BY transect_id, seq, method ORDER BY d))",
        ),
        """SELECT transect_id, seq, method, max(abs(CASE WHEN h0 IS NULL THEN (vp - v) / h1 WHEN h1 IS NULL THEN (v - vm) / h0
  ELSE (h0 * h0 * vp + (h1 * h1 - h0 * h0) * v - h1 * h1 * vm) / (h0 * h1 * (h0 + h1)) END)) AS max_abs_gradient FROM side GROUP BY ALL""",
        "transect_id, seq, method", "max_abs_gradient",
    ),
)
def _(s, d):
    return T.smoothing_methods(points(s, d), manual(s, d))


_WIN = """win0 AS (SELECT f.*, m.label, m.detected_position AS centre FROM feat f JOIN matches m ON m.transect_id = f.transect_id AND m.detected_position IS NOT NULL AND abs(f.distance - m.detected_position) <= 5),
win AS (SELECT transect_id, centre, label, """ + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in ("nir_d1_smooth", "nir", "brightness", "ndvi", "ndwi")) + """,
  min(nir_d1_smooth) AS nir_d1_min, max(variability) AS variability_max, avg(variability) AS variability_mean, arg_min(nir, distance) - arg_max(nir, distance) AS nir_drop FROM win0 GROUP BY ALL)"""


@query("window_features", out(twins.matched(_WIN), "SELECT * FROM win", "transect_id, centre, label", " ".join(T.WINDOW_FEATURES)))
def _(s, d):
    return T.window_features(nums(s, d), matches(s, d))


@query(
    "tp_fp_comparison",
    out(
        twins.matched(_WIN, "wl AS (" + " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c}::DOUBLE AS value FROM win" for c in T.WINDOW_FEATURES) + ")"),
        """SELECT *, tp_mean - fp_mean AS difference, coalesce(CASE WHEN n1 > 0 AND n2 > 0 AND sqrt(((n1 - 1) * tp_std * tp_std + (n2 - 1) * fp_std * fp_std) / (n1 + n2 - 2)) > 0
  THEN abs((tp_mean - fp_mean) / sqrt(((n1 - 1) * tp_std * tp_std + (n2 - 1) * fp_std * fp_std) / (n1 + n2 - 2))) ELSE 0 END, 0) AS effect_size FROM (
SELECT feature, avg(value) FILTER (label = 'TP') AS tp_mean, stddev_samp(value) FILTER (label = 'TP') AS tp_std, avg(value) FILTER (label = 'FP') AS fp_mean, stddev_samp(value) FILTER (label = 'FP') AS fp_std,
  count(value) FILTER (label = 'TP') AS n1, count(value) FILTER (label = 'FP') AS n2 FROM wl GROUP BY feature) WHERE n2 > 0""",
        "feature", "tp_mean tp_std fp_mean fp_std difference effect_size",
    ),
)
def _(s, d):
    return T.compare_tp_fp(T.window_features(nums(s, d), matches(s, d)), T.WINDOW_FEATURES)


# ---------------------------------------------------------------- lines and tiles

_LINES = twins.chain(fixture.LINES_SQL)


@query("line_directions", _LINES + "SELECT transect_id, CASE WHEN transect_id % 3 = 0 THEN 'west_to_east' ELSE 'east_to_west' END AS direction FROM ids")
def _(s, d):
    return G.directions(fixture.lines(s, d))


@query(
    "line_reprojection",
    "WITH "
    + fixture.LINES_SQL
    + """, earth AS (
  SELECT 6378137.0::DOUBLE AS a, n, sqrt(f * (2 - f)) AS e, 0.9996::DOUBLE * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS radius, sqrt(g * (2 - g)) AS ge
  FROM (SELECT f / (2 - f) AS n, f, g FROM (SELECT 1 / 298.257223563::DOUBLE AS f, 1 / 298.257222101::DOUBLE AS g))
), utm AS (
  SELECT transect_id, k, (y + 4000000) / radius AS xi, x / radius AS eta FROM vertex, earth
), flat AS (
  SELECT transect_id, k, n, e,
    xi - (n/2 - 2*n**2/3 + 37*n**3/96 - n**4/360) * sin(2*xi) * cosh(2*eta) - (n**2/48 + n**3/15 - 437*n**4/1440) * sin(4*xi) * cosh(4*eta)
       - (17*n**3/480 - 37*n**4/840) * sin(6*xi) * cosh(6*eta) - 4397*n**4/161280 * sin(8*xi) * cosh(8*eta) AS p,
    eta - (n/2 - 2*n**2/3 + 37*n**3/96 - n**4/360) * cos(2*xi) * sinh(2*eta) - (n**2/48 + n**3/15 - 437*n**4/1440) * cos(4*xi) * sinh(4*eta)
       - (17*n**3/480 - 37*n**4/840) * cos(6*xi) * sinh(6*eta) - 4397*n**4/161280 * cos(8*xi) * sinh(8*eta) AS q
  FROM utm, earth
), degrees AS (
  SELECT transect_id, k, atan2(sinh(q), cos(p)) + radians(-9.0) AS lam,
    chi + (2*n - 2*n**2/3 - 2*n**3 + 116*n**4/45) * sin(2*chi) + (7*n**2/3 - 8*n**3/5 - 227*n**4/45) * sin(4*chi)
        + (56*n**3/15 - 136*n**4/35) * sin(6*chi) + 4279*n**4/630 * sin(8*chi) AS phi
  FROM (SELECT *, asin(sin(p) / cosh(q)) AS chi FROM flat)
), cone AS (
  SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS c FROM (
    SELECT a, ge, cos(radians(49)) / sqrt(1 - (ge * sin(radians(49))) ** 2) AS m1, cos(radians(44)) / sqrt(1 - (ge * sin(radians(44))) ** 2) AS m2,
      tan(pi()/4 - radians(49)/2) / ((1 - ge * sin(radians(49))) / (1 + ge * sin(radians(49)))) ** (ge/2) AS t1,
      tan(pi()/4 - radians(44)/2) / ((1 - ge * sin(radians(44))) / (1 + ge * sin(radians(44)))) ** (ge/2) AS t2,
      tan(pi()/4 - radians(46.5)/2) / ((1 - ge * sin(radians(46.5))) / (1 + ge * sin(radians(46.5)))) ** (ge/2) AS t0
    FROM earth)
), laid AS (
  SELECT transect_id, k, c, lam, a * m1 / (c * t1 ** c) * (tan(pi()/4 - phi/2) / ((1 - ge * sin(phi)) / (1 + ge * sin(phi))) ** (ge/2)) ** c AS r, a * m1 / (c * t1 ** c) * t0 ** c AS r0
  FROM degrees, cone
)
SELECT transect_id, k, round(700000 + r * sin(c * (lam - radians(3))), 3) AS x, round(6600000 + r0 - r * cos(c * (lam - radians(3))), 3) AS y FROM laid
""",
)
def line_reprojection(s, d):
    utm = fixture.lines(s, d).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] + 500_000).alias("x"), (p["y"] + 4_000_000).alias("y"))))
    moved = G.reproject(utm, "EPSG:32629", "urn:ogc:def:crs:EPSG::2154")
    # outer: else a filter on the points is inferred, and they are worked out for it too
    return moved.select(KEY, F.posexplode_outer("points").alias("k", "p")).select(KEY, "k", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("line_points", out(_LINES, "SELECT * FROM dense", "transect_id", "distance x y"))
def _(s, d):
    return G.densify(fixture.lines(s, d)).drop("ord")


@query(
    "tile_overlap",
    _LINES
    + """SELECT DISTINCT transect_id, raster_id, raster_id AS priority FROM seg, tile
WHERE greatest(0, least((l - x0) / nullif(x1 - x0, 0), (r - x0) / nullif(x1 - x0, 0)), least((b - y0) / nullif(y1 - y0, 0), (t - y0) / nullif(y1 - y0, 0)))
   <= least(1, greatest((l - x0) / nullif(x1 - x0, 0), (r - x0) / nullif(x1 - x0, 0)), greatest((b - y0) / nullif(y1 - y0, 0), (t - y0) / nullif(y1 - y0, 0)))
  AND (x1 <> x0 OR x0 BETWEEN l AND r) AND (y1 <> y0 OR y0 BETWEEN b AND t)""",
)
def _(s, d):
    return G.overlapping_tiles(fixture.lines(s, d), fixture.tiles(s, d), 100.0)


@query(
    "line_samples",
    out(
        twins.chain(
            fixture.LINES_SQL,
            """px AS (SELECT transect_id, distance, raster_id, floor(t - y)::BIGINT * 7 + floor(x - l)::BIGINT * 3 + raster_id AS v FROM dense JOIN tile ON x BETWEEN l AND r AND y BETWEEN b AND t
  WHERE floor(t - y) BETWEEN 0 AND 100 AND floor(x - l) BETWEEN 0 AND 49)""",
            "good AS (SELECT *, row_number() OVER (PARTITION BY transect_id, distance ORDER BY raster_id) AS rn FROM px WHERE v % 251 <> 0 AND v * 2 % 251 <> 0 AND v * 3 % 251 <> 0 AND v * 5 % 251 <> 0)",
        ),
        "SELECT transect_id, distance, (v % 251)::INT AS red, (v * 2 % 251)::INT AS green, (v * 3 % 251)::INT AS blue, (v * 5 % 251)::INT AS nir FROM good WHERE rn = 1",
        "transect_id, red, green, blue, nir", "distance",
    ),
)
def _(s, d):
    return G.sample_transects(fixture.lines(s, d), fixture.tiles(s, d), fixture.pixels(s, d), "west_to_east").drop("ord")


@query(
    "evenly_spaced",
    _LINES + "SELECT transect_id FROM (SELECT transect_id, row_number() OVER (ORDER BY transect_id) - 1 AS p, count(*) OVER () AS n FROM ids) WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda j: (j * (n - 1)) // 4), p)",
)
def _(s, d):
    return G.evenly_spaced(fixture.lines(s, d))


@query("random_transects")
def _(s, d):
    return G.random_transects(fixture.lines(s, d), 10, 321197).select(KEY)


# ------------------------------------------------------------------- plot tables


@query("class_spans", out(twins.classed(twins.RUNS_SQL), _SEGMENTS, 'transect_id, "start", "end", predicted_class', "centroid"))
def _(s, d):
    return writers.class_spans(K.segments(classes(s, d)))


@query(
    "band_range",
    out(
        twins.base("v AS (" + " UNION ALL ".join(f"SELECT transect_id, {b}::DOUBLE AS v FROM points" for b in X.BANDS) + ")"),
        "SELECT transect_id, quantile_cont(v, 0.01) - 20 AS low, quantile_cont(v, 0.99) + 20 AS high FROM v GROUP BY 1", "transect_id", "low high",
    ),
)
def _(s, d):
    return writers.band_range(points(s, d))


@query(
    "run_summary",
    twins.detected()
    + """SELECT transect_id, map_from_entries(list({'k': predicted_class, 'v': n} ORDER BY predicted_class))::VARCHAR AS classes, CAST(sum(n) AS BIGINT) AS points, any_value(lo) AS "start", any_value(hi) AS "end", coalesce(any_value(tr), 0) AS transitions
FROM (SELECT transect_id, predicted_class, count(*) AS n FROM smooth GROUP BY ALL) JOIN ends USING (transect_id) LEFT JOIN (SELECT transect_id, count(*) AS tr FROM final GROUP BY 1) USING (transect_id) GROUP BY transect_id""",
)
def _(s, d):
    classed = settled(s, d)
    c = writers.summary(classed, unmerged(s, d, classed))
    entries = F.transform(F.array_sort(F.map_entries("classes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return c.withColumn("classes", F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")))
