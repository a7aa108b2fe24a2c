"""SQL twins of the queries, built from named steps (common table expressions)."""

from __future__ import annotations

from .fixture import IRREGULAR, REGULAR, ZONES_SQL

W = "PARTITION BY transect_id ORDER BY distance"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
EPS = "1e-10"
BANDS = ("red", "green", "blue", "nir")


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def grad(f: str, d: str = "distance", w: str = W) -> str:
    fm, fp, dm, dp = f"lag({f}) OVER ({w})", f"lead({f}) OVER ({w})", f"lag({d}) OVER ({w})", f"lead({d}) OVER ({w})"
    h0, h1 = f"({d} - {dm})", f"({dp} - {d})"
    return (
        f"CASE WHEN {dm} IS NULL THEN ({fp} - {f}) / {h1} WHEN {dp} IS NULL THEN ({f} - {fm}) / {h0} "
        f"ELSE ({h0} * {h0} * {fp} + ({h1} * {h1} - {h0} * {h0}) * {f} - {h1} * {h1} * {fm}) / ({h0} * {h1} * ({h0} + {h1})) END"
    )


def grad1(f: str, w: str = W) -> str:
    fm, fp = f"lag({f}) OVER ({w})", f"lead({f}) OVER ({w})"
    return f"CASE WHEN {fm} IS NULL THEN {fp} - {f} WHEN {fp} IS NULL THEN {f} - {fm} ELSE ({fp} - {fm}) / 2 END"


def frame(a: int, b: int, w: str = W) -> str:
    def side(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"({w} ROWS BETWEEN {side(a)} AND {side(b)})"


def uniform(f: str, s: int, w: str = W) -> str:
    k = s // 2
    return (
        f"((sum({f}) OVER {frame(-k, k, w)} + greatest(0, {k} - i) * first_value({f}) OVER ({w} {ALL}) "
        f"+ greatest(0, {k} - (n - 1 - i)) * last_value({f}) OVER ({w} {ALL})) / {s})"
    )


def indexed(source: str, name: str, w: str = W, key: str = "transect_id") -> str:
    return f"{name} AS (SELECT *, row_number() OVER ({w}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source})"


def peaks(source: str, x: str, name: str, prominence: float, width: float | None) -> str:
    """Positions p of peaks of column x: runs of equal values, then the nearest higher
    samples on both sides, then the lowest sample up to them."""
    half = ""
    wide = ""
    if width is not None:
        half = f""", {name}_low AS (
  SELECT k.transect_id, k.p, k.x, k.prom, max(CASE WHEN q.i < k.p THEN q.i END) AS a, min(CASE WHEN q.i > k.p THEN q.i END) AS b
  FROM {name}_prom k JOIN {source} q ON q.transect_id = k.transect_id AND q.{x} <= k.x - k.prom / 2 GROUP BY ALL
), {name}_wide AS (
  SELECT k.*, (CASE WHEN xb < h THEN b - (h - xb) / (xb1 - xb) ELSE b END) - (CASE WHEN xa < h THEN a + (h - xa) / (xa1 - xa) ELSE a END) AS width
  FROM (SELECT k.transect_id, k.p, k.a, k.b, k.x - k.prom / 2 AS h, k.prom, qa.{x} AS xa, qa1.{x} AS xa1, qb.{x} AS xb, qb1.{x} AS xb1
        FROM {name}_low k JOIN {source} qa ON qa.transect_id = k.transect_id AND qa.i = k.a
        JOIN {source} qa1 ON qa1.transect_id = k.transect_id AND qa1.i = k.a + 1
        JOIN {source} qb ON qb.transect_id = k.transect_id AND qb.i = k.b
        JOIN {source} qb1 ON qb1.transect_id = k.transect_id AND qb1.i = k.b - 1) k
)"""
        wide = f" JOIN (SELECT transect_id, p FROM {name}_wide WHERE width >= {width}) USING (transect_id, p)"
    return f"""
{name}_run0 AS (SELECT transect_id, i, {x} AS x, CASE WHEN {x} = lag({x}) OVER ({W}) THEN 0 ELSE 1 END AS fresh, distance FROM {source}),
{name}_run1 AS (SELECT *, sum(fresh) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM {name}_run0),
{name}_run AS (SELECT transect_id, run, min(i) AS s, max(i) AS e, min(x) AS x FROM {name}_run1 GROUP BY transect_id, run),
{name}_near AS (
  SELECT *, lag(x) OVER (PARTITION BY transect_id ORDER BY run) AS xl, lead(x) OVER (PARTITION BY transect_id ORDER BY run) AS xr FROM {name}_run
), {name}_top AS (SELECT transect_id, (s + e) // 2 AS p, x FROM {name}_near WHERE x > xl AND x > xr),
{name}_side AS (
  SELECT k.transect_id, k.p, k.x, coalesce(max(CASE WHEN q.i < k.p THEN q.i END), -1) AS l, coalesce(min(CASE WHEN q.i > k.p THEN q.i END), 1000000000) AS h
  FROM {name}_top k LEFT JOIN {source} q ON q.transect_id = k.transect_id AND q.{x} > k.x GROUP BY ALL
), {name}_prom AS (
  SELECT transect_id, p, x, x - greatest(a, b) AS prom FROM (
    SELECT k.transect_id, k.p, k.x, min(CASE WHEN q.i <= k.p THEN q.{x} END) AS a, min(CASE WHEN q.i >= k.p THEN q.{x} END) AS b
    FROM {name}_side k JOIN {source} q ON q.transect_id = k.transect_id AND q.i > k.l AND q.i < k.h GROUP BY k.transect_id, k.p, k.x)
){half}, {name} AS (SELECT transect_id, p FROM {name}_prom{wide} WHERE prom >= {prominence})"""


def features(source: str = "points") -> str:
    norm = " * ".join(["sqrt(" + " + ".join(f"{b}::DOUBLE * {b}" for b in BANDS) + ")", "sqrt(" + " + ".join(f"l{b} * l{b}" for b in BANDS) + ")"])
    dot = " + ".join(f"{b}::DOUBLE * l{b}" for b in BANDS)
    lags = ", ".join(f"lag({b}::DOUBLE) OVER ({W}) AS l{b}" for b in BANDS)
    d1 = ", ".join(f"{grad(f'{b}::DOUBLE')} AS {b}_d1" for b in BANDS)
    us = ", ".join(f"floor({uniform('nir::DOUBLE', s)}) AS u{s}" for s in (5, 7, 9, 11))
    return f"""
{indexed(source, 'f0')},
f1 AS (
  SELECT *, (nir::DOUBLE - red) / (nir + red + {EPS}) AS ndvi, (green::DOUBLE - nir) / (green + nir + {EPS}) AS ndwi,
    (red::DOUBLE + green + blue + nir) / 4 AS brightness, nir / ((red::DOUBLE + green + blue) / 3 + {EPS}) AS nir_ratio,
    blue / (red + {EPS}) AS blue_red_ratio, red / (green + {EPS}) AS red_green_ratio, (red::DOUBLE + green + blue) / 3 AS rgb, {lags} FROM f0
), f2 AS (
  SELECT *, {d1}, {grad('brightness')} AS brightness_d1, {grad('red_green_ratio')} AS rg_ratio_d1, {us}, {uniform('rgb', 7)} AS rgb7,
    stddev_samp(brightness) OVER {frame(-3, 3)} AS variability,
    max(brightness) OVER {frame(-3, 3)} - min(brightness) OVER {frame(-3, 3)} AS local_range,
    CASE WHEN count(*) OVER {frame(-3, 3)} < 3 THEN 0.0 ELSE regr_slope(brightness, i::DOUBLE) OVER {frame(-3, 3)} END AS slope,
    {grad1('brightness')} AS c1,
    CASE WHEN lred IS NULL OR {norm} = 0 THEN 0.0 ELSE degrees(acos(least(1.0, greatest(-1.0, ({dot}) / ({norm} + {EPS}))))) END AS spectral_angle FROM f1
), f3 AS (
  SELECT *, {', '.join(f"{uniform(f'{b}_d1', 3)} AS {b}_d1_smooth" for b in BANDS)}, {uniform('rg_ratio_d1', 5)} AS rg_ratio_d1_smooth,
    {grad1('c1')} AS curvature, {', '.join(f"{grad(f'u{s}')} AS nir_d1_w{s}" for s in (5, 7, 9, 11))} FROM f2
), f4 AS (SELECT *, {', '.join(f"{grad(f'nir_d1_w{s}')} AS nir_d2_w{s}" for s in (5, 7, 9))} FROM f3),
{peaks('f4', 'brightness', 'osc', 5.0, None)},
{peaks('f4', 'rgb7', 'foam', 10.0, 2.0)},
osc_at AS (SELECT DISTINCT transect_id, unnest(range(p - 3, p + 3)) AS i FROM osc),
feat AS (
  SELECT f4.*, o.i IS NOT NULL AS has_oscillations, m.p IS NOT NULL AS has_rgb_foam_peak
  FROM f4 LEFT JOIN osc_at o ON o.transect_id = f4.transect_id AND o.i = f4.i LEFT JOIN foam m ON m.transect_id = f4.transect_id AND m.p = f4.i
)"""


CLASSES_SQL = """
ruled AS (
  SELECT *, CASE
      WHEN nir_ratio <= 0.35 AND (ndwi > 0.60 OR blue_red_ratio > 0.95 OR nir_ratio < 0.30) THEN 'WATER'
      WHEN nir_ratio > 0.40 AND nir_ratio < 0.70 AND ndwi >= 0.25 AND brightness <= 195 THEN 'BEACH_WET'
      WHEN nir_ratio >= 0.80 AND brightness >= 195 AND coalesce(variability <= 10, false) THEN 'DRY_BEACH'
      WHEN nir_ratio >= 0.80 AND coalesce(variability >= 15, false) AND brightness <= 190 THEN 'VEG_DUNES'
      WHEN nir_ratio < 0.35 AND coalesce(variability > 20, false) AND has_oscillations THEN 'WAVE_CRESTS'
      ELSE 'UNKNOWN' END AS raw_class FROM feat
), classed AS (
  SELECT *, CASE raw_class
      WHEN 'WATER' THEN least(0.85 + CASE WHEN ndwi > 0.60 THEN 0.05 ELSE 0 END + CASE WHEN blue_red_ratio > 0.95 THEN 0.05 ELSE 0 END + CASE WHEN nir_ratio < 0.25 THEN 0.05 ELSE 0 END, 0.95)
      WHEN 'BEACH_WET' THEN least(greatest(0.70 + CASE WHEN ndwi > 0.35 THEN 0.10 ELSE 0 END - CASE WHEN nir_ratio < 0.45 OR nir_ratio > 0.65 THEN 0.10 ELSE 0 END, 0.60), 0.85)
      WHEN 'DRY_BEACH' THEN least(0.80 + CASE WHEN brightness > 205 THEN 0.05 ELSE 0 END + CASE WHEN variability < 5 THEN 0.05 ELSE 0 END, 0.90)
      WHEN 'VEG_DUNES' THEN least(0.70 + CASE WHEN variability > 25 THEN 0.10 ELSE 0 END + CASE WHEN has_oscillations THEN 0.05 ELSE 0 END, 0.85)
      WHEN 'WAVE_CRESTS' THEN 0.65 ELSE 0.30 END::DOUBLE AS class_confidence FROM ruled
), coded AS (
  SELECT *, CASE raw_class WHEN 'VEG_DUNES' THEN 0 WHEN 'DRY_BEACH' THEN 1 WHEN 'BEACH_WET' THEN 2 WHEN 'WATER' THEN 3 WHEN 'WAVE_CRESTS' THEN 4 ELSE 5 END AS code FROM classed
), triple AS (
  SELECT *, coalesce(lag(code) OVER (PARTITION BY transect_id ORDER BY distance), code) AS ca, coalesce(lead(code) OVER (PARTITION BY transect_id ORDER BY distance), code) AS cb FROM coded
), smooth AS (
  SELECT *, ['VEG_DUNES', 'DRY_BEACH', 'BEACH_WET', 'WATER', 'WAVE_CRESTS', 'UNKNOWN'][ca + code + cb - greatest(ca, code, cb) - least(ca, code, cb) + 1] AS predicted_class FROM triple
)"""

_RUNS = f"""
fresh AS (SELECT *, CASE WHEN predicted_class <> lag(predicted_class) OVER ({W}) THEN 1 ELSE 0 END AS fresh FROM smooth),
runs AS (SELECT *, sum(fresh) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM fresh)"""


def _detect(drop=39, bright=175, bright_nir=135) -> str:
    past, future = frame(-5, -1), frame(0, 4)
    nir = "nir::DOUBLE"
    return f"""
near AS (
  SELECT *, lag(nir_d2_w7) OVER ({W}) AS va, lead(nir_d2_w7) OVER ({W}) AS vb,
    avg({nir}) OVER {frame(-10, -1)} AS m1, avg({nir}) OVER {frame(0, 9)} AS m2,
    NOT coalesce(nir_d1_w5 > lag(nir_d1_w5) OVER ({W}), false) AND NOT coalesce(nir_d1_w5 > lead(nir_d1_w5) OVER ({W}), false) AS is_min,
    CASE WHEN i >= 5 THEN avg({nir}) OVER {past} - nir ELSE 0.0 END AS ndrop,
    CASE WHEN i >= 5 THEN avg(brightness) OVER {past} ELSE 0.0 END AS bb,
    CASE WHEN i >= 5 THEN avg({nir}) OVER {past} ELSE 0.0 END AS nb,
    CASE WHEN i >= 5 AND i < n - 5 THEN avg(variability) OVER {future} / (avg(variability) OVER {past} + 1e-6) ELSE 0.0 END AS vr,
    coalesce(max(nir_d1_w5) OVER {frame(0, 2)} < -8 AND count(nir_d1_w5) OVER {frame(0, 2)} = 3, false) AS hold,
    (nir_d1_smooth < -8)::INT + (red_d1_smooth < -8 * 0.85)::INT + (green_d1_smooth < -8 * 0.80)::INT + (blue_d1_smooth < -8 * 0.75)::INT AS bands
  FROM smooth
), veg AS (
  SELECT transect_id, i, distance, 'inflection_point' AS detection_method, least(0.65 + abs(va - vb) / 10, 0.85) AS confidence, abs(va - vb) AS magnitude
  FROM near WHERE va * vb < 0 AND abs(va - vb) > 1.0 AND least(n, i + 10) - greatest(0, i - 10) >= 10 AND m1 > m2 + 20
), surf AS (
  SELECT transect_id, i, distance, 'rgb_foam_peak' AS detection_method,
         least(0.82::DOUBLE + CASE WHEN rg_ratio_d1_smooth < -0.01 THEN 0.03 ELSE 0 END, 0.90) AS confidence, nir_d1_w7 AS magnitude
  FROM near WHERE has_rgb_foam_peak AND nir_d1_w7 < -2
), cand AS (SELECT *, abs(nir_d1_w5) AS g FROM near WHERE nir_d1_w5 < -8 AND nir > 50 AND is_min),
strict0 AS (
  SELECT *, least(greatest(0.50 + (g - 8) / 30, 0.50), 0.70) + CASE WHEN g > 12 THEN 0.10 ELSE 0 END + CASE WHEN ndrop > 50 THEN 0.08 ELSE 0 END
    + CASE WHEN i >= 5 AND bb - brightness > 25 THEN 0.05 ELSE 0 END + CASE WHEN vr > 4 THEN 0.07 ELSE 0 END + CASE WHEN hold THEN 0.08 ELSE 0 END
    + CASE WHEN bands >= 3 THEN 0.08 ELSE 0 END + CASE WHEN red_green_ratio BETWEEN 0.95 AND 1.15 THEN 0.05 ELSE 0 END
    + CASE WHEN distance BETWEEN 40 AND 120 THEN 0.05 ELSE 0 END - CASE WHEN distance BETWEEN 40 AND 70 AND ndrop < 50 THEN 0.20 ELSE 0 END
    - CASE WHEN ndrop < {drop} THEN 0.15 * ({drop} - ndrop) / {drop} ELSE 0 END - CASE WHEN bb > 0 AND bb < {bright} THEN 0.10 * ({bright} - bb) / {bright} ELSE 0 END
    - CASE WHEN nb > 0 AND nb < {bright_nir} THEN 0.10 * ({bright_nir} - nb) / {bright_nir} ELSE 0 END - CASE WHEN vr > 0 AND vr < 1.5 THEN 0.08 * (1.5 - vr) / 1.5 ELSE 0 END AS c0
  FROM cand WHERE red_green_ratio BETWEEN 0.90 AND 1.20 AND NOT (distance BETWEEN 40 AND 70 AND vr < 1.0)
), strict AS (SELECT *, least(greatest(c0, 0.30), 0.95) AS confidence FROM strict0 WHERE least(greatest(c0, 0.30), 0.95) >= 0.60),
relaxed0 AS (
  SELECT *, least(least(greatest(0.40 + (g - 8) / 40, 0.40), 0.60) + CASE WHEN g > 10 THEN 0.08 ELSE 0 END + CASE WHEN ndrop > 30 THEN 0.06 ELSE 0 END
    + CASE WHEN vr > 3 THEN 0.05 ELSE 0 END + CASE WHEN distance BETWEEN 40 AND 120 THEN 0.05 ELSE 0 END
    - CASE WHEN distance BETWEEN 40 AND 70 AND ndrop < 40 THEN 0.15 ELSE 0 END, 0.85) AS confidence
  FROM cand WHERE distance BETWEEN 30 AND 250 AND NOT (i >= 5 AND (ndrop < 20 OR bb < 160 OR nb < 100)) AND NOT (i >= 5 AND i < n - 5 AND vr < 1.2)
), relaxed AS (SELECT * FROM relaxed0 WHERE confidence >= 0.40),
pool0 AS (
  SELECT transect_id, i, distance, 'derivative_magnitude' AS detection_method, confidence, nir_d1_w5 AS magnitude, true AS st FROM strict
  UNION ALL SELECT transect_id, i, distance, 'derivative_magnitude_relaxed', confidence, nir_d1_w5, false FROM relaxed
), pool1 AS (
  SELECT *, bool_or(st) OVER t AS any_s, bool_or(st AND distance BETWEEN 30 AND 250) OVER t AS any_in,
    bool_or(st AND distance BETWEEN 40 AND 120) OVER t AS any_zone, bool_or(NOT st AND distance BETWEEN 40 AND 120) OVER t AS relaxed_zone
  FROM pool0 WINDOW t AS (PARTITION BY transect_id)
), pool AS (
  SELECT * FROM pool1 WHERE CASE WHEN any_zone THEN st AND distance BETWEEN 40 AND 120
    ELSE NOT st AND (distance BETWEEN 40 AND 120 OR NOT relaxed_zone) AND (NOT any_s OR any_in) END
), best AS (
  SELECT transect_id, i, distance, detection_method, confidence, magnitude, CASE WHEN any_zone THEN 'strict' ELSE 'fallback' END AS detection_mode
  FROM (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY confidence DESC, distance) AS rn FROM pool)
  WHERE rn = 1 AND confidence >= CASE WHEN any_zone THEN 0.60 ELSE 0.50 END
), found AS (
  SELECT *, NULL::VARCHAR AS detection_mode FROM veg UNION ALL SELECT *, NULL::VARCHAR FROM surf UNION ALL SELECT * FROM best
), known AS (
  SELECT transect_id, i, n, last_value(k IGNORE NULLS) OVER {frame(-9, 0)} AS fc, first_value(k IGNORE NULLS) OVER {frame(1, 9)} AS tc
  FROM (SELECT *, nullif(predicted_class, 'UNKNOWN') AS k FROM smooth)
), informed0 AS (
  SELECT found.*, CASE WHEN i > 0 AND i < n - 1 THEN coalesce(fc, 'UNKNOWN') END AS from_class, CASE WHEN i > 0 AND i < n - 1 THEN coalesce(tc, 'UNKNOWN') END AS to_class
  FROM found JOIN known USING (transect_id, i)
), informed AS (
  SELECT * REPLACE (CASE WHEN
      (from_class IN ('VEG_DUNES', 'DRY_BEACH', 'BEACH_WET') AND to_class IN ('WATER', 'WAVE_CRESTS'))
      OR (to_class IN ('VEG_DUNES', 'DRY_BEACH', 'BEACH_WET') AND from_class IN ('WATER', 'WAVE_CRESTS'))
      OR (from_class = 'DRY_BEACH' AND to_class = 'BEACH_WET') OR (to_class = 'DRY_BEACH' AND from_class = 'BEACH_WET')
      THEN least(confidence + 0.1, 0.95) ELSE confidence END AS confidence), from_class || '->' || to_class AS boundary_type
  FROM informed0
), ends AS (SELECT transect_id, min(distance) AS lo, max(distance) AS hi FROM points GROUP BY 1),
final AS (
  SELECT informed.* FROM informed JOIN ends USING (transect_id)
  WHERE confidence >= CASE WHEN detection_mode = 'fallback' THEN 0.50 ELSE 0.75 END AND distance BETWEEN lo + 10 AND hi - 10
    AND coalesce(from_class, 'UNKNOWN') <> coalesce(to_class, 'UNKNOWN')
)"""


FEATURES_SQL = features()
DETECT_SQL = _detect()

MANUAL_SQL = """
manual AS (
  SELECT transect_id, zend AS position, zone_class || '_to_' || nxt AS manual_type, CAST(rn AS INTEGER) AS seq FROM (
    SELECT *, lead(zone_class) OVER (PARTITION BY transect_id ORDER BY zstart) AS nxt, row_number() OVER (PARTITION BY transect_id ORDER BY zstart) AS rn FROM zones
  ) WHERE nxt IS NOT NULL
)"""

MATCH_SQL = """
det AS (SELECT transect_id, i AS det, detection_method, distance AS p, confidence, boundary_type FROM final),
pairs AS (
  SELECT d.*, m.seq, m.position, m.manual_type, abs(d.p - m.position) AS err FROM det d JOIN manual m
  ON d.transect_id = m.transect_id AND abs(d.p - m.position) <= 5
), bestm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transect_id, det, detection_method ORDER BY err, seq) AS rn FROM pairs) WHERE rn = 1),
matches AS (
  SELECT transect_id, p AS detected_position, 'TP' AS label, position AS manual_position, manual_type, err AS distance_error, boundary_type AS detected_type, confidence FROM bestm
  UNION ALL
  SELECT transect_id, p, 'FP', NULL, NULL, NULL, boundary_type, confidence FROM det ANTI JOIN bestm USING (transect_id, det, detection_method)
  UNION ALL
  SELECT transect_id, NULL, 'FN', position, manual_type, NULL, NULL, NULL FROM manual ANTI JOIN pairs USING (transect_id, seq)
)"""


def chain(*steps: str) -> str:
    return "WITH " + ",\n".join(s.strip() for s in steps) + "\n"


def base(*more: str, irregular: bool = False) -> str:
    return chain(IRREGULAR if irregular else REGULAR, *more)


def featured(*more: str, irregular: bool = False) -> str:
    return base(FEATURES_SQL, *more, irregular=irregular)


def classed(*more: str) -> str:
    return featured(CLASSES_SQL, *more)


def detected(*more: str, **levels) -> str:
    return classed(_detect(**levels) if levels else DETECT_SQL, *more)


#: Detections of one method less than five metres from an anchor; the anchor moves on by
#: as many rows as were merged.
_MERGE = """found1 AS (
  SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY distance, CASE detection_method WHEN 'inflection_point' THEN 0 WHEN 'rgb_foam_peak' THEN 1 ELSE 2 END, i) - 1 AS k FROM found0
), jump AS (
  SELECT a.transect_id, a.k, count(*) AS size, first(b.k ORDER BY b.confidence DESC, b.k) AS best FROM found1 a JOIN found1 b
  ON a.transect_id = b.transect_id AND b.k >= a.k AND b.distance - a.distance < 5 AND a.detection_method = b.detection_method GROUP BY ALL
), walk AS (
  SELECT transect_id, k FROM found1 WHERE k = 0 UNION ALL SELECT w.transect_id, w.k + j.size FROM walk w JOIN jump j ON w.transect_id = j.transect_id AND w.k = j.k
), found AS (
  SELECT f.* EXCLUDE (k) FROM walk w JOIN jump j ON w.transect_id = j.transect_id AND w.k = j.k JOIN found1 f ON f.transect_id = j.transect_id AND f.k = j.best
)"""


def merged(*more: str) -> str:
    """As ``detected``, with near detections merged before classes are looked up."""
    detect = DETECT_SQL.replace("found AS (", "found0 AS (").replace("), known AS (", f"), {_MERGE}, known AS (")
    return recursive(classed(detect, *more))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def matched(*more: str) -> str:
    return detected(ZONES_SQL, MANUAL_SQL, MATCH_SQL, *more)


RUNS_SQL = _RUNS
