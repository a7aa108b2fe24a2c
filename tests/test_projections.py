"""Projections against published points, and lines that go wrong one by one."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tiff import pixels, written
from tideline.operators import geometry as G
from tideline.operators import projections as P
from tideline.plans import workflows
from tideline.sources import readers


def one(spark, xy, *values):
    x, y = xy(*[F.lit(float(v)) for v in values])
    return tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first())


def test_published_points(spark):
    """The worked examples of the guidance note on coordinate conversions."""
    airy, clarke = P.Ellipsoid(6377563.396, 299.32496), P.Ellipsoid(6378206.4 * 3937 / 1200, 294.97870)
    grid = P.TransverseMercator(-2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0, airy)
    assert one(spark, grid.forward, 0.5, 50.5) == pytest.approx((577274.99, 69740.50), abs=0.01)
    assert one(spark, grid.back, 577274.99, 69740.50) == pytest.approx((0.5, 50.5), abs=1e-7)
    texas = P.LambertConic(28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99.0, 2_000_000.0, 0.0, on=clarke)
    assert one(spark, texas.forward, -96.0, 28.5) == pytest.approx((2963503.91, 254759.80), abs=0.01)
    assert one(spark, texas.back, 2963503.91, 254759.80) == pytest.approx((-96.0, 28.5), abs=1e-7)
    web = P.system("EPSG:3857")
    assert one(spark, web.forward, -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600) == pytest.approx((-11169055.58, 2800000.00), abs=0.01)


@pytest.mark.parametrize("name, lon, lat", [("EPSG:32629", -9.5, 42.1), ("EPSG:32733", 17.2, -33.9), ("EPSG:25830", -1.1, 59.0), ("EPSG:6343", -96.4, 28.2), ("EPSG:26910", -124.0, 0.0), ("EPSG:2154", 5.5, 43.3), ("EPSG:3946", 1.2, 46.3), ("EPSG:3034", 25.0, 61.0), ("EPSG:3347", -60.0, 47.5), ("EPSG:3857", 151.2, -33.9), ("EPSG:4326", 1.0, 2.0)])
def test_round_trips_stay_under_a_millimetre(spark, name, lon, lat):
    s = P.system(name)
    x, y = one(spark, s.forward, lon, lat)
    back = one(spark, s.back, x, y)
    metres = math.hypot((back[0] - lon) * 111_320 * math.cos(math.radians(lat)), (back[1] - lat) * 111_320)
    assert metres < 1e-3
    again = one(spark, s.forward, *back)
    assert math.dist(again, (x, y)) < 1e-3


def test_conic_with_one_parallel_and_southern_cone(spark):
    for s in (P.LambertConic(46.0, 46.0, 46.0, 3.0, 1e6, 2e6, 0.9999), P.LambertConic(-20.0, -36.0, -30.0, 25.0, 0.0, 0.0)):
        at = s.lon0 + 2.0, s.lat0 + 1.5
        assert one(spark, s.back, *one(spark, s.forward, *at)) == pytest.approx(at, abs=1e-9)
        assert one(spark, s.forward, s.lon0, s.lat0) == pytest.approx((s.east, s.north), abs=1e-6)


def test_plane_to_plane(spark):
    """By way of degrees: the same as in two steps; equal systems are left alone."""
    lines = spark.createDataFrame([(1, [(500_000.0, 4_600_000.0), (501_000.0, 4_600_500.0)])], "transect_id long, points array<struct<x:double,y:double>>")
    there = G.reproject(lines, "EPSG:32630", "EPSG:3946")
    back = G.reproject(there, "urn:ogc:def:crs:EPSG::3946", "EPSG:32630").first()["points"]
    assert [tuple(p) for p in back] == [pytest.approx(p, abs=1e-3) for p in [(500_000.0, 4_600_000.0), (501_000.0, 4_600_500.0)]]
    assert G.reproject(lines, "EPSG:99999", "urn:ogc:def:crs:EPSG::99999") is lines
    for a, b in (("EPSG:31370", "EPSG:4326"), ("EPSG:4326", "local"), (None, "EPSG:4326"), ("EPSG:4326", "")):
        with pytest.raises(ValueError):
            G.reproject(lines, a, b)


def test_names_of_systems(spark, tmp_path):
    assert [P.epsg(n) for n in ("EPSG:4326", "urn:ogc:def:crs:EPSG::25829", "urn:ogc:def:crs:EPSG:9.8:2154", "urn:ogc:def:crs:OGC:1.3:CRS84", "local", None)] == [4326, 25829, 2154, 4326, None, None]
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "b.json").write_text('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::6343"}}, "features": []}')
    assert [readers.geojson_crs(spark, str(tmp_path / f)) for f in ("a.json", "b.json")] == ["EPSG:4326", "EPSG:6343"]


# ------------------------------------------------------------- what goes wrong singly


def collection(path, features, crs=None):
    out = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": p} for t, c, p in features]}
    path.write_text(json.dumps(out | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})))


LEFT, TOP = 500_000.0, 4_600_037.0


def shore(spark, tmp_path, broken, degrees=False):
    """Results of an analysis of three lines and ``broken`` ones."""
    folder = tmp_path / f"tiles{len(broken)}"
    folder.mkdir()
    x = pixels("u2", seed=4)
    (folder / "a.tif").write_bytes(written(x, left=LEFT, top=TOP, compression=5, predictor=2, tile=(16, 16)))
    if broken:
        (folder / "b.tif").write_bytes(b"II* no raster")
    ways = [[[LEFT + 0.5, TOP - r], [LEFT + 38.8, TOP - r]] for r in (5.5, 12.5, 30.5)]
    if degrees:
        inverse = P.system("EPSG:32629")
        ways = [[list(one(spark, inverse.back, *p)) for p in w] for w in ways]
    good = [("LineString", w, {"TransectID": k}) for k, w in enumerate(ways)]
    lines = tmp_path / f"lines{len(broken)}{degrees}.json"
    collection(lines, [*good, *broken], None if degrees else "urn:ogc:def:crs:EPSG::32629")
    out = tmp_path / f"out{len(broken)}{degrees}"
    classed, _ = workflows.analyze_all_transects(spark, str(folder), str(lines), str(out), "all", visualize=2)
    rows = sorted(map(tuple, classed.select("transect_id", "distance", "red", "green", "blue", "nir", "predicted_class", "confidence").collect()))
    problems = spark.read.csv(str(out / "problems"), header=True).collect() if list((out / "problems").glob("*.csv")) else []
    return rows, {(r["transect_id"] and int(r["transect_id"]), r["stage"]): r["reason"] for r in problems}, x, out


BROKEN = [
    ("Point", [1.0, 2.0], {"TransectID": 10}),
    ("LineString", [[1.0, 2.0]], {"TransectID": 11}),
    ("LineString", [[1.0, 2.0], [1.0]], {"TransectID": 12}),
    ("LineString", [[LEFT + 900, TOP], [LEFT + 950, TOP]], {"TransectID": 13}),
    ("LineString", [[LEFT, TOP - 1], [LEFT + 9, TOP - 1]], {}),
    ("LineString", [[LEFT, TOP - 1], [LEFT + 9, TOP - 1]], {"TransectID": 14}),
    ("LineString", [[LEFT, TOP - 2], [LEFT + 9, TOP - 2]], {"TransectID": 14}),
]


def test_broken_lines_and_tiles_leave_the_others_unchanged(spark, tmp_path):
    alone, none, x, out = shore(spark, tmp_path, [])
    assert none == {} and {r[0] for r in alone} == {0, 1, 2}
    assert alone[7][2:6] == tuple(x[:, 5, 7].tolist())
    assert spark.read.csv(str(out / "plot_points"), header=True).select("TransectID").distinct().count() == 2
    rows, problems, *_ = shore(spark, tmp_path, BROKEN)
    assert rows == alone
    stages = {(10, "read"), (11, "read"), (12, "read"), (None, "read"), (14, "read"), (13, "sample"), (None, "raster")}
    assert set(problems) == stages
    assert problems[10, "read"] == "not a LineString" and problems[13, "sample"] == "no pixel under the line" and "b.tif" in problems[None, "raster"]


def test_lines_in_degrees_are_brought_to_the_tiles(spark, tmp_path):
    """Without a system a GeoJSON is in degrees; samples are those of the plane lines."""
    rows, problems, *_ = shore(spark, tmp_path, [], degrees=True)
    (tmp_path / "plane").mkdir()
    plane, *_ = shore(spark, tmp_path / "plane", [])
    assert problems == {} and len(rows) == len(plane)
    assert np.mean([a[2:6] == b[2:6] for a, b in zip(rows, plane)]) > 0.99


def test_unreadable_blocks_are_listed(spark, tmp_path):
    x = pixels("u2", seed=4)
    raw = bytearray(written(x, left=LEFT, top=TOP, compression=8))
    raw[8:30] = b"\0" * 22  # the first three rows
    (tmp_path / "a.tif").write_bytes(bytes(raw))
    lines = tmp_path / "lines.json"
    collection(lines, [("LineString", [[LEFT + 0.5, TOP - r], [LEFT + 38.5, TOP - r]], {"TransectID": k}) for k, r in enumerate((1.5, 12.5))], "EPSG:32629")
    classed, _ = workflows.analyze_all_transects(spark, str(tmp_path), str(lines), str(tmp_path / "out"), "all")
    assert {r[0] for r in classed.select("transect_id").distinct().collect()} == {1}
    reasons = [r["reason"] for r in spark.read.csv(str(tmp_path / "out/problems"), header=True).where("transect_id = 0").collect()]
    assert len(reasons) == 2 and any("39 samples" in r for r in reasons)


def test_samples_from_east_to_west_ascend(spark):
    lines = spark.createDataFrame([(1, [(30.5, 1.5), (0.5, 1.5), (0.5, 1.5)])], "transect_id long, points array<struct<x:double,y:double>>")
    tiles = spark.createDataFrame([(0, 0, 0.0, 5.0, 1.0, 40, 5, None)], "raster_id int, priority int, left double, top double, res double, width int, height int, nodata int")
    cells = spark.range(200).selectExpr("0 raster_id", "id div 40 row", "id % 40 col", "1 red", "1 green", "1 blue", "cast(id as int) nir")
    got, problems = G.sample_lines(lines, tiles, cells)
    by_ord = [r["distance"] for r in got.orderBy("ord").collect()]
    assert by_ord == sorted(by_ord) == [float(k) for k in range(31)] and problems.count() == 0
