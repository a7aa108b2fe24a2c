"""Readers and the whole workflow on files written here."""

import json
import struct

import numpy as np
import pytest

from tideline.operators import matching as M
from tideline.plans import workflows
from tideline.sources import readers, writers


def tiff(path, pixels, left, top, res=1.0, epsg=32629, nodata=None):
    """A plain strip TIFF of four interleaved byte bands."""
    bands, h, w = pixels.shape
    data = pixels.transpose(1, 2, 0).astype(np.uint8).tobytes()
    extra, tags = b"", []
    base = 8 + len(data)

    def add(code, kind, values, letter):
        nonlocal extra
        raw = values if kind == 2 else struct.pack("<" + letter * len(values), *values)
        n = len(values)
        if len(raw) <= 4:
            tags.append((code, kind, n, raw.ljust(4, b"\0")))
        else:
            tags.append((code, kind, n, struct.pack("<I", base + len(extra))))
            extra += raw

    add(256, 3, [w], "H"), add(257, 3, [h], "H"), add(258, 3, [8] * bands, "H"), add(259, 3, [1], "H"), add(262, 3, [1], "H")
    add(273, 4, [8], "I"), add(277, 3, [bands], "H"), add(278, 3, [h], "H"), add(279, 4, [len(data)], "I"), add(284, 3, [1], "H")
    add(33550, 12, [res, res, 0.0], "d"), add(33922, 12, [0.0, 0.0, 0.0, left, top, 0.0], "d")
    add(34735, 3, [1, 1, 0, 1, 3072, 0, 1, epsg], "H")
    if nodata is not None:
        add(42113, 2, str(nodata).encode() + b"\0", "")
    at = base + len(extra)
    entries = b"".join(struct.pack("<HHI", c, k, n) + v for c, k, n, v in sorted(tags))
    path.write_bytes(b"II*\0" + struct.pack("<I", at) + data + extra + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0))


@pytest.fixture()
def world(tmp_path):
    rng = np.random.default_rng(0)
    folder = tmp_path / "tiles"
    folder.mkdir()
    a, b = rng.integers(1, 250, (4, 20, 20)), rng.integers(1, 250, (4, 20, 20))
    a[:, 5, 5] = 0
    tiff(folder / "a.tif", a, 0.0, 20.0, nodata=0)
    tiff(folder / "b.tiff", b, 19.0, 20.0, nodata=0)
    features = [
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": c}, "properties": {"TransectID": t}}
        for t, c in ((2, [[1.5, 10.5], [30.2, 10.5]]), (1, [[0.5, 14.5], [18.5, 14.5]]))
    ]
    lines = tmp_path / "lines.json"
    lines.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32629"}}, "features": features}))
    return folder, lines, a, b


def test_rasters_lines_and_samples(spark, world, tmp_path):
    from tideline.operators import geometry as G

    folder, lines, a, b = world
    meta = readers.check_rasters(readers.raster_meta(spark, str(folder)))
    assert [(r["width"], r["bands"], r["crs"], r["nodata"]) for r in meta.collect()] == [(20, 4, "EPSG:32629", 0.0)] * 2
    found = readers.transects_geojson(spark, str(lines))
    assert [r["transect_id"] for r in found.collect()] == [1, 2]
    got = G.sample_transects(found, meta, readers.raster_pixels(spark, str(folder), meta))
    few = G.sample_transects(found, meta, readers.pixels_of(spark, str(folder), meta))
    assert sorted(tuple(r) for r in few.collect()) == sorted(tuple(r) for r in got.collect())
    one = {r["distance"]: r for r in got.where("transect_id = 1").collect()}
    assert 5.0 not in one and one[4.0]["red"] == a[0, 5, 4]  # the nodata pixel is skipped
    two = {r["distance"]: r for r in got.where("transect_id = 2").collect()}
    assert two[18.0]["nir"] == a[3, 9, 19] and two[19.0]["nir"] == b[3, 9, 1]  # the first tile wins the overlap
    classed, kept = workflows.analyze_all_transects(spark, str(folder), str(lines), str(tmp_path / "out"), "all")
    assert classed.select("transect_id").distinct().count() == 2
    assert spark.read.csv(str(tmp_path / "out/points"), header=True).count() == classed.count()
    total = spark.read.json(str(tmp_path / "out/summary_overall")).collect()[0]
    assert (total["transects"], total["points"], sum(total["class_distribution"].asDict().values())) == (2, classed.count(), classed.count())


def test_training_workflow(spark, world, tmp_path):
    folder, lines, *_ = world
    samples = workflows.training_samples(spark, str(folder), str(lines), str(tmp_path / "t"), 1, 5)
    assert samples.select("transect_id").distinct().count() == 1
    meta = spark.read.json(str(tmp_path / "t/metadata")).collect()[0]
    assert (meta["transects_available"], meta["samples_processed"], meta["random_seed"]) == (2, 1, 5)
    one = spark.read.json(str(tmp_path / "t/transects")).collect()
    assert len(one) == 1 and one[0]["points"] == spark.read.csv(str(tmp_path / "t/points"), header=True).count()


def test_manual_zone_lines(spark):
    rows = ["transectID,start[m],end[m],CLASS,WAVE_CREST_POSITIONS", "1,0,10.5,VEGETATED_DUNES,NA", "1,10.5,20,WATER,[12.5, 14]", "2,0,5,BEACH_DRY", "3,0,4,WATER, [1"]
    got = readers.parse_zones(spark.createDataFrame([(r,) for r in rows], "value string")).orderBy("transect_id", "start").collect()
    assert [(r["transect_id"], r["end"], r["zone_class"], r["wave_crests"]) for r in got] == [
        (1, 10.5, "VEGETATED_DUNES", None), (1, 20.0, "WATER", [12.5, 14.0]), (2, 5.0, "BEACH_DRY", None), (3, 4.0, "WATER", [1.0]),
    ]


def test_log_lines_belong_to_the_last_transect(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "[1/2] Processing transect 7\nRejected at 45.0m: NIR drop too small\nDetected 3 zone boundaries\nFiltered 5 -> 2 transitions\n"
        "Selected shell line at 61.0m conf=0.81 mode=strict\n[2/2] Processing transect 9\nRejected at 12.0m: brightness too low\n"
    )
    report = workflows.run_log_analysis(spark, str(tmp_path / "run.log"), str(tmp_path / "report"))
    assert {(r["section"], r["name"]): r["value"] for r in report.collect()}["overall", "detected_pct"] == 50
    assert spark.read.csv(str(tmp_path / "report/rejections"), header=True).count() == 2
    got = {r["transect_id"]: r for r in readers.log_summary(readers.read_log(spark, str(tmp_path / "run.log"))).collect()}
    assert (got[7]["selected_at"], got[7]["mode"], got[7]["filtered"], got[7]["boundaries"], got[7]["rejected_nir_drop"]) == (61.0, "strict", 3, 3, 1)
    assert got[9]["selected_at"] is None and got[9]["rejected_brightness"] == 1


def test_log_report_and_text(spark, tmp_path):
    found = spark.createDataFrame(
        [(7, 61.0, 0.8, "strict", 3, 3, 1, 1), (8, 50.0, 0.6, "fallback", 4, 1, 2, 0), (9, None, None, None, 1, None, 0, 0)],
        "transect_id long, selected_at double, confidence double, mode string, boundaries int, filtered long, rejections long, rejected_distance long",
    )
    report = readers.log_report(found)
    got = {(r["section"], r["name"]): r["value"] for r in report.collect()}
    assert got["overall", "detected"] == 2 and got["overall", "detected_pct"] == pytest.approx(200 / 3)
    assert got["confidence", "mean"] == pytest.approx(0.7) and got["attrition", "attrition_pct"] == pytest.approx(75)
    assert got["mode_pct", "strict"] == 50 and got["modes", "fallback"] == 1
    assert got["rejections", "total"] == 3 and got["rejections", "per_transect"] == 1 and got["rejections", "distance"] == 1
    writers.text_report("Log", report, str(tmp_path / "log"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert "ATTRITION" in lines and any(x.startswith("attrition_pct") and x.endswith("75.000") for x in lines)
    empty = readers.log_report(found.limit(0))
    assert {(r["section"], r["name"]): r["value"] for r in empty.collect()}["overall", "detected_pct"] is None


def test_shell_line_report(spark, tmp_path):
    verdicts = spark.createDataFrame([(1, 60.0, 61.0, 1.0, 0.8, "CORRECT"), (2, 60.0, None, None, None, "FALSE_NEGATIVE")], "transect_id long, manual_location double, detected_location double, error_m double, confidence double, result string")
    writers.shell_line_report(verdicts, M.shell_line_metrics(verdicts), str(tmp_path))
    assert spark.read.csv(str(tmp_path / "results"), header=True).count() == 2
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert any(x.startswith("FALSE_NEGATIVE") and x.endswith("1.000") for x in lines) and any(x.startswith("recall") and x.endswith("0.500") for x in lines)


def test_csv_priority_and_json(spark, tmp_path):
    head = "TransectID,distance,red,green,blue,nir\n"
    (tmp_path / "a.csv").write_text(head + "1,0.0,1,2,3,4\n")
    (tmp_path / "b.csv").write_text(head + "1,0.0,9,9,9,9\n2,0.0,5,6,7,8\n")
    got = readers.samples_by_priority(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("transect_id").collect()
    assert [(r["transect_id"], r["red"]) for r in got] == [(1, 1), (2, 5)]
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"transect_id": 3, "boundary_info": {"DRY_WET": {"distance": 55.0}}}, {"transect_id": 4, "boundary_info": {}}]}))
    assert [tuple(r) for r in readers.detections_json(spark, str(tmp_path / "d.json")).collect()] == [(3, 55.0)]


def test_validation_workflow(spark, tmp_path):
    from tideline.plans import fixture

    sf = "/root/testdata/sf0.001"
    tables = workflows.run_all_validations(fixture.spectral_points(spark, sf), fixture.manual_zones(spark, sf), str(tmp_path / "v"))
    m = tables["transition_matches"]
    assert m.where("label <> 'FN'").count() + 0 == m.where("label in ('TP', 'FP')").count()
    assert spark.read.csv(str(tmp_path / "v/threshold_sensitivity"), header=True).count() == 30
    assert spark.read.csv(str(tmp_path / "v/shell_line/results"), header=True).count() == M.first_dry_wet(fixture.manual_zones(spark, sf)).count()
    analysed = workflows.run_feature_analysis(fixture.spectral_points(spark, sf), fixture.manual_zones(spark, sf), str(tmp_path / "f"))
    assert analysed["section_profiles"].count() == 10 * analysed["section_derivatives"].count()
    assert spark.read.csv(str(tmp_path / "f/class_zone_statistics"), header=True).where("feature = 'variability'").count() > 0
