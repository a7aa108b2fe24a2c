"""Made-up spectra and logs read in many splits."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import synthetic as Y
from tideline.sources import readers

STATS = [(c, b, m, s) for c, m, s in (("VEGETATED_DUNE", 60.0, 8.0), ("VEGETATED_DUNES", 80.0, 12.0), ("BEACH_DRY", 180.0, 10.0), ("BEACH_WET", 120.0, 15.0), ("WATER", 30.0, 4.0)) for b in Y.BANDS]


def stats(spark):
    return spark.createDataFrame(STATS, "class string, feature string, mean double, std double")


def test_rows_do_not_depend_on_partitions(spark):
    ids = spark.range(40).withColumnRenamed("id", "transect_id")
    one = Y.synthetic_spectra(ids.coalesce(1), stats(spark), shell=(10.0, 5.0, 4.0))
    many = Y.synthetic_spectra(ids.repartition(13).where("transect_id % 2 = 1"), stats(spark), shell=(10.0, 5.0, 4.0))
    want = {(r["transect_id"], r["distance"]): tuple(r) for r in one.collect()}
    got = {(r["transect_id"], r["distance"]): tuple(r) for r in many.collect()}
    assert len(want) == 40 * 300 and got == {k: v for k, v in want.items() if k[0] % 2}
    other = Y.synthetic_spectra(ids, stats(spark), seed=43).where("transect_id = 1 and distance = 60").first()
    assert other["red"] != want[1, 60.0][3]


def test_draws_are_normal(spark):
    z = Y.normal(7, F.col("id"), "red", F.lit(1))
    r = spark.range(200_000).select(z.alias("z")).agg(F.avg("z"), F.stddev("z"), F.skewness("z"), F.kurtosis("z"), F.avg((F.abs("z") < 1.96).cast("double"))).first()
    assert abs(r[0]) < 0.01 and abs(r[1] - 1) < 0.01 and abs(r[2]) < 0.03 and abs(r[3]) < 0.06 and abs(r[4] - 0.95) < 0.003


def test_classes_come_near_the_real_ones(spark):
    """Away from zone ends, means lie within a tenth of a deviation and deviations are those
    of a mean of five."""
    made = Y.synthetic_spectra(spark.range(200).withColumnRenamed("id", "transect_id"), stats(spark))
    inner = made.where("not (distance < 2 or distance between 53 and 56 or distance between 103 and 106 or distance between 118 and 121 or distance > 297)")
    for r in Y.compare_spectra(inner, stats(spark)).collect():
        assert abs(r["apart"]) < 0.1 and r["made_std"] == pytest.approx(r["real_std"] / 5**0.5, rel=0.05)
    assert {r["zone_class"]: r["real_mean"] for r in Y.compare_spectra(inner, stats(spark)).collect()}["VEG_DUNES"] == 70.0
    few = Y.synthetic_spectra(spark.range(1).withColumnRenamed("id", "transect_id"), stats(spark).where("class = 'WATER'"))
    assert few.count() == 180 and few.where("brightness < 0 or brightness > 255").count() == 0


def test_a_log_in_many_splits(spark, tmp_path):
    lines = []
    for k in range(400):
        lines += [f"[{k + 1}/400] Processing transect {1000 + k}"] if k % 3 == 0 else []
        lines += [f"Rejected at {k}.5m: NIR drop too small", "", "noise " * (k % 5)]
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.log").write_text("Rejected at 1.0m: brightness\n[1/1] Processing transect 5\nRejected at 2.0m: variance")
    whole = [tuple(r) for r in readers.read_log(spark, [str(tmp_path / "run.log"), str(tmp_path / "other.log")]).collect()]
    assert len(whole) == len(lines) + 3
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found = readers.read_log(spark, [str(tmp_path / "run.log"), str(tmp_path / "other.log")])
        split = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(split, key=repr) == sorted(whole, key=repr)
    transect, want = None, {}
    for n, line in enumerate(lines):
        transect = int(line.split()[-1]) if "Processing" in line else transect
        want[n] = transect
    assert {r[1]: r[2] for r in split if r[0].endswith("run.log")} == want
    assert {r[1]: r[2] for r in split if r[0].endswith("other.log")} == {0: None, 1: 5, 2: 5}
