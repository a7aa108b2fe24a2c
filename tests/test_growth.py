"""Steps whose cost once ran away from the input: all in one task, sent whole through the
driver, or worked out again for every row."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tideline.functions.tables import spread
from tideline.operators import geometry as G
from tideline.operators import synthetic as Y

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def fullest(df):
    """Rows in the partition that holds most."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_no_table_of_tiles_or_pixels_is_sent_whole(spark):
    for name in ("line_samples", "tile_overlap"):
        assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


def test_few_bytes_are_dealt_to_many_tasks(spark):
    ids = spark.range(2000).select(F.col("id").alias("transect_id")).distinct()
    assert fullest(spread(ids, "ids", "transect_id")) < 700
    assert spread(ids.where("false"), "ids", "transect_id").count() == 0
    lines = ids.select("transect_id", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D))").alias("points"))
    dense = G.densify(lines)
    assert dense.count() == 20_000 and fullest(dense) < 7_000


def test_made_spectra_are_dealt_to_many_tasks(spark):
    ids = spark.range(2000).select(F.col("id").alias("transect_id")).distinct()
    stats = spark.createDataFrame([("WATER", b, 100.0, 5.0) for b in Y.BANDS], "class string, feature string, mean double, std double")
    made = Y.synthetic_spectra(ids, stats)
    assert made.count() == 2000 * 180 and fullest(made) < 700 * 180


def test_reprojection_works_on_lines_not_on_events(spark):
    text = plan(entry.queries()["line_reprojection"](spark, SF))
    assert "event_id" not in text and not any("Filter" in row and "COSH" in row for row in text.splitlines())


def test_classes_are_worked_out_once(spark):
    """What a query returns starts from written classes, not from events again."""
    for name in ("run_summary", "processing_stats"):
        assert "event_id" not in plan(entry.queries()[name](spark, SF))


def test_comparison_deals_transects_to_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(entry.queries()["synthetic_comparison"](spark, SF))


def test_samples_are_not_sent_whole_to_their_zones(spark):
    """Neither side is, by any estimate, and the zones are what a task holds."""
    text = plan(entry.queries()["points_in_zones"](spark, SF))
    assert "Broadcast" not in text and "SortMergeJoin" not in text and "ShuffledHashJoin" in text and "BuildRight" in text
