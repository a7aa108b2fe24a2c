"""One small session for all tests, and the comparison of a query with its SQL twin."""

import math
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-shared-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [[columns[i] for i in order], *sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)]


def compare(spark, name, sf_dir):
    """Differences between a query and its SQL twin on one folder of tables."""
    import duckdb

    import __spark_entry__ as entry

    frame = entry.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            if os.path.exists(f"{sf_dir}/{t}.parquet"):
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        twin = db.execute(entry.oracle_sql()[name])
        want = rows_of([c[0] for c in twin.description], twin.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if got[0] != want[0]:
        return [f"columns {got[0]} against {want[0]}"]
    there, here = set(want[1:]), set(got[1:])
    extra, lost = [r for r in here if r not in there], [r for r in there if r not in here]
    if len(got) != len(want) or extra or lost:
        return [f"{len(got) - 1} rows against {len(want) - 1}", *extra[:3], "---", *lost[:3]]
    return []
