"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session has none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tideline-")
    return _OWN[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read, and read it back: it is computed once,
    later plans start from a scan, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str, key: str, per_task: int = 500) -> DataFrame:
    """A table of few bytes whose rows become many: written, and dealt to tasks by ``key``,
    about ``per_task`` rows to each.  Adaptive execution would put it all into one task, and
    what its rows become stays where they are."""
    df = settle(df, name)
    return df.repartition(max(1, -(-df.count() // per_task)), key)
