"""Exact deduplication by stateful streaming; DataFrame functions only.

Arrivals (identifier, digest of the normalised text, content locator) go through a
streaming aggregation whose state never expires and lies on disk (RocksDB, its
checkpoint in the shared folder): per digest the arrival with the largest identifier so
far, the locator of its content (file and row) and the number of copies.  Digests are
summed before the shuffle, so a text that makes up a third of the corpus is a few state
updates.  With a folder for the state, a later call goes on from it: copies of what came
in an earlier delivery are found, and the largest identifier of all deliveries stays.

A digest hit is only a candidate: the texts of all hits are read again by locator and
grouped by digest and whole text, summed before the shuffle, so that copies travel once a
task.  Texts that differ under one digest are regrouped by their full text.  Content of
an earlier delivery that can no longer be read is taken at its digest's word.

Texts are equal when identical after lower-casing A-Z only.  Null text counts as empty;
empty texts are equal to each other.  A null identifier is the smallest.  Of rows that
repeat identifier and text, the one with the last locator stays; all count in group_size.
Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import join_heavy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keyed state on disk.  Changes are logged rather than whole files copied, and no space
#: is reserved ahead: each partition's store is small.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share this much memory for writes and blocks
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Files of arrivals that one micro-batch takes.
FILES_PER_BATCH = 64
#: Locators of up to so many rows are sent to every task; more are joined by key.
MOST_SENT = 200_000


def normal(text: Column) -> Column:
    """A-Z lower-cased; where a text is all ASCII, plain lower() says the same faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def absorb(root: str, schema, spark: SparkSession, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the arrivals under ``root`` that the state there has not seen yet through it; per
    digest among them: keeper (id, locator), copies.  Of the changes that the state wrote,
    those of this run alone are read: each arrival changes its digest's."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("copies"))

    state = sums(stream.parquet(f"{root}/arrivals"))
    sums(spark.createDataFrame([], schema)).write.mode("overwrite").parquet(f"{root}/changes/epoch=-1")
    before_run = spark.read.parquet(f"{root}/changes").agg(F.max("epoch")).first()[0]
    before_run = -1 if before_run is None else before_run

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        run = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # both values only ever grow, so the latest change of a digest is the largest
    return (
        spark.read.parquet(f"{root}/changes")
        .where(F.col("epoch") > before_run)
        .groupBy("digest")
        .agg(F.max("keeper").alias("keeper"), F.max("copies").alias("copies"))
    )


def located_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose locator is in ``wanted`` (distinct): few are sent to every
    task, more are joined."""
    few = wanted.count() <= MOST_SENT
    return rows.join(F.broadcast(wanted) if few else wanted, "locator", "left_semi")


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    files_per_batch: int = FILES_PER_BATCH,
    state: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept, and locator (file
    and row, as ``common.located`` gives them).  ``state`` is a shared folder that deliveries
    have in common; without one, ``docs`` is all there is."""
    spark = docs.sparkSession

    def read(docs: DataFrame) -> DataFrame:
        docs, file, row = C.located(docs)
        t = normal(F.col(text_col))
        return docs.select(
            F.col(id_col).alias("id"), t.alias("t"), digest(t).alias("digest"), F.struct(F.col(file).alias("file"), F.col(row).alias("row")).alias("locator")
        )

    rows = read(docs)
    root = state or C.fresh_path(spark, "dedup-state")
    arrivals = rows.drop("t")
    path = f"{root}/arrivals/{uuid.uuid4().hex}"
    arrivals.write.parquet(path)
    arrivals = spark.read.schema(arrivals.schema).parquet(path)
    seen = C.stash(absorb(root, arrivals.schema, spark, files_per_batch), "seen")
    verdicts = join_heavy(arrivals, seen, "digest", "copies").withColumnsRenamed({"copies": "group_size"})

    # hits: all bytes are compared
    hits = C.stash(verdicts.where("group_size > 1").select("locator", "keeper"), "hits")
    texts = located_in(rows, hits.select("locator")).select("id", "digest", "locator", "t")
    if state:  # keepers that came with an earlier delivery
        old = hits.select(F.col("keeper.locator").alias("locator")).distinct().join(hits.select("locator"), "locator", "left_anti")
        old = C.stash(old, "old-keepers")
        files = [r[0] for r in old.select("locator.file").distinct().collect()]  # names of files, which the driver lists anyway
        if files := [f for f in files if there(spark, f)]:
            before = located_in(read(spark.read.parquet(*files).select(id_col, text_col)), old)
            texts = texts.unionByName(before.select("id", "digest", "locator", "t"))
    groups = texts.groupBy("digest", "t").agg(F.max(F.struct("id", "locator")).alias("own_keeper"), F.count(F.lit(1)).alias("n"))
    several = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    several = C.stash(several, "false-hits")
    if not several.isEmpty():
        own = rows.join(several, "digest", "left_semi").join(groups, ["digest", "t"]).select("locator", "own_keeper", "n")
        verdicts = verdicts.join(own, "locator", "left").withColumns(
            {"keeper": F.coalesce("own_keeper", "keeper"), "group_size": F.coalesce("n", "group_size")}
        )
    return verdicts.select(
        F.col("id").alias(id_col), "digest", F.col("keeper.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keeper.locator")).alias("kept"), "locator"
    )


def there(spark: SparkSession, file: str) -> bool:
    """Can a file of an earlier delivery still be read?"""
    try:
        spark.read.parquet(file)
        return True
    except AnalysisException:
        return False


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
