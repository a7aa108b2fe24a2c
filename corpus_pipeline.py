"""A training-data pipeline over ``documents``: five stages, each a corpus operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents, whatever further columns the table has and however they are named.  Rows are
told apart by where they were read (``common.located``), never by doc_id, which may be
null or repeat.  The mixing stage decides an order: its rows are written in that order,
and packing follows it by the files' names and row numbers.

Every stage takes an empty table and gives an empty one.  What the others do with nulls,
ties and repeated rows stands at each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, exact_dedup, mixing, packing, simhash_dedup, toxicity

#: Locators of up to so many rows are sent to every task; more are joined by key.
MOST_SENT = 200_000


def kept_rows(docs: DataFrame, verdicts) -> DataFrame:
    """``docs`` without the rows that ``verdicts(docs)``, with locator and kept, drops."""
    docs = common.from_files(docs)
    located, file, row = common.located(docs)
    dropped = common.stash(verdicts(docs).where(~F.col("kept")).select("locator.*"), "dropped")
    n = dropped.count()
    if not n:
        return docs
    same = (located[file] == dropped["file"]) & (located[row] == dropped["row"])
    return located.join(F.broadcast(dropped) if n <= MOST_SENT else dropped, same, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.5 stay.  Null and empty texts have the model's bias as score,
    repeated rows and ties equal scores, so they stay or go together."""
    labels = common.table(spark, sf_dir, "labels")
    score = common.unused("_score", docs.columns)
    return toxicity.toxicity(docs, labels, carry=docs.columns).where(F.col(score) < 0.5).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the largest doc_id stays, a null id being
    the smallest; of rows that repeat the id too, the last one read."""
    return kept_rows(docs, exact_dedup.dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the row with the smallest doc_id stays, a null id being
    the largest; of rows that repeat the id, the first by fingerprint and place.  Null and
    empty texts are near each other."""
    return kept_rows(docs, simhash_dedup.classes)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of their slots.  A null source is a source of its own; rows that
    repeat an id are rows like any others."""
    slot, place = (common.unused(c, docs.columns) for c in ("_slot", "_place"))
    return mixing.mix(docs, carry=docs.columns).orderBy(slot, place).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in the order in which they were written.  A null or empty text is
    its end token alone."""
    rows = docs.select("doc_id", "text")
    try:
        placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        placed.schema
    except AnalysisException:  # not read from files: there is no written order
        return packing.pack(rows)
    return packing.pack(placed, order=["_file", "_row"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, fingerprints and token ids can't be said in SQL; the tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
