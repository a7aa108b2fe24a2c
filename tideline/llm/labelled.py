"""What the two classifiers share: a bounded training sample, one fit, scores for all."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def held_out(id_col: str, folds: int, out: int) -> Column:
    """crc32 of the id as text modulo ``folds`` is ``out``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))


def training_rows(docs, labels, label: str, id_col: str, text_col: str, folds: int, out: int, most: int) -> DataFrame:
    """(y, text): up to ``most`` labelled documents of each class outside the held-out
    fold, taken in the order of a hash of their id.  Ids labelled both ways count as 1."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
        .where(~held_out("id", folds, out))
    )
    # the sample is chosen by id; only its own texts are then read into it
    there = docs.select(F.col(id_col).alias("id")).distinct().join(known, "id")
    parts = [there.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = rows.join(F.broadcast(chosen), "id")  # at most 2 * most rows are broadcast
    # ids that repeat in docs could exceed the bound
    return both.orderBy(F.xxhash64("id"), "id", "text").limit(2 * most).select("y", "text")


def fit(sample: DataFrame, train) -> bytes:
    """``train(texts, y) -> bytes`` in one task: the sample is bounded by its rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "text"], kind="stable").reset_index(drop=True)
        return pd.DataFrame({"model": [train(rows["text"].tolist(), rows["y"].to_numpy())]})

    got = sample.groupBy().applyInPandas(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else train([], np.zeros(0, np.int64))


def score_all(docs: DataFrame, model: bytes, score, text_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and _score (with underscores behind it if that is one of them):
    ``score(model, texts) -> array``, the model (of fixed size) broadcast."""
    name = C.unused("_score", carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = list(dict.fromkeys([*carry, text_col]))

    def run(batches):
        for batch in batches:
            found = np.clip(score(shared.value, batch.column(text_col)), 0.0, 1.0)
            yield batch.select(carry).append_column(name, pa.array(found, pa.float64()))
        C.release()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*given).mapInArrow(run, f"{fields}, `{name}` double")
