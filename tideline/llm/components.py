"""Connected components of links between integer nodes, as joins and sums.

Alternates two contractions until nothing changes: every node hands its larger
neighbours its smallest one, then every node ties its smaller neighbours to the
smallest.  A node's neighbours are never gathered: only their minimum is taken
(partially before the shuffle) and joined back, so a node with a third of all links is
a skewed join, which Spark splits.  Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stash

#: Rows of (group, size) that may be broadcast.  Fewer groups than this can each hold more
#: than one in MOST_BROADCAST of all rows, whatever the table.
MOST_BROADCAST = 10_000
#: A group of up to so many rows is never heavy.
LIGHT = 256


def heavy_keys(sizes: DataFrame, weight: str) -> DataFrame:
    """Of a table of keys with their numbers of rows, those with more than one in
    MOST_BROADCAST of all rows: fewer than MOST_BROADCAST."""
    total = sizes.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    return sizes.where(F.col(weight) > max(LIGHT, total // MOST_BROADCAST))


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the one row of ``table`` for their key; ``weight`` is the number of rows
    with a key.  Heavy keys are broadcast, so their rows stay where they are; the rest is
    joined by key."""
    heavy = stash(heavy_keys(table, weight), "heavy")
    if heavy.isEmpty():
        return rows.join(table, key)
    named = F.broadcast(heavy.select(key))
    light = rows.join(named, key, "left_anti").join(table.join(named, key, "left_anti"), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def connected(edges: DataFrame) -> DataFrame:
    """``edges``: longs a and b.  Returns (node, root): the smallest node reachable,
    for every node that is in a link to another one."""
    edges = stash(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = _signature(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        tight = wide.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(tight.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def cells(rows: DataFrame, group: list[str], spread: str, most: int) -> DataFrame:
    """Deal each group to cells that together hold every pair of its rows.

    A group of up to ``most`` rows is one cell.  A larger one is cut into chunks of
    about ``most`` rows by the hash of ``spread``; each pair of chunks is a cell of its
    own, wherever it runs.  Adds chunk, i and j (i <= j): the cell compares chunk i
    with chunk j.  No row or pair is dropped.
    """
    sizes = stash(rows.groupBy(*group).count().where(F.col("count") > most), "large-groups")
    n = sizes.count()
    if n:  # few large groups are sent to every task, many are joined by key
        large = F.broadcast(sizes) if n <= MOST_BROADCAST else sizes
        out = rows.join(large, group, "left")
    else:
        out = rows.withColumn("count", F.lit(None).cast("long"))
    c = F.coalesce(F.ceil(F.col("count") / most), F.lit(1).cast("long"))
    out = out.withColumn("chunk", F.pmod(F.xxhash64(spread), c))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), c - 1)))
    return out.select(
        *rows.columns, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (before == label).all():
            break
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def per_cells(rows: DataFrame, group: list[str], spread: str, most: int, run, schema: str) -> DataFrame:
    """``run(table, cell)`` over stretches of whole cells: ``cell`` numbers the rows'
    cells from 0, in order.  Cells of one group can lie in different tasks."""
    keys = [*group, "i", "j"]
    dealt = cells(rows, group, spread, most)
    dealt = dealt.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, spread)

    def number(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in keys:
            v = t[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    def over(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.table(batch)]) if held is not None else pa.table(batch)
            if held.num_rows:
                cell = number(held)
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if whole > most:
                    yield from run(held.slice(0, whole).combine_chunks(), cell[:whole]).to_batches()
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from run(held.combine_chunks(), number(held)).to_batches()

    return dealt.mapInArrow(over, schema)
