"""Mixing sources to target weights as a Pfair schedule of document blocks.

A source's documents, in an order shuffled by a hash of their id, form blocks of
``block`` documents.  Time runs in slots of one block.  In the ideal mixture every source
is served at its weight's share at all times; when one has run out, the others' shares are
scaled up.  By virtual time v source i has got min(w_i v, blocks_i), so its block k ends
at v = k / w_i, in slot time T(v) = the sum of that over all sources: blocks of sources
that ended before, plus v times the weight of the rest (two running sums over the table
of block ends, sorted by v).  Block k is released at floor(T((k-1)/w)) and due at
ceil(T(k/w)), and in each slot the released block with the earliest deadline goes out.
Then at every moment of the whole schedule each source is less than one block away from
its ideal share.  Sources of weight 0 or less follow after all others, in equal shares.

The earliest-deadline rule is run by ranges of slots: each range for itself, then the
blocks that wait at each range's start (at most one a source) from the sets so found, then
each range again with those.  If X waits when a range of L slots starts, and D is what the
range alone would send (an idle slot counts as the latest deadline of all), it sends the L
earliest of D and X and hands on the rest.  Two ranges in a row act like one such range, so
the middle step is a tree: FAN ranges are joined in a task, then FAN of those, and what
waits is handed down again.  The result is that of one run over all slots.

No document is dropped or repeated.  Ranks inside a source come from counts over (source,
hash bucket), so a source with a third of all rows is many small windows, and each bucket
takes the slots of its own blocks along: rows are shuffled once.  An id that very many
rows repeat is dealt to all buckets by where its rows were read.

Null sources form a source of their own; null ids are ordinary values; rows that
repeat an id are separate documents (their order is arbitrary if all else is equal).
An empty table gives an empty result.  Text is not read.  Sources are rows of a table
joined by key, as many as there are; the driver sees two counts.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C
from .components import heavy_keys

BLOCK = 16
ROWS_PER_BUCKET = 250_000
SPAN = 8192  # slots of a range, at least
FAN = 64  # ranges that one task joins
EPS = 1e-6  # slots; more than the rounding errors of T, and windows only get narrower by it
IDLE = (1 << 62, -1, -1)


def block_windows(sizes: DataFrame) -> DataFrame:
    """(sid, k, rel, due) of every block, from (sid, blocks, w)."""
    n = C.partitions(sizes.sparkSession)
    step = F.lit(4096).cast("long")
    late = F.col("w") <= 0
    cut = sizes.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), "blocks", step))).repartition(n, "sid", "a")
    ends = cut.withColumn("k", F.explode(F.sequence("a", F.least(F.col("a") + step - 1, F.col("blocks")))))
    ends = ends.withColumns({"late": late, "w": F.when(late, 1.0).otherwise(F.col("w")), "last": F.col("k") == F.col("blocks")})
    ends = ends.withColumn("v", F.col("k") / F.col("w")).repartitionByRange(n, "late", "v", "sid", "k")
    parts = C.stash(
        ends.select(
            "sid", "k", "late", "v", F.spark_partition_id().alias("pid"), F.when(F.col("last"), F.col("blocks")).otherwise(0).alias("b"),
            *[F.when(F.col("last") & (F.col("late") == x), F.col("w")).otherwise(0.0).alias(c) for c, x in (("w0", False), ("w1", True))],
        ),
        "block-ends",
    )
    order = ["late", "v", "sid", "k"]
    down = Window.orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("pid").agg(*[F.sum(c).alias(c) for c in ("b", "w0", "w1")])  # n rows at most
    starts = sums.select("pid", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_s") for c, w in (("b", up), ("w0", down), ("w1", down))])
    before = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("pid").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select(
        "*", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b_r"), *[F.sum(c).over(onward).alias(f"{c}_r") for c in ("w0", "w1")]
    ).join(F.broadcast(starts), "pid")
    rest = F.when(F.col("late"), F.col("w1_s") + F.col("w1_r")).otherwise(F.col("w0_s") + F.col("w0_r"))
    t = run.select("sid", "k", (F.col("b_s") + F.col("b_r") + F.col("v") * rest).alias("t"))
    none = F.lit(None).cast("double")
    both = F.array(
        F.struct(F.col("k"), none.alias("rel"), F.col("t").alias("due")),
        F.struct((F.col("k") + 1).alias("k"), F.col("t").alias("rel"), none.alias("due")),
    )
    sides = t.select("sid", F.explode(both).alias("x")).select("sid", "x.*")
    return (
        sides.groupBy("sid", "k").agg(F.max("rel").alias("rel"), F.max("due").alias("due"))
        .where("rel is not null and due is not null")
        .select("sid", "k", F.floor(F.col("rel") + EPS).alias("rel"), F.ceil(F.col("due") - EPS).alias("due"))
    )


def earliest_first(pdf: pd.DataFrame, start: int, stop: int) -> tuple[list[tuple], list[tuple]]:
    """What goes out in slots start to stop, as (due, sid, k) or IDLE, and what waits then."""
    pdf = pdf.sort_values("rel", kind="stable")
    rel = pdf["rel"].tolist()
    keys = list(zip(pdf["due"].tolist(), pdf["sid"].tolist(), pdf["k"].tolist()))
    sent, ready, p = [], [], 0
    for t in range(start, stop):
        while p < len(rel) and rel[p] <= t:
            heapq.heappush(ready, keys[p])
            p += 1
        sent.append(heapq.heappop(ready) if ready else IDLE)
    return sent, ready


def after(left: list[tuple], sent: list[tuple], waits: list[tuple]) -> list[tuple]:
    """What waits after a stretch that alone sends ``sent`` (its latest ones are enough) and
    leaves ``left``, if ``waits`` waited before it."""
    return left + [x for x in heapq.nlargest(len(waits), waits + sent) if x != IDLE]


def joined(parts: list[tuple[list, list]], keep: int) -> tuple[list[tuple], list[tuple]]:
    """(left, the ``keep`` latest sent) of stretches one after the other, as of one stretch."""
    left: list[tuple] = []
    sent: list[tuple] = []
    for own_left, own_sent in parts:
        both = sorted(left + own_sent, reverse=True)
        late, rest = both[: len(left)], both[len(left) :]
        sent = heapq.nlargest(keep, sent + rest)
        left = own_left + [x for x in late if x != IDLE]
    return left, sent


def _parts(pdf: pd.DataFrame) -> list[tuple[int, list, list]]:
    """(node, left, sent) of all nodes, in order."""
    rows = sorted(pdf[["node", "sent", "due", "sid", "k"]].itertuples(index=False, name=None))
    out = []
    for node, group in groupby(rows, key=lambda x: x[0]):
        found: tuple[list, list] = [], []
        for x in group:
            found[bool(x[1])].append(x[2:])
        out.append((node, *found))
    return out


def waiting_blocks(ends, nodes: int, sources: int, fan: int) -> DataFrame:
    """(node, due, sid, k) of the blocks that wait at each range's start.  ``ends(keep)`` has
    what each range alone leaves and the latest it sends.  Up a tree, ``fan`` stretches at a
    time are joined into one; down again, each is told what waits before it: no task sees
    more than ``fan`` stretches, and no stretch is more than a few blocks a source."""
    depth = 0
    while fan ** (depth + 1) < nodes:
        depth += 1
    # a stretch below hands up the latest blocks that those above may ask for
    levels = [C.stash(ends((depth + 2) * sources), "range-ends")]
    kinds = "node long, sent boolean, due long, sid long, k long"
    for level in range(1, depth + 1):
        keep = (depth + 2 - level) * sources

        def up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            left, sent = joined([x[1:] for x in _parts(pdf)], keep)  # written below, while ``keep`` is this
            rows = [(key[0], True, *x) for x in sent] + [(key[0], False, *x) for x in left]
            return pd.DataFrame(rows, columns=["node", "sent", "due", "sid", "k"])

        above = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("up")).applyInPandas(up, kinds)
        levels.append(C.stash(above, "range-ends"))

    def down(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        waits, rows = list(before[["due", "sid", "k"]].itertuples(index=False, name=None)), []
        for node, left, sent in _parts(pdf):
            rows += [(node, *x) for x in waits]
            waits = after(left, sent, waits)
        return pd.DataFrame(rows, columns=["node", "due", "sid", "k"])

    waits = None
    for level in reversed(levels):
        if waits is None:
            waits = level.sparkSession.createDataFrame([], "node long, due long, sid long, k long")
        under = level.groupBy(F.floor(F.col("node") / fan).alias("up"))
        waits = under.cogroup(waits.groupBy("node")).applyInPandas(down, "node long, due long, sid long, k long")
        waits = C.stash(waits, "waiting") if level is not levels[0] else waits
    return waits


def schedule(windows: DataFrame, sources: int, span: int = SPAN, fan: int | None = None) -> DataFrame:
    """(sid, k, slot) of every block: earliest deadline first, run by ranges of slots."""
    n = max(span, 8 * sources)
    fan = fan or max(2, min(FAN, (1 << 18) // max(sources, 1)))  # with many sources, as large as a range is
    blocks = C.stash(windows.withColumn("range", F.floor(F.col("rel") / n)), "blocks")
    nodes = blocks.agg(F.coalesce(F.max("range") + 1, F.lit(0))).first()[0]

    def ends(keep: int) -> DataFrame:
        def alone(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            sent, left = earliest_first(pdf, key[0] * n, (key[0] + 1) * n)
            rows = [(key[0], True, *x) for x in heapq.nlargest(keep, sent)] + [(key[0], False, *x) for x in left]
            return pd.DataFrame(rows, columns=["node", "sent", "due", "sid", "k"])

        return blocks.groupBy("range").applyInPandas(alone, "node long, sent boolean, due long, sid long, k long")

    def placed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = key[0] * n
        sent, _ = earliest_first(pdf, start, start + n)
        rows = [(x[1], x[2], start + t) for t, x in enumerate(sent) if x != IDLE]
        return pd.DataFrame(rows, columns=["sid", "k", "slot"])

    waiting = waiting_blocks(ends, nodes, sources, fan).select(F.col("node").alias("range"), (F.col("node") * n).alias("rel"), "due", "sid", "k")
    return blocks.unionByName(waiting).groupBy("range").applyInPandas(placed, "sid long, k long, slot long")


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    temper: float = 0.5,
    block: int = BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: list[str] | None = None,
    span: int = SPAN,
) -> DataFrame:
    """One row per row of ``docs``: id and source (or the columns ``carry``), _block
    (within the source), _slot and _place (within the slot).  Ordering by slot and place
    is the mixture.  Where ``carry`` has such a name, an underscore is put behind it.

    ``weights`` maps sources to target weights; a source it does not name, or every
    source if it is None, weighs its number of documents to the power ``temper``.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    carry = carry or [id_col, source_col]
    _block, _slot, _place = (C.unused(x, carry) for x in ("_block", "_slot", "_place"))
    docs, file, number = C.located(docs)
    row = F.struct(*[F.col(c) for c in carry]).alias("row")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), F.xxhash64(file, number).alias("read_at"), row
    )
    sizes = rows.groupBy("key", "source").count()
    named = T.StructType([T.StructField("name", docs.schema[source_col].dataType), T.StructField("given", T.DoubleType())])
    given = spark.createDataFrame([(k, float(w)) for k, w in (weights or {}).items()], named)
    sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").orderBy("key")
    sizes = C.stash(
        sizes.select(
            "key", F.monotonically_increasing_id().alias("sid"), "count", F.ceil(F.col("count") / block).alias("blocks"),
            F.coalesce("given", F.pow("count", F.lit(float(temper)))).alias("w"),
        ),
        "source-sizes",
    )
    total, sources = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    slots = schedule(block_windows(sizes), sources, span)
    n = max(4 * C.partitions(spark), total // ROWS_PER_BUCKET + 1)
    often = C.stash(heavy_keys(rows.groupBy(F.xxhash64("id").alias("h")).count(), "count").select("h"), "repeated-ids")
    rows = rows.withColumn("h", F.xxhash64("id"))
    if not often.isEmpty():  # few, by the meaning of heavy
        rows = rows.join(F.broadcast(often.select("h", F.lit(True).alias("often"))), "h", "left")
        rows = rows.withColumn("h", F.when(F.col("often"), F.xxhash64("h", "read_at")).otherwise(F.col("h"))).drop("often")
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n)))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("key", "bucket")
        .count()
        .select("key", "bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("count") - 1) / block)
    # the slots of a bucket's blocks: about ROWS_PER_BUCKET / block numbers
    timed = (
        starts.join(sizes.select("key", "sid"), "key")
        .select("key", "bucket", "start", "sid", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("k", F.col("block") + 1)
        .join(slots, ["sid", "k"])
        .groupBy("key", "bucket", "start")
        .agg(F.min("block").alias("first"), F.array_sort(F.collect_list(F.struct("block", "slot")))["slot"].alias("slots"))
    )
    within = Window.partitionBy("key", "bucket").orderBy("h", "id", "read_at")
    ranked = (
        rows.withColumn("r", F.row_number().over(within) - 1)
        .join(timed, ["key", "bucket"])
        .withColumn("rank", F.col("start") + F.col("r"))
        .withColumn("block", F.floor(F.col("rank") / block))
    )
    slot = F.element_at("slots", (F.col("block") - F.col("first") + 1).cast("int"))
    return ranked.select(
        *[F.col("row")[c].alias(c) for c in carry],
        F.col("block").alias(_block),
        slot.cast(T.LongType()).alias(_slot),
        F.pmod("rank", F.lit(block)).alias(_place),
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place")
    )
