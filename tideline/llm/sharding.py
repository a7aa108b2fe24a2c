"""Sharding by the minimax contiguous partition; DataFrame functions only.

Documents of equal text are one atomic group.  Groups stand in the order of their smallest
identifier, and each shard takes a stretch of them.  The capacity is the smallest one under
which ``shards`` stretches hold everything, so the largest shard is as small as it can be;
a binary search finds it, and a capacity is checked greedily: each shard takes groups as
long as they fit.  The cuts then stay under that capacity and, within it, give each shard
its even share of what is left, where groups heavier than an even share count as one, so
that a large group does not leave the other shards empty or uneven.

The greedy check needs the running sums of the groups, of which there may be as many as
documents.  They are summed by ranges (``common.running``) and written; what the search reads is a
grid of at most ``2 * cells`` of them, whatever the table: the first and the last sum in
each cell of equal width.  Between the last sum of a cell and the first of the next lies
one group, so only the inside of a cell is unknown.  Taking the inside as solid gives a
capacity that is enough, taking it as divisible one that is needed; cells that any cut can
fall into between the two are read again on a finer grid, until none is left.

The size of a document is its UTF-8 bytes plus ``overhead``.  A null text counts as empty and
is grouped with empty ones.  Groups are told apart by MD5: should two texts share one, they
share a shard.  A null identifier is the largest; a group of nothing else comes last.  Of
groups with the same smallest identifier (repeated ones) the smaller digest comes first, and
rows that repeat an identifier stand as they were read.  With fewer groups than shards some
shards are empty.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import join_heavy

SHARDS, OVERHEAD = 24, 8
#: Cells of the grid at least; cuts can fall into some 3 * shards**2 of them.
CELLS = 1 << 15
ROWS_PER_FILE = 1 << 20


class Heavy:
    """Groups that weigh more than an even share, fewer than ``shards``: for the even cuts
    each counts as no more than an even share of the rest."""

    def __init__(self, groups: list[tuple[int, int]], total: int, shards: int):
        """``groups``: running sum and weight, ascending."""
        self.groups = groups
        self.counts = max((total - sum(w for _, w in groups)) // max(shards - len(groups), 1), 1)

    def level(self, x: int) -> int:
        gone = 0
        for stop, w in self.groups:
            if x >= stop:
                gone += w - self.counts
            elif x > stop - w:  # inside
                return stop - w - gone + (x - stop + w) * self.counts // w
        return x - gone

    def real(self, y: int) -> int:
        gone = 0
        for stop, w in self.groups:
            start = stop - w - gone
            if y < start:
                break
            if y < start + self.counts:
                return stop - w
            gone += w - self.counts
        return y + gone


class Grid:
    """Some of the running sums, ascending from 0, and for each whether more lie between it
    and the one before."""

    def __init__(self, sums: list[int], more: list[bool], heavy: Heavy):
        self.sums, self.more, self.heavy, self.total = sums, more, heavy, sums[-1]

    def down(self, x: int, divisible: bool = False) -> int:
        """The last cut up to x; with ``divisible`` the inside of a cell can be cut anywhere."""
        k = bisect_right(self.sums, x) - 1
        return x if divisible and k + 1 < len(self.sums) and self.more[k + 1] else self.sums[k]

    def up(self, x: int, divisible: bool = False) -> int:
        k = bisect_left(self.sums, x)
        return x if divisible and self.more[k] and self.sums[k] != x else self.sums[k]

    def forward(self, capacity: int, shards: int, divisible: bool = False) -> list[int]:
        """Where the shards end if each takes what fits."""
        out = [0]
        for _ in range(shards):
            out.append(self.down(min(out[-1] + capacity, self.total), divisible))
        return out

    def backward(self, capacity: int, shards: int, divisible: bool = False) -> list[int]:
        """The least ends from which the later shards can still hold the rest."""
        out = [self.total]
        for _ in range(shards):
            out.append(self.up(max(out[-1] - capacity, 0), divisible))
        return out[::-1]

    def capacity(self, shards: int, divisible: bool = False) -> int:
        """The least capacity for which the greedy check passes."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.forward(middle, shards, divisible)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even(self, capacity: int, least: list[int], shards: int, low: bool = False, high: bool = False) -> list[int]:
        """Cuts that give each shard its share of what is left, but a group at least, not less
        than ``least`` and not more than ``capacity``; with ``low`` or ``high`` bounds of them."""
        out, end = [0], self.heavy.level(self.total)
        for k in range(1, shards + 1):
            at = self.heavy.level(out[-1])
            share = self.heavy.real(at + (end - at) // (shards - k + 1))
            wanted = max(self.down(share, high), self.up(min(out[-1] + 1, self.total), low), least[k])
            out.append(min(wanted, self.down(min(out[-1] + capacity, self.total), high)))
        return out

    def unknown(self, shards: int) -> list[tuple[int, int]]:
        """Cells with more sums inside that a cut can fall into."""
        low, high = self.capacity(shards, True), self.capacity(shards)
        first, last = self.backward(high, shards, True), self.backward(low, shards)
        spans = [
            *zip(self.forward(low, shards), self.forward(high, shards, True)),
            *zip(first, last),
            *zip(self.even(low, first, shards, low=True), self.even(high, last, shards, high=True)),
        ]
        cells = set()
        for a, b in spans:
            for k in range(bisect_right(self.sums, a), min(bisect_left(self.sums, b) + 1, len(self.sums))):
                if self.more[k]:
                    cells.add((self.sums[k - 1], self.sums[k]))
        return sorted(cells)

    def refined(self, cells: list[tuple[int, int]], sums: list[int], more: list[bool]) -> Grid:
        """With the sums found inside ``cells``, their ends among them where they matter."""
        known = dict(zip(self.sums, self.more))
        for _, b in cells:
            del known[b]
        known |= dict(zip(sums, more))
        order = sorted(known)
        return Grid(order, [known[x] for x in order], self.heavy)


def sums_in(groups: DataFrame, spans: list[tuple[int, int]], cells: int) -> tuple[list[int], list[bool]]:
    """First and last running sum in each cell of equal width over ``spans`` (open, closed],
    and whether others lie between them: at most two for each of ``cells`` cells and span."""
    width = -(-sum(b - a for a, b in spans) // cells)
    stop = F.col("stop")
    joined = [spans[0]]
    for a, b in spans[1:]:  # neighbours become one
        joined[-1:] = [(joined[-1][0], b)] if joined[-1][1] == a else [joined[-1], (a, b)]
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in joined])
    inside = F.get(F.filter(bounds, lambda s: (stop > s["a"]) & (stop <= s["b"])), F.lit(0))
    near = groups.where(stop.between(joined[0][0] + 1, joined[-1][1])).select("stop", inside["a"].alias("a")).where("a is not null")
    found = near.groupBy("a", F.floor((stop - F.col("a") - 1) / width).alias("cell")).agg(
        F.min("stop").alias("low"), F.max("stop").alias("high"), F.count(F.lit(1)).alias("n")
    )
    sums, more = [], []
    for low, high, n in found.select("low", "high", "n").collect():  # bounded by ``cells``
        sums += [low, high] if high > low else [low]
        more += [False, n > 2] if high > low else [False]
    return sums, more


def cut(groups: DataFrame, total: int, heavy: Heavy, shards: int, cells: int | None = None) -> list[int]:
    """The running sums at which the shards end, from that of the first shard on."""
    cells = cells or max(CELLS, 16 * shards * shards)
    grid, unknown = Grid([0, total], [False, True], heavy), [(0, total)]
    while unknown:
        grid = grid.refined(unknown, *sums_in(groups, unknown, cells))
        unknown = grid.unknown(shards)
    capacity = grid.capacity(shards)
    return grid.even(capacity, grid.backward(capacity, shards), shards)[1:]


def assign(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, cells: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, size, crc, shard, slot, file and row (as
    ``common.located`` gives them)."""
    docs, file, row = C.located(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = C.stash(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead).cast("long")).alias("size"), F.crc32(text).alias("crc"),
            F.unhex(F.md5(text)).alias("digest"), F.col(file).alias("file"), F.col(row).alias("row"),
        ),
        "sizes",
    )
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.sum("size").alias("weight"), F.count(F.lit(1)).alias("copies"))
    groups = C.stash(C.running(groups, [F.col("first").asc_nulls_last(), F.col("digest")], {"stop": F.col("weight")}, "groups"), "group-sums")
    total = groups.agg(F.coalesce(F.max("stop"), F.lit(0))).first()[0]
    most = groups.where(F.col("weight") > total // shards).select("stop", "weight").orderBy("stop").collect()  # fewer than shards
    ends = cut(groups, total, Heavy([tuple(r) for r in most], total, shards), shards, cells) if total else []
    shard = sum(((F.col("stop") > e).cast("int") for e in ends[:-1]), F.lit(0))
    placed = join_heavy(rows, groups.select("digest", "copies", shard.alias("shard")), "digest", "copies").drop("digest", "copies")
    order = [F.col("shard"), F.col("id").asc_nulls_last(), F.col("file"), F.col("row")]
    placed = C.running(placed, order, {"slot": F.lit(1)}, "placed")
    starts = placed.groupBy("shard").agg(F.min("slot").alias("start"))  # a row a shard
    return placed.join(F.broadcast(starts), "shard").select("id", "size", "crc", "shard", (F.col("slot") - F.col("start")).alias("slot"), "file", "row")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, rows_per_file: int = ROWS_PER_FILE, **names) -> DataFrame:
    """The rows of ``docs`` under ``folder``/shard=0, shard=1 ...: files of at most so many
    rows, in the order of their slots, which stand beside them.  Returns what ``assign`` does."""
    docs = C.from_files(docs)
    found = C.stash(assign(docs, shards, **names), "shards")
    located, file, row = C.located(docs)
    shard, slot = (C.unused(c, docs.columns) for c in ("shard", "slot"))
    where = found.select(F.col("file").alias("_f"), F.col("row").alias("_r"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    both = located.join(where, (located[file] == where["_f"]) & (located[row] == where["_r"]))
    both = both.select(*docs.columns, F.col("_shard").alias(shard), F.col("_slot").alias(slot))
    chunk = F.floor(F.col(slot) / rows_per_file)
    both.repartition(C.partitions(docs.sparkSession), F.col(shard), chunk).sortWithinPartitions(shard, slot).write.partitionBy(shard).option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(folder)
    return found


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(C.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {C.CRC_TABLE_SQL} AS tab),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), rows AS (
  SELECT r, doc_id, strlen(t) + {OVERHEAD} AS size, md5(t) AS digest, {C.crc32_sql("t", "tab")} AS text_crc32 FROM d, crc
), g AS (
  SELECT digest, min(doc_id) AS first, sum(size) AS weight FROM rows GROUP BY digest
), p AS (
  SELECT digest, weight::BIGINT AS weight, (sum(weight) OVER (ORDER BY first NULLS LAST, digest ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM g
), h AS (
  SELECT greatest(coalesce(sum(weight) FILTER (weight <= total // {SHARDS}), 0) // greatest({SHARDS} - count(*) FILTER (weight > total // {SHARDS}), 1), 1)::BIGINT AS counts,
         any_value(total) AS total
  FROM p, (SELECT max(stop) AS total FROM p)
), level AS (
  SELECT stop, (sum(CASE WHEN weight > total // {SHARDS} THEN counts ELSE weight END) OVER (ORDER BY stop))::BIGINT AS lev FROM p, h
), s AS MATERIALIZED (
  SELECT list_prepend(0, list(stop ORDER BY stop)) AS stops, list_prepend(0, list(lev ORDER BY stop)) AS levels, max(stop) AS total, max(lev) AS top FROM level
), search AS (
  SELECT (total + {SHARDS} - 1) // {SHARDS} AS low, total AS high, 0::BIGINT AS pos, 0 AS used FROM s
  UNION ALL
  SELECT CASE WHEN pos < total AND used = {SHARDS} THEN (low + high) // 2 + 1 ELSE low END,
         CASE WHEN pos = total THEN (low + high) // 2 ELSE high END,
         CASE WHEN pos = total OR used = {SHARDS} THEN 0 ELSE list_max(list_filter(stops, lambda x: x <= pos + (low + high) // 2)) END,
         CASE WHEN pos = total OR used = {SHARDS} THEN 0 ELSE used + 1 END
  FROM search, s WHERE low < high
), capacity AS MATERIALIZED (
  SELECT low AS c FROM search WHERE low >= high
), backward AS (
  SELECT {SHARDS} AS k, total AS pos FROM s
  UNION ALL
  SELECT k - 1, list_min(list_filter(stops, lambda x: x >= pos - c)) FROM backward, s, capacity WHERE k > 0
), least AS MATERIALIZED (
  SELECT list(len(list_filter(stops, lambda x: x <= pos)) ORDER BY k) AS least FROM backward, s
), even AS (
  SELECT 0 AS k, 1::BIGINT AS i, 0::BIGINT AS pos
  UNION ALL
  SELECT k + 1, nxt, stops[nxt] FROM (
    SELECT k, stops, least(
        greatest(len(list_filter(levels, lambda x: x <= levels[i] + (top - levels[i]) // ({SHARDS} - k))), least(i + 1, len(stops)), least[k + 2]),
        len(list_filter(stops, lambda x: x <= pos + c))) AS nxt
    FROM even, s, least, capacity WHERE k < {SHARDS}
  )
), placed AS (
  SELECT p.digest, (SELECT count(*) FROM even WHERE k BETWEEN 1 AND {SHARDS - 1} AND even.pos < p.stop)::INT AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, r) - 1 AS slot, NULL::INT AS grown_shard
FROM rows JOIN placed USING (digest)
"""
