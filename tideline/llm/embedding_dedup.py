"""Embedding near-duplicates by spherical-cap filters from structured random codes.

A code rotates the space at random, cuts it in two halves and draws ``words`` random
directions in each; every pair of them, joined, is a filter direction, so 2 * words
directions give words**2 filters.  A vector passes every filter whose direction it
exceeds a cap with, and at least its few best of each code; the list is decoded from the
two halves' products, without scoring all pairs.  Vectors of one label that share a
filter are compared in double precision, and links of cosine ``threshold`` or more
remain.  Large filters are cut into chunks whose pairs are compared in different tasks
(``components.cells``): nothing is capped.

``words`` doubles as the table grows fourfold, so that a filter holds about as many vectors
at every size, and the cap rises so that a random vector passes about PASSED filters of each
code.  Higher caps part near vectors more often; one more best filter for each doubling
makes up for that: ``test_filter_recall`` asks that 98 % of vectors of 64 dimensions at
cosine 0.93 share a filter, at 128, 512 and 4096 words.

A pair is counted only in the smallest filter its two vectors share.  A task returns
counts and a spanning forest, never pairs.  Equal vectors of a label take part once,
with their number.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null label, link with nothing: n_links 0, component_id their own id.  Vectors of
different length do not link.  Rows that repeat id and vector count as copies; rows that
repeat an id under another label or with another vector are vectors of their own.  A row
with a null id links like any other; component_id is the smallest id that is not null, or
null.  Vectors of up to SHORT dimensions go to the boxes of a grid that can hold a link
instead of to filters, which lose too many of their links; nothing is lost there.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected, forest, join_heavy, per_cells

THRESHOLD = 0.93
CODES, WORDS, PASSED, LEAST = 4, 128, 3.54, 3
#: Names of filters fit an int up to here, and the directions of 64 dimensions 34 MB.  From
#: a billion vectors on filters hold more vectors each, and are cut like any large one.
MOST_WORDS = 1 << 14
CELL = 2048
#: Vectors of up to so many dimensions go to the boxes of a grid: caps part too many of them.
SHORT = 8


def code_size(n: int) -> int:
    """Directions in each half of a code, for a table of n vectors: about as many filters."""
    words = WORDS
    while CODES * words * words < n and words < MOST_WORDS:
        words *= 2
    return words


@lru_cache(maxsize=8)
def codes(d: int, words: int):
    rng, out = np.random.default_rng(20240 + d), []
    for _ in range(CODES):
        turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
        halves = []
        for size in (d // 2, d - d // 2):
            c = rng.standard_normal((words, size))
            halves.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2))
        out.append((turn, *halves))
    return out


def boxes(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) for short vectors: all boxes of a grid that a vector comes within half the
    greatest distance of linked vectors of.  Linked vectors share one: half-way between two
    is near both."""
    reach = np.sqrt(max(2 - 2 * threshold, 0.0)) * (1 + 1e-9)
    width = max(1.0, reach)
    row, name = np.arange(len(x)), np.zeros(len(x), np.int64)
    low, high = (np.floor((x + s * reach / 2) / width).astype(np.int64) + 2 for s in (-1, 1))
    for k in range(x.shape[1]):
        two = np.flatnonzero(low[row, k] != high[row, k])
        name, row = np.concatenate([name + (low[row, k] << 2 * k), name[two] + (high[row[two], k] << 2 * k)]), np.concatenate([row, row[two]])
    order = np.lexsort((name, row))
    return row[order], name[order]


def decode(x: np.ndarray, words: int = WORDS, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that the unit vectors ``x`` pass, by row and filter."""
    if x.shape[1] <= SHORT:
        return boxes(x, threshold)
    d = x.shape[1]
    words = min(words, WORDS << max(0, (d - SHORT - 1) // 4))  # in few dimensions finer filters part linked vectors
    cap = NormalDist().inv_cdf(1 - PASSED / words**2) / np.sqrt(d)
    least, half, rows, names = LEAST + (words // WORDS).bit_length() - 1 + (3 if d <= 24 else 0), d // 2, [], []
    step = max(1, (1 << 21) // words)  # rows at a time, so that products stay small
    for k, (turn, left, right) in enumerate(codes(x.shape[1], words)):
        for start in range(0, len(x), step):
            y = x[start : start + step] @ turn
            a, b = y[:, :half] @ left.T, y[:, half:] @ right.T
            best = (-np.partition(-v, least - 1, axis=1)[:, :least] for v in (a, b))
            sums = (next(best)[:, :, None] + next(best)[:, None, :]).reshape(len(y), -1)
            at = np.minimum(cap, np.sort(sums, axis=1)[:, -least])
            at -= 1e-12  # the best pass whatever the rounding
            row, first = np.nonzero(a >= (at - b.max(axis=1))[:, None])
            pair, second = np.nonzero(b[row] >= (at[row] - a[row, first])[:, None])
            rows.append(row[pair] + start)
            names.append((k * words + first[pair]) * words + second)
    row, name = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (rows, names))
    order = np.lexsort((name, row))
    return row[order], name[order]


def _matrix(column) -> np.ndarray:
    """Unit vectors in double precision from a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(words: int, threshold: float):
    def run(batches):
        for batch in batches:
            size = batch.column("d").to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                row, name = decode(_matrix(part.column("vec")), words, threshold)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(name, pa.int32()))
                out = part.append_column("filters", lists).take(pa.array(row))
                yield out.append_column("filter", pa.array(name, pa.int32()))

    return run


def _compare(threshold: float):
    def run(t: pa.Table, cell: np.ndarray) -> pa.Table:
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        rep, n, name = (t[c].to_numpy() for c in ("node", "n", "filter"))
        chunk, ci, cj = (t[c].to_numpy() for c in ("chunk", "i", "j"))
        nodes, links, roots = [], [], []
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < 2:
                continue
            own = np.arange(a, b)
            one, two = own[chunk[a:b] == ci[a]], own[chunk[a:b] == cj[a]]
            if not len(one) or not len(two):
                continue
            x = _matrix(t["vec"].slice(a, b - a))
            near = x[one - a] @ x[two - a].T >= threshold
            if ci[a] == cj[a]:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            touched = np.flatnonzero(np.isin(own, np.concatenate([one[near.any(1)], two[near.any(0)]])))
            # of the filters below this one, which are shared: those pairs are counted there
            lists = t["filters"].combine_chunks().take(pa.array(own[touched]))
            who = np.repeat(np.arange(len(touched)), np.diff(lists.offsets.to_numpy()))
            below = lists.flatten().to_numpy()
            small = below < name[a]
            kinds, kind = np.unique(below[small], return_inverse=True)
            has = np.zeros((b - a, len(kinds)), np.float32)
            has[touched[who[small]], kind] = 1
            first = near & (has[one - a] @ has[two - a].T == 0)
            count = np.zeros(b - a, np.int64)
            count[one - a] += first @ n[two]
            if ci[a] != cj[a]:
                count[two - a] += n[one] @ first
            p, q = np.nonzero(near)
            order = np.argsort(rep[a:b], kind="stable")  # so that the root is the smallest
            place = np.empty_like(order)
            place[order] = np.arange(b - a)
            label = order[forest(place[one[p] - a], place[two[q] - a], b - a)][place]
            nodes.append(rep[own[touched]])
            links.append(count[touched])
            roots.append(rep[own[label[touched]]])
        empty = [np.zeros(0, np.int64)]
        return pa.table({c: np.concatenate(v or empty) for c, v in (("a", nodes), ("links", links), ("b", roots))})

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id."""
    label = F.col(label_col).cast("string")
    name = F.sha2(F.concat_ws(":", F.length(label).cast("string"), label, F.col(vec_col).cast("string")), 256)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.alias("label"), name.alias("name"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    # equal vectors of a label are one node, with a number of its own: ids may repeat
    first = F.min(F.struct("label", "vec"))
    reps = good.groupBy("name").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), first.alias("f"))
    reps = C.stash(reps.select("name", "least", "n", "f.label", "f.vec", F.monotonically_increasing_id().alias("node")), "vectors")
    named = reps.select(F.md5("label").alias("label"), F.size("vec").alias("d"), "node", "n", "vec")
    kind = reps.schema["vec"].dataType.simpleString()
    filtered = named.mapInArrow(
        _filtered(code_size(reps.count()), threshold), f"label string, d int, node long, n long, vec {kind}, filters array<int>, filter int"
    )
    found = C.stash(
        per_cells(filtered, ["label", "d", "filter"], "node", CELL, _compare(threshold), "a long, links long, b long"),
        "near-vectors",
    )
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = C.stash(connected(found.select("a", "b")), "roots")
    light = reps.select("name", "node", "least", "n")
    of_node = roots.join(light, "node").groupBy("root").agg(F.min("least").alias("smallest"))
    of_node = roots.join(of_node, "root").select("node", "smallest")
    classes = (
        light.join(links.withColumnRenamed("a", "node"), "node", "left")
        .join(of_node, "node", "left")
        .select("name", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    )
    linked = join_heavy(good.select("id", "name"), classes, "name", "n").select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(C.table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings
), link AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b
    ON a.ok AND b.ok AND a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links,
       min(w.vec_id) AS component_id, v.vec_id = min(w.vec_id) AS kept
FROM v JOIN reach ON reach.a = v.r JOIN v w ON w.r = reach.b
GROUP BY v.r, v.vec_id
"""
