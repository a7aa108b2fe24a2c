"""SimHash near-duplicates, found by BK-trees over shards of fingerprints.

Fingerprints within ``radius`` bits that are cut into radius + k blocks agree in at
least k of them, so every link lies in a shard: the fingerprints that share some k
blocks.  k is the smallest that leaves shards of about one tree.  A shard of more than
``TREE`` fingerprints is cut into trees of bounded size, and each tree is sent to every
chunk of its shard (see ``components.cells``): that is the broadcast of shard trees,
by key and with a bound.  A tree keys its children by their integer distance to the
parent; a query at distance d of a node follows only the edges d-radius to d+radius.
All trees of an Arrow batch are grown and searched together, level by level.

Only distinct fingerprints take part, so copies cost nothing, and a task sends on a
spanning forest of its links.  Components then come from joins.

Null and empty texts have no words and fingerprint zero, linked like any other; fewer
than four words are one shingle.  Repeated rows share a fingerprint.  A null id is
larger than any other as a component id.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected, forest, join_heavy, per_cells

SHINGLE, RADIUS, SEED, TREE = 4, 4, 42, 4096


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int):
    """XXH64 of every shingle of every row, and the row of each."""
    data = C.LOWER[data]
    starts, ends, first = C.find_words(data, offsets)
    n = np.diff(first)
    length = ends - starts
    to = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    mark = np.zeros(len(data) + 1, np.int64)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)
    joined[inside] = data[np.cumsum(mark[:-1]) > 0]
    joined = joined.tobytes()
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    last = np.minimum(at + width, first[row + 1]) - 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    spans = zip(to[at].tolist(), (to[last] + length[last]).tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(row)), row, count


def simhash(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half of the shingle hashes."""
    data, offsets = C.utf8(texts)
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for a, b in C.row_chunks(offsets):
        h, row, count = _shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        ones = np.zeros((b - a, 64), np.int64)
        for k in range(0, len(h), 1 << 16):
            part, r = h[k : k + (1 << 16)], row[k : k + (1 << 16)]
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[r[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        out[a:b] = ((2 * ones > count[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, carry: list[str], text_col: str, width: int = SHINGLE) -> DataFrame:
    """The columns ``carry`` and fp: the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp = simhash(batch.column(text_col), width).view(np.int64)
            yield batch.select(carry).append_column("fp", pa.array(fp))
        C.release()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, text_col).mapInArrow(run, f"{fields}, fp long")


# ------------------------------------------------------------------- BK-trees


def grow(fp: np.ndarray, tree: np.ndarray):
    """BK-trees of distinct fingerprints, one for each value of ``tree`` (sorted).

    Returns each tree's root and the edges: sorted keys parent * 65 + distance, children.
    """
    roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    parent = np.repeat(roots, np.diff(np.append(roots, len(tree))))
    rest = np.setdiff1d(np.arange(len(fp)), roots, assume_unique=True)
    keys, children = [], []
    while len(rest):
        key = parent[rest] * 65 + np.bitwise_count(fp[rest] ^ fp[parent[rest]])
        edge, first, which = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        children.append(rest[first])
        parent[rest] = rest[first][which]
        placed = np.zeros(len(rest), bool)
        placed[first] = True
        rest = rest[~placed]
    keys = np.concatenate(keys or [np.zeros(0, np.int64)])
    children = np.concatenate(children or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return roots, keys[order], children[order]


def search(fp, roots, keys, children, queries, query_root, radius):
    """Pairs (query index, node) within the radius, following only edges that can hold any."""
    for k in range(0, len(queries), 1024):
        q = np.arange(k, min(k + 1024, len(queries)))
        node = roots[query_root[q]]
        while len(q):
            d = np.bitwise_count(queries[q] ^ fp[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            q = np.repeat(q, n)
            node = children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]


def _spanning(cell, fp, chunk, i, j, radius):
    """Links (fingerprint, local root) of a batch of whole cells."""
    member, asks = chunk == j, chunk == i
    present = np.unique(cell[member])
    asks &= np.isin(cell, present)
    tree_fp, queries = fp[member], fp[asks]
    if not len(tree_fp) or not len(queries):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    roots, keys, children = grow(tree_fp, cell[member])
    names, at = np.unique(fp, return_inverse=True)
    node_at, query_at = at[member], at[asks]
    label = np.arange(len(names))
    for q, node in search(tree_fp, roots, keys, children, queries, np.searchsorted(present, cell[asks]), radius):
        x, y = label[query_at[q]], label[node_at[node]]
        other = x != y
        if other.any():
            label = forest(x[other], y[other], len(names))[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def near_links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """``nodes``: distinct longs fp.  Links (a, b) that connect all fingerprints within
    ``radius`` bits of each other."""
    n, keep = nodes.count(), 1
    while n >> (64 * keep // (radius + keep)) > tree // 4 and keep < 4:
        keep += 1
    parts = radius + keep
    edge = [64 * p // parts for p in range(parts + 1)]
    blocks = [sum(1 << bit for bit in range(edge[p], edge[p + 1])) for p in range(parts)]
    masks = [sum(c) for c in combinations(blocks, keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = nodes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(signed)])
        ).alias("s"),
    ).select("fp", "s.t", "s.v")

    def links(t, cell):
        fp = t["fp"].to_numpy().view(np.uint64)
        a, b = _spanning(cell, fp, t["chunk"].to_numpy(), t["i"].to_numpy(), t["j"].to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return per_cells(shards, ["t", "v"], "fp", tree, links, "a long, b long")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id (the smallest id reachable),
    kept and locator (as ``common.located`` gives it).  One row of each class is kept: the one
    with the smallest id, null last, and of those the first by fingerprint and locator."""
    docs, file, row = C.located(docs)
    rows = docs.select(
        F.col(id_col).alias("id"), F.struct(F.col(file).alias("file"), F.col(row).alias("row")).alias("locator"), F.col(text_col).alias("text")
    )
    prints = C.stash(fingerprints(rows, ["id", "locator"], "text", width), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "locator")).alias("least")
    nodes = C.stash(prints.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "nodes")
    roots = connected(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = C.stash(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    heads = named.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("prints"))
    found = C.stash(join_heavy(named.select("fp", "n", "root"), heads, "root", "prints").select("fp", "n", "head"), "heads")
    return join_heavy(prints, found, "fp", "n").select(
        F.col("id").alias(id_col), "fp", F.col("head.id").alias("component_id"), (F.col("locator") == F.col("head.locator")).alias("kept"), "locator"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id (smallest id reachable)."""
    return classes(docs, id_col, text_col, width, radius).drop("kept", "locator")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
