"""Compression of vectors to short codes: product quantisation by Heap Lloyd.

Components become whole numbers (floor of ``scale`` times each), vectors are cut into
``parts`` equal stretches, and each part position gets a codebook of ``entries`` entries by
Lloyd's rounds, in whole numbers throughout, so that results don't depend on how rows are
dealt to tasks.

A table of blocks of at most BLOCK vectors carries the state from round to round: each
block holds its vectors' whole numbers, their codes, and one heap per part position and
entry, keyed by the lower bound of the distance to any other entry minus the upper bound of
the distance to the own one.  When codebooks move, no bound is touched: the driver adds to
each entry's cumulative drift its own move and the largest move of another entry.  A block
then looks at the root of each heap and pops parts as long as their key is not above that
drift; only those are compared with all entries again, exactly, and pushed to the heap of
their nearest entry.  A heap is kept as one ascending run, so that popping cuts off its
front.  What a block returns besides its new state are the sums that left and joined each
entry; they are added up in Spark, and the driver gets one number per entry and component.
Each round writes the state to the shared folder, so a lost executor repeats its blocks.

Rows whose vector is null, empty or holds null or non-finite components are dropped, and so
are rows whose vector is not as long as that of the row with the smallest identifier.
Vectors that ``parts`` does not divide are filled up with zeros.  Whole numbers beyond 2**28
either way are set to that bound.  A null identifier is the largest; of rows that repeat one
the smaller vector, then the row read first, comes first among the first entries.  With
fewer rows than ``entries`` the codebooks are as small.  Ties go to the lower entry, entries
without parts stay, null labels count as one label.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import join_heavy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 1024
#: Bound of the whole numbers: squared distances of parts of up to 8 components fit a long.
MOST = 1 << 28
#: What rounding may take from a bound, as a share of the distances it is made of.
SLACK = 1e-9


@dataclass
class Codebooks:
    """Entries (part, entry, component) and the cumulative drift of each entry."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, sums: dict) -> Codebooks:
        """Each entry replaced by the floor of its parts' mean; ``sums`` holds number and
        componentwise sums by (part, entry)."""
        new = self.entries.copy()
        for (part, entry), (n, *total) in sums.items():
            if n:
                new[part, entry] = [t // n for t in total]
        move = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + SLACK)
        if move.shape[1] > 1:
            most = np.sort(move, axis=1)
            other = np.where(move == most[:, -1:], most[:, -2:-1], most[:, -1:])  # the largest move of the others
            other = np.where((move == most[:, -1:]).sum(axis=1, keepdims=True) > 1, most[:, -1:], other)
        else:
            other = np.zeros_like(move)
        return Codebooks(new, self.drift + move + other)

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def compare(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (of equals the lower) of each part, and how much farther, less what
    rounding may hide, the second nearest is."""
    far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    code = far.argmin(axis=1)
    own = np.sqrt(far[np.arange(len(x)), code].astype(np.float64))
    if far.shape[1] == 1:
        return code, np.full(len(x), np.inf)
    far[np.arange(len(x)), code] = np.iinfo(np.int64).max
    second = np.sqrt(far.min(axis=1).astype(np.float64))
    return code, second - own - SLACK * (second + own + 1)


class Heaps:
    """The heaps of one part position of a block: members by entry and ascending key."""

    def __init__(self, code: np.ndarray, member: np.ndarray, key: np.ndarray):
        self.code, self.member, self.key = code, member, key

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Members whose key their entry's drift has caught up with; they leave the heaps."""
        entry = self.code[self.member]
        ends = np.searchsorted(entry, np.arange(len(drift) + 1))
        out = []
        for e in np.flatnonzero(ends[1:] > ends[:-1]):
            a, b = ends[e], ends[e + 1]
            if self.key[a] <= drift[e]:
                out.append(np.arange(a, a + np.searchsorted(self.key[a:b], drift[e], "right")))
        if not out:
            return np.zeros(0, np.int64)
        gone = np.concatenate(out)
        popped = self.member[gone]
        self.member, self.key = np.delete(self.member, gone), np.delete(self.key, gone)
        return popped

    def push(self, member: np.ndarray, key: np.ndarray) -> None:
        member, key = np.concatenate([self.member, member]), np.concatenate([self.key, key])
        order = np.lexsort((key, self.code[member]))
        self.member, self.key = member[order], key[order]


def scan(x: np.ndarray, part: int, book: np.ndarray, drift: np.ndarray, heaps: Heaps, popped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compares the popped parts again and pushes them; (number and sums) that entries won
    and lost by it."""
    w = book.shape[1]
    values = x[popped, part * w : (part + 1) * w]
    before = heaps.code[popped]
    code, ahead = compare(values, book)
    heaps.code[popped] = code
    heaps.push(popped, ahead + drift[code])
    change = np.zeros((len(book), w + 1), np.int64)
    weighed = np.column_stack([np.ones(len(popped), np.int64), values])
    new = code != before
    np.add.at(change, code[new], weighed[new])
    old = new & (before >= 0)
    np.subtract.at(change, before[old], weighed[old])
    entries = np.flatnonzero(change.any(axis=1))
    return entries, change[entries]


STATE = "x binary, code binary, member binary, key binary, moves array<struct<part:int,entry:int,sums:array<long>>>"
_MOVES = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))]))


def _advance(x: np.ndarray, heaps: list[Heaps], books: Codebooks) -> tuple[bytes, bytes, bytes, list]:
    moves = []
    for p, h in enumerate(heaps):
        popped = h.pop(books.drift[p]) if len(h.member) else np.arange(len(x))
        if len(popped):
            entries, change = scan(x, p, books.entries[p], books.drift[p], h, popped)
            moves += [{"part": p, "entry": int(e), "sums": c.tolist()} for e, c in zip(entries, change)]
    return (
        np.stack([h.code for h in heaps], axis=1).astype(np.uint8).tobytes(),
        np.concatenate([h.member for h in heaps]).astype("<i2").tobytes(),
        np.concatenate([h.key for h in heaps]).astype("<f8").tobytes(),
        moves,
    )


def _block(row: dict, parts: int) -> tuple[np.ndarray, list[Heaps]]:
    code = np.frombuffer(row["code"], np.uint8).reshape(-1, parts).astype(np.int64)
    n = len(code)
    member, key = np.frombuffer(row["member"], "<i2").astype(np.int64), np.frombuffer(row["key"], "<f8")
    x = np.frombuffer(row["x"], "<i4").reshape(n, -1).astype(np.int64)
    return x, [Heaps(code[:, p].copy(), member[p * n : (p + 1) * n], key[p * n : (p + 1) * n]) for p in range(parts)]


def _start(books: Codebooks, scale: float):
    """Batches of (id, label, vec) to blocks, all parts compared with the first codebooks."""
    parts, _, w = books.entries.shape

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = whole(part.column("vec"), parts, scale)
                heaps = [Heaps(np.full(len(x), -1), np.zeros(0, np.int64), np.zeros(0)) for _ in range(parts)]
                state = _advance(x, heaps, books)
                one = pa.array([0, len(x)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(one, part.column("id")), pa.ListArray.from_arrays(one, part.column("label")),
                        pa.array([x.astype("<i4").tobytes()]), *(pa.array([v]) for v in state[:3]), pa.array([state[3]], _MOVES),
                    ],
                    ["id", "label", "x", "code", "member", "key", "moves"],
                )

    return run


def _round(books: Codebooks):
    """Blocks to blocks: parts that the drift has caught up with are compared again."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x, heaps = _block({c: one.column(c)[0].as_py() for c in ("x", "code", "member", "key")}, len(books.entries))
                state = _advance(x, heaps, books)
                yield pa.RecordBatch.from_arrays(
                    [one.column("id"), one.column("label"), one.column("x"), *(pa.array([v]) for v in state[:3]), pa.array([state[3]], _MOVES)],
                    ["id", "label", "x", "code", "member", "key", "moves"],
                )

    return run


def _finish(books: Codebooks):
    """Blocks to one row a vector: id, label, code, error."""
    parts, _, w = books.entries.shape

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x, heaps = _block({c: one.column(c)[0].as_py() for c in ("x", "code", "member", "key")}, parts)
                codes = _advance(x, heaps, books)[0].hex()
                near = np.concatenate([books.entries[p][h.code] for p, h in enumerate(heaps)], axis=1)
                error = ((x - near) ** 2).sum(axis=1)
                width = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [one.column("id").flatten(), one.column("label").flatten(), pa.array([codes[i : i + width] for i in range(0, len(codes), width)]), pa.array(error)],
                    ["id", "label", "code", "error"],
                )

    return run


def whole(vectors, parts: int, scale: float) -> np.ndarray:
    """Whole numbers of vectors of equal length, filled up to equal parts."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def sums_of(state: DataFrame) -> dict:
    """Number and sums that joined each entry, less those that left: bounded by the codebooks."""
    moves = state.select(F.explode("moves").alias("m")).select("m.part", "m.entry", F.posexplode("m.sums").alias("at", "v"))
    # a table's sum may need more than a long
    found = moves.groupBy("part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict = {}
    for part, entry, at, v in sorted(map(tuple, found)):
        out.setdefault((part, entry), []).append(int(v))
    return out


def quantize(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """One row per usable row of ``vectors``: id, label, code (two hex digits a part) and
    error (squared distance of its whole numbers to the coded ones); and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.where(F.coalesce(finite & (F.size("vec") > 0), F.lit(False)))
    order = [F.col("id").asc_nulls_last(), F.col("vec")]
    first = good.orderBy(*order).select("vec").first()
    if first is None:
        kinds = rows.dtypes
        return good.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false").select(*[F.col(c).cast(t) for c, t in kinds[:2]], "code", "error"), None
    good = good.where(F.size("vec") == len(first["vec"]))
    begin = good.orderBy(*order).limit(entries).select("vec").collect()  # at most 256 vectors
    x = whole(pa.array([r["vec"] for r in begin], pa.list_(pa.float64())), parts, scale)
    books = x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()
    books = Codebooks(books, np.zeros(books.shape[:2]))
    schema = f"id array<{rows.schema['id'].dataType.simpleString()}>, label array<{rows.schema['label'].dataType.simpleString()}>, {STATE}"
    state, sums = None, {}
    for _ in range(rounds):
        step = good.mapInArrow(_start(books, scale), schema) if state is None else state.mapInArrow(_round(books), schema)
        state = C.stash(step, "heaps")
        for at, change in sums_of(state).items():
            sums[at] = [a + b for a, b in zip(sums.get(at, [0] * len(change)), change)]
        books = books.moved(sums)
    if state is None:
        state = C.stash(good.mapInArrow(_start(books, scale), schema), "heaps")
    out = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return state.mapInArrow(_finish(books), out), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = quantize(C.table(spark, sf_dir, "embeddings"))
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    found = C.stash(found.withColumn("name", name), "codes")
    by_label = found.groupBy("name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return join_heavy(found, by_label, "name", "_n").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _assign_sql(k: int) -> str:
    """Nearest entry of each part under the codebooks of round k; then the next codebooks."""
    return f"""near{k} AS MATERIALIZED (
  SELECT r, p, e, dist FROM (
    SELECT q.r, q.p, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist,
           row_number() OVER (PARTITION BY q.r, q.p ORDER BY dist, b.e) AS place
    FROM q JOIN book{k} b USING (p)
  ) WHERE place = 1
)"""


def _book_sql(k: int) -> str:
    return f"""book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS v
      FROM (SELECT n.p, n.e, unnest(q.v) AS x, generate_subscripts(q.v, 1) AS i FROM near{k} n JOIN q USING (r, p)) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m USING (p, e)
)"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding,
         list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT r, p, list_slice(x, p * len(x) // {PARTS} + 1, (p + 1) * len(x) // {PARTS}) AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM q WHERE r <= {ENTRIES}),
{", ".join(f"{_assign_sql(k)}, {_book_sql(k)}" for k in range(ROUNDS))},
{_assign_sql(ROUNDS)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near{ROUNDS} GROUP BY r
), entries AS (
  SELECT string_agg(array_to_string(v, ','), ',' ORDER BY p, e) AS t FROM book{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(t) AS codebooks_sha256
FROM coded JOIN kept USING (r), entries
"""
