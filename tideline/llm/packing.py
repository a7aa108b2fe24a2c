"""Order-preserving packing of token streams by dynamic programming.

Documents are range-partitioned and sorted by ``order``; a partition's documents, each
closed by ``end_id``, are one token stream.  Windows of at most ``capacity`` tokens cut
the stream at document ends (free), sentence ends (``SENTENCE``) or, inside very long
sentences, every ``HARD_STEP`` tokens (``HARD``).  The best cost up to a cut j is

    penalty(j) + capacity - j + min over cuts i in [j - capacity, j) of (cost(i) + i)

so the minimum moves with a window and a monotone queue gives every transition in
constant time.  The stream goes through in stretches of ``STRETCH`` tokens; what lies
behind a stretch's best last cut is carried on, so memory does not grow with the
partition.  A partition's last window is cut into powers of two, which need no padding.

Rows that tie in ``order`` (equal or null ids) are told apart by where they were read, so
they spread over partitions like any others.

Null text counts as empty: such a document is its end token alone.  Documents of any
length are split over windows; repeated rows are packed each for itself; a null id is
carried along.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import word_tokenizer

CAPACITY, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
SENTENCE, HARD, HARD_STEP = 8.0, 64.0, 256
STRETCH, SHARD_BYTES = 1 << 19, 64 << 20


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, capacity: int, closed: bool) -> np.ndarray:
    """Positions of the chosen cuts, beginning with 0.  ``cuts`` ascends from above 0 in
    steps of at most ``capacity``.  Of the last ``capacity`` tokens, the cheapest cut ends
    the full windows; what follows it is the last window, which costs no padding, if
    ``closed``, and is otherwise left for later."""
    where = [0, *cuts.tolist()]
    extra = [0.0, *penalty.tolist()]
    cost, back = [0.0] * len(where), [0] * len(where)
    queue, value, head = [0], [0.0], 0  # candidates by ascending cost + position
    for j in range(1, len(where)):
        p = where[j]
        while where[queue[head]] < p - capacity:
            head += 1
        back[j] = queue[head]
        now = value[head] + capacity + extra[j]
        cost[j] = now - p
        while len(queue) > head and value[-1] >= now:
            queue.pop()
            value.pop()
        queue.append(j)
        value.append(now)
    end = len(where) - 1
    first = bisect_left(where, where[end] - capacity)
    j = min(range(first, end + (not closed)), key=cost.__getitem__, default=0) or (0 if closed else end)
    if closed:
        j, back[end] = end, j
    chosen = []
    while j:
        chosen.append(where[j])
        j = back[j]
    return np.array([0, *chosen[::-1]])


def with_hard_cuts(cuts: np.ndarray, penalty: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.diff(cuts, prepend=0)
    n = np.where(gaps > 2 * step, (gaps - 1) // step, 0)
    more = np.repeat(cuts - gaps - step * (np.cumsum(n) - n), n) + step * (np.arange(n.sum()) + 1)
    both = np.concatenate([cuts, more])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([penalty, np.full(len(more), HARD)])[order]


class Stream:
    """Tokens of documents in order, not yet packed."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.shard = capacity, 0, 0
        self.parts, self.n = [], 0
        self.ids, self.begins, self.ends, self.cuts, self.penalties = [], [], [], [], []

    def add(self, doc_ids: list, tokens: np.ndarray, sizes: np.ndarray, sentence_ends: np.ndarray) -> None:
        ends = self.n + np.cumsum(sizes)
        self.ids += doc_ids
        self.begins.append(ends - sizes)
        self.ends.append(ends)
        both = np.concatenate([ends, self.n + sentence_ends])
        order = np.argsort(both, kind="stable")
        self.cuts.append(both[order])
        self.penalties.append(np.repeat([0.0, SENTENCE], [len(ends), len(sentence_ends)])[order])
        self.parts.append(tokens)
        self.n += len(tokens)

    def flush(self, closed: bool):
        """Pack what is there, but for the open end, and keep the rest."""
        if not self.n:
            return None
        tokens = np.concatenate(self.parts)
        begins, ends = np.concatenate(self.begins), np.concatenate(self.ends)
        cuts, penalty = with_hard_cuts(
                np.concatenate(self.cuts), np.concatenate(self.penalties), min(HARD_STEP, max(1, self.capacity // 2))
            )
        chosen = best_cuts(cuts, penalty, self.capacity, closed)
        if closed:
            at, rest = chosen[-2], int(chosen[-1] - chosen[-2])
            tail = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
            chosen = np.concatenate([chosen[:-1], at + np.cumsum(tail)])
        last = int(chosen[-1])
        some = begins < last
        edges = np.unique(np.concatenate([chosen, np.maximum(begins[some], 0)]))
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(begins, a, "right") - 1
        window = np.searchsorted(chosen, a, "right") - 1
        raw = memoryview(np.ascontiguousarray(tokens, "<u4")).cast("B")
        out = pa.table(
            {
                "id": pa.array([self.ids[d] for d in doc.tolist()], type=self.id_type),
                "start": a - begins[doc],
                "length": b - a,
                "ids_crc32": np.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())], np.int64),
                "doc_tokens": ends[doc] - begins[doc],
                "sequence_id": (self.shard << 32) + self.sequence + window,
                "offset": a - chosen[window],
            }
        )
        self.sequence += len(chosen) - 1
        stay = ends > last
        self.ids = [self.ids[d] for d in np.flatnonzero(stay).tolist()]
        self.begins, self.ends = [begins[stay] - last], [ends[stay] - last]
        ahead = cuts > last
        own = ahead & (penalty != HARD)
        self.cuts, self.penalties = [cuts[own] - last], [penalty[own]]
        self.parts, self.n = [tokens[last:]], len(tokens) - last
        return out


def pack(
    docs: DataFrame,
    order: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    n = max(C.partitions(spark), C.text_bytes(docs, text_col) // SHARD_BYTES + 1)
    docs, file, row = C.located(docs)
    by = [*(F.col(c) for c in order or [id_col]), F.xxhash64(file, row)]
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(f"by{k}") for k, c in enumerate(by)]
    )
    keys = [f"by{k}" for k in range(len(by))]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches):
        stream, words = Stream(capacity), word_tokenizer(tokenizer)
        stream.shard = TaskContext.get().partitionId()
        for batch in batches:
            stream.id_type = batch.schema.field("id").type
            ids = batch.column("id")
            data, offsets = C.utf8(batch.column("text"))
            for a, b in C.row_chunks(offsets, 2 << 20):
                part, rows_at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = C.find_words(part, rows_at)
                tokens, size = words.chunk(part, starts, ends)
                row = np.repeat(np.arange(b - a), np.diff(first))
                sums = np.concatenate([[0], np.cumsum(size)])
                closes = np.append(sums[first[1:]] + np.arange(b - a), 0)[:-1]  # where each end token goes
                tokens = np.insert(tokens, sums[first[1:]], end_id)
                sizes = np.diff(sums[first]) + 1
                # a word that ends a sentence or a line, unless it is its document's last
                stop = np.isin(part[ends - 1], (0x2E, 0x21, 0x3F)) if len(ends) else np.zeros(0, bool)
                line = np.zeros(len(ends), bool)
                more = ends < len(part)
                line[more] = part[ends[more]] == 0x0A
                inner = np.ones(len(ends), bool)
                inner[first[1:][np.diff(first) > 0] - 1] = False
                cut = (sums[1:] + row)[(stop | line) & inner]
                cut = cut[~np.isin(cut, closes)]
                stream.add(ids.slice(a, b - a).to_pylist(), tokens, sizes, np.unique(cut))
                if stream.n >= stretch:
                    yield from stream.flush(False).to_batches()
        if (last := stream.flush(True)) is not None:
            yield from last.to_batches()
        del stream, last
        C.release()

    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(
        run,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    ).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
