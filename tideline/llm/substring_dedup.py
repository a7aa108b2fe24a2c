"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Candidates come from hashes, the verdict from the words themselves:

1. Documents are dealt to blocks of a few MB by where they were read, so rows that repeat
   each other spread.  In a block every window gets a rolling hash modulo 2**61 - 1.  Each
   distinct hash leaves the block once (40 bits, in the bucket that the whole hash names),
   with a bit saying whether the block holds it more than once; so a passage in a third of
   all documents costs each bucket one entry a block, not one a document.
2. A bucket counts its hashes over all blocks and sends one bit per entry back.
3. Each block takes a BLAKE2b digest of the words of every candidate window.  Digests are
   counted like the hashes; what comes back are those that no other window shares.
4. Each block (the same exchange as in step 1) drops those, and turns what is left into
   covered words; overlapping windows merge into maximal removal intervals.

A collision of hashes therefore costs a digest and removes nothing.

Nulls: a null text has no words; a null id is an ordinary value.  Empty texts give
n_words 0.  Repeated rows are separate documents, so their windows count as repeats.
Texts shorter than the window are never touched.  Other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Bytes of a hash and of a digest that leave a block.
HASH, DIGEST = 5, 16


def _ordered(block: pa.Table) -> pa.Table:
    """The same order whenever the block is read."""
    return block.sort_by([("place", "ascending"), ("id", "ascending"), ("text", "ascending")])


def _windows(text, window: int):
    """For chunks of rows: (first row, words' starts, ends, word index of each row, first
    words of the windows, bytes)."""
    data, offsets = C.utf8(text)
    for a, b in C.row_chunks(offsets):
        part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = C.find_words(part, rows)
        begin = np.arange(max(0, len(starts) - window + 1))
        row_end = np.repeat(first[1:], np.diff(first))[: len(begin)]
        yield a, starts, ends, first, begin[begin + window <= row_end], part


def _hashes(text, window: int) -> np.ndarray:
    found = [
        C.window_hashes(C.hash_words(part, starts, ends, C.BASES[0]), window, C.BASES[1])[begin]
        for _, starts, ends, _, begin, part in _windows(text, window)
    ]
    return np.concatenate(found or [np.zeros(0, np.uint64)])


def _digests(text, window: int, chosen: np.ndarray) -> np.ndarray:
    """Digests (n, DIGEST) of the words, joined by spaces, of the chosen windows in turn."""
    out, seen = [], 0
    for _, starts, ends, _, begin, part in _windows(text, window):
        at = begin[chosen[seen : seen + len(begin)]]
        seen += len(begin)
        if len(at):
            joined, to = C.joined_words(part, starts, ends)
            out += [blake2b(joined[x:y], digest_size=DIGEST).digest() for x, y in zip(to[at].tolist(), (to[at + window] - 1).tolist())]
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, DIGEST)


def _numbers(raw: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as one or two columns of integers."""
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return list(wide.view(np.uint64).T)


def _alike(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct row of bytes, the distinct row of every row, and counts."""
    order = np.lexsort(columns := _numbers(raw))
    new = np.ones(len(raw), bool)
    if len(raw):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    inverse = np.empty(len(raw), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.bincount(inverse, minlength=int(new.sum()))


def _entries(raw: np.ndarray, bucket_of: np.ndarray, n_buckets: int):
    """Distinct rows of bytes by bucket: their bytes, whether each comes twice, where the
    buckets begin, and the entry of every row."""
    at, inverse, n = _alike(raw)
    bucket = (bucket_of[at] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    return raw[at][order], n[order] > 1, edges, place[inverse]


def _hash_entries(text, window: int, n_buckets: int):
    h = _hashes(text, window)
    return _entries(h.view(np.uint8).reshape(-1, 8)[:, :HASH], C.mix(h), n_buckets)


def _digest_entries(digests: np.ndarray, n_buckets: int):
    return _entries(digests, _numbers(digests)[0], n_buckets)


def _bits(marks: pa.Table, edges: np.ndarray) -> np.ndarray:
    """The bits that came back for a block's entries; none where no row came."""
    out = np.zeros(edges[-1], bool)
    for b, x in zip(marks["bucket"].to_pylist(), marks["bits"]):
        out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=edges[b + 1] - edges[b])
    return out


def _sent(block: int, raw: np.ndarray, twice: np.ndarray, edges: np.ndarray) -> list[tuple]:
    return [
        (block, b, raw[edges[b] : edges[b + 1]].tobytes(), np.packbits(twice[edges[b] : edges[b + 1]]).tobytes())
        for b in np.flatnonzero(np.diff(edges)).tolist()
    ]


def _table(rows: list[tuple], kinds: dict) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table({n: pa.array(v, k) for (n, k), v in zip(kinds.items(), columns)})


SENT = {"block": pa.int64(), "bucket": pa.int64(), "entries": pa.binary(), "twice": pa.binary()}
BACK = {"block": pa.int64(), "bucket": pa.int64(), "bits": pa.binary()}


def _count(width: int, repeated: bool):
    """Entries seen in two blocks, or twice in one; or all the others."""

    def run(key, bucket):
        b = key[0].as_py()
        if b < 0:  # a block's own note, handed on
            return _table([(*x, y) for *x, y in zip(*(bucket[c].to_pylist() for c in ("block", "bucket", "entries")))], BACK)
        each = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, width) for x in bucket["entries"]]
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(e)) for x, e in zip(bucket["twice"], each)]
        _, inverse, n = _alike(np.concatenate(each))
        n = n + np.bincount(inverse, np.concatenate(bits), len(n)).astype(np.int64)
        hit = np.split((n[inverse] > 1) == repeated, np.cumsum([len(e) for e in each])[:-1])
        return _table([(k, b, np.packbits(x).tobytes()) for k, x in zip(bucket["block"].to_pylist(), hit) if x.any()], BACK)

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, removed (list of
    [first word, end word) intervals) and kept_text (kept words joined by a space)."""
    spark = docs.sparkSession
    size, least = C.text_bytes(docs, text_col), C.partitions(spark)
    n_blocks = max(least, size // BLOCK_BYTES + 1)
    n_buckets = max(least, size // BUCKET_BYTES + 1)
    docs, file, row = C.located(docs)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(file, row).alias("place")
    )
    blocks = rows.withColumn("block", F.pmod("place", F.lit(n_blocks)))

    def fingerprints(key, block):
        raw, twice, edges, _ = _hash_entries(_ordered(block)["text"], window, n_buckets)
        return _table(_sent(key[0].as_py(), raw, twice, edges), SENT)

    def candidates(text, marks):
        """Which windows of the block have a repeated hash, in turn, and the bits behind that."""
        _, _, edges, entry = _hash_entries(text, window, n_buckets)
        hit = _bits(marks, edges)
        return hit[entry], hit

    def digests(key, block, marks):
        if not marks.num_rows:
            return _table([], SENT)
        text, k = _ordered(block)["text"], key[0].as_py()
        chosen, hit = candidates(text, marks)
        raw, twice, edges, _ = _digest_entries(_digests(text, window, chosen), n_buckets)
        note = (k, -1 - k, np.packbits(hit).tobytes(), b"")  # the block gets its candidates back with the rest
        return _table([note, *_sent(k, raw, twice, edges)], SENT)

    def repeated(text, marks) -> np.ndarray:
        """For every window of a block in turn: do its words start anywhere else?"""
        own = [x for b, x in zip(marks["bucket"].to_pylist(), marks["bits"]) if b < 0]
        if not own:
            return np.zeros(sum(len(begin) for *_, begin, _ in _windows(text, window)), bool)
        _, _, edges, entry = _hash_entries(text, window, n_buckets)
        out = np.unpackbits(np.frombuffer(own[0].as_py(), np.uint8), count=int(edges[-1])).astype(bool)[entry]
        alone = marks.filter(pa.array([b >= 0 for b in marks["bucket"].to_pylist()]))
        if alone.num_rows:
            _, _, edges, entry = _digest_entries(_digests(text, window, out), n_buckets)
            out[np.flatnonzero(out)[_bits(alone, edges)[entry]]] = False
        return out

    def cut(key, block, marks):
        block = _ordered(block)
        hit = repeated(block["text"], marks)
        out = {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
        seen = 0
        for _, starts, ends, first, begin, data in _windows(block["text"], window):
            again = begin[hit[seen : seen + len(begin)]]
            seen += len(begin)
            step = np.zeros(len(starts) + 1, np.int64)
            np.add.at(step, again, 1)
            np.subtract.at(step, again + window, 1)
            gone = np.cumsum(step[:-1]) > 0
            kept = ~gone
            joined, total = C.joined_words(data, starts[kept], ends[kept])
            total = total[np.concatenate([[0], np.cumsum(kept)])]  # where the words after each kept one begin
            n, lost = np.diff(first), np.concatenate([[0], np.cumsum(gone)])
            for r in range(len(n)):
                a, b = first[r], first[r + 1]
                out["n_words"].append(int(n[r]))
                out["n_removed"].append(int(lost[b] - lost[a]))
                x, y = total[a], total[b]
                out["kept_text"].append(joined[x : max(x, y - 1)].decode("utf-8", "replace"))
                spans = []
                if lost[b] > lost[a]:  # runs that touch a row's edge end there
                    inner = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    spans = inner.reshape(-1, 2).tolist()
                out["removed"].append(spans)
        made = [
            pa.array(out["n_words"], pa.int64()),
            pa.array(out["n_removed"], pa.int64()),
            pa.array(out["removed"], pa.list_(pa.list_(pa.int64()))),
            pa.array(out["kept_text"], pa.string()),
        ]
        return pa.table([block["id"], *made], names=["id", *out])

    kind = rows.schema["id"].dataType.simpleString()
    sent, back = "block long, bucket long, entries binary, twice binary", "block long, bucket long, bits binary"
    by_block = blocks.groupBy("block")
    marks = by_block.applyInArrow(fingerprints, sent).groupBy("bucket").applyInArrow(_count(HASH, True), back)
    marks = by_block.cogroup(marks.groupBy("block")).applyInArrow(digests, sent)
    marks = marks.groupBy("bucket").applyInArrow(_count(DIGEST, False), back)
    return (
        by_block.cogroup(marks.groupBy("block"))
        .applyInArrow(cut, f"id {kind}, n_words long, n_removed long, removed array<array<long>>, kept_text string")
        .withColumnRenamed("id", id_col)
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), starts AS (
  SELECT rid, words, unnest(range(1, len(words) - 33)) AS p FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT rid, p, md5(array_to_string(list_slice(words, p, p + 34), ' ')) AS h FROM starts
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT rid, p FROM windows SEMI JOIN repeated USING (h)
), gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM hit
), word AS (
  SELECT rid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM docs
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
