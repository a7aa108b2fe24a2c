"""Importance resampling towards a target corpus over bucket-partitioned inverted postings.

Texts are lower-cased (A-Z only); words are runs of digits, letters a-z and characters
beyond ASCII.  Features are all runs of 1 to ``grams`` consecutive words, joined by one
space, with repeats; the bucket of a feature is the CRC-32 of its UTF-8 bytes modulo
``buckets``.  The corpus is inverted by stretches of CHUNK rows: a posting list holds, for
one bucket and one stretch, the rows that have it and how often.  However frequent a
feature, a stretch has one list for it, of at most CHUNK rows.

Lists are shuffled by bucket, each bucket dealt to SALTS keys, and meet the bucket's gain
there: floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of its counts s in the
corpus and t in the target, which are summed before the shuffle and co-grouped by bucket.
A list with its gain is the contribution to the weights of its rows; contributions are
shuffled by stretch and summed there.  Gumbel noise of a hash of the identifier is added,
and of the rows with at least ``least`` words the ``share`` with the highest scores is drawn.

Null and empty texts have no features and weight 0.  Of equal scores the smaller identifier
comes first, a null one last, then the row read first.  A null identifier is hashed as an
empty one; rows that repeat an identifier get the same noise.  An empty target has no
counts; an empty corpus gives no row.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS, GRAMS, LEAST, SHARE, SEED = 10_000, 1, 20, (10, 100), "2024"
#: Rows of one stretch, and keys of one bucket.
CHUNK, SALTS = 2048, 16
#: The bucket of the list that holds a stretch's own rows.
OWN = -1
LIST = "file long, chunk long, bucket int, at array<smallint>, n array<int>, total long"

BETWEEN = np.ones(256, bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False


def features(data: np.ndarray, offsets: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of lower-cased texts, and each row's number of words."""
    starts, ends, first = C.find_words(data, offsets, BETWEEN)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    crc = C.crc_ranges(data, starts, ends)
    space = np.full(1, 0x20, np.uint8)
    rows, names = [row], [crc % np.uint32(buckets)]
    for k in range(1, grams):  # runs of k + 1 words go on from those of k, where the row does
        goes_on = np.flatnonzero(row[: len(row) - k] == row[k:])
        longer = np.zeros(len(row), np.uint32)
        zero = np.zeros(len(goes_on), np.int64)
        spaced = C.crc_ranges(space, zero, zero + 1, crc[goes_on])
        longer[goes_on] = C.crc_ranges(data, starts[goes_on + k], ends[goes_on + k], spaced)
        crc = longer
        rows.append(row[goes_on])
        names.append(crc[goes_on] % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(names).astype(np.int64), words


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def invert(grams: int, buckets: int):
    """Batches of (file, row, id, text) to posting lists."""

    def lists(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        file, at = part.column("file").to_numpy(), part.column("row").to_numpy()
        row, bucket, words = features(C.LOWER[data], offsets, grams, buckets)
        runs = np.concatenate([[0], np.flatnonzero((file[1:] != file[:-1]) | (at[1:] // CHUNK != at[:-1] // CHUNK)) + 1])
        stretch = np.searchsorted(runs, np.arange(len(at)), "right") - 1
        own = np.full(len(at), OWN)
        # features, then the rows themselves, by stretch, bucket and place
        place = np.concatenate([row, np.arange(len(at))])
        key = (stretch[place] * (buckets + 1) + np.concatenate([bucket, own]) + 1) * CHUNK + at[place] % CHUNK
        counted, first, count = np.unique(key, return_index=True, return_counts=True)
        lists_of, where = np.divmod(counted, CHUNK)
        cuts = np.concatenate([[0], np.flatnonzero(lists_of[1:] != lists_of[:-1]) + 1, [len(lists_of)]])
        name = lists_of[cuts[:-1]]
        mine = lists_of % (buckets + 1) == 0
        count[mine] = words[place[first[mine]]]
        begin = runs[name // (buckets + 1)]
        ids = part.column("id").take(pa.array(place[first[mine]]))
        held = np.concatenate([[0], np.cumsum(np.where(name % (buckets + 1) == 0, np.diff(cuts), 0))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(file[begin]), pa.array(at[begin] // CHUNK), pa.array(name % (buckets + 1) - 1, pa.int32()),
                _lists(cuts, where, pa.int16()), _lists(cuts, count, pa.int32()), pa.array(np.add.reduceat(count, cuts[:-1]), pa.int64()),
                pa.ListArray.from_arrays(pa.array(held, pa.int32()), ids),
            ],
            ["file", "chunk", "bucket", "at", "n", "total", "ids"],
        )

    def run(batches):
        for batch in batches:
            data, offsets = C.utf8(batch.column("text"))
            for a, b in C.row_chunks(offsets, 1 << 22):
                yield lists(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        C.release()

    return run


def postings(docs: DataFrame, id_col: str, text_col: str, grams: int, buckets: int) -> DataFrame:
    docs, file, row = C.located(docs)
    rows = docs.select(F.xxhash64(file).alias("file"), F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return C.stash(rows.mapInArrow(invert(grams, buckets), f"{LIST}, ids array<{kind}>"), "postings")


def total_weights(grams: int):
    """Contributions, sorted by stretch, to a row for each row of the corpus."""

    def stretch(file, chunk, weight, at, words, ids) -> pa.RecordBatch:
        n = sum(np.maximum(words - k, 0) for k in range(grams))
        columns = [np.full(len(at), file), chunk * CHUNK + at, ids, words, n, weight[at]]
        return pa.RecordBatch.from_arrays([c if c is ids else pa.array(c, pa.int64()) for c in columns], ["file", "row", "id", "n_words", "n_features", "weight"])

    def run(batches):
        key = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, chunk, bucket, gain = (batch.column(c).to_numpy() for c in ("file", "chunk", "bucket", "gain"))
            edges = np.concatenate([[0], np.flatnonzero((file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])) + 1, [len(file)]])
            for a, b in zip(edges[:-1], edges[1:]):
                at, n, ids = (batch.column(c).slice(a, b - a) for c in ("at", "n", "ids"))
                size = np.diff(at.offsets.to_numpy())
                at, n, ids = at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(np.int64), ids.flatten()
                own = np.repeat(bucket[a:b] == OWN, size)
                # whole numbers far below 2**53, so that their sum as doubles is exact
                weight = np.bincount(at[~own], (n * np.repeat(gain[a:b], size))[~own], CHUNK).astype(np.int64)
                found = (weight, at[own], n[own], ids)
                if key == (file[a], chunk[a]):
                    found = (held[0] + weight, *(np.concatenate([x, y]) for x, y in zip(held[1:3], found[1:3])), pa.concat_arrays([held[3], ids]))
                elif held:
                    yield stretch(*key, *held)
                key, held = (file[a], chunk[a]), found
        if held:
            yield stretch(*key, *held)

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least: int = LEAST,
    grams: int = GRAMS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank (null if not
    drawn).  ``share`` is the share drawn, as a fraction of whole numbers."""
    spark = docs.sparkSession
    lists = postings(docs, id_col, text_col, grams, buckets)
    wanted = postings(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", grams, buckets)
    none = F.lit(0).cast("long")
    both = (
        lists.select("bucket", F.col("total").alias("s"), none.alias("t"))
        .unionByName(wanted.select("bucket", none.alias("s"), F.col("total").alias("t")))
        .where(F.col("bucket") != OWN)
        .groupBy("bucket")
        .agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    )
    both = C.stash(both, "buckets")
    s, t = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1) * F.lit(s + buckets) / ((F.col("s") + 1) * F.lit(t + buckets))))
    gains = both.select("bucket", gain.alias("gain"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("file", "chunk"), F.lit(SALTS)).cast("int")
    dealt = lists.where(F.col("bucket") != OWN).withColumn("salt", salt)
    given = dealt.join(gains.hint("shuffle_hash"), ["bucket", "salt"])
    columns = ["file", "chunk", "bucket", "at", "n", "ids", "gain"]
    own = lists.where(F.col("bucket") == OWN).withColumn("gain", none)
    by_stretch = given.select(columns).unionByName(own.select(columns)).repartition(C.partitions(spark), "file", "chunk").sortWithinPartitions("file", "chunk")
    kind = lists.schema["ids"].dataType.elementType.simpleString()
    weights = by_stretch.mapInArrow(total_weights(grams), f"file long, row long, id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights.withColumns({"score": F.col("weight") + noise, "enough": F.col("n_words") >= least})
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("file"), F.col("row")]
    ranked = C.running(scored, order, {"place": F.lit(1)}, "scored")
    number = ranked.where("enough").count() * share[0] // share[1]
    rank = F.when(F.col("enough") & (F.col("place") <= number), F.col("place"))
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SQL = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
SQL = f"""
WITH crc AS MATERIALIZED (SELECT {C.CRC_TABLE_SQL} AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, {WORD_SQL} AS word FROM d) GROUP BY r, word),
b AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT {WORD_SQL} AS word FROM benchmark) GROUP BY word),
v AS MATERIALIZED (
  SELECT word, {C.crc32_sql("word", "tab")} % {BUCKETS} AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM b), crc
), s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM w JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM b JOIN v USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})
                 / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM w JOIN v USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, n_features >= {LEAST} AS enough, row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN enough AND place <= (SELECT count(*) FROM ranked WHERE enough) * {SHARE[0]} // {SHARE[1]} THEN place END AS rank
FROM ranked
"""
