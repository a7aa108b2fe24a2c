"""What several corpus operators share: tables, the shared folder, words as numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may do without: a temporary one is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-tideline-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    leaves a copy that outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, columns) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` as it is if it was read from Parquet files, else written and read again."""
    try:
        docs.select("_metadata.row_index").schema
        return docs
    except AnalysisException:
        return stash(docs, "docs")


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns that tell its rows apart, and their names: the file a
    row was read from and its number there.  They are the same each time ``docs`` is read,
    also by a task that runs again.  What was not read from Parquet files is written first;
    write what a join or explode has made out of files yourself."""
    file, row = unused("_file", docs.columns), unused("_row", docs.columns)
    try:
        found = from_files(docs).select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        found.schema  # refused if there is no such metadata
        return found, file, row
    except AnalysisException:
        pass
    # a column of ``docs`` itself is called _metadata: its files are read in one order
    return docs.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row)), file, row


def release() -> None:
    """Hand memory that numpy and Arrow no longer use back to the system at a task's end:
    workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a whole text column; sizes blocks, never decides about rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]


def running(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """``df`` with the sums of ``values`` over all rows up to this one: ranges of the order
    are summed each for itself, then one row a range."""
    values = {k: v.cast("long") for k, v in values.items()}
    parts = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    parts = stash(parts, name)  # both uses see the same ranges
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    starts = sums.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({k: F.sum(v).over(within) for k, v in values.items()})
    out = out.join(F.broadcast(starts), "_range")  # one row a range
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).drop("_range", *[f"_{k}" for k in values])


# ---------------------------------------------------------------- text as bytes

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[list(SEPARATORS)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column (null counts as empty) and row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) row ranges of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word.
    ``separates`` says of each byte whether it stands between words."""
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[:-1] = ~separates[data]
    inside[-1] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins[:-1])
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


#: Odd multipliers of the polynomial hashes (any odd 64-bit number would do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of values[start:end] for every range, from one
    pass of prefix sums modulo 2**64."""
    p, inverse = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * inverse[starts]


PRIME = np.uint64((1 << 61) - 1)
_LOW32, _LOW29, _B32, _B29, _B61 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1), np.uint64(32), np.uint64(29), np.uint64(61)


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo the prime 2**61 - 1, both below it, by halves of 32 bits."""
    b = np.uint64(b) if isinstance(b, int) else b
    ah, al, bh, bl = a >> _B32, a & _LOW32, b >> _B32, b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    x = (ah * bh << np.uint64(3)) + (middle >> _B29) + ((middle & _LOW29) << _B32) + (low & PRIME) + (low >> _B61)
    x = (x & PRIME) + (x >> _B61)
    return np.where(x >= PRIME, x - PRIME, x)


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**61 - 1 of every ``width`` values in a row.
    The hashes of 1, 2, 4 ... values are joined as the bits of ``width`` say."""
    step = 1 << 13
    if len(values) > step + width:  # stretches that stay in the processor's cache
        return np.concatenate([window_hashes(values[a : a + step + width - 1], width, base) for a in range(0, len(values) - width + 1, step)])
    prime = int(PRIME)
    base %= prime
    part = values % PRIME
    size, out, done = 1, None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:  # ``done`` values, then ``size`` more
                n = max(0, len(values) - done - size + 1)
                out = times(out[:n], pow(base, size, prime)) + part[done : done + n]
                out = np.where(out >= PRIME, out - PRIME, out)
            done += size
        if 2 * size > width:
            return out[: max(0, len(values) - width + 1)]
        n = max(0, len(part) - size)
        part = times(part[:n], pow(base, size, prime)) + part[size : size + n]
        part = np.where(part >= PRIME, part - PRIME, part)
        size *= 2


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins (and the end)."""
    to = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    mark = np.zeros(len(data) + 1, np.int64)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)
    out[inside] = data[np.cumsum(mark[:-1]) > 0]
    return out.tobytes(), to


def same_words(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> bool:
    """Are all the words a[start:start+size] and b[start:start+size] the same bytes?"""
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return bool((a[np.repeat(a_starts, sizes) + step] == b[np.repeat(b_starts, sizes) + step]).all())


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix(hash_ranges(data, starts, ends, base) + (ends - starts).astype(np.uint64) * np.uint64(base))


# ---------------------------------------------------------------- CRC-32

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
#: Ranges over so many bytes are left to zlib, one by one.
LONG_RANGE = 64


def crc_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of data[start:end] for every range, going on from the values ``before``."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    size = ends - starts
    for k in np.flatnonzero(size > LONG_RANGE):
        crc[k] = zlib.crc32(data[starts[k] : ends[k]], int(crc[k]))
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], LONG_RANGE, "right")]
    ordered, at = size[order], starts[order]
    state = ~crc[order]
    for k in range(int(ordered[-1]) if len(ordered) else 0):  # the k-th byte of all that have one
        a = int(np.searchsorted(ordered, k, "right"))
        x = state[a:]
        state[a:] = CRC[(x ^ data[at[a:] + k]) & 0xFF] ^ (x >> 8)
    crc[order] = ~state
    return crc


#: DuckDB SQL of the table of all bytes' remainders, and of a text's CRC-32 with it.
CRC_TABLE_SQL = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"


def crc32_sql(text: str, table: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
