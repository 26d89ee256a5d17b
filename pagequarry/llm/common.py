"""Small things that several corpus operators share."""

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import checkpointed, shared_folder

#: Bytes of text that the numpy helpers look at in one go; bounds a worker's temporary arrays.
SLICE_BYTES = 1 << 18


#: Rows of an Arrow batch of whole texts; the default of 10000 holds tens of megabytes on both sides of each worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for workers that read whole texts, unless the session has chosen a size itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *hashes: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage, and later readers take only the columns they need.

    hashes: columns of which hardly any two values are equal; no dictionary of them is tried.
    """
    path = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is common if it holds more than one row in so many: fewer keys than this can be.
COMMON = 1000


def meet(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `rows` (`total` of them) with `keys`, which has one row for each key and counts its rows in `n`.

    The common keys, fewer than COMMON whatever the table, are sent to where the rows lie, so that no task gathers the rows of a
    common key; the others shuffle. Both tables are read twice and should be written ones.
    """
    common = F.broadcast(keys.where(F.col("n") > total / COMMON))
    others = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(keys.where(F.col("n") <= total / COMMON), key)
    return rows.join(common, key).unionByName(others)


#: Bits of a sketch; it is sent to every executor and takes an eighth of this in bytes, whatever the table.
SKETCH_BITS = 1 << 26


def sketch(df: DataFrame, key: Column) -> DataFrame:
    """(bucket, bitmap): the bits of the keys that occur, 4 kB a row. Missing bits prove that a key is absent."""
    at = F.pmod(key, F.lit(SKETCH_BITS))
    bits = df.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).repartition("bucket")
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def with_sketch(df: DataFrame, key: Column, of: DataFrame, into: str) -> DataFrame:
    """df with a column `into` that is false where the sketch proves that the key is absent."""
    at = F.pmod(key, F.lit(SKETCH_BITS))
    marked = df.withColumn("bucket", F.bitmap_bucket_number(at)).withColumn("bit", F.bitmap_bit_position(at)).join(F.broadcast(of), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1
    return marked.withColumn(into, F.coalesce(held, F.lit(False))).drop("bucket", "bit", "bitmap")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(parts)), F.lit(0))


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Yield (first row, bytes as uint8, offsets) for runs of whole texts of about `size` bytes; null texts are empty."""
    raw = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    raw = raw.fill_null(b"")
    n = len(raw)
    if not n:
        return
    offsets = np.frombuffer(raw.buffers()[1], np.int64, count=n + 1 + raw.offset)[raw.offset :]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i along axis 0; 0 for empty ranges."""
    out = np.zeros((len(offsets) - 1,) + values.shape[1:], np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


def release() -> None:
    """Give a worker's freed memory back: workers are reused, and what they keep adds up over the stages of a pipeline."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, SLICE_BYTES * 2), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each range: a polynomial by prefix sums, mixed."""
    up, down = powers(BASE, len(values)), powers(INVERSE, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the blank-separated words of concatenated texts, and how many words lie before each text."""
    inside = ~BLANKS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    edge[1:] = True
    edge[1:-1] = ~inside[1:]
    edge[offsets] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def arrow(kind: str, once: bool = False):
    """Like arrow_udf(kind), but for functions of modules that may be imported before there is a session.

    once: a filter on the result stays above it. Otherwise Spark moves the filter below the column and runs the function for both,
    which takes twice the time and a second Python worker in each task.
    """

    def of(function):
        def call(*columns):
            udf = F.arrow_udf(function, kind)
            return (udf.asNondeterministic() if once else udf)(*columns)

        return call

    return of
