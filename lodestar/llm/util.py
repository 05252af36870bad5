"""Session helpers: the shared folder, spooled tables, packed exchanges."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many bytes, and joined by shuffle above.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session, as in tests, gets one of its own, and a cluster an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a lost executor loses nothing. The table goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    jvm.Path(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm.Path(path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df hinted for broadcast if its counted size is small, else for a hash join after a shuffle. df should be a spooled table."""
    if df.count() * row_bytes <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("shuffle_hash")


#: Bits a key has in a filter, and the most a filter may have in all: 2**28 bits are 32 MB, as BROADCAST_BYTES.
FILTER_BITS = 16
MOST_BITS = 1 << 28
_BUCKET_BITS = 32768


def marked(df: DataFrame, keys: DataFrame, names: list[str], flag: str, count: int | None = None) -> DataFrame:
    """df with the boolean ``flag``: false only where no row of keys has its values of ``names`` (which keys must have too).

    A filter of one hashed bit a key, made and looked up inside the JVM and
    broadcast in buckets of 4 KB. It never has more than MOST_BITS, so a longer
    list of keys makes more rows true that needn't be, and nothing larger.
    """
    n = keys.count() if count is None else count
    size = _BUCKET_BITS
    while size < min(MOST_BITS, FILTER_BITS * n):
        size *= 2
    place = F.pmod(F.xxhash64(F.lit("filter"), *(F.col(c) for c in names)), F.lit(size))
    bits = keys.select(place.alias("p")).select(F.floor(F.col("p") / _BUCKET_BITS).alias("__bucket"), (F.col("p") % _BUCKET_BITS).alias("bit"))
    buckets = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    out = df.withColumn("__place", place).withColumn("__bucket", F.floor(F.col("__place") / _BUCKET_BITS))
    out = out.join(F.broadcast(buckets), "__bucket", "left")
    bit = (F.col("__place") % _BUCKET_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    on = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), bit % 8 + 1)) != 0
    return out.withColumn(flag, F.coalesce(on, F.lit(False))).select(*df.columns, flag)


def without(df: DataFrame, drop: DataFrame, names: list[str]) -> DataFrame:
    """The rows of df for which drop, a spooled table, has no row with equal, non-null values of ``names``.

    drop is broadcast if it is small. Otherwise only rows that a filter of drop's
    keys lets through are shuffled to be joined, and the others, most of them,
    stay where they are, so that a corpus doesn't move because some of it goes.
    """
    n = drop.count()
    if not n:
        return df
    if n * 16 * (1 + len(names)) <= BROADCAST_BYTES:
        return df.join(F.broadcast(drop.select(*names)), names, "left_anti").select(*df.columns)
    both = marked(df, drop, names, "__maybe", n)
    some = both.where("__maybe").drop("__maybe").join(drop.select(*names).hint("shuffle_hash"), names, "left_anti")
    return both.where("NOT __maybe").drop("__maybe").unionByName(some.select(*df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchange(df: DataFrame, column: str = "part", n: int | None = None) -> DataFrame:
    """Send each row to the partition numbered in ``column``."""
    return df.repartitionById(n or parts(df.sparkSession), F.col(column))


def blobs(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of values[bounds[i]:bounds[i + 1]], one item each."""
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by a sort: np.unique hashes integers, which takes far longer over millions of different ones."""
    values = np.sort(values)
    keep = np.ones(len(values), np.bool_)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the worker, which Spark keeps for later tasks, gives its free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition as one table; None if it is empty."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``key``, from batches sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), n]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
