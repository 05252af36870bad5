"""Versioned tables, vector files, text files and binary logs."""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENCODINGS = ("utf-8", "utf-16", "latin-1", "cp1252")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session, as in tests, gets one of its own, and a cluster an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def spooled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: made once however often it is used, whole if an executor is lost, and gone when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Tables under a folder, each a series of versions.

    A version is a small file that names the segments (Parquet folders) each of
    its tables consists of. It appears by a rename when all of them are written,
    so a reader sees whole versions only, and one that reads an older version
    isn't disturbed. Appending writes a segment and a version with one more name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, p: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(f"{self.path}/{name}/versions")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _segments(self, name: str, version: int) -> dict[str, list[str]] | None:
        fs, path = self._fs(f"{self.path}/{name}/versions/v{version}")
        try:
            stream = fs.open(path)
            raw = bytes(stream.readAllBytes())
            stream.close()
            return json.loads(raw)
        except (Py4JJavaError, ValueError):
            return None

    def _publish(self, name: str, tables: dict[str, list[str]]) -> int:
        have = self.versions(name)
        v = have[-1] + 1 if have else 0
        folder = f"{self.path}/{name}/versions"
        fs, at = self._fs(f"{folder}/v{v}")
        _, temporary = self._fs(f"{folder}/_{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        if fs.exists(at) or not fs.rename(temporary, at):
            fs.delete(temporary, False)
            raise RuntimeError(f"{name}: version {v} was written by somebody else")
        return v

    def _write(self, name: str, df: DataFrame) -> str:
        segment = f"segments/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{segment}")
        return segment

    def save_together(self, name: str, tables: dict[str, DataFrame]) -> int:
        """A version of several tables, which are replaced at once or not at all."""
        return self._publish(name, {t: [self._write(name, df)] for t, df in tables.items()})

    def extend(self, name: str, more: dict[str, DataFrame], anew: dict[str, DataFrame]) -> int:
        """A version with rows added to some tables, and others replaced."""
        have = self.versions(name)
        old = (self._segments(name, have[-1]) or {}) if have else {}
        new = {t: [*old.get(t, []), self._write(name, df)] for t, df in more.items()} | {t: [self._write(name, df)] for t, df in anew.items()}
        return self._publish(name, old | new)

    def segment_count(self, name: str, table: str = "") -> int:
        have = self.versions(name)
        return len((self._segments(name, have[-1]) or {}).get(table, [])) if have else 0

    def restore_together(self, name: str, tables: tuple[str, ...], version: int | None = None) -> dict[str, DataFrame] | None:
        """None where there is nothing, or nothing that can be read."""
        have = self.versions(name)
        v = version if version is not None else (have[-1] if have else None)
        segments = None if v is None else self._segments(name, v)
        if segments is None or any(t not in segments for t in tables):
            return None
        try:
            return {t: self.spark.read.parquet(*(f"{self.path}/{name}/{x}" for x in segments[t])) for t in tables}
        except (AnalysisException, Py4JJavaError):
            return None

    def save(self, name: str, df: DataFrame) -> int:
        return self.save_together(name, {"": df})

    def append(self, name: str, df: DataFrame) -> int:
        """A version with these rows besides those of the newest."""
        return self.extend(name, {"": df}, {})

    def restore(self, name: str, version: int | None = None) -> DataFrame | None:
        got = self.restore_together(name, ("",), version)
        return None if got is None else got[""]

    def keep(self, name: str, newest: int = 1) -> None:
        """Drop all versions but the newest few, and segments that none of those names."""
        have = self.versions(name)
        for v in have[:-newest]:
            fs, path = self._fs(f"{self.path}/{name}/versions/v{v}")
            fs.delete(path, False)
        named = {x for v in have[-newest:] for segments in (self._segments(name, v) or {}).values() for x in segments}
        fs, path = self._fs(f"{self.path}/{name}/segments")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if f"segments/{s.getPath().getName()}" not in named:
                fs.delete(s.getPath(), True)

    def purge(self, name: str) -> None:
        fs, path = self._fs(f"{self.path}/{name}")
        fs.delete(path, True)


#: Bytes of a vector file that a task reads at once.
RANGE_BYTES = 64 << 20


def _file_ranges(spark: SparkSession, path: str, unit: int) -> DataFrame:
    """(path, first, rows): pieces of files of equal records, of any size; a record cut off at the end isn't one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    step = max(1, RANGE_BYTES // unit)
    out = []
    for s in fs.globStatus(p) or []:
        files = [s] if s.isFile() else [x for x in fs.listStatus(s.getPath()) if x.isFile()]
        for f in files:
            n = f.getLen() // unit
            out += [(f.getPath().toString(), a, min(step, n - a)) for a in range(0, n, step)]
    df = spark.createDataFrame(out, "path string, first bigint, rows bigint")
    return df.repartition(max(1, len(out)))


def read_vector_file(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(path, slot, embedding) of files that are dense rows of little-endian float32, read in ranges by as many tasks."""

    def rows(batches):
        for b in batches:
            for p, first, n in zip(*(b.column(c).to_pylist() for c in ("path", "first", "rows")), strict=True):
                system, at = pyarrow.fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with system.open_input_file(at) as f:
                    x = np.frombuffer(f.read_at(n * 4 * dim, first * 4 * dim), "<f4")
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x))
                for a in range(0, n, 10_000):
                    k = min(10_000, n - a)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * k), pa.array(np.arange(first + a, first + a + k)), values.slice(a, k)], ["path", "slot", "embedding"])

    return _file_ranges(spark, path, 4 * dim).mapInArrow(rows, "path string, slot bigint, embedding array<float>")


def reorder(vectors: DataFrame, order: DataFrame) -> DataFrame:
    """Vectors in a new order: order is (old_slot, slot)."""
    return vectors.withColumnRenamed("slot", "old_slot").join(order, "old_slot").drop("old_slot")


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """Bytes to text, by the first encoding that fits."""

    def one(c):
        if c is None:
            return None
        for e in ENCODINGS:
            try:
                return bytes(c).decode(e)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): text files, and the readable part of HTML ones."""
    from lodestar.functions.text import html_text

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", decode("content").alias("text"))
    return files.withColumn("text", F.when(F.lower("path").rlike(r"\.html?$"), html_text(F.col("text"))).otherwise(F.col("text")))


_FRAME = struct.Struct("<BI")


def frames(records: list[tuple[int, bytes]]) -> bytes:
    """Log records as type, length, payload and Adler-32 of the payload."""
    return b"".join(_FRAME.pack(t, len(p)) + p + struct.pack("<I", zlib.adler32(p)) for t, p in records)


def parse_frames(raw: bytes) -> list[tuple[int, bytes]]:
    """Records up to the first that is cut off or whose checksum fails."""
    out, at = [], 0
    while at + _FRAME.size <= len(raw):
        t, n = _FRAME.unpack_from(raw, at)
        end = at + _FRAME.size + n
        if end + 4 > len(raw) or zlib.adler32(raw[at + _FRAME.size : end]) != struct.unpack_from("<I", raw, end)[0]:
            break
        out.append((t, raw[at + _FRAME.size : end]))
        at = end + 4
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, kind, payload) of binary logs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for f in batches:
            for p, c in zip(f["path"], f["content"], strict=True):
                got = parse_frames(bytes(c))
                yield pd.DataFrame({"path": [p] * len(got), "seq": range(len(got)), "kind": [t for t, _ in got], "payload": [x for _, x in got]})

    return files.mapInPandas(rows, "path string, seq bigint, kind int, payload binary")
