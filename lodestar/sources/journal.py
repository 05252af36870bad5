"""Mutation logs: records of index and registry in their binary form, and a journal of batches with checkpoints."""

from __future__ import annotations

import struct
import uuid
import zlib
from datetime import datetime, timezone

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.store import Store, frames, parse_frames

#: Bytes of a log beyond which it is worth a checkpoint, by kind.
CHECKPOINT_BYTES = {"topology": 64 << 20, "registry": 16 << 20}

TOPOLOGY = "insert link delete entry commit".split()
REGISTRY = "registered linked earnings performance".split()
ACCESS = (None, "available", "restricted", "unknown")

TOPOLOGY_ROW = "path string, seq bigint, kind string, local_idx int, partition_id string, document_id string, vector_index int, level int, neighbours array<array<int>>"
STAT = "struct<document_id:string,retrievals:int,sentiment:double,last_retrieved:timestamp,counts:map<string,int>,sentiments:map<string,struct<retrievals:int,sentiment:double,last_retrieved:timestamp>>>"
REGISTRY_ROW = f"path string, seq bigint, kind string, document_id string, owner_id string, `group` struct<id:string,label:string,owner_id:string,access:string,description:string,tags:array<string>>, earnings array<struct<document_id:string,credits:double>>, stats array<{STAT}>"


class _Writer:
    def __init__(self):
        self.parts: list[bytes] = []

    def put(self, form: str, *values) -> _Writer:
        self.parts.append(struct.pack("<" + form, *values))
        return self

    def text(self, t: str | None) -> _Writer:
        raw = (t or "").encode()[:65535]
        self.parts += [struct.pack("<H", len(raw)), raw]
        return self

    def when(self, t: datetime | None) -> _Writer:
        return self.put("B", 0) if t is None else self.put("Bd", 1, t.replace(tzinfo=t.tzinfo or timezone.utc).timestamp())

    def raw(self) -> bytes:
        return b"".join(self.parts)


class _Reader:
    """Raises struct.error where a payload ends too early."""

    def __init__(self, raw: bytes):
        self.b, self.at = raw, 0

    def get(self, form: str):
        value = struct.unpack_from("<" + form, self.b, self.at)
        self.at += struct.calcsize("<" + form)
        return value[0] if len(value) == 1 else value

    def text(self) -> str:
        n = self.get("H")
        raw = self.get(f"{n}s") if n else b""
        return raw.decode("utf-8", "replace")

    def when(self) -> datetime | None:
        return datetime.fromtimestamp(self.get("d"), timezone.utc).replace(tzinfo=None) if self.get("B") == 1 else None


def encode_topology(kind: str, local_idx: int = -1, partition_id: str = "", document_id: str = "", vector_index: int = -1, level: int = -1, neighbours=()) -> tuple[int, bytes]:
    """(code, payload). neighbours are lists by layer; of kind 'link' the only one, of the layer in ``level``."""
    w = _Writer()
    if kind == "insert":
        w.text(partition_id).text(document_id).put("iBB", vector_index, level, len(neighbours))
        for own in neighbours:
            w.put(f"H{len(own)}i", len(own), *own)
    elif kind == "link":
        own = neighbours[0] if len(neighbours) else []
        w.put(f"iBH{len(own)}i", local_idx, level, len(own), *own)
    elif kind == "delete":
        w.put("i", local_idx)
    elif kind == "entry":
        w.put("ii", local_idx, level)
    return TOPOLOGY.index(kind) + 1, w.raw()


def decode_topology(code: int, payload: bytes) -> dict:
    r, kind = _Reader(payload), TOPOLOGY[code - 1]
    many = lambda n: [r.get("i") for _ in range(n)]
    if kind == "insert":
        row = {"partition_id": r.text(), "document_id": r.text(), "vector_index": r.get("i"), "level": r.get("B")}
        return {"kind": kind, **row, "neighbours": [many(r.get("H")) for _ in range(r.get("B"))]}
    if kind == "link":
        return {"kind": kind, "local_idx": r.get("i"), "level": r.get("B"), "neighbours": [many(r.get("H"))]}
    if kind == "delete":
        return {"kind": kind, "local_idx": r.get("i")}
    if kind == "entry":
        return {"kind": kind, "local_idx": r.get("i"), "level": r.get("i")}
    return {"kind": kind}


def _group(w: _Writer, g: dict | None) -> None:
    if g is None:
        w.put("B", 0)
        return
    w.put("B", 1).text(g["id"]).text(g.get("label")).text(g.get("owner_id")).put("B", ACCESS.index(g.get("access")))
    if g.get("description") is None:
        w.put("B", 0)
    else:
        w.put("B", 1).text(g["description"])
    w.put("H", len(g.get("tags") or ()))
    for t in g.get("tags") or ():
        w.text(t)


def encode_registry(kind: str, document_id: str = "", owner_id: str = "", group: dict | None = None, earnings=(), stats=()) -> tuple[int, bytes]:
    w = _Writer()
    if kind in ("registered", "linked"):
        _group(w.text(document_id).text(owner_id), group)
    elif kind == "earnings":
        w.put("H", len(earnings))
        for d, credits in earnings:
            w.text(d).put("d", credits)
    else:
        w.put("H", len(stats))
        for s in stats:
            w.text(s["document_id"]).put("id", s["retrievals"], s["sentiment"]).when(s.get("last_retrieved"))
            w.put("H", len(s.get("counts") or {}))
            for p, n in (s.get("counts") or {}).items():
                w.text(p).put("i", n)
            w.put("H", len(s.get("sentiments") or {}))
            for p, x in (s.get("sentiments") or {}).items():
                w.text(p).put("id", x["retrievals"], x["sentiment"]).when(x.get("last_retrieved"))
    return REGISTRY.index(kind) + 1, w.raw()


def decode_registry(code: int, payload: bytes) -> dict:
    r, kind = _Reader(payload), REGISTRY[code - 1]
    if kind in ("registered", "linked"):
        out = {"kind": kind, "document_id": r.text(), "owner_id": r.text(), "group": None}
        if r.get("B") == 1:
            g = {"id": r.text(), "label": r.text(), "owner_id": r.text()}
            code = r.get("B")
            g["access"] = ACCESS[code] if code < 4 else None
            g["description"] = r.text() if r.get("B") == 1 else None
            g["tags"] = [r.text() for _ in range(r.get("H"))]
            out["group"] = g
        return out
    if kind == "earnings":
        return {"kind": kind, "earnings": [{"document_id": r.text(), "credits": r.get("d")} for _ in range(r.get("H"))]}
    stats = []
    for _ in range(r.get("H")):
        s = {"document_id": r.text(), "retrievals": r.get("i"), "sentiment": r.get("d"), "last_retrieved": r.when()}
        s["counts"] = {r.text(): r.get("i") for _ in range(r.get("H"))}
        s["sentiments"] = {r.text(): {"retrievals": r.get("i"), "sentiment": r.get("d"), "last_retrieved": r.when()} for _ in range(r.get("H"))}
        stats.append(s)
    return {"kind": kind, "stats": stats}


def committed_topology(rows: list[dict]) -> list[dict]:
    """Records up to the last commit; all of them if there is none, as in logs that are older than commits."""
    at = [i for i, r in enumerate(rows) if r["kind"] == "commit"]
    return [r for r in (rows[: at[-1]] if at else rows) if r["kind"] != "commit"]


def read_records(spark: SparkSession, path: str, of: str = "topology") -> DataFrame:
    """Records of binary logs up to the first that is cut off, corrupt or unknown; of topology logs only committed ones.

    A log is one file of a bounded size (CHECKPOINT_BYTES), and read by one task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    row = TOPOLOGY_ROW if of == "topology" else REGISTRY_ROW
    decode = decode_topology if of == "topology" else decode_registry
    schema = spark.createDataFrame([], row).schema
    names = schema.names

    def rows(frames_):
        for f in frames_:
            for p, c in zip(f["path"], f["content"], strict=True):
                got: list[dict] = []
                for code, payload in parse_frames(bytes(c)):
                    try:
                        got.append({"path": p, "seq": len(got), **decode(code, payload)})
                    except (struct.error, IndexError, UnicodeDecodeError):
                        break
                got = committed_topology(got) if of == "topology" else got
                frame = pd.DataFrame([[g.get(n) for n in names] for g in got], columns=names)
                for n in ("local_idx", "vector_index", "level"):
                    if n in frame:
                        frame[n] = frame[n].astype("Int32")
                yield frame

    return files.mapInPandas(rows, row)


def write_records(path: str, records: list[tuple[int, bytes]], append: bool = True) -> int:
    """Append framed records to a log file on any file system that Arrow knows; the bytes it has then. Where it can't append it is written anew."""
    system, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    old = b""
    if append and system.get_file_info(at).type != pyarrow.fs.FileType.NotFound:
        with system.open_input_file(at) as f:
            old = f.read()
    raw = old + frames(records)
    with system.open_output_stream(at) as f:
        f.write(raw)
    return len(raw)


class Journal:
    """A log as batches of rows with ``seq``, and checkpoints of the state they lead to.

    A batch is written whole or not at all, so it is the unit of commit. A
    checkpoint is a version of the state's tables that also says up to which seq
    they hold; batches behind it are the tail. Truncating drops batches that a
    checkpoint covers; if it is cut short, they are left and skipped by their seq.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, limit: int = CHECKPOINT_BYTES["topology"]):
        self.store, self.name, self.limit = Store(spark, path), name, limit
        self.folder = f"{path.rstrip('/')}/{name}-log"

    def _batches(self) -> list[tuple[int, int, str, int]]:
        """(first seq, last seq, folder, bytes) of whole batches."""
        fs, path = self.store._fs(self.folder)
        out = []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            at = s.getPath().toString()
            part = s.getPath().getName().split("-")
            if len(part) == 3 and part[0].isdigit() and fs.exists(self.store._fs(at + "/_SUCCESS")[1]):
                out.append((int(part[0]), int(part[1]), at, fs.getContentSummary(s.getPath()).getLength()))
        return sorted(out)

    def append(self, records: DataFrame) -> None:
        """A batch of rows; their seq must be behind those of all batches before."""
        low, high = records.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return
        last = max((b[1] for b in self._batches()), default=self.checkpoint_seq())
        if low <= last:
            raise ValueError(f"seq {low} isn't behind {last}")
        records.write.parquet(f"{self.folder}/{low:020d}-{high:020d}-{uuid.uuid4().hex}")

    def checkpoint_seq(self) -> int:
        got = self.store.restore_together(self.name, ("upto",))
        return -1 if got is None else got["upto"].first()["seq"]

    def tail(self) -> DataFrame | None:
        """Records behind the checkpoint, each seq once."""
        upto = self.checkpoint_seq()
        paths = [at for _, high, at, _ in self._batches() if high > upto]
        if not paths:
            return None
        return self.store.spark.read.parquet(*paths).where(F.col("seq") > upto).dropDuplicates(["seq"])

    def size(self) -> int:
        return sum(b[3] for b in self._batches())

    def due(self) -> bool:
        return self.size() > self.limit

    def checkpoint(self, tables: dict[str, DataFrame], seq: int | None = None) -> None:
        """Keep the state's tables as of seq (all records so far), then drop the batches that they cover."""
        last = max((b[1] for b in self._batches()), default=self.checkpoint_seq()) if seq is None else seq
        self.store.save_together(self.name, tables | {"upto": self.store.spark.createDataFrame([(last,)], "seq bigint")})
        self.truncate()

    def truncate(self) -> None:
        upto = self.checkpoint_seq()
        for _, high, at, _ in self._batches():
            if high <= upto:
                fs, path = self.store._fs(at)
                fs.delete(path, True)

    def state(self, tables: tuple[str, ...]) -> dict[str, DataFrame] | None:
        return self.store.restore_together(self.name, tables)


def checksum(payload: bytes) -> int:
    """Adler-32."""
    return zlib.adler32(payload)
