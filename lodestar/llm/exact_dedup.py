"""Exact dedup by a log-structured merge index over text digests.

1. every task puts the 128-bit digests of its rows into a memtable of a fixed
   number of bytes; a full one is flushed as a sorted run with a filter, and runs
   of one level are compacted into one of the next, which adds up equal digests
   and keeps the smallest identifier;
2. the runs go to partitions by digest, each a further index; a digest that is in
   a run already, which most filters deny without a search, is a hit;
3. only the texts of hits are read again and sent to be compared byte by byte,
   the smallest identifier's first. All others have no copy, so that the corpus
   itself isn't shuffled.

An entry is 32 bytes whatever the text; no step holds a partition's texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import util

#: Bytes of entries a memtable holds before it is flushed as a sorted run.
MEMTABLE_BYTES = 1 << 16
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Bytes of hits' texts whose copies are joined in a task before they are sent.
LOCAL_BYTES = 16 << 20

#: A digest of two words, how many rows have it, and their smallest identifier (NO_ID if none has any).
ENTRY = np.dtype([("a", np.int64), ("b", np.int64), ("n", np.int64), ("least", np.int64)])
NO_ID = np.iinfo(np.int64).max


class Filter:
    """A Bloom filter of digests: 16 bits a key, 4 probes taken from the digest itself."""

    def __init__(self, run: np.ndarray):
        self.mask = np.uint64((1 << max(10, int(16 * len(run) - 1).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for p in self._probes(run["a"], run["b"]):
            np.bitwise_or.at(self.bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def _probes(self, a: np.ndarray, b: np.ndarray):
        a, b = a.astype(np.uint64), b.astype(np.uint64) | np.uint64(1)
        return ((a + np.uint64(i) * b) & self.mask for i in range(4))

    def maybe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), np.bool_)
        for p in self._probes(a, b):
            ok &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return ok


def compacted(entries: np.ndarray) -> np.ndarray:
    """Entries in order of digest, one each: rows added up, the smallest identifier kept."""
    e = entries[np.lexsort((entries["b"], entries["a"]))]
    if not len(e):
        return e
    at = np.flatnonzero(np.concatenate([[True], (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]))
    out = e[at]
    out["n"] = np.add.reduceat(e["n"], at)
    out["least"] = np.minimum.reduceat(e["least"], at)
    return out


class Index:
    """A log-structured merge index of digests.

    ``add`` takes entries: they wait in a memtable, which is flushed when it has
    ``memtable`` bytes as a sorted run of level 0. FANOUT runs of a level are
    compacted into one of the next. ``flushes`` and ``compactions`` count both.
    """

    def __init__(self, memtable: int = MEMTABLE_BYTES, fanout: int = FANOUT):
        self.limit, self.fanout = max(1, memtable // ENTRY.itemsize), fanout
        self.mem: list[np.ndarray] = []
        self.held = 0
        self.levels: list[list[tuple[np.ndarray, Filter]]] = []
        self.flushes = self.compactions = 0

    def add(self, entries: np.ndarray) -> None:
        while len(entries):
            part, entries = entries[: self.limit - self.held], entries[self.limit - self.held :]
            self.mem.append(part)
            self.held += len(part)
            if self.held >= self.limit:
                self.flush()

    def flush(self) -> None:
        if self.held:
            run = compacted(np.concatenate(self.mem))
            self.mem, self.held = [], 0
            self.flushes += 1
            self.push(run)

    def push(self, run: np.ndarray, level: int = 0) -> None:
        """Take in a sorted run, such as another index has flushed."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, Filter(run)))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self.compactions += 1
            self.push(compacted(np.concatenate([r for r, _ in runs])), level + 1)

    def insert(self, run: np.ndarray) -> np.ndarray:
        """Take in a sorted run; of its entries those that are hits, in it or with what was there before."""
        hit = (run["n"] > 1) | (self.rows(run["a"], run["b"]) > 0)
        self.push(run)
        return run[hit]

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many rows have each digest. Runs whose filter denies it aren't searched."""
        out = np.zeros(len(a), np.int64)
        probe = np.zeros(len(a), ENTRY)
        probe["a"], probe["b"] = a, b
        for level in self.levels:
            for run, kept in level:
                at = np.flatnonzero(kept.maybe(a, b))
                if len(at):
                    place = _place(run, probe[at])
                    same = (run["a"][place] == a[at]) & (run["b"][place] == b[at])
                    out[at[same]] += run["n"][place[same]]
        if self.held:
            mem = compacted(np.concatenate(self.mem))
            place = _place(mem, probe)
            same = (mem["a"][place] == a) & (mem["b"][place] == b)
            out[same] += mem["n"][place[same]]
        return out

    def whole(self) -> np.ndarray:
        """Everything compacted into one run."""
        self.flush()
        runs = [r for level in self.levels for r, _ in level]
        if len(runs) > 1:
            self.compactions += 1
            run = compacted(np.concatenate(runs))
            self.levels = [[(run, Filter(run))]]
            return run
        return runs[0] if runs else np.empty(0, ENTRY)


def _place(run: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Where each probed digest would be in a sorted run, within it; digests agree in the first word by chance only."""
    at = np.minimum(np.searchsorted(run["a"], probe["a"]), len(run) - 1)
    while True:
        on = (run["a"][at] == probe["a"]) & (run["b"][at] < probe["b"]) & (at + 1 < len(run))
        on &= run["a"][np.minimum(at + 1, len(run) - 1)] == probe["a"]
        if not on.any():
            return at
        at = at + on


_RUN = "part int, entries binary"


def _flushed(batches, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's index, and of its last run each partition's part."""
    index = Index()
    for b in batches:
        e = np.zeros(b.num_rows, ENTRY)
        e["a"], e["b"] = b.column("a").to_numpy(), b.column("b").to_numpy()
        e["least"], e["n"] = b.column("id").fill_null(NO_ID).to_numpy(), 1
        index.add(e)
    run = index.whole()
    part = ((run["a"].astype(np.uint64) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    run, cut = run[order], np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cut)).tolist()
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([run[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())], ["part", "entries"])


def _hits(batches) -> Iterator[pa.RecordBatch]:
    """Digests of more than one row, of the runs that came to a partition, with the smallest identifier."""
    index, found = Index(), [np.empty(0, ENTRY)]
    for b in batches:
        for run in b.column("entries"):
            found.append(index.insert(np.frombuffer(run.as_buffer(), ENTRY)))
    hit, run = compacted(np.concatenate(found)), index.whole()
    run = run[_place(run, hit)] if len(hit) else run[:0]
    yield pa.RecordBatch.from_arrays([pa.array(run["a"]), pa.array(run["b"]), pa.array(run["least"], mask=run["least"] == NO_ID)], ["a", "b", "least"])


def hits(rows: DataFrame) -> DataFrame:
    """(a, b, least): the digests that occur more than once in rows (id, a, b), and the smallest identifier of each."""
    n = util.parts(rows.sparkSession)
    runs = util.exchange(rows.mapInArrow(lambda b: _flushed(b, n), _RUN), n=n)
    return runs.mapInArrow(_hits, "a bigint, b bigint, least bigint")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with its digest in (__a, __b): two chained 64-bit hashes of the text, of null like of any other value."""
    t = F.col(text_col).cast("string")
    return docs.withColumn("__a", F.xxhash64(F.lit(1), t)).withColumn("__b", F.xxhash64(F.lit("exact"), t))


_SENT = "a bigint, b bigint, least bigint, ids array<bigint>, text binary"


def _local(batches):
    """Map side: copies inside a task meet here, so a hot text is sent once a task (or each LOCAL_BYTES of it)."""
    held: dict[bytes | None, tuple[int, int, list]] = {}
    size = 0
    for b in batches:
        rows = zip(b.column("id").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)
        for i, x, y, t in rows:
            if t in held:
                held[t][2].append(i)
            else:
                held[t] = (x, y, [i])
                size += len(t or b"") + 100
            size += 8
        if size > LOCAL_BYTES:
            yield from _sent(held)
            held, size = {}, 0
    yield from _sent(held)


def _sent(held: dict) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for at in range(0, len(items), 1000):
        some = items[at : at + 1000]
        least = [min((i for i in v[2] if i is not None), default=NO_ID) for _, v in some]
        columns = (pa.array([v[0] for _, v in some], pa.int64()), pa.array([v[1] for _, v in some], pa.int64()), pa.array(least, pa.int64()), pa.array([v[2] for _, v in some], pa.list_(pa.int64())), pa.array([t for t, _ in some], pa.binary()))
        yield pa.RecordBatch.from_arrays(list(columns), ["a", "b", "least", "ids", "text"])


_PAIR = "doc_id bigint, keep_id bigint, a bigint, b bigint"


def _verified(batches):
    """Of rows sorted by digest and smallest identifier: each is compared byte by byte with the texts of its digest that came before.

    The first row of a text has the smallest identifier of it, so nothing is
    kept but one text for each that shares the digest.
    """
    rows: list[tuple] = []
    now: tuple | None = None
    entries: list[tuple] = []  # of the digest at hand: (text, smallest identifier)
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("a", "b", "least", "ids", "text"))
        for x, y, least, ids, t in zip(*columns, strict=True):
            if (x, y) != now:
                now, entries = (x, y), []
            keep = next((e[1] for e in entries if e[0] == t), NO_ID)
            if keep == NO_ID and all(e[0] != t for e in entries):
                keep = least
                entries.append((t, least))
            rows.extend((i, None if keep == NO_ID else keep, x, y) for i in ids)
        if len(rows) > 20_000:
            yield _pairs(rows)
            rows = []
    yield _pairs(rows)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "keep_id", "a", "b"])


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, a, b) of rows without a copy, (doc_id, keep_id, a, b) of those that may have one)."""
    slim = digests(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text").withColumnsRenamed({"__a": "a", "__b": "b"})
    found = util.spool(hits(slim.select("id", "a", "b")), "hits")
    both = util.marked(slim, found, ["a", "b"], "__hit")
    sent = both.where("__hit").select("id", "a", "b", "text").mapInArrow(util.frugal(_local), _SENT)
    n = util.parts(docs.sparkSession)
    return both.where("NOT __hit").select("id", "a", "b"), sent.repartition(n, "a", "b").sortWithinPartitions("a", "b", "least").mapInArrow(util.frugal(_verified), _PAIR)


def canonical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id): for each row the smallest identifier among the rows with the same text.

    Null texts are copies of each other and not of the empty text; a very long
    text is like any other. A null identifier is never the smallest unless a text
    has no other; rows repeated whole appear as often as they came, each with the
    same answer; an empty table gives none. Columns other than the two named,
    whatever their names, are not looked at.
    """
    alone, pairs = copies(docs, id_col, text_col)
    return alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id")).unionByName(pairs.select("doc_id", "keep_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are the smallest of their text, with all columns of docs.

    Decided by identifier and text together: an identifier that occurs with
    several texts goes only with those of which another has a smaller one. Rows
    with a null identifier are kept; of rows repeated whole, with equal
    identifier and text, one stays, any if they differ elsewhere. Null, empty and
    very long texts are texts like others (see canonical); an empty table stays empty.
    """
    pairs = util.spool(copies(docs, id_col, text_col)[1].where("doc_id IS NOT NULL"), "exact")
    row = [F.col("doc_id").alias("__id"), F.col("a").alias("__a"), F.col("b").alias("__b")]
    drop = util.spool(pairs.where("doc_id <> keep_id").select(*row).distinct(), "drop")
    twice = util.spool(pairs.where("doc_id = keep_id").groupBy(*row).count().where("count > 1").drop("count"), "twice")
    keys = ["__id", "__a", "__b"]
    out = util.without(digests(docs, id_col, text_col).withColumn("__id", F.col(id_col).cast("long")), drop, keys)
    n = twice.count()
    if n:
        both = util.marked(out, twice, keys, "__twice", n)
        # rows that only seem to be repeated are told apart by the text itself
        out = both.where("NOT __twice OR __id IS NULL").unionByName(both.where("__twice AND __id IS NOT NULL").dropDuplicates(["__id", text_col]))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(util.table(spark, sf_dir, "documents"))


SQL = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents"
