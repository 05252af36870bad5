from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.sources import journal
from lodestar.sources import store as S
from lodestar.streaming import queue

from .conftest import SF


def test_versions(spark, tmp_path):
    s = S.Store(spark, str(tmp_path))
    assert s.restore("t") is None
    s.save("t", spark.range(3))
    before = s.restore("t")
    s.append("t", spark.range(10, 12))
    assert s.restore("t").count() == 5 and before.count() == 3
    s.save("t", spark.range(1))
    assert s.versions("t") == [0, 1, 2] and s.restore("t").count() == 1 and s.restore("t", 0).count() == 3 and s.restore("t", 1).count() == 5
    s.keep("t", 1)
    assert s.versions("t") == [2] and s.restore("t").count() == 1 and len(list((tmp_path / "t" / "segments").iterdir())) == 1
    s.purge("t")
    assert s.restore("t") is None


def test_a_version_appears_whole(spark, tmp_path):
    s = S.Store(spark, str(tmp_path))
    s.save_together("t", {"a": spark.range(2), "b": spark.range(3)})
    s._write("t", spark.range(100))  # a writer that died before it published
    got = s.restore_together("t", ("a", "b"))
    assert got["a"].count() == 2 and got["b"].count() == 3
    s.extend("t", {"a": spark.range(5)}, {"b": spark.range(1)})
    got = s.restore_together("t", ("a", "b"))
    assert got["a"].count() == 7 and got["b"].count() == 1 and s.segment_count("t", "a") == 2
    (tmp_path / "t" / "versions" / "v2").write_text("not a list of segments")
    assert s.restore_together("t", ("a",)) is None


def test_vector_file(spark, tmp_path):
    x = np.arange(24, dtype="<f4").reshape(6, 4)
    (tmp_path / "v.bin").write_bytes(x.tobytes() + b"\0\0")
    got = S.read_vector_file(spark, str(tmp_path / "v.bin"), 4)
    assert [r.embedding for r in got.orderBy("slot").collect()] == x.tolist()
    pieces = S._file_ranges(spark, str(tmp_path / "v.bin"), 16)
    assert [(r.first, r.rows) for r in pieces.collect()] == [(0, 6)]
    order = spark.createDataFrame([(5, 0), (2, 1)], "old_slot bigint, slot bigint")
    assert [r.embedding for r in S.reorder(got, order).orderBy("slot").collect()] == [x[5].tolist(), x[2].tolist()]


def test_vector_files_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BYTES", 64)
    for k in range(2):
        (tmp_path / f"v{k}.bin").write_bytes((np.arange(400, dtype="<f4") + 1000 * k).tobytes())
    got = S.read_vector_file(spark, str(tmp_path), 4)
    assert got.rdd.getNumPartitions() > 20
    assert [r.embedding[0] for r in got.orderBy("path", "slot").collect()] == [1000.0 * k + 4 * i for k in range(2) for i in range(100)]


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.html").write_bytes(b"<p>x</p>")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in S.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é", "b.txt": "é", "c.html": "x"}


@pytest.mark.parametrize("damage", [None, "cut", "flip"])
def test_log_frames(spark, tmp_path, damage):
    records = [(1, b"one"), (2, b""), (3, b"three" * 100)]
    raw = S.frames(records)
    raw = raw[:-3] if damage == "cut" else raw[:-20] + b"?" + raw[-19:] if damage == "flip" else raw
    (tmp_path / "log").write_bytes(raw)
    got = [(r.kind, bytes(r.payload)) for r in S.read_log(spark, str(tmp_path / "log")).orderBy("seq").collect()]
    assert got == (records if damage is None else records[:2])


def test_put_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(12)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    s = S.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = queue.put_stream(queue.file_stream(spark, str(tmp_path / "in"), "doc_id bigint, text string"), s, "Owner", str(tmp_path / "cp"), group_id="g")
        q.awaitTermination(120)
    assert s.versions("index") == [1, 2] and s.segment_count("index", "index") == 3
    registry, index = queue.state(s)
    assert index.select("partition_id", "document_id", "pos").distinct().count() == index.count() > 0
    assert {r.owner_id for r in index.select("owner_id").distinct().collect()} == {"owner"}
    ids = {r.document_id for r in index.select("document_id").distinct().collect()}
    assert ids == {r.document_id for r in registry.owner_document.collect()} == {r.document_id for r in registry.document_group.collect()}
    # a batch that is run again changes nothing, and folding neither
    part = spark.read.parquet(str(tmp_path / "in")).limit(4)
    before = index.count()
    queue.put_batch(part, s, "owner", "index", 2, "g")
    queue.put_batch(part, s, "owner", "index", 3, "g", fold_at=2)
    assert queue.current(s).count() == before and s.segment_count("index", "index") == 1


def test_a_failed_stream_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s, tries, seen = S.Store(spark, str(tmp_path / "store")), [], []

    def start():
        def batch(df, number):
            tries.append(number)
            if len(tries) == 1:
                raise RuntimeError("out of luck")
            seen.extend(r.id for r in df.collect())

        return queue.file_stream(spark, str(tmp_path / "in"), "id bigint", 100).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    queue.resumed(start, s, "errors")
    assert sorted(seen) == [0, 1, 2] and "out of luck" in s.restore("errors").first().error


def test_requests_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"owner_id":"ANN"}\n{"owner_id":"bob","scope":"global"}\n')
    q = queue.requests(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("asked").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.owner_id, r.scope) for r in spark.table("asked").collect()) == [("ann", "personal"), ("bob", "global")]


TOPOLOGY = [
    {"kind": "insert", "partition_id": "pé", "document_id": "d", "vector_index": 3, "level": 1, "neighbours": [[1, 2], []]},
    {"kind": "link", "local_idx": 2, "level": 0, "neighbours": [[5, 1, 7]]},
    {"kind": "entry", "local_idx": -1, "level": -1},
    {"kind": "delete", "local_idx": 9},
]
GROUP = {"id": "g", "label": "l", "owner_id": "o", "access": "available", "description": None, "tags": ["a", "b"]}
STATS = [{"document_id": "d", "retrievals": 2, "sentiment": 0.5, "last_retrieved": datetime(2024, 1, 2, 3, 4, 5), "counts": {"p": 3}, "sentiments": {"p": {"retrievals": 1, "sentiment": 0.25, "last_retrieved": None}}}]
REGISTRY = [
    {"kind": "registered", "document_id": "d", "owner_id": "o", "group": GROUP},
    {"kind": "linked", "document_id": "d", "owner_id": "o2", "group": None},
    {"kind": "earnings", "earnings": [{"document_id": "d", "credits": 1.5}]},
    {"kind": "performance", "stats": STATS},
]


def test_records_of_both_logs(spark, tmp_path):
    for r in TOPOLOGY:
        assert journal.decode_topology(*journal.encode_topology(**r)) == r
    codes = [journal.encode_registry("registered", "d", "o", GROUP), journal.encode_registry("linked", "d", "o2"), journal.encode_registry("earnings", earnings=[("d", 1.5)]), journal.encode_registry("performance", stats=STATS)]
    assert [journal.decode_registry(*c) for c in codes] == REGISTRY
    assert journal.encode_topology("delete", 9) == (3, b"\x09\0\0\0") and journal.encode_topology("commit") == (5, b"")
    path = str(tmp_path / "t.log")
    commit = journal.encode_topology("commit")
    n = journal.write_records(path, [journal.encode_topology(**r) for r in TOPOLOGY[:2]] + [commit])
    assert journal.write_records(path, [journal.encode_topology(**r) for r in TOPOLOGY[2:]]) > n
    got = journal.read_records(spark, path).orderBy("seq").collect()
    assert [(r.kind, r.local_idx, r.partition_id, r.neighbours) for r in got] == [("insert", None, "pé", [[1, 2], []]), ("link", 2, None, [[5, 1, 7]])]
    journal.write_records(path, [journal.encode_topology(**r) for r in TOPOLOGY], append=False)
    assert journal.read_records(spark, path).count() == 4  # a log without commits counts whole
    path = str(tmp_path / "r.log")
    journal.write_records(path, [*codes, (9, b"unknown"), codes[0]])
    got = journal.read_records(spark, path, "registry").orderBy("seq").collect()
    assert [r.kind for r in got] == ["registered", "linked", "earnings", "performance"]
    assert got[0].group.tags == ["a", "b"] and got[2].earnings[0].credits == 1.5 and got[3].stats[0].counts == {"p": 3}


def test_journal(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("x"))
    j = journal.Journal(spark, str(tmp_path), "reg", limit=10)
    assert j.tail() is None and j.state(("sums",)) is None and not j.due()
    j.append(rows(0, 5))
    j.append(rows(5, 9))
    with pytest.raises(ValueError):
        j.append(rows(8, 10))
    assert j.tail().count() == 9 and j.due()
    total = lambda: (j.state(("sums",))["sums"].first().s if j.state(("sums",)) else 0) + ((j.tail().agg(F.sum("x")).first()[0] or 0) if j.tail() else 0)
    assert total() == 72
    j.checkpoint({"sums": j.tail().agg(F.sum("x").alias("s"))})
    assert j.tail() is None and j.checkpoint_seq() == 8 and j.size() == 0 and total() == 72
    j.append(rows(9, 11))
    assert total() == 72 + 38
    # a crash between checkpoint and truncation leaves batches that count once all the same
    j.store.save_together("reg", {"sums": spark.createDataFrame([(110,)], "s bigint"), "upto": spark.createDataFrame([(10,)], "seq bigint")})
    assert j.size() > 0 and j.tail() is None and total() == 110
    j.truncate()
    assert j.size() == 0
    # a batch that wasn't written whole isn't there
    (tmp_path / "reg-log" / f"{11:020d}-{12:020d}-x").mkdir()
    assert j.tail() is None


def test_windows_over_event_time(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{SF}/events.parquet*")
    q = queue.event_counts(stream, "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    want = {(r.start, r.event_type): r.n for r in e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
