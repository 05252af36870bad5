import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, search
from lodestar.operators.index import EF, Index, adapted, elected, loaded, replayed
from lodestar.operators.registry import Registry
from lodestar.plans import catalog, recovery
from lodestar.plans.views import Views
from lodestar.sources.journal import Journal

from .conftest import SF


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def held(index):
    spark = index.nodes.sparkSession
    copy = lambda df: spark.createDataFrame(df.collect(), df.schema)
    return Index(copy(index.nodes), copy(index.links), copy(index.states))


def small(spark, shards=2, n=60, dim=8, seed=1):
    r = np.random.default_rng(seed)
    rows = [(s, i, 1000 * s + i, (1000 * s + i) // 4, int(i % 16 == 5) + int(i == 37), False, r.standard_normal(dim).tolist()) for s in range(shards) for i in range(n)]
    return spark.createDataFrame(rows, "shard_id int, local_idx int, partition_id bigint, document_id bigint, level int, is_deleted boolean, embedding array<float>")


def nearest(nodes, q, k, ok=lambda r: True):
    rows = [r for r in nodes.collect() if not r.is_deleted and ok(r)]
    d = lambda r: float(((np.array(r.embedding, np.float64) - q) ** 2).sum())
    out = {}
    for s in {r.shard_id for r in rows}:
        out[s] = [r.partition_id for r in sorted((r for r in rows if r.shard_id == s), key=lambda r: (d(r), r.partition_id))[:k]]
    return out


def asked(spark, n=3, dim=8, seed=9):
    r = np.random.default_rng(seed)
    q = [r.standard_normal(dim) for _ in range(n)]
    return q, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, query array<float>")


def test_insert_in_batches_is_as_good_as_at_once(spark):
    nodes = small(spark)
    q, queries = asked(spark)
    index = held(Index.build(nodes.where("local_idx < 20")))
    for a, b in ((20, 45), (45, 60)):
        new = nodes.where(f"local_idx >= {a} AND local_idx < {b}").withColumn("seq", F.col("local_idx"))
        index = held(index.inserted(new.select("shard_id", "seq", "partition_id", "document_id", "level", "embedding")))
    assert sorted(r.local_idx for r in index.nodes.where("shard_id = 1").collect()) == list(range(60))
    once = Index.build(nodes)
    assert sorted(map(tuple, index.links.collect()), key=repr) == sorted(map(tuple, once.links.collect()), key=repr)
    assert {(r.shard_id, r.entry, r.max_level) for r in index.states.collect()} == {(0, 37, 1), (1, 37, 1)} or {(r.shard_id, r.max_level) for r in index.states.collect()} == {(r.shard_id, r.max_level) for r in once.states.collect()}
    for r in index.search(queries, 5).collect():
        assert [h.partition_id for h in r.hits] == nearest(nodes, q[r.query_id], 5)[r.shard_id]


def test_upsert_marks_the_old_one(spark):
    nodes = small(spark, 1, 30)
    index = held(Index.build(nodes))
    far = spark.createDataFrame([(0, 1, 7, 1, 0, [50.0] * 8), (0, 2, 900, 225, 0, []), (0, 3, 901, 225, 0, [49.0] * 8)], "shard_id int, seq int, partition_id bigint, document_id bigint, level int, embedding array<float>")
    index = held(index.inserted(far))
    rows = sorted((r.local_idx, r.partition_id, r.is_deleted) for r in index.nodes.collect() if r.partition_id in (7, 900, 901))
    assert rows == [(7, 7, True), (30, 7, False), (31, 901, False)]
    hits = index.search(spark.createDataFrame([(0, [50.0] * 8)], "query_id bigint, query array<float>"), 2).first().hits
    assert [h.partition_id for h in hits] == [7, 901]


def test_put_routes_documents(spark):
    index = held(Index.build(small(spark, 2, 20)))
    r = np.random.default_rng(4)
    rows = [(i, 5000 + i, 2 if i < 2 else 800 + i // 3, 0, r.standard_normal(8).tolist()) for i in range(30)]
    docs = spark.createDataFrame(rows, "seq int, partition_id bigint, document_id bigint, level int, embedding array<float>")
    after = held(index.put(docs, capacity=24))
    where = {r.document_id: r.shard_id for r in graph.routing(after.nodes).collect()}
    assert where[2] == 0  # stays where it was
    assert [r.is_deleted for r in after.nodes.where("document_id = 2").orderBy("local_idx").collect()] == [True] * 4 + [False] * 2
    per = {r.shard_id: r["count"] for r in after.nodes.where("NOT is_deleted").groupBy("shard_id").count().collect()}
    assert per[0] <= 24 + 3 and per[1] <= 24 + 3 and max(per) == 2 and {r.shard_id for r in after.states.collect()} == {0, 1, 2}


def test_removal_elects_another_entry(spark):
    index = held(Index.build(small(spark)))
    entry = {r.shard_id: r.entry for r in index.states.collect()}
    gone = index.nodes.where(F.col("local_idx") == entry[0]).where("shard_id = 0").select("document_id")
    after = held(index.removed(gone))
    states = {r.shard_id: r for r in after.states.collect()}
    best = after.nodes.where("shard_id = 0 AND NOT is_deleted").orderBy(F.desc("level"), "local_idx").first()
    assert (states[0].entry, states[0].max_level) == (best.local_idx, best.level) and states[1].entry == entry[1]
    none = held(index.removed(index.nodes.select("document_id")))
    assert {(r.entry, r.max_level) for r in none.states.collect()} == {(-1, -1)}
    assert none.search(asked(spark)[1], 3).count() == 0


def test_compaction_demotes_and_elects(spark):
    nodes = spark.createDataFrame([(0, i, 10 + i, i, lv, i in (1, 4, 5), [float(i)] * 4) for i, lv in enumerate([0, 2, 1, 1, 1, 0, 0])], "shard_id int, local_idx int, partition_id bigint, document_id bigint, level int, is_deleted boolean, embedding array<float>")
    rows = [(0, 0, [1, 2]), (1, 0, [0, 2]), (1, 1, [2]), (1, 2, []), (2, 0, [1, 3, 0]), (2, 1, [1, 4]), (3, 0, [2, 5, 6]), (3, 1, []), (4, 0, [3]), (4, 1, [2]), (5, 0, [3]), (6, 0, [5, 3])]
    links = spark.createDataFrame([(0, *r) for r in rows], "shard_id int, local_idx int, layer int, neighbours array<int>")
    after = Index(nodes, links, elected(nodes)).compacted(0.4)
    # 3 had nobody above layer 0 and comes down; 2 loses its two there only now and keeps its level
    assert [(r.local_idx, r.partition_id, r.level) for r in after.nodes.orderBy("local_idx").collect()] == [(0, 10, 0), (1, 12, 1), (2, 13, 0), (3, 16, 0)]
    assert {(r.local_idx, r.layer): list(r.neighbours) for r in after.links.collect()} == {(0, 0): [1], (1, 0): [2, 0], (1, 1): [], (2, 0): [1, 3], (3, 0): [2]}
    assert after.states.first()[:3] == (0, 1, 1)
    same = Index(nodes, links, elected(nodes)).compacted(0.5)
    assert same.nodes.count() == 7 and same.links.count() == len(rows) and {tuple(r.neighbours) for r in same.links.collect()} == {tuple(r[2]) for r in rows}
    edges = spark.createDataFrame([(11, 12, 1), (12, 11, 1), (14, 12, 1), (10, 12, 0)], "src bigint, dst bigint, layer int")
    assert [r.level for r in graph.compact(nodes, edges, 0.4)[0].orderBy("local_idx").collect()] == [0, 1, 0, 0]


def test_breadth_follows_what_is_looked_at(spark):
    ema, ef = adapted(0, 100)
    assert (ema, ef) == (100, 150) and adapted(100, 200) == (pytest.approx(115), 173) and adapted(0, 1)[1] == 50 and adapted(0, 10**6)[1] == 800
    index = held(Index.build(small(spark)))
    q, queries = asked(spark, 4)
    got = sorted(index.search(queries, 5).collect(), key=lambda r: (r.shard_id, r.query_id))
    ema = 0
    for r in got[:4]:
        assert r.nodes == 60 and r.found == 60 and r.max_level == len(r.hops)
        ema, after = adapted(ema, r.explored)
        assert r.next_ef == after and r.ema == pytest.approx(ema)
    assert [r.ef for r in got[:4]] == [EF] + [r.next_ef for r in got[:3]]
    learnt = index.learned(index.search(queries, 5))
    assert {r.ef for r in learnt.states.collect()} == {got[3].next_ef}
    assert {r.ef for r in index.search(queries, 5, ef=7).collect()} == {7}


def test_what_may_not_be_returned_is_walked_through(spark):
    nodes = small(spark, 1, 60)
    index = held(Index.build(nodes))
    q, queries = asked(spark)
    few = nodes.where("document_id % 5 = 2").select("document_id")
    for r in index.search(queries, 5, few).collect():
        assert [h.partition_id for h in r.hits] == nearest(nodes, q[r.query_id], 5, lambda r: r.document_id % 5 == 2)[0]


def test_recall_of_the_stored_graph(views):
    found = views.graph.search(views.queries(), 10, ef=40)
    got = {(r.query_id, r.shard_id): {h.partition_id for h in r.hits} for r in found.collect()}
    want: dict = {}
    for r in search.candidates(views.node.where("NOT is_deleted"), views.queries(), 10, ("shard_id",)).collect():
        want.setdefault((r.query_id, r.shard_id), set()).add(r.partition_id)
    assert np.mean([len(got[k] & w) / len(w) for k, w in want.items()]) >= 0.9


def test_replay_gives_the_state_twice(spark):
    nodes = small(spark, 1, 30)
    index = held(Index.build(nodes))
    rows = [(1, 0, "insert", 30, 500, 125, 0, 0, [3, 4]), (2, 0, "link", 3, None, None, None, 0, [30, 1]), (3, 0, "link", 99, None, None, None, 0, [1]), (4, 0, "link", 3, None, None, None, 7, [1]),
            (5, 0, "delete", 2, None, None, None, None, None), (6, 0, "insert", 31, 1, 0, 0, 0, [9]), (7, 0, "entry", 30, None, None, 0, None, None), (8, 0, "entry", 400, None, None, 9, None, None), (9, 1, "insert", 0, 700, 175, 1, 0, []), (9, 1, "insert", 0, 700, 175, 1, 1, [])]
    log = spark.createDataFrame(rows, "seq bigint, shard_id int, kind string, local_idx int, partition_id bigint, document_id bigint, level int, layer int, neighbours array<int>")
    plain = index.nodes.drop("embedding")
    once = replayed(plain, index.links, index.states, log)
    twice = replayed(*(spark.createDataFrame(df.collect(), df.schema) for df in (once.nodes, once.links, once.states)), log)
    both = replayed(plain, index.links, index.states, log.union(log.withColumn("seq", F.col("seq") + 10)))
    for other in (twice, both):
        for a, b in ((once.nodes, other.nodes), (once.links, other.links), (once.states, other.states)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert {(r.local_idx, r.is_deleted) for r in once.nodes.where("shard_id = 0 AND local_idx IN (2, 30, 31)").collect()} == {(2, True), (30, False)}
    assert {(r.shard_id, r.entry, r.max_level) for r in once.states.collect()} >= {(0, 30, 0)}
    assert [list(r.neighbours) for r in once.links.where("shard_id = 0 AND local_idx = 3 AND layer = 0").collect()] == [[30, 1]]


def test_recovery(spark, tmp_path):
    nodes = small(spark, 2, 20)
    registry = Registry(
        spark.createDataFrame([("o", d) for d in (*range(0, 4), *range(250, 255), 99)], "owner_id string, document_id bigint").withColumn("group_id", F.lit("g")),
        spark.createDataFrame([], "document_id bigint, group_id string"), spark.createDataFrame([], "group_id string, owner_id string, label string, access string, tags array<string>"),
        spark.createDataFrame([(d, "restricted") for d in (*range(0, 4), *range(250, 255), 99)], "document_id bigint, access string"),
    )
    j = Journal(spark, str(tmp_path), "graph")
    vectors = nodes.select("shard_id", "partition_id", "embedding")
    assert recovery.recover(j, registry, vectors) is None
    full = held(Index.build(nodes))
    # a checkpoint of shard 0 with 19 nodes, a log with the last one, with shard 1 and a second node of partition 3
    part = Index(full.nodes.where("shard_id = 0 AND local_idx < 19").drop("embedding"), full.links.where("shard_id = 0 AND local_idx < 19"), full.states.where("shard_id = 0"))
    j.checkpoint({"nodes": part.nodes, "links": part.links, "states": part.states}, seq=0)
    late = full.nodes.where("shard_id = 1 OR local_idx = 19").join(full.links, ["shard_id", "local_idx"])
    log = late.select((F.col("partition_id") + 1).alias("seq"), "shard_id", F.lit("insert").alias("kind"), "local_idx", "partition_id", "document_id", "level", "layer", "neighbours")
    log = log.unionByName(spark.createDataFrame([(9001, 1, "entry", 5, None, None, 1, None, None), (9002, 1, "delete", 3, None, None, None, None, None)], log.schema))
    j.append(log.withColumn("seq", F.row_number().over(__import__("pyspark").sql.Window.orderBy("seq", "layer")).cast("bigint")))
    got = recovery.recover(j, registry, vectors, nodes.where("document_id < 3").select("document_id"), at=0.9)
    report = {r.what: r.n for r in got.report.collect()}
    live = got.index.nodes.where("NOT is_deleted").collect()
    assert {r.document_id for r in live} == {*range(0, 4), *range(250, 255)} and len(live) == report["nodes"] == 16 + 20 - 1
    assert report["orphans"] == 1 and report["shards without vectors"] == 0 and report["copies"] == 0
    assert {r.document_id: r.shard_id for r in got.routing.collect()} == {d: int(d >= 250) for d in (*range(0, 4), *range(250, 255))}
    assert {r.document_id for r in got.missing.collect()} == {3, 99, *range(250, 255)}
    q, queries = asked(spark)
    for r in got.index.search(queries, 4).collect():
        assert [h.partition_id for h in r.hits] == nearest(got.index.nodes, q[r.query_id], 4)[r.shard_id]
    # a shard that has lost vectors is left out of search
    cut = recovery.recover(j, registry, vectors.where("partition_id <> 1004"), at=0.9)
    assert {r.shard_id: r.entry == -1 for r in cut.index.states.collect()} == {0: False, 1: True}
    assert {r.shard_id for r in cut.index.search(queries, 4).collect()} == {0}


def test_stored_and_loaded(spark, tmp_path):
    from lodestar.sources.store import Store

    index = Index.build(small(spark, 1, 15))
    store = Store(spark, str(tmp_path))
    assert Index.restore(store) is None
    index.save(store)
    again = Index.restore(store)
    q, queries = asked(spark)
    assert sorted(map(repr, again.search(queries, 3).collect())) == sorted(map(repr, index.search(queries, 3).collect()))
    g = loaded(again.nodes.orderBy("local_idx").toPandas(), again.links.toPandas(), 0)
    assert all(len(x) == n + 1 for x, n in zip(g.links, g.levels, strict=True))


def test_texts_are_attached_without_a_shuffle_of_them(spark, views):
    hits = search.search(views, views.queries(), catalog.OWNER, bound=views.bound).select("query_id", "partition_id", "position")
    content = views.table("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("partition_id"), "text")
    out = search.materialise(hits, content)
    assert out.count() == hits.count() and out.where("text IS NULL").count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_shards_are_divided_among_tasks(spark):
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    nodes = small(spark, shards=12, n=20)
    _, queries = asked(spark)
    index = Index.build(nodes)
    assert tasks(index.links) > 1
    index = held(index)
    assert tasks(index.search(queries, 3)) > 1
    new = nodes.where("local_idx < 3").withColumn("seq", F.col("local_idx")).select("shard_id", "seq", (F.col("partition_id") + 500).alias("partition_id"), "document_id", "level", "embedding")
    assert tasks(index.inserted(new).links.where("local_idx >= 20")) > 1
    assert tasks(graph.graph_edges(nodes)) > 1


def test_graph_is_the_same_with_and_without_table(monkeypatch):
    def made():
        out = []
        for seed, n in enumerate((1, 2, 40, 160)):
            r = np.random.default_rng(seed)
            x = r.standard_normal((n, 8)).astype(np.float32).astype(np.float64)
            x[n // 2 :] = x[: n - n // 2] if seed % 2 else x[n // 2 :]
            g = graph.Graph().build(x, np.minimum(np.floor(-np.log(r.random(n)) / np.log(4)).astype(int), 3))
            out.append((g.links, g.entry, [g.traced(q, ef, ok) for q in r.standard_normal((5, 8)) for ef in (5, 50) for ok in (None, r.random(n) < 0.5)]))
        return out

    with_table = made()
    monkeypatch.setattr(graph, "TABLE", 0)
    assert made() == with_table


def test_insertion_builds_the_first_graph_once(spark):
    plan = catalog.QUERIES["ann_after_insert"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
