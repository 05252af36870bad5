import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, ingest, log, quantize, search
from lodestar.operators.registry import Registry
from lodestar.plans.views import Views

from .conftest import SF


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def vectors(n, dim=32, seed=1):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


# --- search -------------------------------------------------------------------------
def test_candidates_with_odd_vectors(spark):
    x = vectors(40)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(90, 0, []), (91, 1, None), (92, 2, [1.0])]
    df = spark.createDataFrame(rows, "partition_id bigint, shard_id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(7, x[3].tolist())], "query_id bigint, query array<float>")
    got = [r.partition_id for r in search.candidates(df, q, 5).orderBy("rank").collect()]
    want = np.argsort(((x - x[3]) ** 2).sum(1), kind="stable")[:5].tolist()
    assert got == want
    assert search.candidates(df, q.limit(0), 5).count() == 0
    per = search.candidates(df, q, 2, ("shard_id",)).groupBy("shard_id").count().collect()
    assert {r.shard_id: r["count"] for r in per} == {0: 2, 1: 2, 2: 2}


def test_thresholds_of_larger_shards(spark):
    x = vectors(200, 8)

    def model(x):
        t = None
        for i in range(1, len(x) + 1):
            if i > 10 and (i <= 64 or i % 64 == 0):
                m = i - 1
                step = max(1, m // min(150, m))
                d = ((x[0:m:step][:150].astype(np.float64) - x[m]) ** 2).sum(1)
                new = d.mean() + 1.5 * d.std()
                t = new if i < 100 or t is None else 0.9 * t + 0.1 * new
        return t

    sizes = {0: 200, 1: 64, 2: 30, 3: 10, 4: 128}
    rows = [(s, i, x[i].tolist()) for s, n in sizes.items() for i in range(n)]
    got = {r.shard_id: r.threshold for r in search.thresholds(spark.createDataFrame(rows, "shard_id int, local_idx int, embedding array<float>")).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert all(abs(got[s] - model(x[: sizes[s]])) < 1e-6 for s in got)


def test_cut_keeps_all_of_a_group_without_survivors(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, 3.0), (2, 4.0)], "q int, d double")
    assert sorted((r.q, r.d) for r in search.cut(df, ["q"], F.col("d"), F.lit(1.0)).collect()) == [(1, 0.5), (2, 3.0), (2, 4.0)]


def test_scope_rules(views):
    ids = lambda **k: {r.document_id for r in search.scope_documents(views, "owner_3", **k).collect()}
    own, everything = ids(scope="personal"), ids(scope="global")
    assert own < everything
    assert ids(scope="personal", group="owner_3-g1") < own
    assert ids(scope="personal", group="owner_3-g1", aggregate=True) == own
    assert ids(scope="personal", groups=["owner_3-g1"], aggregate=True) == ids(scope="personal", group="owner_3-g1")
    assert ids(scope="personal", groups=["nothing"]) == set()


def test_pool_may_exceed_k(views):
    got = search.search(views, views.queries(3), "owner_3", "global").groupBy("query_id").count().collect()
    assert all(search.K < r["count"] <= search.POOL for r in got)


def test_rerank_hook(views):
    far = search.search(views, views.queries(2), "owner_3", rerank=lambda d: -d).where("position = 1").select("query_id", "distance").collect()
    near = search.search(views, views.queries(2), "owner_3").where("position = 1").select("query_id", "distance").collect()
    assert all(dict(far)[q] > dict(near)[q] for q in dict(near))


# --- quantization -------------------------------------------------------------------
def test_kmeans_finds_separate_clusters():
    x = np.concatenate([vectors(30, 4) * 0.01 + c for c in (0, 10, 20, 30)])
    c = quantize.kmeans(x, 4, seed=3)
    assert sorted(np.round(c.mean(1)).tolist()) == [0, 10, 20, 30]


def test_trained_codebooks(views):
    got = quantize.train(views.partition, "shard_id", 4)
    n = got.groupBy("shard_id", "sub").count().collect()
    assert {r["count"] for r in n} == {2} and len(n) == 4 * 16
    again = quantize.train(views.partition, "shard_id", 4)
    assert got.exceptAll(again).count() == 0


# --- graph --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def built():
    x = vectors(300).astype(np.float64)
    levels = np.minimum(np.floor(-np.log(np.random.default_rng(4).uniform(size=300)) / np.log(16)), 3).astype(int)
    return x, levels, graph.Graph().build(x, levels)


def test_graph_invariants(built):
    x, levels, g = built
    assert levels[g.entry] == levels.max()
    for i, own in enumerate(g.links):
        assert len(own) == levels[i] + 1
        assert own[0]
        for layer, n in enumerate(own):
            assert len(n) <= (32 if layer == 0 else 16) and i not in n and len(set(n)) == len(n)


def test_graph_recall_and_order(built):
    x, _, g = built
    hit = 0
    for q in vectors(20, seed=9).astype(np.float64):
        want = set(np.argsort(((x - q) ** 2).sum(1))[:5].tolist())
        got = g.search(q, 5)
        assert [d for d, _ in got] == sorted(d for d, _ in got)
        hit += len(want & {i for _, i in got})
    assert hit / 100 >= 0.9


def test_graph_walks_through_what_it_may_not_return(built):
    x, _, g = built
    allowed = np.zeros(len(x), bool)
    allowed[::25] = True
    got = g.search(x[1], 5, allowed=allowed)
    want = sorted((float(((x[i] - x[1]) ** 2).sum()), int(i)) for i in np.flatnonzero(allowed))[:5]
    assert [i for _, i in got] == [i for _, i in want]


@pytest.mark.parametrize("kind", ["graph", "ivf"])
def test_ann_recall(views, kind):
    q = views.queries()
    exact = search.candidates(views.node.where("NOT is_deleted"), q, 10).select("query_id", "partition_id")
    if kind == "graph":
        rows = graph.ann(views.node, q, 10)
        got = {(r.query_id, r.partition_id) for r in rows.collect()}
    else:
        got = {(r.query_id, r.partition_id) for r in graph.ivf(views.node.where("NOT is_deleted").select("partition_id", "embedding"), q, 10, 16, 12).collect()}
    want = {(r.query_id, r.partition_id) for r in exact.collect()}
    assert len(want & got) / len(want) >= 0.8


def test_compaction(views):
    nodes = views.node
    edges = graph.knn_edges(nodes.withColumn("is_deleted", F.lit(False)))
    new, kept = graph.compact(nodes, edges)
    assert new.where("is_deleted").count() == 0
    ids = [r.local_idx for r in new.where("shard_id = 1").orderBy("local_idx").collect()]
    assert ids == list(range(len(ids)))
    alive = {r.partition_id for r in new.collect()}
    assert all(r.src in alive and r.dst in alive for r in kept.collect())


def test_shards_fill_in_order(spark):
    docs = [(i, i, n) for i, n in enumerate([3, 4, 1, 9, 2, 2, 5])]
    got = {r.document_id: r.shard_id for r in graph.fill(spark.createDataFrame(docs, "seq bigint, document_id bigint, nodes bigint"), 5).collect()}
    want, shard, n = {}, 0, 0
    for _, d, k in docs:
        if n >= 5:
            shard, n = shard + 1, 0
        want[d] = shard
        n += k
    assert got == want


# --- registry -----------------------------------------------------------------------
@pytest.fixture
def small(spark):
    return Registry(
        spark.createDataFrame([("a", 1, "ga"), ("a", 2, "ga"), ("b", 2, "gb")], "owner_id string, document_id bigint, group_id string"),
        spark.createDataFrame([(1, "ga"), (2, "ga"), (2, "gb")], "document_id bigint, group_id string"),
        spark.createDataFrame([("ga", "a", "A", "available", ["x"]), ("gb", "b", "B", "restricted", ["y"])], "group_id string, owner_id string, label string, access string, tags array<string>"),
        spark.createDataFrame([(1, "available"), (2, "available")], "document_id bigint, access string"),
    )


NEW = "owner_id string, document_id bigint, group_id string, label string, tags array<string>, access string"


def access(r):
    return {x.document_id: x.access for x in r.document_access.collect()}


def test_registering_without_group_restricts(spark, small):
    after = small.registered(spark.createDataFrame([("a", 1, None, None, [], None)], NEW))
    assert access(after) == {1: "restricted", 2: "available"}


def test_registering_into_own_and_foreign_groups(spark, small):
    after = small.registered(spark.createDataFrame([("b", 3, "ga", None, ["n"], None), ("a", 4, "ga", None, ["n"], None), ("c", 5, "gc", "C", ["q"], "available")], NEW))
    assert access(after) == {1: "available", 2: "available", 3: "restricted", 4: "available", 5: "available"}
    tags = {g.group_id: g.tags for g in after.groups.collect()}
    assert tags == {"ga": ["n", "x"], "gb": ["y"], "gc": ["q"]}
    assert {(r.document_id, r.group_id) for r in after.document_group.collect()} == {(1, "ga"), (2, "ga"), (2, "gb"), (4, "ga"), (5, "gc")}


def test_linking_leaves_access_and_tags(spark, small):
    after = small.linked(spark.createDataFrame([("b", 1, "ga"), ("b", 1, "gn")], "owner_id string, document_id bigint, group_id string"))
    assert access(after) == access(small)
    assert {g.group_id for g in after.groups.collect()} == {"ga", "gb", "gn"}
    assert {r.document_id for r in after.owner_document.where("owner_id = 'b'").collect()} == {1, 2}


def test_unlinking(spark, small):
    after = small.unlinked(spark.createDataFrame([("a", 1), ("a", 2)], "owner_id string, document_id bigint"))
    assert access(after) == {2: "available"}
    assert {(r.document_id, r.group_id) for r in after.document_group.collect()} == {(2, "gb")}
    assert after.groups.count() == 2
    assert small.without_owner("a").groups.count() == 1


def test_only_owners_change_access(small):
    assert access(small.with_access("b", 1, "restricted")) == access(small)
    assert access(small.with_access("a", 1, "restricted"))[1] == "restricted"
    assert access(small.with_group_access("b", "ga", "restricted")) == access(small)
    assert set(access(small.with_group_access("a", "ga", "restricted")).values()) == {"restricted"}


def test_labels_and_groups(small):
    assert {g.label for g in small.relabelled("a", "ga", "New").relabelled("b", "ga", "Not").groups.collect()} == {"New", "B"}
    assert small.without_groups("b", ["ga", "gb"]).groups.count() == 1


# --- ingest -------------------------------------------------------------------------
def test_put_and_remove(spark):
    index = spark.createDataFrame([("d1", 1, [1.0]), ("d2", 2, [2.0])], "document_id string, partition_id bigint, embedding array<float>")
    new = spark.createDataFrame([("d1", 9, [3.0]), ("d3", 8, [])], "document_id string, partition_id bigint, embedding array<float>")
    assert {(r.document_id, r.partition_id) for r in ingest.put(index, new).collect()} == {("d1", 9), ("d2", 2)}
    assert [r.document_id for r in ingest.remove_partition(index, 1).collect()] == ["d2"]


def test_embedding_is_made_once_for_a_text(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "i int, t string")
    got = {r.i: r.embedding for r in ingest.embed(rows, "t").collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_embedding_is_the_same_wherever_a_text_goes_on_in_the_next_batch(spark):
    rows = [(i, {"k": [i]}, (["a", "b", "", None] + [f"t{j}" for j in range(9)])[i % 13]) for i in range(130)]
    df = spark.createDataFrame(rows, "i int not null, m map<string,array<int>>, t string").withColumn("n", F.array(F.lit(1)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        # another vector at each call; too many texts at a time or an empty one are errors
        got = ingest.embed(df, "t", lambda texts: [np.random.rand(3) for t in texts if len(texts) <= 3 and t], batch=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.i, r.m, r.t, r.n) for r in got) == [(*r, [1]) for r in rows]
    assert len({(r.t, tuple(r.embedding)) for r in got if r.t}) == 11 and all(r.embedding is None for r in got if not r.t)


def test_texts_are_read_and_shuffled_once_when_prepared(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = ingest.prepared(docs, "o").groupBy("document_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    # a null identifier isn't one; texts with the same words are one document with the places of the longest
    some = spark.createDataFrame([(1, "b a"), (2, "a b"), (None, "c"), (3, None), (4, "a b" + " a b" * 1000)], "doc_id int, text string")
    got = [(r.document_id, r.pos) for r in ingest.prepared(some, "O").collect()]
    assert len(set(got)) == len(got) == 3 and {p for _, p in got} == {0, 1, 2}


# --- queue and log ------------------------------------------------------------------
JOBS = "lane int, seq bigint, owner_id string, group_id string, kind string, items bigint"


def test_capped_queue_against_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(i % 2, i, rng.choice("ab"), rng.choice(["g", None]), rng.choice(["put", "put", "put", "remove"]), rng.randrange(1, 60)) for i in range(200)]
    want = []
    for lane in (0, 1):
        now = None
        for _, s, o, g, k, n in [r for r in rows if r[0] == lane]:
            if now and now[5] and k == "put" and now[3:5] == [o, g] and now[6] < 100:
                now[2], now[6] = s, now[6] + n
            else:
                if now:
                    want.append(now)
                now = [lane, s, s, o, g, k == "put", n]
        want.append(now)
    got = [[r.lane, r["first"], r["last"], r.owner_id, r.group_id, r["items"]] for r in log.capped(spark.createDataFrame(rows, JOBS), "lane").collect()]
    assert sorted(got, key=repr) == sorted(([*w[:5], w[6]] for w in want), key=repr)


def test_replay_counts_a_record_once(spark):
    rows = [(1, "registered", 5, 0.0, False), (2, "earnings", 5, 2.0, False), (2, "earnings", 5, 2.0, False), (3, "earnings", 5, -1.0, False), (4, "earnings", 5, 7.0, True), (5, "earnings", 5, 9.0, False)]
    df = spark.createDataFrame(rows, "seq bigint, op string, document_id bigint, value double, corrupt boolean").withColumn("ts", F.lit(None).cast("timestamp"))
    assert [(r.registered, r.earned) for r in log.replay(df).collect()] == [(True, 2.0)]
    assert log.replay(df, 2).first().earned == 0.0
    assert log.committed(df).count() == 0
