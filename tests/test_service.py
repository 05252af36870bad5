from lodestar.operators.registry import Registry
from lodestar.plans.service import Service


def fresh(spark):
    return Service.empty(spark)


def held(service):
    """The same, from driver-side copies, so that plans don't grow in this test."""
    spark = service.index.sparkSession
    copy = lambda df: spark.createDataFrame(df.collect(), df.schema)
    r = service.registry
    info = None if service.info is None else copy(service.info)
    return Service(Registry(copy(r.owner_document), copy(r.document_group), copy(r.groups), copy(r.document_access)), copy(service.index), info=info)


def test_ingest_search_remove(spark):
    docs = spark.createDataFrame([(1, "red apples grow on tall trees"), (2, "blue whales swim in cold oceans"), (3, "  ")], "doc_id bigint, text string")
    s, out = fresh(spark).ingest(docs, "Ann", "ann-g")
    assert out.first().asDict() == {"skipped": 0, "linked": 0, "prepared": 2, "failed": 1, "success": False, "tokens": 0}
    s = held(s)
    hit = s.search(["whales in oceans"], "ann", k=1).collect()
    assert [h.preview for h in hit] == ["blue whales swim in cold oceans"]
    assert s.search(["whales"], "bob").count() == 0
    again, out = s.ingest(docs, "ann", "ann-g")
    assert out.first().skipped == 2
    s, out = s.ingest(docs.where("doc_id = 2"), "bob")
    assert out.first().linked == 1
    s = held(s)
    assert s.search(["whales"], "bob").count() == 1 and s.index.count() == 2
    whales = s.index.where("text LIKE 'blue%'").select("document_id")
    s = held(s.removed("ann", whales))
    assert s.index.count() == 2 and s.search(["whales in"], "ann", k=5).count() == 1
    node = s.index.where("text LIKE 'blue%'").first().partition_id
    assert held(s.without_node("ann", node)).index.count() == 2
    assert held(s.without_node("bob", node)).index.count() == 1


def test_dispatch(spark):
    s, _ = fresh(spark).ingest(spark.createDataFrame([(1, "red apples grow")], "doc_id bigint, text string"), "ann", "ann-g")
    s = held(s)
    assert s.dispatch("stats").first().documents == 1
    assert s.dispatch("library", owner="ann").first().group_id == "ann-g"
    assert s.dispatch("nothing") is None
    s = s.dispatch("update_group", owner="ann", group_id="ann-g", label="New", access="available")
    assert s.dispatch("search", texts=["apples"], owner="bob", scope="global").count() == 1
    assert s.registry.groups.first().label == "New"


def test_names_metadata_tags_and_usage(spark):
    docs = spark.createDataFrame([(1, "red apples grow on tall trees", "A", bytearray(b"\x01"), ["fruit"]), (2, "blue whales swim in cold oceans", None, None, [])], "doc_id bigint, text string, name string, metadata binary, tags array<string>")
    s, out = fresh(spark).ingest(docs, "", "g", media_type="note", nobody="Node1")
    assert out.first().asDict() == {"skipped": 0, "linked": 0, "prepared": 2, "failed": 0, "success": True, "tokens": 12}
    s = held(s)
    rows = {r.name: r for r in s.info.collect()}
    assert rows["A"].metadata == b"\x01" and rows["A"].tags == ["fruit"] and rows["A"].media_type == "note" and len(rows["A"].tags_embedding) == 64
    assert rows[None].tags == ["blue", "cold", "oceans", "swim", "whales"]
    assert {r.owner_id for r in s.index.collect()} == {"node1"} and s.registry.groups.first().tags == ["blue", "cold", "fruit", "oceans", "swim", "whales"]
    # a new document takes the place of one that is to go
    old = next(r.document_id for r in s.info.collect() if r.name == "A")
    s = held(s.ingest(spark.createDataFrame([(3, "green pears grow on small trees")], "doc_id bigint, text string"), "node1", "g", remove=old)[0])
    assert old not in {r.document_id for r in s.index.collect()} | {r.document_id for r in s.info.collect()} | {r.document_id for r in s.registry.owner_document.collect()}
    assert s.info.count() == 2


def test_items_with_identifiers_of_the_caller(spark):
    items = spark.createDataFrame([("mine", 0, "red apples"), ("mine", 1, "blue whales"), ("other", 0, "red apples"), ("none", 0, "")], "document_id string, pos int, text string")
    s = held(fresh(spark).indexed(items, "Ann", "g"))
    assert sorted((r.document_id, r.pos, r.owner_id) for r in s.index.collect()) == [("mine", 0, "ann"), ("mine", 1, "ann"), ("other", 0, "ann")]
    s = held(s.indexed(items.where("document_id = 'mine' AND pos = 1"), "ann", "g"))
    assert sorted((r.document_id, r.pos) for r in s.index.collect()) == [("mine", 1), ("other", 0)]
    assert s.registry.owner_document.count() == 2


def test_answers_to_removals_and_updates(spark):
    items = spark.createDataFrame([("a", "red apples"), ("b", "blue whales"), ("c", "green pears")], "document_id string, text string")
    s = held(fresh(spark).indexed(items, "ann", "g"))
    s = held(s.indexed(items.where("document_id = 'b'"), "bob"))
    asked = spark.createDataFrame([("ann", "a"), ("ann", "b"), ("bob", "a"), ("bob", "zz")], "owner_id string, document_id string")
    got = {(r.owner_id, r.document_id): (r.authorised, r.fully_removed) for r in s.registry.removal(asked.where("owner_id = 'ann'")).collect()}
    assert got == {("ann", "a"): (True, True), ("ann", "b"): (True, False)}
    assert {(r.document_id, r.authorised) for r in s.registry.removal(asked.where("owner_id = 'bob'")).collect()} == {("a", False), ("zz", False)}
    after = held(s.removed("bob", asked.where("owner_id = 'bob'").select("document_id")))
    assert after.index.count() == 3
    assert not s.changed(s.updated_group("ann", "g"), "ann", "g") and s.changed(s.updated_group("ann", "g", label="New"), "ann", "g")
    assert not s.changed(s.updated_group("bob", "g", label="New"), "bob", "g") and s.changed(s.updated_document("ann", "a", access="available"), "ann", document_id="a")
    gone = held(s.dispatch("remove_all", owner="ann"))
    assert {r.document_id for r in gone.index.collect()} == {"b"} and gone.registry.groups.count() == 0
    part = Service(s.registry, s.index.where("document_id <> 'c'"), info=s.info)
    assert {r.document_id for r in part.cleaned().registry.owner_document.collect()} == {"a", "b"}


def test_embedding_service():
    import base64
    import json

    import numpy as np
    import pytest

    from lodestar.operators import ingest

    def send(url, body, headers):
        texts = json.loads(body)["input"]
        if texts == ["bad"]:
            return 500, b""
        rows = [{"index": i, "embedding": [float(len(t)), 1.0] if i % 2 else base64.b64encode(np.array([len(t), 1], "<f4").tobytes()).decode()} for i, t in enumerate(texts)]
        return 200, json.dumps({"data": rows[::-1]}).encode()

    run = ingest.http_embedder("http://localhost/v1/embeddings", send=send)
    assert run(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]]
    with pytest.raises(RuntimeError):
        run(["bad"])
