"""More named queries: the stored graph, upkeep of index and registry, ingest, maps and JSON. Registered with those of the catalogue."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import misc, text as T, vector as V
from lodestar.operators import graph, ingest, log, search
from lodestar.operators.index import Index, replayed
from lodestar.operators.registry import Registry, accumulated_partitions
from lodestar.plans.catalog import CID, EDGES, OWNED, OWNER, PUBLIC, QD, _search_sql, query, r6
from lodestar.plans.recovery import merged
from lodestar.plans.views import Views
from lodestar.sources.store import spooled

SHARD_TOP = f"SELECT query_id, shard_id, partition_id, document_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY d, partition_id) AS r FROM (SELECT query_id, shard_id, partition_id, document_id, {QD} AS d FROM v_node p, v_query q WHERE NOT is_deleted AND {{}})) WHERE r <= 10"
LIVE = "SELECT shard_id, max(level) AS max_level, count(*) AS live FROM v_node WHERE NOT is_deleted GROUP BY shard_id"


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "shard_id", F.explode("hits").alias("h")).select("query_id", "shard_id", "h.partition_id", "h.document_id", F.round("h.distance", 6).alias("distance"))


# --- the stored graph: shards of 125 nodes are searched whole by a breadth of 150, so the answers are exact -----------
@query(SHARD_TOP.format("true"))
def ann_graph(v: Views) -> DataFrame:
    return _hits(v.graph.search(v.queries(), 10))


@query(SHARD_TOP.format(f"({OWNED} OR {PUBLIC})"))
def ann_filtered(v: Views) -> DataFrame:
    """What may not be returned is walked through."""
    return _hits(v.graph.search(v.queries(), 10, search.scope_documents(v, OWNER, "global")))


@query(f"""SELECT query_id, n.shard_id, n.nodes, l.max_level, CASE WHEN query_id = 0 THEN 150 ELSE round(n.nodes * 1.5)::INT END AS ef, n.nodes AS explored, l.live AS found, round(n.nodes * 1.5)::INT AS next_ef
FROM v_query, (SELECT shard_id, count(*) AS nodes FROM v_node GROUP BY 1) n JOIN ({LIVE}) l USING (shard_id)""")
def ann_trace(v: Views) -> DataFrame:
    """The breadth follows what searches look at, here all of a shard."""
    return v.graph.search(v.queries(), 10).select("query_id", "shard_id", F.col("nodes").cast("long").alias("nodes"), "max_level", "ef", F.col("explored").cast("long").alias("explored"), F.col("found").cast("long").alias("found"), "next_ef")


@query(SHARD_TOP.format("true").replace("v_node p", "(SELECT * FROM v_node WHERE document_id % 9 <> 4) p"))
def ann_after_removal(v: Views) -> DataFrame:
    return _hits(v.graph.removed(v.document.where("document_id % 9 = 4")).search(v.queries(), 10))


@query(SHARD_TOP.format("true").replace("v_node p", "(SELECT partition_id, document_id, shard_id, embedding, is_deleted FROM v_node WHERE shard_id > 1 OR shard_id = 0 AND local_idx < 100 UNION ALL SELECT partition_id + 1000000, document_id + 1000000, 0, embedding, false FROM v_node WHERE shard_id = 1 AND local_idx < 60) p"))
def ann_after_insert(v: Views) -> DataFrame:
    """A graph of part of the nodes, into which a batch is inserted."""
    first = Index.build(v.node.where("shard_id > 1 OR shard_id = 0 AND local_idx < 100"))
    # links of shards that are touched and of those that aren't: built once for both
    first = replace(first, links=spooled(first.links))
    new = v.node.where("shard_id = 1 AND local_idx < 60").select(F.lit(0).alias("shard_id"), F.col("local_idx").alias("seq"), (F.col("partition_id") + 1000000).alias("partition_id"), (F.col("document_id") + 1000000).alias("document_id"), "level", "embedding")
    return _hits(first.inserted(new).search(v.queries(), 10))


@query("SELECT shard_id, count(*) AS nodes, count(*) FILTER (NOT is_deleted) AS live, max(level) FILTER (NOT is_deleted) AS max_level, arg_max(CASE WHEN shard_id = 1 THEN n ELSE local_idx END, level * 1000 - local_idx) FILTER (NOT is_deleted) AS entry FROM (SELECT *, (row_number() OVER (PARTITION BY shard_id ORDER BY local_idx) - 1)::INT AS n FROM v_node WHERE NOT is_deleted) GROUP BY shard_id")
def index_compact(v: Views) -> DataFrame:
    """Shard 1 is rewritten. Hubs keep neighbours above layer 0 wherever a level has two nodes, so none comes down here."""
    after = v.graph.compacted()
    n = after.nodes.groupBy("shard_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("is_deleted")).alias("live"))
    return n.join(after.states, "shard_id").select("shard_id", "nodes", "live", "max_level", "entry")


@query("""SELECT shard_id, local_idx, partition_id, document_id % 6 = 0 AND shard_id = 0 AS is_deleted FROM v_partition WHERE shard_id < 2
UNION ALL SELECT 1, (1000 + local_idx)::INT, partition_id, false FROM v_partition WHERE shard_id = 0 AND document_id % 6 = 0""")
def index_without_copies(v: Views) -> DataFrame:
    """Documents of shard 0 that are in shard 1 too stay there."""
    n = v.partition.where("shard_id < 2").withColumn("level", F.lit(0)).withColumn("is_deleted", F.lit(False)).drop("slot", "label")
    copies = n.where("shard_id = 0 AND document_id % 6 = 0").withColumn("shard_id", F.lit(1)).withColumn("local_idx", F.col("local_idx") + 1000)
    empty = v.spark.createDataFrame([], "shard_id int, entry int, max_level int, ef int, ema double")
    links = v.spark.createDataFrame([], "shard_id int, local_idx int, layer int, neighbours array<int>")
    return Index(n.unionByName(copies), links, empty).without_copies().nodes.select("shard_id", "local_idx", "partition_id", "is_deleted")


@query(EDGES + "SELECT shard_id, src, dst, pos::INT AS pos FROM edge WHERE pos <= 4")
def graph_prune(v: Views) -> DataFrame:
    return graph.prune(graph.knn_edges(v.node), 4).select("shard_id", "src", "dst", "pos")


RECORDS = """, b AS (SELECT shard_id, local_idx, partition_id, document_id FROM v_partition WHERE local_idx < 100),
n AS (SELECT *, local_idx < 100 AS old FROM v_partition)
"""


@query(RECORDS + """SELECT shard_id, local_idx, partition_id, partition_id % 7 = 0 AS is_deleted,
  CASE WHEN local_idx % 10 = 0 THEN (local_idx + 3)::VARCHAR WHEN old THEN '' ELSE (local_idx - 1)::VARCHAR END AS neighbours FROM n""")
def wal_replay_topology(v: Views) -> DataFrame:
    """A checkpoint of the first 100 nodes of each shard, and a log of the rest, in which every record is there twice."""
    old = v.partition.where("local_idx < 100").select("shard_id", "local_idx", "partition_id", "document_id", F.lit(0).alias("level"), F.lit(False).alias("is_deleted"))
    links = old.select("shard_id", "local_idx", F.lit(0).alias("layer"), F.array().cast("array<int>").alias("neighbours"))
    states = old.select("shard_id").distinct().select("shard_id", F.lit(0).alias("entry"), F.lit(0).alias("max_level"), F.lit(150).alias("ef"), F.lit(0.0).alias("ema"))
    p, none = v.partition, F.lit(None)

    def record(rows, seq, kind, neighbours=None):
        return rows.select(
            (seq * 10_000_000 + F.col("partition_id")).alias("seq"), "shard_id", F.lit(kind).alias("kind"), "local_idx", "partition_id", "document_id", F.lit(0).alias("level"), F.lit(0).alias("layer"),
            (F.array(F.col("local_idx") + neighbours) if neighbours else none.cast("array<int>")).cast("array<int>").alias("neighbours"),
        )

    records = record(p.where("local_idx >= 100"), 1, "insert", -1).unionByName(record(p.where("local_idx % 10 = 0"), 2, "link", 2)).unionByName(record(p.where("local_idx % 10 = 0"), 3, "link", 3)).unionByName(record(p.where("partition_id % 7 = 0"), 4, "delete"))
    again = records.withColumn("seq", F.col("seq") + 5_000_000)
    after = replayed(old, links, states, records.unionByName(again))
    near = F.array_join(F.col("neighbours").cast("array<string>"), ",")
    return after.nodes.join(after.links, ["shard_id", "local_idx"]).select("shard_id", "local_idx", "partition_id", "is_deleted", near.alias("neighbours"))


@query("SELECT document_id, CASE WHEN document_id < 4 THEN 2 ELSE 5 + (document_id - 4) // 10 END::INT AS shard_id FROM v_document")
def shard_route(v: Views) -> DataFrame:
    """Shard 2 of five has room for four documents, then new ones are made."""
    docs = v.partition.groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes")).withColumn("seq", F.col("document_id"))
    have = v.spark.createDataFrame([(0, 46), (1, 50), (2, 30), (3, 46), (4, 60)], "shard_id int, nodes int")
    return graph.fill(docs, 46, have)


@query(f", d AS (SELECT document_id FROM v_partition WHERE partition_id = 77) SELECT partition_id, document_id FROM v_partition WHERE document_id NOT IN (SELECT document_id FROM d)")
def index_remove_partition(v: Views) -> DataFrame:
    return ingest.remove_partition(v.partition, 77).select("partition_id", "document_id")


@query("SELECT partition_id, document_id, false AS fresh FROM v_partition WHERE document_id % 10 <> 3 UNION ALL SELECT partition_id + 500000, document_id, true FROM v_partition WHERE document_id % 10 = 3 AND slot < 2")
def index_put(v: Views) -> DataFrame:
    """Documents put again replace all they had."""
    old = v.partition.select("partition_id", "document_id", "embedding", F.lit(False).alias("fresh"))
    new = v.partition.where("document_id % 10 = 3 AND slot < 2").select((F.col("partition_id") + 500000).alias("partition_id"), "document_id", "embedding", F.lit(True).alias("fresh"))
    return ingest.put(old, new).select("partition_id", "document_id", "fresh")


@query("SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'have' ELSE 'loaded' END AS what FROM v_document WHERE document_id % 4 = 0 OR document_id % 6 <> 0")
def index_merge(v: Views) -> DataFrame:
    """Loaded indices of documents that are routed and not there yet."""
    d = v.document
    return merged(d.where("document_id % 6 <> 0"), d.where("document_id % 4 = 0").withColumn("what", F.lit("have")), d.withColumn("what", F.lit("loaded")))


RANKED = "abs(d - 0.9) + 0.01 * d"


@query(_search_sql(OWNED, False).replace("d < (SELECT max(threshold)", f"{RANKED} < (SELECT max(threshold)").replace("ORDER BY d, partition_id) AS position", f"ORDER BY {RANKED}, partition_id) AS position"))
def search_reranked(v: Views) -> DataFrame:
    hits = search.search(v, v.queries(), OWNER, bound=v.bound, rerank=lambda d: F.abs(d - 0.9) + 0.01 * d)
    return hits.select("query_id", "partition_id", "document_id", r6("distance"), "position")


# --- registry -----------------------------------------------------------------------
CLAIMS = """, c(seq, owner_id, document_id, group_id, access) AS (VALUES (1, 'owner_b', 900, 'fresh', 'available'), (2, 'owner_a', 901, 'fresh', 'restricted'), (3, 'owner_b', 902, 'fresh', NULL),
 (4, 'owner_a', 903, 'owner_3-g0', NULL), (5, 'owner_3', 904, 'owner_3-g0', NULL), (6, 'owner_a', 905, NULL, 'available'), (7, 'owner_a', 906, 'mine', NULL))"""


def _claims(v: Views) -> DataFrame:
    rows = [(1, "owner_b", 900, "fresh", "available"), (2, "owner_a", 901, "fresh", "restricted"), (3, "owner_b", 902, "fresh", None), (4, "owner_a", 903, "owner_3-g0", None), (5, "owner_3", 904, "owner_3-g0", None), (6, "owner_a", 905, None, "available"), (7, "owner_a", 906, "mine", None)]
    return v.spark.createDataFrame(rows, "seq int, owner_id string, document_id bigint, group_id string, access string").withColumn("label", F.col("group_id")).withColumn("tags", F.array(F.lit("t")))


@query(CLAIMS + """, h AS (SELECT group_id, arg_min(owner_id, seq) AS owner_id, coalesce(arg_min(coalesce(access, 'restricted'), seq), 'restricted') AS access FROM c WHERE group_id IS NOT NULL AND group_id NOT IN (SELECT group_id FROM v_group) GROUP BY 1
 UNION ALL SELECT group_id, owner_id, access FROM v_group)
SELECT c.owner_id, c.document_id, CASE WHEN h.owner_id = c.owner_id THEN c.group_id END AS group_id, CASE WHEN h.owner_id = c.owner_id THEN h.access ELSE 'restricted' END AS access FROM c LEFT JOIN h USING (group_id)""")
def register_claims(v: Views) -> DataFrame:
    """Two owners claim a new group in one batch; the first has it."""
    r = Registry.of(v).registered(_claims(v))
    new = r.owner_document.where("document_id >= 900 AND document_id < 1000").join(r.document_access, "document_id")
    there = _claims(v).select("owner_id", "document_id")
    return new.join(there, ["owner_id", "document_id"], "left_semi").select("owner_id", "document_id", "group_id", "access")


@query(f""", new AS (SELECT '{OWNER}' AS owner_id, document_id, 'owner_' || (document_id % 7) || '-g0' AS group_id FROM v_document WHERE document_id < 40),
ok AS (SELECT n.owner_id, n.document_id, CASE WHEN g.owner_id IS NULL OR g.owner_id = n.owner_id THEN n.group_id END AS group_id FROM new n LEFT JOIN v_group g USING (group_id))
SELECT owner_id, document_id, coalesce(d.group_id, ok.group_id) AS group_id FROM v_document_group d FULL JOIN ok USING (owner_id, document_id)""")
def link_owner(v: Views) -> DataFrame:
    new = v.document.where("document_id < 40").select(F.lit(OWNER).alias("owner_id"), "document_id", F.concat(F.lit("owner_"), (F.col("document_id") % 7).cast("string"), F.lit("-g0")).alias("group_id"))
    return Registry.of(v).linked(new).owner_document


@query(f"""SELECT group_id, CASE WHEN group_id = '{OWNER}-g1' THEN 'New' ELSE label END AS label, CASE WHEN group_id = '{OWNER}-g1' THEN 'what' END AS description FROM v_group WHERE group_id <> '{OWNER}-g2'""")
def group_update(v: Views) -> DataFrame:
    """An owner renames a group and deletes another; somebody else can't."""
    r = Registry.of(v).relabelled(OWNER, f"{OWNER}-g1", "New", "what").relabelled("owner_1", f"{OWNER}-g0", "Taken").relabelled(OWNER, f"{OWNER}-g0", "")
    return r.without_groups(OWNER, [f"{OWNER}-g2", "owner_1-g0"]).groups.select("group_id", "label", "description")


@query(f""", a AS (SELECT DISTINCT '{OWNER}' AS owner_id, document_id FROM v_document WHERE document_id < 50)
SELECT owner_id, document_id, o.document_id IS NOT NULL AS authorised, o.document_id IS NOT NULL AND (SELECT count(*) FROM v_owner_document x WHERE x.document_id = a.document_id) = 1 AS fully_removed
FROM a LEFT JOIN v_owner_document o USING (owner_id, document_id)""")
def removal_answers(v: Views) -> DataFrame:
    return Registry.of(v).removal(v.document.where("document_id < 50").select(F.lit(OWNER).alias("owner_id"), "document_id"))


@query(f"SELECT document_id, (SELECT count(*) FROM v_owner_document x WHERE x.document_id = o.document_id) = 1 AS fully_removed FROM v_owner_document o WHERE owner_id = '{OWNER}'")
def removal_of_all(v: Views) -> DataFrame:
    return Registry.of(v).owned(OWNER)


@query("SELECT owner_id, document_id FROM v_owner_document WHERE document_id % 5 <> 2")
def orphan_removal(v: Views) -> DataFrame:
    """Documents that aren't indexed leave the registry."""
    return Registry.of(v).cleaned(v.document.where("document_id % 5 <> 2")).owner_document.select("owner_id", "document_id")


@query("SELECT user_id AS document_id, event_type AS partition_id, count(*) AS retrievals, round(sum(value), 4) AS sentiment, max(ts) AS last_retrieved FROM events GROUP BY ALL", prefix=False)
def accumulate_partitions(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("partition_id"), F.lit(1).alias("retrievals"), F.col("value").alias("sentiment"), F.col("ts").alias("last_retrieved"), F.col("ts").alias("seq"))
    half = e.where("retrievals = 1 AND sentiment > 20"), e.where("NOT sentiment > 20")
    out = accumulated_partitions(*half)
    return out.select("document_id", "partition_id", "retrievals", F.round("sentiment", 4).alias("sentiment"), "last_retrieved")


# --- graph endpoints ----------------------------------------------------------------
def _endpoint(v: Views, documents: DataFrame | None, hubs: bool = False, live: bool = False) -> DataFrame:
    n = v.node if documents is None else v.node.join(documents, "document_id", "left_semi")
    n = n.where("level > 0") if hubs else n
    return (n.where("NOT is_deleted") if live else n).select("partition_id", "document_id", "level")


NODES = "SELECT partition_id, document_id, level FROM v_node p WHERE "


@query(NODES + f"{OWNED} AND document_id = 10")
def graph_document(v: Views) -> DataFrame:
    return _endpoint(v, search.scope_documents(v, OWNER, "personal").where("document_id = 10"))


@query(NODES + f"{OWNED} AND document_id IN (3, 10, 11)")
def graph_own_documents(v: Views) -> DataFrame:
    return _endpoint(v, search.scope_documents(v, OWNER, "personal").where("document_id IN (3, 10, 11)"))


@query(NODES + f"{OWNED} AND level > 0")
def graph_own_hubs(v: Views) -> DataFrame:
    return _endpoint(v, search.scope_documents(v, OWNER, "personal"), hubs=True)


@query(NODES + f"({OWNED} OR {PUBLIC}) AND level > 0 AND NOT is_deleted")
def graph_global_hubs(v: Views) -> DataFrame:
    return _endpoint(v, search.scope_documents(v, OWNER, "global"), hubs=True, live=True)


@query(NODES + "document_id % 4 = 1")
def graph_documents(v: Views) -> DataFrame:
    return _endpoint(v, v.document.where("document_id % 4 = 1"))


@query(NODES + "document_id % 4 = 1 AND level > 0")
def graph_documents_hubs(v: Views) -> DataFrame:
    return _endpoint(v, v.document.where("document_id % 4 = 1"), hubs=True)


# --- maps, JSON, requests -----------------------------------------------------------
COUNTS = "a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE NOT value > 20 GROUP BY ALL)"


@query(f"WITH {COUNTS} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) + coalesce(b.n, 0) AS added, coalesce(a.n, b.n) AS first FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type", prefix=False)
def map_merges(v: Views) -> DataFrame:
    """Two maps of each user, added up and united with the first one's values winning."""
    e = v.table("events")

    def counts(rows, name):
        n = rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name))

    both = counts(e.where("value > 20"), "a").join(counts(e.where("NOT value > 20"), "b"), "user_id", "full")
    none = F.create_map().cast("map<string,bigint>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    added = both.select("user_id", F.explode(misc.merge_sum(a, b)).alias("event_type", "added"), misc.merge_first(a, b).alias("m"))
    return added.select("user_id", "event_type", "added", F.element_at("m", F.col("event_type")).alias("first"))


@query("SELECT event_type, user_id, min(value) AS least, array_to_string([event_type], ',') AS members FROM events GROUP BY ALL", prefix=False)
def map_pairs(v: Views) -> DataFrame:
    least = misc.least_by(v.table("events"), ["event_type", "user_id"], "value")
    sets = misc.values_as_sets(F.create_map(F.col("user_id").cast("string"), F.col("event_type")))
    return least.select("event_type", "user_id", F.col("value").alias("least"), F.array_join(F.element_at(sets, F.col("user_id").cast("string")), ",").alias("members"))


@query("""SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS body, 'kind=' || event_type || '%20%26%20more&user=' || user_id AS items,
'data: {"event_kind":"' || event_type || '","user_id":' || user_id || '}' || chr(10) || chr(10) AS line FROM events""", prefix=False)
def request_encoding(v: Views) -> DataFrame:
    fields = {"user": F.col("user_id"), "kind": F.col("event_type"), "none": F.lit(None).cast("string")}
    more = {"user": F.col("user_id"), "kind": F.concat("event_type", F.lit(" & more")), "none": F.lit(None).cast("string")}
    payload = F.struct(F.col("user_id").alias("userId"), F.col("event_type").alias("eventKind"))
    return v.table("events").select("event_id", misc.request_body(fields).alias("body"), misc.query_items(more).alias("items"), misc.event_line(payload, ["userId", "eventKind"]).alias("line"))


@query("""SELECT event_id, 'owner_' || (user_id % 7) AS owner_id, CASE WHEN event_id % 2 = 0 THEN 'global' ELSE 'personal' END AS scope, event_id % 3 = 0 AS aggregate, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS tags,
CASE WHEN event_id % 4 = 0 THEN 'a,b' ELSE event_type END AS inputs, (CASE event_id % 3 WHEN 0 THEN 2.5 * user_id WHEN 1 THEN 3.0 END)::DOUBLE AS vector FROM events""", prefix=False)
def request_decoding(v: Views) -> DataFrame:
    e, i = v.table("events"), F.col("event_id")
    part = lambda when, text: F.when(when, text).otherwise("")
    body = F.concat(F.lit('{"owner_id":"OWNER_'), (F.col("user_id") % 7).cast("string"), F.lit('"'), part(i % 2 == 0, ',"scope":"global"'), part(i % 3 == 0, ',"aggregate":true'), part(i % 5 == 0, ',"tags":["x","y"]'), F.lit("}"))
    r = misc.parse_request(body)
    inputs = misc.parse_inputs(F.when(i % 4 == 0, F.lit('["a","b"]')).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    u = F.col("user_id").cast("string")
    vector = misc.parse_vector(F.when(i % 3 == 0, F.concat(F.lit("["), u, F.lit(","), u, F.lit(".0,"), (F.col("user_id") / 2).cast("string"), F.lit("]"))).when(i % 3 == 1, F.lit('"AACAPwAAAEA="')).otherwise(F.lit('"no base64"')))
    rows = e.select("event_id", r.alias("r"), inputs.alias("inputs"), vector.alias("vector"))
    total = F.when(F.col("vector").isNotNull(), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")))
    return rows.select("event_id", "r.owner_id", "r.scope", "r.aggregate", F.size("r.tags").alias("tags"), F.array_join("inputs", ",").alias("inputs"), total.alias("vector"))


# --- text ---------------------------------------------------------------------------
def _pack_sql(parts: str, joint: str, limit: int) -> str:
    """Greedy packing of a list of texts, as a fold over structs."""
    start = "{'o': []::VARCHAR[], 'b': ''}"
    step = f"lambda a, x: CASE WHEN a.b = '' THEN {{'o': a.o, 'b': x.b}} WHEN length(a.b) + length({joint}) + length(x.b) <= {limit} THEN {{'o': a.o, 'b': a.b || {joint} || x.b}} ELSE {{'o': list_append(a.o, a.b), 'b': x.b}} END"
    return f"(SELECT CASE WHEN r.b = '' THEN r.o ELSE list_append(r.o, r.b) END FROM (SELECT list_reduce(list_transform({parts}, lambda x: {{'o': []::VARCHAR[], 'b': x}}), {step}, {start}) AS r))"


def _trim_sql(t: str) -> str:
    return f"regexp_replace({t}, '^[\\p{{Z}}\\s]+|[\\p{{Z}}\\s]+$', '', 'g')"


def _chunks_sql(clean: str, limit: int = T.MAX_CHARS) -> str:
    """WITH-list that ends in chunked(doc_id, chunks), from a query of (doc_id, clean)."""
    mark = "chr(1)"
    return f"""clean AS ({clean}),
par AS (SELECT doc_id, i, p FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(clean, chr(10) || chr(10)), lambda x: {_trim_sql('x')}), lambda x: x <> '') AS ps FROM clean))),
sen AS (SELECT doc_id, i, list_filter(list_transform(string_split(regexp_replace(p, '\\.([ \\n])', '.' || {mark} || '\\1', 'g'), {mark}), lambda x: {_trim_sql('x')}), lambda x: x <> '') AS s FROM par WHERE length(p) > {limit}),
cut AS (SELECT doc_id, i, flatten(list_transform(s, lambda x: list_transform(range(0, ((length(x) + {limit - 1}) // {limit})::BIGINT), lambda k: substring(x, (k * {limit} + 1)::INT, {limit})))) AS s FROM sen),
seg AS (SELECT doc_id, i, [p] AS s FROM par WHERE length(p) <= {limit} UNION ALL SELECT doc_id, i, {_pack_sql('s', "' '", limit)} FROM cut),
flat AS (SELECT doc_id, flatten(list(s ORDER BY i)) AS s FROM seg GROUP BY doc_id),
chunked AS (SELECT doc_id, {_pack_sql('s', 'chr(10) || chr(10)', limit)} AS chunks FROM flat)"""


def chunk_sql() -> str:
    from lodestar.plans.catalog import ORACLE_SQL

    return _chunks_sql(ORACLE_SQL["sanitize_text"])


@query(f"WITH {chunk_sql()} SELECT doc_id, (unnest(range(1, len(chunks) + 1)) - 1)::INT AS pos, unnest(chunks) AS chunk FROM chunked", prefix=False)
def doc_chunks(v: Views) -> DataFrame:
    return ingest.chunks(v.table("documents"))


@query(f"WITH {CID}, {chunk_sql()} SELECT content_id AS document_id, max(len(chunks)) AS partitions, 'owner_1' AS owner_id FROM cid JOIN chunked USING (doc_id) GROUP BY content_id", prefix=False)
def ingest_documents(v: Views) -> DataFrame:
    """Documents as they are put: inputs with one identity are one document, a partition for each place."""
    return ingest.prepared(v.table("documents"), "Owner_1").groupBy("document_id", "owner_id").agg(F.count(F.lit(1)).alias("partitions"))


@query("SELECT source, sum(len(string_split_regex(trim(text), '\\s+')))::BIGINT AS tokens FROM documents WHERE trim(text) <> '' GROUP BY source", prefix=False)
def ingest_usage(v: Views) -> DataFrame:
    return v.table("documents").where("trim(text) <> ''").groupBy("source").agg(ingest.usage(F.col("text")).alias("tokens"))


def _entities_sql() -> str:
    from lodestar.plans.catalog import ORACLE_SQL

    sql = ORACLE_SQL["html_extract"]
    # the named entities are decoded inside the last two steps about white space; numbers come between
    inner = sql[sql.index("coalesce(nullif(") + len("coalesce(nullif(") : sql.index(", ''), html)")]
    head, tail = "regexp_replace(regexp_replace(regexp_replace(", inner.index(", '[ \\t]+', ' ', 'g')")
    named = inner[len(head) : tail]
    rest = inner[tail:]
    point = lambda c, base: f"CASE WHEN length({c}) < 8 AND {base} BETWEEN 1 AND 1114111 AND NOT {base} BETWEEN 55296 AND 57343 THEN chr({base}::INT) END"
    decimal = "list_reduce(list_distinct(regexp_extract_all(t, '&#([0-9]+);', 1)), lambda a, c: replace(a, '&#' || c || ';', coalesce(" + point("c", "try_cast(c AS BIGINT)") + ", '&#' || c || ';')), t)"
    hexed = "list_reduce(list_distinct(regexp_extract_all(t, '&#x([0-9a-fA-F]+);', 1)), lambda a, c: replace(a, '&#x' || c || ';', coalesce(" + point("c", "try_cast('0x' || c AS BIGINT)") + ", '&#x' || c || ';')), t)"
    return f"WITH n AS (SELECT page_id, html, {named} AS t FROM pages), d AS (SELECT page_id, html, {decimal} AS t FROM n), h AS (SELECT page_id, html, {hexed} AS t FROM d) SELECT page_id, coalesce(nullif({head}t{rest}, ''), html) AS body FROM h"


@query(_entities_sql(), prefix=False)
def html_extract_full(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("""WITH j AS (SELECT event_id AS seq, user_id % 4 AS lane, event_type AS o, event_type <> 'error' AS put FROM events),
l AS (SELECT lane, list({'o': []::STRUCT(f BIGINT, l BIGINT, o VARCHAR, n BIGINT)[], 'f': seq, 'l': seq, 'w': o, 'p': put, 'n': 1::BIGINT} ORDER BY seq) AS s FROM j GROUP BY lane),
r AS (SELECT lane, list_reduce(s, lambda a, x: CASE WHEN a.p AND x.p AND a.w = x.w AND a.n < 2 THEN {'o': a.o, 'f': a.f, 'l': x.l, 'w': a.w, 'p': true, 'n': a.n + x.n}
 ELSE {'o': list_append(a.o, {'f': a.f, 'l': a.l, 'o': a.w, 'n': a.n}), 'f': x.f, 'l': x.l, 'w': x.w, 'p': x.p, 'n': x.n} END) AS r FROM l),
b AS (SELECT lane, unnest(list_append(r.o, {'f': r.f, 'l': r.l, 'o': r.w, 'n': r.n})) AS b FROM r)
SELECT lane, b.f AS first, b.l AS last, b.o AS owner_id, 'g' AS group_id, b.n AS items FROM b""", prefix=False)  # fmt: skip
def queue_coalesce_capped(v: Views) -> DataFrame:
    from lodestar.plans.catalog import _jobs

    return log.capped(_jobs(v), "lane", 2)


@query("SELECT event_id, user_id, upper(event_type) AS kind, unnest([value, -value]) AS signed FROM events WHERE value > 10 AND event_type <> 'error'", prefix=False)
def stream_operators(v: Views) -> DataFrame:
    """Map, filter and flat-map, which are the same on a stream of micro-batches."""
    rows = v.table("events").where("value > 10 AND event_type <> 'error'")
    return rows.select("event_id", "user_id", F.upper("event_type").alias("kind"), F.explode(F.array("value", -F.col("value"))).alias("signed"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean, coalesce(try_cast(event_type AS INT), -1) AS fallback FROM events", prefix=False)
def stream_fallbacks(v: Views) -> DataFrame:
    """A value that can't be computed gives way to another, as a stream that fails does to its replacement."""
    from lodestar.streaming.queue import recovered

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    rows = v.table("events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("mean"), "event_type")
    return recovered(rows, F.col("event_type").try_cast("int"), F.lit(-1), "fallback").drop("event_type")


@query("SELECT partition_id, round(ema, 9) AS ema FROM (SELECT partition_id, CASE WHEN partition_id = 0 THEN partition_id::DOUBLE ELSE 0.85 * (partition_id - 1) + 0.15 * partition_id END AS ema FROM v_partition)")
def moving_average(v: Views) -> DataFrame:
    before = F.when(F.col("partition_id") > 0, (F.col("partition_id") - 1).cast("double"))
    value = F.col("partition_id").cast("double")
    ema = F.when(F.col("partition_id") == 1, 0.15 * value).otherwise(search.average(before, value, 0.15))
    return v.partition.select("partition_id", F.round(ema, 9).alias("ema"))


@query("SELECT event_id, '[' || left(event_type, 2) || ']' AS shown, length(event_type) + 200 AS cut FROM events", prefix=False)
def previews(v: Views) -> DataFrame:
    long = F.concat("event_type", F.repeat(F.lit("x"), 200))
    return v.table("events").select("event_id", F.concat(F.lit("["), F.substring(T.preview(long), 1, 2), F.lit("]")).alias("shown"), F.length(T.preview(long, full=True)).alias("cut"))


@query("SELECT partition_id, least(floor(-ln((('0x' || md5(partition_id::VARCHAR)[1:8])::BIGINT + 1) / 4294967297.0::DOUBLE) / ln(16)), greatest(1, floor(ln(greatest(2, document_id)) / ln(16)) + 2))::INT AS level FROM v_partition")
def hub_levels(v: Views) -> DataFrame:
    return v.partition.select("partition_id", V.hashed_level(F.col("partition_id"), F.col("document_id")).alias("level"))
