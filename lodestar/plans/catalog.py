"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import misc, text as T, vector as V
from lodestar.operators import graph, ingest, log, quantize, search
from lodestar.operators.registry import Registry, accumulated
from lodestar.plans.views import PREFIX, Views, dot_sql, l2_sql
from lodestar.sources.store import spooled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OWNER, BOOK, WIDTH = "owner_3", 8, 4


def query(sql: str | None = None, prefix: bool = True, name: str | None = None):
    """Register a function of Views under its name, with its SQL."""

    def add(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            if not prefix:
                ORACLE_SQL[key] = sql
            elif sql.lstrip().startswith(","):
                ORACLE_SQL[key] = PREFIX + sql
            else:
                ORACLE_SQL[key] = PREFIX + " " + sql
        return f

    return add


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --- vectors ------------------------------------------------------------------------
QD = l2_sql("q.query", "p.embedding")


@query(f"SELECT p.partition_id, round({QD}, 6) AS distance FROM v_partition p, v_query q WHERE q.query_id = 0 ORDER BY {QD}, p.partition_id LIMIT 10")
def knn_exact(v: Views) -> DataFrame:
    d = V.squared_l2(F.col("query"), F.col("embedding")).alias("distance")
    rows = v.partition.crossJoin(F.broadcast(v.queries().where("query_id = 0"))).select("partition_id", d)
    return rows.orderBy("distance", "partition_id").limit(10).select("partition_id", r6("distance"))


@query(f"SELECT query_id, partition_id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, partition_id) AS rank FROM (SELECT query_id, partition_id, {QD} AS d FROM v_partition p, v_query q)) WHERE rank <= 10")
def knn_exact_multi(v: Views) -> DataFrame:
    return search.candidates(v.partition, v.queries(), 10).select("query_id", "partition_id", r6("distance"), "rank")


def _scoped_sql(where: str) -> str:
    return f"SELECT query_id, partition_id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, partition_id) AS rank FROM (SELECT query_id, partition_id, {QD} AS d FROM v_partition p, v_query q WHERE {where})) WHERE rank <= 10"


def _scoped(v: Views, **scope) -> DataFrame:
    seen = search.scope_documents(v, OWNER, **scope)
    return search.candidates(v.partition.join(seen, "document_id", "left_semi"), v.queries(), 10).select("query_id", "partition_id", r6("distance"), "rank")


OWNED = f"p.document_id IN (SELECT document_id FROM v_owner_document WHERE owner_id = '{OWNER}')"
PUBLIC = "p.document_id IN (SELECT document_id FROM v_document_access WHERE access = 'available')"


@query(_scoped_sql(OWNED))
def knn_filtered_owner(v: Views) -> DataFrame:
    return _scoped(v, scope="personal")


@query(_scoped_sql(f"{OWNED} AND p.document_id IN (SELECT document_id FROM v_document_group WHERE group_id IN ('{OWNER}-g0', '{OWNER}-g2'))"))
def knn_filtered_group(v: Views) -> DataFrame:
    return _scoped(v, scope="personal", groups=[f"{OWNER}-g0", f"{OWNER}-g2"])


@query(_scoped_sql(f"({OWNED} OR {PUBLIC})"))
def knn_filtered_global(v: Views) -> DataFrame:
    return _scoped(v, scope="global")


@query(f"SELECT query_id, shard_id, partition_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY d, partition_id) AS rank FROM (SELECT query_id, shard_id, partition_id, {QD} AS d FROM v_partition p, v_query q)) WHERE rank <= 30")
def shard_topk_merge(v: Views) -> DataFrame:
    return search.candidates(v.partition, v.queries(), search.PER_SHARD, ("shard_id",)).select("query_id", "shard_id", "partition_id", r6("distance"))


@query("SELECT shard_id, round(threshold, 6) AS threshold FROM v_threshold")
def shard_threshold(v: Views) -> DataFrame:
    return v.thresholds.select("shard_id", r6("threshold"))


def _search_sql(where: str, boost: bool, columns: str = "query_id, partition_id, document_id, round(d, 6) AS distance, position::INT AS position") -> str:
    key = f"CASE WHEN {OWNED.replace('p.', 'n.')} AND NOT {PUBLIC.replace('p.', 'n.')} THEN n.norm * 0.9 ELSE n.norm END" if boost else "n.norm"
    return f""", c AS (SELECT query_id, shard_id, partition_id, document_id, {QD} AS d FROM v_partition p, v_query q WHERE {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY d, partition_id) AS r FROM c),
n AS (SELECT t.*, CASE WHEN threshold > 0 THEN d / threshold ELSE d END AS norm FROM t LEFT JOIN v_threshold USING (shard_id) WHERE r <= 30),
pool AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY {key}, partition_id) AS place FROM n) WHERE place <= 9),
cut AS (SELECT *, (SELECT max(threshold) FROM v_threshold) AS threshold, d < (SELECT max(threshold) FROM v_threshold) AS keep FROM pool),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, partition_id) AS position FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_keep FROM cut) WHERE keep OR NOT any_keep)
SELECT {columns} FROM res"""


@query(_search_sql(OWNED, False))
def search_personal(v: Views) -> DataFrame:
    return search.search(v, v.queries(), OWNER, bound=v.bound).select("query_id", "partition_id", "document_id", r6("distance"), "position")


@query(_search_sql(f"({OWNED} OR {PUBLIC})", True))
def search_global(v: Views) -> DataFrame:
    return search.search(v, v.queries(), OWNER, "global", bound=v.bound).select("query_id", "partition_id", "document_id", r6("distance"), "position")


@query(_search_sql(f"({OWNED} OR {PUBLIC}) AND NOT (p.shard_id = 1 AND p.partition_id % 2 = 0)", True))
def remove_then_search(v: Views) -> DataFrame:
    live = v.node.where("NOT is_deleted")
    return search.search(v, v.queries(), OWNER, "global", bound=v.bound, live=live).select("query_id", "partition_id", "document_id", r6("distance"), "position")


@query(_search_sql(OWNED, False, "query_id, partition_id, round(d, 6) AS distance, round(d * (1 + (partition_id % 3 - 1) * 0.1), 6) AS adjusted, round(CASE WHEN d > 0 THEN d * (1 + (partition_id % 3 - 1) * 0.1) / d ELSE 1 END, 6) AS factor, "
       "CASE WHEN d * (1 + (partition_id % 3 - 1) * 0.1) >= threshold THEN 'dropped' WHEN d = 0 THEN 'unchanged' WHEN partition_id % 3 = 0 THEN 'boosted' WHEN partition_id % 3 = 2 THEN 'demoted' ELSE 'unchanged' END AS status"))  # fmt: skip
def adjustment_report(v: Views) -> DataFrame:
    hits = search.search(v, v.queries(), OWNER, bound=v.bound).withColumn("adjusted", F.col("distance") * (1 + (F.col("partition_id") % 3 - 1) * 0.1))
    return search.adjustments(hits).select("query_id", "partition_id", r6("distance"), r6("adjusted"), r6("factor"), "status")


@query(_search_sql(OWNED, False, "query_id, partition_id, position::INT AS position, left(x.text, 200) AS preview").replace("FROM res", "FROM res LEFT JOIN documents x ON x.doc_id = res.partition_id"))
def search_late_materialise(v: Views) -> DataFrame:
    hits = search.search(v, v.queries(), OWNER, bound=v.bound).select("query_id", "partition_id", "position")
    content = v.table("documents").select(F.col("doc_id").alias("partition_id"), T.preview(F.col("text")).alias("preview"))
    return search.materialise(hits, content).select("query_id", "partition_id", "position", "preview")


@query(f""", d AS (SELECT query_id, partition_id, {QD} AS d FROM v_partition p, v_query q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, partition_id) AS r FROM d),
k AS (SELECT *, d < 0.5 + query_id % 3 AS keep FROM t WHERE r BETWEEN 2 AND 9), c AS (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_keep FROM k)
SELECT query_id, partition_id, round(d, 6) AS distance FROM c WHERE keep OR NOT any_keep""")  # fmt: skip
def search_fallback_cut(v: Views) -> DataFrame:
    rows = search.candidates(v.partition, v.queries(), 9).where("rank >= 2")
    return search.cut(rows, ["query_id"], F.col("distance"), 0.5 + F.col("query_id") % 3).select("query_id", "partition_id", r6("distance"))


TD = dot_sql("t.tags_embedding", "q.query")


@query(f"SELECT query_id, document_id, round(1 - {TD}, 6) + 0.0 AS distance FROM v_tags t, v_query q WHERE t.tags_embedding IS NULL OR 1 - {TD} < 0.85")
def tag_distance_filter(v: Views) -> DataFrame:
    d = V.tag_distance(F.col("tags_embedding"), F.col("query"))
    rows = search.tag_filter(v.tags.crossJoin(F.broadcast(v.queries())), F.col("query"))
    return rows.select("query_id", "document_id", F.round(d, 6).alias("distance"))


@query(_search_sql(f"{OWNED} AND p.document_id IN (SELECT document_id FROM v_tags t WHERE t.tags_embedding IS NULL OR 1 - {dot_sql('t.tags_embedding', '(SELECT query FROM v_query WHERE query_id = 5)')} < 0.85)", False))
def search_tagged(v: Views) -> DataFrame:
    tag = [float(x) for x in v.queries().where("query_id = 5").first()["query"]]
    return search.search(v, v.queries(), OWNER, bound=v.bound, tags=F.array(*map(F.lit, tag))).select("query_id", "partition_id", "document_id", r6("distance"), "position")


@query(f"SELECT label, count(*) AS n, round(avg({l2_sql('p.embedding', 'q.query')}), 6) AS mean_distance FROM v_partition p, v_query q GROUP BY label")
def label_distance(v: Views) -> DataFrame:
    rows = v.partition.crossJoin(F.broadcast(v.queries())).withColumn("d", V.squared_l2(F.col("embedding"), F.col("query")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_distance"))


# --- quantization -------------------------------------------------------------------
PQ = f""", sub AS (SELECT partition_id, document_id, s AS sub, embedding[s * {WIDTH} + 1:s * {WIDTH} + {WIDTH}] AS part FROM v_partition, range(0, 16) t(s)),
book AS (SELECT sub, partition_id AS code, part AS centroid FROM sub WHERE partition_id < {BOOK}),
near AS (SELECT partition_id, document_id, sub, arg_min(code, {{'d': d, 'code': code}}) AS code, min(d) AS d FROM (SELECT s.partition_id, s.document_id, s.sub, b.code, {l2_sql('s.part', 'b.centroid')} AS d FROM sub s JOIN book b USING (sub)) GROUP BY ALL),
lut AS (SELECT query_id, sub, code, sqrt({l2_sql(f'query[sub * {WIDTH} + 1:sub * {WIDTH} + {WIDTH}]', 'centroid')}) AS d FROM v_query, book),
adc AS (SELECT query_id, partition_id, document_id, sum(lut.d) AS distance FROM near JOIN lut USING (sub, code) GROUP BY ALL)
"""


def _pq(v: Views):
    book = quantize.first_codebook(v.partition, BOOK, WIDTH)
    codes = quantize.encode(v.partition, book, WIDTH)
    return book, codes


def _adc(v: Views) -> DataFrame:
    book, codes = _pq(v)
    return quantize.asymmetric(codes, quantize.lookup_table(v.queries(), book, WIDTH))


@query("SELECT source, count(*) AS n, (CASE WHEN count(*) < 78 THEN 2 ELSE least(65536, pow(2, floor(log2(count(*) // 39)))) END)::INT AS k FROM documents GROUP BY source")
def pq_codebook_size(v: Views) -> DataFrame:
    return v.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("k", V.codebook_size(F.col("n")))


@query(PQ + "SELECT partition_id, array_to_string(list(code ORDER BY sub), ',') AS codes FROM near GROUP BY partition_id")
def pq_encode(v: Views) -> DataFrame:
    return _pq(v)[1].select("partition_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(PQ + "SELECT query_id, partition_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), partition_id) AS r FROM adc) WHERE r <= 20")
def pq_adc_topk(v: Views) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("distance", 9), "partition_id"))
    return _adc(v).withColumn("r", rank).where("r <= 20").select("query_id", "partition_id", r6("distance"))


@query(PQ + "SELECT round(greatest(avg(e) + 1.5 * stddev_pop(e), 8.0), 6) AS threshold FROM (SELECT partition_id, sum(sqrt(d)) AS e FROM near GROUP BY 1)")
def pq_threshold(v: Views) -> DataFrame:
    book, codes = _pq(v)
    return quantize.threshold(v.partition, codes, book, WIDTH).select(r6("threshold"))


@query(PQ + f"SELECT query_id, document_id, partition_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(distance, 9), partition_id) AS r FROM adc p WHERE {OWNED}) WHERE r <= 3")
def search_linear_scan(v: Views) -> DataFrame:
    seen = search.scope_documents(v, OWNER, "personal")
    rows = _adc(v).join(v.partition.select("partition_id", "document_id"), "partition_id").join(seen, "document_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.round("distance", 9), "partition_id"))
    return rows.withColumn("r", rank).where("r <= 3").select("query_id", "document_id", "partition_id", r6("distance"))


@query(PQ + """, hit AS (SELECT DISTINCT query_id, group_id FROM v_query, v_document_group WHERE (document_id + query_id) % 23 = 0),
w AS (SELECT a.query_id, m.group_id, a.partition_id, round(a.distance, 9) AS distance FROM adc a JOIN (SELECT DISTINCT group_id, document_id FROM v_document_group) m USING (document_id)
  WHERE document_id IN (SELECT document_id FROM v_document_access WHERE access = 'available') AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = a.query_id AND h.group_id = m.group_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY distance, partition_id) AS r FROM w), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_id) AS n FROM b WHERE r = 1)
SELECT query_id, group_id, partition_id, round(distance, 6) AS distance FROM g WHERE n <= 3""")  # fmt: skip
def diversity_floor(v: Views) -> DataFrame:
    adc = _adc(v).join(v.partition.select("partition_id", "document_id"), "partition_id").withColumn("distance", F.round("distance", 9))
    hit = v.document_group.crossJoin(F.broadcast(v.queries().select("query_id"))).where("(document_id + query_id) % 23 = 0").select("query_id", "group_id").distinct()
    return quantize.diversity_floor(adc, hit, v, 3).select("query_id", "group_id", "partition_id", r6("distance"))


@query(PQ + f""", c AS (SELECT query_id, shard_id, partition_id, document_id, {QD} AS d FROM v_partition p, v_query q WHERE ({OWNED} OR {PUBLIC})),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY d, partition_id) AS r FROM c),
n AS (SELECT t.query_id, t.partition_id, t.document_id, d, CASE WHEN threshold > 0 THEN d / threshold ELSE d END AS norm FROM t LEFT JOIN v_threshold USING (shard_id) WHERE r <= 2),
hit AS (SELECT DISTINCT query_id, group_id FROM n JOIN v_document_group USING (document_id)),
w AS (SELECT a.query_id, m.group_id, a.partition_id, a.document_id, round(a.distance, 9) AS distance FROM adc a JOIN (SELECT DISTINCT group_id, document_id FROM v_document_group) m USING (document_id)
  WHERE document_id IN (SELECT document_id FROM v_document_access WHERE access = 'available') AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = a.query_id AND h.group_id = m.group_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY distance, partition_id) AS r FROM w) WHERE r = 1),
u AS (SELECT *, CASE WHEN query_id IN (SELECT query_id FROM g) THEN norm WHEN {OWNED.replace('p.', 'n.')} AND NOT {PUBLIC.replace('p.', 'n.')} THEN norm * 0.9 ELSE norm END AS k FROM n
  UNION ALL SELECT query_id, partition_id, document_id, distance, distance, distance FROM g WHERE n <= 3),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, partition_id) AS place FROM u) WHERE place <= 9),
z AS (SELECT *, d < (SELECT max(threshold) FROM v_threshold) AS keep FROM pool)
SELECT query_id, partition_id, document_id, round(d, 6) AS distance FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_keep FROM z) WHERE keep OR NOT any_keep""")  # fmt: skip
def search_global_diverse(v: Views) -> DataFrame:
    adc = _adc(v).join(v.partition.select("partition_id", "document_id"), "partition_id").withColumn("distance", F.round("distance", 9))
    return search.search(v, v.queries(), OWNER, "global", bound=v.bound, adc=adc, per_shard=2).select("query_id", "partition_id", "document_id", r6("distance"))


@query()
def pq_train_kmeans(v: Views) -> DataFrame:
    return quantize.train(v.partition, "shard_id", WIDTH)


@query()
def ann_ivf(v: Views) -> DataFrame:
    return graph.ivf(v.partition, v.queries(), 10, 16, 12)


@query()
def graph_layers(v: Views) -> DataFrame:
    return graph.graph_edges(v.node)


# --- text ---------------------------------------------------------------------------
STOP = ", ".join(f"'{w}'" for w in T.TAG_STOP_WORDS)
ID_STOP = ", ".join(f"'{w}'" for w in T.ID_STOP_WORDS)
TAGS = f"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ({STOP}) GROUP BY ALL),
tags AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10)"""


@query(f"WITH {TAGS} SELECT doc_id, rank::INT AS rank, word, n FROM tags", prefix=False)
def doc_tags(v: Views) -> DataFrame:
    return ingest.tags(v.table("documents")).select("doc_id", "rank", "word", "n")


@query(f"WITH {TAGS} SELECT source, array_to_string(list_sort(list(DISTINCT word)), ' ') AS tags FROM tags JOIN documents USING (doc_id) WHERE rank <= 2 GROUP BY source", prefix=False)
def group_tag_union(v: Views) -> DataFrame:
    docs = v.table("documents")
    two = ingest.tags(docs).where("rank <= 2").groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    rows = docs.select("doc_id", "source").join(two, "doc_id")
    return ingest.tag_union(rows, "source", "words").select("source", T.tag_string(F.col("tags")).alias("tags"))


CID = f"""w AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(lower(text), '[\\p{{Z}}\\n-\\r\\x{{85}}\\t]+')), '^\\p{{P}}+|\\p{{P}}+$', '', 'g') AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ({ID_STOP}) GROUP BY ALL),
s AS (SELECT doc_id, array_to_string(list_sort(list(word)), ' ') AS signature FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM c) WHERE r <= 10 GROUP BY doc_id),
h AS (SELECT d.doc_id, coalesce(signature, '') AS signature, sha256(coalesce(signature, '')) AS x FROM documents d LEFT JOIN s USING (doc_id)),
cid AS (SELECT doc_id, signature, array_to_string(list_transform(range(1, 64, 2), lambda i: lpad(('0x' || x[i:i + 1])::INT::VARCHAR, greatest(2, length(('0x' || x[i:i + 1])::INT::VARCHAR))::INT, '0')), '') AS content_id FROM h)"""


@query(f"WITH {CID} SELECT doc_id, signature, content_id FROM cid", prefix=False)
def doc_content_id(v: Views) -> DataFrame:
    return ingest.content_ids(v.table("documents"))


@query(f"""WITH {CID}, i AS (SELECT content_id, 'owner_' || (doc_id % 3) AS owner_id, CASE WHEN doc_id % 4 > 0 THEN 'g' || (doc_id % 2) END AS group_id, doc_id FROM cid),
n AS (SELECT DISTINCT content_id FROM i WHERE doc_id % 5 < 2), l AS (SELECT DISTINCT content_id, owner_id, 'g' || (doc_id % 2) AS group_id FROM i WHERE doc_id % 5 = 0)
SELECT doc_id, CASE WHEN content_id NOT IN (SELECT content_id FROM n) THEN 'index'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.content_id = i.content_id AND l.owner_id = i.owner_id AND (i.group_id IS NULL OR l.group_id = i.group_id)) THEN 'skip' ELSE 'link' END AS action FROM i""", prefix=False)  # fmt: skip
def doc_dedup_gate(v: Views) -> DataFrame:
    d = F.col("doc_id")
    # asked for by inputs, index and links: the texts are read and identified once
    ids = spooled(ingest.content_ids(v.table("documents")).select("doc_id", "content_id"))
    rows = ids.withColumn("owner_id", F.concat(F.lit("owner_"), (d % 3).cast("string"))).withColumn("g", F.concat(F.lit("g"), (d % 2).cast("string")))
    links = rows.where(d % 5 == 0).select("content_id", "owner_id", F.col("g").alias("group_id"))
    gated = ingest.gate(rows.withColumn("group_id", F.when(d % 4 > 0, F.col("g"))).drop("g"), rows.where(d % 5 < 2), links)
    return gated.select("doc_id", "action")


@query(f"WITH {CID} SELECT count(*) FILTER (action = 'link') AS linked, count(*) FILTER (action = 'index') AS prepared, count(*) FILTER (action = 'skip') AS skipped, 0::BIGINT AS failed, true AS success FROM (SELECT CASE WHEN content_id IN (SELECT content_id FROM cid WHERE doc_id % 5 < 2) THEN 'link' ELSE 'index' END AS action FROM cid)", prefix=False)
def ingest_outcome(v: Views) -> DataFrame:
    ids = spooled(ingest.content_ids(v.table("documents")).select("doc_id", "content_id")).withColumn("owner_id", F.lit("o")).withColumn("group_id", F.lit(None).cast("string"))
    return ingest.outcome(ingest.gate(ids, ids.where("doc_id % 5 < 2"), ids.limit(0)))


@query("SELECT text, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text", prefix=False)
def coalesced_embed_inputs(v: Views) -> DataFrame:
    return v.table("documents").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))


@query()
def ingest_prepared(v: Views) -> DataFrame:
    return ingest.prepared(v.table("documents"), "Owner_1").select("document_id", "pos", "text", "partition_id", "owner_id")


def _nested(f: str, pairs) -> str:
    out = f
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query(f"""WITH a AS (SELECT doc_id, {_nested('text', T.LIGATURES)} AS t FROM documents), b AS (SELECT doc_id, translate(replace(t, chr(173), ''), '{T.SPACES}', '{' ' * len(T.SPACES)}') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, ' {{2,}}', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM d)
SELECT doc_id, regexp_replace(t, '^[\\p{{Z}}\\s]+|[\\p{{Z}}\\s]+$', '', 'g') AS clean FROM e""", prefix=False)  # fmt: skip
def sanitize_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


def _html_sql() -> str:
    t = "html"
    for tag in T.DROPPED:
        t = f"regexp_replace({t}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    t = f"regexp_replace({t}, '</?\\s*(?:{'|'.join(T.BLOCKS)})(?:\\s[^>]*)?>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for name, c in T.ENTITIES:
        t = f"regexp_replace({t}, '&{name};', '{c.replace(chr(39), chr(39) * 2)}', 'gi')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '^[\\p{{Z}}\\s]+|[\\p{{Z}}\\s]+$', '', 'g')"
    return f"SELECT page_id, coalesce(nullif({t}, ''), html) AS body FROM pages"


@query(_html_sql(), prefix=False)
def html_extract(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.html_text(F.col("html"), entities=False).alias("body"))


@query("SELECT conv_id, count(*) AS parts, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id", prefix=False)
def multi_part_inputs(v: Views) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return v.table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.array_join(turns, "\n\n").alias("body"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, printf('%.4f', value) AS shown FROM events", prefix=False)
def scalar_formats(v: Views) -> DataFrame:
    return v.table("events").select("event_id", misc.epoch_seconds(F.col("ts")).alias("seconds"), misc.iso_time(F.col("ts")).alias("iso"), misc.four_digits(F.col("value")).alias("shown"))


# --- registry -----------------------------------------------------------------------
EARN = "e AS (SELECT p_partkey AS document_id, sum(l_extendedprice * (1 - l_discount)) AS earned FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)"


@query(f"WITH {EARN} SELECT p_brand AS group_id, count(*) AS documents, round(sum(coalesce(earned, 0)), 2) AS total_earnings FROM part LEFT JOIN e ON p_partkey = document_id GROUP BY p_brand", prefix=False)
def group_earnings(v: Views) -> DataFrame:
    earned = v.table("lineitem").groupBy(F.col("l_partkey").alias("document_id")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("earned"))
    parts = v.table("part").select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("group_id"))
    return parts.join(earned, "document_id", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum(F.coalesce("earned", F.lit(0.0))), 2).alias("total_earnings"))


@query("SELECT document_id, round(sum(earned), 2) AS earned, sum(n)::BIGINT AS n FROM (SELECT p_partkey AS document_id, p_retailprice AS earned, 1 AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT l_partkey, l_extendedprice, 1 FROM lineitem WHERE l_discount > 0.05) GROUP BY 1", prefix=False)
def accumulate_earnings(v: Views) -> DataFrame:
    stats = v.table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("document_id"), F.col("p_retailprice").alias("earned"), F.lit(1).alias("n"))
    delta = v.table("lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("document_id"), F.col("l_extendedprice").alias("earned"), F.lit(1).alias("n"))
    return accumulated(stats, delta, "document_id", ["earned", "n"]).select("document_id", F.round("earned", 2).alias("earned"), "n")


@query("SELECT user_id AS document_id, count(*) AS n, round(sum(value), 4) AS value, arg_max(ts, event_id) FILTER (event_type <> 'error') AS last_retrieved FROM events GROUP BY user_id", prefix=False)
def accumulate_performance(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("user_id").alias("document_id"), "value", F.lit(1).alias("n"), F.when(F.col("event_type") != "error", F.col("ts")).alias("last_retrieved"), F.col("event_id").alias("seq"))
    out = accumulated(e.limit(0), e, "document_id", ["n", "value"], "last_retrieved", "seq")
    return out.select("document_id", "n", F.round("value", 4).alias("value"), "last_retrieved")


@query("SELECT user_id AS document_id, event_type AS partition_id, count(*) AS n, round(CASE WHEN count(*) FILTER (value > 20) > 0 THEN sum(value) FILTER (value > 20) / count(*) FILTER (value > 20) ELSE 0.5 END, 6) AS sentiment FROM events GROUP BY ALL", prefix=False)
def partition_sentiment(v: Views) -> DataFrame:
    rated = F.col("value") > 20
    rows = v.table("events").groupBy(F.col("user_id").alias("document_id"), F.col("event_type").alias("partition_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(rated, F.col("value"))).alias("total"), F.count_if(rated).alias("rated"))
    return rows.select("document_id", "partition_id", "n", F.round(V.average_sentiment(F.col("total"), F.col("rated")), 6).alias("sentiment"))


@query("SELECT (SELECT count(DISTINCT document_id) FROM v_document_access) AS documents, (SELECT count(*) FROM v_group) AS groups, (SELECT count(DISTINCT owner_id) FROM v_owner_document) AS owners, (SELECT count(*) FROM v_document_access WHERE access = 'available') AS available")
def registry_totals(v: Views) -> DataFrame:
    return Registry.of(v).totals()


LIB = "SELECT g.group_id, label, owner_id, access, coalesce(docs, '') AS documents FROM {} g LEFT JOIN (SELECT group_id, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS docs FROM v_document_group GROUP BY 1) d USING (group_id)"


def _lib(df: DataFrame) -> DataFrame:
    return df.select("group_id", "label", "owner_id", "access", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"))


@query(LIB.format(f"(SELECT * FROM v_group WHERE owner_id = '{OWNER}' OR access = 'available')"))
def owner_library(v: Views) -> DataFrame:
    return _lib(Registry.of(v).library(OWNER, include_available=True))


@query(LIB.format("(SELECT * FROM v_group WHERE group_id IN (SELECT group_id FROM v_document_group WHERE document_id IN (10, 11, 20)))"))
def library_by_document(v: Views) -> DataFrame:
    return _lib(Registry.of(v).library_of_documents(v.document.where(F.col("document_id").isin(10, 11, 20))))


PAGE = f", p AS (SELECT group_id, owner_id, row_number() OVER (ORDER BY group_id) AS n FROM v_group WHERE (owner_id = '{OWNER}' OR access = 'available') AND group_id > 'owner_1-g1')"


@query(PAGE + " SELECT group_id, owner_id, (SELECT count(*) > 4 FROM p) AS has_more FROM p WHERE n <= 4")
def library_page(v: Views) -> DataFrame:
    return Registry.of(v).page(OWNER, "owner_1-g1", 4, include_available=True)


@query(", b AS (SELECT owner_id, document_id FROM v_owner_document UNION SELECT owner_id, document_id FROM v_document_group JOIN v_group USING (group_id, owner_id)) SELECT document_id, array_to_string(list_sort(list(DISTINCT owner_id)), ',') AS owners FROM b GROUP BY 1 HAVING count(DISTINCT owner_id) > 1")
def co_owners(v: Views) -> DataFrame:
    return Registry.of(v).co_owners().select("document_id", F.array_join("owners", ",").alias("owners"))


@query(f"SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM v_document_group WHERE group_id = '{OWNER}-g1') THEN 'available' ELSE access END AS access FROM v_document_access")
def access_cascade(v: Views) -> DataFrame:
    return Registry.of(v).with_group_access(OWNER, f"{OWNER}-g1", "available").document_access


@query(f"SELECT document_id, CASE WHEN document_id = 10 THEN 'available' ELSE access END AS access FROM v_document_access WHERE EXISTS (SELECT 1 FROM v_owner_document WHERE document_id = 10 AND owner_id = '{OWNER}')")
def document_access_change(v: Views) -> DataFrame:
    return Registry.of(v).with_access(OWNER, 10, "available").with_access("owner_nobody", 11, "available").document_access


@query(f", l AS (SELECT owner_id, document_id, group_id FROM v_document_group WHERE NOT (owner_id = '{OWNER}' AND document_id % 20 < 11)) SELECT (SELECT count(*) FROM l) AS links, (SELECT count(DISTINCT document_id) FROM l) AS documents, (SELECT count(*) FROM v_document_access WHERE document_id IN (SELECT document_id FROM l) AND access = 'available') AS available, (SELECT count(*) FROM (SELECT DISTINCT document_id, group_id FROM v_document_group EXCEPT SELECT document_id, group_id FROM v_document_group WHERE owner_id = '{OWNER}' AND document_id % 20 < 11) WHERE document_id IN (SELECT document_id FROM l)) AS members")
def unlink_owner(v: Views) -> DataFrame:
    r = Registry.of(v)
    after = r.unlinked(r.owner_document.where((F.col("owner_id") == OWNER) & (F.col("document_id") % 20 < 11)).select("owner_id", "document_id"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(after.owner_document, "links").crossJoin(n(after.owner_document.select("document_id").distinct(), "documents")).crossJoin(n(after.document_access.where("access = 'available'"), "available")).crossJoin(n(after.document_group, "members"))


@query(f"SELECT group_id, count(*) AS members FROM (SELECT DISTINCT group_id, document_id FROM v_document_group WHERE owner_id <> '{OWNER}') GROUP BY group_id")
def remove_owner_all(v: Views) -> DataFrame:
    return Registry.of(v).without_owner(OWNER).document_group.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT DISTINCT document_id, CASE WHEN document_id = 3 AND owner_id = 'owner_3' THEN 'owner_3-g2' ELSE group_id END AS group_id FROM v_document_group")
def move_document(v: Views) -> DataFrame:
    return Registry.of(v).moved(OWNER, 3, f"{OWNER}-g2").moved("owner_5", 3, "owner_5-g0").document_group


NEW = """, new AS (SELECT owner_id, document_id, 'owner_' || (document_id % 2) || '-g0' AS group_id FROM v_owner_document WHERE document_id < 30),
put AS (SELECT n.document_id, arg_max(CASE WHEN g.owner_id = n.owner_id THEN g.access ELSE 'restricted' END, n.owner_id) AS access FROM new n LEFT JOIN v_group g USING (group_id) GROUP BY 1)
"""


@query(NEW + "SELECT document_id, coalesce(p.access, a.access) AS access FROM v_document_access a FULL JOIN put p USING (document_id)")
def register_documents(v: Views) -> DataFrame:
    """In order of owner; the last row of a document decides."""
    new = v.owner_document.where("document_id < 30").select("owner_id", "document_id", F.concat(F.lit("owner_"), (F.col("document_id") % 2).cast("string"), F.lit("-g0")).alias("group_id"))
    new = new.withColumn("label", F.lit("x")).withColumn("tags", F.array(F.lit("t"))).withColumn("access", F.lit(None).cast("string")).withColumn("seq", F.substring("owner_id", -1, 1).cast("int"))
    return Registry.of(v).registered(new).document_access


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN group_id = 'memory-' || owner_id THEN 'memory' WHEN group_id = 'resonance-' || owner_id THEN 'resonance' ELSE 'document' END AS kind FROM (SELECT owner_id, CASE right(group_id, 1) WHEN '0' THEN 'memory-' || owner_id WHEN '1' THEN 'resonance-' || owner_id ELSE group_id END AS group_id FROM v_group)) GROUP BY kind")
def group_kinds(v: Views) -> DataFrame:
    last = F.substring("group_id", -1, 1)
    g = v.group.withColumn("group_id", F.when(last == "0", F.concat(F.lit("memory-"), "owner_id")).when(last == "1", F.concat(F.lit("resonance-"), "owner_id")).otherwise(F.col("group_id")))
    return g.groupBy(misc.group_kind(F.col("group_id"), F.col("owner_id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'orphan' AS what, document_id FROM v_document WHERE document_id % 11 = 0 UNION ALL SELECT 'lost', document_id FROM v_document WHERE document_id % 13 = 0 AND document_id % 11 <> 0")
def orphan_cleanup(v: Views) -> DataFrame:
    r = Registry.of(v)
    part = Registry(r.owner_document, r.document_group, r.groups, r.document_access.where("document_id % 11 <> 0"))
    indexed = v.document.where("document_id % 13 <> 0 OR document_id % 11 = 0")
    return part.orphans(indexed).select(F.lit("orphan").alias("what"), "document_id").union(part.lost(indexed).select(F.lit("lost"), "document_id"))


# --- graph --------------------------------------------------------------------------
EDGES = f""", e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS pos FROM (SELECT a.shard_id, a.partition_id AS src, b.partition_id AS dst, {l2_sql('a.embedding', 'b.embedding')} AS d
FROM v_node a JOIN v_node b ON a.shard_id = b.shard_id AND a.partition_id <> b.partition_id WHERE NOT a.is_deleted AND NOT b.is_deleted)), edge AS (SELECT * FROM e WHERE pos <= 16)
"""


@query(EDGES + "SELECT shard_id, src, dst, pos::INT AS pos, round(d, 6) AS distance FROM edge")
def graph_edges_knn(v: Views) -> DataFrame:
    return graph.knn_edges(v.node).select("shard_id", "src", "dst", "pos", r6("distance"))


@query(EDGES + "SELECT shard_id, count(*) FILTER (NOT is_deleted) AS live, count(*) FILTER (is_deleted) AS deleted, max(level) AS max_level, round(avg(coalesce(g, 0)), 6) AS mean_degree FROM v_node LEFT JOIN (SELECT src, count(*) AS g FROM edge GROUP BY 1) ON src = partition_id GROUP BY shard_id")
def graph_stats(v: Views) -> DataFrame:
    return graph.stats(v.node, graph.knn_edges(v.node)).withColumn("mean_degree", F.round("mean_degree", 6))


@query("SELECT document_id, count(*) FILTER (NOT is_deleted) AS live, max(level) FILTER (NOT is_deleted) AS max_level, bool_or(NOT is_deleted) AS trained FROM v_node GROUP BY 1")
def document_graph_stats(v: Views) -> DataFrame:
    return graph.document_stats(v.node)


@query("SELECT partition_id, shard_id, level FROM v_node WHERE level > 0 AND NOT is_deleted")
def graph_hubs(v: Views) -> DataFrame:
    return graph.hubs(v.node).select("partition_id", "shard_id", "level")


@query(f"SELECT partition_id, level FROM v_node p WHERE {OWNED}")
def graph_personal(v: Views) -> DataFrame:
    return v.node.join(search.scope_documents(v, OWNER, "personal"), "document_id", "left_semi").select("partition_id", "level")


@query(f"SELECT partition_id, level FROM v_node p WHERE ({OWNED} OR {PUBLIC}) AND NOT is_deleted AND shard_id = 0")
def graph_global_shard(v: Views) -> DataFrame:
    return v.node.where("shard_id = 0 AND NOT is_deleted").join(search.scope_documents(v, OWNER, "global"), "document_id", "left_semi").select("partition_id", "level")


@query(EDGES + "SELECT partition_id, coalesce(n, '') AS neighbours FROM v_node LEFT JOIN (SELECT src, array_to_string(list(dst ORDER BY pos), ',') AS n FROM edge GROUP BY 1) ON src = partition_id WHERE shard_id = 0")
def graph_neighbors(v: Views) -> DataFrame:
    nodes = v.node.where("shard_id = 0")
    return graph.neighbours(nodes, graph.knn_edges(nodes)).select("partition_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(EDGES + "SELECT partition_id, coalesce(n, '') AS neighbours FROM v_node LEFT JOIN (SELECT src, array_to_string(list(dst ORDER BY pos), ',') AS n FROM edge WHERE pos <= 4 GROUP BY 1) ON src = partition_id WHERE partition_id IN (1, 5, 126, 200, 333)")
def node_batch(v: Views) -> DataFrame:
    ids = v.spark.createDataFrame([(i,) for i in (1, 5, 126, 200, 333, 10**9)], "partition_id bigint")
    edges = graph.prune(graph.knn_edges(v.node), 4)
    return graph.neighbours(v.node, edges, ids).select("partition_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("SELECT shard_id, arg_max(local_idx, level * 1000 - local_idx) AS local_idx FROM v_node WHERE NOT is_deleted GROUP BY 1")
def entry_point(v: Views) -> DataFrame:
    return graph.entry_points(v.node)


@query("SELECT partition_id, shard_id, (CASE WHEN shard_id = 1 THEN row_number() OVER (PARTITION BY shard_id ORDER BY local_idx) - 1 ELSE local_idx END)::INT AS local_idx FROM v_node WHERE NOT is_deleted")
def graph_compact(v: Views) -> DataFrame:
    nodes = v.node
    edges = nodes.limit(0).select(F.col("partition_id").alias("src"), F.col("partition_id").alias("dst"))
    return graph.compact(nodes, edges)[0].select("partition_id", "shard_id", "local_idx")


PLACED = ", d AS (SELECT document_id, shard_id FROM v_partition UNION SELECT document_id, shard_id + 1 FROM v_partition WHERE document_id % 6 = 0)"


@query(PLACED + " SELECT document_id, max(shard_id)::INT AS shard_id, count(DISTINCT shard_id) AS copies FROM d GROUP BY 1 HAVING count(DISTINCT shard_id) > 1")
def cross_shard_dedup(v: Views) -> DataFrame:
    p = v.partition.select("document_id", "shard_id")
    return graph.newest_shard(p.union(p.where("document_id % 6 = 0").select("document_id", (F.col("shard_id") + 1).cast("int"))))


@query("SELECT shard_id, partition_id, local_idx FROM v_partition WHERE partition_id % 9 = 0")
def phantom_sweep(v: Views) -> DataFrame:
    p = v.partition.select("shard_id", "partition_id", "local_idx")
    return graph.phantoms(p.union(p.where("partition_id % 9 = 0").select("shard_id", "partition_id", (F.col("local_idx") + 1000).cast("int"))))


@query("SELECT document_id, max(shard_id) AS shard_id FROM v_node WHERE NOT is_deleted GROUP BY 1")
def routing_rebuild(v: Views) -> DataFrame:
    return graph.routing(v.node)


@query("SELECT document_id, (document_id // 10)::INT AS shard_id FROM v_document")
def shard_fill(v: Views) -> DataFrame:
    docs = v.partition.groupBy("document_id").agg(F.count(F.lit(1)).alias("nodes")).withColumn("seq", F.col("document_id"))
    return graph.fill(docs, 46)


# --- queue and log ------------------------------------------------------------------
@query("""WITH j AS (SELECT event_id AS seq, user_id % 4 AS lane, event_type AS o, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS kind FROM events),
m AS (SELECT *, CASE WHEN kind = 'put' AND lag(kind) OVER w = 'put' AND lag(o) OVER w = o THEN 0 ELSE 1 END AS fresh FROM j WINDOW w AS (PARTITION BY lane ORDER BY seq)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY lane ORDER BY seq ROWS UNBOUNDED PRECEDING) AS batch FROM m)
SELECT lane, batch::BIGINT AS batch, min(seq) AS first, max(seq) AS last, count(*) AS items FROM b GROUP BY ALL""", prefix=False)  # fmt: skip
def queue_coalesce(v: Views) -> DataFrame:
    return log.coalesced(_jobs(v), "lane").select("lane", "batch", "first", "last", "items")


def _jobs(v: Views) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    return v.table("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("lane"), F.col("event_type").alias("owner_id"), F.lit("g").alias("group_id"), kind.alias("kind"), F.lit(1).cast("long").alias("items"))


VALID = ", ok AS (SELECT * FROM v_log WHERE seq < (SELECT min(seq) FROM v_log WHERE corrupt))"


@query(VALID + " SELECT op, count(*) AS n, max(seq) AS last FROM ok WHERE seq <= (SELECT max(seq) FROM ok WHERE op = 'commit') GROUP BY op")
def wal_commit_prefix(v: Views) -> DataFrame:
    return log.committed(v.log).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query(VALID + """ SELECT document_id, bool_or(op = 'registered') AS registered, count(*) FILTER (op = 'performance') AS retrievals, round(coalesce(sum(value) FILTER (op = 'performance'), 0), 4) AS sentiment,
round(coalesce(sum(value) FILTER (op = 'earnings' AND value > 0), 0), 4) AS earned, arg_max(ts, seq) FILTER (op = 'performance') AS last_retrieved FROM ok WHERE seq > 100 AND op <> 'commit' GROUP BY 1""")  # fmt: skip
def wal_replay_registry(v: Views) -> DataFrame:
    twice = v.log.unionByName(v.log.where("seq % 7 = 0"))
    return log.replay(twice, 100).withColumn("sentiment", F.round("sentiment", 4)).withColumn("earned", F.round("earned", 4))


from lodestar.plans import upkeep  # noqa: E402, F401
