"""Exact, filterable top-k search and the steps after it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import vector as V

K = 3
PER_SHARD = 10 * K
POOL = 3 * K
OWNER_BOOST = 0.9
TAG_THRESHOLD = 0.85
#: Query vectors up to this many bytes go along with the task; more are joined by a broadcast of the vectors' side in blocks.
QUERY_BYTES = 64 << 20


def _nearest(batches, queries: np.ndarray, ids: np.ndarray, k: int, keys: list[str], carry: list[str]):
    """The k nearest rows of each batch for every query and value of ``keys``, by a matrix product over the batch."""
    names = [*keys, "partition_id", *carry]
    square = (queries * queries).sum(1)
    for b in batches:
        column = b.column("embedding")
        if not b.num_rows:
            continue
        size = np.diff(column.offsets.to_numpy())
        ok = np.flatnonzero(size == queries.shape[1])  # empty vectors and those of another dimension aren't searched
        if not len(ok):
            continue
        b = b.take(pa.array(ok))
        x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, queries.shape[1])
        group = np.zeros(len(x), np.int64) if not keys else np.unique(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys]), axis=1, return_inverse=True)[1].ravel()
        near = square[:, None] - 2 * queries @ x.T + (x * x).sum(1)
        rows, qs = [], []
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            for q in range(len(queries)):
                d = near[q, own]
                if len(own) > k:
                    cut = np.partition(d, k - 1)[k - 1]
                    take = own[d <= cut + 1e-9]
                else:
                    take = own
                rows.append(take)
                qs.append(np.full(len(take), q))
        at, qs = np.concatenate(rows), np.concatenate(qs)
        exact = np.empty(len(at))
        for a in range(0, len(at), 65536):
            s = slice(a, a + 65536)
            d = x[at[s]] - queries[qs[s]]
            exact[s] = (d * d).sum(1)
        taken = b.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(ids[qs]), *(taken.column(c) for c in names), pa.array(exact)], ["query_id", *names, "distance"])


def candidates(vectors: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, keys, partition_id, carry, distance, rank): the k nearest vectors of each query within each value of ``keys``.

    One scan; each task keeps its own k, and a window over those k decides, so
    what is shuffled grows with tasks and queries and not with the vectors. Ties
    go by partition_id. Columns named in ``carry`` come along. Queries are
    requests and few; if they are large they are cross-joined by Spark instead.
    """
    got = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow() if _small(queries) else None
    kinds = dict(vectors.dtypes)
    schema = ", ".join(["query_id bigint", *(f"{c} {kinds[c]}" for c in (*keys, "partition_id", *carry)), "distance double"])
    if got is None:
        pairs = vectors.crossJoin(queries).where(F.size("embedding") == F.size("query"))
        found = pairs.select("query_id", *keys, "partition_id", *carry, V.squared_l2(F.col("query"), F.col("embedding")).alias("distance"))
    elif not got.num_rows:
        found = vectors.sparkSession.createDataFrame([], schema)
    else:
        q, ids = np.array(got.column("query").to_pylist(), np.float64), got.column("query_id").to_numpy()
        slim = vectors.select(*keys, "partition_id", *carry, "embedding").where("embedding IS NOT NULL")
        found = slim.mapInArrow(lambda b: _nearest(b, q, ids, k, list(keys), list(carry)), schema)
    rank = F.row_number().over(W.partitionBy("query_id", *keys).orderBy("distance", "partition_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _small(queries: DataFrame) -> bool:
    n = queries.agg(F.sum(F.size("query") * 8)).first()[0] or 0
    return n <= QUERY_BYTES


def thresholds(nodes: DataFrame, least: int = 11) -> DataFrame:
    """(shard_id, threshold): the running distance threshold of each shard, from (shard_id, local_idx, embedding).

    A proposal is mean + 1.5 standard deviations of the distances from a node to
    at most 150 evenly strided nodes before it. One is made for the 64th node, or
    the last of a smaller shard, and takes effect whole; then for every 64th, and
    counts a tenth. Shards of fewer nodes than ``least`` have none.
    """
    n = nodes.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    at = nodes.join(n, "shard_id").where("local_idx + 1 = least(n, 64) OR (local_idx + 1 > 64 AND (local_idx + 1) % 64 = 0)")
    at = at.select("shard_id", F.col("local_idx").alias("m"), F.col("embedding").alias("node"))
    step = F.greatest(F.lit(1), F.floor(F.col("m") / F.least(F.lit(150), F.col("m"))))
    pairs = at.join(nodes.select("shard_id", "local_idx", "embedding"), "shard_id").where((F.col("local_idx") < F.col("m")) & (F.col("local_idx") % step == 0) & (F.col("local_idx") / step < 150))
    d = V.squared_l2(F.col("node"), F.col("embedding"))
    made = pairs.groupBy("shard_id", "m").agg((F.avg(d) + 1.5 * F.stddev_pop(d)).alias("t"))
    series = made.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "t"))), lambda s: s["t"]).alias("ts"))
    return series.select("shard_id", F.aggregate(F.slice("ts", 2, 1 << 30), F.element_at("ts", 1), lambda t, p: 0.9 * t + 0.1 * p).alias("threshold"))


def cut(rows: DataFrame, by: list[str], distance: Column, threshold: Column) -> DataFrame:
    """Rows below the threshold; all of a group of which none is."""
    keep = distance < threshold
    return rows.withColumn("__keep", keep).withColumn("__any", F.max("__keep").over(W.partitionBy(*by))).where("__keep OR NOT __any").drop("__keep", "__any")


def tag_filter(documents: DataFrame, query_tags: Column | None) -> DataFrame:
    """Documents near enough to the tag vector, and untagged ones; all without a tag vector."""
    if query_tags is None:
        return documents
    d = V.tag_distance(F.col("tags_embedding"), query_tags)
    return documents.where(d.isNull() | (d < TAG_THRESHOLD))


def scope_documents(views, owner: str, scope: str, groups: list[str] | None = None, group: str | None = None, aggregate: bool = False) -> DataFrame:
    """(document_id) that a request may see, once each."""
    own = views.owner_document.where(F.col("owner_id") == owner).select("document_id")
    docs = own
    if scope == "global":
        docs = own.union(views.document_access.where("access = 'available'").select("document_id")).distinct()
    ids = groups or ([group] if group and not aggregate else [])
    if ids:
        docs = docs.join(views.document_group.where(F.col("group_id").isin(ids)).select("document_id"), "document_id", "left_semi")
    return docs.distinct()


def search(views, queries: DataFrame, owner: str, scope: str = "personal", groups: list[str] | None = None, group: str | None = None, aggregate: bool = False, tags: Column | None = None,
           rerank=lambda distance: distance, live: DataFrame | None = None, adc: DataFrame | None = None, per_shard: int = PER_SHARD, bound: DataFrame | None = None) -> DataFrame:
    """Two-level top-k: (query_id, partition_id, document_id, distance, adjusted, threshold, norm, position).

    Documents are filtered by scope, group and tag before the scan, candidates
    are taken per shard, made comparable by the shard's threshold, boosted for the
    owner's private documents in global scope, pooled, reranked and cut. The order
    of the answer is by adjusted distance; norm and boost only decide who is in
    the pool. ``bound`` is the table of thresholds(), if it is kept, as it should be for a large index;
    it has a row a shard, and Spark broadcasts it while it is small.

    With ``adc`` (query_id, partition_id, document_id, distance), in global scope,
    available groups without any candidate get their best partition injected, at
    most K a query, at its quantized distance, which is of another scale; such a
    query's pool is then chosen by norm alone, without boost.
    """
    nodes = live if live is not None else views.partition
    seen = scope_documents(views, owner, scope, groups, group, aggregate)
    if tags is not None:
        seen = tag_filter(seen.join(views.tags, "document_id", "left"), tags).select("document_id")
    found = candidates(nodes.join(seen, "document_id", "left_semi"), queries, per_shard, ("shard_id",), ("document_id",))
    bound = thresholds(views.partition) if bound is None else bound
    rows = found.join(bound, "shard_id", "left").withColumn("norm", V.threshold_norm(F.col("distance"), F.coalesce("threshold", F.lit(float("inf")))))
    best = F.row_number().over(W.partitionBy("query_id", "partition_id").orderBy("norm", "shard_id"))
    rows = rows.withColumn("best", best).where("best = 1")
    key = F.col("norm")
    if scope == "global":
        free = views.document_access.where("access = 'available'").select("document_id", F.lit(True).alias("free"))
        mine = views.owner_document.where(F.col("owner_id") == owner).select("document_id", F.lit(True).alias("mine")).distinct()
        rows = rows.join(free, "document_id", "left").join(mine, "document_id", "left")
        key = F.when(F.col("mine") & F.col("free").isNull(), F.col("norm") * OWNER_BOOST).otherwise(F.col("norm"))
        if adc is not None:
            rows, key = _diverse(views, rows, key, adc, groups or ([group] if group and not aggregate else []))
    pool = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(key, "partition_id"))).where(F.col("place") <= POOL)
    limit = bound.agg(F.coalesce(F.max("threshold"), F.lit(float("inf"))).alias("limit"))
    pool = pool.withColumn("adjusted", rerank(F.col("distance"))).crossJoin(F.broadcast(limit))
    kept = cut(pool, ["query_id"], F.col("adjusted"), F.col("limit"))
    position = F.row_number().over(W.partitionBy("query_id").orderBy("adjusted", "partition_id"))
    return kept.select("query_id", "partition_id", "document_id", "distance", "adjusted", F.col("limit").alias("threshold"), "norm", position.alias("position"))


def _diverse(views, rows: DataFrame, key: Column, adc: DataFrame, groups: list[str]) -> tuple[DataFrame, Column]:
    from lodestar.operators.quantize import diversity_floor

    have = rows.select("query_id", "document_id").join(views.document_group.select("document_id", "group_id"), "document_id").select("query_id", "group_id").distinct()
    new = diversity_floor(adc, have, views, K, groups)
    new = new.join(views.partition.select("partition_id", "document_id"), "partition_id").select("query_id", "partition_id", "document_id", "distance", F.col("distance").alias("norm"))
    changed = new.select("query_id").distinct().withColumn("changed", F.lit(True))
    rows = rows.withColumn("key", key).join(changed, "query_id", "left").withColumn("key", F.when(F.col("changed"), F.col("norm")).otherwise(F.col("key")))
    cols = ["query_id", "partition_id", "document_id", "distance", "norm"]
    both = rows.select(*cols, "key").unionByName(new.withColumn("key", F.col("norm")))
    return both.withColumn("best", F.lit(1)), F.col("key")


def average(ema: Column, value: Column, alpha: float) -> Column:
    """Exponential moving average; the first value counts whole."""
    return F.when(ema.isNull() | (ema == 0), value).otherwise((1 - alpha) * ema + alpha * value)


def adjustments(pool: DataFrame) -> DataFrame:
    """What reranking did to each row of (distance, adjusted, threshold)."""
    a, b, t = F.col("distance"), F.col("adjusted"), F.col("threshold")
    return pool.withColumn("factor", V.adjustment_factor(a, b)).withColumn("status", V.adjustment_status(a, b, t))


#: Hits that are held by the driver, to be looked up in one scan of the texts.
HITS = 100_000


def materialise(hits: DataFrame, content: DataFrame) -> DataFrame:
    """Attach the text of the few rows that are left; content is (partition_id, text).

    The hits are an answer to requests and so few; they are counted, and the texts
    are only scanned, never shuffled. Hits without text stay. An answer of more
    than HITS rows is joined as Spark sees fit.
    """
    got = hits.limit(HITS + 1).toArrow()
    if got.num_rows > HITS:
        return hits.join(content, "partition_id", "left")
    few = hits.sparkSession.createDataFrame(got)
    ids = hits.sparkSession.createDataFrame(got.select(["partition_id"]).group_by("partition_id").aggregate([]))
    found = content.join(F.broadcast(ids), "partition_id")
    # at most as many rows as there are hits
    return few.join(F.broadcast(found), "partition_id", "left")
